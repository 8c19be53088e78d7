"""Jaccard join against all pairs."""

import random
import re

import numpy as np
import pytest

from bytegrain.llm import jaccard_join as jj
from bytegrain.llm.components import connected_components
from bytegrain.llm.jaccard_join import jaccard_components


def shingles(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 3]) for i in range(max(1, len(words) - 2)))


def brute(rows, percent=90):
    sets = [shingles(t) for _, t in rows]
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                label[root(i)] = root(j)
    least = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            least[root(i)] = min(least.get(root(i), key), key)
    return sorted(
        ((rows[i][0], len(sets[i]), least.get(root(i))) for i in range(len(rows))), key=repr
    )


def got(spark, rows, **options):
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr(
        "doc_id", "text", "text AS cluster", "1 AS _n", "2 AS node"
    )
    found = jaccard_components(docs.repartition(3), **options).collect()
    return sorted(map(tuple, found), key=repr)


def texts(seed, groups, copies):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(3000)]
    common = rng.choices(words, k=40)
    rows = []
    for _ in range(groups):
        base = rng.choices(words, k=rng.choice([4, 12, 25, 60, 150]))
        if rng.random() < 0.3:
            base[2:2] = common
        for _ in range(rng.randrange(1, copies)):
            text = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
                at = rng.randrange(len(text))
                text[at : at + rng.randrange(2)] = [rng.choice(words)]
            rows.append(" ".join(text))
    rng.shuffle(rows)
    return [(i + 10, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("page", [512, 3])
def test_components(spark, page):
    rows = texts(1, 60, 9)
    rows += [(1, None), (2, ""), (3, " \n"), (4, "One"), (5, "one"), (6, "one two"), (7, "ONE\ttwo ")]
    rows += [(None, "one two"), (8, "É two"), (9, "é two"), (None, None), (None, "alone here")]
    want = brute(rows)
    assert len({c for *_, c in want}) < len(rows)
    assert got(spark, rows, page=page) == want


def test_a_chain_of_near_copies(spark):
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(words[3 * i : 3 * i + 150])) for i in range(80)]
    assert got(spark, rows, page=4) == brute(rows)
    assert got(spark, rows, page=4, percent=97) == brute(rows, 97)


def test_linked_sets_share_a_signature():
    rng = np.random.default_rng(4)
    for n in [*range(10, 40), 95, 200, 500, 1999]:
        x = np.unique(rng.integers(0, 1 << jj.TOKEN_BITS, n).astype(np.uint64))
        for _ in range(20):
            y = x.copy()
            fresh = rng.integers(0, 1 << jj.TOKEN_BITS, n).astype(np.uint64)
            changed = rng.integers(0, n // 19 + 1)
            y[rng.choice(len(y), changed, replace=False)] = fresh[:changed]
            cut = rng.integers(0, n // 10 + 1)
            y = np.unique(y[: len(y) - cut])
            overlap = len(np.intersect1d(x, y))
            if 190 * overlap >= 90 * (len(x) + len(y)) and len(np.setxor1d(x, y)):
                shared = np.intersect1d(jj.signatures(x, len(x), 90), jj.signatures(y, len(y), 90))
                assert len(shared)


def test_connected_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)]
    edges += [(1000 + i, 1001 + i) for i in range(40)] + [(5000, i) for i in range(5001, 5100)]
    label = {v: v for e in edges for v in e}
    for _ in range(400):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    rows = connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    linked = {v for a, b in edges if a != b for v in (a, b)}
    assert {r.node: r.label for r in rows} == {v: label[v] for v in linked}


def test_empty_table(spark):
    assert got(spark, []) == []
    assert got(spark, [(1, None)]) == [(1, 0, 1)]
