"""Jaccard join against all pairs."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from bytegrain.llm import near_copies as jj
from bytegrain.llm.near_copies import near_copy_components
from bytegrain.session import Stage


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
    found = near_copy_components(docs.repartition(3), **{"width": 3, "percent": 90, **options}).collect()
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
                (left, few), (right, many) = jj.signatures(x, len(x), 90), jj.signatures(y, len(y), 90)
                shared = np.intersect1d(left, right)
                assert len(shared) >= min(few, many) >= 1
                assert len(shared)


def test_sketches_never_lose_a_link():
    rng = np.random.default_rng(5)
    for n in [1, 2, 30, 300, 700, 5000]:
        x = np.unique(rng.integers(0, 1 << jj.TOKEN_BITS, n).astype(np.uint64))
        for changed in [0, 1, n // 20, n // 9, n // 5, n // 2, n]:
            fresh = np.unique(rng.integers(0, 1 << jj.TOKEN_BITS, changed).astype(np.uint64))
            y = np.union1d(x[min(changed, len(x) - 1) :], fresh)
            sizes = len(x) + len(y)
            words = [np.frombuffer(jj.sketch(t, jj.sketch_bits(len(t))), np.uint64) for t in (x, y)]
            for width in (8, min(map(len, words))):
                differ = int(np.bitwise_count(jj.fold(words[0], width) ^ jj.fold(words[1], width)).sum())
                assert differ <= len(np.setxor1d(x, y))
                assert jj.within(differ, sizes, 80) or not jj.linked(x, y, 80)
    assert not jj.within(differ, sizes, 80)


@pytest.mark.parametrize("sizes", [[1] * 150, [70, 1, 1, 90, 2, 65, 3], [2] * 40, [200]])
def test_groups_meet_once(monkeypatch, sizes):
    monkeypatch.setattr(jj, "PAIRS", 1 << 10)
    nodes, sigs = sum(sizes), np.array([5], np.int64).tobytes()
    comps = np.repeat(np.arange(len(sizes)), sizes)
    table = pa.table(
        {"node": np.arange(nodes), "comp": comps, "need": [1] * nodes, "n": [9] * nodes, "sigs": [sigs] * nodes, "bits": [bytes(64)] * nodes}
    )
    found = jj.Sketches(table, 80).pairs().to_pylist()
    assert all(r["k"] == r["need"] == 1 for r in found)
    want = [(a, b) for b in range(nodes) for a in range(b) if comps[a] != comps[b]]
    assert sorted((r["a"], r["b"]) for r in found) == sorted(want)


def test_texts_that_share_a_passage_make_few_pairs(spark):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(9000)]
    passage = rng.choices(words, k=240)
    rows = [(i, " ".join(passage + rng.choices(words, k=110))) for i in range(120)]
    rows += [(120, rows[0][1] + " more")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = Stage(jj.set_table(docs, "doc_id", "text", 5), "sets").df
    shared = Stage(jj.shared_signatures(sets, 80), "shared").df
    alone = spark.createDataFrame([], "node long, label long")
    pairs = jj.pairs_across(shared, sets, alone, 80)
    assert 1 <= pairs.count() < len(rows)
    assert jj.verified(pairs, sets, 80).count() == 1


def test_components_are_bridged_by_one_pair(spark):
    matches = [(1, 2, 9), (3, 2, 5), (4, 2, 7), (5, 6, 8), (7, 8, 3), (7, 4, 1)]
    labels = [(1, 1), (3, 1), (2, 2), (4, 2), (6, 6), (9, 6)]
    found = jj.bridges(
        spark.createDataFrame(matches, "node long, hub long, k long"),
        spark.createDataFrame(labels, "node long, label long"),
    )
    assert sorted(map(tuple, found.collect())) == [(1, 2), (5, 6), (7, 4)]


def test_empty_table(spark):
    assert got(spark, []) == []
    assert got(spark, [(1, None)]) == [(1, 0, 1)]
