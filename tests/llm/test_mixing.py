"""Mixing against a plain computation over sorted draws."""

import hashlib
import random
import re
from collections import defaultdict

import pytest

from bytegrain.llm import mixing
from bytegrain.llm.mixing import cyclic_weights, mix


def brute(rows, cycle, most=3):
    sizes = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _ in rows]
    sources = sorted({s for *_, s in rows}, key=lambda s: (s is None, s or ""))
    weight = {s: cycle[i % len(cycle)] for i, s in enumerate(sources)}
    total_of = defaultdict(int)
    for size, (*_, s) in zip(sizes, rows):
        total_of[s] += size
    target = dict.fromkeys(sources, 0.0)
    excess, open_ = float(sum(sizes)), set(sources)
    while excess > 1e-9 and open_:
        share = excess / sum(weight[s] for s in open_)
        excess = 0.0
        for s in sorted(open_, key=str):
            target[s] += share * weight[s]
            if target[s] >= most * total_of[s]:
                excess += target[s] - most * total_of[s]
                target[s] = float(most * total_of[s])
                open_.discard(s)
    taken = {}
    for s in sources:
        n = total_of[s]
        whole = min(int(target[s] / n + 1e-9), most) if n else 0
        rest = target[s] - whole * n
        groups = defaultdict(list)
        for i, (key, _, src) in enumerate(rows):
            if src == s:
                name = f"mix:{'' if key is None else key}".encode()
                groups[int(hashlib.md5(name).hexdigest()[:9], 16)].append(i)
                taken[i] = whole * sizes[i]
        upto = 0
        for draw in sorted(groups):
            size = sum(sizes[i] for i in groups[draw])
            if upto < rest and (upto + size < rest or upto + size - rest <= rest - upto):
                for i in groups[draw]:
                    taken[i] += sizes[i]
            upto += size
    return sorted(
        ((rows[i][0], sizes[i], total_of[rows[i][2]], round(target[rows[i][2]], 3), taken[i]) for i in taken),
        key=repr,
    )


def table(n, seed):
    rng = random.Random(seed)
    rows = [
        (i, " ".join(["w"] * int(rng.paretovariate(1.1))), rng.choice(["a", "a", "a", "b", "Ä", "z", None]))
        for i in range(n)
    ]
    rows += [(n, None, "a"), (n + 1, "", "empty"), (None, "x\x1cy z", "b"), (3, "again and again", "b")]
    return rows


@pytest.mark.parametrize("broadcast", [100_000, 0])
@pytest.mark.parametrize("n", [40, 400])
def test_mix(spark, monkeypatch, n, broadcast):
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", broadcast)
    rows = table(n, n)
    docs = spark.createDataFrame(
        [(*r, "x", 1.0) for r in rows], "doc_id long, text string, source string, size string, weight double"
    )
    got = [
        (r.doc_id, r["size"], r.source_size, round(r.target, 3), r.taken)
        for r in mix(docs, cyclic_weights(docs, (5, 2, 1))).collect()
    ]
    assert sorted(got, key=repr) == brute(rows, (5, 2, 1))


def test_hot_draws_and_budget(spark):
    docs = spark.createDataFrame([(1, "a b c", "s")] * 5 + [(2, "a", "t")], "doc_id int, text string, source string")
    rows = mix(docs, cyclic_weights(docs, (1,)), budget=8).collect()
    assert sorted((r.source, r.copies) for r in rows) == [("s", 0)] * 5 + [("t", 3)]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id int, text string, source string")
    assert mix(docs, cyclic_weights(docs, (5, 2, 1))).collect() == []
