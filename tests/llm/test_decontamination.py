"""Hits of item windows against a search of every place of every text."""

import random
import re
from collections import Counter

import pytest

from bytegrain.llm import decontamination
from bytegrain.llm.decontamination import contamination

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
DOCS, ITEMS = "doc_id bigint, text string", "item_id bigint, text string"


def words(text):
    upper = {c: c + 32 for c in range(65, 91)}
    return WORD.findall((text or "").translate(upper))


def brute(docs, items, window):
    wanted = {}
    for item, text in items:
        held = words(text)
        for i in range(max(len(held) - window + 1, min(len(held), 1))):
            wanted.setdefault(tuple(held[i : i + window]), set()).add("" if item is None else str(item))
    for doc, text in docs:
        held, hit, found = words(text), set(), set()
        for size in {len(w) for w in wanted}:
            for i in range(len(held) - size + 1):
                if (run := tuple(held[i : i + size])) in wanted:
                    hit |= set(range(i, i + size))
                    found |= wanted[run]
        yield (doc, len(held), len(hit), tuple(sorted(found)))


def check(spark, docs, items, window):
    left = spark.createDataFrame([(*d, "x", 1) for d in docs], DOCS + ", token string, `at` int").repartition(3)
    right = spark.createDataFrame([(*i, 1) for i in items], ITEMS + ", words int")
    got = contamination(left, right, window=window).collect()
    assert Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in got) == Counter(
        brute(docs, items, window)
    )


@pytest.mark.parametrize("seed, window, block, passes", [(1, 10, 256, 1), (2, 4, 7, 1), (3, 3, 5, 3), (4, 1, 2, 1)])
def test_random_texts(spark, monkeypatch, seed, window, block, passes):
    monkeypatch.setattr(decontamination, "BLOCK", block)
    if passes > 1:
        monkeypatch.setattr(decontamination, "PASS_WINDOWS", 12)
        monkeypatch.setattr(decontamination, "PASS_ITEMS", 0)
        monkeypatch.setattr(decontamination, "BROADCAST_ROWS", 0)
    draw = random.Random(seed)
    some = ["a", "B", "é", "É", "7", "zz", "日本"]

    def text(n):
        return "".join(draw.choice(some) + draw.choice([" ", "-", "\n", ", "]) for _ in range(n))

    items = [(i, text(draw.randrange(0, 9))) for i in range(8)]
    items += [(None, text(4)), (3, text(2)), (9, items[0][1]), (10, None), (11, ""), (12, "...")]
    docs = [(i, text(draw.randrange(0, 40))) for i in range(30)]
    docs += [(i % 4, docs[i][1] + items[i % 8][1]) for i in range(10)]
    docs += [(None, None), (None, ""), (1, None), (1, "?!"), *docs[:3], (None, text(900)), (5, docs[5][1])]
    check(spark, docs, items, window)


def test_windows_of_ten_words(spark):
    item = " ".join(f"w{i}" for i in range(25))
    near = item.replace("w12", "W12").upper()
    broken = " ".join("x" if i % 9 == 8 else f"w{i}" for i in range(25))
    docs = [(1, f"see {near}; end"), (2, broken), (3, " ".join(item.split()[5:15])), (4, f"{item} {item}")]
    check(spark, docs, [(7, item), (70, item), (8, "only four words here")], 10)


def test_empty_tables(spark):
    none, no_items = spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS)
    some = spark.createDataFrame([(1, "a b"), (None, None)], DOCS)
    assert contamination(none, no_items).collect() == []
    assert contamination(none, spark.createDataFrame([(1, "a b")], ITEMS)).collect() == []
    found = contamination(some, no_items).collect()
    assert sorted((r.n_words, r.n_hit, r["items"]) for r in found) == [(0, 0, []), (2, 0, [])]
