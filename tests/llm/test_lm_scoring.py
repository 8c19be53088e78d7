"""Stupid backoff against counting document by document."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest


from bytegrain.llm.arrow import pack, unpack
from bytegrain.llm.lm_scoring import joined, score_documents, split


def brute(rows, order, backoff=0.4):
    texts = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]

    def counts(words):
        return Counter(tuple(words[i : i + m]) for m in range(1, order + 1) for i in range(len(words) - m + 1))

    own = list(map(counts, texts))
    total = sum(own, Counter())
    n = sum(map(len, texts))
    found = []
    for (key, _), words, mine in zip(rows, texts, own):
        score, highest, unseen = 0.0, 0, 0
        for i, _ in enumerate(words):
            factor = 1.0
            for m in range(min(order, i + 1), 0, -1):
                gram = tuple(words[i - m + 1 : i + 1])
                c = total[gram] - mine[gram]
                if c > 0:
                    context = total[gram[:-1]] - mine[gram[:-1]] if m > 1 else n - len(words)
                    score += math.log(factor * c / context)
                    highest += m == order
                    break
                factor *= backoff
            else:
                score += math.log(factor / max(n - len(words), 1))
                unseen += 1
        mean = round(score / len(words), 9) if words else None
        found.append((key, len(words), round(score, 6), mean, highest, unseen))
    return sorted(found, key=repr)


@pytest.mark.parametrize("order, fan", [(1, 2048), (2, 2048), (3, 2048), (2, 3), (3, 2), (3, 1)])
def test_scores(spark, order, fan):
    """Also where blocks meet the hash ranges in teams."""
    rng = random.Random(order)
    words = [f"w{i}" for i in range(60)] + ["é", "x\x1cy"]
    rows = [(i, " ".join(rng.choices(words, range(1, 63), k=rng.randrange(50)))) for i in range(40)]
    rows += [(5, "w1 w2 only\nhere"), (5, "w1 w2 only\nhere"), (None, "w3"), (90, None), (91, " \t"), (92, "z")]
    docs = spark.createDataFrame(rows, "doc_id int, text string").selectExpr("*", "1 AS _block", "text AS bucket")
    got = [
        (r.doc_id, r.n_words, round(r.log_score, 6) + 0.0, r.mean_log_score and round(r.mean_log_score, 9), r.n_highest, r.n_unseen)
        for r in score_documents(docs.repartition(3), order=order, fan=fan).collect()
    ]
    assert sorted(got, key=repr) == brute(rows, order)


def test_few_rows(spark):
    docs = spark.createDataFrame([(1, "alone in here")], "doc_id int, text string")
    (row,) = score_documents(docs).collect()
    assert row.n_unseen == 3
    assert score_documents(docs.where("false")).collect() == []


@pytest.mark.parametrize("texts", [[""], [None], ["", None, " \n"], ["", "a b", None]])
def test_blocks_without_words(spark, texts):
    """Documents without words score 0, also where no document of their block has any."""
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    for r in score_documents(docs).collect():
        if texts[r.doc_id] != "a b":
            assert tuple(r)[1:] == (0, 0.0, None, 0, 0)


def test_many_blocks(spark):
    """More blocks than a table may have buckets."""
    docs = spark.createDataFrame([(i, f"w{i % 5} and w{i % 7}") for i in range(50)], "doc_id int, text string")
    expected = sorted(map(tuple, score_documents(docs).collect()))
    most = "spark.sql.sources.bucketing.maxBuckets"
    before = spark.conf.get(most)
    spark.conf.set(most, "3")
    try:
        assert sorted(map(tuple, score_documents(docs, fan=2).collect())) == expected
    finally:
        spark.conf.set(most, before)


def test_teams_without_words(spark):
    docs = spark.createDataFrame([(0, ""), (1, None), (2, "a b")], "doc_id int, text string")
    got = {r.doc_id: tuple(r)[1:] for r in score_documents(docs, fan=2).collect()}
    assert got[0] == got[1] == (0, 0.0, None, 0, 0)
    assert got[2][0] == got[2][4] == 2
    assert score_documents(docs.where("false"), fan=2).collect() == []


@pytest.mark.parametrize("values", [[], [0], [7, 0, 2**32 - 1], [2**32, 1], [2**64 - 1, 0, 5]])
def test_halves(values):
    arrays, _ = unpack(pack(*split(np.array(values, np.uint64))))
    assert joined(arrays, 0).tolist() == values
