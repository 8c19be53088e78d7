"""Toxicity: held-out accuracy, located sentences, and the noisy-or by hand."""

import math
import random
import zlib

from bytegrain.llm.catalog import op5_toxicity
from bytegrain.llm.toxicity import Finder, Model, fit, reject_toxic, score_toxicity, train_toxicity

SF_DIR = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    rows = {r.doc_id: r for r in op5_toxicity(spark, SF_DIR).collect()}
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet").collect()
    held = [r for r in labels if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert all(rows[r.doc_id].held_out for r in held)
    toxic = [rows[r.doc_id].predicted for r in held if r.toxic]
    clean = [rows[r.doc_id].predicted for r in held if not r.toxic]
    assert sum(toxic) / len(toxic) > 0.8
    assert sum(clean) / len(clean) < 0.01
    assert all((r.score >= 0.7) == bool(r.predicted) for r in rows.values())


def test_score_is_the_noisy_or_of_sentences(spark):
    model = Model(("bad$", "wors"), (6.0, 3.0), -5.0)
    text = "All is well. A BAD, bad thing!\nWorse İ and worst. badly done"
    docs = spark.createDataFrame(
        [(1, text, 0), (1, text, 1), (2, None, 0), (None, "", 0), (4, " .\n!", 0)],
        "doc_id int, text string, score int",
    )
    got = {(r.doc_id, round(r.score, 9)): r.offending for r in score_toxicity(docs, model).collect()}

    def p(z):
        return 1 / (1 + math.exp(-z))

    want = 1 - (1 - p(-5)) ** 2 * (1 - p(1)) * (1 - p(-2))
    assert set(got) == {(1, round(want, 9)), (2, 0.0), (None, 0.0), (4, 0.0)}
    (span,) = got[1, round(want, 9)]
    assert text[span.start : span.stop] == " A BAD, bad thing"


def test_training_finds_the_sentence(spark):
    rng = random.Random(3)
    words = [f"w{i}ord".replace(str(i), chr(97 + i % 26) * (1 + i // 26)) for i in range(200)]
    rows, labels = [], []
    for i in range(300):
        sentences = [" ".join(rng.choices(words, k=8)) for _ in range(12)]
        if i % 5 == 0:
            sentences[rng.randrange(12)] += f" snarl{rng.choice(words)} here"
        rows.append((i, ". ".join(sentences), "x"))
        labels.append((i, 1 if i % 5 == 0 else 0, "y"))
    labels += [(None, 1, ""), (5000, 1, ""), (7, None, ""), (0, 0, "")]
    docs = spark.createDataFrame(rows, "doc_id int, text string, _label string")
    model = train_toxicity(docs, spark.createDataFrame(labels, "doc_id int, toxic int, text string"))
    assert "snarl" in model.terms
    for r in score_toxicity(docs, model).collect():
        assert (r.score > 0.7) == (r.doc_id % 5 == 0)
        if r.doc_id % 5 == 0:
            (span,) = r.offending
            assert "snarl" in rows[r.doc_id][1][span.start : span.stop]


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "text")], "doc_id int, text string")
    labels = spark.createDataFrame([], "doc_id int, toxic int")
    (row,) = score_toxicity(docs, train_toxicity(docs, labels)).collect()
    assert row.score < 0.01 and row.offending == []
    assert score_toxicity(docs.where("false"), Model((), (), 0.0)).collect() == []


def test_fit_without_terms():
    class Row:
        label, plain, sentences = 1, 3, []

    weights, bias = fit([Row], 0)
    assert len(weights) == 0 and bias > -8
    assert Finder(()).sentences("One. Two")[0] == 2


def test_toxic_rows_go_and_others_stay_as_they_are(spark):
    model = Model(("bad$",), (25.0,), -20.0)
    rows = [(1, "A bad thing.", 0.5, None), (1, "All is well.", 0.5, "x"), (2, None, None, "x")]
    rows += [(None, "", 1.0, "x"), (1, "All is well.", 0.5, "x")]
    rows += [(9, "well. " * 300_000, 0.1, None), (10, "x. " * 300_000 + "bad", 0.1, None)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, score double, offending string")
    kept = reject_toxic(docs, model, 0.7)
    assert kept.schema == docs.schema
    want = [r for r in rows if "bad" not in (r[1] or "")]
    assert sorted(map(repr, map(tuple, kept.collect()))) == sorted(map(repr, want))
    assert reject_toxic(docs.where("false"), model, 0.7).collect() == []
