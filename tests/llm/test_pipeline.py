"""The pipeline stage by stage against the brute-force versions of its operators."""

import hashlib

import pytest
from tokenizers import Tokenizer

import corpus_pipeline as cp
import public_tokenizers
from llm.test_jaccard_join import brute as brute_components
from llm.test_mixing import brute as brute_mix
from llm.test_substring_dedup import brute as brute_repeats

from bytegrain.session import Stage

SF_DIR = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def staged(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    tables = [docs]
    for name, stage in cp.STAGES:
        docs = Stage(stage(spark, docs, SF_DIR), name).df
        tables.append(docs)
    return [t.collect() for t in tables], [t.columns for t in tables]


def test_columns_and_order(staged):
    assert [n for n, _ in cp.STAGES][0] == "toxicity"
    assert staged[1][:-1] == [COLUMNS] * 5


def test_toxic_documents_go(spark):
    larger = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{larger}/documents.parquet")
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{larger}/labels.parquet").collect()}
    kept = cp.toxicity(spark, docs, larger)
    assert kept.columns == COLUMNS
    assert kept.exceptAll(docs).isEmpty()
    left = {r.doc_id for r in kept.select("doc_id").collect()}
    gone = [labels[d] for d in labels if d not in left]
    assert sum(gone) > 0.8 * sum(labels.values())
    assert sum(x == 0 for x in gone) < 0.01 * len(labels)


def test_near_copies_go(monkeypatch, staged):
    before, after = staged[0][1:3]

    def shingles(text, width=5):
        words = (text or "").encode().lower().split()
        return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1)))

    from llm import test_jaccard_join

    monkeypatch.setattr(test_jaccard_join, "shingles", shingles)
    want = [key for key, _, component in brute_components([(r.doc_id, r.text) for r in before], 80) if key == component]
    assert sorted(r.doc_id for r in after) == sorted(want)
    assert len(want) < len(before)
    assert {tuple(r) for r in after} <= {tuple(r) for r in before}


def test_repeated_passages_go(staged):
    before, after = staged[0][2:4]
    want = {
        key: kept.decode(errors="ignore")
        for key, _, _, kept in brute_repeats([(r.doc_id, r.text) for r in before], 400)
    }
    assert {r.doc_id: r.text for r in after} == want
    assert len(before) == len(after) and all(r.n_chars == len(r.text) for r in after)


def test_sources_are_mixed(staged):
    before, after = staged[0][3:5]
    taken = brute_mix([(r.doc_id, r.text, r.source) for r in before], cp.WEIGHTS)
    want = {key: words // size for key, size, *_, words in taken if size}
    got = dict.fromkeys(want, 0)
    for r in after:
        if r.doc_id in got:
            got[r.doc_id] += 1
    assert got == want


def test_texts_are_encoded(staged):
    before, after = staged[0][4:]
    library = Tokenizer.from_file(public_tokenizers.path(cp.TOKENIZER))
    want = []
    for r in before:
        ids = library.encode(r.text, add_special_tokens=False).ids
        packed = b"".join(i.to_bytes(4, "little") for i in ids)
        want.append((r.doc_id, len(ids), packed, hashlib.sha256(r.text.encode()).hexdigest()))
    assert sorted((r.doc_id, r.n_tokens, bytes(r.ids), r.decoded_sha256) for r in after) == sorted(want)


def test_stages_handle_odd_rows(spark):
    rows = [
        (None, None, None, None, None),
        (1, "", "en", None, 0),
        (2, "one two three four five six", "en", "b", 1),
        (2, "one two three four five six", "en", "b", 1),
        (3, "ONE two three four five six", None, "a", 1),
        (4, "é" * 500, "fr", "a", 500),
        (5, "x" + "é" * 450, "fr", "a", 451),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    empty = docs.where("false")
    for name, stage in cp.STAGES:
        docs = Stage(stage(spark, docs, SF_DIR), name).df
        empty = Stage(stage(spark, empty, SF_DIR), name).df
        assert empty.count() == 0
        if name == "near_copies":
            assert sorted(r.doc_id for r in docs.where("doc_id > 1").collect()) == [2, 4, 5]


def test_replacement_signs_stay(spark):
    passage = "".join(chr(0x4E00 + i * 37 % 5000) for i in range(150))
    rows = [
        (1, "read \ufffd as it was \ufffd"),
        (2, "\ufffd" + "é" + passage + "à\ufffd"),
        (3, "\ufffdè" + passage + "á"),
        (4, "x" * 399 + "\ufffd"),
        (5, "é" + "\ufffd" * 140 + "ab\ufffd" + "c"),
        (6, "ĩ" + "\ufffd" * 140 + "ad\ufffd" + "c"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr(
        "doc_id", "text", "'en' AS lang", "'a' AS source", "CAST(length(text) AS bigint) AS n_chars"
    )
    after = {r.doc_id: r for r in cp.repeated_passages(spark, docs, SF_DIR).collect()}
    assert {key: r.text for key, r in after.items()} == {
        1: rows[0][1],
        2: "\ufffdé\ufffd",
        3: "\ufffdè",
        4: rows[3][1],
        5: "b\ufffdc",
        6: "d\ufffdc",
    }
    assert all(r.n_chars == len(r.text) for r in after.values())


def test_near_copies_by_row(spark):
    a, b, c, d, e = (" ".join(f"{x}{i}" for i in range(30)) for x in "abcde")
    rows = [
        (1, a, "x"),
        (2, a.upper(), "x"),  # a copy of 1 that shares its id with b
        (2, b, "x"),
        (3, b + " more", "y"),  # a near copy of b
        (4, c, "x"),  # near copies that share an id
        (4, c + " more", "x"),
        (None, d, "x"),  # near copies without id
        (None, d + " more", "x"),
        (None, e, "x"),
        (9, e, "y"),
        (None, "alone", None),
        (7, "twice " + a[::-1], "x"),  # equal rows
        (7, "twice " + a[::-1], "x"),
        (8, None, "x"),
        (8, "", "x"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = cp.near_copies(spark, docs.repartition(3), SF_DIR)
    assert kept.columns == docs.columns
    left = [tuple(r) for r in kept.collect()]
    assert set(left) <= set(rows)
    for group in (rows[:2], rows[2:4], rows[9:10], rows[10:11], rows[11:12], rows[13:14], rows[14:15]):
        assert left.count(group[0]) == 1
        assert all(row not in left for row in group[1:])
    assert rows[8] not in left
    assert sum(r in left for r in rows[4:6]) == sum(r in left for r in rows[6:8]) == 1
    assert len(left) == 9
