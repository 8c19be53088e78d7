import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import brute
from bytegrain.functions import segment
from bytegrain.model import COMPACT, SPEC, BpeModel, Layout
from bytegrain.operators import encoding
from bytegrain.operators.chunks import word_freq
from bytegrain.operators.decoding import decode
from bytegrain.operators.encoding import encode, segment_by_rounds, segment_chunks
from bytegrain.operators.quality import id_range, roundtrip
from bytegrain.operators.training import train
from test_text import ADVERSARIAL


def docs_of(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")


@pytest.fixture(scope="module")
def model(spark):
    text = "river stone over river stone under " * 50
    return train(word_freq(docs_of(spark, [text, *ADVERSARIAL])), SPEC.merges_start + 60)


@pytest.fixture(params=[1024, 0], ids=["whole text", "by chunk"])
def way(request, monkeypatch):
    """Both ways to encode."""
    monkeypatch.setattr(encoding, "WHOLE_TEXT_MERGES", request.param)


def test_roundtrip_of_adversarial_text(spark, model, way):
    docs = docs_of(spark, ADVERSARIAL + ["stone river"])
    decoded = decode(encode(docs, model), model)
    assert roundtrip(decoded).first() == (len(ADVERSARIAL) + 1, 0)
    assert id_range(encode(docs, model), model).first().in_range


def test_encoding_compresses(spark, model):
    text = "under stone " * 100
    (row,) = encode(docs_of(spark, [text]), model).collect()
    assert len(row.ids) < len(text)


def test_empty_null_and_special(spark, model, way):
    docs = docs_of(spark, ["", None, "hello"])
    plain = {r.doc_id: r.ids for r in encode(docs, model).collect()}
    assert plain[0] == [] and plain[1] is None
    marked = encode(docs, model, add_special=True)
    ids = {r.doc_id: r.ids for r in marked.collect()}
    assert ids[0] == [513, 514] and ids[2] == [513, *plain[2], 514]
    texts = decode(decode(marked, model, skip_special=False, out="all"), model).collect()
    got = {r.doc_id: (r.all, r.decoded) for r in texts}
    assert got[2] == ("<BOS>hello<EOS>", "hello") and got[0] == ("<BOS><EOS>", "")


@pytest.mark.parametrize("short", [32, 2])
def test_segmentation_equals_lowest_rank_first(spark, monkeypatch, short):
    """Both segmenters give what the brute force gives, and so do joins with the rank table."""
    monkeypatch.setattr(encoding, "WHOLE_TEXT_MERGES", 0)
    monkeypatch.setattr(segment, "SHORT", short)
    rng = random.Random(7)
    corpus = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 12))) for _ in range(60)]
    merges = brute.train([c.encode() for c in corpus], 40, 260)
    model = BpeModel(COMPACT, "cl100k", merges)
    unseen = ["".join(rng.choice("abcé") for _ in range(rng.randint(1, 15))) for _ in range(200)]
    unseen += ["".join(rng.choice("abcdé") for _ in range(n)) for n in (255, 257, 700)] + ["a" * 600]
    want = {c: brute.segment(c.encode(), merges, 260) for c in unseen}
    table = segment.pair_table(np.array([m[:2] for m in merges]), 260)
    for way in (segment.segment_short, segment.segment_long):
        assert {c: way(list(c.encode()), table) for c in unseen} == want
    words = spark.createDataFrame([(c,) for c in unseen], "chunk string")
    assert {r.chunk: r.ids for r in segment_chunks(words, model).collect()} == want
    texts = docs_of(spark, [" ".join(unseen[i : i + 9]) for i in range(0, 200, 9)])
    assert roundtrip(decode(encode(texts, model), model)).first().mismatches == 0


@pytest.mark.parametrize("seed, start", [(1, 260), (2, 260), (3, 55_290)])
def test_rounds_of_joins_equal_the_heap(spark, monkeypatch, seed, start):
    """Random vocabularies, whose merges needn't come from any training; ids around 55,296."""
    layout = Layout("wide", 256, ("<UNK>",), start - 257)
    rng = random.Random(seed)
    merges, ids = [], [*b"abc"]
    while len(merges) < 60:
        pair = (rng.choice(ids), rng.choice(ids), None)
        if pair not in merges:
            ids.append(start + len(merges))
            merges.append(pair)
    model = BpeModel(layout, "cl100k", merges)
    chunks = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 40))) for _ in range(80)]
    words = spark.createDataFrame([(c,) for c in [*chunks, *chunks[:5], None]], "chunk string")
    want = {c: brute.segment(c.encode(), merges, start) for c in chunks}
    assert {r.chunk: r.ids for r in segment_by_rounds(words, model).collect()} == want
    known = {r.chunk: r.ids for r in segment_chunks(words.dropna(), model).collect()}
    assert known == want
    docs = docs_of(spark, chunks)
    for whole in (0, 1024):
        monkeypatch.setattr(encoding, "WHOLE_TEXT_MERGES", whole)
        assert [r.ids for r in encode(docs, model).orderBy("doc_id").collect()] == [want[c] for c in chunks]
    assert [r.decoded for r in decode(encode(docs, model), model).orderBy("doc_id").collect()] == chunks
    assert segment_by_rounds(words.limit(0), model).collect() == []


def test_a_full_vocabulary_against_brute_force(spark):
    """Training to the end of all pairs and encoding with every merge learned."""
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(160)]
    texts = [" ".join(rng.choice(words) for _ in range(12)) for _ in range(40)]
    docs = docs_of(spark, texts)
    model = train(word_freq(docs), 50_304)
    chunks = [c.encode() for t in texts for c in pretokens(t)]
    assert model.merges == brute.train(chunks, 50_304, SPEC.merges_start) and len(model.merges) > 300
    for row in encode(docs, model).collect():
        want = [i for c in pretokens(row.text) for i in brute.segment(c.encode(), model.merges, SPEC.merges_start)]
        assert row.ids == want


def pretokens(text):
    """Chunks of lower-case words between single blanks."""
    return [w if i == 0 else f" {w}" for i, w in enumerate(text.split(" "))]


def test_all_ways_agree(spark, model, monkeypatch):
    docs = docs_of(spark, ADVERSARIAL)
    monkeypatch.setattr(encoding, "WHOLE_TEXT_MERGES", 1024)
    whole = encode(docs, model).collect()
    monkeypatch.setattr(encoding, "WHOLE_TEXT_MERGES", 0)
    assert encode(docs, model).collect() == whole


def test_encoding_shuffles_nothing(spark, model, monkeypatch):
    monkeypatch.setattr(encoding, "WHOLE_TEXT_MERGES", 0)
    plan = encode(docs_of(spark, ["hello"]), model)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("ArrowEvalPython") == 1


def test_a_worker_forgets_when_it_holds_much(monkeypatch):
    monkeypatch.setattr(segment, "KNOWN_CHUNKS", 3)
    held = segment.Segmenter(np.array([(97, 98)]), 300)
    lists = pa.array([["ab", "cab"], None, [], ["ab", "abab" * 40]], pa.list_(pa.string()))
    for _ in range(3):
        got = held.encode(lists).to_pylist()
        assert got == [[300, 99, 300], None, [], [300] * 81]
    assert "abab" * 40 not in held.known


def test_literal_specials_are_text(spark, model):
    (row,) = encode(docs_of(spark, ["<EOS>"]), model).collect()
    assert all(i < 256 or i >= SPEC.merges_start for i in row.ids)


@pytest.mark.parametrize(
    "raw", ["FF", "E28041", "F09F98", "C328", "EDA080", "E282", "41C0AF42", "", "68C3A9"]
)
def test_decoding_of_malformed_bytes(spark, raw):
    data = bytes.fromhex(raw)
    rows = spark.createDataFrame([(1, list(data))], "k int, ids array<int>")
    model = BpeModel(COMPACT, "cl100k", [])
    got = decode(rows, model).first().decoded
    assert got == data.decode("utf-8", errors="replace")


@pytest.mark.parametrize("doublings", [0, 24])
def test_decoding_does_not_depend_on_keys_or_vocabulary_size(spark, doublings):
    """Null and empty arrays, repeated and null keys; a token of 16 MB in the vocabulary."""
    merges = [(97, 97, 1), *((260 + i, 260 + i, 1) for i in range(doublings))][:doublings]
    rows = [(1, [97]), (1, [98]), (None, [99]), (2, None), (3, [])]
    coded = spark.createDataFrame(rows, "k int, ids array<int>")
    got = decode(coded, BpeModel(COMPACT, "cl100k", merges)).collect()
    assert [(r.k, r.decoded) for r in got] == [(1, "a"), (1, "b"), (None, "c"), (2, None), (3, "")]


def test_unknown_fallback_and_reserved_ids(spark, model):
    ids = [104, 99999, -1, 256 + 105, 517, 516]
    rows = spark.createDataFrame([(ids,)], "ids array<int>")
    assert decode(rows, model).first().decoded == "h<UNK><UNK>i"
    kept = decode(rows, model, skip_special=False).first().decoded
    assert kept == "h<UNK><UNK>i<UNUSED_0><SEP>"


def test_legacy_loses_text(spark):
    docs = docs_of(spark, ["naïve snake_case"])
    model = train(word_freq(docs, "legacy"), 265, COMPACT, "legacy")
    row = decode(encode(docs, model), model).first()
    assert row.decoded == "nave snakecase"


def test_vocabulary_layouts(spark, model):
    rows = {r.token_id: r for r in model.vocab_table(spark).collect()}
    assert len(rows) == model.vocab_size == 528 + 60 and sorted(rows) == list(range(588))
    assert bytes(rows[65].bytes) == b"A" and bytes(rows[321].bytes) == b"A"
    assert [rows[i].surface for i in range(512, 518)] == [
        "<PAD>", "<BOS>", "<EOS>", "<UNK>", "<SEP>", "<UNUSED_0>",
    ]
    for _, left, right, new, _ in model.merge_rows:
        assert rows[new].bytes == rows[left].bytes + rows[right].bytes
    assert COMPACT.merges_start == 260 and SPEC.merges_start == 528


def test_only_a_few_merges_are_replayed_on_texts(spark):
    docs = spark.createDataFrame([(0, "abab")], "doc_id int, text string")
    for merges, arrow in ((4, False), (32, True)):
        model = BpeModel(COMPACT, "cl100k", [(97, 98 + i, None) for i in range(merges)])
        plan = encode(docs, model)._jdf.queryExecution().toString()
        assert ("ArrowEvalPython" in plan) == arrow


def test_chunks_are_segmented_in_pieces(monkeypatch):
    held = segment.Segmenter(np.array([(97, 98), (300, 300)]), 300)
    lists = [["abab", "é"], None, [], ["x"] * 7, ["abab" * 9, "", "ab"], [], None]
    chunks = pa.array(lists, pa.list_(pa.string()))
    whole = held.encode(chunks).to_pylist()
    assert whole[0] == [301, 195, 169] and whole[1] is None and whole[2] == []
    monkeypatch.setattr(segment, "PIECE_CHUNKS", 2)
    assert held.encode(chunks).to_pylist() == whole
    assert held.encode(chunks.slice(2, 3)).to_pylist() == whole[2:5]
    assert held.encode(chunks.slice(0, 0)).to_pylist() == []


def test_encoding_a_large_batch_takes_little_memory():
    held = segment.Segmenter(np.array([(97, 98)]), 300)
    chunks = pa.array([["abab", "abc", "x"] * 700] * 1000, pa.list_(pa.string()))  # 2.1 million
    tracemalloc.start()
    try:
        ids = held.encode(chunks)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(ids) == 1000 and ids[999].as_py()[:5] == [300, 300, 300, 99, 120]
    assert peak < 60e6
