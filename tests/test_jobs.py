import base64
import json
from pathlib import Path

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from bytegrain.functions.segment import segment_long
from bytegrain.model import COMPACT, BpeModel, Layout
from bytegrain.operators.corpus import prepare_corpus
from bytegrain.operators.decoding import decode
from bytegrain.operators.encoding import encode
from bytegrain.plans.catalog import QUERIES, SAMPLE
from bytegrain.plans.jobs import build_corpus, encode_corpus, train_tokenizer
from bytegrain.sources.artifact import load_model, save_model
from bytegrain.sources.tables import read_shard_text, read_token_table, write_shard_text
from bytegrain.operators.shards import assign_shards
from bytegrain.streaming.ingest import ingest, ingest_encoded, read_stream


def docs_of(spark, texts, start=0):
    return spark.createDataFrame(list(enumerate(texts, start)), "doc_id bigint, text string")


def texts(n, seed=0):
    return [f" Document {seed + i} tells of rain, of more rain & of sun. " * 3 for i in range(n)]


def test_artifact_shape_and_reload(spark, tmp_path):
    model = BpeModel(COMPACT, "cl100k", [(104, 105, 3), (260, 33, 2)])
    save_model(spark, model, str(tmp_path / "a"))
    (part,) = (tmp_path / "a").glob("part-*")
    data = json.loads(part.read_text())
    assert data["vocab_size"] == 262 and data["merges"] == [[104, 105], [260, 33]]
    # Keys of the format, ids of the special tokens.
    assert data["special_tokens"] == {"<PAD>": 256, "<BOS>": 257, "<EOS>": 258, "<UNK>": 259}
    assert base64.b64decode(data["vocab"]["261"]) == b"hi!" and len(data["vocab"]) == 262
    loaded = load_model(spark, str(tmp_path / "a"))
    assert [m[:2] for m in loaded.merges] == [(104, 105), (260, 33)]
    assert loaded.layout == COMPACT and loaded.vocab_rows == model.vocab_rows


def test_pattern_and_specials_of_the_artifact(spark, tmp_path):
    save_model(spark, BpeModel(COMPACT, "legacy", [(104, 105, 3)]), str(tmp_path / "a"))
    assert load_model(spark, str(tmp_path / "a")).pattern == "legacy"
    with pytest.raises(ValueError):
        load_model(spark, str(tmp_path / "a"), "cl100k")
    for layout in (
        Layout("own", 256, ("<A>", "<B>", "<C>"), 2),
        Layout("own", 512, ("<Z>", "<UNK>"), 0, 256),
    ):
        model = BpeModel(layout, "cl100k", [(104, 105, 3), (layout.merges_start, 33, 1)])
        path = str(tmp_path / f"own{layout.special_start}")
        save_model(spark, model, path)
        loaded = load_model(spark, path)
        assert loaded.vocab_rows == model.vocab_rows
        ids = [layout.merges_start + 1, layout.special_start]
        (row,) = decode(
            spark.createDataFrame([(ids,)], "ids array<int>"), loaded, skip_special=False
        ).collect()
        assert row.decoded == "hi!" + layout.specials[0]


def test_resume_needs_the_same_key(spark, tmp_path):
    shards = str(tmp_path / "shards")
    docs = docs_of(spark, texts(5))
    build_corpus(docs, shards, min_chars=20)
    with pytest.raises(AnalysisException):
        build_corpus(docs.withColumnRenamed("doc_id", "page_id"), shards, min_chars=20, key="page_id")
    assert spark.read.parquet(shards).count() == 5


def test_indented_artifact_and_wrong_size_load(spark, tmp_path):
    data = {
        "vocab_size": 7,
        "special_tokens": {"<PAD>": 256, "<BOS>": 257, "<EOS>": 258, "<UNK>": 259},
        "vocab": {"65": "QQ=="},
        "merges": [[97, 98]],
    }
    (tmp_path / "t.json").write_text(json.dumps(data, indent=2))
    model = load_model(spark, str(tmp_path / "t.json"))
    assert model.vocab_size == 261
    (row,) = encode(docs_of(spark, ["abab"]), model).collect()
    assert row.ids == [260, 260]
    data["special_tokens"]["<UNK>"] = 300
    (tmp_path / "u.json").write_text(json.dumps(data))
    with pytest.raises(ValueError):
        load_model(spark, str(tmp_path / "u.json"))


@pytest.mark.parametrize(
    "change",
    [
        {"merges": [[97, 261]]},
        {"merges": [[97, 257]]},
        {"merges": [[97, -1]]},
        {"merges": [[97, 98, 99]]},
        {"merges": [[97]]},
        {"merges": [None]},
        {"merges": None},
        {"vocab": {"260": "YWM="}},
        {"vocab": {"65": "QkI="}},
        {"vocab": {"261": "YWI="}},
    ],
)
def test_malformed_artifacts_are_refused(spark, tmp_path, change):
    data = {
        "special_tokens": {"<PAD>": 256, "<BOS>": 257, "<EOS>": 258, "<UNK>": 259},
        "vocab": {"65": "QQ==", "260": "YWI="},
        "merges": [[97, 98]],
    }
    (tmp_path / "t.json").write_text(json.dumps(data))
    assert load_model(spark, str(tmp_path / "t.json")).vocab_size == 261
    (tmp_path / "u.json").write_text(json.dumps(data | change))
    with pytest.raises(ValueError):
        load_model(spark, str(tmp_path / "u.json"))


def test_an_artifact_of_60000_merges(spark, tmp_path):
    """Saved, loaded, and used on both sides of 55,296."""
    merges, ids = [], list(range(97, 123))
    while len(merges) < 60_000:
        at = len(merges)
        merges.append((ids[at % len(ids)], ids[(7 * at + at // 26) % 26], None))
        if at < 26 * 26 * 100:
            ids.append(COMPACT.merges_start + at)
    model = BpeModel(COMPACT, "cl100k", merges)
    save_model(spark, model, str(tmp_path / "a"))
    loaded = load_model(spark, str(tmp_path / "a"))
    assert loaded.merges == merges and loaded.vocab_size == 60_260
    contents = {row[0]: row[1].decode("latin-1") for row in model.vocab_rows}
    texts = [contents[i] for i in (300, 55_295, 55_296, 57_344, 60_259)]
    docs = docs_of(spark, [" ".join(texts), *texts])
    coded = encode(docs, loaded)
    assert [r.decoded for r in decode(coded, loaded).orderBy("doc_id").collect()] == [" ".join(texts), *texts]
    table = {pair[:2]: COMPACT.merges_start + at for at, pair in reversed(list(enumerate(merges)))}
    for row in coded.where("doc_id > 0").collect():
        assert row.ids == segment_long(list(row.text.encode()), table)
    rows = spark.createDataFrame([(1, [55_295, 55_296, 57_343, 57_344, 60_259])], "k int, ids array<int>")
    want = "".join(contents[i] for i in (55_295, 55_296, 57_343, 57_344, 60_259))
    assert decode(rows, loaded).first().decoded == want


def test_long_tokens_have_no_line_breaks_in_base64(spark, tmp_path):
    merges = [(97, 97, 1), *((260 + i, 260 + i, 1) for i in range(7))]
    save_model(spark, BpeModel(COMPACT, "cl100k", merges), str(tmp_path / "a"))
    (part,) = (tmp_path / "a").glob("part-*")
    assert base64.b64decode(json.loads(part.read_text())["vocab"]["267"], validate=True) == b"a" * 256


def test_shard_text_files(spark, tmp_path):
    sharded = assign_shards(docs_of(spark, ["a\n", "b\r\n c", "d"]), 2)
    write_shard_text(sharded, str(tmp_path / "s"))
    got = {r.shard_id: r.text for r in read_shard_text(spark, str(tmp_path / "s")).collect()}
    assert got == {0: "a\n\n\nb\r\n c", 1: "d"}


@pytest.mark.parametrize("by_offset,joined", [(False, False), (True, True)])
def test_corpus_to_tokens(spark, tmp_path, by_offset, joined):
    shards, model_path, tokens = (str(tmp_path / n) for n in ("shards", "model", "tokens"))
    build_corpus(docs_of(spark, texts(30)), shards, min_chars=20, shard_size=8, max_shards=2)
    assert spark.read.parquet(shards).count() == 16
    build_corpus(docs_of(spark, texts(30)), shards, min_chars=20, shard_size=8)
    landed = spark.read.parquet(shards)
    assert landed.count() == 30 and landed.select("doc_id").distinct().count() == 30
    staged = Path(spark.conf.get("spark.checkpoint.dir")) / "bytegrain"
    before = set(staged.glob("*"))
    trained = train_tokenizer(spark, shards, model_path, 560, joined=joined)
    assert trained.vocab_size == 560
    encode_corpus(spark, shards, model_path, tokens, by_offset=by_offset)
    build_corpus(docs_of(spark, texts(4, 90), 90), shards, min_chars=20, shard_size=8)
    assert set(staged.glob("*")) == before
    table = read_token_table(spark, tokens)
    assert {r.split for r in table.select("split").distinct().collect()} == {"train", "val"}
    if not by_offset:
        model = load_model(spark, model_path)
        back = {r.doc_id: r.decoded for r in decode(table, model).collect()}
        assert back == {i: t.strip() for i, t in enumerate(texts(30))}


def test_stream_resumes_without_repeats(spark, tmp_path):
    source, target, log = (str(tmp_path / n) for n in ("in", "out", "log"))
    for batch in range(3):
        docs_of(spark, texts(5, 5 * batch), 5 * batch).write.mode("append").parquet(source)
        for _ in range(2):
            stream = read_stream(spark, source, "doc_id bigint, text string", max_files=1)
            ingest(stream, target, log, min_chars=20)
        got = [r.doc_id for r in spark.read.parquet(target).orderBy("doc_id").collect()]
        assert got == list(range(5 * (batch + 1)))


def test_stream_encoding_equals_batch(spark, tmp_path):
    docs = docs_of(spark, texts(6) + ["", "unseen: ¡qué!"])
    docs.write.parquet(str(tmp_path / "in"))
    model = BpeModel(COMPACT, "cl100k", [(104, 101, 9), (108, 108, 8), (260, 261, 7)])
    stream = read_stream(spark, str(tmp_path / "in"), docs.schema, key="doc_id")
    ingest_encoded(stream, model, str(tmp_path / "out"), str(tmp_path / "log"), add_special=True)
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("doc_id").collect()
    want = encode(docs, model, add_special=True).select("doc_id", "ids").orderBy("doc_id").collect()
    assert got == want


def test_many_batches_with_a_stop(spark, tmp_path):
    """Over 300 merges, several batches, a stop that leaves a batch half done, and a resumption."""
    letters = "abcdefgh"
    words = [a + b + c for a in letters for b in letters for c in letters]
    merges = [(ord(a), ord(b), None) for a in letters for b in letters]
    merges += [(260 + i, ord(c), None) for i in range(64) for c in letters[:4]]
    model = BpeModel(COMPACT, "cl100k", merges)
    assert len(merges) > 300
    source, target, log = (str(tmp_path / n) for n in ("in", "out", "log"))
    parts = [[" ".join(words[(7 * i + j) % len(words)] for j in range(i % 9)) for i in range(at, at + 20)] for at in range(0, 100, 20)]
    for batch, part in enumerate(parts[:3]):
        docs_of(spark, part, 20 * batch).coalesce(1).write.mode("append").parquet(source)
    read = lambda: read_stream(spark, source, "doc_id bigint, text string", max_files=1)
    ingest_encoded(read(), model, target, log)
    for name in ("2", ".2.crc"):  # as if stopped before the last batch was committed
        (tmp_path / "log" / "commits" / name).unlink()
    for batch, part in enumerate(parts[3:], 3):
        docs_of(spark, part, 20 * batch).coalesce(1).write.mode("append").parquet(source)
    ingest_encoded(read(), model, target, log)
    got = spark.read.parquet(target).orderBy("doc_id").collect()
    docs = docs_of(spark, [t for part in parts for t in part])
    assert got == encode(docs, model).select("doc_id", "ids").orderBy("doc_id").collect()
    assert len(list((tmp_path / "log" / "offsets").glob("[0-9]*"))) == 5


@pytest.mark.parametrize("files", [0, 1, 3])  # 0: documents.parquet is a file itself
def test_stream_queries_read_a_file_or_a_folder(spark, tmp_path, files):
    source = docs_of(spark, [text * 2 for text in texts(40)])
    docs = source.repartition(max(files, 1))
    docs.write.parquet(str(tmp_path / "written"))
    if files:
        (tmp_path / "written").rename(tmp_path / "documents.parquet")
    else:
        (part,) = (tmp_path / "written").glob("part-*")
        part.rename(tmp_path / "documents.parquet")
    docs_of(spark, ["rain and more rain"]).selectExpr("doc_id AS item_id", "text").write.parquet(
        str(tmp_path / "benchmark.parquet")
    )
    for name in ("q_stream_encode", "q_stream_encode_large"):
        got = QUERIES[name](spark, str(tmp_path))
        assert sorted(r.doc_id for r in got.collect()) == list(range(40))
    want = sorted(r.doc_id for r in prepare_corpus(source, SAMPLE).collect())
    got = QUERIES["q_stream_ingest"](spark, str(tmp_path))
    assert want and sorted(r.doc_id for r in got.collect()) == want


def test_staged_tables_go_to_the_shared_folder(spark):
    from bytegrain.session import Stage

    stage = Stage(spark.range(3), "demo")
    folder = Path(stage.path)
    assert stage.path.startswith(spark.conf.get("spark.checkpoint.dir")) and folder.exists()
    assert stage.df.agg(F.sum("id")).first()[0] == 3
    stage.drop()
    assert not folder.exists()
