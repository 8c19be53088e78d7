import pathlib
import random

import pytest
from pyspark.sql import functions as F

from bytegrain.operators.corpus import corpus_stats, prepare_corpus
from bytegrain.operators.ordering import in_key_order, with_rank, with_start
from bytegrain.operators.shards import assign_shards, cap_shards, resume_shards, shard_text
from bytegrain.operators.chunks import word_freq, word_freq_joined
from bytegrain.sources.tables import write_shards
from bytegrain.operators.splits import assign_split, cut_split, token_offsets, token_table


def docs_of(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")


def test_prepare_counts_code_points_after_trimming(spark):
    docs = docs_of(spark, ["  " + "é" * 5 + " \n", "abcd   ", "　abcde", None])
    got = {r.doc_id: r.text for r in prepare_corpus(docs, min_chars=5).collect()}
    assert got == {0: "é" * 5, 2: "abcde"}


def test_stats(spark):
    docs = docs_of(spark, ["a" * 10, " b ", "c" * 9])
    row = corpus_stats(docs, min_chars=5, shard_size=1).first()
    assert row.asDict() == {
        "docs_seen": 3, "docs_kept": 2, "total_chars": 19, "approx_tokens": 4, "shards_written": 2,
    }
    empty = corpus_stats(docs.where("false")).first()
    assert (empty.docs_seen, empty.total_chars, empty.shards_written) == (0, 0, 0)


@pytest.mark.parametrize("partitions", [1, 5])
def test_rank_and_offsets(spark, partitions):
    rng = random.Random(3)
    keys = rng.sample(range(10_000), 500)
    rows = [(k, rng.choice("ab"), rng.randint(0, 9)) for k in keys]
    df = spark.createDataFrame(rows, "k bigint, g string, n bigint").repartition(partitions)
    ranks = {r.k: r["rank"] for r in with_rank(df.select("k"), "k").collect()}
    assert ranks == {k: i for i, k in enumerate(sorted(keys))}
    at, want = {"a": 0, "b": 0}, {}
    for k, g, n in sorted(rows):
        want[k] = at[g]
        at[g] += n
    assert {r.k: r.start_offset for r in with_start(df, "n", "g", "k").collect()} == want


def test_shards_and_tail(spark):
    docs = docs_of(spark, [f"d{i}" for i in range(25)])
    rows = assign_shards(docs, 10).orderBy("doc_id").collect()
    assert [r.shard_id for r in rows] == [i // 10 for i in range(25)]
    assert [r.doc_id for r in rows if r.shard_last] == [9, 19, 24]
    capped = cap_shards(assign_shards(docs, 10), 2)
    assert capped.count() == 20
    with pytest.raises(ValueError):
        cap_shards(docs, 0)
    texts = {r.file_name: r.text for r in shard_text(assign_shards(docs, 10)).collect()}
    assert texts["chunk_00002.txt"] == "\n\n".join(f"d{i}" for i in range(20, 25))


@pytest.mark.parametrize("size", [1, 3, 7, 100])
@pytest.mark.parametrize("kind", ["bigint", "string"])
def test_shards_of_other_keys(spark, kind, size):
    """Keys with gaps, as text too, one of them null: the shard follows from the rank."""
    rng = random.Random(size)
    keys = [None, *rng.sample(range(-500, 500), 60)]
    if kind == "string":
        keys = [k if k is None else f"{'é' if k % 3 else 'z'}{k}" for k in keys]
    order = sorted(keys, key=lambda k: (k is not None, k.encode() if isinstance(k, str) else k or 0))
    df = spark.createDataFrame([(k, "t") for k in keys], f"doc_id {kind}, text string").repartition(4)
    got = {r.doc_id: (r.shard_id, r.shard_last) for r in assign_shards(df, size, first_shard=5).collect()}
    last = len(order) - 1
    assert got == {k: (5 + i // size, i % size == size - 1 or i == last) for i, k in enumerate(order)}
    for shards in (1, 2, 1000):
        kept = assign_shards(df, size, max_new=shards).collect()
        assert {r.doc_id for r in kept} == set(order[: shards * size])
    with pytest.raises(ValueError):
        assign_shards(df, size, max_new=0)


def test_text_moves_once_into_the_shards(spark, tmp_path):
    docs_of(spark, [f"d{i}" for i in range(50)]).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    sharded = assign_shards(docs, 10, max_new=2)
    plan = sharded._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan.split("Subquery")[0]
    assert "LessThanOrEqual(doc_id,19)" in plan
    staged = pathlib.Path(spark.conf.get("spark.checkpoint.dir")) / "bytegrain"
    held = [spark.read.parquet(str(p)).columns for p in staged.glob("ranked-*")]
    assert held and all("text" not in columns for columns in held if "doc_id" in columns)
    write_shards(sharded, str(tmp_path / "out"))
    rows = spark.read.parquet(str(tmp_path / "out")).orderBy("doc_id").collect()
    assert [(r.doc_id, r.shard_id) for r in rows] == [(i, i // 10) for i in range(20)]
    assert len(list((tmp_path / "out").glob("shard_id=*/*.parquet"))) == 2


def test_resume_numbers_on(spark):
    docs = docs_of(spark, [f"d{i}" for i in range(30)])
    landed = assign_shards(docs.where("doc_id % 3 = 0"), 4)
    new = resume_shards(docs, landed, 4, max_new=2).orderBy("doc_id").collect()
    assert [r.shard_id for r in new] == [3] * 4 + [4] * 4
    assert all(r.doc_id % 3 for r in new)
    nothing = landed.where("false")
    assert resume_shards(docs, nothing, 4).agg(F.min("shard_id")).first()[0] == 0


@pytest.mark.parametrize("pattern", ["cl100k", "legacy"])
def test_joined_training_text(spark, pattern):
    """Chunks of documents joined by blank lines, against splitting the joined text itself."""
    texts = ["one two", "ends.", "'s start", "(x) 12", "été _", "a  b", "ümlaut", "7"]
    sharded = assign_shards(docs_of(spark, texts), 3)
    got = {r.chunk: r.freq for r in word_freq_joined(sharded, pattern).collect()}
    whole = word_freq(shard_text(sharded), pattern)
    assert got == {r.chunk: r.freq for r in whole.collect()}


def test_hot_chunk(spark):
    """One chunk holds most of the occurrences."""
    docs = docs_of(spark, [" the" * 2000 + f" w{i}" for i in range(50)])
    got = {r.chunk: r.freq for r in word_freq(docs.repartition(8)).collect()}
    assert got[" the"] == 100_000 and got[" w"] == 50


def encoded(spark):
    rows = [(i, list(range(i % 4))) for i in range(40)]
    return spark.createDataFrame(rows, "doc_id bigint, ids array<int>")


def test_split_and_token_table(spark):
    split = assign_split(encoded(spark), 0.5)
    flat = {"train": [], "val": []}
    for r in split.orderBy("doc_id").collect():
        flat[r.split] += r.ids
    assert flat["train"] and flat["val"]
    for r in token_table(split).collect():
        assert flat[r.split][r.start_offset : r.start_offset + len(r.ids)] == r.ids
    assert token_offsets(split).count() == 40


def test_ids_are_never_shuffled(spark):
    """Offsets over several partitions, null arrays and splits; no exchange in the plan."""
    rng = random.Random(8)
    rows = [(k, rng.choice(["train", "val", None]), None if k % 11 == 5 else list(range(rng.randrange(5)))) for k in range(200)]
    df = spark.createDataFrame(rows, "doc_id bigint, split string, ids array<int>")
    table = token_table(in_key_order(df.repartition(5), "doc_id"))
    assert "Exchange" not in table._jdf.queryExecution().executedPlan().toString().replace("BroadcastExchange", "")
    at, want = {}, {}
    for k, split, ids in rows:
        want[k] = at.get(split, 0)
        at[split] = want[k] + len(ids or [])
    assert {r.doc_id: r.start_offset for r in table.collect()} == want
    with pytest.raises(ValueError):
        token_table(df.repartition(5))
    assert token_table(df.limit(0)).collect() == []


@pytest.mark.parametrize("share", [0.05, 0.5, 0.9, 0.99])
def test_split_by_offset(spark, share):
    table = token_table(encoded(spark).withColumn("split", F.lit("all"))).drop("split")
    flat = [i for r in table.orderBy("doc_id").collect() for i in r.ids]
    cut = cut_split(table, share).orderBy("doc_id").collect()
    border = int(len(flat) * share)
    got = {
        s: [i for r in sorted((r for r in cut if r.split == s), key=lambda r: r.start_offset) for i in r.ids]
        for s in ("train", "val")
    }
    assert got == {"train": flat[:border], "val": flat[border:]}
    for r in cut:
        part = got[r.split]
        assert part[r.start_offset : r.start_offset + len(r.ids)] == r.ids
