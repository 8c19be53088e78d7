"""A corpus from documents: without toxic texts and near copies, without repeated passages,
mixed by source, and encoded. Every stage is one operator of `bytegrain.llm`."""

from __future__ import annotations

import public_tokenizers

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bytegrain.llm.bpe import encode_decode
from bytegrain.llm.mixing import cyclic_weights, plan_mix
from bytegrain.llm.near_copies import near_copy_components
from bytegrain.llm.substring_dedup import remove_repeats
from bytegrain.llm.toxicity import fold, reject_toxic, train_toxicity
from bytegrain.session import Stage

TOXIC = 0.7
SHINGLE_WORDS, SIMILAR_PERCENT = 5, 80
BROADCAST_ROWS = 1_000_000  # two hashes of 8 bytes each
WEIGHTS = (5, 2, 1)
TOKENIZER = "byte_bpe_50k.json"
BLOCK_WORDS = 1 << 18  # small blocks take a sixth more disk, but less of executors that are full by then


def _row(docs: DataFrame, *without: str) -> Column:
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in without])


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below TOXIC; the model learns from the labels outside fold 1."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = train_toxicity(docs, labels.where(fold(F.col("doc_id")) != 1))
    return reject_toxic(docs, model, TOXIC)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked texts the row with the least id; rows without id come last.

    Rows are told apart by id and text, so it doesn't matter whether ids are unique. Rows that
    repeat both are copies, too; one of them stays.
    """
    flags = F.isnull("doc_id"), F.isnull("text")
    hashes = F.xxhash64("doc_id", "text", *flags), F.xxhash64(F.lit(7), "text", "doc_id", *flags)
    rows = docs.select("*", hashes[0].alias("_one"), hashes[1].alias("_two"))
    keyed = rows.select(F.struct(flags[0].alias("_last"), "doc_id", "_one", "_two").alias("_row"), "text")
    found = Stage(
        near_copy_components(keyed, key="_row", width=SHINGLE_WORDS, percent=SIMILAR_PERCENT),
        "components",
    ).df
    gone = found.where("_row <> component_id").select("_row._one", "_row._two").distinct()
    if gone.count() <= BROADCAST_ROWS:
        gone = F.broadcast(gone)
    kept = rows.join(gone, ["_one", "_two"], "left_anti")
    twice = found.select("_row._one", "_row._two").groupBy("_one", "_two").count()
    twice = Stage(twice.where("count > 1").select("_one", "_two"), "repeated-rows").df
    if not twice.isEmpty():
        once = kept.join(twice, ["_one", "_two"], "left_anti")
        again = kept.join(twice, ["_one", "_two"], "left_semi")
        kept = once.unionByName(again.dropDuplicates(["_one", "_two"]))
    return kept.drop("_one", "_two")


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without the bytes of strings of 400 bytes that occur elsewhere.

    What is left of a sign that a removal cut apart goes, too, and nothing else: texts without
    such strings stay as they are. `n_chars` is counted anew.
    """
    others = docs.withColumn("_others", _row(docs, "text", "n_chars"))
    kept = remove_repeats(others, key="_others", signs=True)
    return kept.select("_others.*", F.col("kept").cast("string").alias("text")).select(
        *[F.length("text").cast("bigint").alias(c) if c == "n_chars" else c for c in docs.columns]
    )


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return plan_mix(docs, cyclic_weights(docs, WEIGHTS)).documents(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded_sha256): token ids as little-endian 32-bit integers,
    and the hash of the text that they decode to."""
    coded = encode_decode(docs, public_tokenizers.path(TOKENIZER), block_words=BLOCK_WORDS)
    return coded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        "ids",
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


STAGES = [
    ("toxicity", toxicity),
    ("near_copies", near_copies),
    ("repeated_passages", repeated_passages),
    ("mixed_sources", mixed_sources),
    ("encoded", encoded),
]

ORACLE_SQL = None  # tokens and the fitted model are beyond SQL; tests/llm/test_pipeline.py


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = Stage(stage(spark, docs, sf_dir), name).df
    return STAGES[-1][1](spark, docs, sf_dir)
