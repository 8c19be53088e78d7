"""Reading corpora and reading or writing shard and token tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bytegrain.operators.shards import shard_text


def read_corpus(spark: SparkSession, path: str, *columns: str, key: str | None = None) -> DataFrame:
    """A parquet corpus, pruned to `columns`.

    With `key`, an input that scans in no more tasks than the cluster has slots is spread
    by it, since one file's row group cannot be shared between tasks. That shuffles at most
    one scan split per slot; a larger corpus is left as scanned.
    """
    docs = spark.read.parquet(path)
    if columns:
        docs = docs.select(*columns)
    return spread_small(docs, docs, key) if key is not None else docs


def spread_small(docs: DataFrame, scan: DataFrame, key: str) -> DataFrame:
    """`docs` spread over all slots if `scan`, its batch scan, has no more tasks than slots."""
    slots = scan.sparkSession.sparkContext.defaultParallelism
    return docs.repartition(slots, key) if scan.rdd.getNumPartitions() <= slots else docs


def write_shards(sharded: DataFrame, path: str, mode: str = "append", key: str = "doc_id") -> None:
    """Documents by shard folder, each shard one file in key order. Texts move once."""
    rows = sharded.drop("shard_last").repartition("shard_id").sortWithinPartitions("shard_id", key)
    rows.write.mode(mode).partitionBy("shard_id").parquet(path)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def landed_documents(spark: SparkSession, path: str, key: str = "doc_id") -> DataFrame:
    """Keys and shards of the documents that earlier runs have written."""
    return spark.read.parquet(path).select(key, "shard_id")


def write_shard_text(sharded: DataFrame, path: str, mode: str = "append") -> None:
    """Shards as text, one folder per shard, documents joined by a blank line."""
    rows = shard_text(sharded).select("shard_id", "text")
    rows.write.mode(mode).partitionBy("shard_id").text(path)


def read_shard_text(spark: SparkSession, path: str) -> DataFrame:
    """One row per shard file: (shard_id, text). The writer's final newline is not text."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
    shard = F.regexp_extract(F.input_file_name(), r"shard_id=(\d+)", 1).cast("int")
    return files.select(
        shard.alias("shard_id"), F.regexp_replace("value", r"\n\z", "").alias("text")
    )


def write_token_table(tokens: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """The encoded corpus by split; `start_offset` gives a row's place in the flat array."""
    tokens.write.mode(mode).partitionBy("split").parquet(path)


def read_token_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
