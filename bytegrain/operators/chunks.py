"""Pre-token chunks and their frequency table, the state that training works on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bytegrain.functions.rows import explode_computed
from bytegrain.functions.text import pretokenize, pretokenize_joined
from bytegrain.functions.tokens import byte_tokens, token_ids


def chunk_table(
    docs: DataFrame, pattern: str = "cl100k", key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per chunk occurrence: (key, pos, chunk)."""
    return explode_computed(docs, [key], pretokenize(F.col(text), pattern), "chunk", "pos")


def chunk_byte_ids(chunks: DataFrame) -> DataFrame:
    """Add `ids`, each byte of the chunk as one id 0-255."""
    return chunks.withColumn("ids", token_ids(byte_tokens(F.col("chunk"))))


def word_freq(
    docs: DataFrame,
    pattern: str = "cl100k",
    text: str = "text",
    order: str | None = None,
) -> DataFrame:
    """Distinct chunks with their frequency.

    Map-side aggregation leaves at most one row per chunk and task to shuffle, so
    chunks that fill a third of the corpus do not skew it. With `order`, `first`
    holds where the chunk first occurs in the corpus, for `tie="first"` training.
    """
    return _count(docs, pretokenize(F.col(text), pattern), order)


def word_freq_joined(
    sharded: DataFrame, pattern: str = "cl100k", text: str = "text", order: str | None = None
) -> DataFrame:
    """`word_freq` as if each shard's documents were joined by a blank line."""
    chunks = pretokenize_joined(F.col(text), F.col("shard_last"), pattern)
    return _count(sharded, chunks, order)


def _count(docs: DataFrame, chunks, order: str | None) -> DataFrame:
    if order is None:
        exploded = explode_computed(docs, [], chunks, "chunk")
        return exploded.groupBy("chunk").agg(F.count("*").alias("freq"))
    exploded = explode_computed(docs, [order], chunks, "chunk", "pos")
    return exploded.groupBy("chunk").agg(
        F.count("*").alias("freq"), F.min(F.struct(order, "pos")).alias("first")
    )


def train_size(words: DataFrame) -> DataFrame:
    """Chunk count and initial token (byte) count of the training text."""
    return words.agg(
        F.sum("freq").alias("n_chunks"),
        F.sum(F.col("freq") * F.octet_length("chunk")).alias("n_tokens"),
    )
