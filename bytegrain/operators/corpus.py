"""Corpus preparation: sampling, trimming, length filter, counters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bytegrain.functions.text import keep_draw, strip

# Corpus defaults.
MIN_CHARS = 200
SHARD_SIZE = 10_000
SEED = 42


def sample_corpus(
    docs: DataFrame, fraction: float = 1.0, seed: int = SEED, key: str = "doc_id"
) -> DataFrame:
    """Keep each document independently with probability `fraction`."""
    return docs.where(keep_draw(F.col(key), fraction, seed))


def strip_text(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.withColumn(text, strip(F.col(text)))


def filter_length(docs: DataFrame, min_chars: int = MIN_CHARS, text: str = "text") -> DataFrame:
    return docs.where(F.length(text) >= min_chars)


def prepare_corpus(
    docs: DataFrame,
    fraction: float = 1.0,
    min_chars: int = MIN_CHARS,
    seed: int = SEED,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Sample, trim and length-filter: narrow, so it also runs on a stream."""
    sampled = sample_corpus(docs, fraction, seed, key)
    return filter_length(strip_text(sampled, text), min_chars, text)


def corpus_stats(
    docs: DataFrame,
    fraction: float = 1.0,
    min_chars: int = MIN_CHARS,
    seed: int = SEED,
    shard_size: int = SHARD_SIZE,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """One row of counters over the unfiltered corpus, in one pass."""
    draw = keep_draw(F.col(key), fraction, seed)
    drawn = docs.select(F.when(draw, F.length(strip(F.col(text)))).alias("chars"))
    kept = F.coalesce(F.col("chars") >= min_chars, F.lit(False))
    totals = drawn.agg(
        F.count("*").alias("docs_seen"),
        F.count_if(kept).alias("docs_kept"),
        F.coalesce(F.sum(F.when(kept, F.col("chars").cast("bigint"))), F.lit(0)).alias(
            "total_chars"
        ),
    )
    return totals.select(
        "docs_seen",
        "docs_kept",
        "total_chars",
        F.expr("total_chars div 4").alias("approx_tokens"),
        F.expr(f"(docs_kept + {shard_size - 1}) div {shard_size}").alias("shards_written"),
    )
