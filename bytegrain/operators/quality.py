"""Checks and measures of an encoded corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bytegrain.functions.rows import explode_computed
from bytegrain.model import BpeModel


def compression(encoded: DataFrame, *by: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Bytes, tokens and bytes per token by group."""
    sizes = encoded.select(
        *by,
        F.octet_length(text).cast("bigint").alias("bytes"),
        F.size(ids).cast("bigint").alias("tokens"),
    )
    sums = sizes.groupBy(*by).agg(
        F.count("*").alias("docs"), F.sum("bytes").alias("bytes"), F.sum("tokens").alias("tokens")
    )
    return sums.withColumn("bytes_per_token", F.round(F.col("bytes") / F.col("tokens"), 6))


def token_freq(encoded: DataFrame, ids: str = "ids") -> DataFrame:
    """(token_id, n). Partial sums leave one row per id and task to shuffle."""
    return (
        explode_computed(encoded, [], F.col(ids), "token_id")
        .groupBy("token_id")
        .agg(F.count("*").alias("n"))
    )


def id_range(encoded: DataFrame, model: BpeModel, *by: str, ids: str = "ids") -> DataFrame:
    """Lowest and highest id by group, and whether all lie below the vocabulary size."""
    top = encoded.select(*by, F.array_min(ids).alias("low"), F.array_max(ids).alias("high"))
    return top.groupBy(*by).agg(
        F.min("low").alias("min_id"),
        F.max("high").alias("max_id"),
        (F.coalesce(F.max("high"), F.lit(-1)) < model.vocab_size).alias("in_range"),
    )


def roundtrip(decoded: DataFrame, text: str = "text", out: str = "decoded") -> DataFrame:
    """One row: documents, and documents whose decoded text differs."""
    return decoded.agg(
        F.count("*").alias("docs"),
        F.count_if(~F.col(text).eqNullSafe(F.col(out))).alias("mismatches"),
    )


def merge_log(model_table: DataFrame, vocab: DataFrame, every: int = 1) -> DataFrame:
    """Training progress: the first and every `every`-th merge after it, and the last, with
    the bytes made."""
    last = model_table.agg(F.max("rank")).scalar()
    shown = ((F.col("rank") - 1) % every == 0) | (F.col("rank") == last)
    made = vocab.select(F.col("token_id").alias("new_id"), F.hex("bytes").alias("token_hex"))
    return model_table.where(shown).join(made, "new_id")
