"""Train/validation split and the flat token table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bytegrain.functions.text import keep_draw
from bytegrain.operators.corpus import SEED
from bytegrain.operators.ordering import with_start, with_start_in_order
from bytegrain.session import Stage

TRAIN_SHARE = 0.9


def assign_split(
    docs: DataFrame, train_share: float = TRAIN_SHARE, seed: int = SEED, key: str = "doc_id"
) -> DataFrame:
    """Add `split`, by document, so that no document straddles the border."""
    drawn = keep_draw(F.col(key), train_share, seed)
    return docs.withColumn("split", F.when(drawn, "train").otherwise("val"))


def token_offsets(encoded: DataFrame, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(split, key, n_tokens, start_offset): each document's place in its split's flat array.

    Works on lengths alone, which are written down first: finding the bounds of a range
    shuffle runs the plan below it, and `encoded` may be a plan that encodes.
    """
    lengths = encoded.select("split", key, F.size(ids).cast("bigint").alias("n_tokens"))
    return with_start(Stage(lengths, "lengths").df, "n_tokens", "split", key)


def token_table(encoded: DataFrame, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(split, key, start_offset, ids) of an encoded corpus whose rows lie in key order: order
    the texts by `in_key_order` and encode them then. Ids are written once and never shuffled."""
    rows = encoded.select("split", key, ids)
    return with_start_in_order(rows, ids, "split", key).select("split", key, "start_offset", ids)


def cut_split(tokens: DataFrame, train_share: float = TRAIN_SHARE) -> DataFrame:
    """Split by token position instead: of an unsplit token table (start_offset, ids), the
    first `train_share` of all tokens is training data. The document across the border is cut."""
    total = tokens.agg(F.sum(F.size("ids"))).scalar()
    border = F.floor(total * F.lit(train_share)).cast("bigint")
    head = F.greatest(F.lit(0), F.least(F.size("ids"), border - F.col("start_offset"))).cast("int")
    parts = tokens.withColumn("_head", head)
    train = F.struct(
        F.lit("train").alias("split"),
        F.col("start_offset"),
        F.slice("ids", F.lit(1), F.col("_head")).alias("ids"),
    )
    val = F.struct(
        F.lit("val").alias("split"),
        F.greatest(F.lit(0), F.col("start_offset") - border).cast("bigint").alias("start_offset"),
        F.slice("ids", F.col("_head") + 1, F.size("ids") - F.col("_head")).alias("ids"),
    )
    kept = [c for c in tokens.columns if c not in ("split", "start_offset", "ids")]
    cut = parts.select(*kept, F.explode(F.array(train, val)).alias("part"))
    return cut.select("part.split", *kept, "part.start_offset", "part.ids").where(
        F.size("ids") > 0
    )
