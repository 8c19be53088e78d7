"""Adjacent-pair statistics over a token table (freq, tokens)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bytegrain.functions.rows import explode_computed
from bytegrain.functions.tokens import (
    adjacent_pairs,
    apply_merges,
    byte_tokens,
    merge_literal,
    pair_left,
    pair_right,
)


def token_table(words: DataFrame) -> DataFrame:
    """Starting tokens of a frequency table. One-token chunks hold no pair and drop out."""
    carried = [c for c in ("freq", "first") if c in words.columns]
    return words.select(*carried, byte_tokens(F.col("chunk")).alias("tokens")).where(
        F.length("tokens") > 1
    )


def count_pairs(state: DataFrame) -> DataFrame:
    """(pair, n): overlapping adjacent pairs weighted by chunk frequency.

    Where the state has `first`, so has the result: the pair's earliest boundary.
    """
    pairs = adjacent_pairs(F.col("tokens"))
    if "first" not in state.columns:
        exploded = explode_computed(state, ["freq"], pairs, "pair")
        return exploded.groupBy("pair").agg(F.sum("freq").alias("n"))
    exploded = explode_computed(state, ["freq", "first"], pairs, "pair", "at")
    return exploded.groupBy("pair").agg(
        F.sum("freq").alias("n"), F.min(F.struct("first", "at")).alias("first")
    )


def pair_ids(counts: DataFrame) -> DataFrame:
    """Counts with the pair as two ids."""
    return counts.select(
        pair_left(F.col("pair")).alias("left_id"), pair_right(F.col("pair")).alias("right_id"), "n"
    )


def top_pairs(counts: DataFrame, k: int) -> DataFrame:
    """The first k pairs in merge order. Binary string order of pairs is (left, right)
    id order, so ties go to the lower ids, or to the earlier pair where `first` is known."""
    tie = "first" if "first" in counts.columns else "pair"
    return counts.orderBy(F.desc("n"), F.asc(tie)).limit(k)


def best_pair(counts: DataFrame) -> DataFrame:
    """The pair to merge next; no row when no pair is left."""
    return top_pairs(counts, 1)


def merge_tokens(state: DataFrame, merges: list[tuple[str, str]]) -> DataFrame:
    """Apply merges, each left to right without overlap, in the given order."""
    return state.withColumn("tokens", apply_merges(F.col("tokens"), merge_literal(merges)))
