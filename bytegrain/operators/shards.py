"""Shard assignment, cap, resume and shard text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bytegrain.operators.corpus import SHARD_SIZE
from bytegrain.operators.ordering import with_rank
from bytegrain.session import Stage


def shard_edges(docs: DataFrame, size: int, key: str) -> DataFrame:
    """One row (starts, ends): the first and the last key of each shard, in order.

    Ranks are given to the keys alone; of `size` keys two are held.
    """
    ranked = with_rank(docs.select(key), key)
    last = ranked.agg(F.max("rank").alias("last")).scalar()
    starts = F.when(F.col("rank") % size == 0, F.struct("rank", key))
    ends = F.when((F.col("rank") % size == size - 1) | (F.col("rank") == last), F.struct("rank", key))
    edges = ranked.agg(
        F.sort_array(F.collect_list(starts)).alias("starts"), F.sort_array(F.collect_list(ends)).alias("ends")
    )
    return Stage(edges.select(F.col(f"starts.{key}").alias("starts"), F.col(f"ends.{key}").alias("ends")), "edges").df


def assign_shards(
    docs: DataFrame,
    size: int = SHARD_SIZE,
    key: str = "doc_id",
    first_shard: int = 0,
    max_new: int | None = None,
) -> DataFrame:
    """Add `shard_id` (`size` documents per shard in key order) and `shard_last`, which
    marks a shard's last document. The last shard takes the rest.

    Narrow: each key is searched among the shards' first keys, and documents don't move.
    `max_new` keeps the first shards only, by a bound on the key that reaches the scan.
    """
    edges = shard_edges(docs, size, key)
    if max_new is not None:
        docs = _up_to_shard(docs, edges, max_new, key)


    def place(held: Column) -> Column:
        shard = F.greatest(_not_after(held["edges"]["starts"], held["key"]) - 1, F.lit(0))
        last = F.get(held["edges"]["ends"], shard).eqNullSafe(held["key"])
        return F.struct((shard + first_shard).cast("int").alias("id"), last.alias("last"))

    # The edges are a constant of the plan: a column that is used once is put in its place.
    table = docs.withColumn("_edges", edges.select(F.struct("starts", "ends")).scalar())
    held = F.array(F.struct(F.col("_edges").alias("edges"), F.col(key).alias("key")))
    placed = table.withColumn("_shard", F.get(F.transform(held, place), F.lit(0)))
    return placed.select(*docs.columns, F.col("_shard.id").alias("shard_id"), F.col("_shard.last").alias("shard_last"))


def _not_after(sorted_keys: Column, key: Column) -> Column:
    """How many of an array's keys are not above `key`, by halving. Null is the least key."""
    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(sorted_keys) + F.lit(1))).cast("int"))
    whole = F.struct(F.lit(0).alias("low"), F.size(sorted_keys).alias("high"))

    def halve(part: Column, _) -> Column:
        low, high = part["low"], part["high"]
        middle = F.shiftright(low + high, 1)
        found = F.get(sorted_keys, middle)
        below = found.isNull() | F.coalesce(found <= key, F.lit(False))
        upper, lower = F.struct((middle + 1).alias("low"), high.alias("high")), F.struct(low.alias("low"), middle.alias("high"))
        return F.when(low >= high, part).when(below, upper).otherwise(lower)

    return F.aggregate(steps, whole, halve)["low"]


def _up_to_shard(docs: DataFrame, edges: DataFrame, shards: int, key: str) -> DataFrame:
    if shards < 1:
        raise ValueError("max_new must be at least 1")
    bound = edges.select(F.size("ends").alias("n"), F.get("ends", F.lit(shards - 1)).alias("key")).first()
    if bound.n <= shards:
        return docs
    within = F.col(key) <= F.lit(bound.key) if bound.key is not None else F.lit(False)
    return docs.where(within | F.col(key).isNull())


def cap_shards(sharded: DataFrame, max_new: int, first_shard: int = 0) -> DataFrame:
    """Only the first `max_new` shards that a run would add."""
    if max_new < 1:
        raise ValueError("max_new must be at least 1")
    return sharded.where(F.col("shard_id") < first_shard + max_new)


def resume_shards(
    docs: DataFrame,
    landed: DataFrame,
    size: int = SHARD_SIZE,
    key: str = "doc_id",
    max_new: int | None = None,
) -> DataFrame:
    """Shards for the documents that earlier runs have not landed, numbered on from theirs."""
    top = landed.agg(F.max("shard_id")).first()[0]
    first = 0 if top is None else top + 1
    fresh = docs.join(landed.select(key), key, "left_anti")
    return assign_shards(fresh, size, key, first, max_new)


def shard_text(sharded: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per shard: file name and the documents joined by a blank line. A group
    holds one shard, so never more than the shard size."""
    docs = F.array_sort(F.collect_list(F.struct(key, text)))
    return sharded.groupBy("shard_id").agg(
        F.array_join(F.transform(docs, lambda d: d[text]), "\n\n").alias("text")
    ).select(
        "shard_id",
        F.format_string("chunk_%05d.txt", "shard_id").alias("file_name"),
        "text",
    )
