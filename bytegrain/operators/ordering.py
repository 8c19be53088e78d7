"""Global ranks and running totals without a single-task window."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bytegrain.session import Stage

_ROW_BITS = 33  # low bits of monotonically_increasing_id: the row within its partition


def in_key_order(df: DataFrame, *order: str) -> DataFrame:
    """Rows sorted over all partitions. Narrow steps behind it keep the order."""
    return df.repartitionByRange(*order).sortWithinPartitions(*order)


def _range_sorted(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Range-partition and sort once, tag rows with partition and position, and write
    the result down so that every later pass sees the same tags."""
    tagged = (
        in_key_order(df, *order).withColumn("_row", F.monotonically_increasing_id())
    )
    return (
        Stage(tagged, name)
        .df.withColumn("_part", F.shiftright("_row", _ROW_BITS))
        .withColumn("_local", F.col("_row").bitwiseAND((1 << _ROW_BITS) - 1))
        .drop("_row")
    )


def _offsets(totals: DataFrame, group: list[str]) -> DataFrame:
    """Exclusive prefix sums of per-partition totals; one row per partition and group,
    so its size follows the partition count, not the data."""
    seen: dict[tuple, int] = {}
    rows = []
    for row in sorted(totals.collect(), key=lambda r: r["_part"]):
        key = tuple(row[c] for c in group)
        rows.append((row["_part"], *key, seen.get(key, 0)))
        seen[key] = seen.get(key, 0) + row["_total"]
    fields = [totals.schema[c] for c in ["_part", *group]]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return totals.sparkSession.createDataFrame(rows, f"{schema}, _offset bigint")


def with_rank(df: DataFrame, *order: str) -> DataFrame:
    """Add `rank`, the 0-based position in the order of unique keys. One range shuffle."""
    rows = _range_sorted(df, list(order), "ranked")
    totals = rows.groupBy("_part").agg(F.count("*").alias("_total"))
    offsets = F.broadcast(_offsets(totals, []))
    return (
        rows.join(offsets, "_part")
        .withColumn("rank", F.col("_offset") + F.col("_local"))
        .drop("_part", "_local", "_offset")
    )


def with_start(df: DataFrame, length: str, group: str, *order: str) -> DataFrame:
    """Add `start_offset`: the sum of `length` over all earlier rows of the same group.

    Pass narrow rows: they are shuffled twice, by range and by partition tag.
    """
    rows = _range_sorted(df, list(order), "starts")
    totals = rows.groupBy("_part", group).agg(F.sum(length).cast("bigint").alias("_total"))
    offsets = F.broadcast(_offsets(totals, [group]))
    before = (
        Window.partitionBy("_part", group)
        .orderBy("_local")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    local = rows.withColumn("_before", F.coalesce(F.sum(length).over(before), F.lit(0)))
    return (
        local.join(offsets, ["_part", group])
        .withColumn("start_offset", (F.col("_offset") + F.col("_before")).cast("bigint"))
        .drop("_part", "_local", "_before", "_offset")
    )


def with_start_in_order(df: DataFrame, values: str, group: str, *order: str) -> DataFrame:
    """`with_start` of rows that lie in order already: the start of each array of `values` in
    its group. Rows are written with their start within the partition, and the totals of
    partitions, which are few, are broadcast; nothing is shuffled.
    """

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict = {}
        for batch in batches:
            sizes = pc.fill_null(pc.list_value_length(batch.column(values)), 0).to_numpy(zero_copy_only=False)
            coded = batch.column(group).dictionary_encode(null_encoding="encode")
            codes = coded.indices.to_numpy(zero_copy_only=False)
            before = np.zeros(len(codes), np.int64)
            for code, name in enumerate(coded.dictionary.to_pylist()):
                own = np.flatnonzero(codes == code)
                ends = seen.get(name, 0) + np.cumsum(sizes[own], dtype=np.int64)
                before[own], seen[name] = ends - sizes[own], int(ends[-1])
            yield pa.record_batch([*batch.columns, pa.array(before)], [*batch.schema.names, "_before"])

    tagged = df.withColumn("_part", F.spark_partition_id())
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in tagged.schema)
    rows = Stage(tagged.mapInArrow(place, f"{fields}, _before bigint"), "placed").df
    keys = F.struct(*order)
    totals = rows.groupBy("_part", group).agg(
        F.sum(F.size(values)).cast("bigint").alias("_total"), F.min(keys).alias("_low"), F.max(keys).alias("_high")
    )
    ends = totals.groupBy("_part").agg(F.min("_low").alias("low"), F.max("_high").alias("high"))
    above = F.lag("high").over(Window.orderBy("_part")) > F.col("low")  # one row a partition
    if not ends.select(above.alias("above")).where("above").isEmpty():
        raise ValueError(f"rows must lie in the order of {', '.join(order)}; see in_key_order")
    offsets = F.broadcast(_offsets(totals.select("_part", group, F.coalesce("_total", F.lit(0)).alias("_total")), [group]).withColumnsRenamed({"_part": "_p", group: "_g"}))
    placed = rows.join(offsets, (F.col("_part") == F.col("_p")) & F.col(group).eqNullSafe(F.col("_g")))
    return placed.withColumn("start_offset", F.col("_offset") + F.col("_before")).select(*df.columns, "start_offset")
