"""Exploding computed arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def explode_computed(
    df: DataFrame, keep: list[str], values: Column, name: str, pos: str | None = None
) -> DataFrame:
    """One row per non-null array element.

    For a plain explode the optimizer infers a size filter and pushes it to the scan, which
    would compute an expensive array several times over; the outer form has no such filter.
    """
    if pos is None:
        rows = df.select(*keep, F.explode_outer(values).alias(name))
    else:
        rows = df.select(*keep, F.posexplode_outer(values).alias(pos, name))
    return rows.where(F.col(name).isNotNull())
