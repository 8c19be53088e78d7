"""Decoding id arrays back to text: a narrow array lookup per id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bytegrain.model import BpeModel

UNKNOWN = "<UNK>"


def decode(
    encoded: DataFrame,
    model: BpeModel,
    ids: str = "ids",
    skip_special: bool = True,
    out: str = "decoded",
) -> DataFrame:
    """Add the text of each id array.

    Special and reserved ids are dropped, or spelled out with `skip_special=False`;
    unknown ids give the bytes of `<UNK>`; invalid UTF-8 becomes U+FFFD; a null array gives
    null, an empty one the empty text. The vocabulary rides along as one constant whatever its
    size, so no row is matched by a key.
    """
    contents = _contents(model, skip_special)
    table = encoded.sparkSession.createDataFrame([(contents,)], "contents array<string>")
    parts = F.transform(
        F.col(ids), lambda i: F.coalesce(F.get(F.col("_contents"), i), F.lit(UNKNOWN))
    )
    return (
        encoded.withColumn("_contents", table.scalar())
        .withColumn(out, bytes_to_text(F.array_join(parts, "")))
        .drop("_contents")
    )


def bytes_to_text(latin: Column) -> Column:
    """Text of a byte string written as Latin-1, malformed UTF-8 replaced."""
    return F.make_valid_utf8(F.encode(latin, "ISO-8859-1").cast("string"))


def _contents(model: BpeModel, skip_special: bool) -> list[str]:
    """Latin-1 byte strings by id; ids of a model are dense."""
    hidden = ("special", "reserved") if skip_special else ()
    return [
        "" if kind in hidden else content.decode("latin-1")
        for _, content, kind, _ in sorted(model.vocab_rows, key=lambda row: row[0])
    ]
