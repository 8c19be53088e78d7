"""Continuous, resumable corpus ingest and encoding with Structured Streaming.

Preparation and encoding are narrow, so both run unchanged on a stream. The source's
checkpoint keeps what has been read and the file sink's log what has been written: a
restarted query takes up only new files and writes every document once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from bytegrain.model import BpeModel
from bytegrain.operators.corpus import MIN_CHARS, SEED, prepare_corpus
from bytegrain.operators.encoding import encode
from bytegrain.sources.tables import spread_small


def read_stream(
    spark: SparkSession,
    path: str,
    schema: StructType | str,
    pattern: str | None = None,
    max_files: int | None = None,
    key: str | None = None,
) -> DataFrame:
    """A folder of parquet files as a stream; `pattern` selects files by name. With `key`,
    a small input is spread by it, as in `read_corpus`."""
    reader = spark.readStream.schema(schema)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    docs = reader.parquet(path)
    if key is None:
        return docs
    batch = spark.read.schema(schema).option("pathGlobFilter", pattern or "*").parquet(path)
    return spread_small(docs, batch, key)


def ingest(
    docs: DataFrame,
    target: str,
    checkpoint: str,
    fraction: float = 1.0,
    min_chars: int = MIN_CHARS,
    seed: int = SEED,
    key: str = "doc_id",
    text: str = "text",
) -> None:
    """Sample, trim and filter all documents now available, then stop."""
    _drain(prepare_corpus(docs, fraction, min_chars, seed, key, text), target, checkpoint)


def ingest_encoded(
    docs: DataFrame,
    model: BpeModel,
    target: str,
    checkpoint: str,
    key: str = "doc_id",
    text: str = "text",
    add_special: bool = False,
) -> None:
    """Encode all documents now available, then stop."""
    encoded = encode(docs, model, text, add_special).select(key, "ids")
    _drain(encoded, target, checkpoint)


def _drain(stream: DataFrame, target: str, checkpoint: str) -> None:
    query = (
        stream.writeStream.format("parquet")
        .option("path", target)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
