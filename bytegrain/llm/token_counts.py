"""Token counts by batch encoding in Arrow functions that return lengths only."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bytegrain.llm.arrow import ddl, slices
from bytegrain.llm.tokenizer import Encoder, TokenizerFile, chunks

KNOWN_WORDS = 1 << 19  # lengths that a worker remembers
BATCH_WORDS = 1 << 17  # words that are looked up together
BATCH_BYTES = 1 << 18  # characters of the new words that are encoded in one call


class Lengths:
    """Counts tokens; a word is encoded again only after the memory was emptied."""

    def __init__(self, encoder: Encoder):
        self.encoder = encoder
        self.known: dict[str, int] = {}

    def count(self, texts: list[str | None]) -> list[int]:
        sizes = [0] * len(texts)
        rows: list[tuple[int, list[str]]] = []
        held = 0
        for row, text in enumerate(texts):
            for words in self.encoder.spans(text) if text else ():
                rows.append((row, words))
                held += len(words)
                if held >= BATCH_WORDS:
                    self._add(sizes, rows)
                    rows, held = [], 0
        self._add(sizes, rows)
        return sizes

    def _add(self, sizes: list[int], rows: list[tuple[int, list[str]]]) -> None:
        if len(self.known) > KNOWN_WORDS:
            self.known.clear()
        self._learn(set().union(*[words for _, words in rows]).difference(self.known))
        known = self.known
        for row, words in rows:
            sizes[row] += sum([known[word] for word in words])

    def _learn(self, words: set[str]) -> None:
        batch, size = [], 0
        for word in words:
            batch.append(word)
            size += len(word)
            if size >= BATCH_BYTES:
                self._encode(batch)
                batch, size = [], 0
        self._encode(batch)

    def _encode(self, words: list[str]) -> None:
        self.known.update(zip(words, map(len, self.encoder.encode(words)), strict=True))


def token_counts(
    docs: DataFrame,
    path: str,
    key: str = "doc_id",
    text: str = "text",
    limit: int = 1024,
) -> DataFrame:
    """Tokens of every text: (key, n_bytes, n_tokens, over_limit), one row for each row.

    Narrow: no row moves, only lengths leave the Arrow function. A byte-level vocabulary is
    applied word by word (texts are cut where its pattern can't match across), a long text
    in chunks; other vocabularies encode whole texts. Null and empty texts have 0 tokens;
    rows with null or repeated keys are kept apart; other columns are not read.
    """
    file = TokenizerFile.read(path)

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Lengths(file.load())
        for batch in batches:
            sizes: list[int] = []
            for part in slices(batch, "_text"):
                sizes += counter.count(part.column("_text").to_pylist())
            n_bytes = pc.fill_null(pc.binary_length(batch.column("_text")), 0)
            yield pa.record_batch(
                [batch.column("_key"), n_bytes.cast(pa.int64()), pa.array(sizes, pa.int64())],
                ["_key", "n_bytes", "n_tokens"],
            )

    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    counted = rows.mapInArrow(lengths, f"_key {ddl(docs, key)}, n_bytes bigint, n_tokens bigint")
    return counted.select(
        F.col("_key").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
