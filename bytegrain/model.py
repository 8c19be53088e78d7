"""Vocabulary layouts and the trained model."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from bytegrain.functions.tokens import MAX_VOCAB


@dataclass(frozen=True)
class Layout:
    """Where bytes, byte-fallback ids, special tokens and merges sit in the id space."""

    name: str
    special_start: int
    specials: tuple[str, ...]
    reserved: int = 0
    fallback_start: int | None = None

    @property
    def reserved_start(self) -> int:
        return self.special_start + len(self.specials)

    @property
    def merges_start(self) -> int:
        return self.reserved_start + self.reserved

    def special_id(self, name: str) -> int:
        return self.special_start + self.specials.index(name)

    def base_rows(self) -> list[tuple[int, bytes, str, str | None]]:
        rows = [(i, bytes([i]), "byte", None) for i in range(256)]
        if self.fallback_start is not None:
            rows += [
                (self.fallback_start + i, bytes([i]), "fallback", f"<0x{i:02X}>")
                for i in range(256)
            ]
        rows += [
            (self.special_start + i, s.encode(), "special", s) for i, s in enumerate(self.specials)
        ]
        rows += [
            (self.reserved_start + i, f"<UNUSED_{i}>".encode(), "reserved", f"<UNUSED_{i}>")
            for i in range(self.reserved)
        ]
        return rows


# The two id layouts.
SPEC = Layout("spec", 512, ("<PAD>", "<BOS>", "<EOS>", "<UNK>", "<SEP>"), 11, 256)
COMPACT = Layout("compact", 256, ("<PAD>", "<BOS>", "<EOS>", "<UNK>"))
LAYOUTS = {layout.name: layout for layout in (SPEC, COMPACT)}

# Default vocabulary sizes of the two layouts.
DEFAULT_VOCAB_SIZE = {"spec": 50304, "compact": 32768}


def check_vocab_size(layout: Layout, vocab_size: int) -> int:
    """Number of merges that fills `vocab_size`."""
    if not layout.merges_start < vocab_size <= MAX_VOCAB:
        raise ValueError(
            f"vocab_size must be above {layout.merges_start} and at most {MAX_VOCAB}, "
            f"not {vocab_size}"
        )
    return vocab_size - layout.merges_start


@dataclass
class BpeModel:
    """Ordered merges under a layout.

    At most `MAX_VOCAB` merges exist whatever the corpus size, so the list is the one
    thing kept on the driver.
    """

    layout: Layout
    pattern: str
    merges: list[tuple[int, int, int | None]]
    rounds: int = 0

    @cached_property
    def merge_rows(self) -> list[tuple[int, int, int, int, int | None]]:
        start = self.layout.merges_start
        return [(i + 1, a, b, start + i, n) for i, (a, b, n) in enumerate(self.merges)]

    @cached_property
    def vocab_rows(self) -> list[tuple[int, bytes, str, str | None]]:
        rows = self.layout.base_rows()
        content = {row[0]: row[1] for row in rows}
        for _, left, right, new, _ in self.merge_rows:
            content[new] = content[left] + content[right]
            rows.append((new, content[new], "merge", None))
        return rows

    @property
    def vocab_size(self) -> int:
        return self.layout.merges_start + len(self.merges)

    def merge_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(
            self.merge_rows, "rank int, left int, right int, new_id int, freq bigint"
        )

    def vocab_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(
            [(i, bytearray(b), kind, surface) for i, b, kind, surface in self.vocab_rows],
            "token_id int, bytes binary, kind string, surface string",
        )
