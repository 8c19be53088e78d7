"""Arrow functions that segment pre-token chunks by a list of merges."""

from __future__ import annotations

import ctypes
import hashlib
from array import array
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SHORT = 32  # bytes; longer chunks are segmented with a heap
KNOWN_BYTES = 64  # longer chunks are not remembered
KNOWN_CHUNKS = 1 << 17
PIECE_CHUNKS = 1 << 18  # of the texts that are taken at a time, or one text's
NEVER = 1 << 62

Pairs = dict[tuple[int, int], int]


def pair_table(merges: np.ndarray, first_id: int) -> Pairs:
    """Id that a pair of ids becomes; lower ids are merged first. A repeated pair never fires."""
    table: Pairs = {}
    for at, pair in enumerate(map(tuple, merges.tolist())):
        table.setdefault(pair, first_id + at)
    return table


def segment_short(tokens: list[int], table: Pairs) -> list[int]:
    """Merge the lowest pair, the leftmost of equal ones, until none is left."""
    made = [table.get(pair, NEVER) for pair in zip(tokens, tokens[1:])]
    while made and (new := min(made)) != NEVER:
        i = made.index(new)
        tokens[i : i + 2] = [new]
        del made[i]
        if i:
            made[i - 1] = table.get((tokens[i - 1], new), NEVER)
        if i < len(made):
            made[i] = table.get((new, tokens[i + 1]), NEVER)
    return tokens


def segment_long(tokens: list[int], table: Pairs) -> list[int]:
    """The same with a heap over a linked list, for chunks of any length."""
    count = len(tokens)
    after, before = list(range(1, count + 1)), list(range(-1, count - 1))
    heap = [
        (table[pair], at) for at, pair in enumerate(zip(tokens, tokens[1:])) if pair in table
    ]
    heapify(heap)
    while heap:
        new, at = heappop(heap)
        gone = after[at]
        if gone == count or tokens[at] < 0 or table.get((tokens[at], tokens[gone])) != new:
            continue
        tokens[at], tokens[gone] = new, -1
        after[at] = right = after[gone]
        left = before[at]
        if right < count:
            before[right] = at
            if (made := table.get((new, tokens[right]))) is not None:
                heappush(heap, (made, at))
        if left >= 0 and (made := table.get((tokens[left], new))) is not None:
            heappush(heap, (made, left))
    return [token for token in tokens if token >= 0]


class Segmenter:
    """Segments distinct chunks once and remembers the short ones."""

    def __init__(self, merges: np.ndarray, first_id: int):
        self.table = pair_table(merges, first_id)
        self.known: dict[str, bytes] = {}

    def chunk(self, text: str) -> bytes:
        """The ids of a chunk, packed; a list of them takes several times the room."""
        tokens = list(text.encode())
        segment = segment_short if len(tokens) <= SHORT else segment_long
        ids = array("i", segment(tokens, self.table)).tobytes()
        if len(text) <= KNOWN_BYTES:
            self.known[text] = ids
        return ids

    def lists(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all chunks in a row, number of ids of each chunk), chunks being distinct."""
        if len(self.known) > KNOWN_CHUNKS:
            self.known.clear()
        known = self.known
        found = [known.get(text) or self.chunk(text) for text in chunks.to_pylist()]
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        return np.frombuffer(b"".join(found), np.int32), sizes

    def encode(self, chunks: pa.ListArray) -> pa.Array:
        """The ids of each list of chunks; null lists stay null.

        Lists go in pieces, so that arrays over all chunks of a batch, which take many times
        its size, are never made; what the pieces took is given back.
        """
        ends = np.cumsum(pc.fill_null(pc.list_value_length(chunks), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        found, start = [], 0
        while start < len(ends) or not found:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + PIECE_CHUNKS, side="right")))
            found.append(self.piece(chunks.slice(start, stop - start)))
            start = stop
        ids = pa.concat_arrays(found)
        if len(found) > 1:
            del found
            give_back()
        return ids

    def piece(self, chunks: pa.ListArray) -> pa.Array:
        coded = pc.dictionary_encode(chunks.flatten())
        ids, sizes = self.lists(coded.dictionary)
        codes = coded.indices.to_numpy(zero_copy_only=False)
        flat = ids[spread(np.cumsum(sizes) - sizes, sizes, codes)]
        ends = np.concatenate([[0], np.cumsum(sizes[codes])])
        counts = pc.fill_null(pc.list_value_length(chunks), 0).to_numpy(zero_copy_only=False)
        offsets = ends[np.concatenate([[0], np.cumsum(counts)])]
        return pa.ListArray.from_arrays(
            pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()), mask=chunks.is_null()
        )


def spread(starts: np.ndarray, sizes: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Places of the members of the stretches that `codes` name, one stretch after another."""
    size = sizes[codes]
    before = np.cumsum(size) - size
    return np.arange(int(size.sum())) + np.repeat(starts[codes] - before, size)


def give_back() -> None:
    """Return freed memory to the system; a worker outlives the task that took it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


_held: dict[str, Segmenter] = {}


def held_segmenter(key: str, merges: np.ndarray, first_id: int) -> Segmenter:
    """This worker's segmenter of a model; it stays for later batches, tasks and queries."""
    if key not in _held:
        _held.clear()
        _held[key] = Segmenter(merges, first_id)
    return _held[key]


def merges_key(merges: np.ndarray, first_id: int) -> str:
    return f"{first_id}:{hashlib.sha256(merges.tobytes()).hexdigest()}"
