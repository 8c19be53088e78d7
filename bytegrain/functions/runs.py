"""Arrow functions of training: pairs, chains of pairs, and rewriting, over arrays of token ids.

A batch is laid flat: `values` are its tokens, `lengths` the tokens of each row. Boundary i lies
between values i and i + 1; it is hot if its pair is listed. A piece is a stretch of tokens whose
boundaries are all hot; a chain is a piece of two tokens or more.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from bytegrain.functions.segment import spread

SHIFT = np.int64(32)


def byte_lists(chunks: pa.Array) -> pa.Array:
    """The UTF-8 bytes of each chunk as ids."""
    sizes = pc.binary_length(chunks).to_numpy(zero_copy_only=False)
    data = b"".join(chunks.cast(pa.binary()).to_pylist())
    return lists(np.frombuffer(data, np.uint8).astype(np.int32), sizes)


def lists(values: np.ndarray, sizes: np.ndarray, null: np.ndarray | None = None) -> pa.Array:
    offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
    mask = None if null is None else pa.array(null)
    return pa.ListArray.from_arrays(offsets, pa.array(values, pa.int32()), mask=mask)


def laid_flat(tokens: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    lengths = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False)
    return tokens.flatten().to_numpy(zero_copy_only=False).astype(np.int64), lengths.astype(np.int64)


def pair_keys(values: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key of the pair at each boundary, whether the boundary lies inside a row)."""
    inside = np.ones(max(len(values) - 1, 0), bool)
    ends = np.cumsum(lengths)[:-1] - 1
    inside[ends[(ends >= 0) & (ends < len(inside))]] = False
    return values[:-1] << SHIFT | values[1:], inside


def rows_of(lengths: np.ndarray) -> np.ndarray:
    """The row of each token."""
    return np.repeat(np.arange(len(lengths)), lengths)


def sums(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct keys, sum of weights, place of the first), exact for integers."""
    order = np.argsort(keys, kind="stable")
    starts = np.flatnonzero(np.diff(keys[order], prepend=keys[order][:1] - 1)) if len(keys) else order
    return keys[order][starts], np.add.reduceat(weights[order], starts) if len(keys) else weights, order[starts]


def pair_sums(tokens: pa.ListArray, freq: np.ndarray):
    """(pair, n, row, at): distinct pairs, how often they occur, and where they occur first."""
    values, lengths = laid_flat(tokens)
    keys, inside = pair_keys(values, lengths)
    places = np.flatnonzero(inside)
    rows = rows_of(lengths)
    pairs, n, first = sums(keys[places], freq[rows[places]])
    row = rows[places[first]]
    return pairs, n, row, places[first] - (np.cumsum(lengths) - lengths)[row]


def pieces(values: np.ndarray, lengths: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, size) of each piece; `hot` holds sorted pair keys."""
    if len(values) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    keys, inside = pair_keys(values, lengths)
    near = np.minimum(np.searchsorted(hot, keys), len(hot) - 1)
    joined = inside & (hot[near] == keys)
    starts = np.flatnonzero(np.concatenate([[True], ~joined]))
    return starts, np.diff(np.append(starts, len(values)))


def as_blobs(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Stretches of values as byte strings of little-endian 32-bit integers."""
    every = np.arange(len(starts))
    data = values[spread(starts, sizes, every)].astype("<i4").tobytes()
    offsets = np.concatenate([[0], np.cumsum(sizes * 4)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data)])


def chain_sums(tokens: pa.ListArray, freq: np.ndarray, hot: np.ndarray):
    """(chain, n, row, at): distinct chains, how often they occur, and where they occur first."""
    values, lengths = laid_flat(tokens)
    starts, sizes = pieces(values, lengths, hot)
    long = np.flatnonzero(sizes > 1)
    coded = pc.dictionary_encode(as_blobs(values, starts[long], sizes[long]))
    codes = coded.indices.to_numpy(zero_copy_only=False)
    row = rows_of(lengths)[starts[long]]
    _, n, first = sums(codes.astype(np.int64), freq[row])
    at = starts[long][first] - (np.cumsum(lengths) - lengths)[row[first]]
    return coded.dictionary, n, row[first], at


def rewritten(tokens: pa.ListArray, hot: np.ndarray, form_of: Callable[[bytes], bytes]):
    """(new lists, changed): rows with each chain replaced by its form."""
    values, lengths = laid_flat(tokens)
    starts, sizes = pieces(values, lengths, hot)
    long = sizes > 1
    coded = pc.dictionary_encode(as_blobs(values, starts[long], sizes[long]))
    chains = coded.dictionary.to_pylist()
    forms = [form_of(found) for found in chains]
    codes = coded.indices.to_numpy(zero_copy_only=False)
    form_sizes = np.array([len(form) // 4 for form in forms], np.int64)
    form_values = np.frombuffer(b"".join(forms), "<i4")
    after = np.ones(len(starts), np.int64)
    after[long] = form_sizes[codes]
    begin = np.cumsum(after) - after
    out = np.empty(int(after.sum()), np.int32)
    out[begin[~long]] = values[starts[~long]]
    out[spread(begin[long], after[long], np.arange(int(long.sum())))] = form_values[
        spread(np.cumsum(form_sizes) - form_sizes, form_sizes, codes)
    ]
    rows = rows_of(lengths)[starts]
    new_lengths = np.bincount(rows, after, len(lengths)).astype(np.int64)
    altered = np.array([form != found for form, found in zip(forms, chains)], bool)
    changed = np.bincount(rows[long], altered[codes], len(lengths)) > 0
    return lists(out, new_lengths), changed


def merge_run(run: bytes, new: int) -> bytes:
    """A chain of one hot pair, merged from the left: two tokens, or a run of equal ones."""
    tokens = np.frombuffer(run, "<i4")
    odd = tokens[-1:] if len(tokens) % 2 else tokens[:0]
    return np.append(np.full(len(tokens) // 2, new, "<i4"), odd).astype("<i4").tobytes()
