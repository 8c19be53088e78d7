"""Suffix arrays by two-stage sorting, and common prefixes of neighbours."""

from __future__ import annotations

import numpy as np

SYMBOL_BITS, SYMBOLS = 10, 6  # symbols that one key holds


def rising(text: np.ndarray) -> np.ndarray:
    """Which suffixes are smaller than their successors; the last is not."""
    n = len(text)
    differs = np.flatnonzero(text[:-1] != text[1:])
    decided = np.append(text[:-1] < text[1:], False)
    where = np.searchsorted(differs, np.arange(n))
    up = np.zeros(n, bool)
    inside = where < len(differs)
    up[inside] = decided[differs[where[inside]]]
    return up


def _ranks(order: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Ranks along `order`, where `new` says that an element differs from the one before:
    how many elements are smaller."""
    ranks = np.empty(len(order), np.int64)
    starts = np.flatnonzero(new)
    ranks[order] = np.repeat(starts, np.diff(np.append(starts, len(order))))
    return ranks


def _refine(rank: np.ndarray, at: np.ndarray, key: np.ndarray) -> None:
    """Re-rank the elements `at`, which hold all of their ranks, by a second key."""
    order = np.lexsort((key, rank[at]))
    held, keys = rank[at][order], key[order]
    group = np.append(True, held[1:] != held[:-1])
    new = group | np.append(True, keys[1:] != keys[:-1])
    place = np.arange(len(at))
    first = np.maximum.accumulate(np.where(group, place, 0))
    same = np.maximum.accumulate(np.where(new, place, 0))
    rank[at[order]] = held + same - first


def sort_rising(text: np.ndarray, up: np.ndarray) -> np.ndarray:
    """The suffixes that are smaller than their successors, sorted directly.

    A suffix is the signs up to the next rising place, that place included with a mark, and
    then the suffix there; no such part is a prefix of another. Parts are ranked first, then
    runs of 2, 4, 8 parts, as long as ranks are shared.
    """
    places = np.flatnonzero(up)
    count, n = len(places), len(text)
    if count == 0:
        return places
    sign = (text.astype(np.int64) << 1 | up) + 1
    stop = np.append(places[1:] + 1, n + 1)  # the last part ends with a 0, below all signs
    sign = np.append(sign, np.zeros(SYMBOLS, np.int64))

    def keys(of: np.ndarray, offset: int) -> np.ndarray:
        packed = np.zeros(len(of), np.int64)
        for i in range(SYMBOLS):
            at = places[of] + offset + i
            inside = at < stop[of]
            packed = packed << SYMBOL_BITS | np.where(inside, sign[np.minimum(at, n)], 0)
        return packed

    every = np.arange(count)
    key = keys(every, 0)
    order = np.argsort(key, kind="stable")
    rank = _ranks(order, np.append(True, key[order][1:] != key[order][:-1]))
    offset = SYMBOLS
    active = np.flatnonzero(places + offset < stop)
    while len(active):
        _refine(rank, active, keys(active, offset))
        offset += SYMBOLS
        active = active[places[active] + offset < stop[active]]
    step = 1
    while True:
        shared = np.bincount(rank, minlength=count)[rank] > 1
        at = np.flatnonzero(shared)
        if len(at) == 0:
            break
        after = np.full(len(at), -1, np.int64)
        inside = at + step < count
        after[inside] = rank[at[inside] + step]
        _refine(rank, at, after)
        step *= 2
    sorted_places = np.empty(count, np.int64)
    sorted_places[rank] = places
    return sorted_places


def suffix_array(text: np.ndarray) -> np.ndarray:
    """All suffixes of bytes in order: the rising ones sorted, the rest induced.

    Buckets of the first sign are filled in ascending order. A suffix that isn't smaller than
    its successor comes in its bucket in the order of these successors, which lie in buckets
    already full, or earlier in its own.
    """
    n = len(text)
    if n == 0:
        return np.zeros(0, np.int64)
    up = rising(text)
    direct = sort_rising(text, up)
    direct_sign = text[direct]
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    waiting[text[-1]].append(np.array([n - 1]))
    buckets = []
    for sign in np.flatnonzero(np.bincount(text, minlength=256)).tolist():
        level = np.concatenate([np.zeros(0, np.int64), *waiting[sign]])
        parts = []
        while len(level):
            parts.append(level)
            before = level[level > 0] - 1
            level = before[text[before] == sign]
        start, stop = np.searchsorted(direct_sign, [sign, sign + 1])
        bucket = np.concatenate([*parts, direct[start:stop]])
        buckets.append(bucket)
        before = bucket[bucket > 0] - 1
        signs = text[before]
        before, signs = before[signs > sign], signs[signs > sign]
        order = np.argsort(signs, kind="stable")
        before, signs = before[order], signs[order]
        edges = np.flatnonzero(np.append(True, signs[1:] != signs[:-1])) if len(signs) else []
        for i, edge in enumerate(edges):
            end = edges[i + 1] if i + 1 < len(edges) else len(signs)
            waiting[signs[edge]].append(before[edge:end])
    return np.concatenate(buckets)


def common_prefixes(text: np.ndarray, order: np.ndarray, starts: np.ndarray, most: int) -> np.ndarray:
    """By place in the text, the prefix it shares with the suffix sorted before it.

    Compared are only places whose sign before differs from that of their neighbour, and
    `starts`; from there the prefix shrinks by one with each place. Exact up to `most` bytes
    beyond the last of `starts`.
    """
    n = len(text)
    neighbour = np.full(n, -1, np.int64)
    neighbour[order[1:]] = order[:-1]
    place = np.arange(n)
    fresh = np.ones(n, bool)
    inner = (place > 0) & (neighbour > 0)
    fresh[inner] = text[place[inner] - 1] != text[neighbour[inner] - 1]
    fresh[starts] = True
    padded = np.append(text, np.zeros(most + 16, np.uint8))
    words = np.lib.stride_tricks.sliding_window_view(padded, 8)
    a = place[fresh & (neighbour >= 0)]
    length = np.zeros(n, np.int64)
    active, shift = a, 0
    while len(active) and shift < most:
        left = np.ascontiguousarray(words[active + shift]).view(np.uint64)[:, 0]
        right = np.ascontiguousarray(words[neighbour[active] + shift]).view(np.uint64)[:, 0]
        active = active[left == right]
        length[active] += 8
        shift += 8
    ended = a[length[a] < most]
    for _ in range(8):
        x, y = ended + length[ended], neighbour[ended] + length[ended]
        ended = ended[(padded[x] == padded[y]) & (x < n) & (y < n)]
        length[ended] += 1
    length[a] = np.minimum(length[a], n - np.maximum(a, neighbour[a]))
    source = np.maximum.accumulate(np.where(fresh, place, 0))
    return np.maximum(length[source] - (place - source), 0)
