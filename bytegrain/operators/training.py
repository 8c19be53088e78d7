"""Byte-pair training in rounds of many exact merges.

The state is a table of distinct chunks as arrays of token ids, with a table of pair counts
beside it. One round:

1. The top `k` pairs in merge order form the hot set.
2. Spark cuts every chunk at the boundaries whose pair is not hot and counts the
   distinct chains that remain. Only these reach the driver, at most `max_chains`;
   if there are more, the hot set is halved, down to a single pair, which needs none.
3. The driver picks merges one by one on the chains while the best pair comes no
   later in merge order than the last hot pair.
4. Spark replaces each chain by its merged form in the state and writes it down. Rows that
   changed give signed changes of pair counts; no other row is counted again.

Why step 3 picks what one-at-a-time merging would: a pair's count only falls and its
first boundary only moves back as merges are applied. Any later pair (p, q) meets at a
boundary that once joined the last symbol of p and the first of q; that old pair was at
least as frequent and as early, with ids at most as large, so if (p, q) is within the
horizon the old pair was hot. Symbols made in the round consist of hot pairs. Hence all
occurrences of every pair within the horizon lie inside chains, and chain counts are exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from bytegrain.functions import runs
from bytegrain.model import DEFAULT_VOCAB_SIZE, SPEC, BpeModel, Layout, check_vocab_size
from bytegrain.operators.pairs import top_pairs
from bytegrain.session import Stage

MAX_CHAINS = 1 << 15
MAX_HOT = 1 << 13
MAX_CHAIN = 1 << 14  # tokens; with a longer chain the hot set is halved as with too many
BROADCAST_PAIRS = 1_000_000  # changed pairs, 16 bytes each


def train(
    words: DataFrame,
    vocab_size: int | None = None,
    layout: Layout = SPEC,
    pattern: str = "cl100k",
    tie: str = "id",
    max_chains: int = MAX_CHAINS,
) -> BpeModel:
    """Learn merges from a chunk frequency table until `vocab_size` or no pair is left.

    Among equally frequent pairs, `tie="id"` takes the lowest ids and `tie="first"` the
    one that occurs first in the corpus; the latter needs `words` with `first`, and counts
    all pairs anew each round, since where a pair occurs first can't be updated.
    """
    if tie not in ("id", "first"):
        raise ValueError(f"tie must be 'id' or 'first', not {tie!r}")
    wanted = check_vocab_size(layout, vocab_size or DEFAULT_VOCAB_SIZE[layout.name])
    by_first = tie == "first"
    carried = ["freq", "first"] if by_first else ["freq"]
    # Rounds cost far more than their bytes tell, so the count of tasks is set, not coalesced.
    parts = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    state = Stage(start_state(words.select("chunk", *carried).repartition(parts), carried), "tokens")
    counts = None if by_first else Stage(pair_counts(state.df, carried), "pairs")
    model = BpeModel(layout, pattern, [])
    hot_size = 64
    while len(model.merges) < wanted:
        table = pair_counts(state.df, carried) if by_first else counts.df
        hot = top_pairs(table, hot_size).collect()
        if not hot:
            break
        complete = len(hot) < hot_size
        chains = _collect_chains(state.df, carried, hot, max_chains)
        if chains is not None and len(chains) < max_chains // 3:
            growth = 2 if len(chains) > max_chains // 8 else 4
            hot_size = min(hot_size * growth, MAX_HOT)
        while chains is None and len(hot) > 1:
            hot_size = len(hot) // 2
            hot, complete = hot[:hot_size], False
            chains = _collect_chains(state.df, carried, hot, max_chains)
        next_id, forms = model.vocab_size, None
        if chains is None:
            picked = [(signs_of_pair(hot[0].pair), hot[0].n)]
        else:
            picked, forms = _pick(hot, chains, complete, next_id, wanted - len(model.merges))
        model.merges += [(ord(pair[0]), ord(pair[1]), n) for pair, n in picked]
        model.rounds += 1
        if len(model.merges) == wanted:
            break
        keys = np.array(sorted(r.pair for r in hot), np.int64)
        merged = Stage(rewrite_state(state.df, carried, keys, forms, next_id, by_first), "tokens")
        if not by_first:
            changed = Stage(count_changes(counts.df, merged.df, next_id), "pairs")
            counts.drop()
            counts = changed
        state.drop()
        state = merged
    state.drop()
    if counts is not None:
        counts.drop()
    return model


def start_state(words: DataFrame, carried: list[str]) -> DataFrame:
    """(carried, tokens, old): chunks as bytes; `old` is what a round has replaced, or null."""

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = runs.byte_lists(batch.column("chunk"))
            old = pa.nulls(len(tokens), tokens.type)
            yield pa.record_batch([*map(batch.column, carried), tokens, old], [*carried, "tokens", "old"])

    return words.mapInArrow(start, f"{_ddl(words, carried)}, tokens array<int>, old array<int>")


def pair_counts(state: DataFrame, carried: list[str]) -> DataFrame:
    """(pair, n), and `first` if the state carries it: the pair's earliest boundary."""
    live = state.where(F.size("tokens") > 1).select(*carried, "tokens")
    columns = "pair bigint, n bigint" + (f", first {_first_type(live)}" if "first" in carried else "")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = _in_order(batch, carried)
            pairs, n, row, at = runs.pair_sums(batch.column("tokens"), _freq(batch))
            yield _found(batch, carried, "pair", pa.array(pairs), n, row, at)

    return _summed(live.mapInArrow(count, columns), "pair", carried)


def pair_chains(state: DataFrame, carried: list[str], hot: np.ndarray) -> DataFrame:
    """(chain, n), and `first`: the stretches of every chunk whose boundaries are all hot."""
    live = state.where(F.size("tokens") > 1).select(*carried, "tokens")
    columns = "chain binary, n bigint" + (f", first {_first_type(live)}" if "first" in carried else "")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = _in_order(batch, carried)
            chains, n, row, at = runs.chain_sums(batch.column("tokens"), _freq(batch), hot)
            yield _found(batch, carried, "chain", chains, n, row, at)

    return _summed(live.mapInArrow(cut, columns), "chain", carried)


def rewrite_state(
    state: DataFrame, carried: list[str], hot: np.ndarray, forms: dict[bytes, bytes] | None, next_id: int, by_first: bool
) -> DataFrame:
    """The state with chains replaced; without `forms`, the one hot pair by `next_id`."""
    live = state.where(F.size("tokens") > 1).select(*carried, "tokens")

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        form = (lambda run: runs.merge_run(run, next_id)) if forms is None else (lambda run: forms.get(run, run))
        for batch in batches:
            before = batch.column("tokens")
            tokens, changed = runs.rewritten(before, hot, form)
            none = pa.nulls(len(before), tokens.type)
            old = none if by_first else pc.if_else(pa.array(changed), before.cast(tokens.type), none)
            yield pa.record_batch([*map(batch.column, carried), tokens, old], [*carried, "tokens", "old"])

    return live.mapInArrow(rewrite, f"{_ddl(live, carried)}, tokens array<int>, old array<int>")


def count_changes(counts: DataFrame, state: DataFrame, next_id: int) -> DataFrame:
    """Pair counts after a round. Pairs of new tokens are added; the counts of others fall by
    what the changed rows lost, and the table of counts is not shuffled for it."""

    def change(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for column, sign in (("tokens", 1), ("old", -1)):
                pairs, n, _, _ = runs.pair_sums(batch.column(column), sign * _freq(batch))
                parts.append((pairs, n))
            pairs, n, _ = runs.sums(*map(np.concatenate, zip(*parts)))
            yield pa.record_batch([pa.array(pairs), pa.array(n)], ["pair", "n"])

    changed = state.where("old IS NOT NULL").select("freq", "tokens", "old")
    delta = Stage(
        changed.mapInArrow(change, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n")).where("n <> 0"),
        "changes",
    )
    fresh = (F.shiftright("pair", 32) >= next_id) | (F.col("pair").bitwiseAND(0xFFFFFFFF) >= next_id)
    fallen = delta.df.where(~fresh).select("pair", F.col("n").alias("change"))
    if fallen.count() <= BROADCAST_PAIRS:
        fallen = F.broadcast(fallen)
    left = counts.join(fallen, "pair", "left").select("pair", (F.col("n") + F.coalesce("change", F.lit(0))).alias("n"))
    return left.where("n > 0").unionByName(delta.df.where(fresh))


def _ddl(df: DataFrame, columns: list[str]) -> str:
    return ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in columns)


def _first_type(df: DataFrame) -> str:
    return f"struct<first:{df.schema['first'].dataType.simpleString()},at:int>"


def _freq(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("freq").to_numpy(zero_copy_only=False).astype(np.int64)


def _in_order(batch: pa.RecordBatch, carried: list[str]) -> pa.RecordBatch:
    """With `first`, the rows in the order of the corpus, so that what is met first is first."""
    if "first" not in carried:
        return batch
    first = batch.column("first")
    keys = pa.table([first.field(i) for i in range(first.type.num_fields)], [f"k{i}" for i in range(first.type.num_fields)])
    order = pc.sort_indices(keys, [(name, "ascending") for name in keys.column_names], null_placement="at_start")
    return batch.take(order)


def _found(batch: pa.RecordBatch, carried: list[str], name: str, values: pa.Array, n, row, at) -> pa.RecordBatch:
    columns = {name: values, "n": pa.array(n, pa.int64())}
    if "first" in carried:
        of_row = batch.column("first").take(pa.array(row, pa.int64()))
        columns["first"] = pa.StructArray.from_arrays([of_row, pa.array(at, pa.int32())], ["first", "at"])
    return pa.record_batch(list(columns.values()), list(columns))


def _summed(found: DataFrame, name: str, carried: list[str]) -> DataFrame:
    first = [F.min("first").alias("first")] if "first" in carried else []
    return found.groupBy(name).agg(F.sum("n").alias("n"), *first)


def signs_of_pair(pair: int) -> str:
    return chr(pair >> 32) + chr(pair & 0xFFFFFFFF)


def signs_of_chain(chain: bytes) -> str:
    return "".join(map(chr, np.frombuffer(chain, "<i4").tolist()))


def chain_of_signs(signs: str) -> bytes:
    return np.array([*map(ord, signs)], "<i4").tobytes()


def _collect_chains(state: DataFrame, carried: list[str], hot: list[Row], max_chains: int) -> list[Row] | None:
    if len(hot) == 1:
        return None
    chains = pair_chains(state, carried, np.array(sorted(r.pair for r in hot), np.int64))
    short = F.when(F.octet_length("chain") <= 4 * MAX_CHAIN, F.col("chain"))
    rows = chains.withColumn("chain", short).limit(max_chains + 1).collect()
    fits = len(rows) <= max_chains and all(r.chain is not None for r in rows)
    return rows if fits else None


def _pick(
    hot: list[Row], chains: list[Row], complete: bool, next_id: int, budget: int
) -> tuple[list[tuple[str, int]], dict[bytes, bytes]]:
    """Merges of one round as (pair, count), in order, and the changed chains' new forms.

    A chain is a string here, one sign for each token. Keys of pairs only fall back, so a heap
    may hold outdated ones: what comes up with one is put back with the present one.
    """
    by_first = "first" in hot[0]
    start = [signs_of_chain(r.chain) for r in chains]
    text = list(start)
    freq = [r.n for r in chains]
    width: dict[str, int] = {}
    counts: dict[str, int] = {}
    holders: dict[str, set[int]] = {}

    def tally(i: int, sign: int) -> None:
        for pair in map("".join, zip(text[i], text[i][1:])):
            counts[pair] = counts.get(pair, 0) + sign * freq[i]
            if not counts[pair]:
                del counts[pair]
            elif sign > 0:
                holders.setdefault(pair, set()).add(i)

    def boundary(pair: str):
        """Earliest boundary of a pair, counted in symbols of the round's start."""
        places = []
        for i in holders[pair]:
            at = text[i].find(pair)
            if at >= 0:
                places.append((chains[i].first, sum(width.get(c, 1) for c in text[i][: at + 1])))
        return min(places)

    def merge_key(pair: str):
        return (-counts[pair], boundary(pair) if by_first else pair)

    for i in range(len(text)):
        tally(i, 1)
    horizon = None if complete else merge_key(signs_of_pair(hot[-1].pair))
    heap = [(merge_key(pair), pair) for pair in counts]
    heapify(heap)
    picked: list[tuple[str, int]] = []
    while heap and len(picked) < budget:
        key, pair = heappop(heap)
        if pair not in counts:
            continue
        if key != (now := merge_key(pair)):
            heappush(heap, (now, pair))
            continue
        if horizon is not None and key > horizon:
            break
        picked.append((pair, counts[pair]))
        new = chr(next_id + len(picked) - 1)
        width[new] = width.get(pair[0], 1) + width.get(pair[1], 1)
        fresh: set[str] = set()
        for i in holders.pop(pair):
            if pair not in text[i]:
                continue
            tally(i, -1)
            text[i] = text[i].replace(pair, new)
            tally(i, 1)
            fresh.update(p for p in map("".join, zip(text[i], text[i][1:])) if new in p)
        for made in fresh & counts.keys():
            heappush(heap, (merge_key(made), made))
    forms = {
        bytes(r.chain): chain_of_signs(form) for r, was, form in zip(chains, start, text) if form != was
    }
    return picked, forms
