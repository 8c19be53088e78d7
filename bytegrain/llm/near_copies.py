"""Jaccard components where documents share many passages: signature trees over each signature.

For low thresholds and wide shingles, where texts that merely share a passage have signatures in
common. `jaccard_join` compares pages of sets that signatures connect; here only sets of one
signature are compared, as sketches, and only pairs that share enough signatures, by tokens.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bytegrain.llm.arrow import pack, slices, trimmed, unpack
from bytegrain.llm.components import connected_components
from bytegrain.llm.jaccard_join import (
    BITS,
    BROADCAST_NODES,
    LEAF,
    PAGE,
    TOKEN_BITS,
    TreeNode,
    band,
    build_tree,
    mix,
    possible,
    set_table,
    unpack_tokens,
)
from bytegrain.operators.ordering import with_rank
from bytegrain.session import Stage

ROW_BITS = 512  # of a sketch, at least
SKETCH_SHARE = 1  # words of a set's longer sketches, in all ranges together, for each token
SMALL_GROUP = 64  # sets of a signature that are paired at once
PAIRS = 1 << 17  # that are compared at once
DEALT_ROWS = 256  # sets whose signatures are dealt to ranges at once
GROUP = 4  # buckets whose pairs are signatures
SPARE = 3  # shared pairs beyond the one that is needed, so that empty buckets needn't match
SPARE_SHARE = 24  # for large sets one for so many buckets
BLOCK_SIGNATURES = 1 << 20  # of a block, at least
RANGE_TOKENS = 1 << 22  # tokens of all sets for each range of signatures
PART_ROWS = 1 << 16  # signatures of sets that are compared in one task


def bucket_count(of_band: int, percent: int) -> tuple[int, int]:
    """Buckets of a band, and how many pairs of neighbouring buckets linked sets share at least.

    Linked sets of the band and the one before differ in at most d tokens, so all but d buckets
    hold the same tokens in both. Buckets lie in groups of GROUP; what exceeds one equal bucket
    in each group makes a pair of equal ones inside a group.
    """
    upper = (100 / (percent - 0.01)) ** (of_band + 1)
    differ = int((100 - percent) * 2 * upper / (100 + percent))
    if differ == 0:
        return 1, 0  # only equal sets are linked
    spare = min(max(SPARE, (differ + 1) // SPARE_SHARE), (differ + 1) // 8)
    buckets = differ + 2 + spare
    while buckets - differ - -(-buckets // GROUP) < 1 + spare:
        buckets += 1
    return buckets, buckets - differ - -(-buckets // GROUP)


def signatures(tokens: np.ndarray, n: int, percent: int) -> tuple[np.ndarray, int]:
    """(signatures of a set in its band and the next, how many a linked set that is no larger
    shares at least): hashes of the pairs of buckets of each group.

    Pairs of empty buckets give none, unless there are as many as linked sets need to share.
    """
    found, need = [], 1
    mixed = mix(tokens)
    for of_band in (band(n, percent), band(n, percent) + 1):
        buckets, least = bucket_count(of_band, percent)
        if buckets == 1:
            continue
        edges = (np.arange(buckets, dtype=np.uint64) << np.uint64(TOKEN_BITS)) // np.uint64(buckets)
        starts = np.searchsorted(tokens, edges)
        filled = np.diff(np.append(starts, len(tokens))) > 0
        sums = np.zeros(buckets, np.uint64)
        sums[filled] = np.add.reduceat(mixed, starts[filled])
        values = mix(sums + mix(np.arange(buckets, dtype=np.uint64) + np.uint64(of_band << 32)))
        first = np.arange(buckets)
        pairs, lost = [], 0
        for step in range(1, GROUP):
            i = first[(first % GROUP + step < GROUP) & (first + step < buckets)]
            empty = ~(filled[i] | filled[i + step])
            pairs.append((i, i + step, empty))
            lost += int(empty.sum())
        for i, j, empty in pairs:
            kept = ~empty if lost < least else np.ones(len(i), bool)
            found.append(mix(values[i[kept]] * np.uint64(3) + values[j[kept]]))
        if of_band == band(n, percent):
            need = max(least - lost, 1)
    return (np.concatenate(found) if found else np.zeros(0, np.uint64)), need


class Blocks:
    """Collects signatures of many sets and packs them by range of the signature."""

    def __init__(self, ranges: int):
        self.ranges = ranges
        self.clear()

    def clear(self) -> None:
        self.nodes, self.needs, self.values, self.held = [], [], [], 0

    def add(self, node: int, need: int, values: np.ndarray) -> None:
        self.nodes.append(node)
        self.needs.append(need)
        self.values.append(values)
        self.held += len(values)

    def packed(self) -> pa.RecordBatch:
        flat = np.concatenate([np.zeros(0, np.uint64), *self.values])
        owner = np.repeat(np.arange(len(self.values)), list(map(len, self.values)))
        of_range = ((flat >> np.uint64(32)) * np.uint64(self.ranges) >> np.uint64(32)).astype(np.int64)
        low = flat & np.uint64(0xFFFFFFFF)
        order = np.lexsort((low, of_range))
        edges = np.searchsorted(of_range[order], np.arange(self.ranges + 1))
        nodes, needs = np.array(self.nodes, "<i8"), np.array(self.needs, np.uint32)
        found = [(r, order[edges[r] : edges[r + 1]]) for r in range(self.ranges) if edges[r] < edges[r + 1]]
        blobs = []
        for _, part in found:
            owners, local = np.unique(owner[part], return_inverse=True)
            steps = np.diff(low[part], prepend=np.uint64(0))
            blobs.append(pack(steps, local, needs[owners], blob=nodes[owners].tobytes()))
        self.clear()
        return pa.record_batch(
            [pa.array([r for r, _ in found], pa.int32()), pa.array(blobs, pa.binary())], ["range", "block"]
        )


def shared_signatures(sets: DataFrame, percent: int) -> DataFrame:
    """(sig, node, hub, need): the signatures that several sets have, with the least of these
    sets, `hub`.

    Signatures go to the ranges of their hash packed by block, some 6 bytes each; 32 bits are
    kept within a range, and an accidental match only makes a further candidate.
    """
    spark = sets.sparkSession
    held = sets.where("_tokens IS NOT NULL").select("_n", "_node", "_tokens")
    tokens = held.agg(F.sum("_n").alias("n")).first().n or 0
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-tokens // RANGE_TOKENS))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = Blocks(ranges)
        for batch in batches:
            for part in slices(batch, "_tokens"):
                for n, node, packed in zip(*(part.column(c).to_pylist() for c in ("_n", "_node", "_tokens"))):
                    values, need = signatures(unpack_tokens(packed), n, percent)
                    blocks.add(node, need, values)
                if blocks.held >= BLOCK_SIGNATURES:
                    yield blocks.packed()
        yield blocks.packed()

    def meet(key: tuple, table: pa.Table) -> pa.Table:
        lows, nodes, needs = [], [], []
        for block in table.column("block"):
            (steps, local, need), names = unpack(block.as_py())
            lows.append(np.cumsum(steps, dtype=np.int64))
            nodes.append(np.frombuffer(names, "<i8")[local])
            needs.append(need[local])
        low, node, need = map(np.concatenate, (lows, nodes, needs))
        order = np.lexsort((node, low))
        low, node, need = low[order], node[order], need[order]
        fresh = np.ones(len(low), bool)
        fresh[1:] = (low[1:] != low[:-1]) | (node[1:] != node[:-1])
        low, node, need = low[fresh], node[fresh], need[fresh]
        starts = np.flatnonzero(np.diff(low, prepend=-1))
        sizes = np.diff(np.append(starts, len(low)))
        several = np.repeat(sizes > 1, sizes)
        sig = low + (np.int64(key[0].as_py()) << np.int64(32))
        columns = [sig, node, np.repeat(node[starts], sizes), need.astype(np.int64)]
        return pa.table([pa.array(c[several]) for c in columns], ["sig", "node", "hub", "need"])

    blocks = held.mapInArrow(trimmed(deal), "range int, block binary")
    return blocks.groupBy("range").applyInArrow(meet, "sig bigint, node bigint, hub bigint, need bigint")


def hub_matches(shared: DataFrame) -> DataFrame:
    """(node, hub, k): sets that share as many signatures with a hub as linked sets do."""
    met = shared.where("node <> hub").groupBy("node", "hub").agg(F.count("*").alias("k"), F.min("need").alias("need"))
    return met.where("k >= need").select("node", "hub", "k")


def likely_clusters(matches: DataFrame) -> DataFrame:
    """(node, cluster): sets that share as many signatures with a hub as linked sets do.

    Each set follows the hub that it shares most with, so a group of any size makes one edge
    for each of its sets. Clusters only decide which sets are compared first.
    """
    best = matches.groupBy("node").agg(F.max(F.struct("k", "hub")).alias("best"))
    edges = best.select(F.col("best.hub").alias("a"), F.col("node").alias("b"))
    return connected_components(edges, "clusters").select("node", F.col("label").alias("cluster"))


def bridges(matches: DataFrame, labels: DataFrame) -> DataFrame:
    """(a, b): for two components, not both single sets, the set and hub that share most.

    A group whose sets follow several hubs may come out of its pages in a few components, of
    which any two sets are linked. One link of each two leaves none of these pairs to compare.
    """
    of_node = labels.select("node", F.col("label").alias("_of_node"))
    of_hub = labels.select(F.col("node").alias("hub"), F.col("label").alias("_of_hub"))
    met = matches.join(of_node, "node", "left").join(of_hub, "hub", "left").where("_of_node IS NOT NULL OR _of_hub IS NOT NULL")
    ends = F.coalesce("_of_node", "node"), F.coalesce("_of_hub", "hub")
    apart = met.where(ends[0] != ends[1]).groupBy(F.least(*ends).alias("_low"), F.greatest(*ends).alias("_high"))
    return apart.agg(F.max(F.struct("k", "node", "hub")).alias("best")).select(
        F.col("best.node").alias("a"), F.col("best.hub").alias("b")
    )


def bitmap(tokens: np.ndarray, bits: int = BITS) -> bytes:
    flags = np.zeros(bits, np.uint8)
    flags[(tokens % np.uint64(bits)).astype(np.int64)] = 1
    return np.packbits(flags).tobytes()


def fine_bitmap(packed: bytes) -> bytes:
    """A set's size and a bitmap of four bits or more for each token, a power of two."""
    tokens = unpack_tokens(packed)
    return len(tokens).to_bytes(8, "little") + bitmap(tokens, max(BITS, 1 << (4 * len(tokens) - 1).bit_length()))


def maybe_linked(a: bytes, b: bytes, percent: int) -> bool:
    """Whether two fine bitmaps allow a link; the longer is folded to the length of the other."""
    sizes = [int.from_bytes(x[:8], "little") for x in (a, b)]
    maps = [np.frombuffer(x, np.uint64, offset=8) for x in (a, b)]
    width = min(map(len, maps))
    maps = [np.bitwise_or.reduce(m.reshape(-1, width)) for m in maps]
    common = int(np.bitwise_count(maps[0] & maps[1]).sum())
    most = min(n - int(np.bitwise_count(m).sum()) + common for n, m in zip(sizes, maps))
    return (100 + percent) * most >= percent * sum(sizes)


class Sets:
    """Sets of a page, by cluster and size, with bitmaps, and which of them are connected."""

    def __init__(self, table: pa.Table):
        column = {c: table.column(c).to_pylist() for c in table.column_names}
        places = {(c, node): i for i, (c, node) in enumerate(zip(column["cluster"], column["node"]))}
        order = sorted(places.values(), key=lambda i: (column["cluster"][i], column["n"][i], column["node"][i]))
        self.clusters = [column["cluster"][i] for i in order]
        self.nodes = [column["node"][i] for i in order]
        self.sizes = np.array([column["n"][i] for i in order], np.int64)
        self.tokens = [unpack_tokens(column["tokens"][i]) for i in order]
        self.bits = np.frombuffer(b"".join(map(bitmap, self.tokens)), np.uint64).reshape(len(order), -1)
        self.parent: dict[int, int] = {}

    def root(self, node: int) -> int:
        parent = self.parent
        while parent.setdefault(node, node) != node:
            parent[node] = node = parent[parent[node]]
        return node

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        self.parent[max(a, b)] = min(a, b)
        return a != b


def link(sets, percent: int, leaves) -> list[tuple[int, int]]:
    """Pairs that `leaves` finds, by dual traversal of each cluster's tree.

    Node pairs without a possible link are left out, and those that lie in one component.
    """
    edges: list[tuple[int, int]] = []
    borders = [i for i, c in enumerate(sets.clusters) if i == 0 or c != sets.clusters[i - 1]]
    for start, stop in zip(borders, [*borders[1:], len(sets.clusters)]):
        if stop - start <= LEAF:
            edges += leaves(sets, range(start, stop), range(start, stop), percent)
            continue
        root = build_tree(sets, start, stop)
        stack = [(root, root)]
        while stack:
            a, b = stack.pop()
            if not possible(a, b, percent):
                continue
            same = a.uniform(sets)
            if same is not None and same == b.uniform(sets):
                continue
            if a.children or b.children:
                left, right = a.children or [a], b.children or [b]
                stack += [
                    (x, y) for i, x in enumerate(left) for y in (right[i:] if a is b else right)
                ]
            else:
                edges += leaves(sets, a, b, percent)
    return edges


def possible_pairs(sets, a: TreeNode | range, b: TreeNode | range, percent: int) -> list[tuple[int, int]]:
    """Places of the pairs of two leaves whose bitmaps and sizes allow a link."""
    left, right = np.arange(a.start, a.stop), np.arange(b.start, b.stop)
    common = np.bitwise_count(sets.bits[left][:, None] & sets.bits[right][None]).sum(2, dtype=np.int64)
    own = {i: int(np.bitwise_count(sets.bits[i]).sum()) for i in {*left.tolist(), *right.tolist()}}
    beyond = [sets.sizes[side] - np.array([own[i] for i in side.tolist()]) for side in (left, right)]
    most = np.minimum(beyond[0][:, None] + common, beyond[1][None] + common)
    total = sets.sizes[left][:, None] + sets.sizes[right][None]
    maybe = ((100 + percent) * most >= percent * total) & (left[:, None] < right[None])
    return [(int(left[i]), int(right[j])) for i, j in np.argwhere(maybe).tolist()]


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    overlap = len(np.intersect1d(a, b, assume_unique=True))
    return (100 + percent) * overlap >= percent * (len(a) + len(b))


def link_leaves(sets: Sets, a: TreeNode, b: TreeNode, percent: int) -> list[tuple[int, int]]:
    """Links of two leaves that connect what isn't connected yet."""
    edges = []
    for x, y in possible_pairs(sets, a, b, percent):
        if sets.root(sets.nodes[x]) != sets.root(sets.nodes[y]) and linked(sets.tokens[x], sets.tokens[y], percent):
            sets.join(sets.nodes[x], sets.nodes[y])
            edges.append((sets.nodes[x], sets.nodes[y]))
    return edges


def edge_table(found: list[tuple[int, int]]) -> pa.Table:
    return pa.table([pa.array([e[k] for e in found], pa.int64()) for k in (0, 1)], ["a", "b"])


def links_in_pages(sets: DataFrame, clusters: DataFrame, percent: int, page: int) -> DataFrame:
    """(a, b): links inside pages of `page` sets of a cluster, in the order of their sizes.

    The hub of a cluster comes to all its pages and the first set of a page to the one before,
    so that pages of near copies are connected. Tokens move once.
    """
    sizes = sets.where("_tokens IS NOT NULL").groupBy(F.col("_node").alias("node")).agg(F.first("_n").alias("n"))
    named = Stage(clusters.join(sizes, "node"), "named").df
    ranked = with_rank(named, "cluster", "n", "node")
    own = ranked.select("cluster", "node", F.expr(f"rank div {page}").alias("page"))
    before = ranked.where(f"rank % {page} = 0 AND rank > 0").select(
        "cluster", "node", F.expr(f"rank div {page} - 1").alias("page")
    )
    spread = own.groupBy("cluster").agg(F.min("page").alias("low"), F.max("page").alias("high")).where("low < high")
    hubs = spread.select("cluster", F.col("cluster").alias("node"), F.explode(F.sequence("low", "high")).alias("page"))
    placed = Stage(own.unionByName(before).unionByName(hubs).distinct(), "pages").df
    small = placed.count() <= BROADCAST_NODES
    held = sets.where("_tokens IS NOT NULL").select(F.col("_node").alias("node"), F.col("_n").alias("n"), F.col("_tokens").alias("tokens"))
    members = held.join(F.broadcast(placed) if small else placed, "node")

    def find(table: pa.Table) -> pa.Table:
        return edge_table(link(Sets(table), percent, link_leaves))

    return members.groupBy("page").applyInArrow(find, "a bigint, b bigint")


def sketch(tokens: np.ndarray, bits: int) -> bytes:
    """For each of `bits` places, a power of two, whether an odd number of tokens falls on it.

    The XOR of two sketches is that of the tokens which one of the sets has alone, so they
    differ in no more places than the sets do in tokens, whatever the sets share.
    """
    odd = np.bincount((tokens & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def sketch_bits(n: int) -> int:
    return max(ROW_BITS, 1 << (n - 1).bit_length())


def fold(words: np.ndarray, width: int) -> np.ndarray:
    """The sketch of `width` words of a longer one."""
    return np.bitwise_xor.reduce(words.reshape(-1, width))


def within(differ: np.ndarray, total: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of `total` tokens that differ in so many or more may be linked."""
    return (100 + percent) * differ <= (100 - percent) * total


class Sketches:
    """Sets of a range of signatures: sketches, sizes and components, and who has a signature."""

    def __init__(self, table: pa.Table, percent: int):
        def numbers(name: str) -> np.ndarray:
            return table.column(name).to_numpy().astype(np.int64)

        self.percent = percent
        self.nodes, self.sizes, self.comps, self.needs = map(numbers, ("node", "n", "comp", "need"))
        self.words = [np.frombuffer(x, np.uint64) for x in table.column("bits").to_pylist()]
        width = ROW_BITS // 64
        self.bits = np.array([fold(w, width) for w in self.words], np.uint64).reshape(-1, width)
        held = [np.frombuffer(x, np.int64) for x in table.column("sigs").to_pylist()]
        sigs = np.concatenate([np.zeros(0, np.int64), *held])
        owner = np.repeat(np.arange(len(held)), list(map(len, held)))
        order = np.lexsort((self.comps[owner], sigs))
        sigs, self.owner = sigs[order], owner[order]
        self.starts = np.flatnonzero(np.append(True, sigs[1:] != sigs[:-1])) if len(sigs) else np.zeros(0, np.int64)
        self.counts = np.diff(np.append(self.starts, len(sigs)))

    def meetings(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All pairs of sets that have a signature in common, once for each, in bounded pieces.

        Of larger groups, which lie by component, sets of one component are mostly left out.
        """
        for size in np.unique(self.counts[self.counts <= SMALL_GROUP]).tolist():
            left, right = np.triu_indices(size, 1)
            starts = self.starts[self.counts == size]
            step = max(1, PAIRS // max(len(left), 1))
            for at in range(0, len(starts) if len(left) else 0, step):
                groups = self.owner[starts[at : at + step, None] + np.arange(size)]
                yield groups[:, left].ravel(), groups[:, right].ravel()
        large = self.counts > SMALL_GROUP
        for start, count in zip(self.starts[large].tolist(), self.counts[large].tolist()):
            group = self.owner[start : start + count]
            ends = np.append(np.flatnonzero(np.diff(self.comps[group])) + 1, count)
            at = 0
            while at < count:
                end = int(ends[np.searchsorted(ends, at, side="right")])  # of the component
                whole = end - at >= SMALL_GROUP
                stop = min(end if whole else count, at + SMALL_GROUP)
                for low in range(end if whole else at, count, PAIRS // SMALL_GROUP):
                    high = min(low + PAIRS // SMALL_GROUP, count)
                    i, j = (x.ravel() for x in np.meshgrid(np.arange(at, stop), np.arange(low, high)))
                    ahead = i < j
                    yield group[i[ahead]], group[j[ahead]]
                at = stop

    def near(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Codes of the pairs of different components whose sizes and sketches allow a link."""
        total = self.sizes[i] + self.sizes[j]
        maybe = (self.comps[i] != self.comps[j]) & within(np.abs(self.sizes[i] - self.sizes[j]), total, self.percent)
        i, j, total = i[maybe], j[maybe], total[maybe]
        differ = np.bitwise_count(self.bits[i] ^ self.bits[j]).sum(1, dtype=np.int64)
        maybe = within(differ, total, self.percent)
        i, j = i[maybe], j[maybe]
        return np.minimum(i, j) * len(self.nodes) + np.maximum(i, j)

    def close(self, i: int, j: int) -> bool:
        """The same by the whole sketches."""
        width = min(len(self.words[i]), len(self.words[j]))
        differ = int(np.bitwise_count(fold(self.words[i], width) ^ fold(self.words[j], width)).sum())
        return bool(within(differ, self.sizes[i] + self.sizes[j], self.percent))

    def pairs(self) -> pa.Table:
        """(a, b, k, need): pairs that may be linked, and how many signatures of the range both have."""
        codes, times, held = np.zeros(0, np.int64), np.zeros(0, np.int64), []

        def merge() -> None:
            nonlocal codes, times
            fresh = np.concatenate([np.zeros(0, np.int64), *held])
            held.clear()
            weights = np.append(times, np.ones(len(fresh), np.int64))
            codes, place = np.unique(np.append(codes, fresh), return_inverse=True)
            times = np.bincount(place, weights, len(codes)).astype(np.int64)

        for i, j in self.meetings():
            held.append(self.near(i, j))
            if sum(map(len, held)) > PAIRS:
                merge()
        merge()
        left, right = np.divmod(codes, max(len(self.nodes), 1))
        kept = [self.close(i, j) for i, j in zip(left.tolist(), right.tolist())]
        left, right, times = (x[np.array(kept, bool)] for x in (left, right, times))
        a, b = self.nodes[left], self.nodes[right]
        columns = [np.minimum(a, b), np.maximum(a, b), times, np.minimum(self.needs[left], self.needs[right])]
        return pa.table([pa.array(c, pa.int64()) for c in columns], ["a", "b", "k", "need"])


def pairs_across(shared: DataFrame, sets: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """(a, b): pairs of sets of different components that may be linked.

    Only signatures whose sets lie in several components are left. Their sets meet as sketches,
    one for each range of signatures; tokens don't move here. Pairs must share as many
    signatures as linked sets do.
    """
    comp = labels.select("node", F.col("label").alias("comp"))
    known = shared.select("sig", "node", "need").join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    known = Stage(known, "known").df
    mixed = known.groupBy("sig").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high").select("sig")
    rows = Stage(known.join(mixed, "sig"), "mixed").df
    wanted = rows.select("node").distinct()

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = [unpack_tokens(t) for t in batch.column("_tokens").to_pylist()]
            maps = [sketch(t, sketch_bits(len(t))) for t in tokens]
            yield pa.record_batch([batch.column("_node"), batch.column("_n"), pa.array(maps, pa.binary())], ["node", "n", "bits"])

    held = sets.where("_tokens IS NOT NULL").select("_node", "_n", "_tokens")
    drawn = held.join(wanted, held["_node"] == wanted["node"], "left_semi").mapInArrow(
        trimmed(draw), "node bigint, n bigint, bits binary"
    )
    drawn = drawn.groupBy("node").agg(F.first("n").alias("n"), F.first("bits").alias("bits"))
    parts = max(int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // PART_ROWS))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, DEALT_ROWS):
                rows = batch.slice(at, DEALT_ROWS)
                owner, ranges, packed, maps = [], [], [], []
                for row, (sigs, bits, n) in enumerate(zip(*(rows.column(c) for c in ("sigs", "bits", "n")))):
                    sigs = sigs.values.to_numpy()
                    of_part = (mix(sigs.view(np.uint64)) % np.uint64(parts)).astype(np.int64)
                    found, place = np.unique(of_part, return_inverse=True)
                    words = np.frombuffer(bits.as_py(), np.uint64)
                    width = len(words)
                    while width > ROW_BITS // 64 and width * len(found) > SKETCH_SHARE * n.as_py():
                        width //= 2
                    owner += [row] * len(found)
                    ranges += found.tolist()
                    packed += [part.tobytes() for part in np.split(sigs[np.argsort(place, kind="stable")], np.cumsum(np.bincount(place))[:-1])]
                    maps += [fold(words, width).tobytes()] * len(found)
                own = rows.select(["node", "comp", "need", "n"]).take(pa.array(owner, pa.int64()))
                columns = [pa.array(ranges, pa.int64()), *own.columns, pa.array(packed, pa.binary()), pa.array(maps, pa.binary())]
                yield pa.record_batch(columns, ["_part", "node", "comp", "need", "n", "sigs", "bits"])

    by_node = rows.groupBy("node").agg(F.first("comp").alias("comp"), F.min("need").alias("need"), F.collect_list("sig").alias("sigs"))
    met = by_node.join(drawn, "node").mapInArrow(
        trimmed(deal), "_part bigint, node bigint, comp bigint, need bigint, n bigint, sigs binary, bits binary"
    )

    def find(table: pa.Table) -> pa.Table:
        return Sketches(table, percent).pairs()

    found = met.groupBy("_part").applyInArrow(find, "a bigint, b bigint, k bigint, need bigint")
    counted = found.groupBy("a", "b").agg(F.sum("k").alias("k"), F.min("need").alias("need"))
    return counted.where("k >= need").select("a", "b")


def compared(pairs: DataFrame, contents: DataFrame, test) -> DataFrame:
    """The pairs (a, b) whose contents pass a test; `contents`: (node, held)."""
    left = contents.select(F.col("node").alias("a"), F.col("held").alias("x"))
    right = contents.select(F.col("node").alias("b"), F.col("held").alias("y"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("a", "b", "x", "y")))
            yield from edge_table([(a, b) for a, b, x, y in rows if test(x, y)]).to_batches()

    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(trimmed(check), "a bigint, b bigint")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs that are linked: first by finer bitmaps, a tenth of the tokens, which settle
    nearly all pairs that aren't, then by tokens."""

    def contents(of: DataFrame) -> DataFrame:
        ends = of.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        held = sets.where("_tokens IS NOT NULL").join(ends, F.col("_node") == F.col("node"), "left_semi")
        return held.groupBy(F.col("_node").alias("node")).agg(F.first("_tokens").alias("held"))

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            maps = [fine_bitmap(packed) for packed in batch.column("held").to_pylist()]
            yield pa.record_batch([batch.column("node"), pa.array(maps, pa.binary())], ["node", "held"])

    drawn = Stage(contents(pairs).mapInArrow(trimmed(draw), "node bigint, held binary"), "bitmaps").df
    left = Stage(compared(pairs, drawn, lambda x, y: maybe_linked(x, y, percent)), "near-pairs").df
    return compared(left, contents(left), lambda x, y: linked(unpack_tokens(x), unpack_tokens(y), percent))


def near_copy_components(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    width: int = 5,
    percent: int = 80,
    page: int = PAGE,
) -> DataFrame:
    """(key, n_shingles, component_id), one row for each row of `docs`.

    Texts are lower-cased (A-Z) and cut into words at blanks; a text is the set of its runs of
    `width` words, or its whole sequence if shorter. Two texts are linked if 100 * overlap >=
    `percent` * union. `component_id` is the least key that links reach. Null and empty texts
    and texts without words have no shingles and their own key as component; rows that share a
    key are one node of the graph only through equal sets; a null key is never a component's
    id unless all its members' keys are null. Other columns are not read.

    1. Texts become sets of hashes (a staged table); equal sets are one set from here on.
    2. Tokens of a set are dealt to so many buckets that linked sets must agree in two of a
       group (pigeonhole on their largest difference). Sets that agree share a signature, the
       hash of the pair of buckets. Signatures of one set only are done with.
    3. Sets that share as many signatures with a hub as linked sets do are put into pages, by
       cluster and size, and a page is searched by dual traversal of signature trees. Components
       that come out are connected by their best match with a hub, if that is a link.
    4. Sets that share a signature and are not connected yet are compared as sketches, which
       tell apart sets that have no more than passages in common; pairs that may be linked, and
       share enough signatures, are compared by bitmaps, and those left by their tokens.
    Pairs of nodes that lie in one component already are skipped, which keeps large groups of
    near copies linear.
    """
    sets = Stage(set_table(docs, key, text, width), "sets")
    shared = Stage(shared_signatures(sets.df, percent), "shared")
    matches = Stage(hub_matches(shared.df), "matches")
    found = Stage(links_in_pages(sets.df, likely_clusters(matches.df), percent, page), "links").df
    labels = connected_components(found, "paged")
    between = Stage(bridges(matches.df, labels), "bridges").df
    matches.drop()
    if not between.isEmpty():
        found = Stage(found.unionByName(verified(between, sets.df, percent)), "links").df
        labels = connected_components(found, "bridged")
    pairs = Stage(pairs_across(shared.df, sets.df, labels, percent), "pairs").df
    shared.drop()
    if not pairs.isEmpty():
        more = Stage(verified(pairs, sets.df, percent), "more-links").df
        labels = connected_components(found.unionByName(more), "linked")
    labels = labels.select(F.col("node").alias("_linked"), F.col("label"))
    rows = Stage(sets.df.select("_key", "_n", "_node"), "rows").df
    sets.drop()
    least = rows.where("_node IS NOT NULL").groupBy("_node").agg(F.min("_key").alias("_least"))
    of_node = Stage(
        least.join(labels, F.col("_node") == F.col("_linked"), "left").select(
            "_node", "_least", F.coalesce("label", "_node").alias("_label")
        ),
        "nodes",
    ).df
    of_label = of_node.groupBy("_label").agg(F.min("_least").alias("_component"))
    of_node = of_node.join(of_label, "_label").select(F.col("_node").alias("_set"), "_component")
    return rows.join(of_node, F.col("_node") == F.col("_set"), "left").select(
        F.col("_key").alias(key),
        F.col("_n").alias("n_shingles"),
        F.coalesce("_component", "_key").alias("component_id"),
    )
