"""Jaccard self-join of shingle sets with signature trees."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bytegrain.llm.arrow import ddl, slices, trimmed
from bytegrain.llm.components import connected_components
from bytegrain.operators.ordering import with_rank
from bytegrain.session import Stage

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
TOKEN_BITS = 40  # of a shingle's 64-bit hash, as stored
SPARE = 3  # buckets beyond the least number, so that empty buckets needn't match
BITS = 1024  # of a bitmap
LEAF = 16  # sets of a leaf of the tree, and children of a node
PAGE = 512  # sets of a page, at most
KNOWN_WORDS = 1 << 19
BROADCAST_NODES = 2_000_000  # 16 bytes each


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the input changes about half of the output."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of `width` words in an array of word hashes."""
    count = len(words) - width + 1
    state = np.full(count, width, np.uint64)
    for i in range(width):
        state = mix(state + np.uint64(0x9E3779B97F4A7C15)) + words[i : i + count]
    return mix(state)


def shingle_set(words: np.ndarray, width: int) -> np.ndarray:
    """The sorted set of a text's shingles; the whole sequence if it has fewer words."""
    if len(words) == 0:
        return words
    return np.unique(shingle_hashes(words, min(width, len(words))))


def pack_tokens(tokens: np.ndarray) -> bytes:
    short = (tokens >> np.uint64(64 - TOKEN_BITS)).astype("<u8")
    return short.view(np.uint8).reshape(-1, 8)[:, : TOKEN_BITS // 8].tobytes()


def unpack_tokens(packed: bytes) -> np.ndarray:
    short = np.frombuffer(packed, np.uint8).reshape(-1, TOKEN_BITS // 8)
    wide = np.zeros((len(short), 8), np.uint8)
    wide[:, : TOKEN_BITS // 8] = short
    return wide.reshape(-1).view("<u8")


def set_table(docs: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """(_key, _n, _node, _tokens): size, identity and content of each text's shingle set.

    A task gives the content of a set once, so copies carry none.
    """

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen = WordHashes(), set()
        for batch in batches:
            for part in slices(batch, "_text"):
                if len(hashes) > KNOWN_WORDS:
                    hashes.clear()
                sizes, nodes, contents = [], [], []
                for text in part.column("_text").to_pylist():
                    words = WORD.findall((text or "").encode().lower())
                    flat = np.fromiter((hashes[word] for word in words), np.uint64, len(words))
                    tokens = shingle_set(flat, width)
                    sizes.append(len(tokens))
                    if len(tokens) == 0:
                        nodes.append(None)
                        contents.append(None)
                        continue
                    total = np.add.reduce(mix(tokens ^ np.uint64(0x5851F42D4C957F2D)))
                    node = int(mix(np.array([total + np.uint64(len(tokens))]))[0].view(np.int64))
                    nodes.append(node)
                    contents.append(None if node in seen else pack_tokens(tokens))
                    seen.add(node)
                columns = [
                    part.column("_key"),
                    pa.array(sizes, pa.int64()),
                    pa.array(nodes, pa.int64()),
                    pa.array(contents, pa.binary()),
                ]
                yield pa.record_batch(columns, ["_key", "_n", "_node", "_tokens"])

    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    return rows.mapInArrow(trimmed(sets), f"_key {ddl(docs, key)}, _n bigint, _node bigint, _tokens binary")


def band(n: int, percent: int) -> int:
    """Sizes of linked sets lie in one band or in two that follow each other."""
    return int(math.log(n) / math.log(100 / (percent - 0.01)))


def bucket_count(of_band: int, percent: int) -> tuple[int, int]:
    """Buckets of a band, and how many of them may be empty in a set without being matched.

    Linked sets of the band and the one before differ in at most d tokens, so of d + 1 + e
    buckets at least e + 1 hold the same tokens in both.
    """
    upper = (100 / (percent - 0.01)) ** (of_band + 1)
    differ = int((100 - percent) * 2 * upper / (100 + percent))
    spare = min(SPARE, (differ + 1) // 8)
    return differ + 1 + spare, spare


def signatures(tokens: np.ndarray, n: int, percent: int) -> np.ndarray:
    """Hashes of the buckets of a set in its band and the next; linked sets share one."""
    found = []
    mixed = mix(tokens)
    for of_band in (band(n, percent), band(n, percent) + 1):
        buckets, spare = bucket_count(of_band, percent)
        if buckets == 1:
            continue  # only equal sets are linked
        edges = (np.arange(buckets, dtype=np.uint64) << np.uint64(TOKEN_BITS)) // np.uint64(buckets)
        starts = np.searchsorted(tokens, edges)
        filled = np.diff(np.append(starts, len(tokens))) > 0
        sums = np.zeros(buckets, np.uint64)
        sums[filled] = np.add.reduceat(mixed, starts[filled])
        place = np.arange(buckets, dtype=np.uint64) + np.uint64(of_band << 32)
        values = mix(sums + mix(place))
        found.append(values[filled] if (~filled).sum() <= spare else values)
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


def signature_rows(sets: DataFrame, percent: int) -> DataFrame:
    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_tokens"):
                nodes, values = [], [np.zeros(0, np.uint64)]
                for n, node, packed in zip(
                    *(part.column(c).to_pylist() for c in ("_n", "_node", "_tokens"))
                ):
                    found = signatures(unpack_tokens(packed), n, percent)
                    values.append(found)
                    nodes.append(np.full(len(found), node, np.int64))
                flat = np.concatenate(values).view(np.int64)
                owner = np.concatenate([np.zeros(0, np.int64), *nodes])
                yield pa.record_batch([pa.array(flat), pa.array(owner)], ["sig", "node"])

    held = sets.where("_tokens IS NOT NULL").select("_n", "_node", "_tokens")
    return held.mapInArrow(explode, "sig bigint, node bigint")


def candidate_clusters(sets: DataFrame, percent: int) -> DataFrame:
    """(node, label): sets that share signatures, directly or through others.

    All links lie within clusters. A shared signature makes edges to its least set only.
    """
    rows = signature_rows(sets, percent).repartition("sig")
    hub = F.expr("first(node) OVER (PARTITION BY sig ORDER BY node)")
    edges = rows.select("node", hub.alias("hub")).where("node <> hub")
    return connected_components(edges.select(F.col("hub").alias("a"), F.col("node").alias("b")))


class Sets:
    """Sets of a page or of two, with bitmaps, and which of them are known to be connected."""

    def __init__(self, table: pa.Table):
        column = {c: table.column(c).to_pylist() for c in table.column_names}
        order = sorted(
            range(table.num_rows), key=lambda i: (column["cluster"][i], column["n"][i], column["node"][i])
        )
        self.clusters = [column["cluster"][i] for i in order]
        self.nodes = [column["node"][i] for i in order]
        self.sizes = np.array([column["n"][i] for i in order], np.int64)
        self.tokens = [unpack_tokens(column["tokens"][i]) for i in order]
        self.pages = np.array([column["page"][i] for i in order], np.int64)
        self.bits = np.zeros((len(order), BITS // 64), np.uint64)
        for i, tokens in enumerate(self.tokens):
            flags = np.zeros(BITS, np.uint8)
            flags[(tokens % np.uint64(BITS)).astype(np.int64)] = 1
            self.bits[i] = np.packbits(flags).view(np.uint64)
        self.parent: dict[int, int] = {}
        for i, start in enumerate(order):
            self.join(self.nodes[i], column["comp"][start])

    def root(self, node: int) -> int:
        parent = self.parent
        while parent.setdefault(node, node) != node:
            parent[node] = node = parent[parent[node]]
        return node

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        self.parent[max(a, b)] = min(a, b)
        return a != b


class TreeNode:
    """A run of sets: the OR of their bitmaps, the bits that all have, and the size range."""

    def __init__(self, sets: Sets, start: int, stop: int, children: list[TreeNode]):
        self.start, self.stop, self.children = start, stop, children
        self.any = np.bitwise_or.reduce(sets.bits[start:stop])
        self.all = np.bitwise_and.reduce(sets.bits[start:stop])
        self.low, self.high = int(sets.sizes[start:stop].min()), int(sets.sizes[start:stop].max())

    def uniform(self, sets: Sets) -> int | None:
        roots = {sets.root(node) for node in sets.nodes[self.start : self.stop]}
        return roots.pop() if len(roots) == 1 else None


def build_tree(sets: Sets, start: int, stop: int) -> TreeNode:
    level = [
        TreeNode(sets, at, min(at + LEAF, stop), []) for at in range(start, stop, LEAF)
    ]
    while len(level) > 1:
        level = [
            TreeNode(sets, part[0].start, part[-1].stop, part)
            for part in (level[i : i + LEAF] for i in range(0, len(level), LEAF))
        ]
    return level[0]


def possible(a: TreeNode, b: TreeNode, percent: int) -> bool:
    """Whether the largest overlap of a set of `a` with one of `b` could link them."""
    missing_a = int(np.bitwise_count(a.all & ~b.any).sum())
    missing_b = int(np.bitwise_count(b.all & ~a.any).sum())
    most = min(a.high - missing_a, b.high - missing_b)
    return (100 + percent) * most >= percent * (a.low + b.low)


def link(sets: Sets, percent: int, across: bool) -> list[tuple[int, int]]:
    """Links that connect what isn't connected yet, by dual traversal of each cluster's tree.

    With `across` only sets of different pages are compared.
    """
    edges: list[tuple[int, int]] = []
    start = 0
    while start < len(sets.nodes):
        stop = start + 1
        while stop < len(sets.nodes) and sets.clusters[stop] == sets.clusters[start]:
            stop += 1
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
                edges += link_leaves(sets, a, b, percent, across)
        start = stop
    return edges


def link_leaves(sets: Sets, a: TreeNode, b: TreeNode, percent: int, across: bool):
    left, right = np.arange(a.start, a.stop), np.arange(b.start, b.stop)
    common = np.bitwise_count(sets.bits[left][:, None] & sets.bits[right][None]).sum(2, dtype=np.int64)
    own = np.bitwise_count(sets.bits).sum(1, dtype=np.int64)
    most = np.minimum(
        (sets.sizes - own)[left][:, None] + common, (sets.sizes - own)[right][None] + common
    )
    total = sets.sizes[left][:, None] + sets.sizes[right][None]
    maybe = ((100 + percent) * most >= percent * total) & (left[:, None] < right[None])
    if across:
        maybe &= sets.pages[left][:, None] != sets.pages[right][None]
    edges = []
    for i, j in np.argwhere(maybe).tolist():
        x, y = int(left[i]), int(right[j])
        if sets.root(sets.nodes[x]) == sets.root(sets.nodes[y]):
            continue
        overlap = len(np.intersect1d(sets.tokens[x], sets.tokens[y], assume_unique=True))
        if (100 + percent) * overlap >= percent * int(sets.sizes[x] + sets.sizes[y]):
            sets.join(sets.nodes[x], sets.nodes[y])
            edges.append((sets.nodes[x], sets.nodes[y]))
    return edges


def links_of(groups: DataFrame, by: str, percent: int, across: bool) -> DataFrame:
    def find(table: pa.Table) -> pa.Table:
        found = link(Sets(table), percent, across)
        return pa.table(
            {
                "a": pa.array([a for a, _ in found], pa.int64()),
                "b": pa.array([b for _, b in found], pa.int64()),
            }
        )

    columns = (by, "page", "cluster", "node", "n", "tokens", "comp")
    kept = [c for i, c in enumerate(columns) if c not in columns[:i]]
    return groups.select(*kept).groupBy(by).applyInArrow(find, "a bigint, b bigint")


def page_pairs(pages: DataFrame, percent: int) -> DataFrame:
    """(left, right): pages of one cluster that may still hold an unconnected link.

    Dual traversal above pages: a node covers 16 of the level below. A pair of nodes goes on
    unless their sizes are too far apart or both lie wholly in one component.
    `pages`: (cluster, page, low, high, comp), comp null if the page has several.
    """
    levels = [pages.withColumnRenamed("page", "at")]
    while levels[-1].groupBy("cluster").count().where("count > 1").limit(1).count():
        comp = F.when(
            (F.count("*") == F.count("comp")) & (F.min("comp") == F.max("comp")), F.min("comp")
        )
        above = levels[-1].groupBy("cluster", F.shiftright("at", 4).alias("at"))
        levels.append(
            above.agg(F.min("low").alias("low"), F.max("high").alias("high"), comp.alias("comp"))
        )
    pairs = levels[-1].select("cluster", F.col("at").alias("left"), F.col("at").alias("right"))
    for nodes in reversed(levels[:-1]):
        up = F.shiftright("at", 4).alias("up")
        x = nodes.select("cluster", up, *[F.col(c).alias(f"x_{c}") for c in ("at", "low", "high", "comp")])
        y = nodes.select("cluster", up, *[F.col(c).alias(f"y_{c}") for c in ("at", "low", "high", "comp")])
        met = pairs.join(x.withColumnRenamed("up", "left"), ["cluster", "left"]).join(
            y.withColumnRenamed("up", "right"), ["cluster", "right"]
        )
        same = F.coalesce(F.col("x_comp") == F.col("y_comp"), F.lit(False))
        near = F.col("x_high") * 100 >= F.col("y_low") * percent  # sizes grow along pages
        pairs = met.where((F.col("x_at") <= F.col("y_at")) & near & ~same).select(
            "cluster", F.col("x_at").alias("left"), F.col("y_at").alias("right")
        )
    return pairs.where("left < right").select("left", "right").distinct()


def jaccard_components(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    width: int = 3,
    percent: int = 90,
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
    2. Tokens of a set are dealt to so many buckets that linked sets must agree in a filled one
       (pigeonhole on their largest difference). Sets that share a bucket's hash are clustered
       by edges to the least set, so a group of any size makes no pairs.
    3. Sets of clusters are ordered by cluster and size into pages. A page is searched
       by dual traversal of signature trees, then each page with the next, then all pairs of
       pages that the levels above pages can't rule out. Pairs of nodes that lie in one
       component already are skipped, which keeps large groups of near copies linear.
    """
    sets = Stage(set_table(docs, key, text, width), "sets").df
    clusters = Stage(candidate_clusters(sets, percent), "clusters").df
    small = clusters.count() <= BROADCAST_NODES
    named = clusters.select(F.col("node").alias("_node"), F.col("label").alias("cluster"))
    members = (
        sets.where("_tokens IS NOT NULL")
        .join(F.broadcast(named) if small else named, "_node")
        .groupBy(F.col("_node").alias("node"))
        .agg(F.first("cluster").alias("cluster"), F.first("_n").alias("n"), F.first("_tokens").alias("tokens"))
    )
    members = Stage(members, "members").df
    ranked = with_rank(members.select("cluster", "n", "node"), "cluster", "n", "node")
    paged = members.join(
        ranked.select("node", F.expr(f"rank div {page}").alias("page")), "node"
    )
    paged = Stage(paged, "pages").df
    alone = paged.withColumn("comp", F.col("node"))
    found = Stage(links_of(alone, "page", percent, False), "links-1").df

    found = _link_across(paged, found, percent, adjacent=True)
    found = _link_across(paged, found, percent, adjacent=False)

    labels = connected_components(found, "linked").select(
        F.col("node").alias("_linked"), F.col("label")
    )
    rows = sets.select("_key", "_n", "_node")
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


def _link_across(paged: DataFrame, found: DataFrame, percent: int, adjacent: bool) -> DataFrame:
    """Links between pages added to those found: of pages that follow each other, or of all
    pairs that may still matter."""
    spread = paged.groupBy("cluster").agg(F.min("page").alias("first"), F.max("page").alias("last"))
    spread = spread.where("first < last").select("cluster", "first", "last")
    if spread.isEmpty():
        return found
    labels = connected_components(found, "paged")
    narrow = paged.join(spread, "cluster").join(labels, "node", "left").withColumn("comp", F.coalesce("label", "node"))
    narrow = narrow.select("page", "cluster", "node", "n", "tokens", "comp")
    ends = F.when(F.min("comp") == F.max("comp"), F.min("comp")).alias("comp")
    nodes = narrow.groupBy("cluster", "page").agg(
        F.min("n").alias("low"), F.max("n").alias("high"), ends
    )
    pairs = page_pairs(nodes, percent)
    if adjacent:
        pairs = pairs.where(F.col("right") == F.col("left") + 1)
    pairs = Stage(pairs.withColumn("pair", F.monotonically_increasing_id()), "page-pairs").df
    if pairs.isEmpty():
        return found
    sides = pairs.select("pair", F.explode(F.array("left", "right")).alias("page"))
    more = links_of(narrow.join(sides, "page"), "pair", percent, True)
    return Stage(found.unionByName(more), "links").df
