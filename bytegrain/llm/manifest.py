"""Merkle manifest of a dataset: proofs of all rows by pointer jumping.

Nodes are named (tree, level, at). Tree t >= 0 belongs to the t-th group, its level 0 are the
group's rows; tree TOP stands over the groups, and its level 0 are their subroots. A link leads
from a node to its parent and holds the digests left and right of it; a path is a link, or
several put together, and holds one (left, right) for each step.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bytegrain.operators.ordering import with_rank
from bytegrain.session import Stage

FANOUT = 3
TOP = -1
STEP = "array<struct<left:binary,right:binary>>"
BROADCAST_GROUPS = 200_000  # rows of about 50 bytes
BROADCAST_BYTES = 1 << 24
SALTS = 32


def field(value: Column) -> Column:
    """`-` for null, else the length in bytes, a colon, and the value as text."""
    text = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(
        F.concat(F.octet_length(text).cast("string"), F.lit(":"), text)
    )


def leaf(*values: Column) -> Column:
    """The digest of a row's fields, 32 bytes."""
    return F.unhex(F.sha2(F.concat(*map(field, values)), 256))


def named(tree: Column, level: Column, at: Column) -> Column:
    return F.struct(tree.alias("tree"), level.alias("level"), at.alias("at"))


def node_digest(parts: Column) -> Column:
    """The digest of digests put one after another as hex text."""
    return F.unhex(F.sha2(F.lower(F.hex(parts)), 256))


def joined(digests: Column) -> Column:
    """An array of digests as one byte string."""
    return F.aggregate(digests, F.lit(b""), lambda acc, d: F.concat(acc, d))


def climb(nodes: DataFrame, depth: int, name: str) -> tuple[list[DataFrame], DataFrame]:
    """Runs of each level, lowest first, and the remaining node of each tree: (tree, digest).

    `nodes`: (tree, at, size, digest, row), the level 0 of trees of `size` nodes; trees of one
    node are left as they are. A run is up to FANOUT nodes in a row with their parent's digest;
    each level is a staged table, so none is computed twice and no group exceeds a run.
    """
    levels, roots = [], []
    for level in range(depth):
        roots.append(nodes.where("size = 1").select("tree", "digest"))
        inner = "row" if level == 0 else "CAST(NULL AS INT) AS row"
        runs = (
            nodes.where("size > 1")
            .selectExpr("tree", f"at div {FANOUT} AS up", "size", "at", "digest", inner)
            .groupBy("tree", "up")
            .agg(
                F.first("size").alias("size"),
                F.array_sort(F.collect_list(F.struct("at", "digest", "row"))).alias("run"),
            )
            .withColumn("size", F.expr(f"(size + {FANOUT - 1}) div {FANOUT}"))
            .withColumn("digest", node_digest(joined(F.col("run.digest"))))
        )
        runs = Stage(runs, f"{name}-{level}").df
        levels.append(runs.withColumn("level", F.lit(level)))
        nodes = runs.select("tree", F.col("up").alias("at"), "size", "digest")
    roots.append(nodes.where("size = 1").select("tree", "digest"))
    return levels, reduce(DataFrame.union, roots)


def links(runs: DataFrame) -> DataFrame:
    """(node, up, path, subroot, digest, row): a link for each node of a level's runs.

    The last node of a group's tree is a node of the top tree; a link to it holds its digest
    as `subroot`.
    """
    placed = runs.select(
        "tree", "level", "up", "size", F.col("digest").alias("above"), "run", F.posexplode("run").alias("k", "x")
    )
    ends = (F.col("size") == 1) & (F.col("tree") != TOP)
    left = F.slice("run.digest", F.lit(1), F.col("k"))
    right = F.slice("run.digest", F.col("k") + 2, F.lit(FANOUT))
    return placed.select(
        named(F.col("tree"), F.col("level"), F.col("x.at")).alias("node"),
        F.when(ends, named(F.lit(TOP).cast("bigint"), F.lit(0), F.col("tree")))
        .otherwise(named(F.col("tree"), F.col("level") + 1, F.col("up")))
        .alias("up"),
        F.array(F.struct(joined(left).alias("left"), joined(right).alias("right"))).alias("path"),
        F.when(ends, F.col("above")).alias("subroot"),
        F.col("x.digest").alias("digest"),
        F.col("x.row").alias("row"),
    )


def extend(paths: DataFrame, onward: DataFrame, rows: int, steps: int) -> DataFrame:
    """Paths with the paths that begin where they end put behind them; others as they are.

    `onward` has about `rows` rows of `steps` steps. It is broadcast when that is little: near
    the roots few nodes are the ends of very many paths. Larger ones share few ends.
    """
    further = onward.select(
        F.col("node").alias("_at"),
        F.col("up").alias("_up"),
        F.col("path").alias("_path"),
        F.col("subroot").alias("_subroot"),
    )
    small = rows * (120 + steps * 32 * FANOUT) <= BROADCAST_BYTES
    met = paths.join(
        F.broadcast(further) if small else further, F.col("up") == F.col("_at"), "left"
    )
    return met.select(
        *[c for c in paths.columns if c not in ("up", "path", "subroot")],
        F.coalesce("_up", "up").alias("up"),
        F.when(F.col("_path").isNull(), F.col("path")).otherwise(F.concat("path", "_path")).alias("path"),
        F.coalesce("subroot", "_subroot").alias("subroot"),
    )


def jump(inner: DataFrame, top: tuple[int, int]) -> DataFrame:
    """Paths of all inner nodes to the root `top`, its (level, at), by doubling.

    After round r a path holds 2^r steps or ends at the root. A path that has 2^r steps ends at
    level 2^r + 1 or above, or in the top tree, so only the paths from there on are its
    continuations: each round joins with a smaller part of the table.
    """
    root = named(F.lit(TOP).cast("bigint"), F.lit(top[0]), F.lit(top[1]).cast("bigint"))
    paths, steps = Stage(inner, "paths-1"), 1
    while not paths.df.where(F.col("up") != root).isEmpty():
        high = (F.col("node.tree") == TOP) | (F.col("node.level") >= steps + 1)
        onward = paths.df.where(high)
        longer = Stage(extend(paths.df, onward, onward.count(), steps), f"paths-{2 * steps}")
        paths.drop()
        paths, steps = longer, 2 * steps
    return paths.df


def height(size: int) -> int:
    """Levels above `size` nodes until one is left."""
    levels = 0
    while size > 1:
        size, levels = -(-size // FANOUT), levels + 1
    return levels


def fold(start: Column, path: Column) -> Column:
    """The digest that a path leads to from a digest."""
    return F.aggregate(
        path, start, lambda acc, s: node_digest(F.concat(s["left"], acc, s["right"]))
    )


def group_rows(leaves: DataFrame) -> DataFrame:
    """Number groups and place rows: (tree, at, size, digest, row) and more.

    `leaves`: (group, key, digest, row). One range shuffle orders all rows by group, key and
    digest; a group's rows are a range of ranks, so a hot group is spread over tasks.
    """
    ranked = with_rank(leaves, "group", "key", "digest")
    groups = ranked.groupBy("group").agg(F.min("rank").alias("_first"), F.count("*").alias("size"))
    groups = Stage(
        with_rank(groups, "group").withColumnRenamed("rank", "tree").withColumnRenamed("group", "_group"),
        "groups",
    ).df
    same = F.col("group").eqNullSafe(F.col("_group"))
    if groups.count() <= BROADCAST_GROUPS:
        placed = ranked.join(F.broadcast(groups), same)
    else:
        salted = groups.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        placed = ranked.withColumn("_of", F.pmod("rank", F.lit(SALTS)).cast("int")).join(
            salted, same & (F.col("_of") == F.col("_salt"))
        )
    return placed.select(
        "tree", (F.col("rank") - F.col("_first")).alias("at"), "size", "digest", "row"
    )


def dataset_proofs(
    rows: DataFrame, fields: list[str], key: str = "doc_id", group: str = "source", changed: Column | None = None
) -> DataFrame:
    """Leaf, subroot, root and proof of every row: (key, leaf, subroot, root, path, changed).

    A leaf hashes the row's `fields` in their order. In each group rows ascend by key, a null
    key first, equal keys by leaf; every FANOUT consecutive nodes become one, a last run of fewer
    too, until one is left, the subroot (of a single row its leaf). Subroots in the order of
    their groups, a null group first, become the root likewise. Digests are 32 bytes, and
    hashed as hex text. `path` holds the siblings of each step. Repeated rows are leaves of
    their own. `changed` is a digest that is carried along, null if none is given. An empty
    table gives no rows. Other columns are not read.

    1. Rows leave the scan as digests and are ranked by one range shuffle.
    2. Levels are built from below, each from a staged table, until every tree has one node.
    3. Pointer jumping: inner nodes (half as many as rows) start with the link to their parent;
       self-joins double the distance to the ancestor until all paths end at the root.
    4. Rows take the path of their parent behind their own link.
    """
    fresh = F.lit(None).cast("binary") if changed is None else changed
    leaves = rows.select(
        F.col(group).alias("group"),
        F.col(key).alias("key"),
        leaf(*[F.col(f"`{c}`") for c in fields]).alias("digest"),
        fresh.alias("changed"),
    ).select("group", "key", "digest", F.struct("key", "changed").alias("row"))
    placed = Stage(group_rows(leaves), "placed").df
    top = placed.agg(F.max("size").alias("n"), F.max("tree").alias("tree")).first()
    depth = height(top.n or 0)
    levels, subroots = climb(placed, depth, "runs")
    trees = 0 if top.tree is None else top.tree + 1
    ends = subroots.select(
        F.lit(TOP).cast("bigint").alias("tree"),
        F.col("tree").alias("at"),
        F.lit(trees).cast("bigint").alias("size"),
        "digest",
        F.lit(None).cast("int").alias("row"),
    )
    above, roots = climb(ends, height(trees), "top")
    root = roots.first()
    single = placed.where("size = 1").select(
        named(F.lit(TOP).cast("bigint"), F.lit(0), F.col("tree")).alias("up"),
        F.array().cast(STEP).alias("path"),
        F.col("digest").alias("subroot"),
        "digest",
        "row",
    )
    lowest = [links(runs).drop("node") for runs in levels[:1]]
    wanted = ["up", "path", "subroot", "digest", "row"]
    starts = reduce(DataFrame.union, [part.select(*wanted) for part in [*lowest, single]])
    higher = [links(runs).select("node", "up", "path", "subroot") for runs in [*levels[1:], *above]]
    if higher:
        inner = jump(reduce(DataFrame.union, higher), (height(trees), 0))
        starts = extend(starts, inner, inner.count(), depth + height(trees))
    return starts.select(
        F.col("row.key").alias(key),
        F.col("digest").alias("leaf"),
        "subroot",
        F.lit(None if root is None else bytes(root.digest)).cast("binary").alias("root"),
        "path",
        F.col("row.changed").alias("changed"),
    )


def proof(path: Column) -> Column:
    """The siblings of a path as one byte string, level by level, left to right."""
    return joined(F.transform(path, lambda s: F.concat(s["left"], s["right"])))


def audit_rows(
    rows: DataFrame,
    fields: list[str],
    instead: dict[str, Column],
    where: Column,
    key: str = "doc_id",
    group: str = "source",
) -> DataFrame:
    """Whether rows whose fields were replaced still fold to the root of the manifest.

    The manifest is made of `rows` as they are; then, `where` true (not null), `instead` gives
    other values of fields. Returns (key, leaf, subroot, root, proof_sha256, folded_root,
    verified), one row for each row, digests as hex text; see `dataset_proofs`.
    """
    found = dataset_proofs(
        rows, fields, key, group, F.when(where, leaf(*[instead.get(c, F.col(f"`{c}`")) for c in fields]))
    )
    text = lambda c: F.lower(F.hex(c))
    return found.select(
        key,
        text(F.col("leaf")).alias("leaf"),
        text(F.col("subroot")).alias("subroot"),
        text(F.col("root")).alias("root"),
        F.sha2(text(proof(F.col("path"))), 256).alias("proof_sha256"),
        text(fold(F.coalesce("changed", "leaf"), F.col("path"))).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
