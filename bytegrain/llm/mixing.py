"""Mixing sources to target weights by hash thresholds, without sorting documents."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bytegrain.operators.ordering import with_rank
from bytegrain.session import Stage

LEVELS = 3
LEVEL_BITS = 12
HASH_BITS = LEVELS * LEVEL_BITS
BROADCAST_SOURCES = 100_000  # rows of a table by source that may be broadcast
SALTS = 32

WORDS = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("bigint")


def draw(key: Column, seed: str) -> Column:
    """A number below 2^HASH_BITS drawn by key and seed; equal keys draw alike."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("bigint")


def by_source(docs: DataFrame, sources: DataFrame, count: int) -> DataFrame:
    """Join rows with a table by source, null sources included.

    Up to BROADCAST_SOURCES rows the table is broadcast, so a hot source moves nothing.
    Beyond that both sides are salted.
    """
    other = sources.withColumnRenamed("_source", "_other")
    match = F.col("_source").eqNullSafe(F.col("_other"))
    if count <= BROADCAST_SOURCES:
        return docs.join(F.broadcast(other), match).drop("_other")
    salted = other.withColumn("_salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
    rows = docs.withColumn("_row_salt", F.pmod(F.col("_draw"), F.lit(SALTS)).cast("int"))
    return rows.join(salted, match & (F.col("_salt") == F.col("_row_salt"))).drop(
        "_other", "_salt", "_row_salt"
    )


def share_targets(sources: DataFrame, budget: int | None, most: int) -> DataFrame:
    """Add `_target` to (_source, _size, _weight): the budget shared by weight, where a target
    stops at `most` times its source's size and the excess is shared again by weight.

    The fixed point is reached by raising one level for all sources; a round is one
    aggregation over the sources, of which one row comes back.
    """
    cap, weight = F.col("_size") * most, F.col("_weight")
    total = budget
    if total is None:
        total = sources.agg(F.coalesce(F.sum("_size"), F.lit(0)).alias("n")).first().n
    stopped, free, full = 0, None, -1
    while True:
        capped = F.lit(False)
        if free is not None:
            capped = weight * ((total - stopped) / free) >= cap
        row = sources.agg(
            F.coalesce(F.sum(F.when(capped, cap)), F.lit(0)).alias("stopped"),
            F.sum(F.when(~capped, weight)).alias("free"),
            F.coalesce(F.sum(capped.cast("int")), F.lit(0)).alias("full"),
        ).first()
        if row.full == full or not row.free:
            break
        stopped, free, full = row.stopped, row.free, row.full
    if not row.free:
        return sources.withColumn("_target", cap.cast("double"))
    level = (total - stopped) / free
    return sources.withColumn("_target", F.least(weight * F.lit(level), cap.cast("double")))


def boundary(rows: DataFrame, targets: DataFrame, count: int, level: int) -> DataFrame:
    """By source, the bucket of this level in which the running size reaches `_rest`.

    `rows` are those of the boundary bucket of the level before. (_source, _prefix, _before,
    _after): sizes before the bucket and with it. At most 2^LEVEL_BITS sums for a source.
    """
    shift = HASH_BITS - LEVEL_BITS * (level + 1)
    sums = rows.groupBy("_source", F.shiftright("_draw", shift).alias("_prefix")).agg(
        F.sum("_size").alias("_sum")
    )
    order = Window.partitionBy("_source").orderBy("_prefix")
    start = targets.select("_source", "_rest", "_base")
    running = by_source(sums.withColumn("_draw", F.col("_prefix")), start, count).select(
        "_source",
        "_prefix",
        "_rest",
        (F.col("_base") + F.sum("_sum").over(order) - F.col("_sum")).alias("_before"),
        (F.col("_base") + F.sum("_sum").over(order)).alias("_after"),
    )
    return running.where("_before < _rest AND _after >= _rest").drop("_rest")


@dataclass(frozen=True)
class Mix:
    """What a mix takes, by source: (_source, source_size, target, _whole, _threshold)."""

    rows: DataFrame  # (_key, _source, _size, _draw) of all documents
    decided: DataFrame
    count: int
    seed: str

    def copies(self, rows: DataFrame) -> DataFrame:
        """Add source_size, target and copies to rows with _source and _draw."""
        times = F.col("_whole") + (F.col("_draw") < F.col("_threshold")).cast("bigint")
        met = by_source(rows, self.decided, self.count)
        return met.withColumn("copies", times).drop("_whole", "_threshold")

    def documents(self, docs: DataFrame, key: str = "doc_id", source: str = "source") -> DataFrame:
        """The documents of the mix, each as often as it is taken, with their own columns."""
        whole = docs.select(
            F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_all"),
            F.col(source).alias("_source"),
            draw(F.col(key), self.seed).alias("_draw"),
        )
        taken = self.copies(whole).where("copies > 0")
        each = taken.select("_all", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
        return each.select("_all.*")


def plan_mix(
    docs: DataFrame,
    weights: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    budget: int | None = None,
    most: int = 3,
    seed: str = "mix",
) -> Mix:
    """Find whole copies and the threshold of draws for each source.

    `weights` has (source, weight) once for each source, null as a source of its own; `budget`
    counts words, by default those of all documents.

    A source that is short of its target is taken whole as often as fits; the rest comes from
    documents whose draw by key lies below a threshold of the source. Thresholds come from
    sums of sizes by source and bucket of draws: the bucket in which the sum reaches the rest
    is refined twice, each time over its own documents only, to 36 bits. The last bucket is
    taken if that comes nearer to the target. Draws depend on key and seed alone, so reruns
    agree, and a larger budget takes what a smaller one took.
    """
    rows = Stage(
        docs.select(
            F.col(key).alias("_key"),
            F.col(source).alias("_source"),
            word_count(F.col(text)).alias("_size"),
            draw(F.col(key), seed).alias("_draw"),
        ),
        "sizes",
    ).df
    named = weights.select(F.col(source).alias("_other"), F.col("weight").alias("_weight"))
    sources = Stage(
        rows.groupBy("_source")
        .agg(F.sum("_size").alias("_size"))
        .join(named, F.col("_source").eqNullSafe(F.col("_other")))
        .drop("_other"),
        "sources",
    ).df
    count = sources.count()
    copies = F.floor(F.col("_target") / F.col("_size"))
    whole = F.when(F.col("_size") > 0, F.least(copies, F.lit(most))).otherwise(0)
    targets = (
        share_targets(sources, budget, most)
        .withColumn("_whole", whole.cast("bigint"))
        .withColumn("_rest", F.col("_target") - F.col("_whole") * F.col("_size"))
    )
    found = targets.select("_source", "_rest", F.lit(0).cast("bigint").alias("_base"))
    inside = rows
    for level in range(LEVELS):
        edge = boundary(inside, found, count, level)
        found = Stage(
            edge.join(
                targets.select(F.col("_source").alias("_other"), "_rest"),
                F.col("_source").eqNullSafe(F.col("_other")),
            ).select(
                "_source", "_rest", F.col("_before").alias("_base"), "_prefix", "_before", "_after"
            ),
            f"boundary-{level}",
        ).df
        if level + 1 < LEVELS:
            shift = HASH_BITS - LEVEL_BITS * (level + 1)
            inside = (
                by_source(rows, found.select("_source", F.col("_prefix").alias("_edge")), count)
                .where(F.shiftright("_draw", shift) == F.col("_edge"))
                .drop("_edge")
            )
    nearer = F.col("_after") - F.col("_rest") <= F.col("_rest") - F.col("_before")
    thresholds = found.select(
        F.col("_source").alias("_other"),
        (F.col("_prefix") + nearer.cast("int")).alias("_threshold"),
    )
    decided = targets.join(
        thresholds, F.col("_source").eqNullSafe(F.col("_other")), "left"
    ).select(
        "_source",
        F.col("_size").alias("source_size"),
        F.col("_target").alias("target"),
        "_whole",
        F.coalesce("_threshold", F.lit(0)).alias("_threshold"),
    )
    return Mix(rows, Stage(decided, "thresholds").df, count, seed)


def mix(docs: DataFrame, weights: DataFrame, key: str = "doc_id", source: str = "source", **options) -> DataFrame:
    """How often the mix takes each document; options are those of plan_mix.

    Returns (key, source, size, source_size, target, copies, taken), one row for each row:
    every document is taken `copies` times, `taken` words in all. Equal keys are taken alike.
    Null and empty texts have size 0; a source of size 0 has the target 0. Sources without a
    weight are left out; an empty table gives no rows. Other columns are not read.
    """
    planned = plan_mix(docs, weights, key=key, source=source, **options)
    return planned.copies(planned.rows).select(
        F.col("_key").alias(key),
        F.col("_source").alias(source),
        F.col("_size").alias("size"),
        "source_size",
        "target",
        "copies",
        (F.col("copies") * F.col("_size")).alias("taken"),
    )


def cyclic_weights(docs: DataFrame, cycle: tuple[int, ...], source: str = "source") -> DataFrame:
    """(source, weight) with weights that repeat along the sources by code point, null last."""
    sources = docs.select(F.col(source).isNull().alias("_null"), source).distinct()
    listed = F.array(*map(F.lit, cycle))
    place = F.pmod(F.col("rank"), F.lit(len(cycle))).cast("int")
    return with_rank(sources, "_null", source).select(source, F.get(listed, place).alias("weight"))
