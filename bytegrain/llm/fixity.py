"""Fixity audit of WARC records: Merkle trees over ordered offset ranges of two replicas.

Each replica's tree is built from its own offsets alone; only nodes are compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bytegrain.operators.ordering import with_rank
from bytegrain.session import Stage

FANOUT_BITS = 4
ARCHIVE_BITS = 12  # an archive holds 2^12 ids
RANGE_BITS = 16  # a lowest node holds 2^16 offsets
NOWHERE = -1  # archive and offset of entries whose place is null


def warc_record(record_id: Column, url: Column, payload: Column) -> Column:
    """The bytes of a WARC response record; null parts are empty."""
    body = F.coalesce(payload, F.lit(""))
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"),
        F.coalesce(record_id.cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Target-URI: "),
        F.coalesce(url, F.lit("")),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "),
        F.octet_length(body).cast("string"),
        F.lit("\r\n\r\n"),
        body,
        F.lit("\r\n\r\n"),
    )


def digests(records: DataFrame, key: str, record: str, *more: str) -> DataFrame:
    """(_key, _digest, _bytes, more...): records leave the scan as digests, null as empty."""
    whole = F.coalesce(F.col(record), F.lit(""))
    return records.select(
        F.col(key).alias("_key"),
        F.sha2(whole.cast("binary"), 256).alias("_digest"),
        F.octet_length(whole).cast("bigint").alias("_bytes"),
        *more,
    )


def combined(digest: str = "_digest") -> Column:
    """One digest of a group's digests in any order; sums are formed before the shuffle."""
    half = F.conv(F.substring(digest, 1, 15), 16, 10).cast("decimal(20,0)")
    many = F.concat_ws(":", F.count("*"), F.sum(half), F.min(digest), F.max(digest))
    return F.when(F.count("*") == 1, F.min(digest)).otherwise(F.sha2(many, 256))


def entries(hashed: DataFrame, *by: str) -> DataFrame:
    """(by..., _digest, _bytes): records of one id, or of one id and place, as one entry."""
    return hashed.groupBy(*by).agg(combined().alias("_digest"), F.sum("_bytes").alias("_bytes"))


def manifest(records: DataFrame, key: str = "page_id", record: str = "record") -> DataFrame:
    """Place the entries of records in the order of their ids, a null id first:
    (_key, _digest, _archive, _start, _stop)."""
    held = entries(digests(records, key, record), "_key")
    named = held.select(F.col("_key").isNotNull().alias("_named"), "_key", "_digest", "_bytes")
    before = (  # at most 2^12 rows each
        Window.partitionBy("_archive").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    )
    return (
        with_rank(named, "_named", "_key")
        .withColumn("_archive", F.shiftright("rank", ARCHIVE_BITS))
        .withColumn("_stop", F.sum("_bytes").over(before))
        .withColumn("_start", F.col("_stop") - F.col("_bytes"))
        .select("_key", "_digest", "_archive", "_start", "_stop")
    )


def inventory(hashed: DataFrame, archive: str = "archive", start: str = "start_offset") -> DataFrame:
    """What a replica holds where, as `manifest` gives it, from `digests` with two columns more."""
    placed = hashed.select(
        "_key",
        "_digest",
        "_bytes",
        F.coalesce(F.col(archive).cast("bigint"), F.lit(NOWHERE)).alias("_archive"),
        F.coalesce(F.col(start).cast("bigint"), F.lit(NOWHERE)).alias("_start"),
    )
    return entries(placed, "_key", "_archive", "_start").select(
        "_key", "_digest", "_archive", "_start", (F.col("_start") + F.col("_bytes")).alias("_stop")
    )


def _parent(height: int, depth: int) -> list[Column]:
    """The address of a node's parent of this height: of its archive, or of 16 archives."""
    if height <= depth:
        return [F.col("_archive"), F.shiftright("_node", FANOUT_BITS).alias("_node")]
    return [
        F.shiftright("_archive", FANOUT_BITS).alias("_archive"),
        F.lit(0).cast("bigint").alias("_node"),
    ]


def lowest(placed: DataFrame) -> list[Column]:
    return [F.col("_archive"), F.shiftright("_start", RANGE_BITS).alias("_node")]


def tree(placed: DataFrame, depth: int, above: int) -> list[DataFrame]:
    """The levels of a replica's tree, each (_archive, _node, _digest), from the lowest up.

    A lowest node hashes (start, stop, id, digest) of the entries that start in one range of
    offsets, with sums formed before the shuffle, so a range may hold any number; the others hash
    at most 16 children in order. `depth` levels lead to an archive's root, `above` more to the
    replica's. Levels are staged, so none is computed twice.
    """
    name = F.when(F.col("_key").isNull(), "-").otherwise(F.concat(F.lit("+"), F.col("_key").cast("string")))
    leaf = F.sha2(F.concat_ws(":", "_start", "_stop", "_digest", name), 256)
    level = placed.select(*lowest(placed), leaf.alias("_digest"))
    level = level.groupBy("_archive", "_node").agg(combined().alias("_digest"))
    levels = [Stage(level, "range-nodes").df]
    for height in range(1, depth + above + 1):
        children = F.array_sort(F.collect_list(F.struct("_a", "_n", "_digest")))
        named = levels[-1].select(
            *_parent(height, depth), F.col("_archive").alias("_a"), F.col("_node").alias("_n"), "_digest"
        )
        text = F.transform("_children", lambda c: F.concat_ws(":", c["_a"], c["_n"], c["_digest"]))
        parents = named.groupBy("_archive", "_node").agg(children.alias("_children"))
        parents = parents.select("_archive", "_node", F.sha2(F.array_join(text, ","), 256).alias("_digest"))
        levels.append(Stage(parents, "nodes").df)
    return levels


def mismatches(left: list[DataFrame], right: list[DataFrame], depth: int) -> DataFrame:
    """(_archive, _node) of the ranges that differ, found by descending from the roots.

    A level is read only below nodes that differ, and none below equal roots.
    """
    differ = None
    for height in range(len(left) - 1, -1, -1):
        sides = []
        for nodes in (left[height], right[height]):
            if differ is not None:
                up = _parent(height + 1, depth)
                below = nodes.withColumns({"_pa": up[0], "_pn": up[1]})
                theirs = differ.withColumnsRenamed({"_archive": "_da", "_node": "_dn"})
                met = (F.col("_pa") == F.col("_da")) & (F.col("_pn") == F.col("_dn"))
                nodes = below.join(theirs, met, "left_semi").drop("_pa", "_pn")
            sides.append(nodes)
        other = sides[1].withColumnRenamed("_digest", "_theirs")
        both = sides[0].join(other, ["_archive", "_node"], "full_outer")
        same = F.col("_digest").eqNullSafe(F.col("_theirs"))
        differ = Stage(both.where(~same).select("_archive", "_node"), "differ").df
        if differ.isEmpty():
            return differ
    return differ


def compare(placed: DataFrame, theirs: DataFrame, key: str = "page_id") -> DataFrame:
    """`audit` of a manifest and a replica's inventory."""
    ours, theirs = Stage(placed, "manifest").df, Stage(theirs, "inventory").df
    depth = above = 0
    for side in (ours, theirs):
        far = side.agg(F.max("_start").alias("start"), F.max("_archive").alias("archive")).first()
        start, archive = max(far.start or 0, 0), max(far.archive or 0, 0)
        while start >> RANGE_BITS >> FANOUT_BITS * depth:
            depth += 1
        while archive >> FANOUT_BITS * above:
            above += 1
    found = mismatches(tree(ours, depth, above), tree(theirs, depth, above), depth)
    ranges = found.withColumnsRenamed({"_archive": "_da", "_node": "_dn"})

    def suspects(side: DataFrame) -> DataFrame:
        archive, node = lowest(side)
        return side.join(ranges, (archive == F.col("_da")) & (node == F.col("_dn")), "left_semi")

    held = suspects(theirs).withColumnsRenamed(
        {"_key": "_k", "_digest": "_d", "_archive": "_a", "_start": "_s", "_stop": "_e"}
    )
    there = (F.col("_archive") == F.col("_a")) & (F.col("_start") == F.col("_s"))
    equal = F.col("_digest") == F.col("_d")
    answer = F.when(F.col("_a").isNotNull(), F.struct(~(there & equal), ~equal, "_a", "_s"))
    judged = (
        suspects(ours)
        .join(held, F.col("_key").eqNullSafe(F.col("_k")), "left")
        .select("_key", answer.alias("_best"))
        .groupBy("_key")
        .agg(F.min("_best").alias("_best"))
        .select("_key", F.col("_best.col1").alias("_away"), F.col("_best.col2").alias("_other"),
                F.col("_best._a").alias("_ba"), F.col("_best._s").alias("_bs"))
    )
    judged = Stage(judged, "judged").df
    status = (
        F.when(F.col("_away").isNull(), "missing")
        .when(F.col("_other"), "changed")
        .when(F.col("_away"), "moved")
        .otherwise("intact")
    )
    verdicts = judged.select(F.col("_key").alias("_k"), status.alias("_status")).where("_status <> 'intact'")
    ours = ours.join(verdicts, F.col("_key").eqNullSafe(F.col("_k")), "left").drop("_k")
    answers = judged.where("_away IS NOT NULL").select(F.col("_key").alias("_bk"), "_ba", "_bs")
    used = F.col("_k").eqNullSafe(F.col("_bk")) & (F.col("_a") == F.col("_ba")) & (F.col("_s") == F.col("_bs"))
    extra = held.join(answers, used, "left_anti").select(
        F.col("_k").alias("_key"), F.col("_d").alias("_digest"), F.col("_a").alias("_archive"),
        F.col("_s").alias("_start"), F.col("_e").alias("_stop"), F.lit("extra").alias("_status"),
    )
    return ours.withColumn("_status", F.coalesce("_status", F.lit("intact"))).unionByName(extra).select(
        F.col("_key").alias(key),
        F.col("_archive").alias("archive"),
        F.col("_start").alias("start_offset"),
        F.col("_stop").alias("stop_offset"),
        F.col("_digest").alias("sha256"),
        F.col("_status").alias("status"),
    )


def audit(
    records: DataFrame, replica: DataFrame, key: str = "page_id", record: str = "record"
) -> DataFrame:
    """Compare a replica with the records it should hold.

    `records` has (key, record): they belong into archives of 4,096 ids in the order of ids, a
    null id first, repeated ids as one entry. `replica` has (key, record, archive, start_offset):
    where it holds them; rows of one id and place are one entry. Returns (key, archive,
    start_offset, stop_offset, sha256, status): a row for each id of `records`, 'intact',
    'changed', 'missing' or 'moved' (the same bytes elsewhere), and a row with the replica's place
    and digest for each of its entries that answers no id, 'extra'. An id is answered by the entry
    in its place if that is equal, else the first equal one, else the first of its id. A null
    record is an empty one, a null place lies before all others (-1). Other columns are not read;
    without records all entries are extra, without a replica all ids are missing.
    """
    theirs = digests(replica, key, record, "archive", "start_offset")
    return compare(manifest(records, key, record), inventory(theirs), key)
