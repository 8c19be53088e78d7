"""Stupid-backoff scores of documents from n-gram counts of all other documents."""

from __future__ import annotations

import re
import uuid

import numpy as np
import pyarrow as pa
import xxhash

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from bytegrain.llm.arrow import ddl, pack, unpack
from bytegrain.session import shared_root

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
BLOCK_BYTES = 1 << 25  # text of a block of documents, on average
FAN = 2048  # blocks that meet each hash range on their own; more of them meet in teams
BACKOFF = 0.4
GRAMS = "_block int, bucket int, grams binary"
TOTALS = "_block int, bucket int, words bigint, totals binary"


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Hashes(dict):
    """Hashes of words, each computed once."""

    def __missing__(self, word: bytes) -> int:
        self[word] = found = xxhash.xxh3_64_intdigest(word)
        return found


class Grams:
    """The n-grams of a block of documents up to an order, as hashes.

    `ids[m]` numbers the n-gram of m words that ends at each word; those that would begin
    before their document have no meaning and are masked by `place`, a word's place in it.
    """

    def __init__(self, texts: list, order: int):
        hashes = Hashes()
        counts, flat = [], []
        for text in texts:
            words = WORD.findall((text.as_py() or "").encode())
            counts.append(len(words))
            flat.append(np.array([hashes[word] for word in words], np.uint64))
        self.counts = np.array(counts, np.int64)
        words = np.concatenate([np.zeros(0, np.uint64), *flat])
        total = len(words)
        self.document = np.repeat(np.arange(len(counts)), self.counts)
        self.place = np.arange(total) - (np.cumsum(self.counts) - self.counts)[self.document]
        self.unique: dict[int, np.ndarray] = {}
        self.ids: dict[int, np.ndarray] = {}
        self.often: dict[int, np.ndarray] = {}
        state = np.zeros(total, np.uint64)
        for m in range(1, order + 1):
            before = np.zeros(total, np.uint64)
            before[1:] = state[:-1]
            state = mix(before * np.uint64(0x9E3779B97F4A7C15) + words + np.uint64(m))
            held = self.place >= m - 1
            unique, inverse, often = np.unique(state[held], return_inverse=True, return_counts=True)
            ids = np.zeros(total, np.int64)
            ids[held] = inverse
            self.unique[m], self.ids[m], self.often[m] = unique, ids, often

    def own(self, m: int) -> np.ndarray:
        """How often the n-gram at each word occurs in the word's own document."""
        held = np.flatnonzero(self.place >= m - 1)
        size = max(len(self.unique[m]), 1)
        pairs = self.document[held] * size + self.ids[m][held]
        _, inverse, often = np.unique(pairs, return_inverse=True, return_counts=True)
        own = np.zeros(len(self.place), np.int64)
        own[held] = often[inverse]
        return own


def split(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """High and low halves; no high ones if all are 0, as those of most counts are."""
    high = values >> np.uint64(32)
    return high if high.any() else high[:0], values & np.uint64(0xFFFFFFFF)


def joined(arrays: list[np.ndarray], at: int) -> np.ndarray:
    """What `split` made arrays `at` and `at + 1` of."""
    low = arrays[at + 1].astype(np.uint64)
    return (arrays[at].astype(np.uint64) << np.uint64(32)) + low if len(arrays[at]) else low


def pack_ranges(grams: list[tuple[np.ndarray, np.ndarray]], buckets: int, cuts: np.ndarray) -> list[bytes]:
    """(hashes, counts) of each order, cut before the given ones of so many hash ranges."""
    packed: list[list[np.ndarray]] = [[] for _ in cuts[:-1]]
    for hashes, often in grams:
        bucket = (hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
        edges = np.searchsorted(bucket, cuts.astype(np.uint64)).tolist()
        for arrays, start, stop in zip(packed, edges, edges[1:]):
            steps = np.diff(hashes[start:stop], prepend=np.uint64(0))
            arrays += [*split(steps), *split(often[start:stop].astype(np.uint64))]
    return [pack(*arrays) for arrays in packed]


def gram_rows(block: int, buckets: np.ndarray, packed: list[bytes]) -> pa.Table:
    return pa.table(
        {
            "_block": pa.array(np.full(len(packed), block, np.int32)),
            "bucket": pa.array(buckets.astype(np.int32)),
            "grams": pa.array(packed, pa.binary()),
        }
    )


def merge_blocks(table: pa.Table, order: int):
    """For each order the distinct n-grams of some rows, their counts over all these rows, and
    where each row's n-grams are among them."""
    blocks = [unpack(row.as_py())[0] for row in table.column("grams")]
    for at in range(0, 4 * order, 4):
        hashes = [np.cumsum(joined(block, at), dtype=np.uint64) for block in blocks]
        often = np.concatenate([joined(block, at + 2) for block in blocks])
        unique, inverse = np.unique(np.concatenate(hashes), return_inverse=True)
        sums = np.bincount(inverse, often, len(unique)).astype(np.int64)
        yield unique, sums, np.split(inverse, np.cumsum(list(map(len, hashes)))[:-1])


def all_totals(totals: pa.Table, order: int) -> tuple[int, list[np.ndarray]]:
    """The words of hash ranges, and for each order the totals of their n-grams, in order."""
    rows = sorted(totals.to_pylist(), key=lambda row: row["bucket"])
    parts = [unpack(row["totals"])[0] for row in rows]
    found = [
        np.concatenate([np.zeros(0, np.int64)] + [joined(part, at).astype(np.int64) for part in parts])
        for at in range(0, 2 * order, 2)
    ]
    return sum(row["words"] for row in rows), found


def total_rows(table: pa.Table, words: int, totals: list[list[np.ndarray]]) -> pa.Table:
    return pa.table(
        {
            "_block": table.column("_block"),
            "bucket": table.column("bucket"),
            "words": pa.array(np.full(len(totals), words, np.int64)),
            "totals": pa.array([pack(*part) for part in totals], pa.binary()),
        }
    )


def count_block(order: int, buckets: int, wide: int):
    """A block's n-grams and their counts, a row for each `wide` hash ranges, empty ones too."""

    def count(key: tuple, table: pa.Table) -> pa.Table:
        grams = Grams(table.column("_text"), order)
        cuts = np.append(np.arange(0, buckets, wide), buckets)
        held = [(grams.unique[m], grams.often[m]) for m in range(1, order + 1)]
        return gram_rows(key[0].as_py(), np.arange(len(cuts) - 1), pack_ranges(held, buckets, cuts))

    return count


def count_team(order: int, buckets: int, wide: int):
    """What a team of blocks gave for `wide` hash ranges as one block's rows, one for each."""

    def count(key: tuple, table: pa.Table) -> pa.Table:
        first = table.column("bucket")[0].as_py() * wide
        cuts = np.arange(first, min(first + wide, buckets) + 1)
        held = [(unique, sums) for unique, sums, _ in merge_blocks(table, order)]
        return gram_rows(key[0].as_py(), cuts[:-1], pack_ranges(held, buckets, cuts))

    return count


def total_bucket(order: int):
    """Counts over all blocks, in the order in which each block gave its n-grams."""

    def total(table: pa.Table) -> pa.Table:
        totals: list[list[np.ndarray]] = [[] for _ in range(table.num_rows)]
        words = 0
        for m, (_, sums, places) in enumerate(merge_blocks(table, order)):
            words += int(sums.sum()) if m == 0 else 0
            for part, place in zip(totals, places):
                part += split(sums[place].astype(np.uint64))
        return total_rows(table, words, totals)

    return total


def answer_team(order: int):
    """The totals that a team got, for each of its blocks."""

    def answer(table: pa.Table, found: pa.Table) -> pa.Table:
        words, everywhere = all_totals(found, order)
        totals: list[list[np.ndarray]] = [[] for _ in range(table.num_rows)]
        for (_, _, places), total in zip(merge_blocks(table, order), everywhere):
            for part, place in zip(totals, places):
                part += split(total[place].astype(np.uint64))
        return total_rows(table, words, totals)

    return answer


def score_block(order: int, backoff: float, key_type: pa.DataType):
    """Scores of a block's documents from the totals of its n-grams."""

    def score(docs: pa.Table, totals: pa.Table) -> pa.Table:
        grams = Grams(docs.column("_text"), order)
        everywhere, found = all_totals(totals, order)
        others, before = {}, np.full(len(grams.place), everywhere, np.int64)
        others[0] = before - grams.counts[grams.document]
        for m in range(1, order + 1):
            total = found[m - 1]
            held = total[grams.ids[m]] if len(total) else np.zeros(len(grams.place), np.int64)
            others[m] = np.where(grams.place >= m - 1, held - grams.own(m), 0)
        logs = np.zeros(len(grams.place))
        steps = np.zeros(len(grams.place), np.int64)
        level = np.zeros(len(grams.place), np.int64)
        left = np.ones(len(grams.place), bool)
        for m in range(order, 0, -1):
            tried = left & (grams.place >= m - 1)
            hit = np.flatnonzero(tried & (others[m] > 0))
            context = others[m - 1][hit - 1] if m > 1 else others[0][hit]
            logs[hit] = np.log(others[m][hit] / context)
            level[hit] = m
            left[hit] = False
            steps += tried & left
        rest = np.flatnonzero(left)
        logs[rest] = -np.log(np.maximum(others[0][rest], 1))
        logs += steps * np.log(backoff)
        size = len(grams.counts)
        sums = np.bincount(grams.document, logs, size).astype(float)  # of no words, integers
        unseen = np.bincount(grams.document, level == 0, size).astype(np.int64)
        highest = np.bincount(grams.document, level == order, size).astype(np.int64)
        mean = sums / np.maximum(grams.counts, 1)
        return pa.table(
            {
                "_key": docs.column("_key").cast(key_type),
                "n_words": pa.array(grams.counts),
                "log_score": pa.array(sums),
                "mean_log_score": pa.array(mean, mask=grams.counts == 0),
                "n_highest": pa.array(highest),
                "n_unseen": pa.array(unseen),
            }
        )

    return score


def bucketed(rows: DataFrame, buckets: int, by: str) -> DataFrame:
    """Rows as a table in which those of one value lie together; a bucket may hold several."""
    spark = rows.sparkSession
    buckets = min(buckets, int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets")))
    name = f"blocks_{uuid.uuid4().hex}"
    (
        rows.repartition(buckets, by)
        .write.bucketBy(buckets, by)
        .option("path", f"{shared_root(spark)}/bytegrain/{name}")
        .saveAsTable(name)
    )
    return spark.table(name)


def score_documents(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    order: int = 2,
    backoff: float = BACKOFF,
    fan: int = FAN,
) -> DataFrame:
    """(key, n_words, log_score, mean_log_score, n_highest, n_unseen), one row for each row.

    A word scores count(n-gram) / count(its context) at the highest order at which other
    documents hold the n-gram, times `backoff` for each order given up; a word unknown to all
    others scores as a count of one would, with a further `backoff`. Counts are those of all
    documents without the scored one. The first words of a text start at a lower order.
    `n_highest` and `n_unseen` count the words of the highest order and the unknown ones.
    Null and empty texts have no words, log_score 0 and no mean. Rows with null or repeated
    keys are kept apart (copies count as other documents); other columns are not read.

    1. Documents are dealt into blocks by a hash and written as a table bucketed by block.
    2. A block gives its distinct n-grams with counts by hash range, packed: an n-gram comes
       once from a block, however frequent, so hot ones make no hot partition.
    3. Each hash range sums its counts and answers every block in the order it was given.
       More than `fan` blocks meet the ranges in teams of `fan`, which sum first and hand on
       the answers: rows then grow with blocks x `fan` (up to `fan`^2 blocks), not blocks^2.
    4. A block meets the totals of its n-grams; its texts don't move again.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    size = rows.agg(F.sum(F.octet_length("_text")).alias("n")).first().n or 0
    blocks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BLOCK_BYTES))
    block = F.pmod(F.xxhash64("_key", "_text"), F.lit(blocks)).cast("int")
    dealt = bucketed(rows.withColumn("_block", block), blocks, "_block")
    wide = -(-blocks // fan)  # hash ranges that a team takes at a time
    grams = dealt.groupBy("_block").applyInArrow(count_block(order, blocks, wide), GRAMS)
    if wide > 1:
        parts = -(-blocks // wide)
        unit = (F.floor(F.col("_block") / fan) * parts + F.col("bucket")).cast("int")
        teams = bucketed(grams.withColumn("_unit", unit), blocks, "_unit")
        grams = teams.groupBy("_unit").applyInArrow(count_team(order, blocks, wide), GRAMS)
    totals = grams.groupBy("bucket").applyInArrow(total_bucket(order), TOTALS)
    if wide > 1:
        answers = totals.withColumnRenamed("_block", "_unit").groupBy("_unit")
        totals = teams.groupBy("_unit").cogroup(answers).applyInArrow(answer_team(order), TOTALS)
    key_type = to_arrow_type(docs.schema[key].dataType)
    schema = (
        f"_key {ddl(docs, key)}, n_words bigint, log_score double, mean_log_score double, "
        "n_highest bigint, n_unseen bigint"
    )
    scored = dealt.groupBy("_block").cogroup(totals.groupBy("_block")).applyInArrow(
        score_block(order, backoff, key_type), schema
    )
    return scored.withColumnRenamed("_key", key)
