"""Removal of long repeated byte strings with suffix arrays."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bytegrain.llm.arrow import ddl, trimmed
from bytegrain.llm.suffix_array import common_prefixes, suffix_array
from bytegrain.session import Stage, shared_root

LENGTH = 400
GRAM = 64  # bytes of the strings whose least hash names a window
PIECE = 1 << 18  # window starts that are hashed at a time
RUN = 4096  # window starts of a run at most
SORTED_BYTES = 1 << 18  # text of one suffix array, beyond its last group
HOT_RUNS = 8192  # runs of one name beyond which its windows are compared by hash
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of the base and of its inverse, for hashes of all strings of a text."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def need(self, n: int) -> None:
        if len(self.up) < n:
            self.up = np.cumprod(np.append(np.uint64(1), np.full(n, BASE)))
            self.down = np.cumprod(np.append(np.uint64(1), np.full(n, INVERSE)))

    def hashes(self, text: np.ndarray, size: int) -> np.ndarray:
        """A hash of each string of `size` bytes."""
        n = len(text)
        self.need(n)
        sums = np.append(
            np.uint64(0), np.cumsum((text.astype(np.uint64) + np.uint64(1)) * self.up[:n])
        )
        return mix((sums[size:] - sums[:-size]) * self.down[: n - size + 1])


def sliding(values: np.ndarray, width: int, least) -> np.ndarray:
    """Least (or greatest) values of all windows of `width`."""
    size = 1
    while size * 2 <= width:
        values = least(values[:-size], values[size:])
        size *= 2
    rest = width - size
    return least(values[: len(values) - rest], values[rest:]) if rest else values


def runs(text: np.ndarray, ends: np.ndarray, powers: Powers, length: int, gram: int):
    """Runs of windows of `length` bytes with the same name: (name, start, count, repeats).

    `ends` are those of the documents in `text`; windows cross none. A window's name is the
    least hash of the strings of `gram` bytes inside, so equal windows have equal names.
    `repeats` tells whether a run's windows hold their name's string more than once.
    """
    none = np.zeros(0, np.int64)
    if len(text) < length:
        return none.astype(np.uint64), none, none, none.astype(bool)
    width = length - gram + 1
    grams = powers.hashes(text, gram)
    names = sliding(grams, width, np.minimum)
    start = np.arange(len(names))
    document = np.searchsorted(ends, start, side="right")
    valid = start + length <= ends[document]
    held = np.where(valid, names, np.uint64(0))
    around = np.concatenate([np.zeros(width - 1, np.uint64), held, np.zeros(width - 1, np.uint64)])
    greatest = sliding(around, width, np.maximum)
    least_at = np.flatnonzero((greatest[: len(grams)] == grams) & (grams != 0))
    order = np.lexsort((least_at, grams[least_at]))
    at, value = least_at[order], grams[least_at][order]
    close = (value[1:] == value[:-1]) & (at[1:] - at[:-1] <= width)
    again = np.unique(value[1:][close])
    changes = np.append(True, (names[1:] != names[:-1]) | (document[1:] != document[:-1]))
    first = np.flatnonzero(valid & (changes | np.append(True, ~valid[:-1])))
    after = np.flatnonzero(np.append(valid[:-1] & (changes[1:] | ~valid[1:]), valid[-1])) + 1
    count = after - first
    parts = -(-count // RUN)
    offset = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    first, count = np.repeat(first, parts) + offset * RUN, np.repeat(count, parts) - offset * RUN
    return names[first], first, np.minimum(count, RUN), np.isin(names[first], again)


def named_runs(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """(name, _row, _alt, start, n, weight) of all texts; weight 2 if a run may repeat itself."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            texts = batch.column("_text")
            rows, size = [], 0
            for row in range(batch.num_rows):
                raw = (texts[row].as_py() or "").encode()
                for at in range(0, max(len(raw) - length + 1, 0), PIECE):
                    piece = raw[at : at + PIECE + length - 1]
                    rows.append((row, at, piece))
                    size += len(piece)
                    if size >= PIECE:
                        yield emit(batch, rows, powers)
                        rows, size = [], 0
            if rows:
                yield emit(batch, rows, powers)

    def emit(batch, rows, powers):
        text = np.frombuffer(b"".join(raw for *_, raw in rows), np.uint8)
        ends = np.cumsum([len(raw) for *_, raw in rows])
        names, start, count, again = runs(text, ends, powers, length, gram)
        piece = np.searchsorted(ends, start, side="right")
        row = np.array([r for r, *_ in rows])[piece]
        shift = np.array([at for _, at, _ in rows]) - (ends - [len(raw) for *_, raw in rows])
        take = pa.array(row)
        columns = [
            pa.array(names.view(np.int64)),
            batch.column("_row").take(take),
            batch.column("_alt").take(take),
            pa.array(start + shift[piece]),
            pa.array(count),
            pa.array(again.astype(np.int64) + 1),
        ]
        return pa.record_batch(columns, ["name", "_row", "_alt", "start", "n", "weight"])

    schema = "name bigint, _row bigint, _alt bigint, start bigint, n bigint, weight bigint"
    return docs.select("_row", "_alt", "_text").mapInArrow(trimmed(find), schema)


def run_contents(chosen: DataFrame, length: int, with_text: bool) -> DataFrame:
    """(name, content, hot, _row, _alt, start, n, bytes) of chosen runs; `bytes` only where a
    task meets a content for the first time."""
    fields = "name bigint, content bigint, hot boolean, _row bigint, _alt bigint, start bigint, n bigint"
    none = pa.nulls(0, pa.binary())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            for row in range(batch.num_rows):
                raw = (batch.column("_text")[row].as_py() or "").encode()
                found = batch.column("runs")[row].as_py()
                contents, texts = [], []
                for run in found:
                    text = raw[run["start"] : run["start"] + run["n"] + length - 1]
                    content = xxhash.xxh3_64_intdigest(text) - (1 << 63)
                    contents.append(content)
                    fresh = with_text and (run["name"], content) not in seen
                    texts.append(text if fresh else None)
                    if fresh:
                        seen.add((run["name"], content))
                columns = [
                    pa.array([run["name"] for run in found], pa.int64()),
                    pa.array(contents, pa.int64()),
                    pa.array([run["hot"] for run in found], pa.bool_()),
                    pa.array([batch.column("_row")[row].as_py()] * len(found), pa.int64()),
                    pa.array([batch.column("_alt")[row].as_py()] * len(found), pa.int64()),
                    pa.array([run["start"] for run in found], pa.int64()),
                    pa.array([run["n"] for run in found], pa.int64()),
                    pa.array(texts, pa.binary()) if with_text else none,
                ][: 8 if with_text else 7]
                names = ["name", "content", "hot", "_row", "_alt", "start", "n", "bytes"]
                yield pa.record_batch(columns, names[: len(columns)])

    return chosen.select("_row", "_alt", "_text", "runs").mapInArrow(
        trimmed(cut), fields + (", bytes binary" if with_text else "")
    )


def repeated_starts(texts: list[bytes], length: int) -> list[list[tuple[int, int]]]:
    """For each text, the spans of starts of windows that these texts hold twice or more.

    Starts end `length` - 1 bytes before their text does, so no span crosses texts.
    """
    sizes = np.array(list(map(len, texts)), np.int64)
    ends = np.cumsum(sizes)
    text = np.frombuffer(b"".join(texts), np.uint8)
    order = suffix_array(text)
    starts = ends - sizes
    shared = common_prefixes(text, order, starts, RUN + 2 * length)
    owner = np.repeat(np.arange(len(texts)), sizes)
    valid = np.arange(len(text)) + length <= ends[owner]
    group = np.cumsum(shared[order] < length) - 1
    many = np.bincount(group, valid[order])[group] > 1
    repeated = np.zeros(len(text) + 1, bool)
    repeated[order[many]] = True
    repeated[:-1] &= valid
    edges = np.flatnonzero(np.diff(np.append(False, repeated).astype(np.int8)))
    spans: list[list[tuple[int, int]]] = [[] for _ in texts]
    for low, high in edges.reshape(-1, 2).tolist():
        which = int(owner[low])
        spans[which].append((low - int(starts[which]), high - int(starts[which])))
    return spans


def find_repeats(contents: DataFrame, length: int) -> DataFrame:
    """(name, content, low, high): spans of repeated starts in contents (name, content, times,
    bytes). A content that occurs twice is repeated as a whole; others are sorted together
    with all contents of their names, many names at a time."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in _tuples(batch))
        held: list[tuple[int, int, bool]] = []
        texts: list[bytes] = []
        size = 0
        done: list[tuple[int, int, int, int]] = []
        for name, group in groupby(rows, lambda row: row[0]):
            members = list(group)  # at most HOT_RUNS
            for _, content, times, text in members:
                if times > 1:
                    done.append((name, content, 0, len(text) - length + 1))
            if len(members) > 1 or members[0][2] == 1:
                for _, content, times, text in members:
                    held.append((name, content, times > 1))
                    texts.append(text)
                    size += len(text)
            if size >= SORTED_BYTES or len(done) > 10_000:
                yield spans(held, texts, done)
                held, texts, size, done = [], [], 0, []
        yield spans(held, texts, done)

    def spans(held, texts, done):
        found = list(done)
        if texts:
            for (name, content, whole), starts in zip(held, repeated_starts(texts, length)):
                if not whole:
                    found += [(name, content, low, high) for low, high in starts]
        columns = [pa.array(column, pa.int64()) for column in (zip(*found) if found else [[]] * 4)]
        return pa.record_batch(columns, ["name", "content", "low", "high"])

    return (
        contents.select("name", "content", "times", "bytes")
        .repartition("name")
        .sortWithinPartitions("name")
        .mapInArrow(trimmed(find), "name bigint, content bigint, low bigint, high bigint")
    )


def _tuples(batch: pa.RecordBatch) -> Iterator[tuple]:
    return zip(*(batch.column(c).to_pylist() for c in ("name", "content", "times", "bytes")))


def hot_repeats(contents: DataFrame, length: int) -> DataFrame:
    """As find_repeats, for names with very many runs: windows meet by their own hashes, which
    are counted before the shuffle, so that no group comes together in one task."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            for name, content, times, text in _tuples(batch):
                values = powers.hashes(np.frombuffer(text, np.uint8), length).view(np.int64)
                count = len(values)
                columns = [
                    pa.array(values),
                    pa.array(np.full(count, name)),
                    pa.array(np.full(count, content)),
                    pa.array(np.full(count, times)),
                    pa.array(np.arange(count)),
                ]
                yield pa.record_batch(columns, ["window", "name", "content", "times", "low"])

    schema = "window bigint, name bigint, content bigint, times bigint, low bigint"
    rows = contents.select("name", "content", "times", "bytes").mapInArrow(trimmed(windows), schema)
    often = rows.groupBy("window").agg(F.sum("times").alias("all")).where("all > 1").select("window")
    return rows.join(often, "window").selectExpr("name", "content", "low", "low + 1 AS high")


def whole_signs(raw: bytes, low: int, high: int) -> tuple[int, int]:
    """A span of UTF-8 bytes, widened to the borders of the signs that it cuts."""
    while 0 < low < len(raw) and raw[low] & 0xC0 == 0x80:
        low -= 1
    while high < len(raw) and raw[high] & 0xC0 == 0x80:
        high += 1
    return low, high


def remove_spans(docs: DataFrame, signs: bool) -> DataFrame:
    """Mark the bytes that `spans` cover: (_key, n_bytes, spans, kept)."""
    pair = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, removed, kept = [], [], []
            for text, found in zip(batch.column("_text"), batch.column("spans")):
                raw = (text.as_py() or "").encode()
                merged: list[list[int]] = []
                ordered = sorted((s["low"], s["high"]) for s in found.as_py() or ())
                for span in (whole_signs(raw, *s) for s in ordered) if signs else ordered:
                    if merged and span[0] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], span[1])
                    else:
                        merged.append(list(span))
                stops = [0] + [stop for _, stop in merged]
                starts = [start for start, _ in merged] + [len(raw)]
                sizes.append(len(raw))
                removed.append([{"start": a, "stop": b} for a, b in merged])
                kept.append(b"".join(raw[a:b] for a, b in zip(stops, starts)))
            columns = [
                batch.column("_key"),
                pa.array(sizes, pa.int64()),
                pa.array(removed, pair),
                pa.array(kept, pa.binary()),
            ]
            yield pa.record_batch(columns, ["_key", "n_bytes", "spans", "kept"])

    kind = ddl(docs, "_key")
    return docs.select("_key", "_text", "spans").mapInArrow(
        trimmed(remove),
        f"_key {kind}, n_bytes bigint, spans array<struct<start: bigint, stop: bigint>>, kept binary",
    )


def bucketed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(_key, _text, _row, _alt) as a table bucketed by row identity, so that the two joins
    below don't move texts. Rows with equal key and text are one identity."""
    spark = docs.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    rows = rows.withColumn("_row", F.xxhash64("_key", "_text")).withColumn(
        "_alt", F.xxhash64(F.lit(7), "_text", "_key")
    )
    name = f"texts_{uuid.uuid4().hex}"
    (
        rows.repartition(buckets, "_row", "_alt")
        .write.bucketBy(buckets, "_row", "_alt")
        .option("path", f"{shared_root(spark)}/bytegrain/{name}")
        .saveAsTable(name)
    )
    return spark.table(name)


def remove_repeats(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    length: int = LENGTH,
    gram: int = GRAM,
    hot: int = HOT_RUNS,
    signs: bool = False,
) -> DataFrame:
    """Remove every byte that a string of `length` bytes covers which also starts elsewhere.

    Returns (key, n_bytes, spans, kept) with a row for each row: the removed spans of bytes and
    the remaining bytes. Texts are UTF-8 bytes, null is empty; strings lie within one text and
    are judged on the input. Other columns are not read. Rows with equal key and text are
    copies of each other, as any two equal texts are. An empty table gives no rows. With `signs`
    the removed spans take in signs that they would cut, so what is kept is UTF-8 again.

    1. A window of `length` bytes is named by the least hash of the strings of `gram` bytes
       inside. Neighbours mostly share names, so texts become runs of some 170 starts. Equal
       windows have equal names; runs whose name occurs once are done.
    2. Contents of the other runs are gathered once each, with how often they occur.
    3. Contents with a common name are sorted by a two-stage suffix array; neighbours with a
       common prefix of `length` bytes are repeats. Names with more than `hot` runs would be
       large groups: the hashes of their windows are counted instead.
    4. Repeats go back to the runs of their content and to their documents.
    """
    texts = bucketed(docs, key, text)
    found = Stage(named_runs(texts, length, gram), "runs").df
    names = (
        found.groupBy("name")
        .agg(F.sum("weight").alias("weight"), F.count("*").alias("_runs"))
        .where("weight > 1")
        .select("name", (F.col("_runs") > hot).alias("hot"))
    )
    by_row = (
        found.join(names, "name")
        .groupBy("_row", "_alt")
        .agg(F.collect_set(F.struct("name", "hot", "start", "n")).alias("runs"))
    )
    by_row = Stage(by_row, "chosen").df
    chosen = texts.join(by_row, ["_row", "_alt"])
    contents = (
        run_contents(chosen, length, True)
        .groupBy("name", "content")
        .agg(
            F.count("*").alias("times"),
            F.first("bytes", ignorenulls=True).alias("bytes"),
            F.first("hot").alias("hot"),
        )
    )
    contents = Stage(contents, "contents").df
    repeats = find_repeats(contents.where("NOT hot"), length)
    if not contents.where("hot").isEmpty():
        repeats = repeats.unionByName(hot_repeats(contents.where("hot"), length))
    repeats = Stage(repeats, "repeats").df
    spans = (
        run_contents(chosen, length, False)
        .join(repeats, ["name", "content"])
        .groupBy("_row", "_alt")
        .agg(
            F.collect_set(
                F.struct(
                    (F.col("start") + F.col("low")).alias("low"),
                    (F.col("start") + F.col("high") + (length - 1)).alias("high"),
                )
            ).alias("spans")
        )
    )
    marked = texts.join(spans, ["_row", "_alt"], "left")
    return remove_spans(marked, signs).withColumnRenamed("_key", key)
