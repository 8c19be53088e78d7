"""BPE encoding and decoding with a table of distinct words."""

from __future__ import annotations

import uuid
import zlib
from array import array
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa

from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from bytegrain.llm.arrow import ddl, pack, release, slices, trimmed, unpack
from bytegrain.llm.tokenizer import TokenizerFile
from bytegrain.session import Stage, shared_root, small_batches

BLOCK_WORDS = 1 << 19  # distinct words of a block of documents
BLOCK_BYTES = 1 << 25  # text of a block of documents
KNOWN_BYTES = 1 << 26  # words and ids that a task remembers of its bucket
WORD_COST = 200  # bytes of a remembered word besides its letters and ids
ENCODED_WORDS = 1 << 13  # words that the library is given at a time
PIECES_JOINED = 1 << 16  # ids whose pieces are joined at a time
WORDS_JOINED = 1 << 16  # words of documents that are put back at a time


class Numbers(dict):
    """Numbers words: bucket by bucket of their hash, in the order in which they are first
    asked for. The word at place i of bucket b has number i * buckets + b."""

    def __init__(self, buckets: int):
        self.lengths = [array("I") for _ in range(buckets)]
        self.letters = [bytearray() for _ in range(buckets)]

    def __missing__(self, word: str) -> int:
        raw = word.encode()
        bucket = zlib.crc32(raw) % len(self.lengths)
        number = self[word] = len(self.lengths[bucket]) * len(self.lengths) + bucket
        self.lengths[bucket].append(len(raw))
        self.letters[bucket] += raw
        return number


def split_blocks(file: TokenizerFile, buckets: int, key_type: pa.DataType, block_words: int):
    """Cut documents into words: a row of word numbers for each slice of a block, and a row
    of new words for each block and bucket of words."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = file.load()
        block = TaskContext.get().partitionId() << 32
        numbers, size = Numbers(buckets), 0
        for batch in batches:
            for part in slices(batch, "_text"):
                codes, counts = [], []
                for text in part.column("_text").to_pylist():
                    before = len(codes)
                    for words in encoder.spans(text) if text else ():
                        codes += [numbers[word] for word in words]
                        size += sum(map(len, words))
                    counts.append(len(codes) - before)
                keys = pa.ListArray.from_arrays([0, part.num_rows], part.column("_key"))
                yield _row(block, keys.cast(pa.list_(key_type)), None, None, pack(counts, codes))
                if len(numbers) >= block_words or size >= BLOCK_BYTES:
                    yield from _word_rows(block, numbers, key_type)
                    block, numbers, size = block + 1, Numbers(buckets), 0
        yield from _word_rows(block, numbers, key_type)

    return trimmed(split)


def _row(block, keys, bucket, words, codes) -> pa.RecordBatch:
    columns = [
        pa.array([block], pa.int64()),
        keys,
        pa.array([bucket], pa.int32()),
        pa.array([words], pa.binary()),
        pa.array([codes], pa.binary()),
    ]
    return pa.record_batch(columns, ["block", "keys", "bucket", "words", "codes"])


def _word_rows(block, numbers, key_type) -> Iterator[pa.RecordBatch]:
    none = pa.nulls(1, pa.list_(key_type))
    for bucket, (lengths, letters) in enumerate(zip(numbers.lengths, numbers.letters)):
        if lengths:
            packed = pack(lengths, blob=letters)
            yield _row(block, none, bucket, packed, None)


def encode_buckets(file: TokenizerFile):
    """Encode the distinct words of each bucket once; give every block its words' ids."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = file.load()
        names = ("block", "bucket", "words")
        rows = (row for batch in batches for row in zip(*map(batch.column, names)))
        for bucket, group in groupby(rows, lambda row: row[1].as_py()):
            known: dict[bytes, bytes] = {}
            held = 0
            for block, _, packed in group:
                (lengths,), blob = unpack(packed.as_py())
                ends = np.cumsum(lengths, dtype=np.int64)
                words = [blob[a:b] for a, b in zip((ends - lengths).tolist(), ends.tolist())]
                if held > KNOWN_BYTES:
                    known, held = {}, 0
                new = [word for word in words if word not in known]
                for at in range(0, len(new), ENCODED_WORDS):
                    part = new[at : at + ENCODED_WORDS]
                    coded = encoder.encode([word.decode() for word in part])
                    known.update((word, array("I", ids).tobytes()) for word, ids in zip(part, coded))
                    held += sum(len(word) + len(known[word]) + WORD_COST for word in part)
                ids = [known[word] for word in words]
                flat = np.frombuffer(b"".join(ids), "<u4")
                columns = [
                    pa.array([block.as_py()], pa.int64()),
                    pa.array([bucket], pa.int32()),
                    pa.array([pack([len(word) // 4 for word in ids], flat)], pa.binary()),
                    pa.array([np.unique(flat)], pa.list_(pa.int32())),
                ]
                yield pa.record_batch(columns, ["block", "bucket", "ids", "used"])

    return trimmed(encode)


def assemble_block(buckets: int, key_type: pa.DataType):
    """Put ids and pieces back by position in the documents of a block."""

    def assemble(documents: pa.Table, words: pa.Table) -> pa.Table:
        release()
        pieces: dict[int, bytes] = {}
        parts: dict[int, list[np.ndarray]] = {}
        for number, piece, bucket, ids in zip(*map(words.column, ("id", "piece", "bucket", "ids"))):
            if piece.is_valid:
                pieces[number.as_py()] = piece.as_py()
            else:
                parts[bucket.as_py()] = unpack(ids.as_py())[0]
        table = WordTable(parts, pieces, buckets)
        return pa.Table.from_batches(
            [
                table.documents(keys.as_py(), codes.as_py(), key_type)
                for keys, codes in zip(documents.column("keys"), documents.column("codes"))
            ],
            pa.schema([("_key", key_type), ("ids", pa.binary()), ("decoded", pa.string())]),
        )

    return assemble


class WordTable:
    """The words of a block by number: their ids, and the bytes these decode to.

    Both lie one word after the other in one array each.
    """

    def __init__(self, parts: dict[int, list[np.ndarray]], pieces: dict[int, bytes], buckets: int):
        slots = max((len(lengths) for lengths, _ in parts.values()), default=0)
        starts, sizes = np.zeros((slots, buckets), np.int64), np.zeros((slots, buckets), np.int64)
        ids, at = [np.zeros(0, "<u4")], 0
        for bucket, (lengths, flat) in parts.items():
            ends = np.cumsum(lengths, dtype=np.int64)
            starts[: len(ends), bucket] = at + ends - lengths
            sizes[: len(ends), bucket] = lengths
            ids.append(flat)
            at += len(flat)
        self.ids = np.concatenate(ids).astype("<u4")
        self.starts, self.lengths = starts.reshape(-1), sizes.reshape(-1)
        sizes = np.zeros(max(pieces, default=0) + 1, np.int64)
        sizes[list(pieces)] = list(map(len, pieces.values()))
        edges = np.append(0, np.cumsum(sizes[self.ids]))
        self.letters = np.frombuffer(
            b"".join(
                b"".join([pieces[i] for i in self.ids[at : at + PIECES_JOINED].tolist()])
                for at in range(0, len(self.ids), PIECES_JOINED)
            ),
            np.uint8,
        )
        self.byte_starts = edges[self.starts]
        self.byte_lengths = edges[self.starts + self.lengths] - self.byte_starts

    def documents(self, keys: list, packed: bytes, key_type: pa.DataType) -> pa.RecordBatch:
        (counts, codes), _ = unpack(packed)
        ids, id_ends = _gather(self.ids, self.starts[codes], self.lengths[codes])
        letters, ends = _gather(self.letters, self.byte_starts[codes], self.byte_lengths[codes])
        stops = np.append(0, np.cumsum(counts, dtype=np.int64))
        binary = _cut(ids.view(np.uint8), 4 * id_ends[stops], pa.binary())
        texts = _cut(letters, ends[stops], pa.string())
        try:
            texts.validate(full=True)
        except pa.ArrowInvalid:  # a sign that ids cut apart
            raw = texts.cast(pa.binary()).to_pylist()
            texts = pa.array([text.decode("utf-8", errors="replace") for text in raw], pa.string())
        return pa.record_batch([pa.array(keys, key_type), binary, texts], ["_key", "ids", "decoded"])


def _cut(raw: np.ndarray, edges: np.ndarray, kind: pa.DataType) -> pa.Array:
    """An array of the values that lie between the edges, on the same bytes."""
    offsets = pa.array(edges, pa.int32())
    return pa.Array.from_buffers(kind, len(edges) - 1, [None, offsets.buffers()[1], pa.py_buffer(raw)])


def _gather(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray):
    """The runs of `values` one after the other, and the places where they end, 0 first."""
    ends = np.append(0, np.cumsum(lengths))
    found = np.empty(ends[-1], values.dtype)
    for at in range(0, len(starts), WORDS_JOINED):
        part = slice(at, at + WORDS_JOINED)
        low, high = ends[at], ends[min(at + WORDS_JOINED, len(starts))]
        places = np.repeat(starts[part] - ends[:-1][part], lengths[part])
        found[low:high] = values[places + np.arange(low, high)]
    return found, ends


def encode_decode(
    docs: DataFrame,
    path: str,
    key: str = "doc_id",
    text: str = "text",
    buckets: int | None = None,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """Encode every text and decode it again: (key, ids, decoded), one row for each row.

    `ids` holds the ids as little-endian unsigned 32-bit integers, `decoded` the text that
    they decode to. A null or empty text has no ids and decodes to ''. Rows with null or
    repeated keys are kept apart, other columns are not read, an empty table gives no rows.

    1. Blocks of documents (about `block_words` distinct words or 2^25 characters at most)
       are cut into words and their words numbered; written as a table bucketed by block: word
       numbers of documents, and per block and hash bucket the distinct words.
    2. Each bucket encodes its distinct words once. A word comes once from each block, however
       often it occurs, so a frequent word is no hot key. Staged again.
    3. The ids that a block uses are joined with the id-to-piece table, which is broadcast: it
       has one row for each id of the vocabulary and doesn't grow with the data.
    4. Ids and pieces go to the documents of their block by position; these don't move.
    """
    spark = docs.sparkSession
    file = TokenizerFile.read(path)
    if buckets is None:
        buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    key_type = to_arrow_type(docs.schema[key].dataType)
    kind = ddl(docs, key)
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    blocks = bucketed(
        rows.mapInArrow(
            split_blocks(file, buckets, key_type, block_words),
            f"block bigint, keys array<{kind}>, bucket int, words binary, codes binary",
        ),
        buckets,
    )
    words = blocks.where("bucket IS NOT NULL").select("block", "bucket", "words")
    encoded = Stage(
        words.repartition("bucket")
        .sortWithinPartitions("bucket")
        .mapInArrow(encode_buckets(file), "block bigint, bucket int, ids binary, used array<int>"),
        "word-ids",
    ).df
    vocabulary = spark.createDataFrame(file.load().pieces(), "id int, piece binary")
    used = encoded.groupBy("block").agg(
        F.array_distinct(F.flatten(F.collect_list("used"))).alias("used")  # of the vocabulary
    )
    pieces = used.select("block", F.explode("used").alias("id")).join(F.broadcast(vocabulary), "id")
    known = encoded.select("block", "bucket", "ids").unionByName(
        pieces.select("block", "id", "piece"), True
    )
    coded = blocks.where("bucket IS NULL").select("block", "keys", "codes")
    return (
        coded.groupBy("block")
        .cogroup(known.groupBy("block"))
        .applyInArrow(
            assemble_block(buckets, key_type), f"_key {kind}, ids binary, decoded string"
        )
        .withColumnRenamed("_key", key)
    )


def bucketed(blocks: DataFrame, buckets: int) -> DataFrame:
    spark = blocks.sparkSession
    name = f"blocks_{uuid.uuid4().hex}"
    path = f"{shared_root(spark)}/bytegrain/{name}"
    with small_batches(spark):
        blocks.write.bucketBy(buckets, "block").option("path", path).saveAsTable(name)
    return spark.table(name)
