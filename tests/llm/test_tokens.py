"""Token counts and BPE coding against the library itself."""

import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from bytegrain.llm import bpe
from bytegrain.llm import tokenizer as tk
from bytegrain.llm.arrow import pack, trimmed, unpack
from bytegrain.llm.token_counts import token_counts
from bytegrain.session import BATCH_BYTES, BATCH_OPTION, Stage

JSON = public_tokenizers.path("byte_bpe_50k.json")

TEXTS = [
    None,
    "",
    " ",
    "  \n\n  ",
    "plain words, and a few more.\nSecond line\n\n  indented  twice \t tab\r\nend ",
    "a <|endoftext|>b  <|endoftext|>  <|endoftext|>\nc<|endoftext|>",
    "don't you'LL 12345 x2  nbsp  em 　wide \u0085nel é ́ mark",
    "日本語の文。中文 \U0001f600\U0001f468‍\U0001f469 مرحبا",
    "word “quoted” — dash\n“next”\nline",
    "=" * 5000,
    "nul\x00 in \x1c\x1d text\x0b\x0c",
    ("long text with words \n" * 9000),
    "x" * 70000 + " " + "y z\n" * 20000,
    "plain words, and a few more.",
    "plain words, and a few more.",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(JSON)


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i if i != 3 else None, t, "s", 7) for i, t in enumerate(TEXTS)]
    rows.append((5, "same key, other text", None, None))
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, _key int")


def test_words_encode_on_their_own(library):
    encoder = tk.TokenizerFile.read(JSON).load()
    for text in filter(None, TEXTS):
        words = [w for span in encoder.spans(text) for w in span]
        assert "".join(words) == text
        ids = [i for part in encoder.encode(words) for i in part]
        assert ids == library.encode(text, add_special_tokens=False).ids


def test_token_counts(docs, library):
    got = sorted(map(tuple, token_counts(docs, JSON).collect()), key=repr)
    want = []
    for row in docs.collect():
        n = len(library.encode(row.text or "", add_special_tokens=False).ids)
        want.append((row.doc_id, len((row.text or "").encode()), n, n > 1024))
    assert got == sorted(want, key=repr)


def test_token_counts_of_pieces(docs):
    model = public_tokenizers.path("piece_bpe_32k.model")
    piece = sentencepiece.SentencePieceProcessor(model_file=model)
    got = sorted(r.n_tokens for r in token_counts(docs, model).collect())
    assert got == sorted(len(piece.encode(r.text or "")) for r in docs.collect())


def test_other_json_vocabularies_encode_whole_texts(docs):
    path = public_tokenizers.path("word_bpe_49k.json")
    other = Tokenizer.from_file(path)
    other.no_truncation()
    got = sorted(r.n_tokens for r in token_counts(docs, path).collect())
    want = [len(other.encode(r.text or "", add_special_tokens=False).ids) for r in docs.collect()]
    assert got == sorted(want)


def test_empty_table(docs):
    assert token_counts(docs.where("false"), JSON).collect() == []


def coded(rows):
    return sorted(((r.doc_id, bytes(r.ids), r.decoded) for r in rows), key=repr)


@pytest.mark.parametrize("block_words", [bpe.BLOCK_WORDS, 1])
def test_encode_decode(docs, library, block_words):
    got = coded(bpe.encode_decode(docs, JSON, buckets=5, block_words=block_words).collect())
    want = []
    for row in docs.collect():
        ids = library.encode(row.text or "", add_special_tokens=False).ids
        packed = b"".join(i.to_bytes(4, "little") for i in ids)
        want.append((row.doc_id, packed, library.decode(ids, skip_special_tokens=False)))
    assert got == sorted(want, key=repr)


def test_encode_decode_of_an_empty_table(docs):
    assert bpe.encode_decode(docs.where("false"), JSON).collect() == []


def test_pack():
    (a, b), blob = unpack(pack([1, 2**32 - 1, 70000], [], blob=b"xyz"))
    assert (a.tolist(), b.tolist(), blob) == ([1, 2**32 - 1, 70000], [], b"xyz")


def test_words_of_a_block_take_little_memory():
    """A word costs some 40 bytes in all, not an object of its own with 60 and more."""
    buckets, size = 8, 30_000
    lengths = np.full(size, 3, "<u4")
    parts = {b: (lengths, np.arange(3 * size, dtype="<u4") % 1000) for b in range(buckets)}
    pieces = {i: b"ab" for i in range(1000)}
    tracemalloc.start()
    table = bpe.WordTable(parts, pieces, buckets)
    held, _ = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert held < 60 * buckets * size
    codes = pack([2, 0, 1], [8 * 5, 3, 8 * 7 + 1])
    got = table.documents([1, 2, 3], codes, pa.int64()).to_pydict()
    assert got["decoded"] == ["ab" * 6, "", "ab" * 3]
    assert [np.frombuffer(i, "<u4").tolist() for i in got["ids"]] == [[15, 16, 17, 0, 1, 2], [], [21, 22, 23]]


def test_new_words_of_a_block_are_held_once():
    words = [f"word number {i}" for i in range(50_000)]
    tracemalloc.start()
    numbers = bpe.Numbers(4)
    for word in words:
        numbers[word]
    held, _ = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert held < 150 * len(words)
    first = next(w for w in words if numbers[w] % 4 == 2)
    assert numbers[first] == 2 and numbers.letters[2].startswith(first.encode())
    assert numbers.lengths[2][0] == len(first)


def test_remembered_words_are_bounded_by_what_they_take(monkeypatch):
    """Far more words than are remembered, in blocks that repeat them."""
    monkeypatch.setattr(bpe, "KNOWN_BYTES", 1 << 16)
    monkeypatch.setattr(bpe, "ENCODED_WORDS", 100)
    blocks = [[f" w{i}".encode() for i in range(start, start + 2000)] for start in (0, 1000, 0)]
    rows = [(n, 0, pack(list(map(len, b)), blob=b"".join(b))) for n, b in enumerate(blocks)]
    batch = pa.record_batch([pa.array(c) for c in zip(*rows)], ["block", "bucket", "words"])
    file = tk.TokenizerFile.read(JSON)
    library = Tokenizer.from_file(JSON)
    for words, out in zip(blocks, bpe.encode_buckets(file)(iter([batch]))):
        lengths, flat = unpack(out.column("ids")[0].as_py())[0]
        want = [library.encode(w.decode(), add_special_tokens=False).ids for w in words]
        assert lengths.tolist() == list(map(len, want))
        assert flat.tolist() == [i for ids in want for i in ids]


def test_staged_tables_take_small_batches(spark):
    def batch_sizes(batches):
        for batch in batches:
            yield pa.record_batch([pa.array([batch.num_rows]), pa.array([batch.nbytes])], ["n", "size"])

    rows = spark.range(0, 9000, 1, 1).select(F.expr("repeat(cast(id as string), 1000)").alias("text"))
    sizes = rows.mapInArrow(trimmed(batch_sizes), "n long, size long")
    found = Stage(sizes, "sizes").df.collect()
    assert sum(r.n for r in found) == 9000
    assert max(r.size for r in found) < 1.5 * BATCH_BYTES
    assert spark.conf.get(BATCH_OPTION, None) is None
    spark.conf.set(BATCH_OPTION, 1 << 30)
    try:
        assert Stage(sizes, "sizes").df.count() == 1  # the session's own setting stays
        assert spark.conf.get(BATCH_OPTION) == str(1 << 30)
    finally:
        spark.conf.unset(BATCH_OPTION)


def test_ids_that_cut_a_sign_decode_to_its_replacement():
    pieces = {0: "é".encode()[:1], 1: "é".encode()[1:], 2: b"a"}
    lengths = np.array([2, 1, 2], "<u4")
    table = bpe.WordTable({0: (lengths, np.array([0, 1, 0, 2, 0], "<u4"))}, pieces, 1)
    got = table.documents([7, 8, 9], pack([1, 2, 1], [0, 1, 0, 2]), pa.int64()).to_pydict()
    assert got["decoded"] == ["é", "�é", "a�"]
    assert [np.frombuffer(i, "<u4").tolist() for i in got["ids"]] == [[0, 1], [0, 0, 1], [2, 0]]
