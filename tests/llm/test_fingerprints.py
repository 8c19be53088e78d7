"""Fingerprints against the same definition in plain Python."""

import random
import re
from collections import Counter

import pytest
import xxhash

from bytegrain.llm import fingerprints as fp
from bytegrain.llm.fingerprints import fingerprint_edits, fingerprints


def signed(value):
    return value - (1 << 64) if value >> 63 else value


def hash_text(text):
    return signed(xxhash.xxh64_intdigest(text.encode(), 42))


def word_set(text):
    return {w for w in re.split(r"[\x20\x09-\x0D]+", (text or "").lower()) if w}


def printed(text, known):
    terms = {w for w in word_set(text) if w in known}
    terms = terms if len(terms) >= 8 else word_set(text)
    hashes = [hash_text(w) for w in sorted(terms, key=str.encode)]
    out = []
    for level in range(10):
        held = [h for h in hashes if (h >> 8) & ((1 << 2 * level) - 1) == 0]
        for subset in range(32):
            group, part = divmod(subset, 4)
            seed, found = 42, [h for h in held if h & 7 == group and h >> 3 & 3 == part]
            for h in found:
                seed = xxhash.xxh64_intdigest((h & (1 << 64) - 1).to_bytes(8, "little"), seed)
            empty = not found or (len(held) > 256 and level < 9)
            out.append("00" if empty else f"{1 + signed(seed) % 255:02X}")
    return "".join(out)


def near(a, b):
    if a == b:
        return 1.0
    best = 0.0
    for level in range(10):
        pairs = [(a[i : i + 2], b[i : i + 2]) for i in range(64 * level, 64 * level + 64, 2)]
        filled = [p for p in pairs if p != ("00", "00")]
        if len(filled) >= (8 if level else 1):
            best = max(best, sum(x == y for x, y in filled) / len(filled))
    return best


def brute(rows):
    df = Counter(w for _, t in rows for w in word_set(t))
    known = {w for w, n in df.items() if 0.001 * len(rows) <= n < 0.05 * len(rows)}
    distinct = sorted(
        {(k, t or "") for k, t in rows}, key=lambda r: (r[0] is not None, r[0] or 0, hash_text(r[1]))
    )
    found = []
    for key, text in rows:
        text = text or ""
        at = distinct.index((key, text))
        following = distinct[(at + 1) % len(distinct)][1]
        quarter = len(text) // 4
        edited = text[: len(text) - quarter] + following[:quarter]
        a, b, c = (printed(t, known) for t in (text, edited, following))
        found.append((key, len(text), edited, a, b, round(near(a, b), 9), round(near(a, c), 9)))
    return sorted(found, key=repr)


def table(seed):
    rng = random.Random(seed)
    words = [f"w{i}é" for i in range(900)] + ["\U0001f600x"]
    rows = [
        (i * 7 % 101, " ".join(rng.choices(words, k=rng.choice([3, 12, 60, 300, 900]))))
        for i in range(101)
    ]
    rows += [(None, "No key a b"), (None, None), (5, ""), (5, ""), (7, "twice the key"), (300, " \n")]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_edits(spark, seed):
    rows = table(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr(
        "doc_id", "text", "1 AS rank", "text AS fingerprint"
    )
    got = fingerprint_edits(docs.repartition(3)).collect()
    fields = ("doc_id", "n_chars", "edited", "fingerprint", "edited_fingerprint")
    assert sorted(
        ((*[r[f] for f in fields], round(r.near_edited, 9), round(r.near_next, 9)) for r in got), key=repr
    ) == brute(rows)


def test_copies_have_equal_fingerprints(spark):
    text = " ".join(f"word{i}" for i in range(5000))
    docs = spark.createDataFrame([(1, text), (2, text), (3, "other")], "doc_id int, text string")
    one, two, three = (r.fingerprint for r in fingerprints(docs).orderBy("doc_id").collect())
    assert one == two != three
    assert len(one) == 2 * fp.LEVELS * fp.SUBSETS


def test_texts_of_very_many_words(spark):
    texts = [" ".join(f"{x}{i}" for i in range(300_000)) for x in "ab"]
    rows = [(i, text) for i, text in enumerate(texts)] + [(2, "")]
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    one, two, empty = fingerprint_edits(docs).orderBy("doc_id").collect()
    assert len({one.fingerprint, two.fingerprint, one.edited_fingerprint, empty.fingerprint}) == 4
    assert one.near_next < 0.1 and two.near_next < 0.1
    assert set(empty.fingerprint) == {"0"} and len(one.fingerprint) == len(empty.fingerprint)


def test_likeness_does_not_drop_at_any_size(spark):
    """Edits keep three quarters of a text, whether it has hundreds or hundreds of thousands of words."""
    sizes = [500, 5_000, 60_000, 200_000, 240_000, 262_000, 270_000, 300_000, 400_000]
    rows = [(i, " ".join(f"{chr(97 + i)}{w}" for w in range(n))) for i, n in enumerate(sizes)]
    docs = spark.createDataFrame(rows, "doc_id int, text string").repartition(4)
    found = fingerprint_edits(docs).orderBy("doc_id").collect()
    assert all(r.near_edited > 0.3 and r.near_next < 0.1 for r in found)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id int, text string")
    assert fingerprint_edits(docs).collect() == []
    assert fingerprints(docs).collect() == []
