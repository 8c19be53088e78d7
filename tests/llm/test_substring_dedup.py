"""Suffix arrays and the removal of repeated strings against plain counting."""

import random
from collections import Counter

import numpy as np
import pytest

from bytegrain.llm.substring_dedup import Powers, remove_repeats, runs
from bytegrain.llm.suffix_array import common_prefixes, rising, sort_rising, suffix_array


def random_bytes(rng):
    size, letters = rng.randrange(1, 150), rng.randrange(1, 5)
    base = rng.randrange(250)
    text = bytes(base + rng.randrange(letters) for _ in range(size))
    return text[: size // 4 + 1] * 4 + text if rng.random() < 0.4 else text


def test_suffix_array():
    rng = random.Random(1)
    for _ in range(150):
        text = random_bytes(rng)
        array = np.frombuffer(text, np.uint8)
        want = sorted(range(len(text)), key=lambda i: text[i:])
        assert suffix_array(array).tolist() == want
        up = rising(array)
        assert up.tolist() == [text[i:] < text[i + 1 :] for i in range(len(text))]
        assert sort_rising(array, up).tolist() == [i for i in want if up[i]]
        starts = np.array([0, len(text) // 2])
        shared = common_prefixes(array, np.array(want), starts, 5000)
        for before, at in zip(want, want[1:]):
            n = 0
            while max(at, before) + n < len(text) and text[at + n] == text[before + n]:
                n += 1
            assert shared[at] == n
    assert len(suffix_array(np.zeros(0, np.uint8))) == 0


def test_last_part_that_fills_its_keys():
    """The text ends with a part of as many signs as a key holds, which longer parts begin with."""
    rng = random.Random(3)
    part = b"afedcb"  # one rising place
    tails = [a + b for a in (b"a", b"bb", b"ba", b"b", b"ab", b"") for b in (b"z", b"y", b"")]
    texts = [b"afedcbzafedcbbbafedcbbbafedcbbafedcbaafedcb"]
    for _ in range(200):
        texts.append(b"".join(part + rng.choice(tails) for _ in range(rng.randrange(2, 8))) + part * rng.randrange(1, 3))
    for text in texts:
        want = sorted(range(len(text)), key=lambda i: text[i:])
        assert suffix_array(np.frombuffer(text, np.uint8)).tolist() == want


def test_equal_windows_have_equal_names():
    rng = random.Random(2)
    for _ in range(40):
        texts = [random_bytes(rng) for _ in range(3)]
        ends = np.cumsum([len(t) for t in texts])
        text = b"".join(texts)
        names, start, count, again = runs(np.frombuffer(text, np.uint8), ends, Powers(), 12, 4)
        by_window, weight = {}, Counter()
        covered = []
        for name, s, c, a in zip(names.tolist(), start.tolist(), count.tolist(), again.tolist()):
            weight[name] += 2 if a else 1
            for at in range(s, s + c):
                covered.append(at)
                assert by_window.setdefault(text[at : at + 12], name) == name
        valid = [i for i in range(len(text)) if any(e - len(t) <= i <= e - 12 for e, t in zip(ends, texts))]
        assert covered == valid
        for window, n in Counter(text[i : i + 12] for i in valid).items():
            assert n == 1 or weight[by_window[window]] > 1


def brute(rows, length):
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    found = []
    for (key, _), t in zip(rows, texts):
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = True
        edges = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(int)))
        kept = bytes(b for b, g in zip(t, gone) if not g)
        found.append((key, len(t), [tuple(p) for p in edges.reshape(-1, 2).tolist()], kept))
    return sorted(found, key=repr)


def got(spark, rows, **options):
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id int, text string, name int, bytes string")
    found = remove_repeats(docs.repartition(3), **options).collect()
    return sorted(
        ((r.doc_id, r.n_bytes, [tuple(s) for s in r.spans], bytes(r.kept)) for r in found), key=repr
    )


def table(seed, n):
    rng = random.Random(seed)
    passage = "".join(rng.choices("abcdefgh ", k=90))
    rows = []
    for i in range(n):
        parts = ["".join(rng.choices("abcdefghé ", k=rng.randrange(0, 120)))]
        if rng.random() < 0.6:
            low = rng.randrange(40)
            parts.insert(rng.randrange(2), passage[low : low + rng.randrange(50)])
        rows.append((i, "".join(parts)))
    rows += [(100, rows[3][1]), (100, rows[3][1]), (None, rows[4][1]), (101, None), (102, ""), (102, "ab")]
    rows += [(103, "=" * 9000), (104, "xy" * 40), (105, "é" * 60 + "q")]
    return rows


@pytest.mark.parametrize("hot", [8192, 2])
def test_remove_repeats(spark, hot):
    rows = table(hot, 40)
    assert got(spark, rows, length=14, gram=5, hot=hot) == brute(rows, 14)


def test_long_strings(spark):
    rng = random.Random(9)
    words = ["".join(rng.choices("abcdefghijklm", k=rng.randrange(1, 9))) for _ in range(500)]
    shared = " ".join(rng.choices(words, k=150))
    rows = [(i, " ".join(rng.choices(words, k=rng.randrange(300)))) for i in range(12)]
    rows += [(20 + i, f"{rows[i][1]} {shared[i * 30:]} {rows[i + 1][1]}") for i in range(8)]
    rows += [(40, shared[:399]), (41, shared[:400]), (42, shared[3:403])]
    assert got(spark, rows) == brute(rows, 400)


@pytest.mark.parametrize("length, gram", [(14, 5), (400, 64)])
def test_blocks_as_long_as_a_name_reaches(spark, length, gram):
    rng = random.Random(length)
    rows = []
    for i, size in enumerate(range(length - gram - 1, length - gram + 5)):
        block = "".join(rng.choices("abcdefghijklmnop", k=size - 1)) + "\n"
        rows += [(i, block * 3), (10 + i, "x" + block.upper() * 5 + "y")]
    want = brute(rows, length)
    assert all(spans for _, _, spans, _ in want)
    assert got(spark, rows, length=length, gram=gram) == want


def test_empty_table(spark):
    assert got(spark, []) == []
    assert got(spark, [(1, None)]) == [(1, 0, [], b"")]
