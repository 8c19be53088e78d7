"""Quality rules against a word-by-word count."""

import random
from collections import Counter

from bytegrain.llm import quality_rules as qr
from bytegrain.llm.quality_rules import line_first_quality

GOOD = "It was a long and quiet day in the house by the sea, and all of them had gone out early."


def base(text):
    """By the definition, one word and one line at a time."""
    text = text or ""
    words, word = [], ""
    for c in text + " ":
        if c in " \t\n\x0b\x0c\r":
            words += [word] if word else []
            word = ""
        else:
            word += c
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often = Counter(windows)
    marked = {i + j for i, w in enumerate(windows) if often[w] > 1 for j in range(8)}
    lines = [line for line in text.split("\n") if line.strip(" \t\x0b\x0c\r")]
    failed = len(words) < 20 or 100 * len(marked) > 30 * len(words)
    return (
        len(words),
        sum(map(len, words)),
        sum(c in "#*$%&|<>" for c in text),
        len(lines) - len(set(lines)),
        len(marked),
        failed,
    )


def texts():
    rng = random.Random(5)
    rows = [None, "", " \n\t ", "one", "a b c d e f g h", "a b c d e f g h a b c d e f g h"]
    rows += ["x\x1cy\x1fz é nbsp %&| <b>", f"{GOOD}\n{GOOD}\n{GOOD}", "w " * 5000]
    for size in (7, 8, 9, 30, 80, 400):
        for letters in ("a", "ab", "abcde"):
            rows.append(" ".join(rng.choice(letters) for _ in range(size)))
    rows.append(" ".join(str(i % 977) for i in range(200_000)))
    return rows


def test_base_columns(spark):
    rows = [(None if i == 4 else i % 20, t, i) for i, t in enumerate(texts())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept long")
    got = line_first_quality(docs).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert sorted(((r.doc_id, *[r[n] for n in names]) for r in got), key=repr) == sorted(
        ((key, *base(text)) for key, text, _ in rows), key=repr
    )
    assert not any(r.kept and r.base_failed for r in got)


def test_lines(spark):
    other = "Nobody had told her that the boat would leave before noon, so she walked on slowly."
    rows = {
        "clean": (f"{GOOD}\n{other}", True, f"{GOOD}\n{other}"),
        "menu": (f"Home | News | Shop | Help\n{GOOD}\n{other}", True, f"{GOOD}\n{other}"),
        "entry": (f"Back to top\n{GOOD}\n\n{other}", True, f"{GOOD}\n\n{other}"),
        "notice": (f"{GOOD}\n{other}\nAll rights reserved.", True, f"{GOOD}\n{other}"),
        "twice": (f"{GOOD}\n{other}\n{GOOD[:27]}\n{GOOD[:27]}", True, f"{GOOD}\n{other}\n{GOOD[:27]}"),
        "signs": (GOOD.replace(" ", " %%% ") + f"\n{other[:40]}", False, other[:40]),
        "shout": (GOOD.replace(" ", "!! ") + f"\n{other[:40]}", False, other[:40]),
        "stutter": (" ".join(w for w in GOOD.split() for _ in range(4)) + f"\n{other[:40]}", False, other[:40]),
        "question": (f"{GOOD}??\n{other}!!", True, f"{GOOD}??\n{other}!!"),
    }
    docs = spark.createDataFrame([(k, v[0]) for k, v in rows.items()], "doc_id string, text string")
    got = {r.doc_id: (r.kept, r.cleaned) for r in line_first_quality(docs).collect()}
    assert got == {k: v[1:] for k, v in rows.items()}


def test_windows_of_any_width():
    words = ["a b c a b c x".split(), [], "b c".split()]
    assert qr.repeated_window_words(words, 3) == [6, 0, 0]
    assert qr.repeated_window_words(words, 2) == [6, 0, 0]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert line_first_quality(docs).collect() == []
