"""Quality rules: clean line by line first, then reject documents that lost too much."""

from __future__ import annotations

import re
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bytegrain.llm.arrow import ddl, slices

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
SYMBOLS = "#*$%&|<>"

#: A word that ends in two or more of these is shouted.
SHOUT = re.compile(r"[!?]{2,}(?=[\x20\x09-\x0D]|\Z)")
#: Signs between the entries of a menu or of a path of pages.
SEPARATOR = re.compile(r"(?<=[\x20\x09])[|>»›·•](?=[\x20\x09])")
MENU = re.compile(
    r"(?:home|menu|login|log in|sign in|sign up|register|search|next|previous|prev|back|"
    r"back to top|skip to content|read more|more|share|tweet|contact|contact us|about|about us|"
    r"sitemap|faq|help|subscribe)[.:!]?\Z",
    re.IGNORECASE,
)
BOILERPLATE = re.compile(
    r"all rights reserved|copyright (?:\(c\)|©|[12][0-9]{3})|©|terms of (?:use|service)|"
    r"privacy policy|cookie policy|(?:we|site|website) uses? cookies|enable javascript|"
    r"javascript is disabled|lorem ipsum|licensed under|released under the|"
    r"unsubscribe|click here",
    re.IGNORECASE,
)

SYMBOL_SHARE = 0.1  # of the visible characters of a line
SHOUT_SHARE = 0.3  # of the words of a line
STUTTER_SHARE = 0.5  # of the words of a line, equal to the word before
SEPARATORS = 3  # in a line
LOST_SHARE = 0.5  # of the visible characters of a document
WINDOW = 8
LEAST_WORDS = 20
REPEAT_PERCENT = 30


def line_fails(line: str, words: list[str], visible: int) -> bool:
    """Punctuation, navigation and boilerplate rules; a line has at least one word."""
    if sum(map(line.count, SYMBOLS)) > SYMBOL_SHARE * visible:
        return True
    if ("!!" in line or "?" in line) and len(SHOUT.findall(line)) > SHOUT_SHARE * len(words):
        return True
    if sum(map(eq, words, words[1:])) > STUTTER_SHARE * len(words):
        return True
    if len(SEPARATOR.findall(line)) >= SEPARATORS:
        return True
    if len(words) <= 4 and MENU.match(line.strip(SPACES)):
        return True
    return BOILERPLATE.search(line) is not None


def visible_chars(text: str) -> int:
    return len(text) - sum(map(text.count, SPACES))


def clean_lines(text: str) -> tuple[str, int, int, int]:
    """The text without failed lines; lines removed, visible characters removed, and lines
    with a word that equal an earlier line. Such a line fails as boilerplate, too."""
    seen: set[str] = set()
    kept, removed, lost, repeated = [], 0, 0, 0
    for line in text.split("\n"):
        visible = visible_chars(line)
        if visible:
            again = line in seen
            repeated += again
            seen.add(line)
            words = WORD.findall(line)
            if again or line_fails(line, words, visible):
                removed += 1
                lost += visible
                continue
        kept.append(line)
    return "\n".join(kept), removed, lost, repeated


def repeated_window_words(words: list[list[str]], window: int = WINDOW) -> list[int]:
    """For each list, its words inside windows that it holds twice or more.

    Exact: windows of one word are numbered, then windows of 2, 4, 8 by pairs of numbers.
    """
    counts = np.array(list(map(len, words)), np.int64)
    total = int(counts.sum())
    if total == 0:
        return [0] * len(words)
    numbers: dict[str, int] = {}
    flat = np.fromiter(
        (numbers.setdefault(w, len(numbers)) for row in words for w in row), np.int64, total
    )
    row = np.repeat(np.arange(len(words)), counts)
    ends = np.cumsum(counts)
    width = 1
    while width < window:
        step = min(width, window - width)
        after = np.zeros_like(flat)
        after[: total - step] = flat[step:] + 1  # what crosses the end is not used below
        flat = np.unique(flat * (int(flat.max()) + 2) + after, return_inverse=True)[1]
        width += step
    valid = np.arange(total) + window <= ends[row]
    at = np.flatnonzero(valid)
    if len(at) == 0:
        return [0] * len(words)
    _, inverse, times = np.unique(
        flat[at] * len(words) + row[at], return_inverse=True, return_counts=True
    )
    at = at[times[inverse] > 1]
    starts = np.bincount(at, minlength=total + 1)
    covered = np.cumsum(starts - np.bincount(at + window, minlength=total + 1))[:-1] > 0
    return np.bincount(row, covered, len(words)).astype(np.int64).tolist()


def line_first_quality(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Clean every text line by line, then judge it; one row for each row.

    Returns (key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    kept, cleaned, lines_removed, chars_removed). A line fails if more than a tenth of its
    visible characters are symbols, more than 3 in 10 words are shouted, more than half of its
    words repeat the word before, it holds three menu separators, it is a short menu entry, it
    holds a boilerplate phrase, or it repeats an earlier line. A document is kept if it passes the base rules and its failed lines held at
    most half of its visible characters. Null and empty texts have no words and are not kept.
    Rows with null or repeated keys are kept apart, other columns are not read. Narrow.
    """

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_text"):
                texts = [text or "" for text in part.column("_text").to_pylist()]
                words = list(map(WORD.findall, texts))
                cleaned, removed, lost, repeated = zip(*map(clean_lines, texts))
                columns = [
                    part.column("_key"),
                    pa.array(map(len, words), pa.int64()),
                    pa.array(map(visible_chars, texts), pa.int64()),
                    pa.array([sum(map(text.count, SYMBOLS)) for text in texts], pa.int64()),
                    pa.array(repeated, pa.int64()),
                    pa.array(repeated_window_words(words), pa.int64()),
                    pa.array(cleaned, pa.string()),
                    pa.array(removed, pa.int64()),
                    pa.array(lost, pa.int64()),
                ]
                yield pa.record_batch(columns, NAMES)

    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    schema = f"_key {ddl(docs, key)}, {', '.join(f'{n} {t}' for n, t in FIELDS.items())}"
    failed = (F.col("n_words") < LEAST_WORDS) | (
        100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words")
    )
    kept = F.col("chars_removed") <= LOST_SHARE * F.col("word_chars")
    return rows.mapInArrow(judge, schema).select(
        F.col("_key").alias(key),
        *list(FIELDS)[:5],
        failed.alias("base_failed"),
        (~failed & kept).alias("kept"),
        *list(FIELDS)[5:],
    )


FIELDS = {
    "n_words": "bigint",
    "word_chars": "bigint",
    "n_symbols": "bigint",
    "n_dup_lines": "bigint",
    "n_repeat_words": "bigint",
    "cleaned": "string",
    "lines_removed": "bigint",
    "chars_removed": "bigint",
}
NAMES = ["_key", *FIELDS]
