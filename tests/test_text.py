import sys

import pytest
import regex
from pyspark.sql import functions as F

from bytegrain.functions.text import STR_SPACE_CHARS, keep_draw, pretokenize, strip
from bytegrain.functions.tokens import MAX_VOCAB, adjacent_pairs, byte_tokens, sign, token_ids

ADVERSARIAL = [
    "two  spaces   here",
    "line\r\nbreak \r\n  indented",
    "trailing   ",
    "next\x85line\xa0nbsp em",
    "file\x1csep",
    "it'ſ DON'T We'Ll",
    "café éé",
    "👩‍👩‍👧 emoji 👍🏽!",
    "١٢٣٤٥ १२३४",
    "日本語の文章、句読点。",
    "snake_case __init__",
    " \t\n 　 ",
    "\n\n\nfoo\n\n",
    "tab\t\tword",
    "''s 're x's",
    "a" * 20_000,
    " " * 20_000 + "x",
    "",
]


def chunks_of(spark, texts, pattern):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    rows = df.select("i", pretokenize(F.col("t"), pattern).alias("c")).orderBy("i").collect()
    return [r.c for r in rows]


@pytest.mark.parametrize(
    "text,want",
    [
        # Contractions in either case, digits in threes, letters of any script.
        ("don't", ["don", "'t"]),
        ("DON'T", ["DON", "'T"]),
        ("12345", ["123", "45"]),
        ("2024", ["202", "4"]),
        ("café", ["café"]),
        # Own inputs.
        ("rain over hills", ["rain", " over", " hills"]),
        ("wait; really?!", ["wait", ";", " really", "?!"]),
        ("one\ntwo", ["one", "\n", "two"]),
        ("9 ab 10", ["9", " ab", " ", "10"]),
        ("été мир", ["été", " мир"]),
        ("", []),
    ],
)
def test_cl100k_chunks(spark, text, want):
    assert chunks_of(spark, [text], "cl100k") == [want]


def test_cl100k_keeps_every_character(spark):
    for text, got in zip(ADVERSARIAL, chunks_of(spark, ADVERSARIAL, "cl100k")):
        assert "".join(got) == text


def test_patterns_equal_a_second_regex_engine(spark):
    cl100k = regex.compile(
        r"(?i:'s|'t|'re|'ve|'m|'ll|'d)|[^\r\n\p{L}\p{N}]?\p{L}+|\p{N}{1,3}"
        r"| ?[^\p{White_Space}\p{L}\p{N}]+[\r\n]*|\p{White_Space}*[\r\n]+"
        r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+",
        regex.V1,
    )
    assert chunks_of(spark, ADVERSARIAL, "cl100k") == [cl100k.findall(t) for t in ADVERSARIAL]


def test_legacy_drops_what_it_cannot_match(spark):
    (got,) = chunks_of(spark, ["don't naïve_x 12345  ok..\n"], "legacy")
    assert got == ["don", "'t", " na", "ve", "x", " 12345", " ", " ok", "..", "\n"]


def test_unknown_pattern(spark):
    with pytest.raises(ValueError):
        pretokenize(F.col("t"), "other")


def test_strip_equals_python(spark):
    assert set(STR_SPACE_CHARS) == {c for c in map(chr, range(sys.maxunicode)) if c.isspace()}
    texts = [STR_SPACE_CHARS + "a b" + STR_SPACE_CHARS, STR_SPACE_CHARS, "", "x​", "﻿ y "]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r.s for r in df.select(strip(F.col("t")).alias("s")).collect()] == [
        t.strip() for t in texts
    ]


def test_draw_is_stateless_and_near_its_rate(spark):
    ids = spark.range(20_000)
    kept = {r.id for r in ids.where(keep_draw(F.col("id"), 0.2)).collect()}
    again = {r.id for r in ids.repartition(7).where(keep_draw(F.col("id"), 0.2)).collect()}
    assert kept == again and 3800 < len(kept) < 4200
    assert kept != {r.id for r in ids.where(keep_draw(F.col("id"), 0.2, seed=1)).collect()}
    assert ids.where(keep_draw(F.col("id"), 1.0)).count() == 20_000
    for bad in (0.0, 1.5, -1):
        with pytest.raises(ValueError):
            keep_draw(F.col("id"), bad)


def test_token_strings(spark):
    df = spark.createDataFrame([("é\x00z",), ("",)], "t string")
    rows = df.select(token_ids(byte_tokens(F.col("t"))).alias("ids")).collect()
    assert [r.ids for r in rows] == [[195, 169, 0, 122], []]
    ids = [50303, 528, 97, 0xD7FF, 0xD800, 0xDFFF, 0xE000, 0xFFFF, 0x10000, MAX_VOCAB - 1]
    df = spark.createDataFrame([("".join(map(sign, ids)),)], "t string")
    assert df.select(token_ids(F.col("t")).alias("i")).first().i == ids


def test_pairs_of_long_and_special_strings(spark):
    text = "ab\n.]^-\\" * 3000
    df = spark.createDataFrame([(text,)], "t string")
    row = df.select(adjacent_pairs(F.col("t")).alias("p")).first()
    assert row.p == [text[i : i + 2] for i in range(len(text) - 1)]
