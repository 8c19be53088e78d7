"""Column functions on token strings.

A chunk's tokens are held as one string with one sign for each token, so a merge is the
built-in `replace` and ids never leave the JVM. The sign of an id is the code point of that
number, or, since surrogates are no characters, of a number 2,048 higher from 55,296 up;
`MAX_VOCAB` ids can be written so. Token strings may hold NUL and are for intermediate
tables only; results carry id arrays.
"""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

SURROGATES = 0xD800  # the first of them
GAP = 0x800
BORDER = chr(0x10FFFF)  # marks cuts; no token has this sign
MAX_VOCAB = 0x10FFFF - GAP

MERGE_LIST = "array<struct<pair:string,new:string>>"


def sign(token_id: int) -> str:
    """The sign of an id in a token string."""
    return chr(token_id if token_id < SURROGATES else token_id + GAP)


def sign_id(sign: Column) -> Column:
    """The id of the first sign of a string."""
    code = F.ascii(sign)
    return F.when(code < SURROGATES, code).otherwise(code - GAP)


def byte_tokens(text: Column) -> Column:
    """Token string of a text's UTF-8 bytes, ids 0-255."""
    return F.decode(text.cast("binary"), "ISO-8859-1")


def token_ids(tokens: Column) -> Column:
    """Id array of a token string; empty for the empty string."""
    return F.transform(F.array_remove(F.split(tokens, ""), ""), sign_id)


def adjacent_pairs(tokens: Column) -> Column:
    """All overlapping two-token slices, in linear time whatever the length."""
    return F.regexp_extract_all(tokens, F.lit("(?s)(?=(..))"), F.lit(1))


def pair_left(pair: Column) -> Column:
    return sign_id(F.substring(pair, 1, 1))


def pair_right(pair: Column) -> Column:
    return sign_id(F.substring(pair, 2, 1))


def merge_literal(merges: list[tuple[str, str]]) -> Column:
    """Constant array of (pair, new token), folded by the optimizer."""
    rows = [{"pair": pair, "new": new} for pair, new in merges]
    return F.from_json(F.lit(json.dumps(rows)), MERGE_LIST)


def apply_merges(tokens: Column, merges: Column) -> Column:
    """Apply merges in order; each replaces left to right without overlap."""
    return F.aggregate(merges, tokens, lambda acc, m: F.replace(acc, m["pair"], m["new"]))
