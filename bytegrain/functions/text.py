"""Column functions on raw document text: trimming, sampling, pre-token splitting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Whitespace classes (Java \s is ASCII only, so they are written out)
# and the two pre-token patterns, alternatives in matching order.
UNICODE_SPACE = (
    r"\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
)
STR_SPACE = UNICODE_SPACE + r"\x1C-\x1F"
STR_SPACE_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0 "
    "           "
    "    　"
)
CL100K_PATTERN = (
    r"(?iu:'s|'t|'re|'ve|'m|'ll|'d)"
    r"|[^\r\n\p{L}\p{N}]?\p{L}+"
    r"|\p{N}{1,3}"
    r"| ?[^" + UNICODE_SPACE + r"\p{L}\p{N}]+[\r\n]*"
    r"|[" + UNICODE_SPACE + r"]*[\r\n]+"
    r"|[" + UNICODE_SPACE + r"]+(?![^" + UNICODE_SPACE + r"])"
    r"|[" + UNICODE_SPACE + r"]+"
)
LEGACY_PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d"
    r"| ?[a-zA-Z]+"
    r"| ?[0-9]+"
    r"| ?[^" + STR_SPACE + r"\p{L}\p{N}_]+"
    r"|[" + STR_SPACE + r"]+(?![^" + STR_SPACE + r"])"
    r"|[" + STR_SPACE + r"]+"
)

PATTERNS = {"cl100k": CL100K_PATTERN, "legacy": LEGACY_PATTERN}


def pattern_text(pattern: str) -> str:
    if pattern not in PATTERNS:
        raise ValueError(f"pattern must be one of {sorted(PATTERNS)}, not {pattern!r}")
    return PATTERNS[pattern]


def strip(text: Column) -> Column:
    """Trim Unicode whitespace at both ends."""
    return F.btrim(text, F.lit(STR_SPACE_CHARS))


def keep_draw(key: Column, fraction: float, seed: int = 42) -> Column:
    """True for a `fraction` of keys: a stateless draw from the first 32 bits of an MD5.

    The draw depends on the key and the seed alone, so it is the same on every
    partitioning, after a retry and in a resumed run.
    """
    if not 0.0 < fraction <= 1.0:
        raise ValueError(f"fraction must be in (0, 1], not {fraction}")
    if fraction == 1.0:
        return F.lit(True)
    digest = F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")).cast("binary"))
    draw = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")
    return draw < F.lit(fraction * 4294967296.0)


def pretokenize(text: Column, pattern: str = "cl100k") -> Column:
    """Array of the pre-token chunks of a text, in text order."""
    return F.regexp_extract_all(text, F.lit(pattern_text(pattern)), F.lit(0))


def pretokenize_joined(text: Column, last: Column, pattern: str = "cl100k") -> Column:
    """Chunks of a stripped document as they come out when its shard's documents
    are joined by a blank line. `last` marks the shard's last document.

    The legacy pattern looks one character past the blank line, so a letter is
    put behind it and the chunk of that letter is dropped again.
    """
    if pattern == "cl100k":
        return pretokenize(F.when(last, text).otherwise(F.concat(text, F.lit("\n\n"))), pattern)
    chunks = pretokenize(F.concat(text, F.lit("\n\nX")), pattern)
    return F.when(last, pretokenize(text, pattern)).otherwise(
        F.slice(chunks, F.lit(1), F.size(chunks) - 1)
    )
