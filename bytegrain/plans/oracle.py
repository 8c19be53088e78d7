"""Building blocks of the check SQL, written for DuckDB."""

from __future__ import annotations

# Fixed values, written out here so that a slip in the package can't hide: whitespace, the two
# pre-token patterns in this dialect, and where the merges of each layout begin.
UNICODE_SPACE = (
    r"\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
)
STR_SPACE_CODES = (
    *range(9, 14), *range(28, 33), 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288
)
MERGES_START = {"spec": 528, "compact": 260}

# RE2 has no look-ahead. A marker before the last blank of every run that meets a
# non-blank makes the run split where the look-ahead would; no test text holds U+E000.
_MARK = chr(0xE000)
_INNER_SPACE = UNICODE_SPACE.replace(r"\n", "").replace(r"\r", "")
_STR_SPACE = UNICODE_SPACE + r"\x1C-\x1F"
_CL100K = (
    r"(?i:''s|''t|''re|''ve|''m|''ll|''d)"
    r"|[^\r\n\p{L}\p{N}\x{E000}]?\p{L}+"
    r"|\p{N}{1,3}"
    r"| ?[^" + UNICODE_SPACE + r"\p{L}\p{N}\x{E000}]+[\r\n]*"
    r"|[" + UNICODE_SPACE + r"]*[\r\n]+"
    r"|[" + UNICODE_SPACE + r"]+"
)
_LEGACY = (
    r"''s|''t|''re|''ve|''m|''ll|''d| ?[a-zA-Z]+| ?[0-9]+"
    r"| ?[^" + _STR_SPACE + r"\p{L}\p{N}_\x{E000}]+"
    r"|[" + _STR_SPACE + r"]+"
)


def chunks(text: str, pattern: str = "cl100k") -> str:
    """Expression: the chunk list of a text expression."""
    if pattern == "cl100k":
        blank, last, body = UNICODE_SPACE, _INNER_SPACE, _CL100K
    else:
        blank, last, body = _STR_SPACE, _STR_SPACE, _LEGACY
    marked = (
        f"regexp_replace({text}, '([{blank}])([{last}])([^{blank}])', '\\1{_MARK}\\2\\3', 'g')"
    )
    return f"regexp_extract_all({marked}, '{body}')"


def stripped(text: str) -> str:
    codes = " || ".join(f"chr({code})" for code in STR_SPACE_CODES)
    return f"trim({text}, {codes})"


def draw(key: str, seed: int = 42) -> str:
    return f"('0x' || substr(md5('{seed}:' || {key}), 1, 8))::BIGINT"


def hex_bytes(text: str) -> str:
    """Expression: the byte values of a text expression, as a list."""
    code = f"hex(encode({text}))"
    return (
        f"list_transform(range(0, (length({code}) / 2)::BIGINT), "
        f"lambda i: ('0x' || substr({code}, (2 * i + 1)::INT, 2))::INT)"
    )


def byte_seq(text: str) -> str:
    return f"array_to_string(list_transform({hex_bytes(text)}, lambda b: chr(b)), '')"


def pairs(seq: str) -> str:
    return f"list_transform(range(1, length({seq})), lambda i: substr({seq}, i::INT, 2))"


def ids(seq: str) -> str:
    """Expression: comma-joined ids of a token string."""
    codes = f"list_transform(range(1, length({seq}) + 1), lambda i: unicode(substr({seq}, i::INT, 1)))"
    return f"array_to_string({codes}, ',')"


def words(
    table: str = "documents",
    text: str = "text",
    pattern: str = "cl100k",
    extra: str | None = None,
    order: str | None = None,
) -> str:
    """CTEs `occ` (one row per chunk occurrence) and `words`. `extra` names a second
    table whose chunks enter with frequency 0, to be segmented but not trained on."""
    first = ", min((k, pos)) AS first" if order else ""
    key = order or "0"
    unseen = (
        f"UNION ALL SELECT unnest({chunks('text', pattern)}), 0, 0, 0 FROM {extra}" if extra else ""
    )
    return f"""occ AS (
  SELECT unnest({chunks(text, pattern)}) AS chunk, 1 AS one, {key} AS k,
         generate_subscripts({chunks(text, pattern)}, 1) - 1 AS pos
  FROM {table} {unseen}),
words AS MATERIALIZED (
  SELECT chunk, sum(one)::BIGINT AS freq{first} FROM occ GROUP BY chunk)"""


def training(n_merges: int, layout: str = "spec", tie: str = "id") -> str:
    """CTEs `state` (tokens of every word after each step), `merged` and `final`."""
    start = MERGES_START[layout]
    if tie == "id":
        carried, count, rank = "", "", "n DESC, pair"
    else:
        carried = ", first"
        count = ", min((first, i)) AS place"
        rank = "n DESC, place"
    place = ", unnest(range(1, length(seq))) AS i" if tie == "first" else ""
    return f"""state AS (
  SELECT 0 AS step, chunk, freq{carried}, {byte_seq('chunk')} AS seq,
         NULL::VARCHAR AS pair, NULL::BIGINT AS n FROM words
  UNION ALL
  SELECT s.step + 1, s.chunk, s.freq{carried.replace('first', 's.first')},
         replace(s.seq, b.pair, chr({start} + s.step)), b.pair, b.n
  FROM state s, (
    SELECT pair, n FROM (
      SELECT pair, sum(freq)::BIGINT AS n{count} FROM (
        SELECT freq{carried}, unnest({pairs('seq')}) AS pair{place}
        FROM state WHERE length(seq) > 1 AND freq > 0)
      GROUP BY pair)
    ORDER BY {rank} LIMIT 1) b
  WHERE s.step < {n_merges}),
merged AS (
  SELECT step AS rank, unicode(substr(any_value(pair), 1, 1)) AS left_id,
         unicode(substr(any_value(pair), 2, 1)) AS right_id,
         {start} + step - 1 AS new_id, any_value(n) AS freq
  FROM state WHERE step > 0 GROUP BY step),
final AS (SELECT chunk, seq FROM state WHERE step = (SELECT max(step) FROM state))"""


def encoded(
    table: str = "documents", key: str = "doc_id", text: str = "text", pattern: str = "cl100k"
) -> str:
    """CTE `encoded`: (key, ids as comma-joined string, n_tokens) of every text."""
    return f"""pieces AS (
  SELECT {key}, unnest({chunks(text, pattern)}) AS chunk,
         generate_subscripts({chunks(text, pattern)}, 1) AS pos FROM {table}),
coded AS (SELECT chunk, {ids('seq')} AS ids, length(seq) AS len FROM final),
encoded AS (
  SELECT d.{key}, coalesce(e.ids, '') AS ids, coalesce(e.n_tokens, 0)::BIGINT AS n_tokens
  FROM {table} d LEFT JOIN (
    SELECT {key}, string_agg(ids, ',' ORDER BY pos) AS ids, sum(len) AS n_tokens
    FROM pieces JOIN coded USING (chunk) GROUP BY {key}) e USING ({key}))"""


def with_recursive(*ctes: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(ctes)
