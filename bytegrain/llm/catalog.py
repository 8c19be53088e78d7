"""Registered queries of the training-data operators and their check SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bytegrain.llm.bpe import encode_decode
from bytegrain.llm.conversations import repair_plan, repaired_digests
from bytegrain.llm.decontamination import contamination
from bytegrain.llm.fingerprints import fingerprint_edits
from bytegrain.llm.fixity import compare, digests, inventory, manifest, warc_record
from bytegrain.llm.jaccard_join import jaccard_components
from bytegrain.llm.lm_scoring import score_documents
from bytegrain.llm.manifest import audit_rows
from bytegrain.llm.mixing import cyclic_weights, mix
from bytegrain.llm.quality_rules import BOILERPLATE, MENU, line_first_quality
from bytegrain.llm.substring_dedup import remove_repeats
from bytegrain.llm.token_counts import token_counts
from bytegrain.llm.toxicity import fold, score_toxicity, train_toxicity
from bytegrain.session import Stage

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

BYTE_BPE = "byte_bpe_50k.json"


def query(name: str, oracle: str | None = None):
    def register(function):
        QUERIES[name] = function
        if oracle is not None:
            ORACLES[name] = oracle
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_bpe")
def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))
    return coded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


MIX_ORACLE = r"""
WITH RECURSIVE rows AS (
  SELECT doc_id, source,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 9) AS BIGINT) AS draw
  FROM documents
), sized AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM rows GROUP BY source
), weighted AS (
  SELECT *, [5, 2, 1][1 + (row_number() OVER (ORDER BY source COLLATE "C" NULLS LAST) - 1) % 3] AS weight
  FROM sized
), levels(round, level) AS (
  SELECT 0, (SELECT CAST(sum(source_size) AS DOUBLE) / sum(weight) FROM weighted)
  UNION ALL
  SELECT round + 1,
    (SELECT (sum(source_size) - sum(CASE WHEN weight * level >= 3 * source_size THEN 3 * source_size ELSE 0 END))
            / CAST(sum(CASE WHEN weight * level >= 3 * source_size THEN 0 ELSE weight END) AS DOUBLE)
     FROM weighted)
  FROM levels WHERE round < 40
), shared AS (
  SELECT source, source_size,
         least(weight * (SELECT max(level) FROM levels), 3.0 * source_size) AS target
  FROM weighted
), wholes AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 3) ELSE 0 END AS whole
  FROM shared
), running AS (
  SELECT r.*, w.source_size, w.target, w.whole, w.target - w.whole * w.source_size AS rest,
         sum(size) OVER (PARTITION BY r.source ORDER BY draw) AS upto,
         sum(size) OVER (PARTITION BY r.source, draw) AS same
  FROM rows r JOIN wholes w ON r.source IS NOT DISTINCT FROM w.source
)
SELECT doc_id, source, size, source_size, target,
       CAST(whole AS BIGINT) + CASE WHEN rest > 0 AND (upto < rest OR
         (upto - same < rest AND upto - rest <= rest - (upto - same))) THEN 1 ELSE 0 END AS copies,
       copies * size AS taken
FROM running
"""


@query("op2_mixing", MIX_ORACLE)
def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mix(docs, cyclic_weights(docs, (5, 2, 1)))


@query("op3_token_counts")
def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))


FIXITY_ORACLE = r"""
WITH records AS (
  SELECT page_id, strlen(html) AS n, fate, CAST(concat(
    'WARC/1.1', chr(13), chr(10), 'WARC-Type: response', chr(13), chr(10),
    'WARC-Record-ID: <urn:page:', page_id, '>', chr(13), chr(10),
    'WARC-Target-URI: ', url, chr(13), chr(10), 'Content-Type: text/html', chr(13), chr(10),
    'Content-Length: ', strlen(html), chr(13), chr(10), chr(13), chr(10),
    html, chr(13), chr(10), chr(13), chr(10)) AS VARCHAR) AS record
  FROM (SELECT *, CAST('0x' || substr(md5(CAST(page_id AS VARCHAR)), 1, 8) AS BIGINT) % 101 AS fate
        FROM pages)
), archived AS (
  SELECT *, (row_number() OVER (ORDER BY page_id) - 1) // 4096 AS archive FROM records
), placed AS (
  SELECT *, CAST(sum(strlen(record)) OVER w AS BIGINT) AS stop,
         CAST(sum(strlen(record)) OVER (PARTITION BY archive) AS BIGINT) AS size
  FROM archived
  WINDOW w AS (PARTITION BY archive ORDER BY page_id ROWS UNBOUNDED PRECEDING)
)
SELECT page_id, archive, stop - strlen(record) AS start_offset, stop AS stop_offset,
       sha256(record) AS sha256,
       CASE WHEN fate = 2 THEN 'missing' WHEN fate = 3 THEN 'moved' WHEN fate < 2 THEN 'changed'
            ELSE 'intact' END AS status
FROM placed
UNION ALL
SELECT -1 - page_id, archive, 2 * size + stop - strlen(record), 2 * size + stop, sha256(record), 'extra'
FROM placed WHERE fate = 4
"""


def damaged_replica(records: DataFrame, placed: DataFrame) -> DataFrame:
    """The inventory of a replica in which of 101 records one is altered at its end, one cut
    short, one lost, one moved behind its archive, and one held a second time under an id that
    the records lack. Only digests are joined with places."""
    drawn = F.conv(F.substring(F.md5(F.col("page_id").cast("string")), 1, 8), 16, 10).cast("bigint")
    fate = F.pmod(drawn, F.lit(101))
    altered = F.concat(F.expr("left(record, length(record) - 1)"), F.lit("?"))
    cut = F.expr("left(record, length(record) - 7)")
    damaged = F.when(fate == 0, altered).when(fate == 1, cut).otherwise(F.col("record"))
    held = digests(
        records.where(fate != 2).select("page_id", damaged.alias("record"), fate.alias("fate")),
        "page_id", "record", "fate",
    )
    size = F.max("_stop").over(Window.partitionBy("_archive")).alias("size")  # of at most 4,096 rows
    places = placed.select(F.col("_key").alias("id"), F.col("_archive").alias("archive"), "_start", size)
    copies = F.array(
        F.struct(F.col("_key").alias("key"), (F.col("_start") + F.when(F.col("fate") == 3, F.col("size")).otherwise(0)).alias("start")),
        F.struct((-1 - F.col("_key")).cast(held.schema["_key"].dataType).alias("key"), (F.col("_start") + 2 * F.col("size")).alias("start")),
    )
    taken = F.slice(copies, 1, F.when(F.col("fate") == 4, 2).otherwise(1))
    rows = held.join(places, F.col("_key") == F.col("id")).select(
        "_digest", "_bytes", "archive", F.explode_outer(taken).alias("copy")
    )
    return inventory(
        rows.select(F.col("copy.key").alias("_key"), "_digest", "_bytes", "archive", F.col("copy.start").alias("start_offset"))
    )


@query("op4_warc_fixity", FIXITY_ORACLE)
def op4_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    record = warc_record(F.col("page_id"), F.col("url"), F.col("html"))
    records = pages.select("page_id", record.alias("record"))
    placed = Stage(manifest(records), "places").df
    return compare(placed, damaged_replica(records, placed))


TOXIC = 0.7


@query("op5_toxicity")
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = train_toxicity(docs, labels.where(fold(F.col("doc_id")) != 1))
    return score_toxicity(docs, model).select(
        "doc_id",
        (fold(F.col("doc_id")) == 1).alias("held_out"),
        "score",
        (F.col("score") >= TOXIC).cast("int").alias("predicted"),
        "offending",
    )


JACCARD_ORACLE = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w
  FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM words WHERE len(w) > 0)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), shared AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n
  FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * shared.n >= 90 * (x.n + y.n - shared.n)
), ways AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reached AS (
  SELECT doc_id, doc_id AS other FROM documents
  UNION
  SELECT reached.doc_id, ways.b FROM reached JOIN ways ON ways.a = reached.other
)
SELECT doc_id, CAST(coalesce(any_value(n), 0) AS BIGINT) AS n_shingles, min(other) AS component_id
FROM reached LEFT JOIN sizes USING (doc_id) GROUP BY doc_id
"""


@query("op6_jaccard_join", JACCARD_ORACLE)
def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


@query("op7_fingerprints")
def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    printed = fingerprint_edits(table(spark, sf_dir, "documents"))
    return printed.withColumn("edited_sha256", F.sha2("edited", 256)).drop("edited")


LM_ORACLE = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), placed AS (
  SELECT doc_id, len(w) AS n, unnest(range(1, len(w) + 1)) AS i, w FROM words
), grams AS (
  SELECT doc_id, n, i, w[i] AS word, CASE WHEN i > 1 THEN w[i - 1] END AS before FROM placed
), singles AS (
  SELECT word, doc_id, count(*) AS own, sum(count(*)) OVER (PARTITION BY word) AS everywhere
  FROM grams GROUP BY word, doc_id
), pairs AS (
  SELECT before, word, doc_id, count(*) AS own,
         sum(count(*)) OVER (PARTITION BY before, word) AS everywhere
  FROM grams WHERE before IS NOT NULL GROUP BY before, word, doc_id
), total AS (
  SELECT sum(len(w)) AS n FROM words
), scored AS (
  SELECT g.doc_id,
    CASE WHEN p.everywhere - p.own > 0 THEN ln((p.everywhere - p.own) / (c.everywhere - c.own))
         ELSE (CASE WHEN g.before IS NULL THEN 0 ELSE ln(0.4) END)
              + CASE WHEN s.everywhere - s.own > 0
                     THEN ln((s.everywhere - s.own) / (total.n - g.n))
                     ELSE ln(0.4) - ln(greatest(total.n - g.n, 1)) END END AS log_score,
    coalesce(p.everywhere - p.own > 0, FALSE) AS highest,
    s.everywhere = s.own AND NOT coalesce(p.everywhere - p.own > 0, FALSE) AS unseen
  FROM grams g CROSS JOIN total
  JOIN singles s ON s.word = g.word AND s.doc_id = g.doc_id
  LEFT JOIN singles c ON c.word = g.before AND c.doc_id = g.doc_id
  LEFT JOIN pairs p ON p.before = g.before AND p.word = g.word AND p.doc_id = g.doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words,
       round(coalesce(sum(log_score), 0), 3) AS log_score,
       round(sum(log_score) / nullif(len(d.w), 0), 4) AS mean_log_score,
       CAST(coalesce(sum(CAST(highest AS INT)), 0) AS BIGINT) AS n_highest,
       CAST(coalesce(sum(CAST(unseen AS INT)), 0) AS BIGINT) AS n_unseen
FROM words d LEFT JOIN scored USING (doc_id)
GROUP BY d.doc_id, len(d.w)
"""


@query("op8_lm_scoring", LM_ORACLE)
def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_documents(table(spark, sf_dir, "documents"))
    return scored.withColumns(
        {
            "log_score": F.round("log_score", 3),
            "mean_log_score": F.round("mean_log_score", 4),
        }
    )


QUALITY_ORACLE = r"""
WITH texts AS (
  SELECT doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM texts)
), often AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS times FROM windows
), repeated AS (
  SELECT doc_id, count(DISTINCT i + k) AS n
  FROM often, range(8) t(k) WHERE times > 1 GROUP BY doc_id
), split AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) AS k
  FROM texts
), lines AS (
  SELECT *, length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g')) AS visible,
         regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS lw,
         row_number() OVER (PARTITION BY doc_id, line ORDER BY k) AS copy
  FROM split
), judged AS (
  SELECT doc_id, visible, copy > 1 AS again, copy > 1
    OR len(regexp_extract_all(line, '[#*$%&|<>]')) > 0.1::DOUBLE * visible
    OR len(list_filter(lw, lambda x: regexp_matches(x, '[!?]{2,}$'))) > 0.3::DOUBLE * len(lw)
    OR len(list_filter(range(2, len(lw) + 1), lambda i: lw[i] = lw[i - 1])) > 0.5::DOUBLE * len(lw)
    OR len(regexp_extract_all(regexp_replace(line, '([ \t])', '\1\1', 'g'), '[ \t][|>»›·•][ \t]')) >= 3
    OR (len(lw) <= 4 AND regexp_full_match(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'MENU', 'i'))
    OR regexp_matches(line, 'BOILERPLATE', 'i') AS fails
  FROM lines WHERE visible > 0
), cleaned AS (
  SELECT doc_id, count(*) FILTER (again) AS n_dup_lines, count(*) FILTER (fails) AS lines_removed,
         coalesce(sum(visible) FILTER (fails), 0) AS chars_removed
  FROM judged GROUP BY doc_id
), counted AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
         CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(repeated.n, 0) AS BIGINT) AS n_repeat_words,
         CAST(coalesce(lines_removed, 0) AS BIGINT) AS lines_removed,
         CAST(coalesce(chars_removed, 0) AS BIGINT) AS chars_removed
  FROM texts LEFT JOIN cleaned USING (doc_id) LEFT JOIN repeated USING (doc_id)
)
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT base_failed AND chars_removed <= 0.5 * word_chars AS kept
FROM counted
""".replace("MENU", MENU.pattern.removesuffix(r"\Z")).replace("BOILERPLATE", BOILERPLATE.pattern)


@query("op9_quality_rules", QUALITY_ORACLE)
def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_first_quality(table(spark, sf_dir, "documents")).drop("cleaned")


@query("op10_suffix_array_dedup")
def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("spans").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


MANIFEST_FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def _crc32_sql(text: str) -> str:
    """Expression: the unsigned CRC-32 of an ASCII text expression, bit by bit."""
    codes = f"list_transform(string_split({text}, ''), lambda ch: unicode(ch)::BIGINT)"
    byte = (
        "list_reduce(list_prepend(xor(crc, code), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), "
        "lambda x, y: xor(x >> 1, 3988292384::BIGINT * (x & 1)))"
    )
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda crc, code: {byte}), 4294967295)"


def _leaf_sql(text: str) -> str:
    value = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen(CAST({0} AS VARCHAR)) || ':' || CAST({0} AS VARCHAR) END"
    return f"sha256({' || '.join(value.format(c) for c in [*MANIFEST_FIELDS[:-1], text])})"


_UP = """list_transform(range(0, (len(nodes) + 2) // 3),
    lambda i: sha256(array_to_string(nodes[3 * i + 1:3 * i + 3], '')))"""
_SIDES = """array_to_string(nodes[3 * (place // 3) + 1:place], '') AS lefts,
    array_to_string(nodes[place + 2:3 * (place // 3) + 3], '') AS rights"""

MANIFEST_ORACLE = f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, source, {_leaf_sql("text")} AS leaf,
         CASE WHEN {_crc32_sql("CAST(doc_id AS VARCHAR)")} % 2 = 0
              THEN {_leaf_sql("replace(text, chr(10), '')")} ELSE {_leaf_sql("text")} END AS found
  FROM documents
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place FROM leaves
), trees(source, level, nodes) AS (
  SELECT source, 0, list(leaf ORDER BY place) FROM placed GROUP BY source
  UNION ALL
  SELECT source, level + 1, {_UP} FROM trees WHERE len(nodes) > 1
), subroots AS (
  SELECT source, nodes[1] AS subroot, row_number() OVER (ORDER BY source COLLATE "C" NULLS FIRST) - 1 AS place
  FROM trees WHERE len(nodes) = 1
), top(level, nodes) AS (
  SELECT 0, list(subroot ORDER BY place) FROM subroots
  UNION ALL
  SELECT level + 1, {_UP} FROM top WHERE len(nodes) > 1
), walks(doc_id, source, leaf, level, place, folded, proof) AS (
  SELECT doc_id, source, leaf, 0, place, found, '' FROM placed
  UNION ALL
  SELECT doc_id, source, leaf, level + 1, place // 3, sha256(lefts || folded || rights), proof || lefts || rights
  FROM (SELECT w.*, {_SIDES} FROM walks w
        JOIN trees t ON t.source IS NOT DISTINCT FROM w.source AND t.level = w.level AND len(t.nodes) > 1)
), ends AS (
  SELECT w.* EXCLUDE (level, place), s.subroot, s.place FROM walks w
  JOIN trees t ON t.source IS NOT DISTINCT FROM w.source AND t.level = w.level AND len(t.nodes) = 1
  JOIN subroots s ON s.source IS NOT DISTINCT FROM w.source
), climbs(doc_id, leaf, subroot, level, place, folded, proof) AS (
  SELECT doc_id, leaf, subroot, 0, place, folded, proof FROM ends
  UNION ALL
  SELECT doc_id, leaf, subroot, level + 1, place // 3, sha256(lefts || folded || rights), proof || lefts || rights
  FROM (SELECT w.*, {_SIDES} FROM climbs w JOIN top t ON t.level = w.level AND len(t.nodes) > 1)
)
SELECT doc_id, leaf, subroot, nodes[1] AS root, sha256(proof) AS proof_sha256,
       folded AS folded_root, folded = nodes[1] AS verified
FROM climbs JOIN top t ON t.level = climbs.level AND len(t.nodes) = 1
"""


@query("op11_manifest", MANIFEST_ORACLE)
def op11_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    joined = F.replace("text", F.lit("\n"), F.lit(""))
    return audit_rows(table(spark, sf_dir, "documents"), MANIFEST_FIELDS, {"text": joined}, even)


_TEST_WORDS = r"""regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

LEAK_ORACLE = f"""
WITH documents_words AS (
  SELECT doc_id, {_TEST_WORDS} AS w FROM documents
), item_words AS (
  SELECT CAST(item_id AS VARCHAR) AS item, {_TEST_WORDS} AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item, least(len(w), 10) AS size, array_to_string(w[i:i + 9], ' ') AS words
  FROM (SELECT *, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM item_words WHERE len(w) > 0)
), sizes AS (
  SELECT DISTINCT size FROM windows
), places AS (
  SELECT doc_id, i, size, array_to_string(w[i:i + size - 1], ' ') AS words
  FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM documents_words), sizes
  WHERE i + size - 1 <= len(w)
), met AS (
  SELECT doc_id, i, p.size, item FROM places p JOIN windows USING (words, size)
), hits AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM met, range(10) t(k) WHERE k < size GROUP BY doc_id
), named AS (
  SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item FROM met) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(hits.n, 0) AS n_hit,
       coalesce(named.n, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(hits.n, 0) > 0 AS contaminated
FROM documents_words LEFT JOIN hits USING (doc_id) LEFT JOIN named USING (doc_id)
"""


@query("op12_decontamination", LEAK_ORACLE)
def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def damaged_conversations(rows: DataFrame) -> DataFrame:
    """Rows dropped, emptied, robbed of their sentence ends, repeated or given the role user, by a
    rule of their conversation and turn. Null roles and texts become one space."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    place = F.concat(name("conv_id"), F.lit(":"), name("turn"))
    fate = F.crc32(place.cast("binary")) % 20
    text = F.coalesce("text", F.lit(" "))
    altered = F.when(fate == 1, "").when(fate == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    role = F.when(fate == 4, "user").otherwise(F.coalesce("role", F.lit(" ")))
    copies = F.when(fate == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    kept = rows.select("conv_id", "turn", role.alias("role"), altered.alias("text"), fate.alias("fate"), copies.alias("copies"))
    return kept.where("fate <> 0").select("conv_id", "turn", "role", "text", F.explode_outer("copies").alias("copy")).drop("copy")


def _edit(state: str, cost: str, edits: str) -> str:
    """Expression: a state's least cost, eight digits, and audit after edits; null stays null."""
    return f"(lpad(CAST(CAST({state}[1:8] AS INT) + {cost} AS VARCHAR), 8, '0') || {state}[9:] || '{edits}')"


def _least(*parts: str) -> str:
    return f"least({', '.join(parts)})"


def _row_moves() -> str:
    keep = lambda state, initial: f"CASE WHEN NOT gone AND initial = '{initial}' THEN {_edit(state, 'extra', 'K')} END"
    rerole = lambda state: f"CASE WHEN NOT gone THEN {_edit(state, '3 + extra', 'R')} END"
    drop = lambda state: _edit(state, "4", "D")
    opens = [f"e{i}" for i in (0, 1, 3)]
    return ", ".join(
        [
            drop("e0"),
            _least(drop("e1"), keep("e0", "s")),
            _least(drop("e2"), *[keep(e, "u") for e in opens], *map(rerole, opens)),
            _least(drop("e3"), keep("e2", "a"), rerole("e2")),
        ]
    )


_INSERTED = f"""x0 AS e0, x1 AS e1,
    {_least("x2", *[_edit(f"x{i}", "3", "I") for i in (0, 1, 3)])} AS e2,
    {_least("x3", _edit("x2", "3", "I"), _edit("x0", "6", "II"), _edit("x1", "6", "II"))} AS e3"""

REPAIR_ORACLE = rf"""
WITH RECURSIVE original AS (
  SELECT *, dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS conv,
    {_crc32_sql("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS fate
  FROM conversations
), damaged AS (
  SELECT conv, turn, CASE WHEN fate = 4 THEN 'user' ELSE coalesce(role, ' ') END AS role,
    CASE WHEN fate = 1 THEN '' WHEN fate = 2 THEN regexp_replace(coalesce(text, ' '), '[.!?]', '', 'g')
         ELSE coalesce(text, ' ') END AS text
  FROM original, range(2) t(copy) WHERE fate <> 0 AND (copy = 0 OR fate = 3)
), placed AS (
  SELECT *, left(role, 1) AS initial,
    row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role COLLATE "C", md5(text)) AS i
  FROM damaged
), judged AS (
  SELECT *, lag(initial) OVER (PARTITION BY conv ORDER BY i) || initial AS pair,
    CASE WHEN NOT regexp_matches(text, '[^ 	-
]') THEN 'blank'
         WHEN row_number() OVER (PARTITION BY conv, role, text ORDER BY i) > 1 THEN 'duplicate'
         WHEN NOT regexp_matches(text, '[.!?][ 	-
]*\z') THEN 'truncated' ELSE '' END AS fault
  FROM placed
), rows AS (
  SELECT *, fault IN ('blank', 'duplicate') AS gone, CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END AS extra
  FROM judged
), counts AS (
  SELECT conv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n
  FROM rows GROUP BY conv
), states(conv, i, x0, x1, x2, x3) AS (
  SELECT conv, 0::BIGINT, '00000000', NULL::VARCHAR, NULL::VARCHAR, NULL::VARCHAR FROM counts
  UNION ALL
  SELECT conv, i, {_row_moves()}
  FROM (SELECT s.conv, s.i + 1 AS i, {_INSERTED}, initial, gone, extra
        FROM states s JOIN rows r ON r.conv = s.conv AND r.i = s.i + 1)
), plans AS (
  SELECT conv, least(x0, e3) AS best
  FROM (SELECT s.conv, {_INSERTED}, x0 FROM states s JOIN counts c ON c.conv = s.conv AND c.n = s.i)
), spelt AS (
  SELECT conv, best[9:] AS audit, unnest(range(1, length(best) - 7)) AS j FROM plans
), edits AS (
  SELECT *, audit[j] AS edit, length(replace(audit[:j], 'I', '')) AS i,
    length(replace(audit[:j], 'D', '')) - length(replace(audit, 'D', '')) % 2 AS place
  FROM spelt
), repaired AS (
  SELECT e.conv, string_agg(
    CASE WHEN edit = 'K' THEN role WHEN place % 2 = 1 THEN 'user' ELSE 'assistant' END
    || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END, chr(10) ORDER BY j) AS whole
  FROM edits e LEFT JOIN rows r ON r.conv = e.conv AND r.i = e.i AND edit <> 'I'
  WHERE edit <> 'D' GROUP BY e.conv
)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(CAST(best[1:8] AS BIGINT), 0) AS cost, coalesce(best[9:], '') AS audit,
  sha256(coalesce(whole, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv, conv_id FROM original) o
LEFT JOIN counts USING (conv) LEFT JOIN plans USING (conv) LEFT JOIN repaired USING (conv)
"""


@query("op13_conversation_repair", REPAIR_ORACLE)
def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    original = table(spark, sf_dir, "conversations")
    rows = damaged_conversations(original)
    plan = Stage(repair_plan(rows, ids=original), "repairs").df
    digests = repaired_digests(rows, plan)
    same = F.col("conv_id").eqNullSafe(F.col("_id"))
    return plan.join(digests.select(F.col("conv_id").alias("_id"), F.col("sha256").alias("repaired_sha256")), same).drop("_id")
