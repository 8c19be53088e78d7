"""The registered queries, each with the SQL that states its result."""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bytegrain.functions.tokens import token_ids
from bytegrain.model import DEFAULT_VOCAB_SIZE, LAYOUTS, BpeModel
from bytegrain.operators import chunks, corpus, pairs, quality, shards, splits
from bytegrain.operators.decoding import decode
from bytegrain.operators.encoding import encode, segment_by_rounds
from bytegrain.operators.ordering import in_key_order
from bytegrain.operators.training import train
from bytegrain.plans import oracle as sql
from bytegrain.plans.jobs import build_corpus
from bytegrain.session import Stage, shared_root
from bytegrain.sources import artifact, tables
from bytegrain.streaming import ingest

MERGES = 32
SHARD = 128
SAMPLE = 0.25

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
_models: dict[tuple, BpeModel] = {}


def register(name: str, check: str | None = None):
    def add(query: Query) -> Query:
        QUERIES[name] = query
        if check is not None:
            ORACLES[name] = check
        return query

    return add


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    columns = columns or ("doc_id", "text")
    return tables.read_corpus(spark, f"{sf_dir}/documents.parquet", *columns, key="doc_id")


def table(spark: SparkSession, sf_dir: str, name: str, key: str, *columns: str) -> DataFrame:
    return tables.read_corpus(spark, f"{sf_dir}/{name}.parquet", *columns, key=key)


def trained(
    spark: SparkSession,
    sf_dir: str,
    merges: int = MERGES,
    layout: str = "spec",
    pattern: str = "cl100k",
) -> BpeModel:
    """Model of all documents, trained once per session and parameters."""
    key = (spark.sparkContext.applicationId, sf_dir, merges, layout, pattern)
    if key not in _models:
        words = chunks.word_freq(documents(spark, sf_dir, "text", "doc_id"), pattern)
        shape = LAYOUTS[layout]
        _models[key] = train(words, shape.merges_start + merges, shape, pattern)
    return _models[key]


def encoded(spark: SparkSession, sf_dir: str, *extra: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text", *extra)
    return encode(docs, trained(spark, sf_dir))


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/bytegrain/{name}-{uuid4().hex}"


def joined(ids: Column) -> Column:
    return F.array_join(F.transform(ids, lambda i: i.cast("string")), ",")


def digest(text: str) -> Column:
    return F.md5(F.col(text).cast("binary"))


def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.prepare_corpus(documents(spark, sf_dir))


# Corpus preparation

_STRIPPED = sql.stripped("text")
_KEPT = f"""kept AS (SELECT doc_id, {_STRIPPED} AS text FROM documents
  WHERE length({_STRIPPED}) >= 200)"""
_SHARDED = f"""{_KEPT}, ranked AS (
  SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS rank, count(*) OVER () AS total FROM kept),
sharded AS (SELECT doc_id, text, (rank // {SHARD})::INT AS shard_id,
  rank % {SHARD} = {SHARD - 1} OR rank = total - 1 AS shard_last FROM ranked)"""


@register(
    "q_sample",
    f"SELECT doc_id, n_chars FROM documents WHERE {sql.draw('doc_id')} < {SAMPLE} * 4294967296",
)
def q_sample(spark, sf_dir):
    docs = documents(spark, sf_dir, "doc_id", "n_chars")
    return corpus.sample_corpus(docs, SAMPLE)


@register("q_strip", f"SELECT doc_id, {_STRIPPED} AS text FROM documents")
def q_strip(spark, sf_dir):
    return corpus.strip_text(documents(spark, sf_dir))


@register("q_len_filter", f"WITH {_KEPT} SELECT doc_id, length(text) AS chars FROM kept")
def q_len_filter(spark, sf_dir):
    return prepared(spark, sf_dir).select("doc_id", F.length("text").cast("bigint").alias("chars"))


@register(
    "q_corpus_stats",
    f"""WITH seen AS (
      SELECT length({_STRIPPED}) AS chars,
             {sql.draw('doc_id')} < {SAMPLE} * 4294967296 AND length({_STRIPPED}) >= 200 AS kept
      FROM documents)
    SELECT count(*) AS docs_seen, count(*) FILTER (kept) AS docs_kept,
           coalesce(sum(chars) FILTER (kept), 0)::BIGINT AS total_chars,
           coalesce(sum(chars) FILTER (kept), 0)::BIGINT // 4 AS approx_tokens,
           (count(*) FILTER (kept) + {SHARD - 1}) // {SHARD} AS shards_written FROM seen""",
)
def q_corpus_stats(spark, sf_dir):
    return corpus.corpus_stats(documents(spark, sf_dir), SAMPLE, shard_size=SHARD)


@register("q_shards", f"WITH {_SHARDED} SELECT doc_id, shard_id, shard_last FROM sharded")
def q_shards(spark, sf_dir):
    return shards.assign_shards(prepared(spark, sf_dir).select("doc_id"), SHARD)


@register(
    "q_shard_cap",
    f"WITH {_SHARDED} SELECT shard_id, count(*) AS docs FROM sharded "
    "WHERE shard_id < 3 GROUP BY shard_id",
)
def q_shard_cap(spark, sf_dir):
    sharded = shards.assign_shards(prepared(spark, sf_dir), SHARD, max_new=3)
    return sharded.groupBy("shard_id").agg(F.count("*").alias("docs"))


@register("q_shard_sink", f"WITH {_SHARDED} SELECT shard_id, doc_id, md5(text) AS digest FROM sharded")
def q_shard_sink(spark, sf_dir):
    path = fresh_path(spark, "shards")
    tables.write_shards(shards.assign_shards(prepared(spark, sf_dir), SHARD), path)
    return tables.read_shards(spark, path).select(
        "shard_id", "doc_id", digest("text").alias("digest")
    )


@register(
    "q_shard_text",
    f"""WITH {_SHARDED} SELECT shard_id, 'chunk_' || lpad(shard_id::VARCHAR, 5, '0') || '.txt'
      AS file_name, md5(string_agg(text, chr(10) || chr(10) ORDER BY doc_id)) AS digest
      FROM sharded GROUP BY shard_id""",
)
def q_shard_text(spark, sf_dir):
    sharded = shards.assign_shards(prepared(spark, sf_dir), SHARD)
    return shards.shard_text(sharded).select(
        "shard_id", "file_name", digest("text").alias("digest")
    )


@register(
    "q_shard_resume",
    f"""WITH {_KEPT}, run AS (
      SELECT doc_id, CASE WHEN {sql.draw('doc_id')} < {SAMPLE} * 4294967296
        THEN 'landed' ELSE 'new' END AS run FROM kept),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY doc_id) - 1 AS rank FROM run),
    first AS (SELECT coalesce(max(rank) // {SHARD} + 1, 0) AS shard FROM ranked WHERE run = 'landed')
    SELECT doc_id, run, (rank // {SHARD} + CASE run WHEN 'new' THEN shard ELSE 0 END)::INT AS shard_id
    FROM ranked, first""",
)
def q_shard_resume(spark, sf_dir):
    """The corpus job on a sample, then on everything."""
    path = fresh_path(spark, "shards")
    docs = documents(spark, sf_dir)
    build_corpus(docs, path, SAMPLE, shard_size=SHARD)
    first = Stage(tables.landed_documents(spark, path), "landed").df
    build_corpus(docs, path, shard_size=SHARD)
    run = F.when(F.col("before").isNull(), "new").otherwise("landed").alias("run")
    before = first.select("doc_id", F.col("shard_id").alias("before"))
    landed = tables.landed_documents(spark, path)
    return landed.join(before, "doc_id", "left").select("doc_id", run, "shard_id")


# Pre-tokens and their frequencies


def _occurrences(pattern: str) -> str:
    split = sql.chunks("text", pattern)
    return f"""SELECT doc_id, unnest({split}) AS chunk,
      (generate_subscripts({split}, 1) - 1)::INT AS pos FROM documents"""


@register("q_pretok", _occurrences("cl100k"))
def q_pretok(spark, sf_dir):
    return chunks.chunk_table(documents(spark, sf_dir))


@register("q_pretok_legacy", _occurrences("legacy"))
def q_pretok_legacy(spark, sf_dir):
    return chunks.chunk_table(documents(spark, sf_dir), "legacy")


@register(
    "q_byte_ids",
    sql.with_recursive(sql.words())
    + f" SELECT chunk, array_to_string({sql.hex_bytes('chunk')}, ',') AS ids FROM words",
)
def q_byte_ids(spark, sf_dir):
    words = chunks.word_freq(documents(spark, sf_dir)).select("chunk")
    return chunks.chunk_byte_ids(words).withColumn("ids", joined(F.col("ids")))


@register("q_word_freq", sql.with_recursive(sql.words()) + " SELECT chunk, freq FROM words")
def q_word_freq(spark, sf_dir):
    return chunks.word_freq(documents(spark, sf_dir))


@register(
    "q_word_freq_legacy",
    sql.with_recursive(sql.words(pattern="legacy")) + " SELECT chunk, freq FROM words",
)
def q_word_freq_legacy(spark, sf_dir):
    return chunks.word_freq(documents(spark, sf_dir), "legacy")


@register(
    "q_word_freq_pages",
    sql.with_recursive(sql.words("pages", "html")) + " SELECT chunk, freq FROM words",
)
def q_word_freq_pages(spark, sf_dir):
    return chunks.word_freq(table(spark, sf_dir, "pages", "page_id", "page_id", "html"), text="html")


_SHARD_TEXT = f"""{_SHARDED}, shard_texts AS (
  SELECT shard_id, string_agg(text, chr(10) || chr(10) ORDER BY doc_id) AS text
  FROM sharded GROUP BY shard_id)"""


@register(
    "q_word_freq_joined",
    sql.with_recursive(_SHARD_TEXT, sql.words("shard_texts")) + " SELECT chunk, freq FROM words",
)
def q_word_freq_joined(spark, sf_dir):
    return chunks.word_freq_joined(shards.assign_shards(prepared(spark, sf_dir), SHARD))


@register(
    "q_word_freq_joined_legacy",
    sql.with_recursive(_SHARD_TEXT, sql.words("shard_texts", pattern="legacy"))
    + " SELECT chunk, freq FROM words",
)
def q_word_freq_joined_legacy(spark, sf_dir):
    sharded = shards.assign_shards(prepared(spark, sf_dir), SHARD)
    return chunks.word_freq_joined(sharded, "legacy")


@register(
    "q_train_size",
    sql.with_recursive(sql.words())
    + " SELECT sum(freq)::BIGINT AS n_chunks, sum(freq * strlen(chunk))::BIGINT AS n_tokens FROM words",
)
def q_train_size(spark, sf_dir):
    return chunks.train_size(chunks.word_freq(documents(spark, sf_dir)))


# Pairs, merges, training

_PAIRS = f"""seqs AS (SELECT chunk, freq, {sql.byte_seq('chunk')} AS seq FROM words),
counts AS (SELECT pair, sum(freq)::BIGINT AS n FROM (
  SELECT freq, unnest({sql.pairs('seq')}) AS pair FROM seqs WHERE length(seq) > 1) GROUP BY pair)"""
_PAIR_IDS = "unicode(substr(pair, 1, 1)) AS left_id, unicode(substr(pair, 2, 1)) AS right_id, n"


@register(
    "q_pair_counts",
    sql.with_recursive(sql.words(), _PAIRS) + f" SELECT {_PAIR_IDS} FROM counts",
)
def q_pair_counts(spark, sf_dir):
    words = chunks.word_freq(documents(spark, sf_dir))
    return pairs.pair_ids(pairs.count_pairs(pairs.token_table(words)))


@register(
    "q_best_pair",
    sql.with_recursive(sql.words(), _PAIRS)
    + f" SELECT {_PAIR_IDS} FROM counts ORDER BY n DESC, pair LIMIT 1",
)
def q_best_pair(spark, sf_dir):
    words = chunks.word_freq(documents(spark, sf_dir))
    return pairs.pair_ids(pairs.best_pair(pairs.count_pairs(pairs.token_table(words))))


@register(
    "q_apply_merge",
    sql.with_recursive(sql.words())
    + f", seqs AS (SELECT freq, {sql.byte_seq('chunk')} AS seq FROM words),"
    " merged AS (SELECT freq, replace(replace(seq, 'th', chr(528)), 'ee', chr(529)) AS seq FROM seqs)"
    f" SELECT freq, {sql.ids('seq')} AS ids FROM merged WHERE length(seq) > 1",
)
def q_apply_merge(spark, sf_dir):
    state = pairs.token_table(chunks.word_freq(documents(spark, sf_dir)))
    merged = pairs.merge_tokens(state, [("th", chr(528)), ("ee", chr(529))])
    return merged.where(F.length("tokens") > 1).select(
        "freq", joined(token_ids(F.col("tokens"))).alias("ids")
    )


_MERGED = "rank, left_id, right_id, new_id, freq"


def _merge_rows(spark: SparkSession, model: BpeModel) -> DataFrame:
    return model.merge_table(spark).withColumnsRenamed({"left": "left_id", "right": "right_id"})


@register(
    "q_train_merges",
    sql.with_recursive(sql.words(), sql.training(MERGES)) + f" SELECT {_MERGED} FROM merged",
)
def q_train_merges(spark, sf_dir):
    return _merge_rows(spark, trained(spark, sf_dir))


@register(
    "q_train_merges_legacy",
    sql.with_recursive(sql.words(pattern="legacy"), sql.training(MERGES, "compact"))
    + f" SELECT {_MERGED} FROM merged",
)
def q_train_merges_legacy(spark, sf_dir):
    return _merge_rows(spark, trained(spark, sf_dir, MERGES, "compact", "legacy"))


@register(
    "q_train_first_seen",
    sql.with_recursive(
        sql.words("benchmark", pattern="legacy", order="item_id"),
        sql.training(3 * MERGES, "compact", "first"),
    )
    + f" SELECT {_MERGED} FROM merged",
)
def q_train_first_seen(spark, sf_dir):
    """Ties go to the pair met first in the corpus."""
    items = table(spark, sf_dir, "benchmark", "item_id", "item_id", "text")
    words = chunks.word_freq(items, "legacy", order="item_id")
    shape = LAYOUTS["compact"]
    model = train(words, shape.merges_start + 3 * MERGES, shape, "legacy", tie="first")
    return _merge_rows(spark, model)


@register(
    "q_train_first_docs",
    sql.with_recursive(
        sql.words(pattern="legacy", order="doc_id"), sql.training(MERGES, "compact", "first")
    )
    + f" SELECT {_MERGED} FROM merged",
)
def q_train_first_docs(spark, sf_dir):
    """Ties go to the pair met first, on the main corpus."""
    words = chunks.word_freq(documents(spark, sf_dir), "legacy", order="doc_id")
    shape = LAYOUTS["compact"]
    model = train(words, shape.merges_start + MERGES, shape, "legacy", tie="first")
    return _merge_rows(spark, model)


@register(
    "q_early_stop",
    sql.with_recursive(sql.words("conversations", "role"), sql.training(200))
    + f" SELECT {_MERGED}, (SELECT count(*) FROM merged) AS learned FROM merged",
)
def q_early_stop(spark, sf_dir):
    """A corpus of few words runs out of pairs before the vocabulary is full."""
    roles = table(spark, sf_dir, "conversations", "conv_id", "conv_id", "role")
    model = train(chunks.word_freq(roles, text="role"), LAYOUTS["spec"].merges_start + 200)
    return _merge_rows(spark, model).withColumn("learned", F.lit(len(model.merges)).cast("bigint"))


@register(
    "q_train_joined",
    sql.with_recursive(_SHARD_TEXT, sql.words("shard_texts"), sql.training(MERGES))
    + f" SELECT {_MERGED} FROM merged",
)
def q_train_joined(spark, sf_dir):
    sharded = shards.assign_shards(prepared(spark, sf_dir), SHARD)
    model = train(chunks.word_freq_joined(sharded), LAYOUTS["spec"].merges_start + MERGES)
    return _merge_rows(spark, model)


_TRAINED = (sql.words(), sql.training(MERGES))
# Bytes of every id: bytes and fallback bytes, specials, reserved names, then merges.
_VOCAB = """names AS (
  SELECT 512 + i AS token_id, 'special' AS kind,
         ['<PAD>', '<BOS>', '<EOS>', '<UNK>', '<SEP>'][i + 1] AS surface FROM range(5) t(i)
  UNION ALL SELECT 517 + i, 'reserved', '<UNUSED_' || i || '>' FROM range(11) t(i)),
grown AS (
  SELECT 0 AS step, map_from_entries(list((i, printf('%02X', i)) ORDER BY i)) AS made
  FROM range(256) t(i)
  UNION ALL
  SELECT g.step + 1, map_concat(g.made,
    map([m.new_id::BIGINT], [g.made[m.left_id::BIGINT] || g.made[m.right_id::BIGINT]]))
  FROM grown g JOIN merged m ON m.rank = g.step + 1),
made AS (SELECT made FROM grown ORDER BY step DESC LIMIT 1),
vocab AS (
  SELECT i::INT AS token_id, printf('%02X', i) AS token_hex, 'byte' AS kind, NULL AS surface
  FROM range(256) t(i)
  UNION ALL SELECT (256 + i)::INT, printf('%02X', i), 'fallback', '<0x' || printf('%02X', i) || '>'
  FROM range(256) t(i)
  UNION ALL SELECT token_id::INT, hex(encode(surface)), kind, surface FROM names
  UNION ALL SELECT new_id::INT, made[new_id::BIGINT], 'merge', NULL FROM merged, made)"""


@register(
    "q_vocab",
    sql.with_recursive(*_TRAINED, _VOCAB) + " SELECT token_id, token_hex, kind, surface FROM vocab",
)
def q_vocab(spark, sf_dir):
    vocab = trained(spark, sf_dir).vocab_table(spark)
    return vocab.select("token_id", F.hex("bytes").alias("token_hex"), "kind", "surface")


@register("q_vocab_size", sql.with_recursive(*_TRAINED, _VOCAB) + " SELECT count(*) AS n FROM vocab")
def q_vocab_size(spark, sf_dir):
    return trained(spark, sf_dir).vocab_table(spark).agg(F.count("*").alias("n"))


@register(
    "q_merge_log",
    sql.with_recursive(*_TRAINED, _VOCAB)
    + f""" SELECT {_MERGED}, token_hex FROM merged JOIN vocab ON token_id = new_id
      WHERE (rank - 1) % 5 = 0 OR rank = {MERGES}""",
)
def q_merge_log(spark, sf_dir):
    model = trained(spark, sf_dir)
    log = quality.merge_log(model.merge_table(spark), model.vocab_table(spark), 5)
    return log.withColumnsRenamed({"left": "left_id", "right": "right_id"})


@register(
    "q_artifact",
    sql.with_recursive(*_TRAINED) + " SELECT rank, left_id, right_id, new_id FROM merged",
)
def q_artifact(spark, sf_dir):
    """Merges after saving and loading."""
    path = fresh_path(spark, "artifact")
    artifact.save_model(spark, trained(spark, sf_dir), path)
    return _merge_rows(spark, artifact.load_model(spark, path)).drop("freq")


@register(
    "q_artifact_vocab",
    sql.with_recursive(*_TRAINED, _VOCAB)
    + " SELECT token_id, token_hex, (SELECT count(*) FROM vocab)::INT AS vocab_size FROM vocab",
)
def q_artifact_vocab(spark, sf_dir):
    """Vocabulary as stored in the artifact."""
    path = fresh_path(spark, "artifact")
    artifact.save_model(spark, trained(spark, sf_dir), path)
    stored = artifact.load_artifact(spark, path)
    return stored.select("vocab_size", F.explode("vocab").alias("token_id", "data")).select(
        F.col("token_id").cast("int"), F.hex(F.unbase64("data")).alias("token_hex"), "vocab_size"
    )


# Encoding and decoding

_ENCODED = (*_TRAINED, sql.encoded())


@register("q_encode", sql.with_recursive(*_ENCODED) + " SELECT doc_id, ids, n_tokens FROM encoded")
def q_encode(spark, sf_dir):
    return encoded(spark, sf_dir).select(
        "doc_id", joined(F.col("ids")).alias("ids"), F.size("ids").cast("bigint").alias("n_tokens")
    )


@register(
    "q_encode_special",
    sql.with_recursive(*_ENCODED)
    + " SELECT doc_id, concat_ws(',', '513', nullif(ids, ''), '514') AS ids FROM encoded",
)
def q_encode_special(spark, sf_dir):
    docs = encode(documents(spark, sf_dir), trained(spark, sf_dir), add_special=True)
    return docs.select("doc_id", joined(F.col("ids")).alias("ids"))


@register(
    "q_encode_unseen",
    sql.with_recursive(
        "turns AS (SELECT conv_id * 1000 + turn AS turn_id, text FROM conversations)",
        sql.words(extra="turns"),
        sql.training(MERGES),
        sql.encoded("turns", "turn_id"),
    )
    + " SELECT turn_id, ids, n_tokens FROM encoded",
)
def q_encode_unseen(spark, sf_dir):
    """Texts of another table, with chunks that training has not met."""
    turns = table(spark, sf_dir, "conversations", "conv_id", "conv_id", "turn", "text")
    coded = encode(turns, trained(spark, sf_dir))
    return coded.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("turn_id"),
        joined(F.col("ids")).alias("ids"),
        F.size("ids").cast("bigint").alias("n_tokens"),
    )


@register(
    "q_encode_legacy",
    sql.with_recursive(
        sql.words(pattern="legacy"),
        sql.training(MERGES, "compact"),
        sql.encoded(pattern="legacy"),
    )
    + " SELECT doc_id, ids, n_tokens FROM encoded",
)
def q_encode_legacy(spark, sf_dir):
    coded = encode(documents(spark, sf_dir), trained(spark, sf_dir, MERGES, "compact", "legacy"))
    return coded.select(
        "doc_id", joined(F.col("ids")).alias("ids"), F.size("ids").cast("bigint").alias("n_tokens")
    )


@register(
    "q_encode_loaded",
    sql.with_recursive(
        "sites AS (SELECT page_id, html AS text FROM pages)",
        sql.words(extra="sites"),
        sql.training(MERGES),
        sql.encoded("sites", "page_id"),
    )
    + " SELECT page_id, ids FROM encoded",
)
def q_encode_loaded(spark, sf_dir):
    """Web pages, by a model read back from its artifact."""
    path = fresh_path(spark, "artifact")
    artifact.save_model(spark, trained(spark, sf_dir), path)
    pages = table(spark, sf_dir, "pages", "page_id", "page_id", "html")
    model = artifact.load_model(spark, path)
    return encode(pages, model, "html").select("page_id", joined(F.col("ids")).alias("ids"))


@register(
    "q_artifact_legacy",
    sql.with_recursive(
        sql.words(pattern="legacy"),
        sql.training(MERGES, "compact"),
        sql.encoded(pattern="legacy"),
    )
    + " SELECT doc_id, ids FROM encoded",
)
def q_artifact_legacy(spark, sf_dir):
    """The pattern comes back with the artifact."""
    path = fresh_path(spark, "artifact")
    artifact.save_model(spark, trained(spark, sf_dir, MERGES, "compact", "legacy"), path)
    docs = documents(spark, sf_dir)
    model = artifact.load_model(spark, path)
    return encode(docs, model).select("doc_id", joined(F.col("ids")).alias("ids"))


LARGE = 300  # merges; beyond encoding.WHOLE_TEXT_MERGES, so texts are segmented by chunk


def large_model(spark: SparkSession, sf_dir: str) -> BpeModel:
    key = (spark.sparkContext.applicationId, sf_dir, "benchmark", LARGE)
    if key not in _models:
        items = table(spark, sf_dir, "benchmark", "item_id", "item_id", "text")
        _models[key] = train(chunks.word_freq(items), LAYOUTS["spec"].merges_start + LARGE)
    return _models[key]


@register(
    "q_encode_large",
    sql.with_recursive(
        "turns AS (SELECT conv_id * 1000 + turn AS turn_id, text FROM conversations)",
        sql.words("benchmark", extra="turns"),
        sql.training(LARGE),
        sql.encoded("turns", "turn_id"),
    )
    + " SELECT turn_id, ids, n_tokens FROM encoded",
)
def q_encode_large(spark, sf_dir):
    """Texts of chunks that training has mostly not met."""
    turns = table(spark, sf_dir, "conversations", "conv_id", "conv_id", "turn", "text")
    return encode(turns, large_model(spark, sf_dir)).select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("turn_id"),
        joined(F.col("ids")).alias("ids"),
        F.size("ids").cast("bigint").alias("n_tokens"),
    )


@register(
    "q_encode_dictionary",
    sql.with_recursive(
        sql.words("benchmark"), sql.training(LARGE), sql.encoded("benchmark", "item_id")
    )
    + " SELECT item_id, ids FROM encoded",
)
def q_encode_dictionary(spark, sf_dir):
    """Training texts, whose chunks recur often."""
    items = table(spark, sf_dir, "benchmark", "item_id", "item_id", "text")
    return encode(items, large_model(spark, sf_dir)).select(
        "item_id", joined(F.col("ids")).alias("ids")
    )


@register(
    "q_encode_long_chunks",
    sql.with_recursive(
        "runs AS (SELECT conv_id * 1000 + turn AS turn_id, regexp_replace(text, '[^A-Za-z]', '', 'g') "
        "AS text FROM conversations)",
        sql.words("benchmark", extra="runs"),
        sql.training(LARGE),
        sql.encoded("runs", "turn_id"),
    )
    + " SELECT turn_id, ids, n_tokens FROM encoded",
)
def q_encode_long_chunks(spark, sf_dir):
    """Turns without blanks and signs: each is one chunk of up to thousands of letters."""
    turns = table(spark, sf_dir, "conversations", "conv_id", "conv_id", "turn", "text")
    runs = turns.withColumn("text", F.regexp_replace("text", "[^A-Za-z]", ""))
    return encode(runs, large_model(spark, sf_dir)).select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("turn_id"),
        joined(F.col("ids")).alias("ids"),
        F.size("ids").cast("bigint").alias("n_tokens"),
    )


FULL = DEFAULT_VOCAB_SIZE["spec"] - LAYOUTS["spec"].merges_start


# A vocabulary of the default size; SQL would take one recursion step for each merge, so
# tests/test_coding.py holds both queries against brute force on a small corpus.
@register("q_train_full")
def q_train_full(spark, sf_dir):
    return _merge_rows(spark, trained(spark, sf_dir, FULL))


@register("q_encode_full")
def q_encode_full(spark, sf_dir):
    """All documents by all merges, beside what decoding gives back."""
    model = trained(spark, sf_dir, FULL)
    return decode(encode(documents(spark, sf_dir), model), model).select(
        "doc_id",
        F.sha2(joined(F.col("ids")), 256).alias("ids_sha256"),
        F.size("ids").cast("bigint").alias("n_tokens"),
        (F.col("decoded") == F.col("text")).alias("same"),
    )


@register(
    "q_segment_rounds",
    sql.with_recursive(
        "turns AS (SELECT conv_id * 1000 + turn AS turn_id, text FROM conversations)",
        sql.words("benchmark", extra="turns"),
        sql.training(LARGE),
        sql.encoded("turns", "turn_id"),
    )
    + " SELECT turn_id, ids, n_tokens FROM encoded",
)
def q_segment_rounds(spark, sf_dir):
    """Turns put together from their distinct chunks, which joins with the rank table segment."""
    turns = table(spark, sf_dir, "conversations", "conv_id", "conv_id", "turn", "text")
    turns = turns.select((F.col("conv_id") * 1000 + F.col("turn")).alias("turn_id"), "text")
    cut = chunks.chunk_table(turns, key="turn_id")
    coded = Stage(segment_by_rounds(cut.select("chunk"), large_model(spark, sf_dir)), "segmented").df
    parts = cut.join(coded, "chunk").groupBy("turn_id").agg(F.array_sort(F.collect_list(F.struct("pos", "ids"))).alias("parts"))
    whole = turns.select("turn_id").join(parts, "turn_id", "left").select(
        "turn_id", F.coalesce(F.flatten("parts.ids"), F.array().cast("array<int>")).alias("ids")
    )
    return whole.select(
        "turn_id", joined(F.col("ids")).alias("ids"), F.size("ids").cast("bigint").alias("n_tokens")
    )


@register(
    "q_literal_specials",
    sql.with_recursive(
        "marked AS (SELECT doc_id, text || '<EOS><BOS>' AS text FROM documents)",
        sql.words(extra="marked"),
        sql.training(MERGES),
        sql.encoded("marked"),
    )
    + " SELECT doc_id, ids, 0 AS specials, TRUE AS same FROM encoded",
)
def q_literal_specials(spark, sf_dir):
    """Names of special tokens in a text are ordinary text."""
    docs = documents(spark, sf_dir).withColumn("text", F.concat("text", F.lit("<EOS><BOS>")))
    model = trained(spark, sf_dir)
    special = F.filter("ids", lambda i: (i >= 256) & (i < model.layout.merges_start))
    return decode(encode(docs, model), model).select(
        "doc_id",
        joined(F.col("ids")).alias("ids"),
        F.size(special).alias("specials"),
        (F.col("decoded") == F.col("text")).alias("same"),
    )


@register("q_decode", "SELECT doc_id, md5(text) AS digest FROM documents")
def q_decode(spark, sf_dir):
    return decode(encoded(spark, sf_dir), trained(spark, sf_dir)).select("doc_id", digest("decoded").alias("digest"))


@register(
    "q_decode_special",
    """SELECT doc_id, md5('<BOS>' || text || '<EOS>') AS kept, md5(text) AS skipped FROM documents""",
)
def q_decode_special(spark, sf_dir):
    model = trained(spark, sf_dir)
    coded = encode(documents(spark, sf_dir), model, add_special=True)
    both = decode(decode(coded, model, skip_special=False, out="kept"), model, out="skipped")
    return both.select(
        "doc_id", *(digest(c).alias(c) for c in ("kept", "skipped"))
    )


@register(
    "q_decode_unknown",
    sql.with_recursive(*_ENCODED)
    + """ SELECT doc_id, len(list_filter(string_split(ids, ','), lambda i: i <> '' AND i::INT >= 540))
      AS unknown FROM encoded""",
)
def q_decode_unknown(spark, sf_dir):
    """Ids that a smaller vocabulary lacks decode to <UNK>."""
    model = trained(spark, sf_dir)
    small = BpeModel(model.layout, model.pattern, model.merges[:12])
    marks = decode(encoded(spark, sf_dir), small, skip_special=True)
    return marks.select(
        "doc_id",
        F.expr("(length(decoded) - length(replace(decoded, '<UNK>', ''))) div 5").alias("unknown"),
    )


@register("q_byte_fallback", "SELECT doc_id, md5(text) AS digest FROM documents")
def q_byte_fallback(spark, sf_dir):
    """Fallback ids 256-511 decode to raw bytes."""
    model = trained(spark, sf_dir)
    docs = documents(spark, sf_dir).withColumnRenamed("text", "chunk")
    raised = chunks.chunk_byte_ids(docs).withColumn(
        "ids", F.transform("ids", lambda b: b + model.layout.fallback_start)
    )
    return decode(raised, model).select("doc_id", digest("decoded").alias("digest"))


def _legacy_text(text: str) -> str:
    """What the legacy pattern keeps: all but underscores and letters or digits beyond ASCII."""
    return (
        f"array_to_string(list_filter(regexp_extract_all({text}, '(?s).'), "
        "lambda c: regexp_matches(c, '[a-zA-Z0-9]') "
        "OR NOT regexp_matches(c, '[_\\p{L}\\p{N}]')), '')"
    )


@register("q_decode_legacy", f"SELECT doc_id, md5({_legacy_text('text')}) AS digest FROM documents")
def q_decode_legacy(spark, sf_dir):
    model = trained(spark, sf_dir, MERGES, "compact", "legacy")
    return decode(encode(documents(spark, sf_dir), model), model).select("doc_id", digest("decoded").alias("digest"))


@register(
    "q_roundtrip",
    f"""SELECT 'cl100k' AS pattern, count(*) AS docs, 0 AS mismatches FROM documents
      UNION ALL SELECT 'legacy', count(*), count(*) FILTER ({_legacy_text('text')} <> text)
      FROM documents""",
)
def q_roundtrip(spark, sf_dir):
    def check(pattern: str, layout: str) -> DataFrame:
        model = trained(spark, sf_dir, MERGES, layout, pattern)
        decoded = decode(encode(documents(spark, sf_dir), model), model)
        return quality.roundtrip(decoded).select(F.lit(pattern).alias("pattern"), "*")

    return check("cl100k", "spec").unionByName(check("legacy", "compact"))


# Checks and measures of the encoded corpus


@register(
    "q_id_range",
    sql.with_recursive(*_ENCODED)
    + f""", flat AS (SELECT lang, unnest(string_split(ids, ','))::INT AS id
      FROM encoded JOIN documents USING (doc_id))
    SELECT lang, min(id) AS min_id, max(id) AS max_id, max(id) < {528 + MERGES} AS in_range
    FROM flat GROUP BY lang""",
)
def q_id_range(spark, sf_dir):
    return quality.id_range(encoded(spark, sf_dir, "lang"), trained(spark, sf_dir), "lang")


@register(
    "q_compression",
    sql.with_recursive(*_ENCODED)
    + """ SELECT lang, source, count(*) AS docs, sum(strlen(text))::BIGINT AS bytes,
        sum(n_tokens)::BIGINT AS tokens,
        round(sum(strlen(text)) / sum(n_tokens), 6) AS bytes_per_token
      FROM encoded JOIN documents USING (doc_id) GROUP BY lang, source""",
)
def q_compression(spark, sf_dir):
    return quality.compression(encoded(spark, sf_dir, "lang", "source"), "lang", "source")


@register(
    "q_token_freq",
    sql.with_recursive(*_ENCODED)
    + """, flat AS (SELECT unnest(string_split(ids, ','))::INT AS token_id FROM encoded WHERE ids <> '')
    SELECT token_id, count(*) AS n FROM flat GROUP BY token_id""",
)
def q_token_freq(spark, sf_dir):
    return quality.token_freq(encoded(spark, sf_dir))


_SPLIT = f"CASE WHEN {sql.draw('doc_id')} < 0.9 * 4294967296 THEN 'train' ELSE 'val' END AS split"


@register("q_split", f"SELECT doc_id, {_SPLIT} FROM documents")
def q_split(spark, sf_dir):
    return splits.assign_split(documents(spark, sf_dir, "doc_id"))


_PLACED = f"""placed AS (SELECT doc_id, ids, n_tokens, {_SPLIT} FROM encoded),
offsets AS (SELECT split, doc_id, ids, n_tokens, coalesce(sum(n_tokens) OVER (
  PARTITION BY split ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT
  AS start_offset FROM placed)"""


@register(
    "q_offsets",
    sql.with_recursive(*_ENCODED, _PLACED)
    + " SELECT split, doc_id, n_tokens, start_offset FROM offsets",
)
def q_offsets(spark, sf_dir):
    return splits.token_offsets(splits.assign_split(encoded(spark, sf_dir)))


@register(
    "q_token_table",
    sql.with_recursive(*_ENCODED, _PLACED) + " SELECT split, doc_id, start_offset, ids FROM offsets",
)
def q_token_table(spark, sf_dir):
    """The encoded corpus, written by split and read back."""
    docs = in_key_order(documents(spark, sf_dir), "doc_id")
    path = fresh_path(spark, "tokens")
    coded = splits.assign_split(encode(docs, trained(spark, sf_dir)))
    tables.write_token_table(splits.token_table(coded), path)
    return tables.read_token_table(spark, path).select(
        "split", "doc_id", "start_offset", joined(F.col("ids")).alias("ids")
    )


@register(
    "q_split_by_offset",
    sql.with_recursive(*_ENCODED)
    + """, runs AS (SELECT doc_id, n_tokens, sum(n_tokens) OVER () AS total, coalesce(
      sum(n_tokens) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
      FROM encoded),
    cuts AS (SELECT *, floor(total * 0.9)::BIGINT AS border FROM runs),
    heads AS (SELECT *, greatest(0, least(n_tokens, border - start)) AS head FROM cuts)
    SELECT 'train' AS split, doc_id, start::BIGINT AS start_offset, head::BIGINT AS n_tokens
    FROM heads WHERE head > 0
    UNION ALL SELECT 'val', doc_id, greatest(0, start - border)::BIGINT, (n_tokens - head)::BIGINT
    FROM heads WHERE n_tokens > head""",
)
def q_split_by_offset(spark, sf_dir):
    """The split by token position, which cuts the document across the border."""
    docs = in_key_order(documents(spark, sf_dir), "doc_id")
    coded = encode(docs, trained(spark, sf_dir)).withColumn("split", F.lit("all"))
    cut = splits.cut_split(splits.token_table(coded).drop("split"))
    return cut.select(
        "split", "doc_id", "start_offset", F.size("ids").cast("bigint").alias("n_tokens")
    )


# Streaming


def _document_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus may be one file or a folder of files; only as a glob may a stream's path be a file."""
    schema = "doc_id bigint, text string"
    return ingest.read_stream(spark, f"{sf_dir}/{{documents.parquet}}", schema, key="doc_id")


@register(
    "q_stream_ingest",
    f"""WITH {_KEPT} SELECT doc_id, md5(text) AS digest FROM kept
      WHERE {sql.draw('doc_id')} < {SAMPLE} * 4294967296""",
)
def q_stream_ingest(spark, sf_dir):
    """Stream over the corpus folder; the second run finds nothing new and adds nothing."""
    target, log = fresh_path(spark, "ingested"), fresh_path(spark, "ingest-log")
    for _ in range(2):
        docs = _document_stream(spark, sf_dir)
        ingest.ingest(docs, target, log, SAMPLE)
    return spark.read.parquet(target).select(
        "doc_id", digest("text").alias("digest")
    )


@register("q_stream_encode", sql.with_recursive(*_ENCODED) + " SELECT doc_id, ids FROM encoded")
def q_stream_encode(spark, sf_dir):
    target, log = fresh_path(spark, "encoded"), fresh_path(spark, "encode-log")
    docs = _document_stream(spark, sf_dir)
    ingest.ingest_encoded(docs, trained(spark, sf_dir), target, log)
    return spark.read.parquet(target).select("doc_id", joined(F.col("ids")).alias("ids"))


@register(
    "q_stream_encode_large",
    sql.with_recursive(sql.words("benchmark", extra="documents"), sql.training(LARGE), sql.encoded())
    + " SELECT doc_id, ids, n_tokens FROM encoded",
)
def q_stream_encode_large(spark, sf_dir):
    """A stream encoded by chunk; workers keep what they have segmented for later batches."""
    target, log = fresh_path(spark, "encoded"), fresh_path(spark, "encode-log")
    ingest.ingest_encoded(_document_stream(spark, sf_dir), large_model(spark, sf_dir), target, log)
    return spark.read.parquet(target).select(
        "doc_id", joined(F.col("ids")).alias("ids"), F.size("ids").cast("bigint").alias("n_tokens")
    )
