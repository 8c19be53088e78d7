"""Encoding whole corpora as one narrow pass: no shuffle, and no row leaves its partition.

A short merge list is replayed on each text as a whole, its chunks kept apart by a
character that is no token. For longer lists the JVM splits texts into chunks and an Arrow
function takes the distinct chunks of a batch, piece by piece, and gathers ids by array
operations. A worker remembers short chunks for all its later batches, tasks and queries of
the model, up to a bound, so a frequent chunk is seldom segmented, and skew cannot arise.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bytegrain.functions.rows import explode_computed
from bytegrain.functions.segment import held_segmenter, merges_key
from bytegrain.functions.text import pretokenize
from bytegrain.functions.tokens import (
    BORDER,
    MAX_VOCAB,
    adjacent_pairs,
    apply_merges,
    byte_tokens,
    merge_literal,
    sign,
    token_ids,
)
from bytegrain.model import BpeModel
from bytegrain.session import Stage

WHOLE_TEXT_MERGES = 8  # up to here, replaying all merges on the text beats chunk lookups
BROADCAST_PAIRS = 1_000_000


def encode(
    docs: DataFrame,
    model: BpeModel,
    text: str = "text",
    add_special: bool = False,
    out: str = "ids",
) -> DataFrame:
    """Add the id array of each text. Special-token names in the text are plain text."""
    chunks = pretokenize(F.col(text), model.pattern)
    if len(model.merges) <= WHOLE_TEXT_MERGES and model.vocab_size <= MAX_VOCAB:
        tokens = F.array_join(F.transform(chunks, byte_tokens), BORDER)
        merged = apply_merges(tokens, merge_literal([(pair, new) for _, pair, new in pair_signs(model)]))
        ids = token_ids(F.replace(merged, F.lit(BORDER), F.lit("")))
    else:
        ids = segmenter(model)(chunks)
    if add_special:
        bos, eos = (F.array(F.lit(model.layout.special_id(s))) for s in ("<BOS>", "<EOS>"))
        ids = F.concat(bos, ids, eos)
    return docs.withColumn(out, ids)


def segmenter(model: BpeModel):
    """A column function from arrays of chunks to arrays of ids."""
    merges = np.array([(a, b) for a, b, _ in model.merges], np.int32).reshape(-1, 2)
    first_id = model.layout.merges_start
    key = merges_key(merges, first_id)

    def ids_of(chunks: pa.Array) -> pa.Array:
        return held_segmenter(key, merges, first_id).encode(chunks)

    return F.arrow_udf(ids_of, "array<int>")


def segment_chunks(words: DataFrame, model: BpeModel) -> DataFrame:
    """Add `ids`, the ids of each row's `chunk`."""
    return words.withColumn("ids", segmenter(model)(F.array("chunk")))


def pair_signs(model: BpeModel) -> list[tuple[int, str, str]]:
    """(rank, pair, new token) as signs of token strings, in rank order."""
    return [(rank, sign(left) + sign(right), sign(new)) for rank, left, right, new, _ in model.merge_rows]


def rank_table(spark: SparkSession, model: BpeModel) -> DataFrame:
    """(pair, rank, new): what a pair of tokens becomes; of a repeated pair the first rank."""
    rows: dict[str, tuple[int, str, str]] = {}
    for rank, pair, new in pair_signs(model):
        rows.setdefault(pair, (rank, pair, new))
    return spark.createDataFrame(list(rows.values()), "rank int, pair string, new string")


def segment_by_rounds(words: DataFrame, model: BpeModel) -> DataFrame:
    """(chunk, ids) of the distinct chunks of `words`, by joins alone.

    In each round the pairs of all chunks that still change meet the table of ranks, and each
    chunk has its lowest pair merged, everywhere from the left. Rounds end when no pair is met:
    as many as the merges of the slowest chunk, so this suits many chunks of moderate length.
    """
    ranks = rank_table(words.sparkSession, model)
    if len(model.merges) <= BROADCAST_PAIRS:
        ranks = F.broadcast(ranks)
    distinct = words.select("chunk").where("chunk IS NOT NULL").distinct()
    open_, done = Stage(distinct.withColumn("tokens", byte_tokens(F.col("chunk"))), "open"), []
    while not open_.df.isEmpty():
        pairs = explode_computed(open_.df, ["chunk"], F.array_distinct(adjacent_pairs(F.col("tokens"))), "pair")
        lowest = pairs.join(ranks, "pair").groupBy("chunk").agg(F.min(F.struct("rank", "pair", "new")).alias("low"))
        met = Stage(open_.df.join(lowest, "chunk", "left"), "met")
        done.append(met.df.where("low IS NULL").select("chunk", "tokens"))
        merged = F.replace(F.col("tokens"), F.col("low.pair"), F.col("low.new"))
        after = Stage(met.df.where("low IS NOT NULL").select("chunk", merged.alias("tokens")), "open")
        open_.drop()
        open_ = after
    found = done[0] if done else distinct.withColumn("tokens", F.lit(""))
    for part in done[1:]:
        found = found.union(part)
    return found.select("chunk", token_ids(F.col("tokens")).alias("ids"))
