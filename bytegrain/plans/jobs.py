"""The three corpus jobs end to end: shards, tokenizer artifact, token table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bytegrain.functions.text import pattern_text
from bytegrain.model import SPEC, BpeModel, Layout
from bytegrain.operators.chunks import word_freq, word_freq_joined
from bytegrain.operators.corpus import MIN_CHARS, SEED, SHARD_SIZE, prepare_corpus
from bytegrain.operators.encoding import encode
from bytegrain.operators.ordering import in_key_order
from bytegrain.operators.shards import assign_shards, resume_shards
from bytegrain.operators.splits import TRAIN_SHARE, assign_split, cut_split, token_table
from bytegrain.operators.training import train
from bytegrain.session import any_file, scratch
from bytegrain.sources.artifact import load_model, save_model
from bytegrain.sources.tables import (
    landed_documents,
    read_shards,
    write_shards,
    write_token_table,
)


def build_corpus(
    docs: DataFrame,
    target: str,
    fraction: float = 1.0,
    max_shards: int | None = None,
    seed: int = SEED,
    min_chars: int = MIN_CHARS,
    shard_size: int = SHARD_SIZE,
    key: str = "doc_id",
) -> None:
    """Sample, trim, filter and write shards; documents already under `target` are left out.

    `max_shards` caps the shards this run adds. Shards written with another key are an error.
    """
    with scratch():
        kept = prepare_corpus(docs.select(key, "text"), fraction, min_chars, seed, key)
        spark = docs.sparkSession
        if any_file(spark, f"{target}/shard_id=*"):
            landed = landed_documents(spark, target, key)
            sharded = resume_shards(kept, landed, shard_size, key, max_shards)
        else:
            sharded = assign_shards(kept, shard_size, key, max_new=max_shards)
        write_shards(sharded, target, key=key)


def train_tokenizer(
    spark: SparkSession,
    shards: str,
    artifact: str,
    vocab_size: int | None = None,
    layout: Layout = SPEC,
    pattern: str = "cl100k",
    tie: str = "id",
    joined: bool = False,
    key: str = "doc_id",
) -> BpeModel:
    """Train on all shards and save the artifact. With `joined`, the blank lines between
    the documents of a shard are training text too."""
    pattern_text(pattern)
    with scratch():
        docs = read_shards(spark, shards)
        order = key if tie == "first" else None
        if joined:
            last = docs.groupBy("shard_id").agg(F.max(key).alias("_last"))
            marked = docs.join(last, "shard_id").withColumn("shard_last", F.col(key) == F.col("_last"))
            words = word_freq_joined(marked, pattern, order=order)
        else:
            words = word_freq(docs, pattern, order=order)
        model = train(words, vocab_size, layout, pattern, tie)
        save_model(spark, model, artifact)
    return model


def encode_corpus(
    spark: SparkSession,
    shards: str,
    artifact: str,
    target: str,
    pattern: str | None = None,
    add_special: bool = False,
    train_share: float = TRAIN_SHARE,
    by_offset: bool = False,
    seed: int = SEED,
    key: str = "doc_id",
) -> None:
    """Encode all shards into a token table split into training and validation data: by
    document, or with `by_offset` at one position of the whole flat array. The pattern is the
    artifact's own unless one is given."""
    with scratch():
        docs = in_key_order(read_shards(spark, shards).select(key, "text"), key)
        model = load_model(spark, artifact, pattern)
        coded = encode(docs, model, add_special=add_special).select(key, "ids")
        if by_offset:
            coded = coded.withColumn("split", F.lit("all"))
        else:
            coded = assign_split(coded, train_share, seed, key)
        tokens = token_table(coded, key)
        if by_offset:
            tokens = cut_split(tokens.drop("split"), train_share)
        write_token_table(tokens, target)
