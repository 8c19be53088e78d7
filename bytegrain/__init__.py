"""Tokenizer corpora on Spark: prepare, train, encode, decode, all DataFrame to DataFrame."""

from bytegrain.model import COMPACT, SPEC, BpeModel, Layout
from bytegrain.operators.chunks import chunk_table, train_size, word_freq, word_freq_joined
from bytegrain.operators.corpus import corpus_stats, prepare_corpus, sample_corpus
from bytegrain.operators.decoding import decode
from bytegrain.operators.encoding import encode, segment_by_rounds, segment_chunks
from bytegrain.operators.shards import assign_shards, cap_shards, resume_shards, shard_text
from bytegrain.operators.splits import assign_split, cut_split, token_offsets, token_table
from bytegrain.operators.training import train
from bytegrain.plans.jobs import build_corpus, encode_corpus, train_tokenizer
from bytegrain.sources.artifact import load_model, save_model

__all__ = [
    "BpeModel",
    "COMPACT",
    "Layout",
    "SPEC",
    "assign_shards",
    "assign_split",
    "build_corpus",
    "cap_shards",
    "chunk_table",
    "corpus_stats",
    "cut_split",
    "decode",
    "encode",
    "encode_corpus",
    "load_model",
    "prepare_corpus",
    "resume_shards",
    "sample_corpus",
    "save_model",
    "segment_by_rounds",
    "segment_chunks",
    "shard_text",
    "token_offsets",
    "token_table",
    "train",
    "train_size",
    "train_tokenizer",
    "word_freq",
    "word_freq_joined",
]
