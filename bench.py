"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR names the tables (default sf0.1), BENCH_CPUS the local cores (default 8).
Every query runs in full into a sink that discards rows, after a warm-up on sf0.001.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from bytegrain.model import SPEC, BpeModel
from bytegrain.operators.chunks import word_freq
from bytegrain.operators.encoding import encode, segment_chunks
from bytegrain.operators.training import train
from bytegrain.plans import catalog
from bytegrain.session import Stage

HEADLINE = (
    "q_corpus_stats",
    "q_shards",
    "q_word_freq",
    "q_word_freq_legacy",
    "q_pair_counts",
    "q_train_merges",
    "q_encode",
    "q_encode_unseen",
    "q_decode",
    "q_roundtrip",
    "q_compression",
    "q_token_freq",
    "q_token_table",
    "q_stream_ingest",
    "q_stream_encode",
)


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def yardstick(spark: SparkSession) -> None:
    """A fixed sum, to tell a slower machine from a slower library."""
    run(spark.range(1_000_000_000).select(F.sum(F.col("id") % 7 * F.col("id") % 11)))


def train_many(spark: SparkSession, sf_dir: str, merges: int) -> BpeModel:
    words = word_freq(catalog.documents(spark, sf_dir, "doc_id", "text"))
    return train(words, SPEC.merges_start + merges)


def long_chunks(spark: SparkSession, sf_dir: str, cpus: int):
    """The letters of the documents as chunks of 3,000, none of which recurs."""
    letters = F.regexp_replace("text", "[^A-Za-z]", "")
    docs = catalog.documents(spark, sf_dir).select("doc_id", letters.alias("text")).where("length(text) >= 3000")
    pieces = F.transform(
        F.sequence(F.lit(0), F.floor(F.length("text") / 3000).cast("int") - 1),
        lambda i: F.concat(F.substr("text", i * 3000 + 1, F.lit(3000))),
    )
    return docs.select(F.explode(pieces).alias("chunk")).distinct().limit(4000).repartition(cpus)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    here = os.path.dirname(os.path.abspath(__file__))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.executorEnv.PYTHONPATH", here)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalog.QUERIES
    for name in HEADLINE:
        run(queries[name](spark, "/root/testdata/sf0.001"))
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        run(queries[name](spark, sf_dir))
        seconds[name] = round(time.perf_counter() - start, 3)
    details = {}

    def timed(name: str, action):
        start = time.perf_counter()
        result = action()
        seconds[name] = round(time.perf_counter() - start, 3)
        return result

    for name, merges in (("512_merges", 512), ("6000_merges", 6000), ("full_vocabulary", catalog.FULL)):
        model = timed(f"train_{name}", lambda: train_many(spark, sf_dir, merges))
        details[f"rounds_{name}"] = model.rounds
        for again in ("first", "again"):  # what the first run segments, workers remember
            key = f"encode_{name.split('_')[0]}_{again}"
            timed(key, lambda: run(encode(catalog.documents(spark, sf_dir), model).select("doc_id", "ids")))
    long = Stage(long_chunks(spark, sf_dir, int(cpus)), "long").df.repartition(int(cpus))
    size = long.agg(F.sum(F.octet_length("chunk"))).first()[0] or 0
    timed("encode_long_chunks", lambda: run(segment_chunks(long, model)))
    details["long_chunks_kb"] = round(size / 1000)
    details["long_chunks_kb_per_thread_second"] = round(size / 1000 / seconds["encode_long_chunks"] / int(cpus), 1)
    timed("yardstick", lambda: yardstick(spark))
    total = round(sum(seconds.values()), 3)
    result = {"metric": "headline_total", "value": total, "unit": "sec", "queries": seconds, "details": details}
    print(json.dumps({**result, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
