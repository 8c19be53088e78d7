import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import brute
from bytegrain.functions import runs
from bytegrain.model import COMPACT, SPEC, Layout
from bytegrain.operators.chunks import word_freq
from bytegrain.operators.pairs import (
    best_pair,
    count_pairs,
    merge_tokens,
    pair_ids,
    token_table,
)
from bytegrain.operators import training
from bytegrain.operators.training import train


def state_of(spark, *chunks):
    rows = [(1, "".join(map(chr, c))) for c in chunks]
    return spark.createDataFrame(rows, "freq bigint, tokens string")


def corpus_words(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    return word_freq(docs, order="doc_id")


def word_table(spark, chunks):
    """A frequency table in corpus order straight from chunks."""
    rows = {}
    for i, c in enumerate(chunks):
        freq, first = rows.get(c, (0, (0, i)))
        rows[c] = (freq + 1, first)
    return spark.createDataFrame(
        [(c, n, first) for c, (n, first) in rows.items()],
        "chunk string, freq bigint, first struct<doc_id bigint, pos int>",
    )


def test_overlapping_pairs_are_counted(spark):
    got = {
        (r.left_id, r.right_id): r.n
        for r in pair_ids(count_pairs(state_of(spark, [1, 2, 1, 2, 3]))).collect()
    }
    assert got == {(1, 2): 2, (2, 1): 1, (2, 3): 1}
    (row,) = count_pairs(state_of(spark, [1, 1, 1])).collect()
    assert row.n == 2


def test_best_pair(spark):
    rows = [("\1\2", 10), ("\3\4", 5), ("\5\6", 20)]
    counts = spark.createDataFrame(rows, "pair string, n bigint")
    assert best_pair(counts).first().pair == "\5\6"
    assert best_pair(counts.where("n > 99")).count() == 0
    tied = spark.createDataFrame([("\5\1", 7), ("\3\4", 7), ("\3\5", 7)], "pair string, n bigint")
    assert best_pair(tied).first().pair == "\3\4"


def test_merge_left_to_right_without_overlap(spark):
    state = state_of(spark, [1, 2, 1, 2, 3], [1, 1, 1])
    got = [r.tokens for r in merge_tokens(state, [("\1\2", "c")]).collect()]
    assert [ord(c) for c in got[0]] == [99, 99, 3]
    got = [r.tokens for r in merge_tokens(state, [("\1\1", "c")]).collect()]
    assert [ord(c) for c in got[1]] == [99, 1]


def key(left, right):
    return left << 32 | right


def chain_of(text):
    return np.array([*map(ord, text)], "<i4").tobytes()


def token_lists(*texts):
    return pa.array([[ord(c) for c in t] for t in texts], pa.list_(pa.int32()))


def test_chains_end_where_a_pair_is_not_hot():
    hot = np.array(sorted(key(ord(a), ord(b)) for a, b in ("ab", "b\n", "aa", "^]")), np.int64)
    tokens = token_lists("abcab\nab", "xab^]", "aaaa", "b")
    chains, n, row, at = runs.chain_sums(tokens, np.array([2, 3, 1, 5]), hot)
    got = {c: (k, r, i) for c, k, r, i in zip(chains.to_pylist(), n.tolist(), row.tolist(), at.tolist())}
    assert got == {
        chain_of("ab"): (7, 0, 0), chain_of("ab\n"): (2, 0, 3), chain_of("aaaa"): (1, 2, 0), chain_of("^]"): (3, 1, 3)
    }
    new, changed = runs.rewritten(tokens, hot, lambda c: {chain_of("ab"): chain_of("X")}.get(c, c))
    assert new.to_pylist() == token_lists("Xcab\nX", "xX^]", "aaaa", "b").to_pylist()
    assert changed.tolist() == [True, True, False, False]
    none = np.array([key(1, 1)], np.int64)
    assert runs.rewritten(tokens, none, lambda c: c)[0].to_pylist() == tokens.to_pylist()


@pytest.mark.parametrize("run, form", [("aa", "N"), ("aaa", "Na"), ("aaaa", "NN"), ("ab", "N")])
def test_runs_of_one_pair_merge_from_the_left(run, form):
    assert runs.merge_run(chain_of(run), ord("N")) == chain_of(form)


def test_pair_sums_are_exact_and_first_places_are_kept():
    many = 1 << 60
    tokens = pa.array([[1, 2, 1, 2], None, [], [3], [1, 1, 1]], pa.list_(pa.int32()))
    pairs, n, row, at = runs.pair_sums(tokens, np.array([many + 1, 9, 9, 9, 7]))
    got = {p: (k, r, i) for p, k, r, i in zip(pairs.tolist(), n.tolist(), row.tolist(), at.tolist())}
    assert got == {key(1, 2): (2 * many + 2, 0, 0), key(2, 1): (many + 1, 0, 1), key(1, 1): (14, 4, 0)}
    empty = runs.pair_sums(pa.array([], pa.list_(pa.int32())), np.zeros(0, np.int64))
    assert [len(part) for part in empty] == [0, 0, 0, 0]


@pytest.mark.parametrize("broadcast", [True, False])
def test_counts_after_each_round_are_those_of_a_recount(spark, monkeypatch, broadcast):
    """The kept table of counts, against one made of the state from scratch."""
    if not broadcast:
        monkeypatch.setattr(training, "BROADCAST_PAIRS", -1)
    seen = []
    change = training.count_changes

    def compare(counts, state, next_id):
        after = change(counts, state, next_id)
        kept = Counter({r.pair: r.n for r in after.collect()})
        again = Counter({r.pair: r.n for r in training.pair_counts(state, ["freq"]).collect()})
        seen.append(kept == again)
        return after

    monkeypatch.setattr(training, "count_changes", compare)
    rng = random.Random(4)
    chunks = ["".join(rng.choice("abcd") for _ in range(rng.randint(1, 12))) for _ in range(50)]
    got = train(word_table(spark, chunks), 260 + 40, COMPACT, max_chains=30)
    assert got.merges == brute.train([c.encode() for c in chunks], 40, 260) and len(seen) > 2 and all(seen)


@pytest.mark.parametrize("tie", ["id", "first"])
def test_ids_across_the_surrogates(spark, tie):
    """Merges get ids on both sides of 55,296, and beyond the surrogates."""
    layout = Layout("wide", 256, ("<UNK>",), 55_290 - 257)
    rng = random.Random(5)
    chunks = ["".join(rng.choice("abc") for _ in range(rng.randint(2, 14))) for _ in range(40)]
    got = train(word_table(spark, chunks), layout.merges_start + 25, layout, tie=tie)
    assert got.merges == brute.train([c.encode() for c in chunks], 25, 55_290, tie)
    assert got.vocab_size == 55_315


@pytest.mark.parametrize("tie", ["id", "first"])
@pytest.mark.parametrize("max_chains", [2, 12, 8192])
def test_rounds_equal_one_merge_at_a_time(spark, tie, max_chains):
    rng = random.Random(max_chains)
    for trial in range(2):
        letters = "ab" if trial == 0 else "abcde"
        chunks = [
            "".join(rng.choice(letters) for _ in range(rng.randint(1, 9)))
            for _ in range(rng.randint(3, 40))
        ]
        got = train(word_table(spark, chunks), 260 + 15, COMPACT, tie=tie, max_chains=max_chains)
        want = brute.train([c.encode() for c in chunks], 15, 260, tie)
        assert got.merges == want


def test_several_merges_per_round(spark):
    text = "river stone over river stone under " * 50
    model = train(corpus_words(spark, [text]), 528 + 8)
    assert len(model.merges) == 8 and model.rounds < 8


def test_first_seen_ties_follow_corpus_order(spark):
    """Documents and positions, not chunk spelling, decide between equal counts."""
    texts = ["zebra quark", "quark zebra apple", "apple"]
    model = train(corpus_words(spark, texts), 260 + 10, COMPACT, tie="first")
    chunks = [b"zebra", b" quark", b"quark", b" zebra", b" apple", b"apple"]
    assert model.merges == brute.train(chunks, 10, 260, "first")


def test_early_stop_and_size_check(spark):
    words = spark.createDataFrame([("ab", 3), ("c", 1)], "chunk string, freq bigint")
    model = train(words, 1000)
    assert model.merges == [(97, 98, 3)] and model.vocab_size == 529
    for size in (528, 0x110000):
        with pytest.raises(ValueError):
            train(words, size)
    with pytest.raises(ValueError):
        train(words, 600, tie="random")


def test_result_does_not_depend_on_partitioning(spark):
    texts = ["the cat sat on the mat", "the dog ate the cat", "that hat"] * 3
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    runs = [train(word_freq(docs.repartition(n)), SPEC.merges_start + 12).merges for n in (1, 7)]
    assert runs[0] == runs[1]


def test_token_table_drops_single_tokens(spark):
    words = spark.createDataFrame([("a", 5), ("é", 1)], "chunk string, freq bigint")
    rows = token_table(words).select("freq", F.length("tokens").alias("n")).collect()
    assert [(r.freq, r.n) for r in rows] == [(1, 2)]
