"""Toxicity by multiple-instance learning: sentences explain the label of their document."""

from __future__ import annotations

import functools
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bytegrain.llm.arrow import ddl, release, slices
from bytegrain.session import Stage

WORD = re.compile(r"[^\W\d_]+")
SENTENCE = re.compile(r"[^.!?\n]*[^.!?\s][^.!?\n]*")
BEGINNINGS = range(3, 9)  # letters of word beginnings

SAMPLE_DOCUMENTS = 20_000  # labelled documents that a model is fitted on, at most
CANDIDATES = 200_000  # terms of toxic documents that are counted in clean ones
FEATURES = 20_000  # terms of a model
LEAST_TOXIC = 5  # toxic documents that hold a term
LEAST_G2 = 20.0
LEAST_LIFT = 3.0
STEPS, RATE, DECAY = 600, 0.1, 1e-5
OFFENDING = 0.5


def terms(text: str) -> set[str]:
    """Lower-cased words, written `word$`, and word beginnings."""
    words = set(WORD.findall(text.lower()))
    found = {w + "$" for w in words}
    for size in BEGINNINGS:
        found.update([w[:size] for w in words if len(w) >= size])
    return found


@dataclass(frozen=True)
class Model:
    """Log-odds of a sentence: the bias and the weights of the terms that it holds."""

    terms: tuple[str, ...]
    weights: tuple[float, ...]
    bias: float

    def finder(self) -> Finder:
        return _finder(self.terms)

    def sentences(self, text: str) -> tuple[float, list[tuple[int, int, float]]]:
        """The document's score, and its offending sentences as (start, stop, score)."""
        count, held = self.finder().sentences(text)
        total = (count - len(held)) * np.logaddexp(0.0, self.bias)
        offending = []
        for start, stop, found in held:
            rate = np.logaddexp(0.0, self.bias + sum(self.weights[f] for f in found))
            total += rate
            if -np.expm1(-rate) >= OFFENDING:
                offending.append((start, stop, float(-np.expm1(-rate))))
        return float(-np.expm1(-total)), offending


@functools.lru_cache(maxsize=4)
def _finder(known: tuple[str, ...]) -> Finder:
    return Finder(known)


class Finder:
    """Finds terms in sentences with one automaton over the whole text."""

    def __init__(self, known: tuple[str, ...]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        ends: dict[str, list[tuple[int, bool]]] = {}
        for number, term in enumerate(known):
            ends.setdefault(term.rstrip("$"), []).append((number, term.endswith("$")))
        for letters, numbers in ends.items():
            self.automaton.add_word(letters, (len(letters), numbers))
        self.empty = not ends
        if ends:
            self.automaton.make_automaton()

    def sentences(self, text: str) -> tuple[int, list[tuple[int, int, set[int]]]]:
        """How many sentences there are, and those with terms: (start, stop, terms)."""
        lower = text.lower()
        if len(lower) != len(text):  # keep the places of a few letters that grow
            lower = "".join(c.lower()[:1] for c in text)
        spans = [m.span() for m in SENTENCE.finditer(text)]
        if self.empty:
            return len(spans), []
        held: dict[int, set[int]] = {}
        starts = None
        for last, (size, numbers) in self.automaton.iter(lower):
            first = last - size + 1
            if first and _letter(lower[first - 1]):
                continue
            ended = last + 1 == len(lower) or not _letter(lower[last + 1])
            found = [number for number, whole in numbers if ended or not whole]
            if found:
                starts = starts or [start for start, _ in spans]
                held.setdefault(bisect_right(starts, first) - 1, set()).update(found)
        return len(spans), [(*spans[s], held[s]) for s in sorted(held)]


def _letter(sign: str) -> bool:
    return WORD.match(sign) is not None


def fold(key: Column) -> Column:
    """crc32 of the key as text, modulo 3; 0 for null keys."""
    return F.coalesce(F.crc32(key.cast("string")) % 3, F.lit(0))


def labelled_sample(
    docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, bound: int
) -> DataFrame:
    """(_text, _label) of about `bound` labelled documents at most, drawn by key.

    Only the drawn labels are broadcast, so no document moves.
    """
    known = (
        labels.where(F.col(label).isNotNull() & F.col(key).isNotNull())
        .groupBy(F.col(key).alias("_id"))
        .agg(F.max(F.col(label)).cast("int").alias("_label"))
    )
    count = known.count()
    if count > bound:
        drawn = F.conv(F.substring(F.md5(F.col("_id").cast("string")), 1, 12), 16, 10)
        known = known.where(drawn.cast("double") < bound / count * float(1 << 48))
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    return rows.join(F.broadcast(known), F.col("_key") == F.col("_id")).select("_text", "_label")


def count_terms(rows: DataFrame, known: frozenset[str] | None = None) -> DataFrame:
    """(term, n): documents that hold each term, summed within tasks first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_text", 1 << 23):
                counts: Counter[str] = Counter()
                for text in part.column("_text").to_pylist():
                    found = terms(text or "")
                    counts.update(found if known is None else found & known)
                columns = [pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())]
                yield pa.record_batch(columns, ["term", "n"])

    counted = rows.select("_text").mapInArrow(count, "term string, n bigint")
    return counted.groupBy("term").agg(F.sum("n").alias("n"))


def select_terms(sample: DataFrame, toxic: int, clean: int) -> tuple[str, ...]:
    """Terms that mark toxic documents beyond chance (likelihood ratio) and by a margin."""
    of_toxic = (
        count_terms(sample.where("_label = 1"))
        .where(F.col("n") >= LEAST_TOXIC)
        .orderBy(F.desc("n"), "term")
        .limit(CANDIDATES)
        .collect()
    )
    held = {r.term: r.n for r in of_toxic}
    rows = count_terms(sample.where("_label = 0"), frozenset(held)).collect()
    also = {r.term: r.n for r in rows}
    scored = []
    for term, a in held.items():
        b = also.get(term, 0)
        lift = (a / toxic) / max((b + 0.5) / (clean + 1), 1e-12)
        if lift >= LEAST_LIFT:
            scored.append((g2(a, b, toxic, clean), term))
    chosen = [term for score, term in sorted(scored, reverse=True) if score >= LEAST_G2]
    return tuple(sorted(chosen[:FEATURES]))


def g2(a: int, b: int, toxic: int, clean: int) -> float:
    """Likelihood-ratio statistic of a term in `a` of `toxic` and `b` of `clean` documents."""
    seen = np.array([[a, b], [toxic - a, clean - b]], float)
    expected = np.outer(seen.sum(1), seen.sum(0)) / seen.sum()
    with np.errstate(divide="ignore", invalid="ignore"):
        parts = np.where(seen > 0, seen * np.log(seen / expected), 0.0)
    return float(2 * parts.sum())


def bags(sample: DataFrame, known: tuple[str, ...]) -> DataFrame:
    """(label, plain, sentences): how many sentences hold no term, and the terms of the others."""

    def bag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = _finder(known)
        for batch in batches:
            plain, held = [], []
            for text in batch.column("_text").to_pylist():
                count, found = finder.sentences(text or "")
                plain.append(count - len(found))
                held.append([sorted(terms) for *_, terms in found])
            columns = [
                batch.column("_label"),
                pa.array(plain, pa.int64()),
                pa.array(held, pa.list_(pa.list_(pa.int32()))),
            ]
            yield pa.record_batch(columns, ["label", "plain", "sentences"])

    return sample.mapInArrow(bag, "label int, plain bigint, sentences array<array<int>>")


def fit(rows: Iterable, size: int) -> tuple[np.ndarray, float]:
    """Weights and bias that best explain labels by noisy-or over sentences (Adam).

    With rates softplus(z), a document is toxic with probability 1 - exp(-sum of rates).
    """
    labels, plain, owner, sentence, term = [], [], [], [], []
    for row in rows:
        for found in row.sentences:
            sentence += [len(owner)] * len(found)
            term += found
            owner.append(len(labels))
        labels.append(row.label)
        plain.append(row.plain)
    y, n = np.array(labels, float), np.array(plain, float)
    owner, sentence, term = (np.array(x, np.int64) for x in (owner, sentence, term))
    theta = np.zeros(size + 1)
    theta[size] = -8.0
    mean, square = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, STEPS + 1):
        bias = theta[size]
        z = bias + np.bincount(sentence, theta[term], len(owner))
        rate = np.bincount(owner, np.logaddexp(0.0, z), len(y)) + n * np.logaddexp(0.0, bias)
        rate = np.maximum(rate, 1e-9)
        slope = np.where(y > 0, -1.0 / np.expm1(np.minimum(rate, 700.0)), 1.0) / len(y)
        inner = slope[owner] / (1.0 + np.exp(-z))
        grad = np.zeros_like(theta)
        grad[:size] = np.bincount(term, inner[sentence], size) + DECAY * theta[:size]
        grad[size] = inner.sum() + (slope * n).sum() / (1.0 + np.exp(-bias))
        mean = 0.9 * mean + 0.1 * grad
        square = 0.999 * square + 0.001 * grad**2
        theta -= RATE * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    return theta[:size], float(theta[size])


def train_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    bound: int = SAMPLE_DOCUMENTS,
) -> Model:
    """Fit a model to at most about `bound` labelled documents, drawn by key.

    Terms are chosen by counts over that sample; the fit sees the terms of sentences, not
    texts, on the driver. Keys with several labels count as toxic if one of them says so;
    null keys, labels without a document and null labels are left out. Without toxic or clean
    documents the model has no terms.
    """
    sample = Stage(labelled_sample(docs, labels, key, text, label, bound), "labelled")
    counts = {r["_label"]: r["count"] for r in sample.df.groupBy("_label").count().collect()}
    toxic, clean = counts.get(1, 0), counts.get(0, 0)
    if not toxic or not clean:
        sample.drop()
        return Model((), (), -20.0)
    known = select_terms(sample.df, toxic, clean)
    weights, bias = fit(bags(sample.df, known).toLocalIterator(), len(known))
    sample.drop()
    return Model(known, tuple(weights.tolist()), bias)


def score_toxicity(
    docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(key, score, offending): the noisy-or of all sentences of the whole text, and the
    offending sentences as spans of characters with scores; one row for each row.

    Narrow. Null texts, empty texts and texts without a sentence score 0. Rows with null or
    repeated keys are kept apart, other columns are not read.
    """

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("score", pa.float64())])
        for batch in batches:
            scores, spans = [], []
            for row in range(batch.num_rows):
                value, found = model.sentences(batch.column("_text")[row].as_py() or "")
                scores.append(min(max(value, 0.0), 1.0))
                spans.append([{"start": a, "stop": b, "score": s} for a, b, s in found])
            columns = [batch.column("_key"), pa.array(scores), pa.array(spans, pa.list_(span))]
            yield pa.record_batch(columns, ["_key", "score", "offending"])

    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    spans = "array<struct<start: int, stop: int, score: double>>"
    return rows.mapInArrow(
        score, f"_key {ddl(docs, key)}, score double, offending {spans}"
    ).withColumnRenamed("_key", key)


def reject_toxic(docs: DataFrame, model: Model, threshold: float, text: str = "text") -> DataFrame:
    """The rows of `docs`, all columns as they are, whose text scores below the threshold.

    Narrow; a text goes to its worker once and comes back in slices. Null and empty texts score
    0. Rows with null or repeated keys are judged one by one; an empty table gives no rows.
    """

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for part in slices(batch, text):
                scores = [model.sentences(value.as_py() or "")[0] for value in part.column(text)]
                yield part.filter(pa.array([score < threshold for score in scores], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
