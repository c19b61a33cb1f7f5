"""Quality grades by ordinal cumulative-link regression on hashed text features.

One weight vector is shared by all grades, and ordered thresholds cut its score: P(grade >= k) = sigmoid(score - threshold k).
Features are presences of a document's distinct words, each with its five-character stem and its shape, hashed into
``BUCKETS``. The model is fitted on a bounded sample of labelled rows (``sample`` rows, those with the smallest hash of
the id); documents are scored whole, without a shuffle.

Grades from labels: 0 toxic, 1 poor quality, 2 good.

Cases: null text counts as empty and gets the grade the thresholds give; labels with null id, or without quality and toxicity, are
not used; repeated labels count as often as they stand; labels without document are not used. Without any usable label
nothing is rejected (tail probability 1). Repeated rows stay apart. Empty tables give no rows. ``select_documents`` passes on all
columns under their names.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

BUCKETS = 1 << 28
SAMPLE = 8000
#: A feature is used if so many sampled documents have it.
LEAST_DOCUMENTS = 4
#: ... and a grade's documents have it more or less often than chance by so many standard deviations.
DEVIATIONS = 5.0
GRADES = 3
#: Distinct words whose score a task keeps.
KEPT = 200_000
TRIM = ".,;:!?\"'()[]{}«»“”"
RUNS = re.compile(r"(.)\1+")


class Kinds(dict):
    """Kind of each character: small or capital letter, digit, ASCII mark as it is, else x."""

    def __missing__(self, point: int) -> str:
        c = chr(point)
        self[point] = out = "a" if c.islower() else "A" if c.isupper() else "0" if c.isdigit() else c if c < "\x80" else "x"
        return out


KINDS = Kinds()


def word_features(word: str) -> tuple[int, ...]:
    """Buckets of a word, its stem and its shape."""
    low = word.lower()
    core = low.strip(TRIM)
    shape = RUNS.sub(r"\1", word[:40].translate(KINDS))
    own = {f"s{shape}"}
    if core:
        own |= {f"w{core}", f"p{core[:5]}"}
    return tuple(sorted(zlib.crc32(x.encode("utf-8", "surrogatepass")) % BUCKETS for x in own))


class Features(dict):
    """Features of words, kept for up to ``KEPT`` of them."""

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= KEPT:
            self.clear()
        self[word] = out = word_features(word)
        return out


def text_features(text: str, features: Features) -> np.ndarray:
    return np.unique(np.array([f for w in set(text.split()) for f in features[w]], dtype=np.int32))


@dataclass
class Model:
    """Weights of the buckets that have any, and thresholds in ascending order."""

    buckets: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ..., a column each."""
        return 1 / (1 + np.exp(-np.clip(scores[:, None] - self.thresholds[None, :], -30, 30)))


def telling(flat: np.ndarray, row: np.ndarray, grades: np.ndarray, least: int, deviations: float) -> np.ndarray:
    """Buckets that ``least`` rows have, and some grade's rows more or less often than chance by so many standard deviations."""
    buckets, counts = np.unique(flat, return_counts=True)
    buckets, counts = buckets[counts >= least], counts[counts >= least]
    best = np.zeros(len(buckets))
    for g in range(GRADES):
        share = min(max(np.mean(grades == g), 1e-9), 1 - 1e-9)
        seen, times = np.unique(flat[(grades == g)[row]], return_counts=True)
        own = np.zeros(len(buckets))
        if len(seen):
            at = np.minimum(np.searchsorted(seen, buckets), len(seen) - 1)
            own = np.where(seen[at] == buckets, times[at], 0)
        best = np.maximum(best, np.abs(own - counts * share) / np.sqrt(counts * share * (1 - share)))
    return buckets[best >= deviations]


def fit(features: list[np.ndarray], grades: np.ndarray, rounds: int = 200, rate: float = 0.1, penalty: float = 5e-4, least: int = LEAST_DOCUMENTS, deviations: float = DEVIATIONS) -> Model | None:
    """Full-batch Adam on the ordinal likelihood, with an L2 penalty. None without rows."""
    if not len(features):
        return None
    flat = np.concatenate([np.zeros(0, np.int32), *features])
    row = np.repeat(np.arange(len(features), dtype=np.int32), [len(f) for f in features])
    buckets = telling(flat, row, grades, least, deviations)
    used = np.isin(flat, buckets)
    row, place, n = row[used], np.searchsorted(buckets, flat[used]), len(features)
    del flat, used
    # thresholds as a first one and logarithms of the gaps
    share = np.array([(np.sum(grades >= k) + 1) / (n + 2) for k in range(1, GRADES)])
    first = np.sort(-np.log(share / (1 - share)))
    params = np.concatenate([np.zeros(len(buckets)), [first[0]], np.log(np.maximum(np.diff(first), 0.05))])
    m, v, size = np.zeros_like(params), np.zeros_like(params), len(buckets)
    for t in range(1, rounds + 1):
        w, gaps = params[:size], np.exp(params[size + 1 :])
        thresholds = params[size] + np.concatenate([[0.0], np.cumsum(gaps)])
        scores = np.bincount(row, weights=w[place], minlength=n)
        # P(grade = g) is a difference of neighbouring tails
        tails = 1 / (1 + np.exp(-np.clip(scores[:, None] - thresholds[None, :], -30, 30)))
        upper = np.concatenate([np.ones((n, 1)), tails], axis=1)[np.arange(n), grades]
        lower = np.concatenate([tails, np.zeros((n, 1))], axis=1)[np.arange(n), grades]
        chance = np.maximum(upper - lower, 1e-9)
        du, dl = upper * (1 - upper) / chance, lower * (1 - lower) / chance
        by_score = (du - dl) / n
        by_threshold = np.zeros(GRADES - 1)
        for k in range(GRADES - 1):
            by_threshold[k] = (-du[grades == k + 1].sum() + dl[grades == k].sum()) / n
        gradient = np.concatenate([np.bincount(place, weights=by_score[row], minlength=size) - penalty * w, [by_threshold.sum()], gaps * np.array([by_threshold[k + 1 :].sum() for k in range(GRADES - 2)])])
        m = 0.9 * m + 0.1 * gradient
        v = 0.999 * v + 0.001 * gradient**2
        params = params + rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    gaps = np.exp(params[size + 1 :])
    return Model(buckets, params[:size], params[size] + np.concatenate([[0.0], np.cumsum(gaps)]))


def grade_of():
    return F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2)


def train(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | None:
    """Fits on at most ``sample`` labelled rows. Only their features come to the driver."""
    chosen = labels.select(F.col("doc_id").cast("bigint").alias("label_id"), grade_of().alias("grade")).dropna().orderBy(F.xxhash64("label_id"), "label_id", "grade").limit(sample)
    schema = pa.schema([("grade", pa.int32()), ("features", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for b in slices(batches):
            own = [text_features(t or "", features) for t in b.column(b.schema.get_field_index("text")).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(own, pa.list_(pa.int32()))], schema=schema)

    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # the sample is bounded by its parameter, so it may be broadcast
    joined = docs.join(F.broadcast(chosen), F.col("doc_id") == F.col("label_id")).select(F.col("grade").cast("int"), "text")
    rows = joined.mapInArrow(run, "grade int, features array<int>").toArrow()
    found = rows.column("features").combine_chunks()
    ends = np.concatenate([[0], np.cumsum(pa.compute.list_value_length(found).to_numpy())]) if len(found) else [0]
    flat = found.flatten().to_numpy() if len(found) else np.zeros(0, np.int32)
    features, grades = [flat[a:b] for a, b in zip(ends[:-1], ends[1:])], rows.column("grade").to_numpy().astype(np.int64)
    # in an order of its own, so that the sum of rounding errors is the same at any partitioning
    order = sorted(range(len(features)), key=lambda i: (int(grades[i]), len(features[i]), zlib.crc32(features[i].tobytes())))
    return fit([features[i] for i in order], grades[order])


class Scorer:
    """Scores of texts; those of frequent words are kept."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.weights = dict(zip(model.buckets.tolist(), model.weights.tolist()))
        self.known: dict[str, tuple[int, ...]] = {}

    def features(self, word: str) -> tuple[int, ...]:
        """Features of a word that have a weight."""
        if len(self.known) >= KEPT:
            self.known.clear()
        own = self.known[word] = tuple(f for f in word_features(word) if f in self.weights)
        return own

    def score(self, text: str) -> float:
        known, found = self.known, set()
        for w in set(text.split()):
            own = known.get(w)
            found.update(self.features(w) if own is None else own)
        weights = self.weights
        # summed in order: the same at any partitioning
        return sum([weights[f] for f in sorted(found)])


def graded(documents: DataFrame, model: Model | None) -> DataFrame:
    """All columns of ``documents`` and ``_score, _expected, _tail``: score, expected grade and P(grade >= 2)."""
    if model is None:
        return documents.withColumn("_score", F.lit(0.0)).withColumn("_expected", F.lit(None).cast("double")).withColumn("_tail", F.lit(1.0))
    at, spark = documents.columns.index("text"), documents.sparkSession
    shared = spark.sparkContext.broadcast(model)
    kept: list[Scorer] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not kept:
            kept.append(Scorer(shared.value))
        scorer = kept[0]
        for b in slices(batches):
            scores = np.array([scorer.score(t or "") for t in b.column(at).to_pylist()], dtype=np.float64)
            tails = scorer.model.tails(scores)
            own = [pa.array(scores), pa.array(tails.sum(axis=1)), pa.array(tails[:, -1])]
            yield pa.RecordBatch.from_arrays([*b.columns, *own], names=[*b.schema.names, "_score", "_expected", "_tail"])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in documents.schema] + ["_score double", "_expected double", "_tail double"])
    return documents.mapInArrow(run, schema)


#: A document is selected if it is good with this probability at least.
SELECT = 0.4


def grade_documents(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE, select: float = SELECT) -> DataFrame:
    """``doc_id, score, expected_grade, tail_probability, selected`` of each document."""
    rows = graded(documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")), train(documents, labels, sample))
    return rows.select("doc_id", F.round("_score", 9).alias("score"), F.round("_expected", 9).alias("expected_grade"), F.round("_tail", 9).alias("tail_probability"), (F.col("_tail") >= select).alias("selected"))


def select_documents(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE, select: float = SELECT) -> DataFrame:
    """Rows of ``documents`` that are good with probability ``select`` at least; all columns."""
    model = train(documents, labels, sample)
    if model is None:
        return documents
    names = [f"c{i}" if c != "text" else "text" for i, c in enumerate(documents.columns)]
    rows = graded(documents.toDF(*names), model).filter(F.col("_tail") >= select)
    return rows.select(*[F.col(n).alias(c) for n, c in zip(names, documents.columns)])
