"""Toxicity scores of whole texts: a linear classifier over character n-grams scaled by naive Bayes ratios.

A feature is a hashed character n-gram; its value in a text is its number of occurrences per `UNIT` characters, at
most `MOST`. From labelled texts each feature gets the logarithm of the ratio of its smoothed shares in toxic and in
other texts; values are multiplied by it, and a logistic regression over the scaled values is trained.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aulario.llm.ngrams import Rows, buckets, code_points, sigmoid
from aulario.llm.texts import slices, tidy
from aulario.llm.work import written

ORDERS = (3, 4, 5, 6)
BITS = 22
#: Length to which counts are related; shorter texts count as so long.
UNIT = 300
MOST = 2.0
#: Features are the strongest so many of those in at least LEAST_TEXTS training texts.
FEATURES = 1 << 14
LEAST_TEXTS = 5
SMOOTHING = 1.0
RIDGE = 1e-4
ROUNDS = 200
#: Labelled texts that the classifier is fitted on, at most, of each class: those whose ids have the least hashes.
SAMPLE_PER_CLASS = 2000
#: Text whose n-grams are in memory at once, in bytes, or one text.
AT_ONCE = 1 << 18


def _features(
    texts: list[str | None], wanted: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text number, bucket, value) of all features of each text, and the number of features before each text."""
    points, bounds = code_points(texts)
    keys = [np.zeros(0, np.int64)]
    for start, bucket in buckets(points, bounds, ORDERS, BITS):
        if wanted is not None:
            some = np.flatnonzero(wanted[bucket])
            start, bucket = start[some], bucket[some]
        keys.append(((np.searchsorted(bounds, start, side="right") - 1) << BITS) | bucket)
    found, count = np.unique(np.concatenate(keys), return_counts=True)
    text = found >> BITS
    value = np.minimum(count * float(UNIT) / np.maximum(np.diff(bounds), UNIT)[text], MOST)
    return text, found & ((1 << BITS) - 1), value, np.searchsorted(text, np.arange(len(texts) + 1))


@dataclass(frozen=True)
class Model:
    """Weights of some buckets; all others weigh nothing."""

    bucket: np.ndarray
    weight: np.ndarray
    bias: float

    def table(self) -> np.ndarray:
        table = np.zeros(1 << BITS, dtype=np.float32)
        table[self.bucket] = self.weight
        return table


def scores(texts: list[str | None], table: np.ndarray, bias: float) -> np.ndarray:
    text, bucket, value, _ = _features(texts, table)
    return sigmoid(np.bincount(text, weights=table[bucket] * value, minlength=len(texts)) + bias)


def labelled_sample(docs: DataFrame, labels: DataFrame, per_class: int) -> tuple[DataFrame, dict[int, int]]:
    """(label, text) of at most `per_class` labelled documents of each class, written; and how many there are of each.

    `labels` has (doc_id, label); which documents are taken depends on hashes of their ids only. A document counts once:
    its label is 1 if any of its label rows says so, and of several rows with its id the least text stands for it. The
    ids taken are at most 2 * per_class, so they may be broadcast.
    """
    sound = labels.where("doc_id is not null and label in (0, 1)")
    sound = sound.groupBy("doc_id").agg(F.max(F.col("label").cast("int")).alias("label"))
    counts = {r[0]: r[1] for r in sound.groupBy("label").count().collect()}
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    taken = [sound.where(F.col("label") == c).orderBy(*order).limit(per_class) for c in (0, 1)]
    ids = taken[0].union(taken[1]).withColumnRenamed("doc_id", "taken_id")
    both = docs.select("doc_id", "text").join(F.broadcast(ids), F.col("doc_id") == F.col("taken_id"))
    one = both.groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    return written(one.select("label", "text")), counts


def _strongest(sample: DataFrame) -> list[tuple[int, float]]:
    """(bucket, log-count ratio) of the strongest features; their number is bounded by FEATURES."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, most=AT_ONCE):
                toxic = part.column(0).to_numpy() == 1
                text, bucket, value, _ = _features(part.column(1).to_pylist())
                found, back = np.unique(bucket, return_inverse=True)
                mass = [np.bincount(back, weights=value * (toxic[text] == c)) for c in (True, False)]
                arrays = (found, np.bincount(back), *mass)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], ["bucket", "n", "toxic", "other"])

    mass = (
        sample.mapInArrow(tidy(run), "bucket long, n long, toxic double, other double")
        .groupBy("bucket")
        .agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    )
    mass = written(mass)
    whole = mass.agg(F.sum("toxic"), F.sum("other")).first()
    if whole[0] is None:
        return []
    a, spread = SMOOTHING, SMOOTHING * (1 << BITS)
    ratio = F.log((F.col("toxic") + a) / (whole[0] + spread)) - F.log((F.col("other") + a) / (whole[1] + spread))
    strength = F.round(F.abs(ratio) * F.sqrt(F.col("toxic") + F.col("other")), 9)
    best = (
        mass.where(F.col("n") >= LEAST_TEXTS)
        .select("bucket", ratio.alias("ratio"), strength.alias("strength"))
        .where("strength > 0")
        .orderBy(F.desc("strength"), "bucket")
        .limit(FEATURES)
    )
    return sorted((r[0], r[1]) for r in best.select("bucket", "ratio").collect())


def _logistic(x: Rows, value: np.ndarray, ratio: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and intercept of a ridge-regularised logistic regression on values times ratios, by Adam steps."""
    n = len(y)
    w, bias = np.zeros(x.n_columns + 1), 0.0
    mean, square = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, ROUNDS + 1):
        effect = w[:-1] * ratio
        error = sigmoid(np.bincount(x.rows, weights=value * effect[x.columns], minlength=n) + w[-1]) - y
        slope = np.bincount(x.columns, weights=value * error[x.rows], minlength=x.n_columns) / n * ratio
        slope = np.append(slope + RIDGE * w[:-1], error.mean())
        mean, square = 0.9 * mean + 0.1 * slope, 0.99 * square + 0.01 * slope * slope
        w -= 0.1 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    bias = float(w[-1])
    return w[:-1] * ratio, bias


def train(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> Model:
    """A model from `docs` (doc_id, text) and `labels` (doc_id, label 0 or 1).

    It is fitted on at most `per_class` labelled texts of each class; the intercept is set to the classes' shares among
    all labels. If a class has no text, every score is the smoothed share of toxic labels.
    """
    sample, counts = labelled_sample(docs, labels, per_class)
    toxic, other = counts.get(1, 0), counts.get(0, 0)
    prior = float(np.log((toxic + 0.5) / (other + 0.5)))
    strongest = _strongest(sample) if sample.select("label").distinct().count() == 2 else []
    if not strongest:
        return Model(np.zeros(0, np.int64), np.zeros(0), prior)
    chosen = np.array([b for b, _ in strongest], dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.zeros(1 << BITS, dtype=bool)
        wanted[chosen] = True
        for batch in batches:
            for part in slices(batch, most=AT_ONCE):
                _, bucket, value, bounds = _features(part.column(1).to_pylist(), wanted)
                columns, value = np.searchsorted(chosen, bucket).astype("<u2"), value.astype("<f2")
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([columns[s:e].tobytes() for s, e in zip(bounds, bounds[1:])], pa.binary()),
                        pa.array([value[s:e].tobytes() for s, e in zip(bounds, bounds[1:])], pa.binary()),
                    ],
                    ["label", "columns", "value"],
                )

    rows = sample.mapInArrow(tidy(run), "label int, columns binary, value binary").toArrow()
    y = rows.column("label").to_numpy().astype(np.float64)
    sizes = [len(x) // 2 for x in rows.column("columns").to_pylist()]
    columns = np.frombuffer(b"".join(rows.column("columns").to_pylist()), "<u2").astype(np.int32)
    value = np.frombuffer(b"".join(rows.column("value").to_pylist()), "<f2").astype(np.float32)
    del rows
    x = Rows(np.repeat(np.arange(len(y), dtype=np.int32), sizes), columns, len(y), len(chosen))
    weight, bias = _logistic(x, value, np.array([r for _, r in strongest]), y)
    share = np.log(y.sum() / (len(y) - y.sum()))
    return Model(chosen, weight.astype(np.float32), bias + prior - float(share))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score double) of every row of `docs` (doc_id, text; other columns are not read).

    Scores lie between 0 and 1 and depend on the whole text alone; null and empty texts get the score of a text without
    features. Rows are scored one by one: repeated rows get equal rows, an empty table gives an empty table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = model.table()
        for batch in batches:
            for part in slices(batch, most=AT_ONCE):
                found = scores(part.column(1).to_pylist(), table, model.bias)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found)], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(tidy(run), f"doc_id {kind}, score double")


def without_toxic(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """The rows of `docs`, with all their columns, whose texts score below the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = model.table()
        for batch in batches:
            for part in slices(batch, most=AT_ONCE):
                texts = part.column(part.schema.get_field_index("text")).to_pylist()
                yield part.filter(pa.array(scores(texts, table, model.bias) < threshold))

    return docs.mapInArrow(tidy(run), docs.schema)
