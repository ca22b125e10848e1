"""Quality scores of whole texts by positive-unlabelled learning.

Trusted positives and unlabelled web text are at hand; what is bad is learned from the difference between the two. With
class prior p (the share of good texts in web text) the risk of a classifier on the negatives is its risk on the
unlabelled texts minus p times its negative risk on the positives. The risk

    p * E_positive[loss(g, good)] + max(0, E_unlabelled[loss(g, bad)] - p * E_positive[loss(g, bad)])

is minimised with logistic loss by Newton steps. The positives are a bounded sample of labelled texts; the expectations
over unlabelled text, with their slopes and curvatures, are summed over all documents of the corpus in each step. A
step that does not lower the risk, or that brings the estimated negative risk below zero, where the classifier would
fit the positives by heart, is halved.

The prior is estimated from positives and unlabelled texts alone: of a first classifier's scores, the least ratio of the
shares of unlabelled and of positive texts above a bound. Above a bound that most positives pass there are few bad
texts, and then the ratio is the prior.

Features are dense: shares of pairs of neighbouring characters by kind, and shares of words that repeat one of the words
just before.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aulario.llm.ngrams import sigmoid
from aulario.llm.texts import NOT_SPACE, slices, text_bytes, tidy, word_hashes, words
from aulario.llm.work import written

#: Labelled positives that the classifier is fitted on, at most: those whose ids have the least hashes.
SAMPLE_POSITIVE = 6000
#: Words back to which a word is compared.
REACH = 4
RIDGE = 1e-3
#: Newton steps of a fit, at most; a step that lowers the risk by less than STILL ends it.
STEPS, STILL = 14, 1e-6
#: The prior of the first classifier, and bins of its scores when the prior is estimated.
FIRST_PRIOR, BINS = 0.5, 400
#: Share of the positives that a bound must leave above it to tell the prior.
TOLD_BY = 0.5
#: Tasks in which the sums of all tasks are added up before the driver gets them.
GATHERED = 8

#: Kinds of bytes: lower case, capital, digit, space, line feed, stop, comma, further marks by group, other.
_GROUPS = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\n\r", ".", ",", "!", "?"]
_GROUPS += [";:", "'\"`", "()[]{}<>", "|", "-_/\\", "@#$%&*+=~^"]
KINDS = len(_GROUPS) + 1
KIND_OF = np.full(256, KINDS - 1, dtype=np.int64)
for _number, _group in enumerate(_GROUPS):
    KIND_OF[list(_group.encode())] = _number
KIND_OF[0x80:] = 0  # characters beyond ASCII count as letters

WIDTH = KINDS * KINDS + REACH + 1


def features(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A row of WIDTH features for each text, from its whole text."""
    n = len(at) - 1
    found = np.zeros((n, WIDTH))
    size = np.diff(at)
    if len(data) > 1:
        kind = KIND_OF[data]
        text = np.repeat(np.arange(n), size)
        inside = text[1:] == text[:-1]
        pair = (text[:-1] * KINDS + kind[:-1]) * KINDS + kind[1:]
        counts = np.bincount(pair[inside], minlength=n * KINDS * KINDS).reshape(n, -1)
        found[:, : KINDS * KINDS] = np.sqrt(counts / np.maximum(size - 1, 1)[:, None])
    starts, ends, bounds = words(data, at, NOT_SPACE)
    hashes, number = word_hashes(data, starts, ends), np.diff(bounds)
    owner = np.repeat(np.arange(n), number)
    for back in range(1, REACH + 1):
        again = owner[back:][(hashes[back:] == hashes[:-back]) & (owner[back:] == owner[:-back])]
        share = np.bincount(again, minlength=n) / np.maximum(number, 1)
        found[:, KINDS * KINDS + back - 1] = np.sqrt(share)
    found[:, -1] = np.log1p(number)
    return found


@dataclass(frozen=True)
class Model:
    weight: np.ndarray
    bias: float

    def scores(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        return sigmoid(features(data, at) @ self.weight + self.bias)


@dataclass(frozen=True)
class Sums:
    """Of unlabelled texts x with a last component of 1 and g = x @ v: n, the sum of log(1 + e^g), and of it the slope
    and the curvature in v."""

    n: float
    loss: float
    slope: np.ndarray
    curve: np.ndarray

    def packed(self) -> np.ndarray:
        return np.concatenate([[self.n, self.loss], self.slope, self.curve.reshape(-1)])

    @staticmethod
    def unpacked(values: np.ndarray) -> Sums:
        width = WIDTH + 1
        return Sums(values[0], values[1], values[2 : 2 + width], values[2 + width :].reshape(width, width))


def with_one(rows: np.ndarray) -> np.ndarray:
    return np.concatenate([rows, np.ones((len(rows), 1), dtype=rows.dtype)], axis=1)


def sums(rows: np.ndarray, v: np.ndarray) -> Sums:
    x = with_one(rows).astype(np.float64)
    g = x @ v
    r = sigmoid(g)
    return Sums(len(x), float(np.logaddexp(0, g).sum()), x.T @ r, (x * (r * (1 - r))[:, None]).T @ x)


def fit(positive: np.ndarray, unlabelled: Callable[[np.ndarray], Sums], prior: float) -> np.ndarray:
    """Weights, the intercept last, that minimise the non-negative risk; `unlabelled` gives the sums at any weights."""
    x = with_one(positive.astype(np.float64))
    centre = x.mean(axis=0)
    v = np.zeros(WIDTH + 1)
    ridge = None
    best, step = None, None
    for _ in range(STEPS):
        at = unlabelled(v)
        if ridge is None:  # weights cost what they move a text of usual spread
            square = np.diag(at.curve) * 4 / at.n
            ridge = RIDGE * (np.sqrt(np.maximum(square - (at.slope * 2 / at.n) ** 2, 0)) + 1e-3) ** 2
            ridge[-1] = 0
        g = x @ v
        bad = at.loss / at.n - prior * np.logaddexp(0, g).mean()
        risk = prior * np.logaddexp(0, -g).mean() + max(0.0, bad) + (ridge * v * v).sum() / 2
        if best is not None and (bad < 0 or not risk < best[0]):
            step = step / 2
            v = best[1] + step
            continue
        done = best is not None and best[0] - risk < STILL
        best = risk, v
        if done:
            break
        slope = at.slope / at.n - prior * centre + ridge * v
        step = -np.linalg.solve(at.curve / at.n + np.diag(ridge + 1e-9), slope)
        v = v + step
    return best[1]


def estimated_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The share of positives in unlabelled text, from counts of scores in the same ascending bins."""
    above = [np.cumsum(counts[::-1])[::-1] / max(1, counts.sum()) for counts in (positive, unlabelled)]
    told = above[0] >= TOLD_BY
    return float(np.clip((above[1][told] / above[0][told]).min(), 0.01, 0.99))


def _positives(docs: DataFrame, ids: DataFrame, most: int) -> np.ndarray:
    """Features of at most so many documents: those of `ids` whose ids have the least hashes.

    A document counts once; of several rows with its id the least text stands for it.
    """
    taken = ids.distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    taken = taken.select(F.col("doc_id").alias("taken_id"))
    both = docs.select("doc_id", "text").join(F.broadcast(taken), F.col("doc_id") == F.col("taken_id"))
    one = both.groupBy("doc_id").agg(F.min("text").alias("text"))
    rows = written(_blocks(one).select("doc_rows")).toArrow()
    found = np.frombuffer(b"".join(rows.column(0).to_pylist()), "<f4").reshape(-1, WIDTH).astype(np.float64)
    return found[np.lexsort(found.T[::-1])]


def _blocks(docs: DataFrame) -> DataFrame:
    """The features of all rows, many in a block of 32-bit values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                rows = features(*text_bytes(part.column(0))).astype("<f4")
                yield pa.RecordBatch.from_arrays([pa.array([rows.tobytes()], pa.binary())], ["doc_rows"])

    return docs.select("text").mapInArrow(tidy(run), "doc_rows binary")


def _added_up(blocks: DataFrame, made: Callable[[np.ndarray], np.ndarray]) -> np.ndarray | None:
    """The sum over all blocks of what is made of each, in two steps; None without blocks."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for cell in batch.column(0):
                own = made(np.frombuffer(cell.as_buffer(), "<f4").reshape(-1, WIDTH))
                total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["total"])

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = (cell.as_buffer() for batch in batches for cell in batch.column(0))
        total = sum(np.frombuffer(cell, "<f8") for cell in cells)
        if not isinstance(total, int):
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["total"])

    partial = blocks.mapInArrow(tidy(first), "total binary")
    rows = partial.repartition(GATHERED).mapInArrow(again, "total binary").collect()
    return sum(np.frombuffer(r[0], "<f8") for r in rows) if rows else None


def train(docs: DataFrame, labels: DataFrame, most_positive: int = SAMPLE_POSITIVE) -> Model:
    """A model from `docs` (doc_id, text) and `labels` (doc_id, label 1: trusted positive; others are not used).

    A document is positive if any of its label rows says so. At most `most_positive` positives are taken; all rows of
    `docs` are the unlabelled text. Without positives or texts every score is 0.5.
    """
    sound = labels.where("doc_id is not null and label = 1")
    positive = _positives(docs, sound.select("doc_id"), most_positive)
    blocks = written(_blocks(docs))
    if not len(positive) or blocks.isEmpty():
        return Model(np.zeros(WIDTH), 0.0)

    def unlabelled(v: np.ndarray) -> Sums:
        return Sums.unpacked(_added_up(blocks, lambda rows: sums(rows, v).packed()))

    first = fit(positive, unlabelled, FIRST_PRIOR)
    bounds = np.quantile(with_one(positive) @ first, np.linspace(0, 1, BINS + 1)[1:-1])

    def binned(rows: np.ndarray) -> np.ndarray:
        at = np.searchsorted(bounds, with_one(rows) @ first, side="right")
        return np.bincount(at, minlength=BINS).astype(np.float64)

    prior = estimated_prior(binned(positive), _added_up(blocks, binned))
    v = fit(positive, unlabelled, prior)
    return Model(v[:-1], float(v[-1]))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score double) of every row of `docs` (doc_id, text; other columns are not read).

    Scores lie between 0 and 1 and depend on the whole text alone; null counts as empty. Rows are scored one by one:
    repeated rows get equal rows, an empty table gives an empty table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                found = model.scores(*text_bytes(part.column(1)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found)], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(tidy(run), f"doc_id {kind}, score double")
