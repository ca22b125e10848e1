"""Exact top-k search by inner product, with distributed histogram selection.

Every query is scored against every candidate in blocks of a matrix product. Scores are not kept: the interval in which
a query's k-th best score lies is refined round by round. Tasks count the scores of their candidates in the bins of the
current interval, counts are added up over all tasks, and the bin that holds the k-th becomes the next interval, until
it is one score wide. Then all scores above it are taken, and of the candidates with just this score those with the
smallest ids.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aulario.llm.work import written

#: Queries that are sent to the tasks at once, candidates that a task scores at once, bins of a round.
QUERY_BLOCK = 1024
CANDIDATE_BLOCK = 2048
BINS = 256

_LOW, _HIGH = -(1 << 63), (1 << 63) - 1


def integer_vectors(rows: DataFrame, scale: int = 1024) -> DataFrame:
    """(vec_id, vector array<double>): every component x of `embedding` as floor(scale * x), x as double.

    Vectors that are null, empty, or hold null or non-finite components are left out, as are rows without vec_id.
    """
    x = F.col("embedding").cast("array<double>")
    sound = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    # floor of a double stays a double here: beyond 2**53 doubles are whole already
    whole = F.transform(
        x,
        lambda v: F.when(F.abs(v * scale) < float(1 << 53), F.floor(v * scale).cast("double")).otherwise(v * scale),
    )
    return rows.where(F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & sound).select(
        F.col("vec_id").cast("long").alias("vec_id"), whole.alias("vector")
    )


def _matrices(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, matrix) of the vectors of a batch, by length and in blocks."""
    ids, column = batch.column(0).to_numpy(), batch.column(1)
    sizes = np.asarray(column.value_lengths())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    starts = np.cumsum(sizes) - sizes
    for size in np.unique(sizes).tolist():
        own = np.flatnonzero(sizes == size)
        for at in range(0, len(own), CANDIDATE_BLOCK):
            part = own[at : at + CANDIDATE_BLOCK]
            yield ids[part], flat[starts[part][:, None] + np.arange(size)]


def inner_products(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Exact integer inner products of vectors of whole numbers; beyond 64 bits they stop at the end of the range."""
    size = queries.shape[1]
    bound = np.abs(queries).max(initial=0.0) * np.abs(candidates).max(initial=0.0) * size
    if bound < 2.0**53:  # every partial sum is exact
        return (queries @ candidates.T).astype(np.int64)
    exact = np.frompyfunc(int, 1, 1)
    whole = exact(queries).dot(exact(candidates).T)
    return np.clip(whole, _LOW, _HIGH).astype(np.int64)


class _Block:
    """Some queries: ids, vectors, and the interval of scores that still holds each one's k-th best."""

    def __init__(self, ids: np.ndarray, vectors: list[np.ndarray]):
        self.ids = ids
        self.sizes = {}
        for size in {len(v) for v in vectors}:
            own = np.array([i for i, v in enumerate(vectors) if len(v) == size])
            self.sizes[size] = own, np.stack([vectors[i] for i in own])

    def scored(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(queries, candidate ids, scores, own): `own` marks a query's pair with itself."""
        for batch in batches:
            for ids, matrix in _matrices(batch):
                if matrix.shape[1] in self.sizes:
                    own, vectors = self.sizes[matrix.shape[1]]
                    scores = inner_products(vectors, matrix)
                    yield own, ids, scores, self.ids[own][:, None] == ids[None, :]


def _bounds(vectors: DataFrame, block: _Block) -> dict[int, tuple[int, int, int]]:
    """Least score, greatest score and number of candidates of each query of a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(block.ids)
        low, high, count = np.full(n, _HIGH), np.full(n, _LOW), np.zeros(n, np.int64)
        for own, _, scores, self_pair in block.scored(batches):
            low[own] = np.minimum(low[own], np.where(self_pair, _HIGH, scores).min(axis=1))
            high[own] = np.maximum(high[own], np.where(self_pair, _LOW, scores).max(axis=1))
            count[own] += (~self_pair).sum(axis=1)
        some = np.flatnonzero(count)
        columns = (some, low[some], high[some], count[some])
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["q", "low", "high", "n"])

    found = vectors.mapInArrow(run, "q long, low long, high long, n long")
    rows = found.groupBy("q").agg(F.min("low"), F.max("high"), F.sum("n")).collect()
    return {r[0]: (r[1], r[2], r[3]) for r in rows}


def _histogram(
    vectors: DataFrame, block: _Block, low: np.ndarray, high: np.ndarray, width: np.ndarray, open_: np.ndarray
) -> DataFrame:
    """(q, bin, n): scores of each open query in [low + bin * width, low + (bin + 1) * width), up to `high`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(block.ids), BINS), dtype=np.int64)
        for own, _, scores, self_pair in block.scored(batches):
            at = np.flatnonzero(open_[own])
            queries = own[at]
            over = scores[at].astype(np.uint64) - low[queries].astype(np.uint64)[:, None]  # modulo 2**64: from low on
            bins = over // width[queries][:, None]
            inside = (scores[at] >= low[queries][:, None]) & (scores[at] <= high[queries][:, None]) & ~self_pair[at]
            row, _ = np.nonzero(inside)
            np.add.at(counts, (queries[row], bins[inside].astype(np.int64)), 1)
        q, b = np.nonzero(counts)
        columns = (q, b, counts[q, b])
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["q", "bin", "n"])

    return vectors.mapInArrow(run, "q long, bin long, n long").groupBy("q", "bin").agg(F.sum("n").alias("n"))


def _kth_scores(vectors: DataFrame, block: _Block, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k-th best score of each query of a block (the least, where there are fewer), and how many to take of it."""
    n = len(block.ids)
    low, high, take = np.full(n, _HIGH), np.full(n, _HIGH), np.zeros(n, np.int64)
    for q, (least, most, count) in _bounds(vectors, block).items():
        low[q], high[q], take[q] = least, most, min(k, count)
    open_ = (take > 0) & (low < high)
    while open_.any():
        span = high.astype(object) - low.astype(object) + 1
        width = np.array([-(-int(s) // BINS) for s in span], dtype=np.uint64)
        counts = _histogram(vectors, block, low, high, width, open_)
        # the bin whose scores and those above first reach what is to be taken
        wanted = vectors.sparkSession.createDataFrame(
            [(int(q), int(take[q])) for q in np.flatnonzero(open_)], "q long, take long"
        )
        above = F.sum("n").over(Window.partitionBy("q").orderBy(F.desc("bin")))
        reached = counts.join(wanted, "q").withColumn("reached", above).where("reached >= take")
        for q, b, left in reached.groupBy("q").agg(
            F.max("bin"), F.max_by(F.col("take") - (F.col("reached") - F.col("n")), "bin")
        ).collect():
            low[q], high[q], take[q] = (
                int(low[q]) + b * int(width[q]),
                min(int(high[q]), int(low[q]) + (b + 1) * int(width[q]) - 1),
                left,
            )
        open_ &= low < high
    return low, take


def _selected(vectors: DataFrame, block: _Block, low: np.ndarray, take: np.ndarray) -> DataFrame:
    """(query_id, vec_id, score, tied): all pairs above the k-th score, and each task's smallest ids among ties."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ties: dict[int, np.ndarray] = {}
        for own, ids, scores, self_pair in block.scored(batches):
            some = (take[own] > 0)[:, None] & ~self_pair
            row, at = np.nonzero(some & (scores > low[own][:, None]))
            yield from found(block.ids[own[row]], ids[at], scores[row, at], False)
            row, at = np.nonzero(some & (scores == low[own][:, None]))
            for r in np.unique(row).tolist():
                q = int(own[r])
                # equal ids are repeated rows, each a candidate
                ties[q] = np.sort(np.append(ties.get(q, ids[:0]), ids[at[row == r]]), kind="stable")[: take[q]]
        for q, ids in ties.items():
            yield from found(np.full(len(ids), block.ids[q]), ids, np.full(len(ids), low[q]), True)

    def found(q: np.ndarray, v: np.ndarray, s: np.ndarray, tied: bool) -> Iterator[pa.RecordBatch]:
        if len(q):
            yield pa.RecordBatch.from_arrays(
                [pa.array(q), pa.array(v), pa.array(s), pa.array(np.full(len(q), tied))],
                ["query_id", "vec_id", "score", "tied"],
            )

    return vectors.mapInArrow(run, "query_id long, vec_id long, score long, tied boolean")


def top_k(queries: DataFrame, vectors: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best-scored rows of `vectors` for each row of `queries`.

    Both have (vec_id long, vector array<double> of whole numbers); a query's own vec_id is no candidate. Ties go to the
    smaller vec_id. A query with fewer than k candidates gets all. Vectors of unlike length are not scored against
    each other. Repeated candidates are each ranked; of repeated queries one is asked. Empty tables give an empty table.

    The queries, a stated set, are taken in blocks of QUERY_BLOCK, one block in memory at a time.
    """
    spark = vectors.sparkSession
    ready = written(vectors)
    asked = queries.dropDuplicates(["vec_id"])
    count = asked.count()
    blocks = -(-count // QUERY_BLOCK)
    parts = []
    for number in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == number).collect()
        if not rows:
            continue
        block = _Block(np.array([r[0] for r in rows], np.int64), [np.array(r[1], np.float64) for r in rows])
        low, take = _kth_scores(ready, block, k)
        parts.append(written(_selected(ready, block, low, take)))
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    found = parts[0]
    for part in parts[1:]:
        found = found.union(part)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
