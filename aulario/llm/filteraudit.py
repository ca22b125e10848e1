"""How document filters interact, for every order in which they may be applied.

Each document has a mask of the filters it fails, and documents of one part of the corpus with one mask make a cell: all
orders are answered from the sums of at most 2^k cells a part, gathered in one pass over the corpus. A walk through the
subsets of the filters in Gray-code order toggles one filter at a time. It keeps a counter of active failures for each
cell and the running survivors: a cell leaves the survivors when its counter rises from 0 and comes back when it falls
to 0. The survivors of all 2^k subsets are stored; a step of an order is the difference of two of these states.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aulario.llm.work import written

FEW_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT = 200, 50, 3
#: What is summed in each cell: documents, documents labelled good, documents labelled toxic.
SUMS = ["n", "good", "toxic"]
#: Parts whose rows are laid out at once.
PARTS_AT_ONCE = 256


def gray_walk(k: int) -> Iterator[tuple[int, int]]:
    """(filter toggled, subset after it) over all subsets of k filters but the empty one, which is the start."""
    for i in range(1, 1 << k):
        toggled = (i & -i).bit_length() - 1
        yield toggled, i ^ (i >> 1)


def survivors(cells: np.ndarray) -> np.ndarray:
    """Sums that survive each subset of filters, for `cells` (parts, 2^k masks, sums); same shape, by subset."""
    masks = cells.shape[1]
    k = masks.bit_length() - 1
    failing = [np.flatnonzero(np.arange(masks) >> f & 1) for f in range(k)]
    active = np.zeros(masks, dtype=np.int64)  # active filters that a cell fails
    running = cells.sum(axis=1)
    states = np.empty_like(cells)
    states[:, 0] = running
    on = 0
    for toggled, subset in gray_walk(k):
        own = failing[toggled]
        if subset >> toggled & 1:
            running = running - cells[:, own[active[own] == 0]].sum(axis=1)
            active[own] += 1
        else:
            active[own] -= 1
            running = running + cells[:, own[active[own] == 0]].sum(axis=1)
        on ^= 1 << toggled
        states[:, on] = running
    return states


def shapley(states: np.ndarray) -> np.ndarray:
    """Documents that each filter removes, summed over all orders: (parts, k) from `states` (parts, 2^k) of documents."""
    k = states.shape[1].bit_length() - 1
    found = np.zeros((len(states), k), dtype=np.int64)
    for f in range(k):
        for subset in range(1 << k):
            if not subset >> f & 1:
                size = subset.bit_count()
                orders = factorial(size) * factorial(k - 1 - size)
                found[:, f] += orders * (states[:, subset] - states[:, subset | 1 << f])
    return found


def _with_copies(marked: DataFrame, bit: int) -> DataFrame:
    """Cells (part, mask, n, good, toxic) of rows (text_id, doc_id, part, mask, good, toxic); copies get `bit` added.

    Rows of one text have one mask. They are added up by text, part and labels before anything is compared, so a text
    that a third of all documents share is a few rows when its least doc_id is looked for.
    """
    known = F.col("doc_id").isNotNull()
    keys = ["text_id", "part", "mask", "good", "toxic"]
    by_doc = marked.groupBy(*keys, "doc_id").agg(F.count("*").alias("rows"))
    groups = by_doc.groupBy(*keys).agg(
        F.sum("rows").alias("rows"),
        F.sum(F.when(known, 0).otherwise(F.col("rows"))).alias("unknown"),
        F.min("doc_id").alias("first"),
        F.min_by("rows", "doc_id").alias("first_rows"),
    )
    groups = written(groups)
    least = groups.groupBy("text_id").agg(F.min("first").alias("least")).where("least is not null")
    judged = groups.join(written(least), "text_id", "left")
    fresh = F.col("unknown") + F.when(F.col("first") == F.col("least"), F.col("first_rows")).otherwise(0)
    judged = judged.select("part", "mask", "good", "toxic", "rows", fresh.alias("fresh"))
    cells = judged.select(
        "part",
        "good",
        "toxic",
        F.inline(
            F.array(
                F.struct(F.col("mask").alias("cell"), F.col("fresh").alias("n")),
                F.struct((F.col("mask") + bit).alias("cell"), (F.col("rows") - F.col("fresh")).alias("n")),
            )
        ),
    ).where("n > 0")
    sums = [F.sum(F.col("n") * F.col(c)).alias(c) for c in SUMS[1:]]
    return cells.groupBy("part", F.col("cell").alias("mask")).agg(F.sum("n").alias("n"), *sums)


def text_failures() -> dict[str, Column]:
    """The filters that judge a text by itself, true where it fails; null counts as empty."""
    text = F.coalesce("text", F.lit(""))
    words = F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    capitals = F.char_length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {
        "A": F.size(words) < FEW_WORDS,
        "B": 100 * F.size(F.array_distinct(words)) < DISTINCT_PERCENT * F.size(words),
        "C": 100 * capitals > CAPITAL_PERCENT * F.char_length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def audit_filters(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """One row per part, order of the filters and step, zeros included.

    `docs`: doc_id, text and the column `part` (null: empty string); other columns are ignored. Filters A to D are those
    of `text_failures`, E fails a text that a row with a smaller doc_id has too; rows of one doc_id, or without one, are
    no copies of each other. `labels`: doc_id, quality, toxic; a document counts as good or toxic if any label row of
    its doc_id says 1. Repeated rows count as often as they stand there. An empty table gives no rows.

    Columns: part, filter_order, step (int, from 1), and as long kept, removed, redundant, unique_fails, good_lost,
    toxic_lost, shapley.
    """
    fails = text_failures()
    letters = [*fails, "E"]
    mask = sum((F.when(failed, 1 << i).otherwise(0) for i, failed in enumerate(fails.values())), F.lit(0))
    text = F.coalesce("text", F.lit(""))
    judged = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(text, 256)).alias("text_id"),
        mask.alias("mask"),
    )
    # one row a labelled document, written so that the join can divide a doc_id with many rows
    flags = written(
        labels.where("doc_id is not null")
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(
            F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"),
            F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"),
        )
    )
    judged = judged.join(flags, "doc_id", "left").select(
        "doc_id",
        "part",
        "text_id",
        "mask",
        F.coalesce("good", F.lit(0)).alias("good"),
        F.coalesce("toxic", F.lit(0)).alias("toxic"),
    )
    masks = range(1 << len(letters))
    cell = F.col("mask")
    wide = _with_copies(judged, 1 << len(fails)).groupBy("part").agg(
        *[F.array(*[F.sum(F.when(cell == m, F.col(c)).otherwise(0)) for m in masks]).alias(c) for c in SUMS]
    )
    return wide.mapInArrow(
        _laid_out(letters),
        "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, "
        "good_lost long, toxic_lost long, shapley long",
    )


def _laid_out(letters: list[str]):
    k = len(letters)
    orders = list(permutations(range(k)))
    names = ["".join(letters[f] for f in order) for order in orders]
    filters = np.array(orders).reshape(-1)
    after = np.cumsum(1 << np.array(orders), axis=1).reshape(-1)
    before = after - (1 << filters)
    everything = (1 << k) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, PARTS_AT_ONCE):
                rows = batch.slice(low, PARTS_AT_ONCE)
                cells = [rows.column(1 + i).flatten().to_numpy().reshape(-1, 1 << k) for i in range(len(SUMS))]
                states = survivors(np.stack(cells, axis=2))
                kept, documents = states[:, after, 0], states[:, :, 0]
                lost = states[:, before] - states[:, after]
                # a filter alone: what it removes first, and what only it removes
                alone = documents[:, :1] - documents[:, 1 << np.arange(k)]
                only = documents[:, everything ^ (1 << np.arange(k))] - documents[:, [everything]]
                columns = [
                    kept,
                    lost[:, :, 0],
                    alone[:, filters] - lost[:, :, 0],
                    only[:, filters],
                    lost[:, :, 1],
                    lost[:, :, 2],
                    shapley(documents)[:, filters],
                ]
                n, steps = rows.num_rows, k * len(orders)
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.column(0).take(pa.array(np.repeat(np.arange(n), steps))),
                        pa.array([name for name in names for _ in range(k)] * n),
                        pa.array(np.tile(np.arange(1, k + 1), n * len(orders)), pa.int32()),
                        *[pa.array(c.reshape(-1), pa.int64()) for c in columns],
                    ],
                    ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails"]
                    + ["good_lost", "toxic_lost", "shapley"],
                )

    return run
