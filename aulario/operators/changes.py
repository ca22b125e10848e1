"""Shared pieces of the batch change operators.

A change operator takes the state and a set of requests and returns the new state,
the accepted requests and the rejected ones with the first reason that applied.
Requests carry ``id_solicitud`` (unique) and ``solicitada_en``; together they give
the order in which the requests are taken.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aulario.operators.rules import mark
from aulario.session import cut
from aulario.tables import Tables

ID = "id_solicitud"
ORDER = ["solicitada_en", ID]


@dataclass(frozen=True)
class ChangeResult:
    """The new state, the accepted requests and the rejected ones.

    ``touched`` names, for each table that changes, the keys of the rows that are new, gone or
    different, before or after: what follows a change looks at these rows only.
    """

    tables: Tables
    accepted: DataFrame
    rejected: DataFrame
    touched: dict[str, DataFrame] = field(default_factory=dict)

    def outcomes(self) -> DataFrame:
        """One row per request: whether it was accepted, and why not."""
        yes = self.accepted.select(
            ID, F.lit(True).alias("aceptada"), F.lit(None).cast("string").alias("motivo")
        )
        return yes.unionByName(self.rejected.select(ID, F.lit(False).alias("aceptada"), "motivo"))


class LateResult(ChangeResult):
    """A result whose state doesn't follow from the verdicts: they are worked out when first asked for."""

    def __init__(
        self,
        tables: Tables,
        verdicts: Callable[[], tuple[DataFrame, DataFrame]],
        touched: dict[str, DataFrame],
    ):
        self.__dict__.update(tables=tables, touched=touched, _work_out=verdicts)

    @cached_property
    def _verdicts(self) -> tuple[DataFrame, DataFrame]:
        return self._work_out()

    @property
    def accepted(self) -> DataFrame:
        return self._verdicts[0]

    @property
    def rejected(self) -> DataFrame:
        return self._verdicts[1]


def turn() -> Column:
    """The position of a request, comparable across requests."""
    return F.struct(*ORDER)


def first_reason(*checks: tuple[str, Column]) -> Column:
    """The name of the first check that fails (is not true), NULL when all pass."""
    failing = [F.when(~F.coalesce(ok, F.lit(False)), F.lit(reason)) for reason, ok in checks]
    return F.coalesce(*failing)


def split(judged: DataFrame, *columns: str) -> tuple[DataFrame, DataFrame]:
    """Accepted requests, and rejected ones with ``motivo``.

    The verdicts are materialised first: the new state, the accepted and the rejected part
    all follow from them, and must not disagree or be worked out three times.
    """
    judged = cut(judged.select(*columns, "motivo"))
    accepted = judged.filter(F.col("motivo").isNull()).select(*columns)
    rejected = judged.filter(F.col("motivo").isNotNull()).select(*columns, "motivo")
    return accepted, rejected


def mark_first(df: DataFrame, keys: list[str], name: str, eligible: Column | None = None) -> DataFrame:
    """Add ``name``: whether the row is the earliest of its key among the eligible rows.

    The winner is found by aggregation, so a key asked for very often is reduced
    before the shuffle, and marked by its unique id, so no task sees all its rows.
    The requests judged so far are materialised: they are read for both steps and again
    for the accepted and the rejected part.
    """
    df = cut(df)
    pool = df if eligible is None else df.filter(eligible)
    winners = pool.groupBy(*keys).agg(F.min(turn()).alias("t")).select(f"t.{ID}")
    return mark(df, winners, [ID], name)


def last_change(df: DataFrame, keys: list[str], *values: str) -> DataFrame:
    """Per key the values of the latest request."""
    latest = F.max(F.struct(*ORDER, *values)).alias("u")
    return df.groupBy(*keys).agg(latest).select(*keys, *[f"u.{v}" for v in values])


def update_rows(state: DataFrame, updates: DataFrame, keys: list[str]) -> DataFrame:
    """State rows with the columns of matching updates put in; other rows unchanged."""
    changed = [c for c in updates.columns if c not in keys]
    renamed = updates.select(
        *keys, *[F.col(c).alias(f"nuevo_{c}") for c in changed], F.lit(True).alias("cambia")
    )
    kept = [
        F.when(F.col("cambia"), F.col(f"nuevo_{c}")).otherwise(F.col(c)).cast(state.schema[c].dataType).alias(c)
        if c in changed
        else F.col(c)
        for c in state.columns
    ]
    return state.join(renamed, keys, "left").select(*kept)


def shaped_like(state: DataFrame, rows: DataFrame) -> DataFrame:
    """The columns of ``state`` taken from ``rows``, in its types."""
    return rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in state.schema])


def insert_rows(state: DataFrame, rows: DataFrame) -> DataFrame:
    return state.unionByName(shaped_like(state, rows))


def delete_rows(state: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return state.join(gone.select(*keys), keys, "left_anti")


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def assign_ids(rows: DataFrame, state: DataFrame, column: str, order: list[str]) -> DataFrame:
    """Number new rows from the highest id of the state on, in the given order.

    Rows are range-sorted and numbered inside their partitions; only one row count
    per partition reaches the driver. A window over all rows would sort them in one task.
    """
    start = state.agg(F.max(column)).first()[0] or 0
    place = F.col("_lugar")
    placed = cut(rows.orderBy(*order).withColumn("_lugar", F.monotonically_increasing_id()))
    sizes = (
        placed.groupBy(F.shiftright(place, 33).alias("_tramo")).count().orderBy("_tramo").collect()
    )
    offsets, total = [], start
    for size in sizes:
        offsets.append((size["_tramo"], total))
        total += size["count"]
    base = rows.sparkSession.createDataFrame(offsets, "_tramo long, _base long")
    within = place.bitwiseAND(F.lit((1 << 33) - 1))
    return (
        placed.withColumn("_tramo", F.shiftright(place, 33))
        # One row per partition of the sorted rows.
        .join(F.broadcast(base), "_tramo")
        .withColumn(column, (F.col("_base") + within + 1).cast(state.schema[column].dataType))
        .drop("_lugar", "_tramo", "_base")
    )
