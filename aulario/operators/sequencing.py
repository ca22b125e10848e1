"""Admission in request order under several capacity limits at once.

One-at-a-time processing grants a request when every limit it is subject to still
has room after the requests granted before it. The same result is reached here in
rounds over the whole set:

* a request is granted when, in each of its limits, it is among the first ``free``
  undecided requests of its key: whatever happens to the earlier ones, there is room;
* granted requests use up their keys, and requests whose key is used up are refused.
  A key can only be used up by earlier requests, because the rule above keeps room
  for every earlier undecided one.

The earliest undecided request is always granted, so the rounds end. A crowded key
decides its ``free`` first requests and refuses all others together. Ranks are cut
at a constant, which Spark applies inside each map task before the shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aulario.operators.changes import ID, ORDER, cut, union_all


@dataclass(frozen=True)
class Limit:
    """At most ``free`` grants per key, for the requests where ``applies`` is true.

    ``free`` is a column with the room left at the start, equal for all requests of a
    key and never above ``most``. ``applies`` is a boolean column, or None for all.
    """

    keys: list[str]
    free: str
    most: int
    applies: str | None = None

    def concerns(self) -> Column:
        return F.col(self.applies) if self.applies else F.lit(True)


def _with_room(df: DataFrame, limits: list[Limit]) -> DataFrame:
    for limit in limits:
        df = df.filter(~limit.concerns() | (F.col(limit.free) > 0))
    return df


def _mark_granted(undecided: DataFrame, limits: list[Limit]) -> DataFrame:
    passed = []
    for limit in limits:
        in_turn = Window.partitionBy(*limit.keys).orderBy(*ORDER)
        passed.append(
            undecided.filter(limit.concerns())
            .select(*dict.fromkeys([*ORDER, *limit.keys, limit.free]))
            .withColumn("n", F.row_number().over(in_turn))
            .filter(F.col("n") <= limit.most)
            .filter(F.col("n") <= F.col(limit.free))
            .select(ID)
        )
    passes = union_all(passed).groupBy(ID).agg(F.count("*").alias("pasa"))
    needed = sum((limit.concerns().cast("int") for limit in limits), F.lit(0))
    return (
        undecided.join(passes, ID, "left")
        .withColumn("concedida", F.coalesce("pasa", F.lit(0)) == needed)
        .drop("pasa")
    )


def _use_up(rest: DataFrame, granted: DataFrame, limits: list[Limit]) -> DataFrame:
    for limit in limits:
        # Room is equal for all requests of a key. Grouping by it too gives the join a shuffle of
        # its own on both sides, so requests that crowd on a key can be split over tasks.
        by = [*limit.keys, limit.free]
        taken = granted.filter(limit.concerns()).groupBy(*by).agg(F.count("*").alias("usado")).drop(limit.free)
        rest = (
            rest.join(taken, limit.keys, "left")
            .withColumn(limit.free, F.col(limit.free) - F.coalesce("usado", F.lit(0)))
            .drop("usado")
        )
    return _with_room(rest, limits)


def admit_in_order(requests: DataFrame, limits: list[Limit]) -> DataFrame:
    """The requests that one-at-a-time processing would grant.

    Only the order, keys and room of undecided requests pass through the rounds; each
    round is materialised once. A request without a time is taken before those with one.
    """
    columns = dict.fromkeys(ORDER)
    for limit in limits:
        columns.update(dict.fromkeys([*limit.keys, limit.free]))
        if limit.applies:
            columns[limit.applies] = None
    parts: list[DataFrame] = []
    undecided = _with_room(requests.select(*columns), limits)
    while True:
        marked = cut(_mark_granted(undecided, limits))
        left = {r["concedida"]: r["count"] for r in marked.groupBy("concedida").count().collect()}
        if left.get(True):
            parts.append(marked.filter("concedida").select(ID))
        if not left.get(True) or not left.get(False):
            break
        rest, granted = marked.filter("NOT concedida"), marked.filter("concedida")
        undecided = _use_up(rest, granted, limits).select(*columns)
    if not parts:
        return requests.limit(0)
    return requests.join(union_all(parts), ID, "left_semi")
