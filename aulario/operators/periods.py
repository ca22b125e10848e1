"""Periods of participants granted in request order, so that none touches a day of another sanction.

One-at-a-time processing grants a period when it touches no day granted before it to another sanction of the
participant. The same result is reached in rounds over all participants at once:

* of each participant the first undecided periods, a constant number cut inside map tasks, are decided in their order
  by one aggregate expression over a sorted array;
* what they were granted then decides others without order, as these come later. The granted days are laid out along
  the calendar and merged into stretches; a sweep carries the last stretch started, and the last one of another
  sanction before it, to the days that undecided periods begin and end on. A period that touches a stretch of another
  sanction is refused, one inside a stretch of its own is granted.

A participant with no more periods than are decided at once is finished in the first round. The rest pass on only
periods that touch no stretch of another sanction, so what was granted before never has to be looked at again. Each
round grants the first period left and decides all that touch it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aulario.operators.changes import ORDER, cut, turn, union_all
from aulario.operators.rules import CI

PERIOD = ["fecha_inicio", "fecha_fin"]
#: Periods of a participant that are decided in one expression; granted ones are searched for each.
DECIDED_AT_ONCE = 2_000


def _in_order(periods: Column, own: str) -> Column:
    """The periods of a sorted array that touch none taken before them, but for those of their own sanction."""

    def clash(period: Column):
        return lambda taken: (
            (taken[own] != period[own])
            & (taken["fecha_inicio"] <= period["fecha_fin"])
            & (taken["fecha_fin"] >= period["fecha_inicio"])
        )

    none = F.slice(periods, 1, 0)
    return F.aggregate(
        periods,
        none,
        lambda taken, period: F.when(F.exists(taken, clash(period)), taken).otherwise(F.array_append(taken, period)),
    )


def _stretches(granted: DataFrame, own: str) -> DataFrame:
    """Granted periods merged where they overlap; those of different sanctions are disjoint."""
    along = Window.partitionBy(CI).orderBy("fecha_inicio", "fecha_fin")
    reached = F.max("fecha_fin").over(along.rowsBetween(Window.unboundedPreceding, -1))
    number = F.sum(F.col("abre").cast("int")).over(along.rowsBetween(Window.unboundedPreceding, 0))
    return (
        granted.withColumn("abre", F.coalesce(F.col("fecha_inicio") > reached, F.lit(True)))
        .withColumn("tramo", number)
        .groupBy(CI, "tramo")
        .agg(
            F.min("fecha_inicio").alias("fecha_inicio"),
            F.max("fecha_fin").alias("fecha_fin"),
            F.first(own).alias(own),
        )
    )


def _at_days(stretches: DataFrame, periods: DataFrame, own: str) -> DataFrame:
    """For each day that a period begins or ends on: the last stretch started, and the end of the last of others.

    A participant has at most one stretch and one question per calendar day.
    """
    days = periods.select(CI, F.explode(F.array(*PERIOD)).alias("dia")).distinct()
    started = stretches.select(
        CI,
        F.col("fecha_inicio").alias("dia"),
        F.struct(F.col("fecha_inicio"), F.col("fecha_fin"), F.col(own)).alias("tramo"),
        F.lit(False).alias("pregunta"),
    )
    along = Window.partitionBy(CI).orderBy("dia", "pregunta")
    so_far = along.rowsBetween(Window.unboundedPreceding, 0)
    earlier = along.rowsBetween(Window.unboundedPreceding, -1)
    last = F.last("tramo", ignorenulls=True)
    line = (
        started.unionByName(days.withColumn("pregunta", F.lit(True)), allowMissingColumns=True)
        .withColumn("anterior", last.over(earlier))
        # where the sanction changes, all stretches before belong to others or end before the one left behind
        .withColumn(
            "cambio",
            F.when(
                F.col("tramo").isNotNull() & (F.col(f"tramo.{own}") != F.col(f"anterior.{own}")),
                F.col("anterior.fecha_fin"),
            ),
        )
    )
    return line.select(
        CI,
        "dia",
        "pregunta",
        last.over(so_far).alias("tramo"),
        F.last("cambio", ignorenulls=True).over(so_far).alias("otro_fin"),
    ).filter("pregunta").drop("pregunta")


def _judge(rest: DataFrame, granted: DataFrame, own: str) -> DataFrame:
    """Add ``tocada`` (a day is granted to another sanction) and ``cubierta`` (all days are granted to its own)."""
    answers = cut(_at_days(_stretches(granted, own), rest, own))
    at_end = answers.select(
        CI, F.col("dia").alias("fecha_fin"), F.col("tramo").alias("al_fin"), F.col("otro_fin")
    )
    at_start = answers.select(CI, F.col("dia").alias("fecha_inicio"), F.col("tramo").alias("al_inicio"))
    same = F.col(f"al_fin.{own}") == F.col(own)
    reaches = F.when(same, F.col("otro_fin")).otherwise(F.col("al_fin.fecha_fin")) >= F.col("fecha_inicio")
    inside = (F.col(f"al_inicio.{own}") == F.col(own)) & (F.col("al_inicio.fecha_fin") >= F.col("fecha_fin"))
    return (
        rest.join(at_end, [CI, "fecha_fin"])
        .join(at_start, [CI, "fecha_inicio"])
        .withColumn("tocada", F.coalesce(reaches, F.lit(False)))
        .withColumn("cubierta", F.coalesce(inside, F.lit(False)))
        .drop("al_fin", "al_inicio", "otro_fin")
    )


def granted_in_order(asked: DataFrame, own: str, at_once: int | None = None) -> DataFrame:
    """The rows (participant, ``own``, period, order) of ``asked`` that one-at-a-time processing grants.

    ``own`` names the column with the sanction a period is for. Periods have an end not before their start, and the
    order tells all rows of a participant apart.
    """
    most = at_once or DECIDED_AT_ONCE
    columns = [CI, *dict.fromkeys([own, *PERIOD, *ORDER])]
    undecided = asked.select(*columns)
    item = F.struct(*[c for c in columns if c != CI])
    in_turn = Window.partitionBy(CI).orderBy(*ORDER)
    parts: list[DataFrame] = []
    while True:
        first = undecided.withColumn("n", F.row_number().over(in_turn)).filter(F.col("n") <= most).drop("n")
        ordered = F.transform(F.sort_array(F.collect_list(F.struct(turn().alias("t"), item.alias("p")))), lambda x: x["p"])
        decided = cut(
            first.groupBy(CI)
            .agg(ordered.alias("p"), F.max(turn()).alias("hasta"))
            .select(CI, _in_order(F.col("p"), own).alias("p"), "hasta", F.size("p").alias("n"))
        )
        granted = decided.select(CI, F.inline("p")).select(*columns)
        parts.append(granted)
        full = decided.filter(F.col("n") == most).select(CI, "hasta")
        if full.isEmpty():
            return union_all(parts)
        rest = undecided.join(full, CI).filter(turn() > F.col("hasta")).select(*columns)
        crowded = granted.join(full.select(CI), CI, "left_semi")
        judged = cut(_judge(rest, crowded, own).filter("NOT tocada"))
        parts.append(judged.filter("cubierta").select(*columns))
        undecided = judged.filter("NOT cubierta").select(*columns)
