"""Batch changes of sanctions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aulario.functions.scalar import Date, day
from aulario.operators import rules
from aulario.operators.changes import (
    ID,
    ORDER,
    ChangeResult,
    assign_ids,
    cut,
    delete_rows,
    first_reason,
    insert_rows,
    mark_first,
    split,
    turn,
    update_rows,
)
from aulario.operators.periods import PERIOD, granted_in_order
from aulario.operators.rules import CI, mark
from aulario.tables import Tables


def candidates(requests: DataFrame) -> DataFrame:
    """The requests that could be kept when periods of a participant must not touch.

    A request can only be kept if no earlier one lies inside its period: that one was kept,
    or something touching it was. Of equal periods only the first is left, and of those
    starting on one day only ever shorter ones, so the calendar bounds what remains of a
    participant, not the number of requests.
    """
    first = F.min(turn()).alias("t")
    distinct = (
        requests.groupBy(CI, *PERIOD)
        .agg(first)
        .select(CI, *PERIOD, *[f"t.{c}" for c in ORDER])
    )
    same_start = (
        Window.partitionBy(CI, "fecha_inicio")
        .orderBy(*ORDER)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        distinct.withColumn("corta", F.min("fecha_fin").over(same_start))
        .filter(F.col("corta").isNull() | (F.col("fecha_fin") < F.col("corta")))
        .select(CI, *PERIOD, *ORDER)
    )


def create_sanctions(requests: DataFrame, t: Tables) -> ChangeResult:
    """Create sanctions in request order.

    Checks per request: the participant exists, the period touches no sanction of the
    participant (present before, or created by an earlier request), the end is after
    the start.
    """
    columns = requests.columns
    judged = rules.exists_in(requests, t.participante, {CI: "ci"}, "existe")
    judged = rules.overlaps_sanction(judged, t.sancion_participante)
    judged = cut(rules.dates_in_order(judged))
    ready = judged.filter("existe AND NOT solapada AND fechas_en_orden")
    # Every new sanction is one of its own, so no two of a participant may touch.
    granted = granted_in_order(candidates(ready), ID)
    # A period between kept ones touches at most its neighbours, and kept periods touch
    # none of each other: the earliest granted turn among those touched decides.
    late = _touches_earlier(judged.filter("existe AND NOT solapada AND NOT fechas_en_orden"), granted)
    verdicts = granted.select(ID, F.lit(True).alias("concedida")).unionByName(
        late.distinct().withColumn("concedida", F.lit(False))
    )
    judged = judged.join(cut(verdicts), ID, "left").withColumn(
        "motivo",
        first_reason(
            ("participante_inexistente", F.col("existe")),
            ("periodo_solapado", ~F.col("solapada") & F.coalesce("concedida", F.lit(True))),
            ("fechas_invalidas", F.col("fechas_en_orden")),
            ("periodo_solapado", F.col("concedida")),
        ),
    )
    accepted, rejected = split(judged, *columns)
    created = assign_ids(accepted, t.sancion_participante, "id_sancion", ORDER)
    tables = t.with_tables(sancion_participante=insert_rows(t.sancion_participante, created))
    touched = {"sancion_participante": created.select("id_sancion")}
    return ChangeResult(tables, created, rejected, touched)


def _touches_earlier(backward: DataFrame, granted: DataFrame) -> DataFrame:
    """Requests with end before start that have a date inside an earlier granted period.

    Granted periods of a participant are disjoint, so the last one started up to a day is
    the only one that can contain it; it is carried along the days of the participant.
    """
    dates = backward.select(ID, *ORDER[:1], CI, F.explode(F.array(*PERIOD)).alias("dia"))
    opened = granted.select(
        CI,
        F.col("fecha_inicio").alias("dia"),
        F.struct(F.col("fecha_inicio"), F.col("fecha_fin"), turn().alias("turno")).alias("s"),
        F.lit(0).alias("pregunta"),
    )
    timeline = opened.unionByName(
        dates.select(CI, "dia").distinct().withColumn("pregunta", F.lit(1)), allowMissingColumns=True
    )
    so_far = (
        Window.partitionBy(CI).orderBy("dia", "pregunta").rowsBetween(Window.unboundedPreceding, 0)
    )
    answers = timeline.withColumn("abierta", F.max("s").over(so_far)).filter("pregunta = 1")
    return (
        dates.join(answers.select(CI, "dia", "abierta"), [CI, "dia"])
        .filter((F.col("abierta.fecha_fin") >= F.col("dia")) & (F.col("abierta.turno") < turn()))
        .select(ID)
    )


def default_sanctions(requests: DataFrame, as_of: Date, days: int = 7) -> DataFrame:
    """Periods of ``days`` from the reference date on, as requests for new sanctions."""
    return requests.withColumn("fecha_inicio", day(as_of)).withColumn(
        "fecha_fin", F.date_add(day(as_of), days)
    )


def update_sanctions(changes: DataFrame, t: Tables) -> ChangeResult:
    """Change sanction dates.

    Changes are judged against the sanctions before the batch, and in request order against
    each other: a period must not touch one granted earlier in the batch to another sanction
    of the participant. Of several granted changes of one sanction the last counts; a refused
    one replaces nothing.
    """
    columns = changes.columns
    current = t.sancion_participante.join(
        changes.select("id_sancion"), "id_sancion", "left_semi"
    ).select("id_sancion", CI)
    judged = changes.join(current, "id_sancion", "left").withColumn("existe", F.col(CI).isNotNull())
    judged = rules.overlaps_sanction(judged, t.sancion_participante, ID, own="id_sancion")
    judged = rules.dates_in_order(judged)
    judged = cut(judged)
    fit = F.col("existe") & ~F.col("solapada") & F.col("fechas_en_orden")
    # Equal changes of a sanction share their verdict, so one of each is decided.
    change = [CI, "id_sancion", *PERIOD]
    asked = judged.filter(fit).groupBy(*change).agg(F.min(turn()).alias("t")).select(*change, *[f"t.{c}" for c in ORDER])
    judged = cut(mark(judged, granted_in_order(asked, "id_sancion"), change, "concedida"))
    latest = (
        judged.filter(fit & F.col("concedida"))
        .groupBy("id_sancion")
        .agg(F.max(turn()).alias("t"))
        .select(f"t.{ID}")
    )
    judged = mark(judged, latest, [ID], "vigente").withColumn(
        "motivo",
        first_reason(
            ("sancion_inexistente", F.col("existe")),
            ("periodo_solapado", ~F.col("solapada")),
            ("fechas_invalidas", F.col("fechas_en_orden")),
            ("periodo_solapado", F.col("concedida")),
            ("reemplazada", F.col("vigente")),
        ),
    )
    accepted, rejected = split(judged, *columns)
    updated = update_rows(
        t.sancion_participante, accepted.select("id_sancion", *PERIOD), ["id_sancion"]
    )
    touched = {"sancion_participante": accepted.select("id_sancion")}
    return ChangeResult(t.with_tables(sancion_participante=updated), accepted, rejected, touched)


def shift_sanctions(changes: DataFrame, t: Tables) -> ChangeResult:
    """Extend (positive ``dias``) or shorten (negative) sanctions.

    A shortened sanction must still end after its start; the result is then a change of
    dates like any other.
    """
    current = t.sancion_participante.join(
        changes.select("id_sancion"), "id_sancion", "left_semi"
    ).select("id_sancion", *PERIOD)
    dated = changes.join(current, "id_sancion", "left").withColumn(
        "fecha_fin", F.date_add("fecha_fin", F.col("dias"))
    )
    return update_sanctions(dated.select(*changes.columns, *PERIOD), t)


def finish_sanctions(asked: DataFrame, t: Tables, as_of: Date) -> ChangeResult:
    """End sanctions on the reference date when they would end later.

    One that has not started before that date cannot end on it.
    """
    columns = asked.columns
    current = t.sancion_participante.join(
        asked.select("id_sancion"), "id_sancion", "left_semi"
    ).select("id_sancion", *PERIOD)
    judged = asked.join(current, "id_sancion", "left").withColumn(
        "motivo",
        first_reason(
            ("sancion_inexistente", F.col("fecha_fin").isNotNull()),
            ("ya_finalizada", F.col("fecha_fin") > day(as_of)),
            ("sin_comenzar", F.col("fecha_inicio") < day(as_of)),
        ),
    )
    judged = mark_first(judged, ["id_sancion"], "primera", F.col("motivo").isNull()).withColumn(
        "motivo", F.coalesce("motivo", F.when(~F.col("primera"), "ya_finalizada"))
    )
    accepted, rejected = split(judged, *columns)
    updates = accepted.select("id_sancion", day(as_of).alias("fecha_fin"))
    updated = update_rows(t.sancion_participante, updates, ["id_sancion"])
    touched = {"sancion_participante": accepted.select("id_sancion")}
    return ChangeResult(t.with_tables(sancion_participante=updated), accepted, rejected, touched)


def delete_sanctions(asked: DataFrame, t: Tables) -> ChangeResult:
    columns = asked.columns
    judged = rules.exists_in(
        asked, t.sancion_participante, {"id_sancion": "id_sancion"}, "existe"
    )
    judged = mark_first(judged, ["id_sancion"], "primera").withColumn(
        "motivo", first_reason(("sancion_inexistente", F.col("existe") & F.col("primera")))
    )
    accepted, rejected = split(judged, *columns)
    kept = delete_rows(t.sancion_participante, accepted, ["id_sancion"])
    touched = {"sancion_participante": accepted.select("id_sancion")}
    return ChangeResult(t.with_tables(sancion_participante=kept), accepted, rejected, touched)
