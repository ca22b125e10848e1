"""Booking rules evaluated for whole sets of requests.

A rule takes requests and adds a boolean column, true when the request passes.
State is narrowed to what the requests touch before it is joined or counted, so
the cost follows the size of the change set; whether the narrowing side is
broadcast is left to the size limits of the session.

Requests carry ``id_solicitud`` (unique), ``ci_participante``, the four slot
columns and ``solicitada_en``. Rules that follow one another are given the requests
as they were written first in ``asked``: state is narrowed by those, and not by all
joins of the rules before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aulario.functions.scalar import Date, day, in_force, week_start
from aulario.operators.aggregates import in_state, or_zero, participants_by_booking
from aulario.session import cut
from aulario.sources.schemas import (
    BOOKING_STATES,
    MAX_BOOKINGS_PER_DAY,
    MAX_BOOKINGS_PER_WEEK,
    ROOM_TYPES,
)
from aulario.tables import ROOM, SLOT, Tables

CI = "ci_participante"


def mark(df: DataFrame, keys: DataFrame, on: list[str], name: str) -> DataFrame:
    """Add ``name``: whether the row's key occurs in ``keys``.

    The keys are materialised, so rows that crowd on one key can be split over tasks.
    """
    present = cut(keys.select(*on).distinct()).withColumn(name, F.lit(True))
    return df.join(present, on, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def flag(df: DataFrame, keys: DataFrame, on: list[str], name: str) -> DataFrame:
    """Like ``mark``, for keys that are distinct and materialised already."""
    return df.join(keys.select(*on, F.lit(True).alias(name)), on, "left").withColumn(
        name, F.coalesce(name, F.lit(False))
    )


def no_sanction(requests: DataFrame, t: Tables, as_of: Date) -> DataFrame:
    """``sin_sancion``: no sanction in force on the reference date (not the booked date)."""
    banned = t.sancion_participante.filter(in_force(as_of))
    return mark(requests, banned, [CI], "sin_sancion").withColumn(
        "sin_sancion", ~F.col("sin_sancion")
    )


def active_bookings_by_day(t: Tables, people: DataFrame) -> DataFrame:
    """Active bookings per participant and date, for the given participants only."""
    own = t.reserva_participante.join(people.select(CI), CI, "left_semi")
    return (
        own.join(t.reserva.filter(in_state("activa")), "id_reserva")
        .groupBy(CI, "fecha")
        .agg(F.count("id_reserva").alias("activas"))
    )


def booked_that_day(requests: DataFrame, t: Tables, asked: DataFrame | None = None) -> DataFrame:
    """Add ``activas_dia`` and ``activas_semana``, the active bookings the quotas count.

    Days travel as a map inside their week (at most seven entries), so the requests are
    joined once.
    """
    weekly = (
        active_bookings_by_day(t, asked or requests)
        .groupBy(CI, week_start(F.col("fecha")).alias("lunes"))
        .agg(
            F.sum("activas").alias("activas_semana"),
            F.map_from_entries(F.collect_list(F.struct("fecha", "activas"))).alias("por_dia"),
        )
    )
    return (
        requests.withColumn("lunes", week_start(F.col("fecha")))
        .join(cut(weekly), [CI, "lunes"], "left")
        .withColumn("activas_dia", F.try_element_at("por_dia", F.col("fecha")))
        .withColumn("activas_dia", or_zero("activas_dia"))
        .withColumn("activas_semana", or_zero("activas_semana"))
        .drop("por_dia")
    )


def within_daily_limit(requests: DataFrame, t: Tables) -> DataFrame:
    daily = active_bookings_by_day(t, requests)
    return (
        requests.join(cut(daily), [CI, "fecha"], "left")
        .withColumn("en_limite_dia", or_zero("activas") < MAX_BOOKINGS_PER_DAY)
        .drop("activas")
    )


def within_weekly_limit(requests: DataFrame, t: Tables) -> DataFrame:
    weekly = (
        active_bookings_by_day(t, requests)
        .groupBy(CI, week_start(F.col("fecha")).alias("lunes"))
        .agg(F.sum("activas").alias("activas"))
    )
    return (
        requests.withColumn("lunes", week_start(F.col("fecha")))
        .join(cut(weekly), [CI, "lunes"], "left")
        .withColumn("en_limite_semana", or_zero("activas") < MAX_BOOKINGS_PER_WEEK)
        .drop("activas", "lunes")
    )


def fits_capacity(requests: DataFrame, t: Tables, n: Column | int = 1) -> DataFrame:
    """``cabe``: present participants of ``id_reserva`` plus ``n`` fit the room; unknown room fails."""
    n = F.lit(n) if isinstance(n, int) else n
    touched = t.reserva_participante.join(
        requests.select("id_reserva"), "id_reserva", "left_semi"
    )
    return (
        requests.join(cut(participants_by_booking(touched)), "id_reserva", "left")
        .join(t.sala.select(*ROOM, "capacidad"), ROOM, "left")
        .withColumn(
            "cabe",
            F.coalesce(or_zero("num_participantes") + n <= F.col("capacidad"), F.lit(False)),
        )
        .drop("num_participantes", "capacidad")
    )


def privileged(t: Tables, people: DataFrame | None = None) -> DataFrame:
    """``privilegiado`` per enrolled participant: teaches, or studies a postgraduate programme.

    Any enrolment counts, so the answer does not depend on the order of rows. With ``people``
    only their enrolments are read.
    """
    counts = (F.col("rol") == "docente") | (F.col("tipo") == "posgrado")
    enrolled = t.participante_programa_academico
    if people is not None:
        enrolled = enrolled.join(people.select(CI), CI, "left_semi")
    return (
        enrolled.join(t.programa_academico, "nombre_programa")
        .groupBy(CI)
        .agg(F.bool_or(counts).alias("privilegiado"))
    )


def with_privilege(requests: DataFrame, t: Tables, asked: DataFrame | None = None) -> DataFrame:
    return requests.join(cut(privileged(t, asked or requests)), CI, "left").withColumn(
        "privilegiado", F.coalesce("privilegiado", F.lit(False))
    )


def room_allowed(requests: DataFrame, t: Tables, asked: DataFrame | None = None) -> DataFrame:
    """``sala_permitida`` (and ``privilegiado``): free rooms for all, the others for the privileged."""
    kind = F.col("tipo_sala")
    reserved = kind.isin([r for r in ROOM_TYPES if r != "libre"])
    return (
        with_privilege(requests, t, asked)
        .join(t.sala.select(*ROOM, "tipo_sala"), ROOM, "left")
        .withColumn(
            "sala_permitida",
            F.coalesce((kind == "libre") | (reserved & F.col("privilegiado")), F.lit(False)),
        )
        .drop("tipo_sala")
    )


def touched_slots(requests: DataFrame, t: Tables) -> DataFrame:
    """Bookings, of any status, in the slots asked for."""
    return t.reserva.join(requests.select(*SLOT), SLOT, "left_semi")


def slot_free(requests: DataFrame, t: Tables, asked: DataFrame | None = None) -> DataFrame:
    """``turno_libre``: no booking of any status holds the slot."""
    return mark(requests, touched_slots(asked or requests, t), SLOT, "turno_libre").withColumn(
        "turno_libre", ~F.col("turno_libre")
    )


def slot_free_for_move(moves: DataFrame, t: Tables) -> DataFrame:
    """``turno_libre``: no booking but the moved one (``id_reserva``) holds the slot."""
    holders = (
        touched_slots(moves, t)
        .groupBy(*SLOT)
        .agg(F.min("id_reserva").alias("primera"), F.max("id_reserva").alias("ultima"))
    )
    own = F.col("id_reserva")
    return (
        moves.join(cut(holders), SLOT, "left")
        .withColumn(
            "turno_libre",
            F.col("primera").isNull() | ((F.col("primera") == own) & (F.col("ultima") == own)),
        )
        .drop("primera", "ultima")
    )


def without_active_bookings(t: Tables, people: DataFrame) -> DataFrame:
    """The given participants (``ci``) who have no active booking and may be deleted."""
    return people.join(
        _with_active_bookings(t, people).withColumnRenamed(CI, "ci"), "ci", "left_anti"
    )


def _with_active_bookings(t: Tables, people: DataFrame) -> DataFrame:
    own = t.reserva_participante.join(people.select(F.col("ci").alias(CI)), CI, "left_semi")
    return own.join(t.reserva.filter(in_state("activa")), "id_reserva", "left_semi").select(CI)


def room_deletion_blocks(
    t: Tables, rooms: DataFrame, as_of: Date, asked: DataFrame | None = None
) -> DataFrame:
    """Whether each given room has active, future or any bookings."""
    touched = t.reserva.join((asked or rooms).select(*ROOM), ROOM, "left_semi")
    uses = touched.groupBy(*ROOM).agg(
        F.bool_or(in_state("activa")).alias("con_activas"),
        F.bool_or(F.col("fecha") >= day(as_of)).alias("con_futuras"),
    )
    return (
        rooms.join(cut(uses).withColumn("con_reservas", F.lit(True)), ROOM, "left")
        .withColumn("con_activas", F.coalesce("con_activas", F.lit(False)))
        .withColumn("con_futuras", F.coalesce("con_futuras", F.lit(False)))
        .withColumn("con_reservas", F.coalesce("con_reservas", F.lit(False)))
    )


def deletable_rooms(t: Tables, rooms: DataFrame, as_of: Date) -> DataFrame:
    """The given rooms without active and without future bookings."""
    return (
        room_deletion_blocks(t, rooms, as_of)
        .filter(~F.col("con_activas") & ~F.col("con_futuras"))
        .drop("con_activas", "con_futuras", "con_reservas")
    )


def dates_in_order(requests: DataFrame) -> DataFrame:
    return requests.withColumn("fechas_en_orden", F.col("fecha_fin") > F.col("fecha_inicio"))


def overlaps_sanction(
    requests: DataFrame, sancion: DataFrame, key: str = "id_solicitud", own: str | None = None
) -> DataFrame:
    """``solapada``: a sanction of the same participant touches the asked period.

    ``key`` identifies a request; ``own`` names the column with the sanction to leave
    out, for changes of an existing one. Periods are closed. A request whose end lies
    before its start overlaps when one of its two dates is inside a sanction.

    Instead of pairing requests with sanctions, the latest end among the sanctions
    started up to a day is carried along the days of each participant. A participant
    contributes at most two sanctions and one question per calendar day, however many
    rows there are; the second-latest end answers for requests that leave one out.
    """
    ordered = F.col("fecha_inicio") <= F.col("fecha_fin")
    question = F.when(
        ordered, F.array(F.struct(F.col("fecha_fin").alias("dia"), F.col("fecha_inicio").alias("desde")))
    ).otherwise(
        F.array(
            F.struct(F.col("fecha_inicio").alias("dia"), F.col("fecha_inicio").alias("desde")),
            F.struct(F.col("fecha_fin").alias("dia"), F.col("fecha_fin").alias("desde")),
        )
    )
    own_id = F.col(own) if own else F.lit(None).cast("bigint")
    asked = requests.select(
        key, CI, own_id.alias("propia"), F.inline(question)
    )
    asked_days = asked.select(CI, "dia").distinct()

    concerned = sancion.join(requests.select(CI), CI, "left_semi")
    best_of_day = Window.partitionBy(CI, "fecha_inicio").orderBy(
        F.desc("fecha_fin"), F.desc("id_sancion")
    )
    starts = (
        concerned.withColumn("n", F.row_number().over(best_of_day))
        .filter("n <= 2")
        .select(
            CI,
            F.col("fecha_inicio").alias("dia"),
            F.struct(F.col("fecha_fin").alias("fin"), F.col("id_sancion").alias("id")).alias("s"),
            F.lit(False).alias("pregunta"),
        )
    )
    timeline = starts.unionByName(
        asked_days.withColumn("pregunta", F.lit(True)), allowMissingColumns=True
    )
    so_far = (
        Window.partitionBy(CI).orderBy("dia", "pregunta", "s").rowsBetween(Window.unboundedPreceding, 0)
    )
    before = (
        Window.partitionBy(CI).orderBy("dia", "pregunta", "s").rowsBetween(Window.unboundedPreceding, -1)
    )
    answers = (
        timeline.withColumn("primera", F.max("s").over(so_far))
        .withColumn("previa", F.max("s").over(before))
        .withColumn(
            "perdedora",
            F.when(F.col("previa").isNotNull() & F.col("s").isNotNull(), F.least("previa", "s")),
        )
        .withColumn("segunda", F.max("perdedora").over(so_far))
        .filter("pregunta")
        .select(CI, "dia", "primera", "segunda")
    )
    end = F.when(F.col("primera.id") == F.col("propia"), F.col("segunda.fin")).otherwise(
        F.col("primera.fin")
    )
    hit = asked.join(answers, [CI, "dia"]).filter(end >= F.col("desde"))
    return mark(requests, hit, [key], "solapada")


def complete(df: DataFrame, required: list[str]) -> DataFrame:
    """``completa``: every required field is present and not the empty text."""
    filled = [F.coalesce(F.col(c).cast("string") != "", F.lit(False)) for c in required]
    test = filled[0]
    for f in filled[1:]:
        test = test & f
    return df.withColumn("completa", test)


def valid_status(df: DataFrame, column: str = "estado") -> DataFrame:
    return df.withColumn(
        "estado_valido", F.coalesce(F.col(column).isin(BOOKING_STATES), F.lit(False))
    )


def parse_requests(raw: DataFrame) -> DataFrame:
    """Typed ``fecha`` and ``id_turno`` from text, and whether both could be read.

    Dates are year-month-day with four digits for the year and one or two for the rest.
    """
    date = F.col("fecha")
    readable = date.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$")
    return (
        raw.withColumn("fecha", F.when(readable, F.try_to_date(date, "yyyy-M-d")))
        .withColumn("id_turno", F.trim(F.col("id_turno")).try_cast("int"))
        .withColumn("datos_validos", F.col("fecha").isNotNull() & F.col("id_turno").isNotNull())
    )


def not_in_past(requests: DataFrame, as_of: Date) -> DataFrame:
    return requests.withColumn("no_pasada", F.col("fecha") >= day(as_of))


def exists_in(
    df: DataFrame, parent: DataFrame, on: dict[str, str], name: str, asked: DataFrame | None = None
) -> DataFrame:
    """Add ``name``: whether the referenced parent row exists (``on`` maps child to parent).

    Of the parent only the keys asked for are kept.
    """
    keys = parent.select(*[F.col(p).alias(c) for c, p in on.items()])
    wanted = (asked or df).select(*on)
    return mark(df, keys.join(wanted, list(on), "left_semi"), list(on), name)


def evaluate_requests(requests: DataFrame, t: Tables, as_of: Date) -> DataFrame:
    """Every booking rule for every request, each judged against the state alone."""
    asked = cut(requests)
    judged = room_allowed(no_sanction(asked, t, as_of), t, asked)
    judged = slot_free(booked_that_day(judged, t, asked), t, asked)
    return (
        judged.withColumn("en_limite_dia", F.col("activas_dia") < MAX_BOOKINGS_PER_DAY)
        .withColumn("en_limite_semana", F.col("activas_semana") < MAX_BOOKINGS_PER_WEEK)
        .drop("activas_dia", "activas_semana", "lunes")
    )
