"""Enriched listings and lookups.

Lookups of one key are the listing plus a filter, which Catalyst pushes to the
scans. Where a lookup has a form for all keys at once, that form is the operator.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aulario.functions.scalar import (
    Date,
    day,
    full_name,
    in_force,
    room_label,
    room_type_caption,
    sanction_state,
    slot_label,
    status_caption,
)
from aulario.operators.aggregates import or_zero, participants_by_booking
from aulario.tables import ROOM, Tables

LISTING_LIMIT = 100
CONSOLE_LIMIT = 50
OWN_LIMIT = 20
DASHBOARD_LIMIT = 10


def _is(**values: object) -> Column | None:
    given = [F.col(k) == F.lit(v) for k, v in values.items() if v is not None]
    condition = None
    for g in given:
        condition = g if condition is None else condition & g
    return condition


def _pick(df: DataFrame, **values: object) -> DataFrame:
    condition = _is(**values)
    return df if condition is None else df.filter(condition)


def latest_bookings(t: Tables, limit: int = LISTING_LIMIT) -> DataFrame:
    """The newest bookings with slot label and number of participants.

    The page is cut before participants are counted, and they are counted for it only.
    """
    newest = [F.desc("fecha"), F.desc("hora_inicio"), F.desc("id_reserva")]
    page = t.reserva.join(t.turno, "id_turno").orderBy(*newest).limit(limit)
    ids = page.select("id_reserva")
    people = participants_by_booking(t.reserva_participante.join(ids, "id_reserva", "left_semi"))
    return (
        page.join(people, "id_reserva", "left")
        .select(
            "id_reserva",
            *ROOM,
            "fecha",
            slot_label().alias("horario"),
            "hora_inicio",
            "hora_fin",
            "id_turno",
            "estado",
            or_zero("num_participantes").alias("num_participantes"),
        )
        .orderBy(*newest)
    )


def bookings_detailed(t: Tables, id_reserva: object = None) -> DataFrame:
    """Bookings with slot, capacity, room type and display captions; one or all."""
    return (
        _pick(t.reserva, id_reserva=id_reserva)
        .join(t.turno, "id_turno")
        .join(t.sala, ROOM)
        .select(
            "id_reserva",
            *ROOM,
            "fecha",
            "id_turno",
            "estado",
            slot_label().alias("horario"),
            "hora_inicio",
            "hora_fin",
            "capacidad",
            "tipo_sala",
            status_caption().alias("estado_texto"),
        )
    )


def booking_participants(t: Tables, id_reserva: object = None) -> DataFrame:
    """One row per participation with the person's data and attendance mark."""
    return (
        _pick(t.reserva_participante, id_reserva=id_reserva)
        .join(t.participante, F.col("ci_participante") == F.col("ci"))
        .select("id_reserva", "ci_participante", "nombre", "apellido", "email", "asistencia")
    )


def bookings_with_participants(t: Tables, id_reserva: object = None) -> DataFrame:
    """One row a booking with its participants as a nested list, ordered by identity number.

    The list is collected as a tree: every task first gathers what it has of a booking, and
    these parts are concatenated behind the shuffle. So a crowded booking is collected by all
    tasks that hold some of it, and one row meets per task and booking. A booking without
    participants has an empty list.
    """
    person = F.struct("ci_participante", "nombre", "apellido", "email", "asistencia")
    lists = (
        booking_participants(t, id_reserva)
        .groupBy("id_reserva")
        .agg(F.array_sort(F.collect_list(person)).alias("participantes"))
    )
    return (
        bookings_detailed(t, id_reserva)
        .join(lists, "id_reserva", "left")
        .withColumn("participantes", F.coalesce("participantes", F.array()))
    )


def participant_bookings(t: Tables, ci: object = None, limit: int = OWN_LIMIT) -> DataFrame:
    """The newest bookings of each participant with the own attendance mark.

    The rank filter is applied inside every map task first, so a participant with
    very many bookings sends at most ``limit`` rows per task to the shuffle.
    """
    newest = (
        Window.partitionBy("ci_participante")
        .orderBy(F.desc("fecha"), F.desc("hora_inicio"), F.desc("id_reserva"))
    )
    return (
        _pick(t.reserva_participante, ci_participante=ci)
        .join(t.reserva, "id_reserva")
        .join(t.turno, "id_turno")
        .select(
            "ci_participante",
            "id_reserva",
            *ROOM,
            "fecha",
            "hora_inicio",
            "estado",
            slot_label().alias("horario"),
            "asistencia",
        )
        .withColumn("orden", F.row_number().over(newest))
        .filter(F.col("orden") <= limit)
        .drop("hora_inicio")
    )


def slots(t: Tables) -> DataFrame:
    return t.turno.orderBy("hora_inicio")


def rooms(t: Tables, nombre_sala: object = None, edificio: object = None) -> DataFrame:
    """Rooms with the address of their building and display captions; one or all."""
    return (
        _pick(t.sala, nombre_sala=nombre_sala, edificio=edificio)
        .join(
            t.edificio.select(F.col("nombre_edificio").alias("edificio"), "direccion"),
            "edificio",
        )
        .select(
            *ROOM,
            "capacidad",
            "tipo_sala",
            "direccion",
            room_label().alias("etiqueta"),
            room_type_caption().alias("tipo_texto"),
        )
        .orderBy("edificio", "nombre_sala")
    )


def buildings(t: Tables) -> DataFrame:
    return t.edificio.select("nombre_edificio", "direccion").orderBy("nombre_edificio")


def participants(t: Tables) -> DataFrame:
    """Participants with their enrolments as text; NULL without any.

    A participant has at most one enrolment per programme, so the text is bounded
    by the number of programmes.
    """
    enrolled = t.participante_programa_academico.groupBy(
        F.col("ci_participante").alias("ci")
    ).agg(
        F.expr(
            "listagg(concat(rol, ' en ', nombre_programa), ', ')"
            " WITHIN GROUP (ORDER BY concat(rol, ' en ', nombre_programa))"
        ).alias("programas")
    )
    return (
        t.participante.join(enrolled, "ci", "left")
        .select(
            "ci", "nombre", "apellido", "email", "programas", full_name().alias("nombre_completo")
        )
        .orderBy("apellido", "nombre", "ci")
    )


def participants_with_programmes(
    t: Tables, ci: object = None, email: object = None
) -> DataFrame:
    """Participants with nested enrolments; all, one by identity number, or one by email."""
    enrolled = (
        _pick(t.participante_programa_academico, ci_participante=ci)
        .groupBy(F.col("ci_participante").alias("ci"))
        .agg(F.array_sort(F.collect_list(F.struct("nombre_programa", "rol"))).alias("programas"))
    )
    return (
        _pick(t.participante, ci=ci, email=email)
        .join(enrolled, "ci", "left")
        .withColumn("programas", F.coalesce("programas", F.array()))
    )


def programmes(t: Tables) -> DataFrame:
    return t.programa_academico.orderBy("nombre_programa")


def sanctions(t: Tables, as_of: Date, id_sancion: object = None) -> DataFrame:
    """Sanctions with their participant, state and length in days, newest first."""
    return (
        _pick(t.sancion_participante, id_sancion=id_sancion)
        .join(t.participante, F.col("ci_participante") == F.col("ci"))
        .select(
            "id_sancion",
            "ci_participante",
            "nombre",
            "apellido",
            "email",
            "fecha_inicio",
            "fecha_fin",
            sanction_state(as_of).alias("estado"),
            F.datediff("fecha_fin", "fecha_inicio").alias("duracion_dias"),
        )
        .orderBy(F.desc("fecha_inicio"), F.desc("id_sancion"))
    )


def sanction(t: Tables, as_of: Date, id_sancion: object) -> DataFrame:
    return sanctions(t, as_of, id_sancion).drop("duracion_dias")


def participant_sanctions(t: Tables, as_of: Date, ci: object = None) -> DataFrame:
    """Sanctions by participant with their state; one participant or all."""
    return (
        _pick(t.sancion_participante, ci_participante=ci)
        .select(
            "ci_participante",
            "id_sancion",
            "fecha_inicio",
            "fecha_fin",
            sanction_state(as_of).alias("estado"),
        )
        .orderBy("ci_participante", F.desc("fecha_inicio"), F.desc("id_sancion"))
    )


def participants_outside_booking(t: Tables, id_reserva: object) -> DataFrame:
    """Participants who are not in one given booking."""
    inside = t.reserva_participante.filter(F.col("id_reserva") == F.lit(id_reserva)).select(
        F.col("ci_participante").alias("ci")
    )
    return t.participante.join(inside, "ci", "left_anti").select("ci", "nombre", "apellido")


def available_participants(t: Tables) -> DataFrame:
    """How many participants each booking could still be offered to.

    The names themselves would be all pairs of bookings and participants; the
    count is the number of participants less the known ones already inside.
    """
    everyone = t.participante.agg(F.count("*").alias("n")).scalar()
    known = t.participante.select(F.col("ci").alias("ci_participante"))
    inside = participants_by_booking(
        t.reserva_participante.join(known, "ci_participante", "left_semi")
    )
    return t.reserva.join(inside, "id_reserva", "left").select(
        "id_reserva", (everyone - or_zero("num_participantes")).alias("disponibles")
    )


def memberships(t: Tables, asked: DataFrame) -> DataFrame:
    """The asked (id_reserva, ci_participante) pairs that are participations."""
    return asked.join(
        t.reserva_participante.select("id_reserva", "ci_participante"),
        ["id_reserva", "ci_participante"],
        "left_semi",
    )


def teachers(t: Tables) -> DataFrame:
    """Participants with at least one teaching enrolment (they administer the system)."""
    teaching = t.participante_programa_academico.filter(F.col("rol") == "docente").select(
        F.col("ci_participante").alias("ci")
    )
    return t.participante.join(teaching, "ci", "left_semi")


def sanctions_in_force(t: Tables, as_of: Date, ci: object = None) -> DataFrame:
    """The sanction in force per participant; of several, the one that ends last."""
    latest = F.max(F.struct("fecha_fin", "id_sancion", "fecha_inicio")).alias("s")
    return (
        _pick(t.sancion_participante, ci_participante=ci)
        .filter(in_force(day(as_of)))
        .groupBy("ci_participante")
        .agg(latest)
        .select("ci_participante", "s.id_sancion", "s.fecha_inicio", "s.fecha_fin")
    )


def participant_by_email(t: Tables, email: object) -> DataFrame:
    return _pick(t.participante, email=email)
