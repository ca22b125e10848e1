"""The eleven management reports.

Every report takes the tables and a reference date and returns a lazy, ordered
DataFrame. Ties of a ranked report are broken by its key columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aulario.functions.scalar import (
    Date,
    day,
    pct2,
    rounded_mean,
    short_user_type,
    slot_label,
    week_in_year,
    week_start,
    year_week,
)
from aulario.operators.aggregates import (
    enrolments_by_user_type,
    in_state,
    or_zero,
    participants_by_booking,
    sanctions_by_participant,
    usage_by_room,
)
from aulario.tables import ROOM, Tables

TOP = 10
OCCUPANCY_DAYS = 30
TREND_WEEKS = 8


def most_booked_rooms(t: Tables, as_of: Date) -> DataFrame:
    usage = usage_by_room(t.reserva)
    return (
        t.sala.join(usage, ROOM, "left")
        .select(*ROOM, "capacidad", "tipo_sala", or_zero("reservas").alias("total_reservas"))
        .orderBy(F.desc("total_reservas"), *ROOM)
        .limit(TOP)
    )


def most_demanded_slots(t: Tables, as_of: Date) -> DataFrame:
    usage = t.reserva.groupBy("id_turno").agg(F.count("id_reserva").alias("reservas"))
    return (
        t.turno.join(usage, "id_turno", "left")
        .select("id_turno", slot_label().alias("horario"), or_zero("reservas").alias("total_reservas"))
        .orderBy(F.desc("total_reservas"), "id_turno")
    )


def _attendance_by_room(t: Tables) -> DataFrame:
    """Bookings and participants per room; the mean per booking is their quotient."""
    people = participants_by_booking(t.reserva_participante)
    return (
        t.reserva.join(people, "id_reserva", "left")
        .groupBy(*ROOM)
        .agg(
            F.count("id_reserva").alias("reservas"),
            F.sum(or_zero("num_participantes")).alias("personas"),
        )
    )


def mean_participants(t: Tables, as_of: Date) -> DataFrame:
    return (
        t.sala.join(_attendance_by_room(t), ROOM, "left")
        .select(
            *ROOM,
            "capacidad",
            F.coalesce(F.col("personas") / F.col("reservas"), F.lit(0.0)).alias(
                "promedio_participantes"
            ),
            F.coalesce(
                pct2(F.col("personas"), F.col("reservas") * F.col("capacidad")), F.lit(0.0)
            ).alias("porcentaje_capacidad"),
        )
        .orderBy(F.desc("promedio_participantes"), *ROOM)
    )


def bookings_by_programme(t: Tables, as_of: Date) -> DataFrame:
    """Distinct existing bookings per programme.

    The distinct pairs are formed before counting, which keeps one popular programme from
    becoming one task, and before the bookings are looked up, so no task holds the pairs and
    the sorted sides of that join at once.
    """
    enrolled = t.participante_programa_academico.select("ci_participante", "nombre_programa")
    pairs = (
        t.reserva_participante.select("ci_participante", "id_reserva")
        .join(enrolled, "ci_participante")
        .select("nombre_programa", "id_reserva")
        .distinct()
    )
    counts = (
        pairs.join(t.reserva.select("id_reserva"), "id_reserva", "left_semi")
        .groupBy("nombre_programa")
        .agg(F.count("id_reserva").alias("reservas"))
    )
    return (
        t.programa_academico.join(t.facultad, "id_facultad")
        .join(counts, "nombre_programa", "left")
        .select(
            F.col("nombre").alias("facultad"),
            "nombre_programa",
            F.col("tipo").alias("tipo_programa"),
            or_zero("reservas").alias("total_reservas"),
        )
        .orderBy("facultad", F.desc("total_reservas"), "nombre_programa")
    )


def occupancy_by_building(t: Tables, as_of: Date) -> DataFrame:
    """Share of the room-slots of the last days that were booked.

    The date bound narrows the bookings before the outer joins, so buildings
    without recent bookings, or without rooms, stay in the result.
    """
    recent = t.reserva_since(F.date_sub(day(as_of), OCCUPANCY_DAYS))
    rooms = (
        t.sala.join(usage_by_room(recent), ROOM, "left")
        .groupBy("edificio")
        .agg(
            F.count_distinct("nombre_sala").alias("salas"),
            F.sum(or_zero("reservas")).alias("reservas"),
        )
    )
    slots = t.turno.agg(F.count("*").alias("turnos")).scalar()
    return (
        t.edificio.join(rooms, t.edificio.nombre_edificio == rooms.edificio, "left")
        .select(
            "nombre_edificio",
            or_zero("salas").alias("total_salas"),
            or_zero("reservas").alias("total_reservas"),
        )
        .withColumn(
            "porcentaje_ocupacion",
            pct2(
                F.col("total_reservas"),
                F.col("total_salas") * slots * F.lit(OCCUPANCY_DAYS),
            ),
        )
        .orderBy(F.desc("porcentaje_ocupacion"), "nombre_edificio")
    )


def _bookings_by_user_type(t: Tables) -> DataFrame:
    """Bookings and attendance marks per user type, for types with participations.

    Marks count once per enrolment of the person, bookings once per type. Going
    through one row per type and booking avoids expanding the rows for two
    distinct counts.
    """
    times = F.col("inscripciones")
    return (
        t.reserva_participante.join(enrolments_by_user_type(t), "ci_participante")
        .groupBy("tipo_usuario", "id_reserva")
        .agg(
            F.sum(times).alias("filas"),
            F.sum(F.when(F.col("asistencia"), times).otherwise(F.lit(0).cast("bigint"))).alias("asistencias"),
            F.sum(F.when(~F.col("asistencia"), times).otherwise(F.lit(0).cast("bigint"))).alias("inasistencias"),
        )
        .groupBy("tipo_usuario")
        .agg(
            F.count("id_reserva").alias("total_reservas"),
            F.sum("filas").alias("filas"),
            F.sum("asistencias").alias("total_asistencias"),
            F.sum("inasistencias").alias("total_inasistencias"),
        )
    )


def bookings_by_user_type(t: Tables, as_of: Date) -> DataFrame:
    users = (
        enrolments_by_user_type(t)
        .groupBy("tipo_usuario")
        .agg(F.count("ci_participante").alias("total_usuarios"))
    )
    return (
        users.join(_bookings_by_user_type(t), "tipo_usuario", "left")
        .select(
            "tipo_usuario",
            "total_usuarios",
            or_zero("total_reservas").alias("total_reservas"),
            or_zero("total_asistencias").alias("total_asistencias"),
            or_zero("total_inasistencias").alias("total_inasistencias"),
            pct2(F.col("total_asistencias"), F.col("filas")).alias("porcentaje_asistencia"),
        )
        .orderBy(F.desc("total_reservas"), "tipo_usuario")
    )


def _sanctions_by_user_type(t: Tables, as_of: Date) -> DataFrame:
    return enrolments_by_user_type(t).join(
        sanctions_by_participant(t.sancion_participante, as_of), "ci_participante"
    )


def sanctions_by_user_type(t: Tables, as_of: Date) -> DataFrame:
    """Sanction counts per user type; a sanction counts once per enrolment of its holder."""
    times = F.col("inscripciones")
    return (
        _sanctions_by_user_type(t, as_of)
        .groupBy("tipo_usuario")
        .agg(
            F.count("ci_participante").alias("usuarios_sancionados"),
            F.sum(F.col("sanciones") * times).alias("total_sanciones"),
            F.sum(F.col("vigentes") * times).alias("sanciones_activas"),
            F.sum(F.col("dias") * times).alias("dias"),
        )
        .select(
            "tipo_usuario",
            "usuarios_sancionados",
            "total_sanciones",
            "sanciones_activas",
            rounded_mean(F.col("dias"), F.col("total_sanciones")).alias("duracion_promedio_dias"),
        )
        .orderBy(F.desc("total_sanciones"), "tipo_usuario")
    )


def booking_outcomes(t: Tables, as_of: Date) -> DataFrame:
    counts = t.reserva.groupBy("estado").agg(F.count("*").alias("total"))
    everything = counts.agg(F.sum("total").alias("n")).scalar()
    return counts.select(
        "estado", "total", pct2(F.col("total"), everything).alias("porcentaje")
    ).orderBy(F.desc("total"), "estado")


def _trend_rows(t: Tables, as_of: Date) -> DataFrame:
    return t.reserva_since(F.date_sub(day(as_of), 7 * TREND_WEEKS))


def booked_hours_by_week(t: Tables, as_of: Date) -> DataFrame:
    """Weekly totals; a week that spans New Year gives one row per calendar year."""
    date = F.col("fecha")
    return (
        _trend_rows(t, as_of)
        .groupBy(
            year_week(date).alias("semana"),
            F.year(date).alias("anio"),
            week_in_year(date).alias("num_semana"),
            week_start(date).alias("inicio_semana"),
        )
        .agg(
            F.count("*").alias("total_horas_reservadas"),
            F.count_if(in_state("activa")).alias("horas_activas"),
            F.count_if(in_state("finalizada")).alias("horas_finalizadas"),
            F.count_if(in_state("cancelada")).alias("horas_canceladas"),
        )
        .orderBy(F.desc("semana"), F.desc("anio"))
    )


def most_sanctioned_participants(t: Tables, as_of: Date) -> DataFrame:
    """Sanction counts per participant, each sanction counted once per enrolment."""
    enrolled = t.participante_programa_academico.groupBy(
        F.col("ci_participante").alias("ci")
    ).agg(
        F.count("*").alias("inscripciones"),
        F.expr("listagg(DISTINCT rol, ', ') WITHIN GROUP (ORDER BY rol)").alias("roles"),
    )
    sanctions = sanctions_by_participant(t.sancion_participante, as_of).withColumnRenamed(
        "ci_participante", "ci"
    )
    times = F.coalesce(F.col("inscripciones"), F.lit(1).cast("bigint"))
    return (
        t.participante.join(sanctions, "ci")
        .join(enrolled, "ci", "left")
        .select(
            "ci",
            "nombre",
            "apellido",
            "email",
            (F.col("sanciones") * times).alias("total_sanciones"),
            (F.col("vigentes") * times).alias("sanciones_activas"),
            F.col("ultimo_fin").alias("ultima_sancion_fin"),
            "roles",
        )
        .orderBy(F.desc("total_sanciones"), F.desc("ultima_sancion_fin"), "ci")
        .limit(TOP)
    )


def cancellations_by_building(t: Tables, as_of: Date) -> DataFrame:
    rooms = (
        t.sala.join(usage_by_room(t.reserva), ROOM)
        .groupBy("edificio")
        .agg(
            F.sum("reservas").alias("total_reservas"),
            F.sum("canceladas").alias("total_canceladas"),
            F.sum("sin_asistencia").alias("total_sin_asistencia"),
        )
    )
    total = F.col("total_reservas")
    return (
        t.edificio.join(rooms, t.edificio.nombre_edificio == rooms.edificio)
        .filter(total > 0)
        .select(
            "nombre_edificio",
            "direccion",
            "total_reservas",
            "total_canceladas",
            "total_sin_asistencia",
            pct2(F.col("total_canceladas"), total).alias("porcentaje_cancelacion"),
            pct2(F.col("total_canceladas") + F.col("total_sin_asistencia"), total).alias(
                "porcentaje_problematicas"
            ),
        )
        .orderBy(
            F.desc("total_canceladas"), F.desc("porcentaje_cancelacion"), "nombre_edificio"
        )
    )


# --- Basic variants: same topics with fewer columns or another counting rule ----------------


def basic_most_booked_rooms(t: Tables, as_of: Date) -> DataFrame:
    return most_booked_rooms(t, as_of).drop("capacidad", "tipo_sala")


def basic_mean_participants(t: Tables, as_of: Date) -> DataFrame:
    """The mean stays NULL for rooms without bookings."""
    return (
        t.sala.join(_attendance_by_room(t), ROOM, "left")
        .select(*ROOM, (F.col("personas") / F.col("reservas")).alias("promedio_participantes"))
        .orderBy(F.desc("promedio_participantes"), *ROOM)
    )


def basic_bookings_by_programme(t: Tables, as_of: Date) -> DataFrame:
    return bookings_by_programme(t, as_of).drop("tipo_programa")


def basic_bookings_by_user_type(t: Tables, as_of: Date) -> DataFrame:
    """Only types that have participations."""
    return (
        _bookings_by_user_type(t)
        .select(
            short_user_type().alias("tipo_usuario"), "total_reservas", "total_asistencias"
        )
        .orderBy(F.desc("total_reservas"), "tipo_usuario")
    )


def basic_sanctions_by_user_type(t: Tables, as_of: Date) -> DataFrame:
    """Each sanction counts once per user type of its holder."""
    return (
        _sanctions_by_user_type(t, as_of)
        .groupBy(short_user_type().alias("tipo_usuario"))
        .agg(F.sum("sanciones").alias("total_sanciones"))
        .orderBy(F.desc("total_sanciones"), "tipo_usuario")
    )


def basic_booked_hours_by_week(t: Tables, as_of: Date) -> DataFrame:
    """A week that spans New Year stays one row."""
    date = F.col("fecha")
    return (
        _trend_rows(t, as_of)
        .groupBy(year_week(date).alias("semana"), week_start(date).alias("inicio_semana"))
        .agg(F.count("*").alias("total_horas_reservadas"))
        .orderBy(F.desc("semana"))
    )


def basic_most_sanctioned_participants(t: Tables, as_of: Date) -> DataFrame:
    """Each sanction counts once."""
    sanctions = t.sancion_participante.groupBy(F.col("ci_participante").alias("ci")).agg(
        F.count("id_sancion").alias("total_sanciones")
    )
    return (
        t.participante.join(sanctions, "ci")
        .select("ci", "nombre", "apellido", "total_sanciones")
        .orderBy(F.desc("total_sanciones"), "ci")
        .limit(TOP)
    )


def basic_cancellations_by_building(t: Tables, as_of: Date) -> DataFrame:
    return (
        cancellations_by_building(t, as_of)
        .select(
            "nombre_edificio",
            F.col("total_canceladas").alias("canceladas"),
            "total_reservas",
            "porcentaje_cancelacion",
        )
        .orderBy(F.desc("canceladas"), "nombre_edificio")
    )
