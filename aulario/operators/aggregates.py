"""Pre-aggregations the reports share.

Each one reduces a fact table on its own key before anything is joined to it, so
a hot room, booking or participant is combined on the map side and every later
join meets at most one row per key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aulario.functions.scalar import Date, in_force, user_type
from aulario.tables import ROOM, Tables


def in_state(state: str) -> Column:
    return F.col("estado") == state


def usage_by_room(reserva: DataFrame) -> DataFrame:
    """Booking counts per room; measures a caller does not select are pruned."""
    return reserva.groupBy(*ROOM).agg(
        F.count("id_reserva").alias("reservas"),
        F.count_if(in_state("activa")).alias("activas"),
        F.count_if(in_state("cancelada")).alias("canceladas"),
        F.count_if(in_state("sin asistencia")).alias("sin_asistencia"),
    )


def participants_by_booking(reserva_participante: DataFrame) -> DataFrame:
    return reserva_participante.groupBy("id_reserva").agg(
        F.count("ci_participante").alias("num_participantes")
    )


def enrolments_by_user_type(t: Tables) -> DataFrame:
    """One row per participant and user type with the number of enrolments of that type."""
    return (
        t.participante_programa_academico.join(t.programa_academico, "nombre_programa")
        .select("ci_participante", user_type().alias("tipo_usuario"))
        .groupBy("ci_participante", "tipo_usuario")
        .agg(F.count("*").alias("inscripciones"))
    )


def sanctions_by_participant(sancion: DataFrame, as_of: Date) -> DataFrame:
    return sancion.groupBy("ci_participante").agg(
        F.count("id_sancion").alias("sanciones"),
        F.count_if(in_force(as_of)).alias("vigentes"),
        F.max("fecha_fin").alias("ultimo_fin"),
        F.sum(F.datediff("fecha_fin", "fecha_inicio")).alias("dias"),
    )


def or_zero(col: str) -> Column:
    return F.coalesce(F.col(col), F.lit(0).cast("bigint"))
