"""Key figures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aulario.functions.scalar import Date, in_force, mean1, pct2, severity
from aulario.operators import listings
from aulario.operators.aggregates import in_state, or_zero, participants_by_booking, usage_by_room
from aulario.operators.reports import cancellations_by_building
from aulario.tables import ROOM, Tables


def dashboard(t: Tables, as_of: Date) -> DataFrame:
    """Four totals in one row: three scalar subqueries beside the bookings aggregate."""
    people = t.participante.agg(F.count("*").alias("n")).scalar()
    rooms = t.sala.agg(F.count("*").alias("n")).scalar()
    banned = t.sancion_participante.agg(F.count_if(in_force(as_of)).alias("n")).scalar()
    return t.reserva.agg(F.count_if(in_state("activa")).alias("reservas_activas")).select(
        people.alias("total_participantes"),
        rooms.alias("total_salas"),
        "reservas_activas",
        banned.alias("sanciones_activas"),
    )


def room_statistics(t: Tables) -> DataFrame:
    """Total, active bookings and cancellation rate of every room, 0 without bookings."""
    return t.sala.join(usage_by_room(t.reserva), ROOM, "left").select(
        *ROOM,
        or_zero("reservas").alias("total_reservas"),
        or_zero("activas").alias("reservas_activas"),
        F.coalesce(pct2(F.col("canceladas"), F.col("reservas")), F.lit(0.0)).alias(
            "tasa_cancelacion"
        ),
    )


def sanction_statistics(t: Tables, as_of: Date) -> DataFrame:
    """Counts and mean length over all sanctions, through one row per participant."""
    now = in_force(as_of)
    by_person = t.sancion_participante.groupBy("ci_participante").agg(
        F.count_if(now).alias("activas"),
        F.count("*").alias("n"),
        F.sum(F.datediff("fecha_fin", "fecha_inicio")).alias("dias"),
    )
    totals = by_person.agg(
        F.sum("activas").alias("activas"),
        F.sum("n").alias("totales"),
        F.count_if(F.col("activas") > 0).alias("participantes_sancionados"),
        F.sum("dias").alias("dias"),
    )
    return totals.select(
        or_zero("activas").alias("activas"),
        or_zero("totales").alias("totales"),
        "participantes_sancionados",
        mean1(F.col("dias"), F.col("totales")).alias("duracion_promedio_dias"),
    )


def status_tiles(t: Tables, scope: str = "page") -> DataFrame:
    """Bookings by status over the listing page, or over all bookings."""
    if scope not in ("page", "all"):
        raise ValueError("scope is 'page' or 'all'")
    listed = listings.latest_bookings(t) if scope == "page" else t.reserva
    return listed.groupBy("estado").agg(F.count("*").alias("total"))


def sanction_tiles(t: Tables, as_of: Date) -> DataFrame:
    return listings.sanctions(t, as_of).groupBy("estado").agg(F.count("*").alias("total"))


def seats_left(t: Tables) -> DataFrame:
    """Free seats per booking and whether it is full."""
    inside = or_zero("num_participantes")
    return (
        t.reserva.join(t.sala, ROOM)
        .join(participants_by_booking(t.reserva_participante), "id_reserva", "left")
        .select(
            "id_reserva",
            "capacidad",
            inside.alias("num_participantes"),
            (F.col("capacidad") - inside).alias("lugares_restantes"),
            (inside >= F.col("capacidad")).alias("completa"),
        )
    )


def cancellation_severity(t: Tables, as_of: Date) -> DataFrame:
    return cancellations_by_building(t, as_of).select(
        "nombre_edificio", "porcentaje_cancelacion", severity().alias("nivel")
    )


def own_booking_counts(t: Tables) -> DataFrame:
    """Bookings each participant sees on the own page, which is cut at its page size.

    Counting does not need the page itself: a page of n bookings shows min(n, size).
    """
    own = (
        t.reserva_participante.join(t.reserva.select("id_reserva"), "id_reserva", "left_semi")
        .groupBy(F.col("ci_participante").alias("ci"))
        .agg(F.count("*").alias("n"))
    )
    return t.participante.join(own, "ci", "left").select(
        "ci", F.least(or_zero("n"), F.lit(listings.OWN_LIMIT).cast("bigint")).alias("reservas")
    )
