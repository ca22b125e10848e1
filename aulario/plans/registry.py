"""Reports by name."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from aulario.functions.scalar import Date
from aulario.operators import reports as r
from aulario.tables import Tables

Report = Callable[[Tables, Date], DataFrame]


@dataclass(frozen=True)
class Entry:
    title: str
    view: str
    full: Report
    basic: Report


# Ids, titles and view names are fixed values of the public interface.
REPORTS: dict[str, Entry] = {
    "salas_mas_reservadas": Entry(
        "Salas Más Reservadas",
        "v_salas_mas_reservadas",
        r.most_booked_rooms,
        r.basic_most_booked_rooms,
    ),
    "turnos_demandados": Entry(
        "Turnos Más Demandados",
        "v_turnos_mas_demandados",
        r.most_demanded_slots,
        r.most_demanded_slots,
    ),
    "promedio_participantes": Entry(
        "Promedio de Participantes",
        "v_promedio_participantes_sala",
        r.mean_participants,
        r.basic_mean_participants,
    ),
    "reservas_por_carrera": Entry(
        "Reservas por Carrera",
        "v_reservas_por_carrera_facultad",
        r.bookings_by_programme,
        r.basic_bookings_by_programme,
    ),
    "ocupacion_edificio": Entry(
        "Ocupación por Edificio",
        "v_ocupacion_por_edificio",
        r.occupancy_by_building,
        r.occupancy_by_building,
    ),
    "reservas_por_tipo": Entry(
        "Reservas por Tipo de Usuario",
        "v_reservas_asistencias_por_tipo",
        r.bookings_by_user_type,
        r.basic_bookings_by_user_type,
    ),
    "sanciones_por_tipo": Entry(
        "Sanciones por Tipo",
        "v_sanciones_por_tipo_usuario",
        r.sanctions_by_user_type,
        r.basic_sanctions_by_user_type,
    ),
    "efectividad": Entry(
        "Efectividad de Reservas",
        "v_efectividad_reservas",
        r.booking_outcomes,
        r.booking_outcomes,
    ),
    "horas_semana": Entry(
        "Horas Reservadas por Semana",
        "v_horas_reservadas_por_semana",
        r.booked_hours_by_week,
        r.basic_booked_hours_by_week,
    ),
    "participantes_sancionados": Entry(
        "Participantes Más Sancionados",
        "v_participantes_mas_sancionados",
        r.most_sanctioned_participants,
        r.basic_most_sanctioned_participants,
    ),
    "edificios_cancelaciones": Entry(
        "Edificios con Más Cancelaciones",
        "v_edificios_mas_cancelaciones",
        r.cancellations_by_building,
        r.basic_cancellations_by_building,
    ),
}


def report(name: str, variant: str = "full") -> Report:
    """The report function of ``name``; an unknown name or variant is an error."""
    if name not in REPORTS:
        raise ValueError(f"unknown report {name!r}; known: {', '.join(REPORTS)}")
    if variant not in ("full", "basic"):
        raise ValueError(f"unknown variant {variant!r}; known: full, basic")
    return getattr(REPORTS[name], variant)


def catalog(spark: SparkSession) -> DataFrame:
    rows = [(key, entry.title, entry.view) for key, entry in REPORTS.items()]
    return spark.createDataFrame(rows, "id string, nombre string, vista string")


def register_views(tables: Tables, as_of: Date) -> list[str]:
    """Publish every report as a temporary view for SQL users."""
    for key, entry in REPORTS.items():
        report(key)(tables, as_of).createOrReplaceTempView(entry.view)
    return [entry.view for entry in REPORTS.values()]
