"""Explicit schemas, keys and value domains of the tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

# Fixed values of the data model.
ROOM_TYPES = ["libre", "posgrado", "docente"]
PROGRAMME_TYPES = ["grado", "posgrado"]
ROLES = ["alumno", "docente"]
BOOKING_STATES = ["activa", "cancelada", "sin asistencia", "finalizada"]
OPENING_TIME = "08:00:00"
CLOSING_TIME = "23:00:00"
SANCTION_PRESET_DAYS = [7, 15, 30, 60]
MAX_BOOKINGS_PER_DAY = 2
MAX_BOOKINGS_PER_WEEK = 3


def _schema(**cols: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t, n == "asistencia") for n, t in cols.items()])


_S, _I, _L, _D = T.StringType(), T.IntegerType(), T.LongType(), T.DateType()

SCHEMAS: dict[str, T.StructType] = {
    "facultad": _schema(id_facultad=_I, nombre=_S),
    "programa_academico": _schema(nombre_programa=_S, id_facultad=_I, tipo=_S),
    "participante": _schema(ci=_S, nombre=_S, apellido=_S, email=_S),
    "participante_programa_academico": _schema(
        id_alumno_programa=_L, ci_participante=_S, nombre_programa=_S, rol=_S
    ),
    "edificio": _schema(nombre_edificio=_S, direccion=_S, departamento=_S),
    "sala": _schema(nombre_sala=_S, edificio=_S, capacidad=_I, tipo_sala=_S),
    # Times of day are 'HH:MM:SS' text: its order is the order of the times.
    "turno": _schema(id_turno=_I, hora_inicio=_S, hora_fin=_S),
    "reserva": _schema(
        id_reserva=_L, nombre_sala=_S, edificio=_S, fecha=_D, id_turno=_I, estado=_S
    ),
    "reserva_participante": _schema(
        ci_participante=_S,
        id_reserva=_L,
        fecha_solicitud_reserva=T.TimestampType(),
        asistencia=T.BooleanType(),
    ),
    "sancion_participante": _schema(
        id_sancion=_L, ci_participante=_S, fecha_inicio=_D, fecha_fin=_D
    ),
}


@dataclass(frozen=True)
class ForeignKey:
    columns: tuple[str, ...]
    parent: str
    parent_columns: tuple[str, ...]


UNIQUE_KEYS: dict[str, dict[str, tuple[str, ...]]] = {
    "facultad": {"pk": ("id_facultad",), "uk_nombre": ("nombre",)},
    "programa_academico": {"pk": ("nombre_programa",)},
    "participante": {"pk": ("ci",), "uk_email": ("email",)},
    "participante_programa_academico": {
        "pk": ("id_alumno_programa",),
        "uk_participante_programa": ("ci_participante", "nombre_programa"),
    },
    "edificio": {"pk": ("nombre_edificio",)},
    "sala": {"pk": ("nombre_sala", "edificio")},
    "turno": {"pk": ("id_turno",), "uk_turno": ("hora_inicio", "hora_fin")},
    "reserva": {
        "pk": ("id_reserva",),
        "uk_reserva": ("nombre_sala", "edificio", "fecha", "id_turno"),
    },
    "reserva_participante": {"pk": ("ci_participante", "id_reserva")},
    "sancion_participante": {"pk": ("id_sancion",)},
}

FOREIGN_KEYS: dict[str, list[ForeignKey]] = {
    "programa_academico": [ForeignKey(("id_facultad",), "facultad", ("id_facultad",))],
    "participante_programa_academico": [
        ForeignKey(("ci_participante",), "participante", ("ci",)),
        ForeignKey(("nombre_programa",), "programa_academico", ("nombre_programa",)),
    ],
    "sala": [ForeignKey(("edificio",), "edificio", ("nombre_edificio",))],
    "reserva": [
        ForeignKey(("nombre_sala", "edificio"), "sala", ("nombre_sala", "edificio")),
        ForeignKey(("id_turno",), "turno", ("id_turno",)),
    ],
    "reserva_participante": [
        ForeignKey(("ci_participante",), "participante", ("ci",)),
        ForeignKey(("id_reserva",), "reserva", ("id_reserva",)),
    ],
    "sancion_participante": [ForeignKey(("ci_participante",), "participante", ("ci",))],
}

ENUM_DOMAINS: dict[str, dict[str, list[str]]] = {
    "programa_academico": {"tipo": PROGRAMME_TYPES},
    "participante_programa_academico": {"rol": ROLES},
    "sala": {"tipo_sala": ROOM_TYPES},
    "reserva": {"estado": BOOKING_STATES},
}

# Row rules as SQL predicates that must not be false.
CHECKS: dict[str, dict[str, str]] = {
    "sala": {"capacidad_positiva": "capacidad > 0"},
    "turno": {
        "inicio_antes_de_fin": "hora_inicio < hora_fin",
        "dentro_de_horario": f"hora_inicio >= '{OPENING_TIME}' AND hora_fin <= '{CLOSING_TIME}'",
    },
    "sancion_participante": {"fin_despues_de_inicio": "fecha_fin > fecha_inicio"},
}


def room_types() -> list[str]:
    """Valid room types, in display order."""
    return list(ROOM_TYPES)
