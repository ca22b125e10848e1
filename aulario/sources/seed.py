"""A small sample data set with dates relative to a reference day."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import SparkSession

from aulario.sources.schemas import SCHEMAS
from aulario.tables import Tables


# The sample rows.
FACULTIES = [
    (1, "Facultad de Ingeniería"),
    (2, "Facultad de Ciencias Sociales"),
    (3, "Facultad de Medicina"),
    (4, "Facultad de Derecho"),
]
PROGRAMMES = [
    ("Ingeniería en Sistemas", 1, "grado"),
    ("Ingeniería Civil", 1, "grado"),
    ("Maestría en Ingeniería de Software", 1, "posgrado"),
    ("Psicología", 2, "grado"),
    ("Doctorado en Ciencias Sociales", 2, "posgrado"),
    ("Medicina", 3, "grado"),
    ("Derecho", 4, "grado"),
]
PARTICIPANTS = [
    ("12345678", "Juan", "Pérez", "juan.perez@uni.edu"),
    ("23456789", "María", "Gómez", "maria.gomez@uni.edu"),
    ("34567890", "Carlos", "Rodríguez", "carlos.rodriguez@uni.edu"),
    ("45678901", "Ana", "Martínez", "ana.martinez@uni.edu"),
    ("56789012", "Luis", "Fernández", "luis.fernandez@uni.edu"),
    ("67890123", "Sofía", "López", "sofia.lopez@uni.edu"),
    ("78901234", "Pedro", "Sánchez", "pedro.sanchez@uni.edu"),
    ("89012345", "Laura", "García", "laura.garcia@uni.edu"),
]
ENROLMENTS = [
    (1, "12345678", "Ingeniería en Sistemas", "alumno"),
    (2, "23456789", "Ingeniería Civil", "alumno"),
    (3, "34567890", "Maestría en Ingeniería de Software", "alumno"),
    (4, "45678901", "Psicología", "alumno"),
    (5, "56789012", "Ingeniería en Sistemas", "docente"),
    (6, "67890123", "Doctorado en Ciencias Sociales", "alumno"),
    (7, "78901234", "Medicina", "docente"),
    (8, "89012345", "Derecho", "alumno"),
]
BUILDINGS = [
    ("Edificio Central", "Av. Principal 1234", "Montevideo"),
    ("Edificio Norte", "Calle Norte 567", "Montevideo"),
    ("Edificio Sur", "Calle Sur 890", "Canelones"),
]
ROOMS = [
    ("Sala 101", "Edificio Central", 6, "libre"),
    ("Sala 102", "Edificio Central", 8, "libre"),
    ("Sala 201", "Edificio Central", 4, "posgrado"),
    ("Sala 301", "Edificio Central", 10, "docente"),
    ("Sala A1", "Edificio Norte", 6, "libre"),
    ("Sala A2", "Edificio Norte", 8, "libre"),
    ("Sala B1", "Edificio Norte", 5, "posgrado"),
    ("Sala C1", "Edificio Sur", 12, "libre"),
    ("Sala C2", "Edificio Sur", 6, "docente"),
]
# Room, building, days after the reference day, slot, status.
BOOKINGS = [
    ("Sala 101", "Edificio Central", 0, 1, "activa"),
    ("Sala 102", "Edificio Central", 0, 2, "activa"),
    ("Sala 201", "Edificio Central", 0, 3, "activa"),
    ("Sala A1", "Edificio Norte", 0, 4, "finalizada"),
    ("Sala A2", "Edificio Norte", 1, 5, "activa"),
    ("Sala C1", "Edificio Sur", 2, 6, "activa"),
]
# Participant, booking, attendance.
PARTICIPATIONS = [
    ("12345678", 1, None),
    ("23456789", 1, None),
    ("34567890", 2, None),
    ("45678901", 3, None),
    ("56789012", 4, True),
    ("67890123", 4, True),
    ("78901234", 5, None),
    ("89012345", 6, None),
]
# Participant, first and last day relative to the reference day.
SANCTIONS = [("12345678", -90, -30)]
FIRST_HOUR, LAST_HOUR = 8, 23


def hourly_slots() -> list[tuple[int, str, str]]:
    return [
        (i, f"{hour:02d}:00:00", f"{hour + 1:02d}:00:00")
        for i, hour in enumerate(range(FIRST_HOUR, LAST_HOUR), start=1)
    ]


def seed_tables(spark: SparkSession, today: dt.date) -> Tables:
    def shifted(days: int) -> dt.date:
        return today + dt.timedelta(days=days)

    moment = dt.datetime.combine(today, dt.time())
    rows: dict[str, list[tuple]] = {
        "facultad": FACULTIES,
        "programa_academico": PROGRAMMES,
        "participante": PARTICIPANTS,
        "participante_programa_academico": ENROLMENTS,
        "edificio": BUILDINGS,
        "sala": ROOMS,
        "turno": hourly_slots(),
        "reserva": [
            (i, room, building, shifted(days), slot, state)
            for i, (room, building, days, slot, state) in enumerate(BOOKINGS, start=1)
        ],
        "reserva_participante": [
            (ci, booking, moment, came) for ci, booking, came in PARTICIPATIONS
        ],
        "sancion_participante": [
            (i, ci, shifted(start), shifted(end))
            for i, (ci, start, end) in enumerate(SANCTIONS, start=1)
        ],
    }
    return Tables(**{name: spark.createDataFrame(rows[name], SCHEMAS[name]) for name in SCHEMAS})
