"""Small hand-made cases around the limits of the reports and the audit."""

from __future__ import annotations

import datetime as dt

from aulario.functions.scalar import mean1, pct2, rounded_mean, week_in_year, week_start, year_week
from aulario.operators import kpis, listings, reports
from aulario.operators.constraints import check_constraints
from aulario.plans.registry import report
from pyspark.sql import functions as F
from tests.conftest import TODAY, frame, rows

BOOKING = "id_reserva int, nombre_sala string, edificio string, fecha date, id_turno int, estado string"
PART = "ci_participante string, id_reserva int, fecha_solicitud_reserva timestamp, asistencia boolean"
NOW = dt.datetime(2026, 12, 1)


def bookings(spark, data):
    return frame(spark, data, BOOKING)


def test_percentages(spark):
    cases = [(1, 3, 33.33), (2, 3, 66.67), (1, 8, 12.5), (201, 20000, 1.01), (0, 5, 0.0), (1, 0, None),
             (1005, 100000, 1.01)]
    df = frame(spark, [c[:2] for c in cases], "k long, n long").select(pct2(F.col("k"), F.col("n")))
    assert [r[0] for r in rows(df)] == [c[2] for c in cases]
    means = frame(spark, [(5, 2), (3, 2), (0, 0)], "k long, n long").select(
        rounded_mean(F.col("k"), F.col("n")), mean1(F.col("k"), F.col("n"))
    )
    assert rows(means) == [(3, 2.5), (2, 1.5), (None, 0.0)]


def test_week_numbers(spark):
    expected = {
        "2024-12-29": (202452, 52, "2024-12-23"), "2024-12-30": (202501, 53, "2024-12-30"),
        "2025-01-01": (202501, 1, "2024-12-30"), "2023-01-01": (202252, 0, "2022-12-26"),
        "2026-12-01": (202649, 49, "2026-11-30"), "2020-12-31": (202053, 53, "2020-12-28"),
        "2021-01-03": (202053, 0, "2020-12-28"),
    }
    df = frame(spark, [(d,) for d in expected], "d string").withColumn("d", F.col("d").cast("date"))
    got = df.select(F.col("d").cast("string"), year_week(F.col("d")), week_in_year(F.col("d")),
                    week_start(F.col("d")).cast("string"))
    assert {r[0]: r[1:] for r in rows(got)} == expected


def test_week_over_new_year(spark, seed):
    t = seed.with_tables(reserva=bookings(spark, [
        (1, "Sala 101", "Edificio Central", dt.date(2024, 12, 30), 1, "activa"),
        (2, "Sala 101", "Edificio Central", dt.date(2025, 1, 1), 1, "sin asistencia"),
    ]))
    day = dt.date(2025, 1, 2)
    assert [r[:5] for r in rows(report("horas_semana")(t, day))] == [
        (202501, 2025, 1, dt.date(2024, 12, 30), 1), (202501, 2024, 53, dt.date(2024, 12, 30), 1),
    ]
    assert rows(report("horas_semana", "basic")(t, day)) == [(202501, dt.date(2024, 12, 30), 2)]


def test_date_bounds_are_closed(spark, seed):
    def made(days):
        return bookings(spark, [(i, "Sala 101", "Edificio Central", TODAY + dt.timedelta(d), 1, "cancelada")
                                for i, d in enumerate(days)])

    t = seed.with_tables(reserva=made([-31, -30, 400]))
    assert {r[0]: r[2] for r in rows(report("ocupacion_edificio")(t, TODAY))}["Edificio Central"] == 2
    t = seed.with_tables(reserva=made([-57, -56, 400]))
    assert sum(r[4] for r in rows(report("horas_semana")(t, TODAY))) == 2


def test_same_room_name_in_two_buildings(spark, seed):
    rooms = frame(spark, [("A", "Edificio Norte", 2, "libre"), ("A", "Edificio Sur", 4, "libre")],
                  "nombre_sala string, edificio string, capacidad int, tipo_sala string")
    t = seed.with_tables(sala=rooms, reserva=bookings(spark, [
        (1, "A", "Edificio Norte", TODAY, 1, "cancelada"), (2, "A", "Edificio Norte", TODAY, 2, "activa"),
        (3, "A", "Edificio Sur", TODAY, 1, "sin asistencia"),
    ]), reserva_participante=frame(spark, [("12345678", 1, NOW, None), ("23456789", 1, NOW, None)], PART))
    assert [(r[1], r[4]) for r in rows(report("salas_mas_reservadas")(t, TODAY))] == [
        ("Edificio Norte", 2), ("Edificio Sur", 1),
    ]
    assert {r[1]: r[3:] for r in rows(report("promedio_participantes")(t, TODAY))} == {
        "Edificio Norte": (1.0, 50.0), "Edificio Sur": (0.0, 0.0),
    }
    occupied = {r[0]: r[1:] for r in rows(report("ocupacion_edificio")(t, TODAY))}
    assert occupied["Edificio Central"] == (0, 0, None)  # a building without rooms
    assert occupied["Edificio Norte"] == (1, 2, 0.44)
    assert rows(report("edificios_cancelaciones")(t, TODAY)) == [
        ("Edificio Norte", "Calle Norte 567", 2, 1, 0, 50.0, 50.0),
        ("Edificio Sur", "Calle Sur 890", 1, 0, 1, 0.0, 100.0),
    ]
    assert {r[0]: r[2] for r in rows(kpis.cancellation_severity(t, TODAY))} == {
        "Edificio Norte": "danger", "Edificio Sur": "success",
    }
    assert {r[0]: r[4] for r in rows(kpis.seats_left(t))} == {1: True, 2: False, 3: False}


def test_enrolment_fan_out(spark, seed):
    """Someone with two enrolments counts twice in the full reports, once in the basic ones."""
    day = TODAY
    enrolled = frame(spark, [(1, "12345678", "Derecho", "alumno"), (2, "12345678", "Psicología", "alumno"),
                             (3, "12345678", "Medicina", "docente"), (4, "23456789", "Derecho", "alumno")],
                     "id_alumno_programa int, ci_participante string, nombre_programa string, rol string")
    sanctions = frame(spark, [(1, "12345678", day - dt.timedelta(5), day), (2, "12345678", day, day + dt.timedelta(4)),
                              (3, "34567890", day - dt.timedelta(9), day - dt.timedelta(1))],
                      "id_sancion int, ci_participante string, fecha_inicio date, fecha_fin date")
    people = frame(spark, [("12345678", 1, NOW, True), ("12345678", 2, NOW, False), ("23456789", 1, NOW, None)], PART)
    t = seed.with_tables(participante_programa_academico=enrolled, sancion_participante=sanctions,
                         reserva_participante=people)
    assert {r[0]: r[1:] for r in rows(report("reservas_por_tipo")(t, day))} == {
        "Alumno Grado": (2, 2, 2, 2, 40.0), "Docente": (1, 2, 1, 1, 50.0),
    }
    assert {r[0]: r[1:] for r in rows(report("reservas_por_tipo", "basic")(t, day))} == {
        "Grado": (2, 2), "Docente": (2, 1),
    }
    assert {r[0]: r[1:] for r in rows(report("sanciones_por_tipo")(t, day))} == {
        "Alumno Grado": (1, 4, 4, 5), "Docente": (1, 2, 2, 5),
    }
    assert dict(rows(report("sanciones_por_tipo", "basic")(t, day))) == {"Grado": 2, "Docente": 2}
    top = {r[0]: r[4:] for r in rows(report("participantes_sancionados")(t, day))}
    assert top == {
        "12345678": (6, 6, day + dt.timedelta(4), "alumno, docente"),
        "34567890": (1, 0, day - dt.timedelta(1), None),
    }
    assert [r[3] for r in rows(report("participantes_sancionados", "basic")(t, day))] == [2, 1]
    assert {r[0]: r[4] for r in rows(listings.participants(t)) if r[4]} == {
        "12345678": "alumno en Derecho, alumno en Psicología, docente en Medicina",
        "23456789": "alumno en Derecho",
    }


def test_types_without_participations_stay_in_the_full_report(spark, seed):
    t = seed.with_tables(reserva_participante=frame(spark, [], PART))
    assert sorted(rows(report("reservas_por_tipo")(t, TODAY))) == [
        ("Alumno Grado", 4, 0, 0, 0, None), ("Alumno Posgrado", 2, 0, 0, 0, None), ("Docente", 2, 0, 0, 0, None),
    ]
    assert rows(report("reservas_por_tipo", "basic")(t, TODAY)) == []


def test_ties_are_cut_by_key(spark, seed):
    rooms = frame(spark, [(f"S{i:02d}", "Edificio Sur", 1, "libre") for i in range(15)],
                  "nombre_sala string, edificio string, capacidad int, tipo_sala string")
    t = seed.with_tables(sala=rooms)
    got = rows(report("salas_mas_reservadas")(t, TODAY))
    assert [r[0] for r in got] == [f"S{i:02d}" for i in range(reports.TOP)]


def test_own_bookings_are_cut_per_participant(spark, seed):
    many = bookings(spark, [(i, "Sala 101", "Edificio Central", TODAY + dt.timedelta(i), 1, "activa") for i in range(30)])
    people = frame(spark, [("12345678", i, NOW, None) for i in range(30)] + [("23456789", 3, NOW, None)], PART)
    t = seed.with_tables(reserva=many, reserva_participante=people)
    got = rows(listings.participant_bookings(t).select("ci_participante", "id_reserva", "orden"))
    assert sorted(r[1] for r in got if r[0] == "12345678") == list(range(10, 30))
    assert dict(rows(kpis.own_booking_counts(t)))["12345678"] == 20


def test_audit_finds_each_kind_of_violation(spark, seed):
    t = seed.with_tables(
        sala=frame(spark, [("X", "Edificio Sur", 0, "otra"), ("Y", "Nada", 3, "libre")],
                   "nombre_sala string, edificio string, capacidad int, tipo_sala string"),
        turno=frame(spark, [(1, "07:00:00", "06:00:00"), (1, "09:00:00", "10:00:00")],
                    "id_turno int, hora_inicio string, hora_fin string"),
        reserva=bookings(spark, [(1, "X", "Edificio Sur", TODAY, 1, "activa"), (2, "X", "Edificio Sur", TODAY, 1, None)]),
        reserva_participante=frame(spark, [("0", 9, NOW, None)], PART),
    )
    found = {tuple(r)[:3] for r in check_constraints(t, ["sala", "turno", "reserva", "reserva_participante"]).collect()}
    assert found == {
        ("sala", "check_capacidad_positiva", "X|Edificio Sur"), ("sala", "enum_tipo_sala", "X|Edificio Sur"),
        ("sala", "fk_edificio", "Nada"), ("turno", "pk", "1"), ("turno", "check_inicio_antes_de_fin", "1"),
        ("turno", "check_dentro_de_horario", "1"), ("reserva", "uk_reserva", f"X|Edificio Sur|{TODAY}|1"),
        ("reserva", "not_null_estado", "2"), ("reserva_participante", "fk_participante", "0"),
        ("reserva_participante", "fk_reserva", "9"),
    }
