"""Booking rules against plain loops over the same rows."""

from __future__ import annotations

import datetime as dt
import random

from aulario.operators import rules
from tests.conftest import TODAY, frame, rows

PERIOD = "id_solicitud int, ci_participante string, fecha_inicio date, fecha_fin date"
SANCTION = "id_sancion int, ci_participante string, fecha_inicio date, fecha_fin date"


def periods(rng, n, shortest):
    made = []
    for i in range(n):
        start = TODAY + dt.timedelta(rng.randrange(80))
        made.append((i, rng.choice("ab"), start, start + dt.timedelta(rng.randrange(shortest, 9))))
    return made


def touches(a, b, start, end):
    return (a <= start <= b) or (a <= end <= b) or (start <= a and b <= end)


def test_overlapping_sanctions(spark):
    rng = random.Random(3)
    state, asked = periods(rng, 12, 1), periods(rng, 150, -6)
    got = rules.overlaps_sanction(frame(spark, asked, PERIOD), frame(spark, state, SANCTION))
    expected = {i: any(c == k and touches(a, b, s, e) for _, k, a, b in state) for i, c, s, e in asked}
    assert dict(rows(got.select("id_solicitud", "solapada"))) == expected
    assert set(expected.values()) == {True, False}


def test_overlapping_sanctions_but_the_own(spark):
    rng = random.Random(5)
    state = periods(rng, 24, 1)
    moved = [(i, c, s + dt.timedelta(rng.randrange(-9, 9)), e + dt.timedelta(rng.randrange(-9, 9))) for i, c, s, e in state]
    got = rules.overlaps_sanction(
        frame(spark, moved, SANCTION), frame(spark, state, SANCTION), "id_sancion", own="id_sancion"
    )
    expected = {
        i: any(j != i and c == k and touches(a, b, s, e) for j, k, a, b in state) for i, c, s, e in moved
    }
    assert dict(rows(got.select("id_sancion", "solapada"))) == expected
    assert set(expected.values()) == {True, False}


def test_touching_days_overlap(spark):
    day = TODAY
    state = frame(spark, [(1, "a", day, day + dt.timedelta(5))], SANCTION)
    cases = [(0, -3, -1, False), (1, -3, 0, True), (2, 1, 2, True), (3, -2, 9, True), (4, 5, 8, True), (5, 6, 8, False),
             (6, 9, 3, True), (7, 9, 8, False)]
    asked = [(i, "a", day + dt.timedelta(s), day + dt.timedelta(e)) for i, s, e, _ in cases]
    got = rules.overlaps_sanction(frame(spark, asked, PERIOD), state)
    assert dict(rows(got.select("id_solicitud", "solapada"))) == {c[0]: c[3] for c in cases}
    order = rules.dates_in_order(frame(spark, asked, PERIOD))
    assert [r[0] for r in rows(order.filter("NOT fechas_en_orden").select("id_solicitud"))] == [6, 7]


REQUEST = "id_solicitud int, ci_participante string, nombre_sala string, edificio string, fecha date, id_turno int"


def test_request_rules(spark, seed):
    monday = TODAY - dt.timedelta(TODAY.weekday())
    asked = frame(spark, [
        (1, "12345678", "Sala 101", "Edificio Central", TODAY, 1),
        (2, "12345678", "Sala 201", "Edificio Central", TODAY, 2),
        (3, "34567890", "Sala 201", "Edificio Central", TODAY, 2),
        (4, "12345678", "Sala 999", "Edificio Central", TODAY, 2),
        (5, "99999999", "Sala 101", "Edificio Central", monday, 1),
    ], REQUEST)
    cancelled = seed.with_tables(reserva=seed.reserva.replace("activa", "cancelada", "estado"))
    assert dict(rows(rules.slot_free(asked, cancelled).select("id_solicitud", "turno_libre")))[1] is False
    allowed = dict(rows(rules.room_allowed(asked, seed).select("id_solicitud", "sala_permitida")))
    assert allowed == {1: True, 2: False, 3: True, 4: False, 5: True}
    for rule, flag in [(rules.within_daily_limit, "en_limite_dia"), (rules.within_weekly_limit, "en_limite_semana")]:
        assert set(rows(rule(asked, seed).select(flag))) == {(True,)}
    assert set(rows(rules.within_daily_limit(asked, cancelled).select("en_limite_dia"))) == {(True,)}
    judged = rules.evaluate_requests(asked, seed, TODAY).orderBy("id_solicitud")
    assert [r.turno_libre for r in judged.collect()] == [False, True, True, True, True]
    past = rules.not_in_past(asked, TODAY)
    assert [r.id_solicitud for r in past.filter("NOT no_pasada").collect()] == [5]


def test_quotas_count_active_bookings_only(spark, seed):
    day = TODAY
    data = [(i, "Sala 101", "Edificio Central", day + dt.timedelta(d), i % 15 + 1, state) for i, (d, state) in enumerate(
        [(0, "activa"), (0, "activa"), (1, "activa"), (2, "cancelada"), (7, "activa")])]
    t = seed.with_tables(
        reserva=frame(spark, data, "id_reserva int, nombre_sala string, edificio string, fecha date, id_turno int, estado string"),
        reserva_participante=frame(spark, [("12345678", i, None, None) for i in range(5)],
                                   "ci_participante string, id_reserva int, fecha_solicitud_reserva timestamp, asistencia boolean"),
    )
    asked = frame(spark, [(i, "12345678", "Sala 101", "Edificio Central", day + dt.timedelta(d), 9)
                          for i, d in enumerate([0, 1, 2, 7, 6])], REQUEST)
    daily = rules.within_daily_limit(asked, t).orderBy("id_solicitud")
    weekly = rules.within_weekly_limit(asked, t).orderBy("id_solicitud")
    assert [r.en_limite_dia for r in daily.collect()] == [False, True, True, True, True]
    assert [r.en_limite_semana for r in weekly.collect()] == [False, False, False, True, True]


def test_capacity(spark, seed):
    asked = frame(spark, [(1, "Sala 101", "Edificio Central", 4), (1, "Sala 101", "Edificio Central", 5),
                          (77, "Sala C1", "Edificio Sur", 12), (1, "Nada", "Edificio Sur", 1)],
                  "id_reserva int, nombre_sala string, edificio string, n int")
    from pyspark.sql import functions as F

    got = rules.fits_capacity(asked, seed, F.col("n")).select("id_reserva", "nombre_sala", "n", "cabe")
    assert {r[:3]: r[3] for r in rows(got)} == {
        (1, "Sala 101", 4): True, (1, "Sala 101", 5): False, (77, "Sala C1", 12): True, (1, "Nada", 1): False,
    }


def test_moves_and_deletions(spark, seed):
    moves = frame(spark, [(1, 1, "Sala 101", "Edificio Central", TODAY, 1), (2, 2, "Sala 101", "Edificio Central", TODAY, 1)],
                  "id_solicitud int, id_reserva int, nombre_sala string, edificio string, fecha date, id_turno int")
    got = rules.slot_free_for_move(moves, seed).select("id_solicitud", "turno_libre")
    assert dict(rows(got)) == {1: True, 2: False}
    everyone = seed.participante.select("ci")
    assert sorted(r[0] for r in rows(rules.without_active_bookings(seed, everyone))) == ["56789012", "67890123"]
    halls = seed.sala.select("nombre_sala", "edificio")
    later = TODAY + dt.timedelta(3)
    assert sorted(r[0] for r in rows(rules.deletable_rooms(seed, halls, later))) == [
        "Sala 301", "Sala A1", "Sala B1", "Sala C2",
    ]
    assert "Sala A1" not in {r[0] for r in rows(rules.deletable_rooms(seed, halls, TODAY))}


def test_form_data(spark, seed):
    raw = frame(spark, [(1, "2026-12-01", "3", "activa"), (2, "01/12/2026", "3", "otra"), (3, "2026-12-01", "tres", None),
                        (4, "", "3", "finalizada"), (5, "2026-2-9", " 4 ", "activa"), (6, "2026-02-30", "4", "activa"),
                        (7, "2026-012-05", "1.0", "activa")], "id_solicitud int, fecha string, id_turno string, estado string")
    got = rules.valid_status(rules.parse_requests(rules.complete(raw, ["fecha", "id_turno"]))).orderBy("id_solicitud")
    assert [(r.completa, r.datos_validos, r.estado_valido) for r in got.collect()] == [
        (True, True, True), (True, False, False), (True, False, False), (False, False, True), (True, True, True),
        (True, False, True), (True, False, True),
    ]
    assert [r.fecha for r in got.collect()][4] == dt.date(2026, 2, 9)
    asked = frame(spark, [(1, "12345678"), (2, "0")], "id_solicitud int, ci_participante string")
    found = rules.exists_in(asked, seed.participante, {"ci_participante": "ci"}, "existe")
    assert dict(rows(found.select("id_solicitud", "existe"))) == {1: True, 2: False}


def test_no_sanction(spark, seed):
    asked = frame(spark, [(1, "12345678"), (2, "23456789")], "id_solicitud int, ci_participante string")
    for days, expected in [(0, True), (30, False), (90, False), (91, True)]:
        got = rules.no_sanction(asked, seed, TODAY - dt.timedelta(days)).select("id_solicitud", "sin_sancion")
        assert dict(rows(got)) == {1: expected, 2: True}
