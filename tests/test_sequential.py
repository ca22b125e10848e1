"""Batch operators against one-at-a-time processing of the same requests."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from aulario.operators import booking_changes
from aulario.operators.booking_changes import (
    add_participants,
    admit_bookings,
    remove_participants,
)
from aulario.operators.constraints import check_constraints
from aulario.operators.people_changes import register_participants
from aulario.operators.sanction_changes import create_sanctions
from aulario.sources.readers import FOLDING_COLLATION
from tests.conftest import TODAY, frame, rows

T0 = dt.datetime(2026, 12, 1, 8)
REQUEST = (
    "id_solicitud int, ci_participante string, nombre_sala string, edificio string, "
    "fecha date, id_turno int, solicitada_en timestamp"
)


def outcomes(result) -> dict[int, str | None]:
    return {r.id_solicitud: r.motivo for r in result.outcomes().collect()}


def booking_batch(rng: random.Random, n: int, hot: bool) -> list[tuple]:
    people = ["12345678", "23456789", "45678901", "89012345", "34567890", "56789012"]
    halls = [("Sala 101", "Edificio Central"), ("Sala A1", "Edificio Norte"), ("Sala 201", "Edificio Central"),
             ("Sala 301", "Edificio Central"), ("Sala 999", "Edificio Sur")]
    batch = []
    for i in range(n):
        room = halls[0] if hot and rng.random() < 0.5 else rng.choice(halls)
        ci = people[0] if hot and rng.random() < 0.4 else rng.choice(people)
        date = TODAY + dt.timedelta(rng.randrange(3 if hot else 6))
        batch.append((i, ci, *room, date, rng.randrange(1, 4), T0 + dt.timedelta(minutes=rng.randrange(n))))
    return batch


def one_at_a_time(batch, seed) -> dict[int, str | None]:
    halls = {(r.nombre_sala, r.edificio): r.tipo_sala for r in seed.sala.collect()}
    taken = {(r.nombre_sala, r.edificio, r.fecha, r.id_turno) for r in seed.reserva.collect()}
    active = {r.id_reserva: r.fecha for r in seed.reserva.collect() if r.estado == "activa"}
    booked = [
        (r.ci_participante, active[r.id_reserva])
        for r in seed.reserva_participante.collect()
        if r.id_reserva in active
    ]
    special = {"34567890", "56789012", "67890123", "78901234"}
    result = {}
    for i, ci, room, building, date, slot, _ in sorted(batch, key=lambda b: (b[6], b[0])):
        kind = halls.get((room, building))
        monday = date - dt.timedelta(date.weekday())
        same_day = sum(1 for c, d in booked if c == ci and d == date)
        same_week = sum(1 for c, d in booked if c == ci and d - dt.timedelta(d.weekday()) == monday)
        if kind is None or (kind != "libre" and ci not in special):
            result[i] = "sala_no_permitida"
        elif ci not in special and same_day >= 2:
            result[i] = "limite_dia"
        elif ci not in special and same_week >= 3:
            result[i] = "limite_semana"
        elif (room, building, date, slot) in taken:
            result[i] = "turno_ocupado"
        else:
            result[i] = None
            taken.add((room, building, date, slot))
            booked.append((ci, date))
    return result


@pytest.mark.parametrize("number,n,hot", [(1, 40, False), (2, 60, True), (3, 60, True)])
def test_admit_bookings(spark, seed, number, n, hot):
    batch = booking_batch(random.Random(number), n, hot)
    result = admit_bookings(frame(spark, batch, REQUEST), seed, TODAY)
    expected = one_at_a_time(batch, seed)
    assert outcomes(result) == expected
    granted = [i for i, why in expected.items() if why is None]
    new = result.tables.reserva.filter("id_reserva > 6").orderBy("id_reserva").collect()
    by_id = {b[0]: b for b in batch}
    in_order = sorted(granted, key=lambda i: (by_id[i][6], i))
    assert [(r.id_reserva, r.nombre_sala, r.fecha, r.id_turno, r.estado) for r in new] == [
        (7 + k, by_id[i][2], by_id[i][4], by_id[i][5], "activa") for k, i in enumerate(in_order)
    ]
    joined = result.tables.reserva_participante.filter("id_reserva > 6").orderBy("id_reserva")
    assert [r.ci_participante for r in joined.collect()] == [by_id[i][1] for i in in_order]


def test_sanctioned_and_incomplete_requests(spark, seed):
    day = TODAY - dt.timedelta(30)
    batch = [
        (1, "12345678", "Sala 102", "Edificio Central", day, 1, T0),
        (2, "23456789", "Sala 102", "Edificio Central", day, 1, T0),
        (3, "23456789", "Sala 102", "Edificio Central", None, 1, T0),
        (4, "23456789", "Sala 102", "Edificio Central", day - dt.timedelta(1), 2, T0),
    ]
    result = admit_bookings(frame(spark, batch, REQUEST), seed, day, not_before=day)
    assert outcomes(result) == {1: "sancion_activa", 2: None, 3: "datos_invalidos", 4: "datos_invalidos"}


def test_second_request_wins_when_first_is_over_quota(spark, seed):
    week = TODAY + dt.timedelta(7)
    batch = [
        (1, "23456789", "Sala 101", "Edificio Central", week, 1, T0),
        (2, "23456789", "Sala 101", "Edificio Central", week, 2, T0),
        (3, "23456789", "Sala 101", "Edificio Central", week, 3, T0),
        (4, "45678901", "Sala 101", "Edificio Central", week, 3, T0),
    ]
    result = admit_bookings(frame(spark, batch, REQUEST), seed, TODAY)
    assert outcomes(result) == {1: None, 2: None, 3: "limite_dia", 4: None}


PERSON_REQUEST = "id_solicitud int, id_reserva int, ci_participante string, solicitada_en timestamp"
PEOPLE = ["12345678", "23456789", "34567890", "45678901", "56789012", "67890123", "78901234", "89012345"]


def people_batch(rng: random.Random, n: int) -> list[tuple]:
    return [
        (i, rng.choice([1, 3, 3, 3, 4, 99]), rng.choice([*PEOPLE, "00000000"]),
         T0 + dt.timedelta(minutes=rng.randrange(n)))
        for i in range(n)
    ]


@pytest.mark.parametrize("number", [1, 2])
def test_add_participants(spark, seed, number):
    batch = people_batch(random.Random(number), 40)
    capacity = {1: 6, 2: 8, 3: 4, 4: 6, 5: 8, 6: 12}
    inside = {k: set() for k in capacity}
    for r in seed.reserva_participante.collect():
        inside[r.id_reserva].add(r.ci_participante)
    expected = {}
    for i, booking, ci, _ in sorted(batch, key=lambda b: (b[3], b[0])):
        if booking not in capacity:
            expected[i] = "reserva_inexistente"
        elif len(inside[booking]) >= capacity[booking]:
            expected[i] = "capacidad"
        elif ci not in PEOPLE:
            expected[i] = "participante_inexistente"
        elif ci in inside[booking]:
            expected[i] = "repetido"
        else:
            expected[i] = None
            inside[booking].add(ci)
    result = add_participants(frame(spark, batch, PERSON_REQUEST), seed)
    assert outcomes(result) == expected
    after = {}
    for r in result.tables.reserva_participante.collect():
        after.setdefault(r.id_reserva, set()).add(r.ci_participante)
    assert after == inside
    free = add_participants(frame(spark, batch, PERSON_REQUEST), seed, enforce=False)
    assert "capacidad" not in set(outcomes(free).values())


@pytest.mark.parametrize("number", [1, 2])
def test_remove_participants(spark, seed, number):
    rng = random.Random(number)
    inside = {}
    for r in seed.reserva_participante.collect():
        inside.setdefault(r.id_reserva, set()).add(r.ci_participante)
    batch = [
        (i, b, rng.choice(sorted(inside.get(b, set())) + ["00000000"]), T0 + dt.timedelta(minutes=rng.randrange(30)))
        for i, b in enumerate(rng.choice([1, 2, 4, 4, 99]) for _ in range(14))
    ]
    expected = {}
    for i, booking, ci, _ in sorted(batch, key=lambda b: (b[3], b[0])):
        if len(inside.get(booking, ())) <= 1:
            expected[i] = "ultimo_participante"
        elif ci not in inside[booking]:
            expected[i] = "no_participa"
        else:
            expected[i] = None
            inside[booking].discard(ci)
    result = remove_participants(frame(spark, batch, PERSON_REQUEST), seed)
    assert outcomes(result) == expected
    after = {}
    for r in result.tables.reserva_participante.collect():
        after.setdefault(r.id_reserva, set()).add(r.ci_participante)
    assert after == inside


def test_removals_are_judged_when_verdicts_are_asked_for(spark, seed, monkeypatch):
    judged = []
    whole = booking_changes.split
    monkeypatch.setattr(booking_changes, "split", lambda *a: judged.append(a) or whole(*a))
    inside = sorted((r.id_reserva, r.ci_participante) for r in seed.reserva_participante.collect())
    batch = [(i, b, ci, T0) for i, (b, ci) in enumerate([*inside, *inside, (99, "00000000")])]
    result = remove_participants(frame(spark, batch, PERSON_REQUEST), seed)
    left = sorted((r.id_reserva, r.ci_participante) for r in result.tables.reserva_participante.collect())
    gone = sorted((r.id_reserva, r.ci_participante) for r in result.touched["reserva_participante"].collect())
    assert sorted(left + gone) == inside and len(left) == len({b for b, _ in inside}) and not judged
    assert sorted((r.id_reserva, r.ci_participante) for r in result.accepted.collect()) == gone
    assert len(outcomes(result)) == len(batch) and len(judged) == 1


SANCTION_REQUEST = (
    "id_solicitud int, ci_participante string, fecha_inicio date, fecha_fin date, solicitada_en timestamp"
)


def touches(a, b, start, end) -> bool:
    return (a <= start <= b) or (a <= end <= b) or (start <= a and b <= end)


@pytest.mark.parametrize("number,n", [(1, 60), (2, 120)])
def test_create_sanctions(spark, seed, number, n):
    rng = random.Random(number)
    batch = []
    for i in range(n):
        start = TODAY - dt.timedelta(rng.randrange(-60, 110))
        batch.append((i, rng.choice(["12345678", "12345678", "23456789", "00000000"]), start,
                      start + dt.timedelta(rng.randrange(-4, 16)), T0 + dt.timedelta(minutes=rng.randrange(n))))
    periods = {ci: [] for ci in PEOPLE}
    for r in seed.sancion_participante.collect():
        periods[r.ci_participante].append((r.fecha_inicio, r.fecha_fin))
    expected = {}
    for i, ci, start, end, _ in sorted(batch, key=lambda b: (b[4], b[0])):
        if ci not in periods:
            expected[i] = "participante_inexistente"
        elif any(touches(a, b, start, end) for a, b in periods[ci]):
            expected[i] = "periodo_solapado"
        elif end <= start:
            expected[i] = "fechas_invalidas"
        else:
            expected[i] = None
            periods[ci].append((start, end))
    result = create_sanctions(frame(spark, batch, SANCTION_REQUEST), seed)
    assert outcomes(result) == expected
    after = {ci: [] for ci in PEOPLE}
    for r in result.tables.sancion_participante.collect():
        after[r.ci_participante].append((r.fecha_inicio, r.fecha_fin))
    assert {k: sorted(v) for k, v in after.items()} == {k: sorted(v) for k, v in periods.items()}


def test_register_participants(spark, seed):
    rng = random.Random(7)
    batch = [
        (i, f"c{rng.randrange(8)}", "N", "A", f"e{rng.randrange(8)}@x", "Derecho", "estudiante",
         T0 + dt.timedelta(minutes=rng.randrange(40)))
        for i in range(40)
    ]
    batch += [(90, "12345678", "N", "A", "new@x", "Derecho", "alumno", T0),
              (91, "n1", "N", "A", "ana.martinez@uni.edu", "Derecho", "alumno", T0),
              (92, "n2", "N", "", "n2@x", "Derecho", "alumno", T0),
              (93, "n3", "N", "A", "n3@x", "Otro", "alumno", T0),
              (94, "n4", "N", "A", "n4@x", "Derecho", "jefe", T0)]
    numbers, mails, expected = set(), set(), {}
    for i, ci, _, _, mail, *_ in sorted(batch[:40], key=lambda b: (b[7], b[0])):
        if ci in numbers or mail in mails:
            expected[i] = "ya_registrado"
        else:
            expected[i] = None
            numbers.add(ci)
            mails.add(mail)
    expected |= {90: "ya_registrado", 91: "ya_registrado", 92: "datos_incompletos",
                 93: "programa_inexistente", 94: "rol_invalido"}
    schema = (
        "id_solicitud int, ci string, nombre string, apellido string, email string, "
        "nombre_programa string, rol string, solicitada_en timestamp"
    )
    result = register_participants(frame(spark, batch, schema), seed)
    assert outcomes(result) == expected
    assert result.tables.participante.count() == 8 + len(numbers)
    enrolled = rows(result.tables.participante_programa_academico.filter("id_alumno_programa > 8"))
    assert sorted(r[0] for r in enrolled) == list(range(9, 9 + len(numbers)))
    assert {r[3] for r in enrolled} == {"alumno"}


def test_folding_collation_and_missing_times_do_not_depend_on_the_number_of_requests(spark, seed):
    """Emails that differ in case only are one email; a request without a time is taken first."""
    fold = lambda c: F.collate(F.col(c), FOLDING_COLLATION).alias(c)
    people = [(1, "1", "a@x"), (2, "1", "b@x"), (3, "2", "B@x"), (4, "3", "b@x")]
    rows_ = [(i, ci, "N", "A", mail, "Derecho", "alumno", T0 + dt.timedelta(minutes=i)) for i, ci, mail in people]
    schema = (
        "id_solicitud long, ci string, nombre string, apellido string, email string, nombre_programa string,"
        " rol string, solicitada_en timestamp"
    )
    asked = frame(spark, rows_, schema)
    asked = asked.select(*[fold(c) if c == "email" else F.col(c) for c in asked.columns])
    state = seed.with_tables(participante=seed.participante.select("ci", "nombre", "apellido", fold("email")))
    assert outcomes(register_participants(asked, state)) == {
        1: None, 2: "ya_registrado", 3: None, 4: "ya_registrado",
    }
    slot = ("Sala 301", "Edificio Central", dt.date(2027, 3, 1), 9)
    batch = [(10, "56789012", *slot, T0), (11, "34567890", *slot, None)]
    assert outcomes(admit_bookings(frame(spark, batch, REQUEST), seed, TODAY)) == {10: "turno_ocupado", 11: None}


def test_unknown_participants_and_slots_are_refused(spark, seed):
    slot = ("Sala 301", "Edificio Central", dt.date(2027, 3, 1))
    batch = [
        (1, "00000000", *slot, 9, T0), (2, "34567890", *slot, 99, T0), (3, "34567890", *slot, 9, T0),
    ]
    result = admit_bookings(frame(spark, batch, REQUEST), seed, TODAY)
    assert outcomes(result) == {1: "participante_inexistente", 2: "turno_inexistente", 3: None}
    before, after = (rows(check_constraints(t)) for t in (seed, result.tables))
    assert sorted(before) == sorted(after)
