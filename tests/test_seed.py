"""Expected results over the sample data, derived by hand."""

from __future__ import annotations

import datetime as dt

import pytest

from aulario.operators import kpis, listings, rules
from aulario.operators.constraints import check_constraints
from aulario.plans.registry import REPORTS, catalog, register_views, report
from tests.conftest import TODAY, rows


def run(seed, name, variant="full"):
    return rows(report(name, variant)(seed, TODAY))


def test_most_booked_rooms(seed):
    got = run(seed, "salas_mas_reservadas")
    assert [(r[0], r[4]) for r in got] == [
        ("Sala 101", 1), ("Sala 102", 1), ("Sala 201", 1), ("Sala A1", 1), ("Sala A2", 1),
        ("Sala C1", 1), ("Sala 301", 0), ("Sala B1", 0), ("Sala C2", 0),
    ]


def test_slots(seed):
    got = run(seed, "turnos_demandados")
    assert len(got) == 15
    assert got[0] == (1, "08:00:00 - 09:00:00", 1)
    assert [r[2] for r in got] == [1] * 6 + [0] * 9


def test_mean_participants(seed):
    got = {r[0]: r[3:] for r in run(seed, "promedio_participantes")}
    assert got == {
        "Sala 101": (2.0, 33.33), "Sala 102": (1.0, 12.5), "Sala 201": (1.0, 25.0),
        "Sala A1": (2.0, 33.33), "Sala A2": (1.0, 12.5), "Sala C1": (1.0, 8.33),
        "Sala 301": (0.0, 0.0), "Sala B1": (0.0, 0.0), "Sala C2": (0.0, 0.0),
    }
    basic = {r[0]: r[2] for r in run(seed, "promedio_participantes", "basic")}
    assert basic["Sala 301"] is None and basic["Sala 101"] == 2.0


def test_programmes(seed):
    got = run(seed, "reservas_por_carrera")
    assert len(got) == 7
    assert {r[1]: r[3] for r in got if r[3] != 1} == {"Ingeniería en Sistemas": 2}


def test_occupancy(seed):
    assert run(seed, "ocupacion_edificio") == [
        ("Edificio Central", 4, 3, 0.17), ("Edificio Norte", 3, 2, 0.15), ("Edificio Sur", 2, 1, 0.11),
    ]


def test_user_types(seed):
    assert {r[0]: r[1:] for r in run(seed, "reservas_por_tipo")} == {
        "Alumno Grado": (4, 3, 0, 0, 0.0),
        "Docente": (2, 2, 1, 0, 50.0),
        "Alumno Posgrado": (2, 2, 1, 0, 50.0),
    }
    assert run(seed, "sanciones_por_tipo") == [("Alumno Grado", 1, 1, 0, 60)]


def test_outcomes_and_weeks(seed):
    assert run(seed, "efectividad") == [("activa", 5, 83.33), ("finalizada", 1, 16.67)]
    assert run(seed, "horas_semana") == [
        (202649, 2026, 49, dt.date(2026, 11, 30), 6, 5, 1, 0)
    ]


def test_sanctioned(seed):
    assert run(seed, "participantes_sancionados") == [
        ("12345678", "Juan", "Pérez", "juan.perez@uni.edu", 1, 0, dt.date(2026, 11, 1), "alumno")
    ]


def test_cancellations(seed):
    assert run(seed, "edificios_cancelaciones") == [
        ("Edificio Central", "Av. Principal 1234", 3, 0, 0, 0.0, 0.0),
        ("Edificio Norte", "Calle Norte 567", 2, 0, 0, 0.0, 0.0),
        ("Edificio Sur", "Calle Sur 890", 1, 0, 0, 0.0, 0.0),
    ]


def test_basic_variants_agree_on_shared_measures(seed):
    for name in REPORTS:
        full, basic = report(name)(seed, TODAY), report(name, "basic")(seed, TODAY)
        shared = [c for c in basic.columns if c in full.columns and c != "tipo_usuario"]
        if name == "promedio_participantes":
            basic = basic.fillna(0.0)
        assert sorted(rows(full.select(*shared))) == sorted(rows(basic.select(*shared))), name


def test_catalog(spark, seed):
    assert catalog(spark).count() == 11
    for view in register_views(seed, TODAY):
        spark.table(view).schema
    assert spark.sql("SELECT count(*) FROM v_efectividad_reservas").first()[0] == 2
    with pytest.raises(ValueError):
        report("otro")
    with pytest.raises(ValueError):
        report("efectividad", "otra")


def test_listings(seed):
    got = rows(listings.latest_bookings(seed))
    assert [r[0] for r in got] == [6, 5, 4, 3, 2, 1]
    assert [r[9] for r in got] == [1, 1, 2, 1, 1, 2]
    assert len(rows(listings.latest_bookings(seed, 2))) == 2
    assert rows(listings.bookings_detailed(seed, 4).select("capacidad", "tipo_sala", "estado_texto")) == [
        (6, "libre", "FINALIZADA")
    ]
    assert len(rows(listings.bookings_detailed(seed))) == 6
    assert [r[0] for r in rows(listings.slots(seed))] == list(range(1, 16))
    assert len(rows(listings.rooms(seed))) == 9
    assert rows(listings.rooms(seed, "Sala A1", "Edificio Norte")) == [
        ("Sala A1", "Edificio Norte", 6, "libre", "Calle Norte 567", "Sala A1 (Edificio Norte)", "Libre")
    ]
    assert [r[0] for r in rows(listings.buildings(seed))] == [
        "Edificio Central", "Edificio Norte", "Edificio Sur",
    ]
    assert rows(listings.programmes(seed))[0][0] == "Derecho"


def test_nested_participants(seed):
    got = rows(listings.bookings_with_participants(seed).select("id_reserva", "participantes"))
    assert {booking: [p.ci_participante for p in inside] for booking, inside in got} == {
        1: ["12345678", "23456789"], 2: ["34567890"], 3: ["45678901"],
        4: ["56789012", "67890123"], 5: ["78901234"], 6: ["89012345"],
    }
    (one,) = listings.bookings_with_participants(seed, 4).collect()
    assert [p.asistencia for p in one.participantes] == [True, True]


def test_people(seed):
    got = rows(listings.participants(seed))
    assert [r[2] for r in got] == [
        "Fernández", "García", "Gómez", "López", "Martínez", "Pérez", "Rodríguez", "Sánchez",
    ]
    assert got[0][4] == "docente en Ingeniería en Sistemas"
    assert got[0][5] == "Luis Fernández"
    one = listings.participants_with_programmes(seed, ci="12345678").first()
    assert [(p.nombre_programa, p.rol) for p in one.programas] == [("Ingeniería en Sistemas", "alumno")]
    assert listings.participants_with_programmes(seed, email="ana.martinez@uni.edu").first().ci == "45678901"
    assert listings.participant_by_email(seed, "ana.martinez@uni.edu").first().ci == "45678901"
    assert sorted(r[0] for r in rows(listings.teachers(seed))) == ["56789012", "78901234"]
    outside = rows(listings.participants_outside_booking(seed, 4))
    assert sorted(r[0] for r in outside) == [
        "12345678", "23456789", "34567890", "45678901", "78901234", "89012345",
    ]
    assert dict(rows(listings.available_participants(seed))) == {1: 6, 2: 7, 3: 7, 4: 6, 5: 7, 6: 7}
    own = rows(listings.participant_bookings(seed, "12345678").select("id_reserva", "horario"))
    assert own == [(1, "08:00:00 - 09:00:00")]


def test_memberships(spark, seed):
    asked = spark.createDataFrame([(4, "56789012"), (4, "12345678")], "id_reserva int, ci_participante string")
    assert rows(listings.memberships(seed, asked)) == [(4, "56789012")]


def test_sanction_listings(seed):
    assert rows(listings.sanctions(seed, TODAY).select("estado", "duracion_dias")) == [("FINALIZADA", 60)]
    assert listings.sanction(seed, TODAY, 1).columns[-1] == "estado"
    start, end = TODAY - dt.timedelta(90), TODAY - dt.timedelta(30)
    for day, state in [(start, "ACTIVA"), (end, "ACTIVA"), (end + dt.timedelta(1), "FINALIZADA"),
                       (start - dt.timedelta(1), "FUTURA")]:
        assert listings.participant_sanctions(seed, day, "12345678").first().estado == state
    assert listings.sanctions_in_force(seed, TODAY).isEmpty()
    assert listings.sanctions_in_force(seed, end, "12345678").first().id_sancion == 1


def test_key_figures(seed):
    assert rows(kpis.dashboard(seed, TODAY)) == [(8, 9, 5, 0)]
    assert {r[0]: r[2:] for r in rows(kpis.room_statistics(seed))}["Sala 101"] == (1, 1, 0.0)
    assert rows(kpis.sanction_statistics(seed, TODAY)) == [(0, 1, 0, 60.0)]
    none = seed.with_tables(sancion_participante=seed.sancion_participante.limit(0))
    assert rows(kpis.sanction_statistics(none, TODAY)) == [(0, 0, 0, 0.0)]
    tiles = {"activa": 5, "finalizada": 1}
    assert dict(rows(kpis.status_tiles(seed))) == dict(rows(kpis.status_tiles(seed, "all"))) == tiles
    assert dict(rows(kpis.sanction_tiles(seed, TODAY))) == {"FINALIZADA": 1}
    assert {r[0]: r[3] for r in rows(kpis.seats_left(seed))} == {1: 4, 2: 7, 3: 3, 4: 4, 5: 7, 6: 11}
    assert {r[2] for r in rows(kpis.cancellation_severity(seed, TODAY))} == {"success"}
    assert set(rows(kpis.own_booking_counts(seed).select("reservas"))) == {(1,)}


def test_privileged(seed):
    assert sorted(r[0] for r in rows(rules.privileged(seed).filter("privilegiado"))) == [
        "34567890", "56789012", "67890123", "78901234",
    ]


def test_seed_is_sound(seed):
    assert rows(check_constraints(seed)) == []
