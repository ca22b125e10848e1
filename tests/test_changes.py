"""State after the change operators that need no sequencing."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from aulario.operators import booking_changes as bc
from aulario.operators import listings
from aulario.operators import people_changes as pc
from aulario.operators import room_changes as rc
from aulario.operators import sanction_changes as sc
from aulario.plans.registry import report
from aulario.sources.readers import load_tables
from aulario.sources.writers import write_snapshot
from tests.conftest import TODAY, frame, rows
from tests.test_sequential import REQUEST, T0, outcomes


def requests(spark, data, fields):
    """Rows with a number and one minute between them."""
    numbered = [(i, *row, T0 + dt.timedelta(minutes=i)) for i, row in enumerate(data)]
    return frame(spark, numbered, f"id_solicitud int, {fields}, solicitada_en timestamp")


def test_move_bookings(spark, seed):
    moves = requests(spark, [
        (1, "Sala 102", "Edificio Central", TODAY, 2),  # held by booking 2
        (1, "Sala 301", "Edificio Central", TODAY, 9),
        (2, "Sala 301", "Edificio Central", TODAY, 9),  # just taken
        (1, "Sala 301", "Edificio Central", TODAY, 10),  # second move of the booking
        (99, "Sala 301", "Edificio Central", TODAY, 11),
        (3, "Nada", "Edificio Sur", TODAY, 1),
        (4, "Sala A1", "Edificio Norte", TODAY, 4),  # stays where it is
    ], "id_reserva int, nombre_sala string, edificio string, fecha date, id_turno int")
    result = bc.move_bookings(moves, seed)
    assert outcomes(result) == {
        0: "turno_ocupado", 1: None, 2: "turno_ocupado", 3: "repetida", 4: "reserva_inexistente",
        5: "sala_inexistente", 6: None,
    }
    moved = {r.id_reserva: (r.nombre_sala, r.id_turno, r.estado) for r in result.tables.reserva.collect()}
    assert moved[1] == ("Sala 301", 9, "activa") and moved[2] == ("Sala 102", 2, "activa") and len(moved) == 6


def test_status(spark, seed):
    changes = requests(spark, [(1, "finalizada"), (1, "sin asistencia"), (1, "otra"), (9, "activa")],
                       "id_reserva int, estado string")
    result = bc.set_status(changes, seed)
    assert outcomes(result) == {0: None, 1: None, 2: "estado_invalido", 3: "reserva_inexistente"}
    assert {r.id_reserva: r.estado for r in result.tables.reserva.collect()}[1] == "sin asistencia"
    own = requests(spark, [(1, "12345678"), (2, "12345678")], "id_reserva int, ci_participante string")
    result = bc.cancel_bookings(own, seed, own_only=True)
    assert outcomes(result) == {0: None, 1: "reserva_ajena"}
    assert [r.id_reserva for r in result.tables.reserva.filter("estado = 'cancelada'").collect()] == [1]


def test_purge(spark, seed):
    t = bc.cancel_bookings(requests(spark, [(1,), (2,)], "id_reserva int"), seed).tables
    result = bc.purge_bookings(requests(spark, [(1,), (3,), (9,)], "id_reserva int"), t)
    assert outcomes(result) == {0: None, 1: "estado_no_permitido", 2: "reserva_inexistente"}
    assert result.tables.reserva.count() == 5 and result.tables.reserva_participante.count() == 6
    everything = bc.purge_all_bookings(t)
    assert everything.reserva.count() == 4 and everything.reserva_participante.count() == 5


def test_attendance(spark, seed):
    marks = requests(spark, [(1, "12345678", True), (1, "12345678", False), (1, "34567890", True), (4, "56789012", None)],
                     "id_reserva int, ci_participante string, asistio boolean")
    result = bc.mark_attendance(marks, seed)
    assert outcomes(result) == {0: None, 1: None, 2: "no_participa", 3: "datos_invalidos"}
    after = {(r.id_reserva, r.ci_participante): r.asistencia for r in result.tables.reserva_participante.collect()}
    assert after[1, "12345678"] is False and after[1, "23456789"] is None and after[4, "56789012"] is True


def test_unchecked_removal(spark, seed):
    asked = requests(spark, [(1, "12345678"), (1, "23456789"), (1, "00000000")], "id_reserva int, ci_participante string")
    result = bc.remove_participants(asked, seed, enforce=False)
    assert outcomes(result) == {0: None, 1: None, 2: "no_participa"}


def test_sanction_dates(spark, seed):
    d = dt.timedelta
    state = [(1, "12345678", TODAY - d(5), TODAY + d(5)), (2, "12345678", TODAY + d(10), TODAY + d(20)),
             (3, "23456789", TODAY, TODAY + d(7))]
    t = seed.with_tables(sancion_participante=frame(
        spark, state, "id_sancion int, ci_participante string, fecha_inicio date, fecha_fin date"))
    changes = requests(spark, [
        (1, TODAY - d(5), TODAY + d(8)), (1, TODAY - d(5), TODAY + d(9)), (2, TODAY + d(5), TODAY + d(15)),
        (3, TODAY, TODAY), (9, TODAY, TODAY + d(1)),
    ], "id_sancion int, fecha_inicio date, fecha_fin date")
    result = sc.update_sanctions(changes, t)
    assert outcomes(result) == {0: "reemplazada", 1: None, 2: "periodo_solapado", 3: "fechas_invalidas", 4: "sancion_inexistente"}
    assert {r.id_sancion: r.fecha_fin for r in result.tables.sancion_participante.collect()} == {
        1: TODAY + d(9), 2: TODAY + d(20), 3: TODAY + d(7),
    }
    shifts = requests(spark, [(1, 4), (2, -10), (3, 30), (1, 5)], "id_sancion int, dias int")
    assert outcomes(sc.shift_sanctions(shifts, t)) == {0: None, 1: "fechas_invalidas", 2: None, 3: "periodo_solapado"}
    asked = requests(spark, [(1,), (1,), (2,), (3,), (9,)], "id_sancion int")
    result = sc.finish_sanctions(asked, t, TODAY)
    assert outcomes(result) == {0: None, 1: "ya_finalizada", 2: "sin_comenzar", 3: "sin_comenzar", 4: "sancion_inexistente"}
    assert {r.id_sancion: r.fecha_fin for r in result.tables.sancion_participante.collect()}[1] == TODAY
    result = sc.delete_sanctions(asked, t)
    assert outcomes(result) == {0: None, 1: "sancion_inexistente", 2: None, 3: None, 4: "sancion_inexistente"}
    assert result.tables.sancion_participante.count() == 0


def test_default_sanctions(spark, seed):
    asked = requests(spark, [("12345678",), ("12345678",), ("0",)], "ci_participante string")
    result = sc.create_sanctions(sc.default_sanctions(asked, TODAY), seed)
    assert outcomes(result) == {0: None, 1: "periodo_solapado", 2: "participante_inexistente"}
    new = result.tables.sancion_participante.filter("id_sancion = 2").first()
    assert (new.fecha_inicio, new.fecha_fin) == (TODAY, TODAY + dt.timedelta(7))


def test_participants(spark, seed):
    changes = requests(spark, [
        ("12345678", "J", "P", "nuevo@x"), ("23456789", "M", "G", "ana.martinez@uni.edu"),
        ("34567890", "C", "R", "nuevo@x"), ("0", "Z", "Z", "z@x"), ("45678901", "A", "M", "ana.martinez@uni.edu"),
        ("45678901", "Ana", "M", "ana.martinez@uni.edu"),
    ], "ci string, nombre string, apellido string, email string")
    result = pc.update_participants(changes, seed)
    assert outcomes(result) == {
        0: None, 1: "email_registrado", 2: "email_registrado", 3: "participante_inexistente", 4: "reemplazada", 5: None,
    }
    after = {r.ci: (r.nombre, r.email) for r in result.tables.participante.collect()}
    assert after["12345678"] == ("J", "nuevo@x") and after["45678901"][0] == "Ana" and len(after) == 8


def test_participant_deletion_cascades(spark, seed):
    asked = requests(spark, [("56789012",), ("12345678",), ("0",), ("56789012",)], "ci string")
    result = pc.delete_participants(asked, seed)
    assert outcomes(result) == {
        0: None, 1: "con_reservas_activas", 2: "participante_inexistente", 3: "participante_inexistente",
    }
    t = result.tables
    assert [t.participante.count(), t.reserva_participante.count(), t.participante_programa_academico.count()] == [7, 7, 7]


def test_enrolments(spark, seed):
    asked = requests(spark, [
        ("12345678", "Derecho", "estudiante"), ("12345678", "Derecho", "alumno"), ("12345678", "Otro", "alumno"),
        ("0", "Derecho", "alumno"), ("12345678", "Medicina", "jefe"), ("12345678", "", "alumno"),
        ("12345678", "Ingeniería en Sistemas", "alumno"), ("23456789", "Medicina", "docente"),
    ], "ci_participante string, nombre_programa string, rol string")
    result = pc.add_enrolments(asked, seed)
    assert outcomes(result) == {
        0: None, 1: "ya_inscripto", 2: "programa_inexistente", 3: "participante_inexistente", 4: "rol_invalido",
        5: "datos_incompletos", 6: "ya_inscripto", 7: None,
    }
    new = rows(result.tables.participante_programa_academico.filter("id_alumno_programa > 8").orderBy("id_alumno_programa"))
    assert new == [(9, "12345678", "Derecho", "alumno"), (10, "23456789", "Medicina", "docente")]
    gone = pc.remove_enrolments(asked.filter("id_solicitud IN (0, 6)"), seed)
    assert outcomes(gone) == {0: "no_inscripto", 6: None}
    assert gone.tables.participante_programa_academico.count() == 7


def test_rooms(spark, seed):
    asked = requests(spark, [
        ("Nueva", "Edificio Sur", 3, "libre"), ("Nueva", "Edificio Sur", 4, "libre"), ("Sala 101", "Edificio Central", 4, "libre"),
        ("Sala 101", "Edificio Sur", 4, "libre"), ("Otra", "Nada", 4, "libre"), ("Otra", "Edificio Sur", 0, "libre"),
        ("Otra", "Edificio Sur", 1, "aula"),
    ], "nombre_sala string, edificio string, capacidad int, tipo_sala string")
    result = rc.create_rooms(asked, seed)
    assert outcomes(result) == {
        0: None, 1: "sala_duplicada", 2: "sala_duplicada", 3: None, 4: "edificio_inexistente", 5: "datos_invalidos",
        6: "datos_invalidos",
    }
    assert result.tables.sala.count() == 11


def test_room_updates(spark, seed):
    changes = requests(spark, [
        ("Sala 101", "Edificio Central", "Sala 101", "Edificio Central", 7, "docente"),  # booked, same name
        ("Sala 102", "Edificio Central", "Sala 109", "Edificio Central", 7, "docente"),  # booked, new name
        ("Sala 301", "Edificio Central", "Sala B1", "Edificio Norte", 7, "docente"),  # name in use
        ("Sala 301", "Edificio Central", "Sala 400", "Edificio Norte", 7, "libre"),
        ("Sala 301", "Edificio Central", "Sala 500", "Edificio Norte", 7, "libre"),
        ("Sala B1", "Edificio Norte", "Sala 400", "Edificio Norte", 7, "libre"),  # just taken
        ("Nada", "Edificio Norte", "Sala 600", "Edificio Norte", 7, "libre"),
        ("Sala C2", "Edificio Sur", "Sala C2", "Nada", 7, "libre"),
    ], "nombre_sala string, edificio string, nuevo_nombre_sala string, nuevo_edificio string, capacidad int, tipo_sala string")
    result = rc.update_rooms(changes, seed, TODAY)
    assert outcomes(result) == {
        0: None, 1: "con_reservas", 2: "sala_duplicada", 3: None, 4: "repetida", 5: "sala_duplicada",
        6: "sala_inexistente", 7: "edificio_inexistente",
    }
    after = {(r.nombre_sala, r.edificio): (r.capacidad, r.tipo_sala) for r in result.tables.sala.collect()}
    assert after["Sala 101", "Edificio Central"] == (7, "docente")
    assert after["Sala 400", "Edificio Norte"] == (7, "libre")
    assert ("Sala 301", "Edificio Central") not in after and len(after) == 9


def test_room_deletion(spark, seed):
    asked = requests(spark, [("Sala 101", "Edificio Central"), ("Sala A1", "Edificio Norte"), ("Sala B1", "Edificio Norte"),
                             ("Nada", "Edificio Sur")], "nombre_sala string, edificio string")
    assert outcomes(rc.delete_rooms(asked, seed, TODAY)) == {
        0: "con_reservas_activas", 1: "con_reservas_futuras", 2: None, 3: "sala_inexistente",
    }
    later = rc.delete_rooms(asked, seed, TODAY + dt.timedelta(9))
    assert outcomes(later)[1] == "con_reservas"
    assert later.tables.sala.count() == 8


def test_buildings(spark, seed):
    asked = requests(spark, [("Edificio Este", "Calle 1", "Rocha"), ("Edificio Este", "Calle 2", "Rocha"),
                             ("Edificio Sur", "Calle 3", "Rocha"), ("Edificio X", "Calle 4", None)],
                     "nombre_edificio string, direccion string, departamento string")
    result = rc.create_buildings(asked, seed)
    assert outcomes(result) == {0: None, 1: "edificio_duplicado", 2: "edificio_duplicado", 3: "datos_incompletos"}
    assert result.tables.edificio.count() == 4


def test_a_booking_is_purged_once(spark, seed):
    t = bc.cancel_bookings(requests(spark, [(1,)], "id_reserva int"), seed).tables
    result = bc.purge_bookings(requests(spark, [(1,), (1,)], "id_reserva int"), t)
    assert outcomes(result) == {0: None, 1: "reserva_inexistente"}


def test_moves_into_unknown_slots_are_refused(spark, seed):
    moves = requests(spark, [
        (1, "Sala 301", "Edificio Central", TODAY, 99), (1, "Sala 301", "Edificio Central", TODAY, 9),
    ], "id_reserva int, nombre_sala string, edificio string, fecha date, id_turno int")
    assert outcomes(bc.move_bookings(moves, seed)) == {0: "turno_inexistente", 1: None}


def test_a_refused_change_replaces_nothing(spark, seed):
    d = dt.timedelta
    state = [(1, "12345678", TODAY, TODAY + d(5)), (2, "12345678", TODAY + d(10), TODAY + d(20))]
    t = seed.with_tables(sancion_participante=frame(
        spark, state, "id_sancion int, ci_participante string, fecha_inicio date, fecha_fin date"))
    changes = requests(spark, [
        (2, TODAY + d(30), TODAY + d(40)), (1, TODAY, TODAY + d(7)), (1, TODAY + d(35), TODAY + d(50)),
        (1, TODAY + d(1), TODAY + d(8)), (1, TODAY + d(1), TODAY + d(8)),
    ], "id_sancion int, fecha_inicio date, fecha_fin date")
    result = sc.update_sanctions(changes, t)
    assert outcomes(result) == {0: None, 1: "reemplazada", 2: "periodo_solapado", 3: "reemplazada", 4: None}
    mails = requests(spark, [
        ("23456789", "M", "G", "n@x"), ("12345678", "J", "P", "j2@x"), ("12345678", "J", "P", "n@x"),
    ], "ci string, nombre string, apellido string, email string")
    result = pc.update_participants(mails, seed)
    assert outcomes(result) == {0: None, 1: None, 2: "email_registrado"}
    twice = seed.participante.union(seed.participante.limit(1).selectExpr("'9'", "nombre", "apellido", "email"))
    held = requests(spark, [("9", "J", "P", twice.first().email)], "ci string, nombre string, apellido string, email string")
    assert outcomes(pc.update_participants(held, seed.with_tables(participante=twice))) == {0: "email_registrado"}


def test_changes_of_monthly_bookings(spark, seed, tmp_path):
    write_snapshot(seed, str(tmp_path / "s"), monthly=True)
    t = load_tables(spark, str(tmp_path / "s"), monthly=True)
    moves = requests(spark, [
        (1, "Sala 301", "Edificio Central", dt.date(2027, 2, 1), 9),
    ], "id_reserva int, nombre_sala string, edificio string, fecha date, id_turno int")
    asked = frame(spark, [(1, "34567890", "Sala 301", "Edificio Central", dt.date(2027, 3, 1), 9, T0)], REQUEST)
    for change in (
        lambda x: bc.move_bookings(moves, x),
        lambda x: bc.admit_bookings(asked, x, TODAY),
        lambda x: bc.cancel_bookings(requests(spark, [(1,)], "id_reserva int"), x),
    ):
        plain, monthly = change(seed).tables, change(t).tables
        assert monthly.reserva.columns == plain.reserva.columns
        assert sorted(rows(monthly.reserva)) == sorted(rows(plain.reserva))
        for name in ("ocupacion_edificio", "horas_semana"):
            assert rows(report(name)(monthly, dt.date(2027, 2, 20))) == rows(report(name)(plain, dt.date(2027, 2, 20)))


def test_ids_beyond_32_bits(spark, seed):
    high = seed.reserva.withColumn("id_reserva", F.col("id_reserva") + 2147483641)
    asked = frame(spark, [(1, "34567890", "Sala 301", "Edificio Central", dt.date(2027, 3, 1), 9, T0)], REQUEST)
    new = bc.admit_bookings(asked, seed.with_tables(reserva=high), TODAY).tables.reserva
    assert new.agg(F.max("id_reserva")).first()[0] == 2147483648


def test_orphaned_participations_do_not_count(spark, seed):
    lost = seed.reserva_participante.limit(1)
    missing = lost.withColumn("id_reserva", F.lit(99).cast("long"))
    unknown = lost.withColumn("ci_participante", F.lit("nobody")).withColumn("id_reserva", F.lit(1).cast("long"))
    t = seed.with_tables(reserva_participante=seed.reserva_participante.union(missing).union(unknown))
    for variant in ("full", "basic"):
        of = report("reservas_por_carrera", variant)
        assert rows(of(t, TODAY)) == rows(of(seed, TODAY))
    assert sorted(rows(listings.available_participants(t))) == sorted(rows(listings.available_participants(seed)))
    assert listings.participants_outside_booking(t, 1).count() == 6
