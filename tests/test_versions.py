"""Versions that share unchanged files, and the audit of what a change touched."""

from __future__ import annotations

import datetime as dt
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from aulario.operators import booking_changes as bc
from aulario.operators import people_changes as pc
from aulario.operators import room_changes as rc
from aulario.operators import sanction_changes as sc
from aulario.operators.changes import ChangeResult, delete_rows, insert_rows
from aulario.operators.constraints import check_changes, check_constraints
from aulario.sources.schemas import SCHEMAS
from aulario.sources.versions import load_version, manifest, write_next_version, write_version
from tests.conftest import TODAY, frame, rows

T0 = dt.datetime(2026, 12, 1, 8)
REQUEST = (
    "id_solicitud int, ci_participante string, nombre_sala string, edificio string, "
    "fecha date, id_turno int, solicitada_en timestamp"
)


def state(tables):
    return {name: sorted(map(repr, rows(df.select(*SCHEMAS[name].names)))) for name, df in tables.items()}


def written_files(path):
    return sorted(str(p.relative_to(path).parent) for p in Path(path).rglob("part-*.parquet"))


@pytest.fixture
def first(spark, seed, tmp_path):
    path = str(tmp_path / "v1")
    write_version(seed, path)
    return path


def booked(spark, tables):
    batch = [
        (1, "23456789", "Sala 102", "Edificio Central", TODAY + dt.timedelta(90), 1, T0),
        (2, "45678901", "Sala 101", "Edificio Central", TODAY + dt.timedelta(91), 2, T0),
    ]
    return bc.admit_bookings(frame(spark, batch, REQUEST), tables, TODAY)


def test_first_version_is_the_state(spark, seed, first):
    assert state(load_version(spark, first)) == state(seed)
    months = {(t, m) for t, m, _ in manifest(spark, first)}
    assert ("sala", None) in months and all(m for t, m in months if t == "reserva")


def test_next_version_rewrites_touched_months_only(spark, first, tmp_path):
    before = load_version(spark, first)
    old = state(before)
    result = booked(spark, before)
    path = str(tmp_path / "v2")
    write_next_version(result, first, path)
    month = (TODAY + dt.timedelta(90)).strftime("%Y-%m")
    asked = T0.strftime("%Y-%m")
    assert set(written_files(path)) == {f"reserva/mes={month}", f"reserva_participante/mes={asked}"}
    assert state(load_version(spark, path)) == state(result.tables) != old
    assert state(load_version(spark, first)) == old
    carried = [e for e in manifest(spark, path) if e[2].startswith(first)]
    assert {e[0] for e in carried} >= {"sala", "participante", "sancion_participante"}


def test_rows_that_change_month_leave_the_old_one(spark, first, tmp_path):
    before = load_version(spark, first)
    schema = "id_solicitud int, id_reserva long, nombre_sala string, edificio string, fecha date, id_turno int, solicitada_en timestamp"
    move = frame(spark, [(1, 1, "Sala 101", "Edificio Central", dt.date(2030, 5, 6), 3, T0)], schema)
    result = bc.move_bookings(move, before)
    assert result.accepted.count() == 1
    path = str(tmp_path / "v2")
    write_next_version(result, first, path)
    own = before.reserva.filter("id_reserva = 1").select(F.date_format("fecha", "yyyy-MM")).first()[0]
    files = set(written_files(path))
    left = before.reserva.filter(F.date_format("fecha", "yyyy-MM") == own).count() - 1
    assert files == {"reserva/mes=2030-05"} | ({f"reserva/mes={own}"} if left else set())
    assert state(load_version(spark, path)) == state(result.tables)


def test_versions_follow_each_other(spark, first, tmp_path):
    tables, previous = load_version(spark, first), first
    ids = "id_solicitud int, {} string, solicitada_en timestamp"
    steps = [
        lambda t: booked(spark, t),
        lambda t: sc.delete_sanctions(frame(spark, [(1, 1, T0)], "id_solicitud int, id_sancion long, solicitada_en timestamp"), t),
        lambda t: rc.create_rooms(
            frame(spark, [(1, "Nueva", "Edificio Sur", 5, "libre", T0)],
                  "id_solicitud int, nombre_sala string, edificio string, capacidad int, tipo_sala string, solicitada_en timestamp"), t),
        lambda t: bc.purge_bookings(t.reserva.select(F.col("id_reserva").alias("id_solicitud"), "id_reserva", F.lit(T0).alias("solicitada_en")), t),
        lambda t: pc.delete_participants(frame(spark, [(1, "89012345", T0)], ids.format("ci")), t),
    ]
    for number, step in enumerate(steps):
        result = step(tables)
        want = state(result.tables)
        path = str(tmp_path / f"next{number}")
        write_next_version(result, previous, path)
        tables, previous = load_version(spark, path), path
        assert state(tables) == want


def test_a_change_of_nothing_carries_everything(spark, first, tmp_path):
    before = load_version(spark, first)
    none = frame(spark, [], REQUEST)
    path = str(tmp_path / "v2")
    write_next_version(bc.admit_bookings(none, before, TODAY), first, path)
    assert written_files(path) == [] and state(load_version(spark, path)) == state(before)


def violations(df):
    return sorted(map(tuple, df.collect()))


def test_sound_state_and_sound_change_make_a_sound_state(spark, seed):
    assert violations(check_constraints(seed)) == []
    result = booked(spark, seed)
    assert violations(check_changes(seed, result)) == violations(check_constraints(result.tables)) == []


def test_audit_of_a_change_finds_all_that_the_whole_audit_finds(spark, seed):
    """Rows put in or taken out past the operators: duplicates, lost parents, broken rules, missing values."""
    none = frame(spark, [], REQUEST)
    new = frame(
        spark,
        [
            (1, "Sala 101", "Edificio Central", TODAY, 1, "activa"),  # a number that is taken
            (50, "Sala 999", "Nowhere", TODAY, 1, "activa"),
            (51, "Sala 301", "Edificio Central", dt.date(2031, 1, 1), 99, "rota"),
            (52, "Sala 301", "Edificio Central", dt.date(2031, 1, 1), 99, None),
        ],
        "id_reserva long, nombre_sala string, edificio string, fecha date, id_turno int, estado string",
    )
    people = frame(
        spark, [("00", 50, T0, None), ("12345678", 777, T0, True), ("12345678", 1, T0, True)],
        "ci_participante string, id_reserva long, fecha_solicitud_reserva timestamp, asistencia boolean",
    )
    gone_rooms = seed.sala.filter("nombre_sala = 'Sala 201'").select("nombre_sala", "edificio")
    gone_people = frame(spark, [("23456789",)], "ci string")
    tables = seed.with_tables(
        reserva=insert_rows(seed.reserva, new),
        reserva_participante=insert_rows(seed.reserva_participante, people),
        sala=delete_rows(seed.sala, gone_rooms, ["nombre_sala", "edificio"]),
        participante=delete_rows(seed.participante, gone_people, ["ci"]),
    )
    touched = {
        "reserva": new.select("id_reserva"),
        "reserva_participante": people.select("ci_participante", "id_reserva"),
        "sala": gone_rooms,
        "participante": gone_people,
    }
    found = violations(check_changes(seed, ChangeResult(tables, none, none, touched)))
    assert found == violations(check_constraints(tables)) and len(found) >= 8
