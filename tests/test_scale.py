"""Plans and results on skewed data: one key holds a third of the rows."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from aulario.operators import constraints, listings, periods, rules, sanction_changes
from aulario.operators.sequencing import Limit, _use_up, admit_in_order
from aulario.plans.registry import report
from aulario.session import cut, ensure_checkpoint_dir
from aulario.sources.schemas import FOREIGN_KEYS, UNIQUE_KEYS
from tests.conftest import TODAY, rows

ROWS = 60_000


@pytest.fixture(scope="module")
def skewed(spark, seed, tmp_path_factory):
    """Participations of which a third belong to one person, and a third to one booking."""
    path = str(tmp_path_factory.mktemp("skew") / "rp")
    i = F.col("id")
    spark.range(ROWS, numPartitions=8).select(
        F.when(i % 3 == 0, "12345678").otherwise(F.concat(F.lit("p"), (i % 5000).cast("string"))).alias("ci_participante"),
        F.when(i % 3 == 1, F.lit(1)).otherwise(i % 9000 + 1).cast("int").alias("id_reserva"),
        F.current_timestamp().alias("fecha_solicitud_reserva"),
        (i % 2 == 0).alias("asistencia"),
    ).write.parquet(path)
    enrolled = spark.range(5000).select(
        i.cast("int").alias("id_alumno_programa"),
        F.when(i == 0, "12345678").otherwise(F.concat(F.lit("p"), i.cast("string"))).alias("ci_participante"),
        F.lit("Derecho").alias("nombre_programa"),
        F.lit("alumno").alias("rol"),
    )
    return seed.with_tables(
        reserva_participante=spark.read.parquet(path), participante_programa_academico=enrolled
    )


@pytest.fixture
def small_partitions(spark):
    """Make AQE treat this small data the way it treats large partitions."""
    conf = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4KB",
        "spark.sql.shuffle.partitions": "16",
    }
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def final_plan(df) -> str:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["reservas_por_carrera", "reservas_por_tipo"])
def test_hot_participant_is_split_in_joins(skewed, small_partitions, name):
    assert "skew=true" in final_plan(report(name)(skewed, TODAY))


def test_programmes_of_bookings_are_distinct_before_the_join(skewed, small_partitions):
    plan = report("reservas_por_carrera")(skewed, TODAY)._jdf.queryExecution().optimizedPlan().toString().split("\n")
    (at,) = [i for i, line in enumerate(plan) if "Join LeftSemi" in line]
    assert "Aggregate [" in plan[at + 1]


def test_rules_of_the_audit_are_grouped_in_stages_of_their_own(seed):
    plan = constraints.check_constraints(seed)._jdf.queryExecution().executedPlan().toString()
    rules_of = [len(UNIQUE_KEYS[n]) + len(FOREIGN_KEYS.get(n, [])) + 1 for n in seed.names()]
    assert plan.count("REPARTITION_BY_COL") == sum(rules_of)


@pytest.fixture(scope="module")
def hot_requests(spark, tmp_path_factory):
    """Booking requests of which a third come from one person and a third want one slot."""
    path = str(tmp_path_factory.mktemp("hot") / "requests")
    i = F.col("id")
    spark.range(ROWS, numPartitions=8).select(
        i.alias("id_solicitud"),
        F.when(i % 3 == 0, "12345678").otherwise(F.concat(F.lit("p"), (i % 5000).cast("string"))).alias("ci_participante"),
        F.when(i % 3 == 1, "Sala 101").otherwise(F.concat(F.lit("s"), (i % 5000).cast("string"))).alias("nombre_sala"),
        F.lit("Edificio Central").alias("edificio"),
        F.when(i % 3 == 1, F.lit(TODAY)).otherwise(F.date_add(F.lit(TODAY), (i % 50).cast("int"))).alias("fecha"),
        F.lit(1).alias("id_turno"),
        F.when(i % 3 == 1, 1).otherwise(i % 5000).cast("long").alias("id_reserva"),
        F.current_timestamp().alias("solicitada_en"),
    ).write.parquet(path)
    return spark.read.parquet(path)


@pytest.mark.parametrize(
    "key,judge",
    [
        ("ci_participante", lambda q, t: rules.no_sanction(q, t, "2026-10-15")),
        ("ci_participante", lambda q, t: rules.within_daily_limit(q.withColumn("fecha", F.lit(TODAY)), t)),
        ("ci_participante", rules.with_privilege),
        ("nombre_sala", rules.slot_free),
        ("nombre_sala", rules.slot_free_for_move),
        ("nombre_sala", lambda q, t: rules.room_deletion_blocks(t, q, TODAY)),
        ("id_reserva", rules.fits_capacity),
    ],
    ids=["v1", "v2", "v6", "v7", "v8", "v10", "v4"],
)
def test_request_side_of_a_rule_is_split_at_a_hot_key(seed, hot_requests, small_partitions, key, judge):
    plan = final_plan(judge(hot_requests, seed))
    assert re.search(rf"SortMergeJoin\(skew=true\) \[{key}#[^\n]*LeftOuter", plan)


def test_joins_of_admission_rounds_are_split_at_a_hot_key(hot_requests, small_partitions):
    """What a round grants is taken off the room of its keys; requests that crowd on a key are dealt to many tasks."""
    limits = [Limit(["ci_participante"], "libre_persona", 2), Limit(["nombre_sala", "fecha"], "libre_sala", 1)]
    room = hot_requests.withColumn("libre_persona", F.lit(2) + F.col("id_turno") * 0)
    room = room.withColumn("libre_sala", F.lit(5) + F.col("id_turno") * 0)
    granted = cut(room.filter("id_solicitud % 40 = 7"))
    plan = final_plan(_use_up(room, granted, limits))
    joins = re.findall(r"SortMergeJoin(\(skew=true\))? \[(\w+)#", plan)
    assert {key for _, key in joins} == {"ci_participante", "nombre_sala"}
    assert ("(skew=true)", "ci_participante") in joins and ("(skew=true)", "nombre_sala") in joins


def test_rank_is_cut_before_the_shuffle(skewed):
    plan = listings.participant_bookings(skewed)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2 and "Partial" in plan


def test_top_rooms_use_a_bounded_sort(seed):
    plan = report("salas_mas_reservadas")(seed, TODAY)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject(limit=10" in plan


def test_date_bound_reaches_the_scan(seed):
    plan = report("ocupacion_edificio")(seed, TODAY)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(fecha,2026-11-01)" in plan


def test_crowded_booking_is_one_row_collected_in_parts(skewed, small_partitions):
    people = skewed.reserva_participante.select(F.col("ci_participante").alias("ci")).distinct()
    t = skewed.with_tables(participante=people.select(
        "ci", *[F.lit("x").alias(c) for c in ("nombre", "apellido", "email")]))
    found = listings.bookings_with_participants(t)
    got = found.filter("id_reserva = 1").select("participantes").collect()
    inside = rows(skewed.reserva_participante.filter("id_reserva = 1").select("ci_participante"))
    assert len(got) == 1 and [p.ci_participante for p in got[0][0]] == sorted(r[0] for r in inside)
    plan = final_plan(found)
    parts = plan[plan.index("ObjectHashAggregate(keys=[id_reserva"):]
    assert "functions=[collect_list" in parts and "functions=[partial_collect_list" in parts


def test_rounds_end_quickly_with_a_hot_key(spark):
    """A third of the requests want one slot, a third come from one person."""
    i = F.col("id")
    n = 3000
    asked = spark.range(n).select(
        i.alias("id_solicitud"),
        ((i * 7919) % n).alias("solicitada_en"),
        F.when(i % 3 == 0, 0).otherwise(i % 400).alias("lugar"),
        F.when(i % 3 == 1, 0).otherwise(i % 500).alias("persona"),
        F.lit(1).alias("libre_lugar"),
        F.lit(2).alias("libre_persona"),
    )
    limits = [Limit(["lugar"], "libre_lugar", 1), Limit(["persona"], "libre_persona", 2)]
    got = {r.id_solicitud for r in admit_in_order(asked, limits).select("id_solicitud").collect()}
    places, people, expected = set(), {}, set()
    for r in sorted(asked.collect(), key=lambda r: (r.solicitada_en, r.id_solicitud)):
        if r.lugar not in places and people.get(r.persona, 0) < 2:
            expected.add(r.id_solicitud)
            places.add(r.lugar)
            people[r.persona] = people.get(r.persona, 0) + 1
    assert got == expected


def test_sanctions_of_one_person_are_bounded_by_the_calendar(spark, seed):
    """However many requests one person gets, few have to be walked through in order."""
    i = F.col("id")
    n = 20_000
    start = F.date_add(F.lit("2027-01-01").cast("date"), ((i * 37) % 90).cast("int"))
    asked = spark.range(n, numPartitions=4).select(
        i.alias("id_solicitud"),
        F.lit("23456789").alias("ci_participante"),
        start.alias("fecha_inicio"),
        F.date_add(start, ((i * 11) % 40 + 1).cast("int")).alias("fecha_fin"),
        ((i * 7919) % n).alias("solicitada_en"),
    )
    result = sanction_changes.create_sanctions(asked, seed)
    kept = []
    for r in sorted(asked.collect(), key=lambda r: (r.solicitada_en, r.id_solicitud)):
        if all(r.fecha_fin < a or r.fecha_inicio > b for a, b, _ in kept):
            kept.append((r.fecha_inicio, r.fecha_fin, r.id_solicitud))
    assert {r.id_solicitud for r in result.accepted.collect()} == {k[2] for k in kept}
    assert set(rows(result.rejected.select("motivo").distinct())) == {("periodo_solapado",)}
    assert sanction_changes.candidates(asked).count() < 90 * 40


@pytest.mark.parametrize("in_time", [False, True], ids=["shuffled", "by date"])
def test_changes_of_one_person_take_few_rounds(spark, seed, monkeypatch, in_time):
    """However many changes one person gets, an expression decides a constant number; the days taken decide others."""
    monkeypatch.setattr(periods, "DECIDED_AT_ONCE", 25)
    rounds, decide = [], periods._in_order
    monkeypatch.setattr(periods, "_in_order", lambda p, own: rounds.append(own) or decide(p, own))
    i, n = F.col("id"), 900
    state = spark.range(40).select(
        i.cast("int").alias("id_sancion"),
        F.when(i < 30, "23456789").otherwise("34567890").alias("ci_participante"),
        F.date_add(F.lit("2020-01-01").cast("date"), (i * 2).cast("int")).alias("fecha_inicio"),
        F.date_add(F.lit("2020-01-01").cast("date"), (i * 2 + 1).cast("int")).alias("fecha_fin"),
    )
    start = F.date_add(F.lit("2027-01-01").cast("date"), ((i / 10) if in_time else (i * 37) % 90).cast("int"))
    asked = spark.range(n, numPartitions=4).select(
        i.alias("id_solicitud"),
        ((i * 7) % 40).cast("int").alias("id_sancion"),
        start.alias("fecha_inicio"),
        F.date_add(start, ((i * 11) % 7 + 1).cast("int")).alias("fecha_fin"),
        F.when(i % 50 > 0, i if in_time else (i * 7919) % n).alias("solicitada_en"),
    )
    result = sanction_changes.update_sanctions(asked, seed.with_tables(sancion_participante=state))
    kept, latest = [], {}
    order = sorted(asked.collect(), key=lambda r: (-1 if r.solicitada_en is None else r.solicitada_en, r.id_solicitud))
    for r in order:
        who = r.id_sancion < 30
        if all(w != who or s == r.id_sancion or r.fecha_fin < a or r.fecha_inicio > b for w, s, a, b in kept):
            kept.append((who, r.id_sancion, r.fecha_inicio, r.fecha_fin))
            latest[r.id_sancion] = r.id_solicitud
    assert {r.id_solicitud for r in result.accepted.collect()} == set(latest.values())
    replaced = result.rejected.filter("motivo = 'reemplazada'").count()
    assert replaced == len(kept) - len(latest) and result.rejected.count() == n - len(latest)
    assert 2 <= len(rounds) < 20


def test_a_third_of_all_periods_in_one_participant_takes_few_rounds(spark, monkeypatch):
    rounds, decide = [], periods._in_order
    monkeypatch.setattr(periods, "_in_order", lambda p, own: rounds.append(own) or decide(p, own))
    i = F.col("id")
    start = F.date_add(F.lit("2020-01-01").cast("date"), (i * 7919 % 1500).cast("int"))
    asked = spark.range(ROWS, numPartitions=8).select(
        i.alias("id_solicitud"),
        F.when(i % 3 == 0, "hot").otherwise((i % 5000).cast("string")).alias("ci_participante"),
        (i % 101).alias("id_sancion"),
        start.alias("fecha_inicio"),
        F.date_add(start, (i * 11 % 30 + 1).cast("int")).alias("fecha_fin"),
        (i * 104729 % ROWS).alias("solicitada_en"),
    )
    got = {r[0] for r in rows(periods.granted_in_order(asked, "id_sancion").select("id_solicitud"))}
    kept: dict[str, list] = {}
    want = set()
    for r in sorted(asked.collect(), key=lambda r: (r.solicitada_en, r.id_solicitud)):
        own = kept.setdefault(r.ci_participante, [])
        if all(s == r.id_sancion or r.fecha_fin < a or r.fecha_inicio > b for s, a, b in own):
            own.append((r.id_sancion, r.fecha_inicio, r.fecha_fin))
            want.add(r.id_solicitud)
    assert got == want and 2 <= len(rounds) < 20


def test_no_python_runs_in_sanction_changes(spark, seed):
    asked = spark.createDataFrame([], "id_solicitud int, id_sancion int, fecha_inicio date, fecha_fin date, solicitada_en timestamp")
    plan = periods.granted_in_order(asked.withColumn("ci_participante", F.lit("1")), "id_sancion")
    assert not re.search("Python|Pandas|Arrow", plan._jdf.queryExecution().executedPlan().toString())


def test_checkpoint_folder_of_the_session_is_used(spark):
    ensure_checkpoint_dir(spark)
    assert spark.sparkContext.getCheckpointDir() is not None
