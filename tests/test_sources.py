"""Reading, writing and the sample load."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from aulario.plans.registry import report
from aulario.sources.readers import FOLDING_COLLATION, load_catalog, load_tables
from aulario.sources.schemas import SCHEMAS, room_types
from aulario.sources.writers import (
    collect_statistics,
    export,
    json_array,
    json_rows,
    save_bucketed,
    write_snapshot,
)
from aulario.tables import Tables
from tests.conftest import TODAY, rows


@pytest.mark.parametrize("fmt", ["parquet", "orc", "json", "csv"])
def test_snapshot_round_trip(spark, seed, tmp_path, fmt):
    write_snapshot(seed, str(tmp_path / "s"), fmt)
    again = load_tables(spark, str(tmp_path / "s"), fmt)
    for (name, before), (_, after) in zip(seed.items(), again.items(), strict=True):
        assert after.columns == SCHEMAS[name].names
        assert sorted(rows(before), key=repr) == sorted(rows(after), key=repr), name


def test_snapshots_are_not_overwritten(seed, tmp_path):
    write_snapshot(seed, str(tmp_path / "s"))
    with pytest.raises(Exception, match="already exists"):
        write_snapshot(seed, str(tmp_path / "s"))


def test_monthly_bookings_are_pruned(spark, seed, tmp_path):
    write_snapshot(seed, str(tmp_path / "s"), monthly=True)
    plain = load_tables(spark, str(tmp_path / "s"))
    assert plain.reserva.columns == SCHEMAS["reserva"].names
    monthly = load_tables(spark, str(tmp_path / "s"), monthly=True)
    trend = report("horas_semana")(monthly, TODAY)
    assert rows(trend) == rows(report("horas_semana")(seed, TODAY))
    plan = trend._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(mes" in plan


def test_bucketed_bookings_join_without_a_shuffle(spark, seed, tmp_path):
    save_bucketed(seed, "aulario_prueba", str(tmp_path / "db"), 4)
    stored = load_catalog(spark, "aulario_prueba")
    joined = stored.reserva.join(stored.reserva_participante, "id_reserva").hint("merge")
    counted = stored.reserva_participante.groupBy("id_reserva").count()
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for df in (joined, counted):
            assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
        same = report("promedio_participantes")
        assert rows(same(stored, TODAY)) == rows(same(seed, TODAY))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.sql("DROP DATABASE aulario_prueba CASCADE")


def test_statistics_change_the_join(spark, seed, tmp_path):
    """With counted values a filter on a key is known to leave few rows, which are then broadcast."""
    many = spark.range(20000).select(
        F.col("id").cast("string").alias("ci"), F.lit("n" * 50).alias("nombre"), F.lit("a").alias("apellido"),
        F.col("id").cast("string").alias("email"),
    )
    more = spark.range(60000).select(
        F.col("id").alias("id_sancion"), (F.col("id") % 20000).cast("string").alias("ci_participante"),
        F.lit(TODAY).alias("fecha_inicio"), F.lit(TODAY).alias("fecha_fin"),
    )
    spark.sql("DROP DATABASE IF EXISTS aulario_conteo CASCADE")
    save_bucketed(
        seed.with_tables(participante=many, sancion_participante=more), "aulario_conteo", str(tmp_path / "db"), 2
    )
    conf = {
        "spark.sql.cbo.enabled": "true",
        "spark.sql.autoBroadcastJoinThreshold": "20KB",
        "spark.sql.adaptive.enabled": "false",
    }
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        def plan():
            t = load_catalog(spark, "aulario_conteo")
            some = t.sancion_participante.filter("id_sancion < 30")
            return t.participante.join(some, F.col("ci") == F.col("ci_participante"))

        assert "SortMergeJoin" in plan()._jdf.queryExecution().executedPlan().toString()
        collect_statistics(spark, "aulario_conteo")
        assert "BroadcastHashJoin" in plan()._jdf.queryExecution().executedPlan().toString()
        assert plan().count() == 30
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
        spark.sql("DROP DATABASE aulario_conteo CASCADE")


def test_folding_collation(spark, seed, tmp_path):
    write_snapshot(seed, str(tmp_path / "s"))
    folded = load_tables(spark, str(tmp_path / "s"), collation=FOLDING_COLLATION)
    assert folded.participante.filter("apellido = 'PEREZ'").count() == 1
    assert seed.participante.filter("apellido = 'PEREZ'").count() == 0
    assert len(rows(report("reservas_por_carrera")(folded, TODAY))) == 7


def test_exports(spark, seed, tmp_path):
    df = report("efectividad")(seed, TODAY)
    for fmt in ("csv", "json", "parquet"):
        export(df, str(tmp_path / fmt), fmt)
        back = spark.read.option("header", "true").format(fmt).load(str(tmp_path / fmt))
        assert back.count() == 2
    with pytest.raises(ValueError):
        export(df, str(tmp_path / "x"), "xls")


def test_json(seed):
    df = report("horas_semana")(seed, TODAY)
    data = json.loads(json_array(df, 10))
    assert data[0]["inicio_semana"] == "2026-11-30" and data[0]["total_horas_reservadas"] == 6
    assert json_array(df.limit(0), 10) == "[]"
    with pytest.raises(ValueError):
        json_array(seed.turno, 3)
    marks = json_rows(seed.reserva_participante.select("asistencia")).distinct()
    assert sorted(r[0] for r in rows(marks)) == ['{"asistencia":null}', '{"asistencia":true}']


def test_model(seed):
    assert Tables.names() == list(SCHEMAS)
    assert room_types() == ["libre", "posgrado", "docente"]
