"""Exact distinct counts kept as bitmaps by month."""

from __future__ import annotations

import datetime as dt
import random

from pyspark.sql import functions as F

from aulario.operators import bitmaps
from aulario.plans.registry import report
from tests.conftest import TODAY, frame, rows


def test_bitmaps_count_what_distinct_counts(spark):
    rng = random.Random(4)
    pairs = [(rng.choice("abc"), rng.choice([None, *range(1, 200), 32768, 32769, 65536, 10**12])) for _ in range(3000)]
    df = frame(spark, pairs, "g string, n long")
    found = dict(rows(bitmaps.distinct_count(bitmaps.member_bitmaps(df, ["g"], "n"), ["g"], "total")))
    assert found == {g: len({n for h, n in pairs if h == g and n is not None}) for g in "abc"}
    assert bitmaps.member_bitmaps(df.limit(0), ["g"], "n").count() == 0


def test_sets_of_different_parts_are_merged(spark):
    df = frame(spark, [("a", n) for n in range(1, 50000, 3)], "g string, n long")
    whole = bitmaps.member_bitmaps(df, ["g"], "n")
    parts = bitmaps.member_bitmaps(df.filter("n < 40000"), ["g"], "n").union(
        bitmaps.member_bitmaps(df.filter("n > 20000"), ["g"], "n")
    )
    assert bitmaps.distinct_count(parts, ["g"], "n").collect() == bitmaps.distinct_count(whole, ["g"], "n").collect()
    assert bitmaps.merged(parts, ["g"]).count() == 2


def test_all_months_give_the_report(seed):
    kept = bitmaps.monthly_bookings_by_programme(seed)
    found = dict(rows(bitmaps.bookings_in_months(kept, "nombre_programa")))
    want = {r.nombre_programa: r.total_reservas for r in report("reservas_por_carrera")(seed, TODAY).collect()}
    assert found == {k: v for k, v in want.items() if v}
    typed = dict(rows(bitmaps.bookings_in_months(bitmaps.monthly_bookings_by_user_type(seed), "tipo_usuario")))
    want = {r.tipo_usuario: r.total_reservas for r in report("reservas_por_tipo")(seed, TODAY).collect()}
    assert typed == {k: v for k, v in want.items() if v}


def test_a_span_of_months(spark, seed):
    moved = seed.reserva.withColumn(
        "fecha", F.when(F.col("id_reserva") <= 3, F.lit(dt.date(2026, 1, 31))).otherwise(F.lit(dt.date(2026, 2, 1)))
    )
    kept = bitmaps.monthly_bookings_by_programme(seed.with_tables(reserva=moved))
    january = dict(rows(bitmaps.bookings_in_months(kept, "nombre_programa", last="2026-01")))
    february = dict(rows(bitmaps.bookings_in_months(kept, "nombre_programa", first="2026-02")))
    both = dict(rows(bitmaps.bookings_in_months(kept, "nombre_programa")))
    assert both == {k: january.get(k, 0) + february.get(k, 0) for k in {*january, *february}}


def test_no_pairs_are_shuffled(spark):
    df = spark.range(1, 100_000, numPartitions=4).select((F.col("id") % 3).alias("g"), F.col("id").alias("n"))
    plan = bitmaps.member_bitmaps(df, ["g"], "n")._jdf.queryExecution().executedPlan().toString()
    exchange = plan[plan.index("Exchange hashpartitioning"):]
    assert "partial_bitmap_construct_agg" in exchange
