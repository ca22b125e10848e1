"""Time the headline queries and print one JSON line.

BENCH_SF_DIR is the data folder, BENCH_CPUS the number of local cores.
"""

from __future__ import annotations

import json
import os
import time
from pathlib import Path

from pyspark.sql import SparkSession

from checks.queries import all_queries

HEADLINE = [
    "r1_salas_mas_reservadas",
    "r2_turnos_demandados",
    "r3_promedio_participantes",
    "r4_reservas_por_carrera",
    "r5_ocupacion_edificio",
    "r6_reservas_por_tipo",
    "r7_sanciones_por_tipo",
    "r8_efectividad",
    "r9_horas_semana",
    "r10_participantes_sancionados",
    "r11_edificios_cancelaciones",
    "l1_reservas_recientes",
    "l3_reservas_con_participantes",
    "l4_reservas_por_participante",
    "k2_estadisticas_sala",
    "k6_lugares_restantes",
    "v0_todas_las_reglas",
    "v11_periodo_solapado",
    "m1_admitir_reservas",
    "m5_agregar_participantes",
    "m6_quitar_participantes",
    "m8_crear_sanciones",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("aulario-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = all_queries()
    queries["r8_efectividad"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds: dict[str, float] = {}
    for name in HEADLINE:
        started = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(Path(sf_dir).name.removeprefix("sf")),
                "spark": spark.version,
                "cpus": int(cpus),
                "shuffle_partitions": int(cpus),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
