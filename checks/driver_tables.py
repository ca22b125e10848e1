"""The generated TPC-H-like tables mapped to the booking model.

Both sides of a comparison build the same views: here with DataFrames, in
``checks/oracle.py`` as common table expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aulario.tables import Tables

AS_OF_BOOKINGS = "2001-07-15"
AS_OF_SANCTIONS = "2024-01-20"


# Columns the mapping uses. With a given schema no file is opened before a query runs.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int",
    "customer": "c_custkey bigint, c_nationkey int",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_suppkey bigint, l_linenumber int, l_returnflag string, "
    "l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double",
}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def turnos(spark: SparkSession) -> DataFrame:
    hour = F.col("id") + 7
    return spark.range(1, 16, numPartitions=1).select(
        F.col("id").cast("int").alias("id_turno"),
        F.format_string("%02d:00:00", hour).alias("hora_inicio"),
        F.format_string("%02d:00:00", hour + 1).alias("hora_fin"),
    )


def tables(spark: SparkSession, sf_dir: str) -> Tables:
    def source(name: str) -> DataFrame:
        return read(spark, sf_dir, name)

    def programmes() -> DataFrame:
        return source("nation").select(
            F.col("n_name").alias("nombre_programa"),
            F.col("n_regionkey").alias("id_facultad"),
            F.when(F.col("n_nationkey") % 3 == 0, "posgrado").otherwise("grado").alias("tipo"),
        )

    def participants() -> DataFrame:
        number = F.col("s_suppkey").cast("string")
        return source("supplier").select(
            F.col("s_suppkey").alias("ci"),
            F.col("s_name").alias("nombre"),
            F.concat(F.lit("A"), F.col("s_nationkey").cast("string")).alias("apellido"),
            F.concat(F.lit("p"), number, F.lit("@campus.test")).alias("email"),
        )

    def enrolments() -> DataFrame:
        nation, supplier = source("nation"), source("supplier")
        person = F.col("s_suppkey")
        first = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
            (person * 2).alias("id_alumno_programa"),
            person.alias("ci_participante"),
            F.col("n_name").alias("nombre_programa"),
            F.when(person % 5 == 0, "docente").otherwise("alumno").alias("rol"),
        )
        second = (
            supplier.filter(person % 4 == 0)
            .join(nation, (F.col("s_nationkey") + 7) % 25 == F.col("n_nationkey"))
            .select(
                (person * 2 + 1).alias("id_alumno_programa"),
                person.alias("ci_participante"),
                F.col("n_name").alias("nombre_programa"),
                F.lit("alumno").alias("rol"),
            )
        )
        return first.unionByName(second)

    def rooms() -> DataFrame:
        key = F.col("c_custkey")
        return source("customer").select(
            key.alias("nombre_sala"),
            F.col("c_nationkey").alias("edificio"),
            (key % 12 + 1).cast("int").alias("capacidad"),
            F.when(key % 3 == 0, "libre")
            .when(key % 3 == 1, "posgrado")
            .otherwise("docente")
            .alias("tipo_sala"),
        )

    def bookings() -> DataFrame:
        status = F.col("o_orderstatus")
        return (
            source("orders")
            .join(source("customer"), F.col("o_custkey") == F.col("c_custkey"))
            .select(
                F.col("o_orderkey").alias("id_reserva"),
                F.col("c_custkey").alias("nombre_sala"),
                F.col("c_nationkey").alias("edificio"),
                F.col("o_orderdate").cast("date").alias("fecha"),
                F.substring("o_orderpriority", 1, 1).cast("int").alias("id_turno"),
                F.when(status == "F", "finalizada")
                .when(status == "O", "activa")
                .when(F.col("o_orderkey") % 2 == 0, "cancelada")
                .otherwise("sin asistencia")
                .alias("estado"),
            )
        )

    def participations() -> DataFrame:
        # The code of the one-letter flag: numbers are combined in a hash aggregate.
        flag = F.col("marca")
        return (
            source("lineitem")
            .groupBy(
                F.col("l_suppkey").alias("ci_participante"), F.col("l_orderkey").alias("id_reserva")
            )
            .agg(
                F.min("l_shipdate").alias("fecha_solicitud_reserva"),
                F.max(F.ascii("l_returnflag")).alias("marca"),
            )
            .select(
                "ci_participante",
                "id_reserva",
                "fecha_solicitud_reserva",
                F.when(flag == ord("A"), True).when(flag == ord("R"), False).alias("asistencia"),
            )
        )

    return Tables(
        facultad=lambda: source("region").select(
            F.col("r_regionkey").alias("id_facultad"), F.col("r_name").alias("nombre")
        ),
        programa_academico=programmes,
        participante=participants,
        participante_programa_academico=enrolments,
        edificio=lambda: source("nation").select(
            F.col("n_nationkey").alias("nombre_edificio"),
            F.col("n_name").alias("direccion"),
            F.concat(F.lit("D"), F.col("n_regionkey").cast("string")).alias("departamento"),
        ),
        sala=rooms,
        turno=lambda: turnos(spark),
        reserva=bookings,
        reserva_participante=participations,
        sancion_participante=lambda: sanctions(
            source("events").filter(F.col("event_type") == "error")
        ),
    )


def sanctions(events: DataFrame) -> DataFrame:
    days = F.element_at(
        F.array(F.lit(7), F.lit(15), F.lit(30), F.lit(60)), (F.col("event_id") % 4 + 1).cast("int")
    )
    start = F.col("ts").cast("date")
    return events.select(
        F.col("event_id").alias("id_sancion"),
        F.col("user_id").alias("ci_participante"),
        start.alias("fecha_inicio"),
        F.date_add(start, days).alias("fecha_fin"),
    )
