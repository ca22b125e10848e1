"""Writing snapshots and report results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aulario.sources.schemas import FOREIGN_KEYS, SCHEMAS, UNIQUE_KEYS
from aulario.tables import MONTH, Tables


def write_snapshot(
    tables: Tables,
    path: str,
    fmt: str = "parquet",
    monthly: bool = False,
    files_per_month: int = 4,
) -> None:
    """Write all tables under a new ``path``.

    A folder that already exists is refused: the state being replaced may still be read by
    the plans that lead to the new one. With ``monthly`` the bookings are partitioned by
    month (column ``mes``) of their date, so that date-bound reports read only those needed;
    each month is gathered into at most ``files_per_month`` files.
    """
    for name, df in tables.items():
        writer = df
        by: list[str] = []
        if monthly and name == "reserva":
            salt = F.pmod(F.xxhash64("id_reserva"), F.lit(files_per_month))
            writer = df.withColumn(MONTH, F.date_format("fecha", "yyyy-MM")).repartition(MONTH, salt)
            by = [MONTH]
        out = writer.write.mode("errorifexists").format(fmt)
        if fmt == "csv":
            out = out.option("header", "true")
        if by:
            out = out.partitionBy(*by)
        out.save(f"{path}/{name}")


# Both fact tables lie in the same buckets of the booking they belong to.
BUCKET_KEYS = {"reserva": "id_reserva", "reserva_participante": "id_reserva"}


def save_bucketed(tables: Tables, database: str, path: str, buckets: int) -> None:
    """Save all tables in the catalog, bookings and participations bucketed by booking.

    Joining and counting by booking then needs no shuffle. Choose ``buckets`` so that one
    bucket of participations fits the memory of a task.
    """
    tables.reserva.sparkSession.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    for name, df in tables.items():
        key = BUCKET_KEYS.get(name)
        # One file per bucket: rows arrive in the partitioning they are stored in.
        writer = (df.repartition(buckets, key) if key else df).write.format("parquet")
        if key:
            writer = writer.bucketBy(buckets, key).sortBy(key)
        writer.option("path", f"{path}/{name}").saveAsTable(f"{database}.{name}")


def collect_statistics(spark: SparkSession, database: str) -> None:
    """Count rows of all catalog tables, and values of the columns that joins and filters use.

    With ``spark.sql.cbo.enabled`` (set by ``create_session``) Spark then judges the sides of a join by the rows that
    their filters leave, and not by the size of the files. One pass over each table; again after large changes.
    """
    for name, schema in SCHEMAS.items():
        used = {c for key in UNIQUE_KEYS[name].values() for c in key}
        used |= {c for key in FOREIGN_KEYS.get(name, []) for c in key.columns}
        used |= {f.name for f in schema if f.dataType.typeName() in ("date", "timestamp")} | ({"estado"} & {*schema.names})
        columns = ", ".join(c for c in schema.names if c in used)
        spark.sql(f"ANALYZE TABLE {database}.{name} COMPUTE STATISTICS FOR COLUMNS {columns}")


def export(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """Write a report as csv (with header), json or parquet."""
    if fmt not in ("csv", "json", "parquet"):
        raise ValueError("fmt is csv, json or parquet")
    writer = df.write.mode("errorifexists").format(fmt)
    if fmt == "csv":
        writer = writer.option("header", "true")
    if fmt == "json":
        writer = writer.option("ignoreNullFields", "false")
    writer.save(path)


def json_rows(df: DataFrame) -> DataFrame:
    """Each row as one JSON object with native numbers, ISO dates and explicit nulls."""
    return df.select(
        F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("json")
    )


def json_array(df: DataFrame, limit: int) -> str:
    """A result of at most ``limit`` rows as one JSON array text, ``[]`` when empty.

    For responses to a caller; a larger result is an error and belongs in ``export``.
    """
    rows = json_rows(df).limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} rows; use export")
    return "[" + ",".join(r["json"] for r in rows) + "]"
