"""Versions of the state that share what did not change.

A version is a folder with a manifest: one row (tabla, mes, carpeta) for each table, or for each month of a table that
is stored by month, naming the folder its rows lie in. The next version writes only the tables a change touched, and of
those stored by month only the months that rows left or entered; its manifest names the folders of earlier versions for
all others. Files are never changed, so every version stays readable as long as the folders it names exist.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from aulario.operators.changes import ChangeResult
from aulario.session import cut
from aulario.sources.schemas import SCHEMAS
from aulario.tables import MONTH, Tables

#: Tables stored by month, with the date that tells it.
BY_MONTH = {
    "reserva": "fecha",
    "reserva_participante": "fecha_solicitud_reserva",
    "sancion_participante": "fecha_inicio",
}
#: The month of rows without a date.
NO_MONTH = "sin-fecha"
MANIFEST = "manifiesto"
_FILED = "tabla string, mes string, carpeta string"

Filed = tuple[str, str | None, str]


def _month(table: str) -> Column:
    return F.coalesce(F.date_format(BY_MONTH[table], "yyyy-MM"), F.lit(NO_MONTH))


def _months(rows: DataFrame, table: str) -> set[str]:
    return {r[0] for r in rows.select(_month(table)).distinct().collect()}


def _write_table(df: DataFrame, table: str, path: str, files_per_month: int) -> list[Filed]:
    """Write all rows below ``path/<table>`` and say where they lie."""
    folder = f"{path}/{table}"
    if table not in BY_MONTH:
        df.write.mode("errorifexists").parquet(folder)
        return [(table, None, folder)]
    # Rows of a month are dealt to a few files; a month with very many rows is not one task's.
    salt = F.pmod(F.xxhash64(*df.columns), F.lit(files_per_month))
    dated = df.withColumn(MONTH, _month(table))
    dated.repartition(MONTH, salt).write.mode("errorifexists").partitionBy(MONTH).parquet(folder)
    stored = dated.sparkSession.read.schema(dated.schema).parquet(folder)
    return [(table, month, f"{folder}/{MONTH}={month}") for month in sorted(_stored_months(stored))]


def _stored_months(stored: DataFrame) -> set[str]:
    """Values of the partition column: read from the names of the folders."""
    return {r[0] for r in stored.select(MONTH).distinct().collect()}


def _write_manifest(spark: SparkSession, filed: Iterable[Filed], path: str) -> None:
    spark.createDataFrame(sorted(filed, key=repr), _FILED).coalesce(1).write.mode("errorifexists").json(
        f"{path}/{MANIFEST}"
    )


def manifest(spark: SparkSession, path: str) -> list[Filed]:
    """(table, month or None, folder) of a version; a row for each table and stored month."""
    return [tuple(r) for r in spark.read.schema(_FILED).json(f"{path}/{MANIFEST}").collect()]


def _open(spark: SparkSession, table: str, folders: list[str]) -> DataFrame:
    schema = SCHEMAS[table]
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*folders).select(*schema.names)


def load_version(spark: SparkSession, path: str) -> Tables:
    """The tables of a version."""
    filed = manifest(spark, path)
    return Tables(
        **{name: partial(_open, spark, name, [f for t, _, f in filed if t == name]) for name in SCHEMAS}
    )


def write_version(tables: Tables, path: str, files_per_month: int = 4) -> None:
    """Write all tables as the first version, under a new ``path``."""
    filed: list[Filed] = []
    spark = None
    for name, df in tables.items():
        spark = df.sparkSession
        filed += _write_table(_shaped(df, name), name, path, files_per_month)
    _write_manifest(spark, filed, path)


def _shaped(df: DataFrame, table: str) -> DataFrame:
    return df.select(*[F.col(f.name).cast(f.dataType) for f in SCHEMAS[table]])


def write_next_version(result: ChangeResult, previous: str, path: str, files_per_month: int = 4) -> None:
    """Write the state after a change to the version ``previous`` as a version of its own, under a new ``path``.

    Of a table stored by month the rows that changed are found by their keys. The months they lay in or lie in now are
    read again without them, and written together with what they have become.
    """
    spark = result.accepted.sparkSession
    filed = manifest(spark, previous)
    before = load_version(spark, previous)
    kept = [entry for entry in filed if entry[0] not in result.touched]
    for table, named in result.touched.items():
        after = _shaped(getattr(result.tables, table), table)
        if table not in BY_MONTH:
            kept += _write_table(after, table, path, files_per_month)
            continue
        keys = cut(named.distinct())
        left = getattr(before, table).join(keys, keys.columns, "left_semi")
        entered = cut(after.join(keys, keys.columns, "left_semi"))
        months = _months(left, table) | _months(entered, table)
        own = [entry for entry in filed if entry[0] == table]
        kept += [entry for entry in own if entry[1] not in months]
        if months:
            stay = _open(spark, table, [f for _, month, f in own if month in months])
            stay = stay.join(keys, keys.columns, "left_anti")
            kept += _write_table(stay.unionByName(entered), table, path, files_per_month)
    _write_manifest(spark, kept, path)
