"""Loading the tables."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aulario.sources.schemas import SCHEMAS
from aulario.tables import MONTH, Tables

# Compares text without regard to case and accents.
FOLDING_COLLATION = "UNICODE_CI_AI"


def _folded(df: DataFrame, collation: str | None) -> DataFrame:
    if collation is None:
        return df
    return df.select(
        *[
            F.collate(F.col(f.name), collation).alias(f.name)
            if isinstance(f.dataType, T.StringType)
            else F.col(f.name)
            for f in df.schema
        ]
    )


def load_tables(
    spark: SparkSession,
    path: str,
    fmt: str = "parquet",
    collation: str | None = None,
    monthly: bool = False,
) -> Tables:
    """Read ``path/<table>`` with the declared schemas; nothing is inferred.

    ``fmt`` is parquet, orc, json or csv. With ``collation`` the text columns compare
    and sort by it, e.g. ``FOLDING_COLLATION``. With ``monthly`` date-bound reports read only
    the months they need of a snapshot partitioned by month.
    """

    def one(name: str, schema: T.StructType) -> DataFrame:
        reader = spark.read.format(fmt)
        if fmt == "csv":
            reader = reader.option("header", "true")
        return _folded(reader.schema(schema).load(f"{path}/{name}").select(*schema.names), collation)

    with_month = T.StructType([*SCHEMAS["reserva"], T.StructField(MONTH, T.StringType())])
    return Tables(
        reserva_mensual=partial(one, "reserva", with_month) if monthly else None,
        **{name: partial(one, name, schema) for name, schema in SCHEMAS.items()},
    )


def load_catalog(spark: SparkSession, database: str) -> Tables:
    """Tables saved in the catalog, with the bucketing they were saved with."""
    return Tables(**{name: partial(spark.table, f"{database}.{name}") for name in SCHEMAS})


def load_jdbc(
    spark: SparkSession,
    url: str,
    properties: dict[str, str],
    splits: dict[str, tuple[str, int, int, int]],
) -> Tables:
    """Read the tables from a relational database.

    ``splits`` maps a table to (numeric column, lower, upper, partitions); such a table is
    read by that many parallel range queries instead of one. It must name the tables that
    grow, bookings and participations.
    """
    missing = {"reserva", "reserva_participante"} - set(splits)
    if missing:
        raise ValueError(f"splits needed for {', '.join(sorted(missing))}")


    def one(name: str, schema: T.StructType) -> DataFrame:
        reader = spark.read.format("jdbc").option("url", url).option("dbtable", name)
        for key, value in properties.items():
            reader = reader.option(key, value)
        if name in splits:
            column, lower, upper, parts = splits[name]
            reader = (
                reader.option("partitionColumn", column)
                .option("lowerBound", lower)
                .option("upperBound", upper)
                .option("numPartitions", parts)
            )
        df = reader.load()
        return df.select(
            *[
                (
                    F.date_format(F.col(f.name).cast("timestamp"), "HH:mm:ss")
                    if f.name in ("hora_inicio", "hora_fin")
                    else F.col(f.name).cast(f.dataType)
                ).alias(f.name)
                for f in schema
            ]
        )

    return Tables(**{name: partial(one, name, schema) for name, schema in SCHEMAS.items()})
