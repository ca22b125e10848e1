from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import SparkSession

from aulario.sources.readers import load_tables
from aulario.sources.seed import seed_tables
from aulario.sources.writers import write_snapshot

TODAY = dt.date(2026, 12, 1)


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .appName("aulario-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def seed(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("seed") / "snapshot")
    tables = seed_tables(spark, TODAY)
    one_file = {name: df.coalesce(1) for name, df in tables.items()}
    write_snapshot(tables.with_tables(**one_file), path)
    return load_tables(spark, path)


def rows(df) -> list[tuple]:
    return [tuple(r) for r in df.collect()]


def frame(spark, data: list[tuple], schema: str):
    """A small local table in one partition."""
    return spark.createDataFrame(data, schema).coalesce(1)
