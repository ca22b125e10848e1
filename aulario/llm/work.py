"""The folder shared by driver and executors, and tables written there to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """A new path below the folder that `spark.checkpoint.dir` names.

    Where it is unset, a local master gets a folder of its own for the session (as in tests); a cluster gets an error.
    """
    root = spark.conf.get(CHECKPOINT_DIR, None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_DIR} to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="aulario-llm-")
        spark.conf.set(CHECKPOINT_DIR, root)
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def unused(columns: list[str], *names: str) -> list[str]:
    """The names with underscores added until no column is called so, in any case."""
    taken, found = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        found.append(name)
    return found


def written(df: DataFrame) -> DataFrame:
    """The rows of `df`, written once as Parquet in the shared folder and read back with the same schema."""
    spark = df.sparkSession
    path = shared_folder(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
