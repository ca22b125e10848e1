"""Connected components of a link table, by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aulario.llm.work import written


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of `links` (a, b): nodes have the same root if links join them.

    In each round every node moves to the neighbour (or itself) of least rank, ranks being hashes that change with
    the round; links are renamed and those within one place go. The number of places falls by a constant share per
    round, chains and stars included. A hub's neighbours are reduced by aggregation, and each round is written, so
    that the renaming joins read tables and a hub's links can be split over tasks.

    Null ends and links of a node to itself join nothing and are left out. An empty table gives an empty table.
    """
    left = written(links.where("a is not null and b is not null and a <> b").select("a", "b").distinct())
    place: DataFrame | None = None
    turn = 0
    while not left.isEmpty():
        both = left.union(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = lambda c: F.struct(F.xxhash64(c, F.lit(turn)).alias("rank"), F.col(c).alias("node"))
        best = both.groupBy("a").agg(F.min(rank("b")).alias("near"), F.min(rank("a")).alias("own"))
        moved = written(best.select(F.col("a").alias("old"), F.least("near", "own")["node"].alias("new")))
        to = lambda df, c: df.join(moved.withColumnRenamed("old", c), c).drop(c).withColumnRenamed("new", c)
        if place is None:
            place = moved.select(F.col("old").alias("node"), F.col("new").alias("root"))
        else:
            further = moved.withColumnRenamed("old", "root")
            place = written(
                place.join(further, "root", "left").select("node", F.coalesce("new", "root").alias("root"))
            )
        left = written(to(to(left, "a"), "b").where("a <> b").select("a", "b").distinct())
        turn += 1
    if place is None:
        return left.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return place
