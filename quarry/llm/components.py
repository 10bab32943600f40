"""Connected components of an edge table by alternating star contractions.

Each round is a few joins and aggregations over the remaining edges, so no vertex's
neighbourhood has to fit one task, and the number of rounds grows with the logarithm
of the number of vertices rather than with the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.session import checkpointed


def spread(least: DataFrame) -> DataFrame:
    """Rows dealt out anew, so that a join reads both sides from exchanges of its own: then Spark
    splits the many edges of one vertex among tasks, which it can't above an aggregation."""
    return least.repartition(int(least.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.filter("v > u").join(spread(least), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(spread(least), "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of `edges` (u, v: long): the least node reachable.

    Loops and repeated edges are allowed, an edge with a null end is ignored, and an
    empty table gives an empty one.
    """
    now = checkpointed(edges.select("u", "v").filter("u is not null and v is not null and u <> v").distinct())
    sums = [F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")]
    seen = now.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).agg(*sums).first()
    while seen["n"]:
        now = checkpointed(_small_star(_large_star(now)))
        after = now.agg(*sums).first()
        if after == seen:
            break
        seen = after
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.union(stars.select(F.col("component").alias("node"), "component").distinct())
