"""Aggregate expressions shared by the analytics jobs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.session import checkpointed


def exact_percentiles(rows: DataFrame, keys: list[str], value: str, ps: dict[str, float], weight: str | None = None) -> DataFrame:
    """(keys, one column for each percentile): the element at floor(n * p) of a group's sorted values (the last one
    at most), rounded to 1 digit. It differs from `percentile_disc`: of 10, 20, 30, 40 the 0.5 one is 30.

    Different values are counted and dealt out by ranges of (keys, value), so that neither a
    large group nor all rows meet in one task; a range learns from the ranges' sums how many
    values lie before it. Only a row for each range and key is summed up in order. A row
    stands for `weight` values where that column is named, else for one.
    """
    ranges = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_value")).agg((F.count("*") if weight is None else F.sum(weight)).alias("_n"))
    counts = checkpointed(counts.repartitionByRange(ranges, *keys, "_value").withColumn("_range", F.spark_partition_id()))
    sums = counts.groupBy(*keys, "_range").agg(F.sum("_n").alias("_sum"))
    own = Window.partitionBy(*keys)
    before = F.coalesce(F.sum("_sum").over(own.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = sums.withColumns({"_before": before, "_all": F.sum("_sum").over(own)}).drop("_sum")
    names = [*keys, "_range"]
    placed = placed.select(*[F.col(f"`{k}`").alias(f"_k{i}") for i, k in enumerate(names)], "_before", "_all")
    same = reduce(lambda x, y: x & y, [F.col(f"`{k}`").eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(names)])
    upto = F.sum("_n").over(Window.partitionBy(*names).orderBy("_value")) + F.col("_before")
    ranked = counts.join(placed, same).withColumn("_upto", upto)
    picked = [F.round(F.min(F.when(F.col("_upto") > F.least(F.col("_all") - 1, F.floor(F.col("_all") * F.lit(p)).cast("long")), F.col("_value"))), 1).alias(name) for name, p in ps.items()]
    return ranked.groupBy(*keys).agg(*picked)


def load_summary(requests: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, errors, qps) of requests (ts, status): requests for each second from the first to the last one, 0 within
    the same moment."""
    seconds = (F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))) / 1_000_000
    rate = F.when(seconds > 0, F.round(F.count("*") / seconds, 4)).otherwise(0.0)
    return requests.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(F.col("status") != "ok").alias("errors"), rate.alias("qps"))


def histogram(value: Column, bounds: list[float]) -> list[Column]:
    """Cumulative counts of values up to each bound, as a metrics histogram has them."""
    return [F.count_if(value <= F.lit(b)).alias(f"le_{str(b).replace('.', '_')}") for b in bounds]
