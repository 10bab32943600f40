"""Usage and service levels kept up to date by partial counts of each hour.

Each micro-batch is reduced to counts and sums for each hour, model, status and duration,
and put into a partition of its own number, in the place of what an earlier try of the
same batch has left: so a batch that is run again counts once. Reports add up the
partial counts; as durations are kept with their counts, percentiles are exact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.stats import exact_percentiles
from quarry.operators.usage import generations
from quarry.session import path_exists

KEYS = ("hour", "model", "status", "duration_ms")
PARTIAL = "hour timestamp, model string, status string, duration_ms double, calls long, input_tokens long, output_tokens long, cost decimal(38,7), batch_id long"


def partial_counts(traces: DataFrame) -> DataFrame:
    """A row for each hour, model, status and duration of the model calls among trace records."""
    rows = generations(traces).withColumn("hour", F.date_trunc("hour", "ts")).withColumn("duration_ms", F.col("duration_ms").cast("double"))
    sums = [F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("input_tokens", "output_tokens")]
    return rows.groupBy(*KEYS).agg(F.count("*").alias("calls"), *sums, F.coalesce(F.sum("cost"), F.lit(0)).cast("decimal(38,7)").alias("cost"))


def written(traces: DataFrame, batch_id: int, folder: str) -> None:
    """Puts the partial counts of a batch in the place of those that the batch has written before."""
    partial_counts(traces).withColumn("batch_id", F.lit(batch_id).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(folder)


def kept_up(stream: DataFrame, folder: str, checkpoint: str, every: str = "10 minutes"):
    """A query that writes the partial counts of each micro-batch of a stream of trace records."""
    return stream.writeStream.foreachBatch(lambda rows, batch_id: written(rows, batch_id, folder)).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def merged(spark: SparkSession, folder: str) -> DataFrame:
    """The counts of all batches, with their day."""
    rows = spark.read.schema(PARTIAL).parquet(folder) if path_exists(spark, folder) else spark.createDataFrame([], PARTIAL)
    sums = [F.sum(c).alias(c) for c in ("calls", "input_tokens", "output_tokens")]
    return rows.groupBy(*KEYS).agg(*sums, F.sum("cost").cast("decimal(38,7)").alias("cost")).withColumn("day", F.date_format("hour", "yyyy-MM-dd"))


def usage(counts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, calls, input_tokens, output_tokens, cost), as `usage_by` gives them."""
    sums = [F.sum(c).cast("long").alias(c) for c in ("calls", "input_tokens", "output_tokens")]
    return counts.groupBy(*keys).agg(*sums, F.round(F.sum("cost").cast("decimal(38,7)"), 4).cast("double").alias("cost"))


def sla(counts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, total, ok, availability, p50_ms, p95_ms), as `usage.sla` gives them."""
    total = F.sum("calls")
    sums = counts.groupBy(*keys).agg(total.alias("total"), F.coalesce(F.sum(F.when(F.col("status") == "ok", F.col("calls"))), F.lit(0)).alias("ok"))
    ranks = exact_percentiles(counts, keys, "duration_ms", {"p50_ms": 0.5, "p95_ms": 0.95}, weight="calls")
    return sums.withColumn("availability", F.round(F.col("ok") / F.col("total"), 4)).join(ranks, keys, "left").fillna(0.0, ["p50_ms", "p95_ms"])
