"""Trace logs: JSON lines read as a table, filtered pages, masked records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.text import mask_pii

RECORD = "id string, ts string, name string, kind string, status string, duration_ms double, model string, kb string, input string, output string, usage struct<input: bigint, output: bigint>, _bad string"


def read_traces(spark: SparkSession, path: str, tail: int | None = None) -> DataFrame:
    """Records of JSON lines at `path`; lines that don't parse are left out.

    Text files have no line numbers in Spark, so `tail` takes the newest records by time.
    """
    lines = spark.read.text(path)
    parsed = lines.select(F.from_json("value", RECORD, {"columnNameOfCorruptRecord": "_bad"}).alias("r")).select("r.*").filter("_bad is null")
    rows = parsed.select(
        "id", F.try_to_timestamp(F.substring("ts", 1, 19), F.lit("yyyy-MM-dd HH:mm:ss")).alias("ts"), "name", "kind", "status", "duration_ms",
        F.coalesce("model", F.lit("unknown")).alias("model"), "kb", "input", "output", F.coalesce("usage.input", F.lit(0)).alias("input_tokens"), F.coalesce("usage.output", F.lit(0)).alias("output_tokens"),
    )
    return rows if tail is None else rows.orderBy(F.desc_nulls_last("ts"), F.desc("id")).limit(tail)


def write_traces(traces: DataFrame, path: str, max_records: int = 500_000) -> None:
    """Appends records as JSON lines with personal data masked, so many in a file at most."""
    masked_traces(traces).write.mode("append").option("maxRecordsPerFile", max_records).json(path)


def masked_traces(traces: DataFrame) -> DataFrame:
    """String columns input and output masked."""
    return traces.withColumns({c: mask_pii(F.col(c)) for c in ("input", "output") if c in traces.columns})


def filtered(traces: DataFrame, kind: str | None = None, status: str | None = None, kb: str | None = None, day_from: str | None = None, day_to: str | None = None, keyword: str | None = None, searched: Column | None = None) -> DataFrame:
    """Records that meet all the conditions given; the keyword is sought without regard to case."""
    day = F.date_format("ts", "yyyy-MM-dd")
    conditions = [
        kind and F.col("kind") == kind,
        status and F.col("status") == status,
        kb and F.col("kb") == kb,
        day_from and day >= day_from,
        day_to and day <= day_to,
        keyword and F.contains(F.lower(F.col("input") if searched is None else searched), F.lit(keyword.lower())),
    ]
    for condition in conditions:
        if isinstance(condition, Column):
            traces = traces.filter(condition)
    return traces


def page(rows: DataFrame, order: list[Column], number: int, size: int) -> tuple[DataFrame, int]:
    """(rows of the page, from 1, and the number of all rows)."""
    return rows.orderBy(*order).offset((number - 1) * size).limit(size), rows.count()


def audit_events(events: DataFrame, actor: str | None = None, action: str | None = None, since: Column | None = None, until: Column | None = None, limit: int = 5_000) -> DataFrame:
    """Audit events that meet all conditions given, newest first, 1 to 5000 of them: a page is the feature."""
    conditions = [actor and F.col("actor") == actor, action and F.col("action") == action, None if since is None else F.col("created_at") >= since, None if until is None else F.col("created_at") <= until]
    for condition in conditions:
        if isinstance(condition, Column):
            events = events.filter(condition)
    return events.orderBy(F.desc("created_at"), F.desc("id")).limit(max(1, min(limit, 5_000)))
