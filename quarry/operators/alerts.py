"""Alert rules, deduplication while an alert is open, and the life of an alert."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators.usage import generations

#: The rules' thresholds.
BADCASES_PENDING, DAILY_COST, HOURLY_ERRORS = 5, 10.0, 10


def rule_values(traces: DataFrame, now: Column, badcases_pending: Column | None = None, failed_tasks: Column | None = None) -> DataFrame:
    """One row for each rule: (type, severity, dedupe_key, value, threshold, fires), from one pass over the traces."""
    day, hour = now - F.expr("interval 24 hours"), now - F.expr("interval 1 hour")
    cost = generations(traces.withColumn("_now", now)).agg(F.coalesce(F.sum(F.when(F.col("ts") >= day, F.col("cost"))), F.lit(0)).cast("double").alias("cost"))
    errors = traces.agg(F.count_if((F.col("status") == "error") & (F.col("ts") >= hour)).alias("errors"))
    rule = lambda kind, severity, key, value, threshold: F.struct(F.lit(kind).alias("type"), F.lit(severity).alias("severity"), F.lit(key).alias("dedupe_key"), value.cast("double").alias("value"), F.lit(float(threshold)).alias("threshold"))
    rules = F.array(
        rule("quality", "warning", "quality:badcase-pending", F.lit(0) if badcases_pending is None else badcases_pending, BADCASES_PENDING),
        rule("cost", "warning", "cost:24h", F.col("cost"), DAILY_COST),
        rule("error", "critical", "error:1h", F.col("errors"), HOURLY_ERRORS),
        rule("ingest", "warning", "ingest:failed", F.lit(0) if failed_tasks is None else failed_tasks, 1),
    )
    return cost.crossJoin(errors).select(F.explode(rules).alias("r")).select("r.*", (F.col("r.value") >= F.col("r.threshold")).alias("fires"))


def new_alerts(fired: DataFrame, alerts: DataFrame) -> DataFrame:
    """The fired rows whose dedupe_key no alert that isn't resolved has; one row a key."""
    is_open = alerts.filter("status <> 'resolved'").select("dedupe_key")
    return fired.join(is_open, "dedupe_key", "left_anti").dropDuplicates(["dedupe_key"])


def acknowledged(alerts: DataFrame, alert_id: Column, at: Column) -> DataFrame:
    """Open alerts of the id become acked; others are as they were."""
    hit = (F.col("id") == alert_id) & (F.col("status") == "open")
    return alerts.withColumn("acked_at", F.when(hit, at).otherwise(F.col("acked_at"))).withColumn("status", F.when(hit, "acked").otherwise(F.col("status")))


def resolved(alerts: DataFrame, alert_id: Column, at: Column) -> DataFrame:
    """Alerts of the id that are open or acked become resolved."""
    hit = (F.col("id") == alert_id) & F.col("status").isin("open", "acked")
    return alerts.withColumn("resolved_at", F.when(hit, at).otherwise(F.col("resolved_at"))).withColumn("status", F.when(hit, "resolved").otherwise(F.col("status")))


def replayed(fired: DataFrame, key: str = "dedupe_key", kind: str = "kind", order: tuple[str, ...] = ("ts",)) -> DataFrame:
    """Which of a log's fire events made an alert: those whose key had none open.

    Events of kind `resolve` close a key's alert. A fire event makes one if it is the
    first of its key or the key's last event was a resolve.
    """
    over = f"over (partition by `{key}` order by {', '.join(order)})"
    return fired.withColumn("_before", F.expr(f"lag(`{kind}`) {over}")).filter(f"`{kind}` = 'fire' and coalesce(_before, 'resolve') = 'resolve'").drop("_before")


def sliding_errors(events: DataFrame, size: str = "24 hours", step: str = "10 minutes") -> DataFrame:
    """(window_start, window_end, errors): errors in trailing windows, for batch and stream alike."""
    counted = events.filter("status = 'error'").groupBy(F.window("ts", size, step)).agg(F.count("*").alias("errors"))
    return counted.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "errors")


def open_count(alerts: DataFrame) -> DataFrame:
    return alerts.agg(F.count_if(F.col("status") == "open").alias("open"))


def matching(alerts: DataFrame, status: str | None = None, kind: str | None = None, severity: str | None = None, limit: int = 100) -> DataFrame:
    """Alerts that meet all conditions given, newest first, 1 to 500 of them: a page is the feature."""
    for name, value in (("status", status), ("type", kind), ("severity", severity)):
        alerts = alerts if value is None else alerts.filter(F.col(name) == value)
    return alerts.orderBy(F.desc("created_at"), F.desc("id")).limit(max(1, min(limit, 500)))
