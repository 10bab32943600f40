"""Usage, service levels and alerts over the table `events`, read as trace records.

An event stands for a model call: name and model are its type, its value is the duration,
props.k its output tokens, and the type `error` its failed status. `now` is the time of
the last event.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import alerts, stats, tables, traces, usage
from quarry.session import shared_folder, table
from quarry.streaming import rollups


def trace_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").cast("string").alias("id"), "event_id", F.col("ts").cast("timestamp").alias("ts"), F.concat(F.lit("retrieval:"), "event_type").alias("name"), F.lit("generation").alias("kind"),
        F.when(F.col("event_type") == "error", "error").otherwise("ok").alias("status"), F.col("value").alias("duration_ms"), "event_type", "user_id", "props",
        F.when(F.col("event_type") == "view", "qwen-plus").when(F.col("event_type") == "click", "gpt-4o").otherwise(F.col("event_type")).alias("model"),
        F.lit(100).cast("long").alias("input_tokens"), F.get_json_object("props", "$.k").cast("long").alias("output_tokens"),
    )


def _now(rows: DataFrame) -> Column:
    return F.lit(rows.agg(F.max("ts")).first()[0])


def sla_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.sla(trace_table(spark, sf_dir), [])


def sla_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = trace_table(spark, sf_dir).withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    return usage.sla(rows, ["day"])


def usage_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.usage(trace_table(spark, sf_dir))


def usage_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.cost_per_thousand(usage.usage_by(trace_table(spark, sf_dir), ["model"]))


def usage_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.relative_bars(usage.usage_by(trace_table(spark, sf_dir), ["day"]), "output_tokens").withColumn("bar", F.round("bar", 6))


def usage_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.overview(trace_table(spark, sf_dir))


def viewer_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of the last thousand records."""
    return usage.viewer_totals(trace_table(spark, sf_dir), 1_000)


def usage_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.usage_table(trace_table(spark, sf_dir)).select("day", "model", "calls", "cost", "place", "cost_place")


def sla_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`sla_daily` from partial counts of each hour, written by four batches of which one comes twice."""
    rows = trace_table(spark, sf_dir)
    folder = f"{shared_folder(spark)}/rollup-{uuid.uuid4().hex}"
    for batch in (0, 1, 2, 1, 3):
        rollups.written(rows.filter(F.col("event_id") % 4 == batch), batch, folder)
    return rollups.sla(rollups.merged(spark, folder), ["day"])


def usage_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usage of each model from such partial counts."""
    rows = trace_table(spark, sf_dir)
    folder = f"{shared_folder(spark)}/rollup-{uuid.uuid4().hex}"
    for batch in (0, 1, 0):
        rollups.written(rows.filter(F.col("event_id") % 2 == batch), batch, folder)
    return rollups.usage(rollups.merged(spark, folder), ["model"])


def top_cost_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.top_queries(trace_table(spark, sf_dir), F.col("user_id").cast("string"), 10)


def stage_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.stage_stats(trace_table(spark, sf_dir))


def latency_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trace_table(spark, sf_dir).groupBy("event_type").agg(*stats.histogram(F.col("duration_ms"), [1.0, 5.0, 10.0, 50.0, 100.0]), F.count("*").alias("n"))


def load_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.exact_percentiles(trace_table(spark, sf_dir), ["event_type"], "duration_ms", {"p50": 0.5, "p95": 0.95, "p99": 0.99})


def trace_filter_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = traces.filtered(trace_table(spark, sf_dir), status="error", day_from="2024-01-05", day_to="2024-01-20", keyword='"K": 1', searched=F.col("props"))
    return rows.orderBy(F.desc("event_id")).offset(20).limit(20).select("event_id", "event_type", "props")


def cost_last_24h(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = trace_table(spark, sf_dir)
    return usage.cost_since(rows, _now(rows) - F.expr("interval 24 hours"))


def errors_last_1h(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = trace_table(spark, sf_dir)
    return usage.errors_since(rows, _now(rows) - F.expr("interval 1 hour"))


def named_events_7d(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = trace_table(spark, sf_dir)
    return usage.named_events(rows, "retrieval:signup", _now(rows) - F.expr("interval 7 days"))


def alert_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = trace_table(spark, sf_dir)
    return alerts.rule_values(rows, _now(rows)).select("type", "severity", "dedupe_key", F.round("value", 4).alias("value"), "threshold", "fires")


def alert_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors fire an alert of their user, a purchase resolves it."""
    events = table(spark, sf_dir, "events").filter("event_type in ('error', 'purchase')")
    kind = F.when(F.col("event_type") == "error", "fire").otherwise("resolve")
    rows = events.select(F.col("user_id").alias("dedupe_key"), kind.alias("kind"), "ts", "event_id")
    return alerts.replayed(rows, order=("ts", "event_id")).select("dedupe_key", "event_id")


def alert_insert_if_closed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of the last day against alerts of earlier errors, of which those of even users are resolved."""
    events = table(spark, sf_dir, "events").filter("event_type = 'error'")
    day = F.to_date(F.lit(events.agg(F.max("ts")).first()[0]))
    fired = events.filter(F.to_date("ts") == day).select(F.col("user_id").cast("string").alias("dedupe_key"))
    old = events.filter(F.to_date("ts") == F.date_sub(day, 1)).select(F.col("user_id").cast("string").alias("dedupe_key"), F.when(F.col("user_id") % 2 == 0, "resolved").otherwise("open").alias("status")).distinct()
    return alerts.new_alerts(fired, old)


def alert_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = alerts.sliding_errors(trace_table(spark, sf_dir), "24 hours", "6 hours")
    return rows.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "errors")


def exclusive_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order 7 becomes the only active one of its status."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", (F.col("o_orderkey") % 2).cast("int").alias("is_active"))
    return tables.exclusive_flag(orders, "o_orderkey", "o_orderstatus", F.lit(7))


QUERIES = {
    f.__name__: f
    for f in (
        sla_summary, sla_daily, usage_summary, usage_by_type, usage_daily, usage_overview, viewer_totals, usage_ordered, sla_rollup, usage_rollup, top_cost_users, stage_stats, latency_histogram, load_percentiles, trace_filter_page,
        cost_last_24h, errors_last_1h, named_events_7d, alert_rules, alert_dedupe, alert_insert_if_closed, alert_sliding, exclusive_flag,
    )
}

_T = """t AS (SELECT event_id, ts, event_type, user_id, props, value, 'retrieval:' || event_type AS name, CASE WHEN event_type = 'error' THEN 'error' ELSE 'ok' END AS status,
  CASE event_type WHEN 'view' THEN 'qwen-plus' WHEN 'click' THEN 'gpt-4o' ELSE event_type END AS model, strftime(ts, '%Y-%m-%d') AS day,
  CAST(json_extract(props, '$.k') AS BIGINT) AS k,
  (100 * CASE event_type WHEN 'view' THEN 0.004 WHEN 'click' THEN 0.01 ELSE 0.005 END + CAST(json_extract(props, '$.k') AS BIGINT) * CASE event_type WHEN 'view' THEN 0.012 WHEN 'click' THEN 0.03 ELSE 0.015 END) * 0.001 AS cost FROM events)"""
_PCT = "CAST(round(list_sort(list(value))[CAST(least(count(*), floor(count(*) * {p}) + 1) AS BIGINT)], 1) AS DOUBLE)"
_P50, _P95, _P99 = (_PCT.format(p=p) for p in (0.5, 0.95, 0.99))
_SUMS = "count(*) AS calls, CAST(count(*) * 100 AS BIGINT) AS input_tokens, CAST(sum(k) AS BIGINT) AS output_tokens, CAST(round(sum(cost), 4) AS DOUBLE) AS cost"
_SLA = f"count(*) AS total, count(*) FILTER (status = 'ok') AS ok, round(count(*) FILTER (status = 'ok') / count(*), 4) AS availability, {_P50} AS p50_ms, {_P95} AS p95_ms"

ORACLE_SQL = {
    "sla_summary": f"WITH {_T} SELECT {_SLA} FROM t",
    "sla_daily": f"WITH {_T} SELECT day, {_SLA} FROM t GROUP BY day",
    "usage_summary": f"WITH {_T} SELECT CASE grouping(model, day) WHEN 1 THEN 'model' WHEN 2 THEN 'day' ELSE 'all' END AS level, model, day, {_SUMS} FROM t GROUP BY GROUPING SETS ((model), (day), ())",
    "viewer_totals": f"WITH {_T} SELECT count(*) AS records, CAST(count(*) * 100 AS BIGINT) AS input_tokens, CAST(coalesce(sum(k), 0) AS BIGINT) AS output_tokens FROM (SELECT * FROM t ORDER BY ts DESC, CAST(event_id AS VARCHAR) DESC LIMIT 1000)",
    "usage_ordered": f"WITH {_T} SELECT day, model, calls, cost, CAST(row_number() OVER (ORDER BY day, cost DESC, model) AS INTEGER) AS place, CAST(row_number() OVER (ORDER BY cost DESC, model, day) AS INTEGER) AS cost_place FROM (SELECT day, model, {_SUMS} FROM t GROUP BY day, model)",
    "sla_rollup": f"WITH {_T} SELECT day, {_SLA} FROM t GROUP BY day",
    "usage_rollup": f"WITH {_T} SELECT model, {_SUMS} FROM t GROUP BY model",
    "usage_by_type": f"WITH {_T} SELECT *, round(cost / calls * 1000, 4) AS cost_per_1000, input_tokens + output_tokens AS total_tokens FROM (SELECT model, {_SUMS} FROM t GROUP BY model)",
    "usage_daily": f"WITH {_T} SELECT *, round(output_tokens / max(output_tokens) OVER (), 6) AS bar FROM (SELECT day, {_SUMS} FROM t GROUP BY day)",
    "usage_overview": f"WITH {_T} SELECT count(*) AS generations, CAST(0 AS BIGINT) AS tool_calls, CAST(count(*) * 100 AS BIGINT) AS input_tokens, CAST(sum(k) AS BIGINT) AS output_tokens, count(*) FILTER (status <> 'ok') AS errors FROM t",
    "top_cost_users": f"WITH {_T} SELECT * FROM (SELECT CAST(user_id AS VARCHAR) AS query, {_SUMS} FROM t GROUP BY 1) ORDER BY cost DESC, query LIMIT 10",
    "stage_stats": f"WITH {_T} SELECT name, count(*) AS n, round(avg(value), 1) AS avg_ms, {_P95} AS p95_ms FROM t GROUP BY name",
    "latency_histogram": "SELECT event_type, " + ", ".join(f"count(*) FILTER (value <= {b}) AS le_{str(b).replace('.', '_')}" for b in (1.0, 5.0, 10.0, 50.0, 100.0)) + ", count(*) AS n FROM events GROUP BY event_type",
    "load_percentiles": f"SELECT event_type, {_P50} AS p50, {_P95} AS p95, {_P99} AS p99 FROM events GROUP BY event_type",
    "trace_filter_page": f"WITH {_T} SELECT event_id, event_type, props FROM t WHERE status = 'error' AND day BETWEEN '2024-01-05' AND '2024-01-20' AND contains(lower(props), '\"k\": 1') ORDER BY event_id DESC LIMIT 20 OFFSET 20",
    "cost_last_24h": f"WITH {_T} SELECT CAST(round(sum(cost), 4) AS DOUBLE) AS cost FROM t WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 24 HOUR",
    "errors_last_1h": f"WITH {_T} SELECT count(*) AS errors FROM t WHERE status = 'error' AND ts >= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR",
    "named_events_7d": f"WITH {_T} SELECT count(*) AS n FROM t WHERE name = 'retrieval:signup' AND ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY",
    "alert_rules": f"""WITH {_T}, n AS (SELECT max(ts) AS now FROM t),
      v AS (SELECT coalesce(round(CAST(sum(cost) FILTER (ts >= now - INTERVAL 24 HOUR) AS DOUBLE), 4), 0) AS cost, CAST(count(*) FILTER (status = 'error' AND ts >= now - INTERVAL 1 HOUR) AS DOUBLE) AS errors FROM t, n)
      SELECT 'quality' AS type, 'warning' AS severity, 'quality:badcase-pending' AS dedupe_key, 0.0::DOUBLE AS value, 5.0::DOUBLE AS threshold, false AS fires
      UNION ALL SELECT 'cost', 'warning', 'cost:24h', cost, 10.0, cost >= 10 FROM v UNION ALL SELECT 'error', 'critical', 'error:1h', errors, 10.0, errors >= 10 FROM v
      UNION ALL SELECT 'ingest', 'warning', 'ingest:failed', 0.0, 1.0, false""",
    "alert_dedupe": """SELECT user_id AS dedupe_key, event_id FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events WHERE event_type IN ('error', 'purchase'))
      WHERE event_type = 'error' AND coalesce(before, 'purchase') = 'purchase'""",
    "alert_insert_if_closed": """WITH e AS (SELECT *, CAST(ts AS DATE) AS d FROM events WHERE event_type = 'error'), m AS (SELECT max(d) AS d FROM e)
      SELECT DISTINCT CAST(user_id AS VARCHAR) AS dedupe_key FROM e WHERE d = (SELECT d FROM m) AND user_id NOT IN (SELECT user_id FROM e WHERE d = (SELECT d FROM m) - 1 AND user_id % 2 <> 0)""",
    "alert_sliding": """WITH b AS (SELECT time_bucket(INTERVAL 6 HOUR, ts) AS w, count(*) AS c FROM events WHERE event_type = 'error' GROUP BY 1)
      SELECT w - to_hours(6 * CAST(i AS INTEGER)) AS window_start, CAST(sum(c) AS BIGINT) AS errors FROM b, range(4) r(i) GROUP BY 1""",
    "exclusive_flag": "SELECT o_orderkey, o_orderstatus, CAST(CASE WHEN o_orderstatus = (SELECT o_orderstatus FROM orders WHERE o_orderkey = 7) THEN (o_orderkey = 7)::INT ELSE o_orderkey % 2 END AS INTEGER) AS is_active FROM orders",
}
