"""Usage, cost and service levels over a table of trace records.

A trace record has ts, name, kind, status, duration_ms, model, input_tokens and
output_tokens; `now` is a parameter, never the clock.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.stats import exact_percentiles

#: Price for 1000 tokens of input and of output.
PRICES = {
    "qwen-plus": (0.004, 0.012),
    "qwen-turbo": (0.002, 0.006),
    "qwen-max": (0.02, 0.06),
    "qwen-flash": (0.001, 0.003),
    "gpt-4o": (0.01, 0.03),
    "gpt-4o-mini": (0.0006, 0.0024),
}
DEFAULT_PRICE = (0.005, 0.015)


def cost(model: Column, input_tokens: Column, output_tokens: Column, prices: dict[str, tuple[float, float]] | None = None) -> Column:
    """Cost of a call as DECIMAL(38, 7), so that sums don't depend on their order."""
    dec = lambda x: F.lit(repr(x)).cast("decimal(10,4)")
    rate_in, rate_out = dec(DEFAULT_PRICE[0]), dec(DEFAULT_PRICE[1])
    for name, (a, b) in (prices or PRICES).items():
        rate_in, rate_out = F.when(model == name, dec(a)).otherwise(rate_in), F.when(model == name, dec(b)).otherwise(rate_out)
    return ((F.coalesce(input_tokens, F.lit(0)).cast("decimal(18,0)") * rate_in + F.coalesce(output_tokens, F.lit(0)).cast("decimal(18,0)") * rate_out) * F.lit("0.001").cast("decimal(4,3)")).cast("decimal(38,7)")


def _sums() -> list[Column]:
    return [
        F.count("*").alias("calls"),
        F.coalesce(F.sum("input_tokens"), F.lit(0)).cast("long").alias("input_tokens"),
        F.coalesce(F.sum("output_tokens"), F.lit(0)).cast("long").alias("output_tokens"),
        F.round(F.coalesce(F.sum("cost"), F.lit(0)).cast("decimal(38,7)"), 4).cast("double").alias("cost"),
    ]


def generations(traces: DataFrame, since: Column | None = None) -> DataFrame:
    """Model calls with their cost and day, those before `since` and without a time left out."""
    rows = traces.filter((F.col("kind") == "generation") & F.col("ts").isNotNull())
    rows = rows if since is None else rows.filter(F.col("ts") >= since)
    return rows.withColumn("cost", cost(F.col("model"), F.col("input_tokens"), F.col("output_tokens"))).withColumn("day", F.date_format("ts", "yyyy-MM-dd"))


def usage(traces: DataFrame, since: Column | None = None) -> DataFrame:
    """One row for each model, each day and all: (level, model, day, calls, tokens, cost) in one pass."""
    rows = generations(traces, since)
    grouped = rows.groupingSets([["model"], ["day"], []], "model", "day").agg(F.grouping_id().alias("gid"), *_sums())
    level = F.when(F.col("gid") == 1, "model").when(F.col("gid") == 2, "day").otherwise("all")
    return grouped.select(level.alias("level"), "model", "day", "calls", "input_tokens", "output_tokens", "cost")


def usage_by(traces: DataFrame, keys: list[str], since: Column | None = None) -> DataFrame:
    return generations(traces, since).groupBy(*keys).agg(*_sums())


def top_queries(traces: DataFrame, query: Column, limit: int = 10, since: Column | None = None) -> DataFrame:
    """The costliest queries: the excerpt of the last user message names one; ties by name."""
    rows = generations(traces, since).withColumn("query", F.substring(F.trim(query), 1, 80)).filter("query <> ''")
    return rows.groupBy("query").agg(*_sums()).orderBy(F.desc("cost"), "query").limit(max(1, min(limit, 50)))


def overview(traces: DataFrame) -> DataFrame:
    """Calls, tokens, tool calls and errors (any status but ok, missing ones too)."""
    generation = F.col("kind") == "generation"
    return traces.agg(
        F.count_if(generation).alias("generations"),
        F.count_if(F.col("name").startswith("tool:")).alias("tool_calls"),
        F.coalesce(F.sum(F.when(generation, F.col("input_tokens"))), F.lit(0)).cast("long").alias("input_tokens"),
        F.coalesce(F.sum(F.when(generation, F.col("output_tokens"))), F.lit(0)).cast("long").alias("output_tokens"),
        F.count_if(F.coalesce(F.col("status") != "ok", F.lit(True))).alias("errors"),
    )


def viewer_totals(traces: DataFrame, n: int = 20) -> DataFrame:
    """One row: how many of the last n records there are, and the tokens of those of them that are model calls."""
    last = traces.orderBy(F.desc("ts"), F.desc("id")).limit(n)
    tokens = lambda c: F.coalesce(F.sum(F.when(F.col("kind") == "generation", F.col(c))), F.lit(0)).cast("long").alias(c)
    return last.agg(F.count("*").alias("records"), tokens("input_tokens"), tokens("output_tokens"))


def usage_table(traces: DataFrame, since: Column | None = None) -> DataFrame:
    """Usage by day and model with two orders: `place` by day, within a day the costliest first, and `cost_place` the
    costliest first of all; ties by model and day."""
    rows = usage_by(traces, ["day", "model"], since)  # a row for each day and model
    place = F.row_number().over(Window.orderBy("day", F.desc("cost"), "model"))
    return rows.withColumn("place", place).withColumn("cost_place", F.row_number().over(Window.orderBy(F.desc("cost"), "model", "day")))


def recent_days(traces: DataFrame, days: int = 7) -> DataFrame:
    """(day, input_tokens, output_tokens) of the last days that have model calls."""
    return usage_by(traces, ["day"]).select("day", "input_tokens", "output_tokens").orderBy(F.desc("day")).limit(days)


def last_user_message(messages: Column) -> Column:
    """The content of the last message of role user in a JSON list of messages (role, content), or null."""
    own = F.filter(F.from_json(messages, "array<struct<role: string, content: string>>"), lambda m: m["role"] == "user")
    return F.get(own, F.size(own) - 1)["content"]


def cost_since(traces: DataFrame, since: Column) -> DataFrame:
    return generations(traces, since).agg(F.round(F.coalesce(F.sum("cost"), F.lit(0)).cast("decimal(38,7)"), 4).cast("double").alias("cost"))


def errors_since(traces: DataFrame, since: Column) -> DataFrame:
    """Records whose status is error, another meaning than that of `overview`."""
    return traces.filter((F.col("status") == "error") & (F.col("ts") >= since)).agg(F.count("*").alias("errors"))


def named_events(traces: DataFrame, name: str, since: Column) -> DataFrame:
    return traces.filter((F.col("name") == name) & (F.col("ts") >= since)).agg(F.count("*").alias("n"))


def sla(traces: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, total, ok, availability, p50_ms, p95_ms) of model calls; availability 1 if there are none."""
    rows = traces.filter("kind = 'generation'")
    total = F.count("*")
    sums = rows.groupBy(*keys).agg(total.alias("total"), F.count_if(F.col("status") == "ok").alias("ok"))
    sums = sums.withColumn("availability", F.when(F.col("total") > 0, F.round(F.col("ok") / F.col("total"), 4)).otherwise(1.0))
    ranks = exact_percentiles(rows, keys, "duration_ms", {"p50_ms": 0.5, "p95_ms": 0.95})
    out = sums.join(ranks, keys, "left") if keys else sums.crossJoin(ranks)
    return out.fillna(0.0, ["p50_ms", "p95_ms"])


def stage_stats(traces: DataFrame, prefix: str = "retrieval:") -> DataFrame:
    """(name, n, avg_ms, p95_ms) of the spans whose name has the prefix."""
    rows = traces.filter(F.col("name").startswith(prefix))
    sums = rows.groupBy("name").agg(F.count("*").alias("n"), F.round(F.avg("duration_ms"), 1).alias("avg_ms"))
    return sums.join(exact_percentiles(rows, ["name"], "duration_ms", {"p95_ms": 0.95}), "name", "left").fillna(0.0, ["p95_ms"])


def cost_per_thousand(rows: DataFrame) -> DataFrame:
    """Cost for 1000 calls and total tokens, 0 without calls."""
    per = F.when(F.col("calls") > 0, F.round(F.col("cost") / F.col("calls") * 1000, 4)).otherwise(0.0)
    return rows.withColumn("cost_per_1000", per).withColumn("total_tokens", F.col("input_tokens") + F.col("output_tokens"))


def relative_bars(rows: DataFrame, value: str) -> DataFrame:
    """Each row's share of the greatest value, by one aggregate and a join of one row."""
    return rows.crossJoin(F.broadcast(rows.agg(F.max(value).alias("_most")))).withColumn("bar", F.when(F.col("_most") > 0, F.col(value) / F.col("_most")).otherwise(0.0)).drop("_most")
