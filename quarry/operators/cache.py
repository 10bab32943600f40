"""Answer caches as tables: semantic lookup, exact keys with a lifetime, eviction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import contains_pii
from quarry.functions.vectors import cosine

#: Similarity of a hit, rows that are looked through, lifetimes in seconds.
THRESHOLD, HOT_ROWS = 0.92, 500
REASONING_TTL, SEARCH_TTL = 86_400, 1_800


def hot_set(cache: DataFrame) -> DataFrame:
    """The rows most often hit, then the newest: a top-k, which is the feature."""
    return cache.orderBy(F.desc("hits"), F.desc("created_at"), F.desc("id")).limit(HOT_ROWS)


def nearest_cached(queries: DataFrame, cache: DataFrame, digits: int = 6) -> DataFrame:
    """(query_id, doc_id, score, hit): for each query (id, vector) the nearest row of the hot set of a cache
    (id, vector, hits, created_at).

    Of equally near rows the last in the hot set's order counts, the least often hit and
    oldest. hit: whether it is near enough. The hot set has HOT_ROWS rows at most, so it is
    broadcast.
    """
    order = Window.orderBy(F.desc("hits"), F.desc("created_at"), F.desc("id"))  # over HOT_ROWS rows
    hot = hot_set(cache).withColumn("place", F.row_number().over(order)).select(F.col("id").alias("doc_id"), F.col("vector").alias("cached"), "place")
    pairs = queries.select(F.col("id").alias("query_id"), "vector").crossJoin(F.broadcast(hot))
    scored = pairs.select("query_id", F.struct(F.round(cosine(F.col("vector"), F.col("cached")), digits).alias("score"), "place", "doc_id").alias("near"))
    best = scored.groupBy("query_id").agg(F.max("near").alias("near"))
    return best.select("query_id", "near.doc_id", "near.score", (F.col("near.score") >= THRESHOLD).alias("hit"))


def semantic_lookup(queries: DataFrame, cache: DataFrame) -> DataFrame:
    """(query_id, doc_id, score) of the hot cached row that answers each query, where one is near enough."""
    return nearest_cached(queries, cache).filter("hit").drop("hit")


def counted_hits(cache: DataFrame, hits: DataFrame) -> DataFrame:
    """The cache with hits raised by the lookups that found a row."""
    n = hits.groupBy(F.col("doc_id").alias("id")).agg(F.count("*").alias("_n"))
    return cache.join(n, "id", "left").withColumn("hits", F.col("hits") + F.coalesce("_n", F.lit(0))).drop("_n")


def saved(cache: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows in the place of those with the same question; questions with personal data aren't stored."""
    fresh = rows.filter(~contains_pii(F.col("question")))
    return cache.join(fresh.select("question"), "question", "left_anti").unionByName(fresh)


def exact_lookup(keys: DataFrame, cache: DataFrame, now: Column, ttl: int) -> DataFrame:
    """Cached rows of the keys that are no older than ttl seconds and don't come from changing tools."""
    alive = cache.filter((now - F.col("created_at") <= ttl) & ~F.coalesce(F.col("dynamic"), F.lit(False)))
    return keys.join(alive, "key")


def evicted(cache: DataFrame, now: Column, ttl: int) -> DataFrame:
    return cache.filter(now - F.col("created_at") <= ttl)


def hit_rates(lookups: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, hits, misses, hit_rate) of lookups (hit boolean); a lookup without an answer is a miss."""
    hits = F.count_if(F.col("hit"))
    return lookups.groupBy(*keys).agg(hits.alias("hits"), (F.count("*") - hits).alias("misses"), F.round(hits / F.count("*"), 4).alias("hit_rate"))


def cache_stats(cache: DataFrame) -> DataFrame:
    return cache.agg(F.count("*").alias("entries"), F.coalesce(F.sum("hits"), F.lit(0)).cast("long").alias("hits"))
