"""Who may see which document, by (kb_id, doc)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def visible(docs: DataFrame, restricted: DataFrame, grants: DataFrame, username: Column, keys: list[str]) -> DataFrame:
    """Public documents and those granted to the user; a document without an entry is public."""
    meta = restricted.select(*keys, "restricted")
    own = grants.filter(F.col("username") == username).select(*keys, F.lit(True).alias("_granted")).distinct()
    joined = docs.join(meta, keys, "left").join(own, keys, "left")
    return joined.filter((F.coalesce("restricted", F.lit(0)) == 0) | F.coalesce("_granted", F.lit(False))).drop("restricted", "_granted")


def key_is_active(revoked_at: Column, expires_at: Column, now: Column) -> Column:
    """Not revoked and not past its end, if it has one."""
    return revoked_at.isNull() & (expires_at.isNull() | (expires_at > now))


def key_in_scope(scope: Column, kb_id: Column) -> Column:
    """An empty scope holds for every knowledge base."""
    return F.coalesce((F.size(scope) == 0) | F.array_contains(scope, kb_id), F.lit(True))


def admitted(requests: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """((query_id, question, kb_id) of the requests that may be answered, (query_id, status, reason) of all others).

    requests: (query_id, question, kb_ids, scope, revoked_at, expires_at), with the columns of
    the caller's key beside what it asks for. Without knowledge bases, `default` is meant. A
    key that isn't active gives 401, a blank question 400, and a knowledge base outside the
    key's scope 403 for the whole request.
    """
    rows = requests.withColumn("kb_ids", F.when(F.size(F.coalesce("kb_ids", F.array())) > 0, F.col("kb_ids")).otherwise(F.array(F.lit("default"))))
    denied = F.filter("kb_ids", lambda kb: ~key_in_scope(F.col("scope"), kb))
    status = (
        F.when(~key_is_active(F.col("revoked_at"), F.col("expires_at"), now), 401)
        .when(F.trim(F.coalesce("question", F.lit(""))) == "", 400)
        .when(F.size(denied) > 0, 403)
        .otherwise(200)
    )
    rows = rows.withColumns({"status": status, "denied": denied})
    reason = F.when(F.col("status") == 401, "key").when(F.col("status") == 400, "question").otherwise(F.array_join("denied", ", "))
    may = rows.filter("status = 200").select("query_id", F.trim("question").alias("question"), F.explode(F.array_distinct("kb_ids")).alias("kb_id"))
    return may, rows.filter("status <> 200").select("query_id", "status", reason.alias("reason"))
