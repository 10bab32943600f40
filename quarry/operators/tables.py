"""Changes of tables as rewrites: upserts, guarded updates, cascading deletes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upserted(table: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """`table` with the rows of `changes` in the place of those with equal keys."""
    return table.join(changes.select(*keys), keys, "left_anti").unionByName(changes)


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key by `order` (newest last), by one aggregation."""
    columns = [F.col(c) for c in rows.columns]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("_r")).select("_r.*")


def inserted_or_ignored(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    return table.unionByName(rows.dropDuplicates(keys).join(table.select(*keys), keys, "left_anti"))


def inserted_or_replaced(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """As `upserted`, with the hit count of replaced rows at 0."""
    return upserted(table, rows.withColumn("hits", F.lit(0).cast(table.schema["hits"].dataType)), keys)


def updated_where(table: DataFrame, condition: Column, values: dict[str, Column]) -> DataFrame:
    """Columns set where the condition holds."""
    hit = F.coalesce(condition, F.lit(False))
    return table.select([F.when(hit, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in table.columns])


def exclusive_flag(table: DataFrame, key: str, group: str, target: Column, flag: str = "is_active") -> DataFrame:
    """The target row's flag set and those of its group's other rows cleared; other groups stay."""
    groups = table.filter(F.col(key) == target).select(F.col(group).alias("_g")).distinct()
    return table.join(F.broadcast(groups.limit(1)), F.col(group) == F.col("_g"), "left").withColumn(flag, F.when(F.col("_g").isNotNull(), (F.col(key) == target).cast("int")).otherwise(F.col(flag))).drop("_g")


def cascade_deleted(parents: DataFrame, children: DataFrame, key: str, foreign: str, doomed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Parents and children without those of the keys in `doomed` (one column `key`)."""
    return parents.join(doomed, key, "left_anti"), children.join(doomed.withColumnRenamed(key, foreign), foreign, "left_anti")


def admin_count(users: DataFrame) -> DataFrame:
    return users.agg(F.count_if(F.col("is_admin") == 1).alias("admins"))


def may_delete_user(users: DataFrame, username: str) -> DataFrame:
    """One row: whether an administrator remains if the user goes."""
    others = F.count_if((F.col("is_admin") == 1) & (F.col("username") != username))
    is_admin = F.count_if((F.col("is_admin") == 1) & (F.col("username") == username))
    return users.agg(((is_admin == 0) | (others > 0)).alias("allowed"))


def tasks_done(tasks: DataFrame, kb: str, modes: tuple[str, ...] = ("upload", "delete"), at: Column | None = None) -> DataFrame:
    """Pending tasks of a knowledge base in the modes become done; others (edits) stay."""
    hit = (F.col("kb_id") == kb) & (F.col("status") == "pending") & F.col("mode").isin(*modes)
    return updated_where(tasks, hit, {"status": F.lit("done")} | ({} if at is None else {"updated_at": at}))


def tasks_failed(tasks: DataFrame, failures: DataFrame, at: Column | None = None) -> DataFrame:
    """Pending tasks that failures (id, message) name become error with the message; those that are done or failed stay."""
    told = failures.groupBy("id").agg(F.min("message").alias("_message"))
    rows = tasks.join(told, "id", "left")
    hit = (F.col("status") == "pending") & F.col("_message").isNotNull()
    changes = {"status": F.lit("error"), "message": F.col("_message")} | ({} if at is None else {"updated_at": at})
    rows = rows if "message" in tasks.columns else rows.withColumn("message", F.lit(None).cast("string"))
    return updated_where(rows, hit, changes).drop("_message")


def next_seq(messages: DataFrame) -> DataFrame:
    """(session_id, next_seq): one above the greatest, 0 for none."""
    return messages.groupBy("session_id").agg((F.coalesce(F.max("seq"), F.lit(-1)) + 1).alias("next_seq"))
