"""Versions of a chunk index: written as snapshots, published last, rebuilt where the parameters changed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.manifest import applied, manifest_diff, needs_full_rebuild
from quarry.session import path_exists


def latest_version(spark: SparkSession, folder: str) -> tuple[int, str | None]:
    """(version, parameter fingerprint) of what was published last, (0, None) if nothing was."""
    marks = f"{folder}/published"
    if not path_exists(spark, marks):
        return 0, None
    row = spark.read.schema("version int, parameters string").json(marks).agg(F.max(F.struct("version", "parameters")).alias("m")).first()
    return (row["m"]["version"], row["m"]["parameters"]) if row["m"] else (0, None)


def chunks_of(spark: SparkSession, folder: str, version: int, kb_id: str | None = None) -> DataFrame:
    """Chunks of a version; of one knowledge base, its partition alone is read."""
    rows = spark.read.parquet(f"{folder}/chunks/{version}")
    return rows if kb_id is None else rows.filter(F.col("kb_id") == kb_id)


def published(chunks: DataFrame, manifest: DataFrame, folder: str, version: int, parameters: str) -> int:
    """Writes chunks (kb_id and others) and manifest (file, fp) as `version`; the mark that readers go by comes last, so a
    job that dies before leaves the earlier version in force, and its own is written anew by the next."""
    chunks.write.mode("overwrite").partitionBy("kb_id").parquet(f"{folder}/chunks/{version}")
    manifest.select("file", "fp").write.mode("overwrite").parquet(f"{folder}/manifests/{version}")
    manifest.sparkSession.createDataFrame([(version, parameters)], "version int, parameters string").coalesce(1).write.mode("append").json(f"{folder}/published")
    return version


def updated(spark: SparkSession, folder: str, manifest: DataFrame, chunker: Callable[[DataFrame], DataFrame], parameters: str) -> dict[str, int | bool]:
    """Brings the index in `folder` up to `manifest` (file, fp) and returns the counts of this call.

    chunker: files (file) -> chunks (kb_id, source and others). It gets the added and
    modified files; all of them where nothing was published or the parameters changed.
    Where nothing changed, no version is written.
    """
    version, before = latest_version(spark, folder)
    if version == 0 or needs_full_rebuild(before, parameters):
        fresh = chunker(manifest.select("file"))
        published(fresh, manifest, folder, version + 1, parameters)
        return {"full_rebuild": True, "version": version + 1, "chunks": chunks_of(spark, folder, version + 1).count()}
    diff = manifest_diff(spark.read.parquet(f"{folder}/manifests/{version}"), manifest)
    counts = {"added": 0, "removed": 0, "modified": 0, "unchanged": 0} | {r["status"]: r["n"] for r in diff.groupBy("status").agg(F.count("*").alias("n")).collect()}
    if counts["added"] + counts["removed"] + counts["modified"]:
        fresh = chunker(diff.filter("status in ('added', 'modified')").select("file"))
        published(applied(chunks_of(spark, folder, version), fresh, diff), manifest, folder, version + 1, parameters)
        version += 1
    return {"full_rebuild": False, "version": version, **counts, "chunks": chunks_of(spark, folder, version).count()}
