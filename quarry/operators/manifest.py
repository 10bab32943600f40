"""Incremental indexing: fingerprints, manifest differences, new snapshots."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import key_hash


def file_fingerprint(name: Column, size: Column, modified: Column) -> Column:
    return key_hash(name, size, modified)


def chunk_id(source: Column, index: Column, text: Column) -> Column:
    """A deterministic id: the same chunk keeps it in every run."""
    return F.concat(F.lit("chunk_"), key_hash(source, index, text, size=12))


def corpus_fingerprint(manifest: DataFrame) -> DataFrame:
    """One row: a fingerprint of (file, fp) rows in any order, by a sum of row hashes.

    Names aren't brought together in one row, so it holds for any number of files.
    """
    part = F.conv(F.substring(F.sha2(F.concat_ws(":", "file", "fp"), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    return manifest.agg(F.substring(F.sha2(F.concat_ws(":", F.count("*").cast("string"), F.coalesce(F.sum(part), F.lit(0)).cast("string")), 256), 1, 16).alias("fingerprint"))


def manifest_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(file, status) with status added, removed, modified or unchanged."""
    a, b = old.select("file", F.col("fp").alias("old_fp")), new.select("file", F.col("fp").alias("new_fp"))
    status = F.when(F.col("old_fp").isNull(), "added").when(F.col("new_fp").isNull(), "removed").when(F.col("old_fp") != F.col("new_fp"), "modified").otherwise("unchanged")
    return a.join(b, "file", "full_outer").select("file", status.alias("status"))


def diff_counts(diff: DataFrame) -> DataFrame:
    return diff.groupBy("status").agg(F.count("*").alias("n"))


def applied(chunks: DataFrame, fresh: DataFrame, diff: DataFrame) -> DataFrame:
    """Chunks of unchanged files with their vectors, and the fresh ones of added and modified files."""
    gone = diff.filter("status in ('removed', 'modified')").select(F.col("file").alias("source"))
    return chunks.join(gone, "source", "left_anti").unionByName(fresh)


def parameter_fingerprint(**parameters: object) -> str:
    """A fingerprint of the settings that all chunks depend on (sizes, model, schema version), in any order."""
    return hashlib.sha256(":".join(f"{k}={v}" for k, v in sorted(parameters.items())).encode()).hexdigest()[:16]


def needs_full_rebuild(old_parameters: str | None, new_parameters: str) -> bool:
    """Whether the chunking parameters' fingerprint changed, so that no chunk can be kept."""
    return old_parameters != new_parameters


def metadata_page(page: Column) -> Column:
    """-1 stands for no page in stored metadata."""
    return F.coalesce(page, F.lit(-1))


def restored_page(page: Column) -> Column:
    return F.when(page >= 0, page)
