"""Rows in files with a table of the trigrams of each file, so that a search for a substring reads few files.

A row whose text contains a keyword has all its trigrams (runs of three characters, lower
case), so a file that lacks one of them needn't be read. What is read is compared exactly;
a keyword of fewer than three characters reads all files.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SIZE = 3
#: Rows of a file, about.
FILE_ROWS = 20_000
#: Texts whose trigrams are taken together.
TEXTS_AT_ONCE = 500


def _trigrams(texts: list[str]) -> np.ndarray:
    """The different trigrams of texts, as numbers of three code points of 21 bits."""
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    if len(points) < SIZE:
        return np.zeros(0, np.int64)
    ends = np.repeat(np.cumsum([len(t) for t in texts]), [len(t) for t in texts])
    grams = (points[:-2] << 42) | (points[1:-1] << 21) | points[2:]
    return pc.unique(pa.array(grams[np.arange(len(grams)) + SIZE <= ends[: len(grams)]])).to_numpy()


def _file_trigrams(rows: DataFrame) -> DataFrame:
    """(file, gram) of rows (file, text) in lower case; a pair stands there once for each part of a file that a task reads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, seen = None, np.zeros(0, np.int64)
        pair = lambda: pa.record_batch({"file": pa.array([own] * len(seen), pa.string()), "gram": pa.array(seen)})
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS_AT_ONCE):
                part = batch.slice(at, TEXTS_AT_ONCE)
                names = part.column("file").to_numpy(zero_copy_only=False)
                cuts = [0, *(np.flatnonzero(names[1:] != names[:-1]) + 1).tolist(), len(names)]
                for a, b in zip(cuts, cuts[1:]):
                    if names[a] != own:
                        if own is not None:
                            yield pair()
                        own, seen = names[a], np.zeros(0, np.int64)
                    seen = pc.unique(pa.array(np.concatenate([seen, _trigrams(part.column("text").slice(a, b - a).to_pylist())]))).to_numpy()
        if own is not None:
            yield pair()

    return rows.mapInArrow(run, "file string, gram long")


def written(rows: DataFrame, text: str, folder: str, order: list[str], file_rows: int = FILE_ROWS) -> None:
    """Puts rows into files of neighbours in `order`, and the trigrams of each file beside them."""
    files = max(1, -(-rows.count() // file_rows))
    rows.repartitionByRange(files, *order).sortWithinPartitions(*order).write.mode("overwrite").parquet(f"{folder}/rows")
    held = _file_trigrams(rows.sparkSession.read.parquet(f"{folder}/rows").select(F.input_file_name().alias("file"), F.lower(F.coalesce(F.col(text), F.lit(""))).alias("text")))
    # sorted by trigram, so that a search reads the row groups of a keyword's trigrams alone
    held.distinct().repartitionByRange(max(1, files // 16), "gram").sortWithinPartitions("gram").write.mode("overwrite").parquet(f"{folder}/trigrams")


def candidate_files(spark: SparkSession, folder: str, keyword: str) -> list[str] | None:
    """The files that have all trigrams of the keyword; None where it is too short to tell."""
    lowered = spark.range(1).select(F.lower(F.lit(keyword)).alias("k")).first()["k"]
    grams = _trigrams([lowered]).tolist()
    if not grams:
        return None
    held = spark.read.parquet(f"{folder}/trigrams").filter(F.col("gram").isin(grams))
    return [r["file"] for r in held.groupBy("file").agg(F.count_distinct("gram").alias("n")).filter(F.col("n") == len(grams)).select("file").collect()]


def containing(spark: SparkSession, folder: str, text: str, keyword: str) -> tuple[DataFrame, float]:
    """(rows whose text contains the keyword, without regard to case; the share of the files that are read)."""
    every = spark.read.parquet(f"{folder}/rows")
    files = candidate_files(spark, folder, keyword)
    share = 1.0 if files is None else len(files) / max(1, len(every.inputFiles()))
    rows = every if files is None else spark.read.schema(every.schema).parquet(*files) if files else every.limit(0)
    plain = "".join("\\" + c if c in "%_\\" else c for c in keyword)  # these stand for themselves
    return rows.filter(F.col(text).ilike(f"%{plain}%")), share
