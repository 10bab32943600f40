"""From raw documents to a training mixture: five stages over the table `documents`.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet
and read again as the next stage's docs. All but the last return the columns of
`documents`, whatever these are called.

Rows with nulls, empty and very long texts, repeated rows and empty tables pass each
stage with the result that its docstring states; ties go the same way in each run.
A stage whose work runs in Python sends the package to the executors first, so that a
stage can be run alone, on executors whose path doesn't have it.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import decontamination, mixing, ngram_join, quality_classifier, quality_rules
from quarry.session import dropped, shared_folder, shipped, table


def keep_by_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. A null or empty text has too few words and goes; rows that repeat all stay or all go."""
    return quality_rules.passing(docs)


def keep_by_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, trained on all documents' labels, scores at its threshold or above.

    Null texts score as empty ones. Without labels all documents score alike and stay.
    """
    shipped(spark)
    model = quality_classifier.trained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    kept = quality_classifier.scored(docs, model, "_quality").filter(F.col("_quality") >= quality_classifier.THRESHOLD)
    return kept.select([F.col(f"`{c}`") for c in docs.columns])


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that n-gram Jaccard links tie together: that of the smallest doc_id, then of the smallest
    hash of its text. Of repeated rows one stays; rows without a doc_id stay only where no other is linked with them;
    wordless texts are linked with nothing."""
    shipped(spark)
    return ngram_join.one_of_each_component(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item. Null and empty texts hold none; an empty benchmark drops nothing."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The kept documents repeated to the sources' target weights, in a global random order. A null source is one of its
    own; a null doc_id draws by its text."""
    return mixing.mixed_to_targets(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", keep_by_rules),
    ("quality_classifier", keep_by_quality),
    ("ngram_jaccard_join", keep_one_of_near_copies),
    ("decontamination", drop_benchmark_leaks),
    ("mixing", mix_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each but the last is written to the shared folder and read again.

    What a stage has written is removed once the next one has read it; the caller's result
    reads the last of them, which stays.
    """
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            dropped(spark, before)
        before = f"{folder}/{name}"
    return STAGES[-1][1](spark, docs, sf_dir)


#: The classifier of the second stage is trained, which SQL can't express.
ORACLE_SQL = None

QUERIES = {"pipeline": run}
