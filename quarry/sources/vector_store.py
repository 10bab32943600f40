"""Answers of a model kept by content, and a collection of vectors that is rewritten a knowledge base at a time.

A model is asked only about contents whose answers are not in the store: what a changed
file shares with its former version, with other files or with other knowledge bases costs
nothing. Answers are added under the key of the content and of the model, and a call that
fails leaves nothing behind, so the next run asks again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.providers import Embedder, embedded
from quarry.session import checkpointed, dropped, path_exists

KEPT = "model string, key string, vector array<double>"


def content_key(text: Column) -> Column:
    """The key of a text; a null text has that of the empty one."""
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def answered_once(rows: DataFrame, key: Column, ask: Callable[[DataFrame], DataFrame], store: str, answer: str, error: str) -> tuple[DataFrame, int]:
    """(rows with columns `answer` and `error`, number of keys asked about) of any rows.

    ask: rows of different keys -> the same with `answer` and `error`. Of equal keys one row
    is asked about. Answers without an error are kept in the folder `store`.
    """
    spark = rows.sparkSession
    keyed = rows.withColumn("_key", key)
    kept = spark.read.parquet(store) if path_exists(spark, store) else None
    wanted = keyed.dropDuplicates(["_key"])
    new = checkpointed(ask(wanted if kept is None else wanted.join(kept.select("_key"), "_key", "left_anti")).select("_key", answer, error))
    asked = new.count()
    if asked:
        new.filter(F.col(error).isNull()).drop(error).write.mode("append").parquet(store)
    failed = new.filter(F.col(error).isNotNull()).select("_key", error)
    if not path_exists(spark, store):
        return keyed.drop("_key").withColumns({answer: F.lit(None), error: F.lit(None).cast("string")}), asked
    held = spark.read.parquet(store).dropDuplicates(["_key"])
    return keyed.join(held, "_key", "left").join(failed, "_key", "left").drop("_key"), asked


def with_vectors(chunks: DataFrame, folder: str, model: str, embedder: Embedder, text: str = "text") -> tuple[DataFrame, int]:
    """(chunks with vector and embed_error, texts that the model was asked about): each different text once, ever."""
    return answered_once(chunks, content_key(F.col(text)), lambda new: embedded(new, embedder, text), f"{folder}/answers/{model}", "vector", "embed_error")


def read_images(images: DataFrame, folder: str, ocr: Callable[[bytes], str]) -> tuple[DataFrame, int]:
    """(images with text and error, images read) of image files (source, size, modified, content): a file of a name, size and
    time that was read before is not read again."""
    names = [f"`{f.name}` {f.dataType.simpleString()}" for f in images.schema.fields]

    def ask(new: DataFrame) -> DataFrame:
        def run(batches):
            import pyarrow as pa

            for batch in batches:
                texts, errors = [], []
                for content in batch.column("content").to_pylist():
                    try:
                        texts.append(ocr(content))
                        errors.append(None)
                    except Exception as e:  # noqa: BLE001 - an image may be broken in any way
                        texts.append(None)
                        errors.append(f"{type(e).__name__}: {e}")
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string()), pa.array(errors, pa.string())], names=[*batch.schema.names, "text", "error"])

        return new.select(*images.columns, "_key").mapInArrow(run, ", ".join([*names, "_key string", "text string", "error string"]))

    key = F.sha2(F.concat_ws(":", "source", F.col("size").cast("string"), F.col("modified").cast("string")), 256)
    return answered_once(images, key, ask, f"{folder}/images", "text", "error")


def collection(spark: SparkSession, folder: str) -> DataFrame:
    """The chunks of all knowledge bases, with their vectors."""
    return spark.read.parquet(f"{folder}/chunks")


def updated(chunks: DataFrame, folder: str, model: str, embedder: Embedder) -> dict[str, int]:
    """Makes the collection of `folder` hold exactly `chunks` (kb_id: string, chunk_id, source, text, page), and returns counts.

    Knowledge bases whose chunks are as they were keep their files; of the others the model
    is asked about new texts alone, their partitions are put in the place of the old ones,
    and those that are gone are dropped. A text that the model fails for has a null vector
    and embed_error, and is asked about again when its knowledge base next changes. Null
    kb_ids are left out. The fingerprints that decide come last: an update that dies is done
    again.
    """
    spark = chunks.sparkSession
    rows = chunks.filter("kb_id is not null and kb_id <> ''").select(F.concat(F.lit("kb:"), F.col("kb_id")).alias("kb"), *[c for c in chunks.columns if c != "kb_id"])
    fields = [F.col(c) for c in rows.columns if c != "kb"]
    now = checkpointed(rows.groupBy("kb").agg(F.concat_ws(":", F.lit(model), F.count("*").cast("string"), F.sum(F.xxhash64(*fields).cast("decimal(38,0)")).cast("string")).alias("new")))
    marks = f"{folder}/marks"
    before = spark.read.parquet(marks).withColumnRenamed("new", "old") if path_exists(spark, marks) else now.limit(0).withColumnRenamed("new", "old")
    both = checkpointed(now.join(before, "kb", "full"))
    changed = both.filter("new is not null and not (new <=> old)").select("kb")
    gone = [r["kb"] for r in both.filter("new is null").select("kb").collect()]
    counts = {"changed": changed.count(), "gone": len(gone), "kept": both.filter("new = old").count(), "asked": 0}
    if counts["changed"]:
        made, counts["asked"] = with_vectors(rows.join(changed, "kb", "left_semi"), folder, model, embedder)
        made.repartition("kb", F.pmod(F.xxhash64("chunk_id"), F.lit(8))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("kb").parquet(f"{folder}/chunks")
    for kb in gone:
        for name in spark.read.parquet(f"{folder}/chunks").filter(F.col("kb") == kb).select(F.url_decode(F.regexp_extract(F.input_file_name(), "/(kb=[^/]*)/", 1)).alias("f")).distinct().collect():
            dropped(spark, f"{folder}/chunks/{name['f']}")
    now.write.mode("overwrite").parquet(marks)
    return counts
