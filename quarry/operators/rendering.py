"""Search results as the text that an answering model reads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions import lexicons, text


def hits_as_text(hits: DataFrame, year_now: int) -> DataFrame:
    """(query_id, worst_risk, text) of hits (query_id, rank, source, page, score, text), the few best of each query.

    The text lists the hits by rank, below a warning if a document among them is stale. The
    worst risk is that of the first hit at high risk, else of the first at medium risk, else
    none; its warning is the one shown.
    """
    rows = hits.withColumn("_fresh", text.freshness(F.col("source"), F.substring("text", 1, 200), year_now))
    grade = F.when(F.col("_fresh.expire_risk") == "high", 0).when(F.col("_fresh.expire_risk") == "medium", 1)
    worst = F.when(grade.isNotNull(), F.struct(grade.alias("grade"), "rank", "_fresh"))
    place = F.concat(
        F.lit("来源: "), F.col("source"), F.when(F.coalesce(F.col("page"), F.lit(0)) != 0, F.concat(F.lit(", 第"), F.col("page").cast("string"), F.lit("页"))).otherwise(""),
        F.when(F.col("_fresh.doc_year").isNotNull(), F.concat(F.lit(" ("), F.col("_fresh.doc_year").cast("string"), F.lit("年文档)"))).otherwise(""),
    )
    line = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] ("), place, F.lit(", 相关度: "), F.format_string("%.2f", F.round("score", 2)), F.lit(")\n"), F.col("text"))
    found = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))).alias("lines"), F.min(worst).alias("worst"))
    search = F.coalesce(F.col("worst._fresh.should_search"), F.lit(False))
    warning = F.concat(F.lit("⚠️ 时效性警告："), F.col("worst._fresh.warning"), F.when(search, F.lit(lexicons.STALE_HIT_ADVICE)).otherwise(""), F.lit("\n"))
    parts = F.concat(F.array(warning), F.transform("lines", lambda x: x["line"]), F.array(F.when(search, F.lit(lexicons.STALE_HITS_NOTE))))
    return found.select("query_id", F.coalesce("worst._fresh.expire_risk", F.lit("none")).alias("worst_risk"), F.array_join(F.array_compact(parts), "\n\n").alias("text"))
