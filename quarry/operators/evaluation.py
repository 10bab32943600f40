"""Retrieval and answer quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators.containing import containing

#: What an honest answer outside the knowledge base says.
HONEST_MARKERS = ["知识库无相关内容", "模型通识", "未找到", "没有找到", "无法从知识库"]


def holders(questions: DataFrame, docs: DataFrame) -> DataFrame:
    """(query_id, doc_id): the documents (doc_id, text) whose text holds a non-blank question (query_id, question) whole."""
    asked = questions.filter("query_id is not null and question is not null and trim(question) <> ''").select(F.col("query_id").cast("long").alias("query_id"), F.col("question").alias("pattern"))
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text")
    return containing(texts, asked).join(asked, "pattern").select("query_id", F.col("id").alias("doc_id"))


def hit_ranks(questions: DataFrame, ranked: DataFrame) -> DataFrame:
    """(query_id, hit_rank) of every non-blank question (query_id, question, expected): the first rank
    (query_id, source, rank) of the expected source, or null."""
    asked = questions.filter(F.trim("question") != "")
    first = ranked.groupBy("query_id", F.col("source").alias("expected")).agg(F.min("rank").alias("hit_rank"))
    return asked.join(first, ["query_id", "expected"], "left").select("query_id", "question", "expected", "hit_rank")


def recall_mrr(details: DataFrame, k: int) -> DataFrame:
    """One row: recall at k and mean reciprocal rank; a rank beyond k counts for the latter only."""
    share = lambda x: F.round(F.coalesce(x / F.count("*"), F.lit(0.0)), 4)
    hits = F.count_if(F.col("hit_rank") <= k)
    return details.agg(F.count("*").alias("total"), hits.alias("hits"), share(hits).alias("recall"), share(F.sum(F.coalesce(1 / F.col("hit_rank"), F.lit(0.0)))).alias("mrr"))


def miss_count(details: Column) -> Column:
    """Items of a run's array of details without a hit."""
    return F.size(F.filter(details, lambda d: d["hit_rank"].isNull()))


def quality_trend(runs: DataFrame, last: int = 200) -> DataFrame:
    """(day, mode, recall): the best recall of each day and mode among the last runs that are done."""
    recent = runs.filter("status = 'done'").orderBy(F.desc("created_at"), F.desc("id")).limit(last)
    return recent.groupBy(F.date_format("created_at", "yyyy-MM-dd").alias("day"), "mode").agg(F.max("recall").alias("recall"))


def answer_scores(answers: DataFrame) -> DataFrame:
    """Scores of answers (source, keywords, ood, answer), as columns source_hit, has_citation, kw_score, honest, score."""
    answer = F.col("answer")
    hit = F.coalesce(F.contains(answer, F.col("source")), F.lit(False))
    cited = F.contains(answer, F.lit("[来源:")) | F.contains(answer, F.lit("【模型通识】"))
    keywords = F.when(F.size("keywords") > 0, F.size(F.filter("keywords", lambda k: F.contains(answer, k))) / F.size("keywords"))
    fake = answer.rlike(r"\[来源: [^\]]+\.(?:md|pdf|docx|xlsx|txt)")
    marked = F.array(*[F.contains(answer, F.lit(m)) for m in HONEST_MARKERS])
    honest_mark = F.array_contains(marked, True)
    one = lambda c: c.cast("double")
    score = (
        F.when(F.col("ood"), 0.6 * one(~fake) + 0.4 * one(honest_mark))
        .when(keywords.isNotNull(), 0.5 * one(hit) + 0.3 * keywords + 0.2 * one(cited))
        .otherwise(0.7 * one(hit) + 0.3 * one(cited))
    )
    return answers.withColumns({"source_hit": hit, "has_citation": cited, "kw_score": keywords, "honest": ~fake & honest_mark, "score": F.round(score, 3)})


def score_summary(scored: DataFrame) -> DataFrame:
    """Counts and the mean score; source hits are of answers in, honesty of those outside the knowledge base."""
    return scored.agg(
        F.count("*").alias("n"),
        F.round(F.coalesce(F.avg("score"), F.lit(0.0)), 3).alias("mean_score"),
        F.count_if(~F.col("ood") & F.col("source_hit")).alias("source_hits"),
        F.count_if(~F.col("ood")).alias("in_scope"),
        F.count_if(F.col("ood") & F.col("honest")).alias("honest"),
        F.count_if(F.col("ood")).alias("out_of_scope"),
    )
