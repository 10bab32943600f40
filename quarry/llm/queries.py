"""The queries opN_<name> over whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import decontamination, html_extraction, language_id, license_scan, lm_scoring, mixing, ngram_join, phrases, quality_classifier, quality_rules, source_divergence, token_files, toxicity
from quarry.session import shared_folder, table

#: The public tokenizer of op12 and the id that it puts behind each document.
TOKENIZER, END_ID = "byte_bpe_50k.json", 2


def _held_out(fold: int, remainder: int) -> Column:
    """Whether crc32 of doc_id as text has this remainder; a null doc_id is not held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % fold == remainder, F.lit(False))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = language_id.identified(docs.select("doc_id", "text"), language_id.trained(docs))
    return found.select("doc_id", _held_out(3, 1).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.col("lang_rejected").alias("rejected"))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.model_scores(table(spark, sf_dir, "documents"), _held_out(10, 0))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed_to_targets(table(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.scanned(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality_classifier.scored(docs, quality_classifier.trained(docs, table(spark, sf_dir, "labels")), "score")
    predicted = (F.col("score") >= quality_classifier.THRESHOLD).cast("int").alias("predicted")
    return scored.select("doc_id", _held_out(5, 0).alias("held_out"), "score", predicted)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_rules.verdicts(quality_rules.ledger(table(spark, sf_dir, "documents")))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.scored(docs, toxicity.trained(docs, table(spark, sf_dir, "labels")), "score")
    predicted = (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted")
    return scored.select("doc_id", _held_out(5, 0).alias("held_out"), "score", predicted)


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.extracted(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.linked_components(table(spark, sf_dir, "documents"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scanned(table(spark, sf_dir, "documents"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence.divergence(table(spark, sf_dir, "documents"))


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = f"{shared_folder(spark)}/token_files-{uuid.uuid4().hex}"
    token_files.written(table(spark, sf_dir, "documents"), folder, public_tokenizers.path(TOKENIZER), END_ID)
    return token_files.read(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_lm_scoring": op2_lm_scoring,
    "op3_mixing": op3_mixing,
    "op4_decontamination": op4_decontamination,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_toxicity": op6_toxicity,
    "op7_html_extraction": op7_html_extraction,
    "op8_ngram_jaccard_join": op8_ngram_jaccard_join,
    "op9_quality_rules": op9_quality_rules,
    "op10_license_scan": op10_license_scan,
    "op11_source_divergence": op11_source_divergence,
    "op12_token_files": op12_token_files,
    "op13_phrases": op13_phrases,
}

ORACLE_SQL: dict[str, str] = {
    "op3_mixing": mixing.ORACLE_SQL,
    "op4_decontamination": decontamination.ORACLE_SQL,
    "op8_ngram_jaccard_join": ngram_join.ORACLE_SQL,
    "op9_quality_rules": quality_rules.ORACLE_SQL,
    "op10_license_scan": license_scan.ORACLE_SQL,
    "op11_source_divergence": source_divergence.ORACLE_SQL,
    "op13_phrases": phrases.ORACLE_SQL,
}
