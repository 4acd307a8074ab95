"""The registered queries of the operators and, where SQL can express them, their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plinth.llm import bpe, licences, media, mixing, pii, quality_fm, quality_rules, ranked_search, resampling, secret_scan, simhash, token_files, toxicity
from plinth.llm.common import benchmark, documents, labels


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op10_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.encode(documents(spark, sf_dir)))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(documents(spark, sf_dir))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "pattern", F.round("posterior", 6).alias("posterior"), "kept")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(pii.find(documents(spark, sf_dir)))


def op1_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(documents(spark, sf_dir))


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir))


def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(documents(spark, sf_dir))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_fm.classify(documents(spark, sf_dir), labels(spark, sf_dir))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(documents(spark, sf_dir), labels(spark, sf_dir))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digests(secret_scan.find(documents(spark, sf_dir)))


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return token_files.digests(token_files.write(docs), docs.schema["doc_id"].dataType.simpleString())


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(documents(spark, sf_dir), benchmark(spark, sf_dir))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(documents(spark, sf_dir), benchmark(spark, sf_dir))


QUERIES = {
    "op5_secret_scan": op5_secret_scan,
    "op3_toxicity": op3_toxicity,
    "op2_quality_classifier": op2_quality_classifier,
    "op7_media_columns": op7_media_columns,
    "op6_mix_sources": op6_mix_sources,
    "op1_licence_scan": op1_licence_scan,
    "op4_pii": op4_pii,
    "op9_quality_rules": op9_quality_rules,
    "op10_byte_level_bpe": op10_byte_level_bpe,
    "op8_simhash_near_dedup": op8_simhash_near_dedup,
    "op11_token_files": op11_token_files,
    "op12_ranked_search": op12_ranked_search,
    "op13_importance_resampling": op13_importance_resampling,
}
SQL: dict[str, str] = {
    "op6_mix_sources": mixing.SQL,
    "op1_licence_scan": licences.SQL,
    "op4_pii": pii.SQL,
    "op9_quality_rules": quality_rules.SQL,
    "op12_ranked_search": ranked_search.SQL,
    "op13_importance_resampling": resampling.SQL,
}
