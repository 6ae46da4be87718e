"""The registered corpus queries: thin wrappers that derive contract columns from the operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oscilla.llm import byte_bpe, common, decontaminate, html_text, language, near_dedup, outliers, phrases, pii, quality, resample, token_counts, token_files, warc

Query = Callable[[SparkSession, str], DataFrame]


def op1_robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outliers.robust_outliers(common.load(spark, sf_dir, "documents")).withColumn("distance2", F.round("distance2", 6))


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(common.load(spark, sf_dir, "pages"))


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(common.load(spark, sf_dir, "documents"))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = token_files.write_token_files(common.load(spark, sf_dir, "documents"), common.shared_path(spark, "tokens"))
    return token_files.checksums(token_files.read_token_files(spark, path))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained_items(common.load(spark, sf_dir, "documents"), common.load(spark, sf_dir, "benchmark"))


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(common.load(spark, sf_dir, "documents"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(common.load(spark, sf_dir, "documents"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.load(spark, sf_dir, "documents")
    return quality.scores(docs, quality.fit(docs, common.load(spark, sf_dir, "labels")))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(common.load(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.load(spark, sf_dir, "documents")
    return language.predict(docs, language.fit(docs))


def op11_warc_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = warc.write_pages(common.load(spark, sf_dir, "pages"), common.shared_path(spark, "warc"))
    return warc.page_records(spark, path).drop("payload")


def op12_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.phrases(common.load(spark, sf_dir, "documents"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(common.load(spark, sf_dir, "documents"), common.load(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Query] = {
    "op1_robust_outliers": op1_robust_outliers,
    "op2_html_text": op2_html_text,
    "op3_minhash_near_dedup": op3_minhash_near_dedup,
    "op4_token_files": op4_token_files,
    "op5_decontamination": op5_decontamination,
    "op6_personal_data": op6_personal_data,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_token_counts": op9_token_counts,
    "op10_language_id": op10_language_id,
    "op11_warc_source": op11_warc_source,
    "op12_phrase_mining": op12_phrase_mining,
    "op13_importance_resampling": op13_importance_resampling,
}
