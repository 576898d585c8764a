"""The training-data queries and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audio, decontam, mixing, nbsvm, pagediff, phrases, ppm, segments, setjoin, suffix, toxicity, treaps, url_rules


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_page_differencing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pagediff.extract_text(table(spark, sf_dir, "pages"))


def op2_spaced_seed_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leak_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.repeat_digest(table(spark, sf_dir, "documents"))


def op4_ppm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score_documents(table(spark, sf_dir, "documents"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nbsvm.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_telephony_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio.media_digest(table(spark, sf_dir, "documents"))


def op8_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge_urls(table(spark, sf_dir, "pages"))


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", F.col("source"), "copies")


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setjoin.near_duplicates(table(spark, sf_dir, "documents"), 4, 85, 100)


def op11_inverted_treaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return treaps.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 10)


def op12_pivot_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op13_segment_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.top_products(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 50, 5)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_page_differencing, op2_spaced_seed_decontamination, op3_suffix_dedup, op4_ppm_scoring, op5_quality_classifier, op6_toxicity, op7_telephony_audio, op8_url_rules, op9_source_mixing, op10_ngram_jaccard, op11_inverted_treaps, op12_pivot_phrases, op13_segment_topk)}

ORACLES: dict[str, str] = {"op8_url_rules": url_rules.ORACLE, "op11_inverted_treaps": treaps.ORACLE, "op12_pivot_phrases": phrases.ORACLE, "op13_segment_topk": segments.ORACLE}
