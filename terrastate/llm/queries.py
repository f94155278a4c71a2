"""The registered queries of this subpackage, thin over its operators, and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrastate.llm import decontaminate, dialogue, licenses, lm, order_minhash, packing, periodic, phrase_dedup, quality, simhash, suffix_dedup, token_counts, webtext
from terrastate.llm.common import tokenizer_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


@query
def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(spark, documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"), size=1024, end_id=2)


@query
def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts.token_counts(spark, documents(spark, sf_dir), tokenizer_path("piece_bpe_32k.model"))
    return counts.selectExpr("doc_id", "n_bytes", "n_tokens", "n_tokens > 4096 AS over_limit")


@query
def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(spark, documents(spark, sf_dir), table(spark, sf_dir, "labels"), threshold=0.3)


@query
def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(spark, documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


@query
def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup_digest(spark, documents(spark, sf_dir))


ORACLES["op5_suffix_array_dedup"] = suffix_dedup.ORACLE_SQL


@query
def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_dedup.digest(phrase_dedup.dedup_spans(spark, documents(spark, sf_dir), window=20))


ORACLES["op6_substring_dedup"] = phrase_dedup.ORACLE_SQL


@query
def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.lm_scores(spark, documents(spark, sf_dir))


@query
def op8_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digest(licenses.notice_scan(spark, documents(spark, sf_dir)))


ORACLES["op8_license_scans"] = licenses.notices_sql()


@query
def op8_license_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digest(licenses.license_scan(spark, documents(spark, sf_dir), run=licenses.longest(licenses.TEMPLATES)))


ORACLES["op8_license_passages"] = licenses.oracle_sql(run=licenses.longest(licenses.TEMPLATES))


@query
def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_components(spark, documents(spark, sf_dir), shingle=3, radius=3)
    return found.select("doc_id", simhash.hex_fingerprint("fp").alias("fingerprint"), "component_id")


@query
def op10_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = order_minhash.edited_fingerprints(spark, documents(spark, sf_dir))
    return found.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
                        order_minhash.likeness("fingerprint", "edited_fingerprint").alias("near_edited"),
                        order_minhash.likeness("fingerprint", "next_fingerprint").alias("near_next"))


@query
def op11_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return webtext.page_texts(spark, table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


@query
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.digest(periodic.periodic_runs(periodic.with_planted_runs(documents(spark, sf_dir)), least=24, times=3))


@query
def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dialogue.repair(spark, dialogue.damaged(table(spark, sf_dir, "conversations")))
