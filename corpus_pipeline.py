"""From raw documents to packed training sequences.

Each stage gets (spark, docs, sf_dir) and calls one operator; ``run`` writes
each stage's rows as Parquet and reads them again as the next one's documents.
All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from terrastate.llm import decontaminate, packing, quality, simhash, suffix_dedup
from terrastate.llm.common import materialize, tokenizer_path


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.keep_good(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), threshold=0.3)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document of smallest id stays."""
    return simhash.keep_one_of_each(spark, docs, shingle=3, radius=3)


def suffix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 50 bytes and more that an earlier document has are cut from the texts."""
    return suffix_dedup.dedup_texts(spark, docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of the benchmark go."""
    return decontaminate.keep_clean(spark, docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents that are left, with their token ids, packed into sequences of 1024 tokens."""
    return packing.packed_pieces(spark, docs, tokenizer_path("byte_bpe_50k.json"), size=1024, end_id=2)


STAGES = [("quality_classifier", quality_stage), ("simhash_near_dedup", simhash_stage), ("suffix_array_dedup", suffix_stage),
          ("benchmark_decontamination", decontamination_stage), ("best_fit_packing", packing_stage)]

#: No plain SQL has a tokenizer or a fitted model; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(spark, stage(spark, docs, sf_dir), name)
    return docs
