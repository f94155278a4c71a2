"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import math
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrastate.session import scratch_path

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = ASCII_UPPER.lower()


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer file (installed on every machine)."""
    import public_tokenizers

    return public_tokenizers.path(name)


def text_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id long, text string): the two columns every operator reads; a null text is the empty text."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it again: cuts the
    lineage, fixes row numbers, and outlives lost executors.  What was shuffled
    for it is removed then; else it stays until the driver collects its garbage."""
    path, former = scratch_path(spark, name), spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(SHUFFLE_CLEANUP) if former is None else spark.conf.set(SHUFFLE_CLEANUP, former)
    return spark.read.schema(df.schema).parquet(path)


def crc_mod(id_column, modulus: int):
    """crc32(doc_id as text) mod ``modulus``; a null id counts as remainder 0."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % modulus, F.lit(0))


def partitions_for(spark: SparkSession, total: float, per_task: float) -> int:
    """Tasks so that each has about ``per_task`` of ``total``, and no fewer than the cluster's cores."""
    return max(int(spark.sparkContext.defaultParallelism), math.ceil(total / per_task))


def unique_name(prefix: str) -> str:
    return f"{prefix}_{uuid.uuid4().hex[:12]}"


def mix64(h: np.ndarray) -> np.ndarray:
    """Finalising mixer of 64-bit hashes (multiply and shift)."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))
