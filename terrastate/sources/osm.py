"""Map element sources (S9): node, way and relation tables with explicit schemas.

The binary container is converted once outside; elements come as Parquet, ORC or
JSON lines (one element a line, ``tags`` as an object), which split across tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from terrastate import schemas


def read_nodes(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """S9, nodes: id, lat, lon, tags, whether they came densely packed, block."""
    return spark.read.schema(schemas.OSM_NODE).format(fmt).load(path)


def read_ways(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """S9, ways: id, node references in order, tags, block."""
    return spark.read.schema(schemas.OSM_WAY).format(fmt).load(path)


def read_relations(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """S9, relations: id, tags, block."""
    return spark.read.schema(schemas.OSM_RELATION).format(fmt).load(path)
