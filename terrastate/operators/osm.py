"""Map elements: cities, roads, block counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

CITY_PLACES = ("city", "town")  # fixed values: place tags that make a city


def extract_cities(nodes: DataFrame, include_dense: bool = True) -> DataFrame:
    """M1: nodes tagged ``place`` in (city, town) with a ``name``; population
    parsed as a signed 64-bit integer, else null.  The reference decodes plain
    nodes only; ``include_dense=False`` reproduces that."""
    tags = F.col("tags")
    src = nodes if include_dense else nodes.filter(~F.col("dense"))
    pop = tags["population"]
    population = F.when(pop.rlike(r"\A[+-]?[0-9]+\z"), pop.try_cast("bigint"))
    return (src.filter(tags["place"].isin(*CITY_PLACES) & tags["name"].isNotNull())
            .select("id", tags["name"].alias("name"), "lat", "lon", population.alias("population")))


def extract_roads(ways: DataFrame) -> DataFrame:
    """M2: ways with a ``highway`` key; optional name; node refs in order."""
    return (ways.filter(F.map_contains_key("tags", "highway"))
            .select("id", F.col("tags")["name"].alias("name"), F.col("refs").alias("nodes")))


def city_point(cities: DataFrame) -> DataFrame:
    """M3: point geometry (SRID 4326) as WKT with longitude first."""
    return cities.withColumn(
        "geom", F.concat(F.lit("POINT("), F.col("lon").cast("string"), F.lit(" "), F.col("lat").cast("string"), F.lit(")")))


def element_counts(nodes: DataFrame, ways: DataFrame, relations: DataFrame) -> DataFrame:
    """Elements per block and kind (node, dense_node, way, relation)."""
    n = nodes.select("block_id", F.when(F.col("dense"), F.lit("dense_node")).otherwise(F.lit("node")).alias("kind"))
    w = ways.select("block_id", F.lit("way").alias("kind"))
    r = relations.select("block_id", F.lit("relation").alias("kind"))
    return n.unionByName(w).unionByName(r).groupBy("block_id", "kind").agg(F.count(F.lit(1)).alias("n"))
