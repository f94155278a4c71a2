"""Country dimension (S8, D1) and its display helpers (F1-F6 applied)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from terrastate.functions import scalar as fx


def country_dim(json_rows: DataFrame, value_col: str = "value") -> DataFrame:
    """JSON objects code -> name (a whole file, or one object per line) ->
    rows (code, name)."""
    m = F.from_json(F.col(value_col), T.MapType(T.StringType(), T.StringType()))
    return json_rows.select(F.explode(m).alias("code", "name"))


def lookup(keys: DataFrame, countries: DataFrame, key_col: str = "country_id") -> DataFrame:
    """D1 get: each key with its country name or null.  No hint: AQE broadcasts
    the dimension from its runtime size (a few hundred codes) and falls back to
    a sort-merge join if a caller passes something large."""
    dim = countries.select(F.col("code").alias(key_col), "name")
    return keys.join(dim, key_col, "left")


def contains(keys: DataFrame, countries: DataFrame, key_col: str = "country_id") -> DataFrame:
    """D1 contains: keys that are known codes."""
    return keys.join(countries.select(F.col("code").alias(key_col)), key_col, "left_semi")


def decorate(countries: DataFrame) -> DataFrame:
    """F1, F3, F5, F6 on the dimension."""
    return countries.select(
        "code", "name",
        fx.lower_code(F.col("code")).alias("code_lower"),
        fx.flag_emoji(F.col("code")).alias("flag"),
        fx.display_name(F.col("name")).alias("display_name"),
        fx.display_label(F.col("code"), F.col("name")).alias("label"),
    )


def search(countries: DataFrame, query: str) -> DataFrame:
    """countries whose name contains ``query``, case-insensitively."""
    return countries.filter(fx.name_matches(F.col("name"), query))


def codes(countries: DataFrame) -> DataFrame:
    """D1 key list: the distinct country codes."""
    return countries.select("code").distinct()


def size(countries: DataFrame) -> DataFrame:
    """D1 length: one row with the number of distinct codes."""
    return countries.agg(F.countDistinct("code").alias("countries"))
