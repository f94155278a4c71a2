"""Leaderboards and counts.

All are aggregates with a map-side partial step: a country holding a third of
all tiles still arrives at the final aggregate as one row per input partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from terrastate.functions.scalar import DEFAULT_TILE_TOTAL, display_name, percent_of


def leaderboard(ownerships: DataFrame) -> DataFrame:
    """L2: tiles per country; countries without tiles do not appear."""
    return ownerships.groupBy("country_id").agg(F.count(F.lit(1)).alias("score"))


def leaderboard_ranked(ownerships: DataFrame, k: int | None = None) -> DataFrame:
    """L3: by score descending, ties by country id; ``k`` keeps the top k (TakeOrdered)."""
    ranked = leaderboard(ownerships).orderBy(F.desc("score"), F.asc("country_id"))
    return ranked.limit(k) if k is not None else ranked


def country_scores(ownerships: DataFrame, countries: DataFrame, code_col: str = "code") -> DataFrame:
    """L1 in bulk: score of each requested country, 0 when it owns nothing."""
    board = leaderboard(ownerships)
    return (countries.select(F.col(code_col).alias("country_id")).distinct()
            .join(board, "country_id", "left")
            .select("country_id", F.coalesce(F.col("score"), F.lit(0)).cast("bigint").alias("score")))


def country_score(ownerships: DataFrame, country_id: str) -> DataFrame:
    """L1: one row (country_id, score), 0 if none."""
    return (ownerships.filter(F.col("country_id") == F.lit(country_id))
            .agg(F.count(F.lit(1)).alias("score"))
            .select(F.lit(country_id).alias("country_id"), F.col("score").cast("bigint")))


def score_deltas(classified: DataFrame) -> DataFrame:
    """+1 for the new owner, -1 for the previous one, for every applied click
    (first claims included, so the sum equals the recount)."""
    applied = classified.filter(F.col("applied"))
    deltas = F.array(
        F.struct(F.col("country_id").alias("country_id"), F.lit(1).cast("bigint").alias("delta")),
        F.struct(F.col("previous_country").alias("country_id"), F.lit(-1).cast("bigint").alias("delta")),
    )
    return (applied.select(F.explode(deltas).alias("d"))
            .select("d.country_id", "d.delta")
            .filter(F.col("country_id").isNotNull()))


def leaderboard_incremental(classified: DataFrame) -> DataFrame:
    """L4: scores maintained from changes; a country at 0 is dropped."""
    return (score_deltas(classified).groupBy("country_id").agg(F.sum("delta").alias("score"))
            .filter(F.col("score") > 0))


def leaderboard_display(ownerships: DataFrame, countries: DataFrame, total: Column | int = DEFAULT_TILE_TOTAL,
                        k: int | None = None) -> DataFrame:
    """Rank, display name, tiles and percent of ``total``.

    The ranking window has no partition key: it runs over the aggregated
    leaderboard, one row per country.  With ``k`` the board is cut to its top k
    before it (TakeOrdered, k rows a task), so the window's one task has k rows
    however many codes the clicks made up.  The dimension join is left to AQE
    (broadcast from its runtime size).
    """
    board = leaderboard_ranked(ownerships, k) if k is not None else leaderboard(ownerships)
    named = board.join(countries.select(F.col("code").alias("country_id"), "name"), "country_id", "left")
    w = Window.orderBy(F.desc("score"), F.asc("country_id"))
    out = named.select(
        F.row_number().over(w).cast("bigint").alias("rank"),
        "country_id",
        display_name(F.coalesce(F.col("name"), F.col("country_id"))).alias("display_name"),
        F.col("score").alias("tiles"),
        percent_of(F.col("score"), total).alias("percent"),
    )
    return out


def country_tile_stats(tile_country: DataFrame) -> DataFrame:
    """Grouping sets ((), (country_code)).

    ``is_total`` = 1 marks the grand total row: ``tiles`` = all tiles,
    ``assigned`` = tiles with a country (unassigned = difference).  Other rows
    are per country, the null country being the unassigned group.
    """
    return (tile_country.groupingSets([[], [F.col("country_code")]], F.col("country_code"))
            .agg(F.count(F.lit(1)).alias("tiles"),
                 F.count("country_code").alias("assigned"),
                 F.grouping_id().cast("int").alias("is_total")))


def leaderboard_reply(board: DataFrame) -> DataFrame:
    """L3 as the served reply: the ranked board encoded as one protobuf
    leaderboard response, base64 text (``data``) with entry and byte counts.
    One row built from the aggregated board (one row per country, bounded by
    the country dimension)."""
    from terrastate.functions.wire import leaderboard_entry_hex

    entry = F.struct((-F.col("score")).alias("neg"), F.col("country_id").alias("c"),
                     leaderboard_entry_hex(F.col("country_id"), F.col("score")).alias("hex"))
    packed = board.agg(F.count(F.lit(1)).alias("entries"), F.array_sort(F.collect_list(entry)).alias("_e"))
    raw = F.unhex(F.array_join(F.transform("_e", lambda e: e["hex"]), ""))
    text = F.regexp_replace(F.base64(raw), "[\\r\\n]", "")  # plain base64, no MIME line breaks
    return packed.select("entries", F.octet_length(raw).cast("bigint").alias("bytes"), text.alias("data"))
