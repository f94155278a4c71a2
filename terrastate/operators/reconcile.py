"""Comparing and repairing ownership.

All are equi-joins on ``tile_id`` over tables with one row per tile (or
semi-joins against such a table), so no key is hot; the planner chooses
broadcast vs sort-merge from runtime sizes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def ownership_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Tiles whose owner in A is missing or different in B (one direction:
    tiles only in B are not reported) -> (tile_id, prod_country, local_country)."""
    left = a.select("tile_id", F.col("country_id").alias("prod_country"))
    right = b.select("tile_id", F.col("country_id").alias("local_country"))
    return (left.join(right, "tile_id", "left")
            .filter(~F.col("prod_country").eqNullSafe(F.col("local_country"))))


def sync_plan(diff: DataFrame) -> DataFrame:
    """R2: click requests that make B equal to A."""
    return diff.select("tile_id", F.col("prod_country").alias("country_id"))


def claim_audit(tc: DataFrame, ownerships: DataFrame, target: str, wanted: str) -> DataFrame:
    """Tiles of ``target`` that are unowned or not owned by ``wanted`` ->
    click requests for ``wanted``."""
    own = ownerships.select("tile_id", F.col("country_id").alias("owner"))
    return (tc.filter(F.col("country_code") == F.lit(target)).select("tile_id")
            .join(own, "tile_id", "left")
            .filter(F.col("owner").isNull() | (F.col("owner") != F.lit(wanted)))
            .select("tile_id", F.lit(wanted).alias("country_id")))


def unauthorized_changes(changes: DataFrame, tc: DataFrame, target: str, wanted: str) -> DataFrame:
    """Changes on ``target``'s tiles whose new owner is not ``wanted``.
    Works on a stream (stream-static semi join) as well as in batch."""
    watched = tc.filter(F.col("country_code") == F.lit(target)).select("tile_id")
    return (changes.filter(F.col("country_id") != F.lit(wanted))
            .join(watched, "tile_id", "left_semi"))


def retake_requests(unauthorized: DataFrame, wanted: str) -> DataFrame:
    """R4 follow-up: one request per offending change."""
    return unauthorized.select("tile_id", F.lit(wanted).alias("country_id"))


def mirror_changes(changes: DataFrame) -> DataFrame:
    """Each change becomes the request (tile, new country) for the replica."""
    return changes.select("tile_id", "country_id")


def divergence_audit(subjects_parsed: DataFrame) -> DataFrame:
    """T5: the log keys a click by its subject, the state service by the
    payload; rows where the two ids differ (or the subject is unreadable)."""
    return subjects_parsed.filter(~F.col("subject_tile_id").eqNullSafe(F.col("tile_id")))
