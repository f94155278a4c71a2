"""Globe points: normalise, project to uv, de-duplicate, keep land."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from terrastate.functions import scalar as fx

KEY_DIGITS = 6  # fixed value: points are keyed by coordinates rounded to 6 places


def normalize_points(points: DataFrame) -> DataFrame:
    """Scale every point onto the unit sphere."""
    n = fx.norm3(F.col("x"), F.col("y"), F.col("z"))
    return points.select("ordinal", (F.col("x") / n).alias("x"), (F.col("y") / n).alias("y"), (F.col("z") / n).alias("z"))


def xyz_to_uv(points: DataFrame, convention: str = "data", digits: int = KEY_DIGITS) -> DataFrame:
    """Uv of unit-sphere points, rounded to ``digits``."""
    return points.withColumn("u", F.round(fx.xyz_to_u(F.col("x"), F.col("z"), convention), digits)) \
        .withColumn("v", F.round(fx.xyz_to_v(F.col("y"), convention), digits))


def dedup_points(points: DataFrame, digits: int = KEY_DIGITS) -> DataFrame:
    """First point (lowest ordinal) per rounded (x, y, z) key.  Partial
    aggregation folds repeats map-side."""
    key = [F.round(F.col(c), digits).alias(f"k{c}") for c in ("x", "y", "z")]
    first = points.groupBy(*key).agg(F.min(F.struct("ordinal", "x", "y", "z")).alias("p"))
    return first.select("p.ordinal", "p.x", "p.y", "p.z")


def land_filter(points: DataFrame, mask: DataFrame, width: int, height: int, threshold: int = 128) -> DataFrame:
    """Keep points whose mask pixel (floor(u*w), floor(v*h)) has red below
    ``threshold``; pixels outside the image are not land.  Equi-join on the
    pixel; the raster is bounded by the image size and AQE broadcasts it when small."""
    # A negative coordinate lands on pixel 0, as an unsigned cast saturates.
    px = F.greatest(F.floor(F.col("u") * F.lit(width)), F.lit(0)).cast("int")
    py = F.greatest(F.floor(F.col("v") * F.lit(height)), F.lit(0)).cast("int")
    keyed = points.withColumn("px", px).withColumn("py", py).filter(
        (F.col("px") < width) & (F.col("py") < height))
    land = mask.filter(F.col("red") < F.lit(threshold)).select("px", "py")
    return keyed.join(land, ["px", "py"], "left_semi").drop("px", "py")
