"""Sinks (K1-K6): what is written, and how.

The ``*_records`` / ``merge_*`` functions return the DataFrame a sink writes,
so the content can be checked; the ``write_*`` functions write it.  Paths are
caller-given shared folders (or ``session.scratch_path``), never machine-local.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from terrastate.session import path_exists
from terrastate.sinks.versions import Outbox, columns_of


# --- K1: ownership snapshot ---------------------------------------------------------------

def merge_snapshot(old: DataFrame, new: DataFrame) -> DataFrame:
    """K1: newer owners replace older ones per tile; on equal time the stored row stays."""
    tagged = (old.select("tile_id", "country_id", "timestamp_ns", F.lit(0).alias("_src"))
              .unionByName(new.select("tile_id", "country_id", "timestamp_ns", F.lit(1).alias("_src"))))
    best = tagged.groupBy("tile_id").agg(
        F.min(F.struct((-F.col("timestamp_ns")).alias("neg_ts"), "_src", "country_id")).alias("b"))
    return best.select("tile_id", F.col("b.country_id").alias("country_id"),
                       (-F.col("b.neg_ts")).alias("timestamp_ns"))


def write_snapshot(snapshot: DataFrame, path: str, partitions: int | None = None) -> None:
    """Range-partitioned and sorted by tile, so range reads (O9) skip files and
    row groups by min/max statistics."""
    spark = snapshot.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    (snapshot.repartitionByRange(n, "tile_id").sortWithinPartitions("tile_id")
     .write.mode("overwrite").parquet(path))


def upsert_snapshot(spark: SparkSession, path: str, new: DataFrame, out_path: str) -> DataFrame:
    """Batch K1: read the current version, merge, write the next version."""
    old = spark.read.parquet(path)
    write_snapshot(merge_snapshot(old, new), out_path)
    return spark.read.parquet(out_path)


# --- K2: notifications ------------------------------------------------------------------------

def notification_records(changes: DataFrame) -> DataFrame:
    return changes.select("tile_id", "country_id", "previous_country_id",
                          *[c for c in ("click_id", "timestamp_ns", "arrival_ns") if c in changes.columns])


def write_notifications(changes: DataFrame, path: str, batch: int = 0, order_cols: tuple[str, ...] = ("arrival_ns", "click_id")) -> Outbox:
    """The changes as batch ``batch`` of the outbox at ``path``; writing a batch again delivers nothing twice."""
    records = notification_records(changes)
    outbox = Outbox(changes.sparkSession, path, columns_of(records), order_cols)
    outbox.put(records, batch)
    return outbox


# --- K3: tile -> country files ------------------------------------------------------------------

def country_tile_chunks(tile_country: DataFrame, chunk: int = 10_000) -> DataFrame:
    """country -> sorted tiles, cut into chunks of ``chunk`` consecutive ids so no
    row (and no group) grows with a big country."""
    assigned = tile_country.filter(F.col("country_code").isNotNull())
    return (assigned.groupBy("country_code", F.floor(F.col("tile_id") / chunk).cast("bigint").alias("chunk_no"))
            .agg(F.array_sort(F.collect_list("tile_id")).alias("tiles")))


def write_tile_country(tile_country: DataFrame, folder: str) -> None:
    tile_country.filter(F.col("country_code").isNotNull()).write.mode("overwrite").json(f"{folder}/tile_to_country")
    country_tile_chunks(tile_country).write.mode("overwrite").json(f"{folder}/country_to_tiles")


def load_or_build_tile_country(spark: SparkSession, folder: str, tiles: DataFrame, build) -> DataFrame:
    """Reuse written files when both were finished (their ``_SUCCESS`` marks are
    there: an interrupted write counts as none); only the unassigned tiles are
    recomputed, as an anti join of all tiles against the stored mapping."""
    names = ("tile_to_country", "country_to_tiles")
    if not all(path_exists(spark, f"{folder}/{n}/_SUCCESS") for n in names):
        write_tile_country(build(), folder)
    t2c = spark.read.schema("tile_id bigint, country_code string").json(f"{folder}/tile_to_country")
    unassigned = tiles.select("tile_id").join(t2c, "tile_id", "left_anti").select(
        "tile_id", F.lit(None).cast("string").alias("country_code"))
    return t2c.unionByName(unassigned)


# --- K4: land points ------------------------------------------------------------------------------

def land_point_records(points: DataFrame) -> DataFrame:
    """One row per kept point; ``length`` of the reference file = row count."""
    return points.select("ordinal", "x", "y", "z", "u", "v")


def write_land_points(points: DataFrame, path: str) -> None:
    land_point_records(points).write.mode("overwrite").parquet(path)


# --- K5: cities and roads -----------------------------------------------------------------------

def city_records(cities: DataFrame) -> DataFrame:
    return cities.select("id", "name", "lat", "lon", "population",
                         F.concat(F.lit("SRID=4326;POINT("), F.col("lon").cast("string"), F.lit(" "),
                                  F.col("lat").cast("string"), F.lit(")")).alias("geom"))


def road_records(roads: DataFrame) -> DataFrame:
    return roads.select("id", "name", F.to_json("nodes").alias("nodes"))


def write_cities(cities: DataFrame, path: str) -> None:
    city_records(cities).write.mode("overwrite").parquet(path)


def write_roads(roads: DataFrame, path: str) -> None:
    road_records(roads).write.mode("overwrite").parquet(path)


# --- K6: ownership pages ---------------------------------------------------------------------------

def page_records(pages: DataFrame) -> DataFrame:
    """One row per page: tile count and the page's ownerships in tile order as
    ``tile:country:ts`` text.  A page holds at most page_size tiles."""
    entry = F.struct("tile_id", F.concat_ws(":", F.col("tile_id").cast("string"), "country_id",
                                            F.col("timestamp_ns").cast("string")).alias("txt"))
    return (pages.groupBy("page_no")
            .agg(F.count(F.lit(1)).alias("n_tiles"), F.array_sort(F.collect_list(entry)).alias("_e"))
            .select("page_no", "n_tiles", F.array_join(F.transform("_e", lambda e: e["txt"]), ",").alias("ownerships")))


def write_pages(pages: DataFrame, path: str) -> None:
    page_records(pages).write.mode("overwrite").json(path)


def page_payloads(pages: DataFrame) -> DataFrame:
    """K6 as served: one protobuf ownership state per page, base64 text, with
    the ownerships in tile order.  A page holds at most page_size tiles."""
    from terrastate.functions.wire import ownership_hex

    entry = F.struct("tile_id", ownership_hex(F.col("tile_id"), F.col("country_id"), F.col("timestamp_ns")).alias("hex"))
    grouped = pages.groupBy("page_no").agg(F.count(F.lit(1)).alias("n_tiles"),
                                           F.array_sort(F.collect_list(entry)).alias("_e"))
    raw = F.unhex(F.array_join(F.transform("_e", lambda e: e["hex"]), ""))
    return grouped.select("page_no", "n_tiles", F.regexp_replace(F.base64(raw), "[\\r\\n]", "").alias("data"))
