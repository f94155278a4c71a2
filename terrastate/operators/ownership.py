"""Ownership state by last-writer-wins.

Rule: a click applies to its tile only when its ``timestamp_ns`` is strictly
greater than the current owner's; equal times lose, so among equal times the
first arrival wins.  Arrival order is the lexicographic order of
``order_cols`` (default ``arrival_ns, click_id``); it is never materialised as a
global sequence number, because that would need one task to number the log.

Scale notes
-----------
* ``current_ownership`` is one aggregate on ``tile_id`` with a map-side partial
  step, so a hot tile is reduced to one row per input partition before the
  shuffle.  The winner is ``min(struct(-timestamp_ns, order..., country))``.
* ``classify_clicks`` needs the running owner in arrival order.  Where the fullest
  tile is bounded that is one window per tile.  A hotter tile is cut: a prefix
  arg-max is associative, so the log is range-partitioned by (tile, order
  columns) into even parts, a summary per (tile, part) gives each part's carry-in
  and the row window runs per (tile, part).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from terrastate.functions.names import free_name
from terrastate.session import checkpoint_dir, estimated_bytes

DEFAULT_ORDER = ("arrival_ns", "click_id")
PAGE_SIZE = 10_000  # fixed value: the client's page size


def _owner_key(df: DataFrame, order_cols: Sequence[str]) -> Column:
    """Ascending order = preference: highest time first, then earliest arrival."""
    fields = [(-F.col("timestamp_ns")).alias("neg_ts")]
    fields += [F.col(c).alias(f"o{i}") for i, c in enumerate(order_cols)]
    fields += [F.col("country_id").alias("country_id")]
    return F.struct(*fields)


def current_ownership(clicks: DataFrame, order_cols: Sequence[str] = DEFAULT_ORDER) -> DataFrame:
    """O1: final owner per tile -> (tile_id, country_id, timestamp_ns)."""
    best = clicks.groupBy("tile_id").agg(F.min(_owner_key(clicks, order_cols)).alias("best"))
    return best.select(
        "tile_id",
        F.col("best.country_id").alias("country_id"),
        (-F.col("best.neg_ts")).alias("timestamp_ns"),
    )


HOT_TILE = 1_000_000  # clicks of one tile that one task may classify by itself
LEAST_CLICK_BYTES = 8  # of a click in a stored log, compressed


def classify_clicks(clicks: DataFrame, order_cols: Sequence[str] = DEFAULT_ORDER, buckets: int | None = None,
                    before: DataFrame | None = None, hot_tile: int = HOT_TILE) -> DataFrame:
    """O3: every click with ``applied`` and what the store returned for it.

    Adds ``applied`` (boolean), ``previous_country`` and ``previous_ts`` (owner
    before this click; null for the first click of a tile).  ``before`` holds the
    owners from before these clicks (tile_id, country_id, timestamp_ns).

    The clicks of the fullest tile are counted first (not where the planner's
    estimate of the log leaves no room for a hot one).  Up to ``hot_tile`` of
    them a tile is one window in arrival order.  Beyond that (or with ``buckets``
    given) the log is range-partitioned by (tile, ``order_cols``) into even
    parts, whatever the type of the order columns: a hot tile, or a burst of one
    instant, is cut by the order columns themselves; the parts are checkpointed,
    which fixes their numbers (Spark removes the checkpoint with the last
    reference to it where ``spark.cleaner.referenceTracking.cleanCheckpoints`` is
    on).  A log that is classified again and again is better kept as an
    ``arrivals.ArrivalLog``, which is never copied.
    """
    if buckets is None and (estimated_bytes(clicks) <= hot_tile * LEAST_CLICK_BYTES or _fullest_tile(clicks) <= hot_tile):
        return _classify_tiles(clicks, order_cols, before)
    spark = clicks.sparkSession
    checkpoint_dir(spark)
    part = free_name(clicks, "part")
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = clicks.repartitionByRange(n, "tile_id", *order_cols).withColumn(part, F.spark_partition_id().cast("bigint")).checkpoint()
    bests = best_clicks(rows, order_cols, part)
    if before is not None:
        bests = bests.unionByName(earlier_owners(before, rows, order_cols, part))
    return classify_parts(rows, bests, order_cols, part).select(*_out_columns(clicks))


def _fullest_tile(clicks: DataFrame) -> int:
    return clicks.groupBy("tile_id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("n")).first().n or 0


def _out_columns(clicks: DataFrame) -> list[str]:
    made = ("applied", "previous_country", "previous_ts")
    return [c for c in clicks.columns if c not in made] + list(made)


def _classify_tiles(clicks: DataFrame, order_cols: Sequence[str], before: DataFrame | None) -> DataFrame:
    """A tile at a time: the owner's time is the running maximum, the owner the last click that applied."""
    rows, since, owner = clicks, free_name(clicks, "since"), free_name(clicks, "owner")
    if before is not None:
        state = before.select("tile_id", F.col("timestamp_ns").alias(since), F.col("country_id").alias(owner))
        rows = rows.join(state, "tile_id", "left")
    else:
        rows = rows.withColumn(since, F.lit(None).cast(clicks.schema["timestamp_ns"].dataType)).withColumn(owner, F.lit(None).cast("string"))
    earlier = Window.partitionBy("tile_id").orderBy(*order_cols).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("previous_ts", F.greatest(F.max("timestamp_ns").over(earlier), F.col(since)))
    rows = rows.withColumn("applied", F.col("previous_ts").isNull() | (F.col("timestamp_ns") > F.col("previous_ts")))
    applied = F.struct(F.col("country_id"))  # a struct, so that a null country is an owner too
    last = F.last(F.when(F.col("applied"), applied), ignorenulls=True).over(earlier)
    rows = rows.withColumn("previous_country", F.when(last.isNotNull(), last["country_id"]).otherwise(F.col(owner)))
    return rows.select(*_out_columns(clicks))


def best_clicks(rows: DataFrame, order_cols: Sequence[str], part: str) -> DataFrame:
    """(tile_id, part, best): of every part the click that owns each of its tiles afterwards."""
    return rows.groupBy("tile_id", part).agg(F.min(_owner_key(rows, order_cols)).alias("best"))


def earlier_owners(owners: DataFrame, rows: DataFrame, order_cols: Sequence[str], part: str) -> DataFrame:
    """Owners from before all parts as ``best_clicks`` of a part before the first; they win equal times."""
    fields = [(-F.col("timestamp_ns")).alias("neg_ts")]
    fields += [F.lit(None).cast(rows.schema[c].dataType).alias(f"o{i}") for i, c in enumerate(order_cols)]
    key = F.struct(*fields, F.col("country_id").alias("country_id"))
    return owners.select("tile_id", F.lit(-1).cast("bigint").alias(part), key.alias("best"))


def classify_parts(rows: DataFrame, bests: DataFrame, order_cols: Sequence[str], part: str) -> DataFrame:
    """Classification of parts in arrival order, each tile's carry-in the best click of its earlier parts."""
    carry, previous = free_name(rows, "carry"), free_name(rows, "previous")
    earlier = Window.partitionBy("tile_id").orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    carried = (bests.select("tile_id", part, F.min("best").over(earlier).alias(carry)).filter(F.col(carry).isNotNull()))
    inside = Window.partitionBy("tile_id", part).orderBy(*order_cols).rowsBetween(Window.unboundedPreceding, -1)
    seen = F.min(_owner_key(rows, order_cols)).over(inside)
    out = rows.withColumn(previous, seen).join(carried, ["tile_id", part], "left").withColumn(previous, F.least(F.col(carry), F.col(previous)))
    since = -F.col(previous)["neg_ts"]
    return (out.withColumn("applied", F.col(previous).isNull() | (F.col("timestamp_ns") > since))
            .withColumn("previous_country", F.col(previous)["country_id"]).withColumn("previous_ts", since).select(*_out_columns(rows)))


def ownership_changes(classified: DataFrame, parity: bool = False) -> DataFrame:
    """Update notifications (tile_id, country_id, previous_country_id).

    A notification needs a previous owner that differs from the click's
    country; so the first claim of a tile is silent.  ``parity=True`` also
    notifies for stale clicks, as the reference server does.
    """
    cond = F.col("previous_country").isNotNull() & (F.col("previous_country") != F.col("country_id"))
    if not parity:
        cond = cond & F.col("applied")
    return classified.filter(cond).select(
        "tile_id", "country_id", F.col("previous_country").alias("previous_country_id"),
        *[c for c in ("click_id", "timestamp_ns", "arrival_ns") if c in classified.columns])


def has_id(clicks: DataFrame, id_col: str = "click_id") -> Column:
    """Whether a click names itself: a null id, or the empty default of the wire format, says nothing."""
    return F.coalesce(F.col(id_col).cast("string"), F.lit("")) != ""


def dedup_clicks(clicks: DataFrame, order_cols: Sequence[str] = DEFAULT_ORDER, id_col: str = "click_id") -> DataFrame:
    """One row per ``id_col``, the earliest delivery (deterministic, unlike dropDuplicates); clicks without an id all stay.
    Partial aggregation keeps copies of a click from meeting in one task unreduced."""
    named = clicks.filter(has_id(clicks, id_col))
    key = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order_cols) if c != id_col],
                   *[F.col(c).alias(f"c{i}") for i, c in enumerate(clicks.columns)])
    first = free_name(clicks, "first")
    best = named.groupBy(id_col).agg(F.min(key).alias(first))
    return (best.select(*[F.col(first)[f"c{i}"].alias(c) for i, c in enumerate(clicks.columns)])
            .unionByName(clicks.filter(~has_id(clicks, id_col))))


def bootstrap_ownership(snapshot: DataFrame, log: DataFrame, order_cols: Sequence[str] = DEFAULT_ORDER) -> DataFrame:
    """Snapshot rows count as the earliest arrivals, then the replayed log."""
    first, *rest = order_cols
    snap = snapshot.select("tile_id", "country_id", "timestamp_ns",
                           F.lit(-(2 ** 63)).cast(log.schema[first].dataType).alias(first),
                           *[F.lit(None).cast(log.schema[c].dataType).alias(c) for c in rest])
    cols = ["tile_id", "country_id", "timestamp_ns", *order_cols]
    return current_ownership(snap.unionByName(log.select(*cols)), order_cols)


def get_tile(ownerships: DataFrame, tile_id: int) -> DataFrame:
    """O7, one tile: zero or one row."""
    return ownerships.filter(F.col("tile_id") == F.lit(tile_id))


def get_tiles(ownerships: DataFrame, ids: DataFrame) -> DataFrame:
    """O7, bulk: every requested id with its owner or null.  The planner picks
    broadcast or sort-merge from runtime sizes (AQE)."""
    return ids.select("tile_id").join(ownerships.select("tile_id", "country_id", "timestamp_ns"), "tile_id", "left")


def ownerships_by_range(ownerships: DataFrame, start: int, end: int) -> DataFrame:
    """Inclusive range; a plain filter so it reaches the Parquet scan."""
    return ownerships.filter(F.col("tile_id").between(F.lit(start), F.lit(end)))


def ownership_pages(ownerships: DataFrame, tile_count: Column | int | None = None,
                    page_size: int = PAGE_SIZE, parity: bool = False) -> DataFrame:
    """The full fetch cut into pages -> adds ``page_no``.

    Default: page k holds ``[k*size, (k+1)*size)``.  ``parity=True`` reproduces
    the client: pages ``[1 + k*size, min(1 + (k+1)*size, tile_count - 1)]``, so
    tile 0 is never fetched and every boundary tile ``1 + k*size`` (k >= 1) is
    fetched twice.  Expressed as an equi-join key, not a range join.
    """
    t = F.col("tile_id")
    if not parity:
        return ownerships.withColumn("page_no", F.floor(t / F.lit(page_size)).cast("bigint"))
    if tile_count is None:
        raise ValueError("parity paging needs the tile count")
    max_tile = (tile_count if isinstance(tile_count, Column) else F.lit(tile_count)) - F.lit(1)
    k = F.floor((t - F.lit(1)) / F.lit(page_size)).cast("bigint")
    boundary = (t > F.lit(1)) & (((t - F.lit(1)) % F.lit(page_size)) == F.lit(0))
    pages = F.when(boundary, F.array(k - F.lit(1), k)).otherwise(F.array(k))
    return (ownerships.filter((t >= F.lit(1)) & (t <= max_tile))
            .withColumn("page_no", F.explode(pages)))


def retained_clicks(clicks: DataFrame, retention_ns: int, time_col: str = "arrival_ns") -> DataFrame:
    """T1 (batch form): what a log kept for ``retention_ns`` still holds, measured
    back from its newest entry.  The maximum is a scalar subquery (one partial
    aggregate per partition), not a driver round trip."""
    newest = clicks.agg(F.max(time_col)).scalar()
    return clicks.filter(F.col(time_col) > newest - F.lit(retention_ns))


def late_clicks(classified: DataFrame) -> DataFrame:
    """Clicks accepted but ignored because they were not newer than the state."""
    return classified.filter(~F.col("applied"))


def change_batches(changes: DataFrame, interval_ns: int, time_col: str = "arrival_ns") -> DataFrame:
    """T3 (batch form): changes delivered in periodic batches of ``interval_ns``."""
    return (changes.groupBy(F.floor(F.col(time_col) / F.lit(interval_ns)).cast("bigint").alias("batch_id"))
            .agg(F.count(F.lit(1)).alias("changes"), F.countDistinct("tile_id").alias("tiles")))
