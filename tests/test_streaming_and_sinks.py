"""Stream = batch on the smallest fixture, sinks that write and read back,
and independence from the session time zone."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from terrastate.operators import leaderboard as lb
from terrastate.operators import ownership as ow
from terrastate.plans import load_all
from terrastate.session import scratch_path
from terrastate.sinks import writers
from terrastate.sinks.versions import Outbox
from terrastate.sources import derived as d
from terrastate.streaming.runners import CHANGE_SCHEMA


def rows(df, cols=None):
    cols = cols or sorted(df.columns)
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


def test_classify_stream_equals_batch(spark):
    q = load_all()
    stream = q["classify_stream"].build(spark, SF_SMALL)
    batch = ow.classify_clicks(d.clicks_a(spark, SF_SMALL))
    assert rows(stream) == rows(batch)


def test_ownership_and_leaderboard_stream_equal_batch(spark):
    q = load_all()
    own = ow.current_ownership(d.clicks_a(spark, SF_SMALL))
    assert rows(q["ownership_stream"].build(spark, SF_SMALL)) == rows(own)
    assert rows(q["leaderboard_stream"].build(spark, SF_SMALL)) == rows(lb.leaderboard(own))


def test_snapshot_write_upsert_and_range_read(spark):
    own = ow.current_ownership(d.clicks_b(spark, SF_SMALL))
    base = scratch_path(spark, "snap")
    old = own.filter(F.col("tile_id") < 100)
    writers.write_snapshot(old, base, partitions=4)
    merged = writers.upsert_snapshot(spark, base, own, scratch_path(spark, "snap2"))
    assert rows(merged) == rows(own)
    r = ow.ownerships_by_range(merged, 50, 150)
    assert r.count() == 101
    plan = r._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "GreaterThanOrEqual(tile_id,50)" in plan


def test_tile_country_files_reuse(spark):
    from terrastate.plans.geo_queries import tile_country

    folder = scratch_path(spark, "tc")
    tiles = d.tiles(spark, SF_SMALL)
    first = writers.load_or_build_tile_country(spark, folder, tiles, lambda: tile_country(spark, SF_SMALL))
    calls = []
    again = writers.load_or_build_tile_country(spark, folder, tiles, lambda: calls.append(1))
    assert not calls  # both files exist: reused, only the unassigned tiles recomputed
    assert rows(first) == rows(again) == rows(tile_country(spark, SF_SMALL))


def test_epoch_is_zone_independent(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        ny = rows(d.clicks_a(spark, SF_SMALL).select("click_id", "timestamp_ns"))
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    utc = rows(d.clicks_a(spark, SF_SMALL).select("click_id", "timestamp_ns"))
    assert ny == utc
    assert dict(utc)[0] // 1000 == 1704067798778549  # 2024-01-01 00:09:58.778549 (first event)


def test_page_records_bounded_rows(spark):
    own = ow.current_ownership(d.clicks_b(spark, SF_SMALL))
    pages = writers.page_records(ow.ownership_pages(own, page_size=50)).collect()
    assert sum(p.n_tiles for p in pages) == 200 and max(p.n_tiles for p in pages) <= 50


@pytest.mark.parametrize("hot_tile", [10**6, 5])
def test_classify_stream_with_ties_matches_fold(spark, hot_tile):
    import random

    from fold import fold
    from terrastate.plans.stream_queries import follow
    from terrastate.streaming import ownership as so
    from terrastate.streaming import runners

    rnd = random.Random(3)
    rows = [(rnd.randint(0, 5), rnd.choice("abc"), (rnd.randint(0, 300) // 40) * 40, i, rnd.randint(0, 5000))
            for i in range(800)]
    schema = "tile_id bigint, country_id string, timestamp_ns bigint, click_id bigint, arrival_ns bigint"
    clicks = spark.createDataFrame(rows, schema)
    out, state = scratch_path(spark, "ties-out"), scratch_path(spark, "ties-owners")
    sink = so.classify_sink(state, so.batch_files(out), hot_tile=hot_tile)
    follow(spark, None, lambda log, at: runners.start(log, sink, checkpoint=at), clicks)
    got = {r.click_id: (r.applied, r.previous_country, r.previous_ts) for r in spark.read.parquet(out).collect()}
    expect, _, _ = fold([dict(zip(["tile_id", "country_id", "timestamp_ns", "click_id", "arrival_ns"], r)) for r in rows])
    assert got == expect


def test_writers_round_trip(spark):
    from terrastate.operators import osm, points
    from terrastate.sources.clicks import read_clicks

    cities = osm.extract_cities(d.osm_nodes(spark, SF_SMALL))
    roads = osm.extract_roads(d.osm_ways(spark, SF_SMALL))
    p_c, p_r = scratch_path(spark, "cities"), scratch_path(spark, "roads")
    writers.write_cities(cities, p_c)
    writers.write_roads(roads, p_r)
    back_c = spark.read.parquet(p_c)
    assert back_c.count() == cities.count()
    assert back_c.filter(~F.col("geom").startswith("SRID=4326;POINT(")).count() == 0
    back_r = spark.read.parquet(p_r)
    assert rows(back_r.select("id", F.from_json("nodes", "array<bigint>").alias("nodes"))) == \
        rows(roads.select("id", "nodes"))

    own = ow.current_ownership(d.clicks_b(spark, SF_SMALL))
    p_p = scratch_path(spark, "pages")
    writers.write_pages(ow.ownership_pages(own, page_size=50), p_p)
    pages = spark.read.json(p_p)
    assert pages.agg(F.sum("n_tiles")).first()[0] == 200

    cls = ow.classify_clicks(d.clicks_a(spark, SF_SMALL))
    p_n = scratch_path(spark, "notes")
    writers.write_notifications(ow.ownership_changes(cls), p_n)
    assert Outbox(spark, p_n, CHANGE_SCHEMA).pending().count() == 350

    pts = points.xyz_to_uv(points.normalize_points(d.raw_points(spark, SF_SMALL)))
    land = points.land_filter(pts, d.land_mask(spark), d.MASK_W, d.MASK_H, d.MASK_THRESHOLD)
    p_l = scratch_path(spark, "land")
    writers.write_land_points(land, p_l)
    assert spark.read.parquet(p_l).count() == land.count() > 0

    # S1 from files: the written log reads back with the explicit schema
    p_log = scratch_path(spark, "log")
    d.clicks_a(spark, SF_SMALL).write.parquet(p_log)
    from pyspark.sql import types as T

    schema = T._parse_datatype_string("tile_id bigint, country_id string, timestamp_ns bigint, click_id bigint, arrival_ns bigint")
    assert read_clicks(p_log, spark, schema=schema).count() == 1000


def test_checkpoint_dir_and_cluster_conf(spark):
    from terrastate.session import checkpoint_dir, cluster_conf

    d1, d2 = checkpoint_dir(spark), checkpoint_dir(spark)
    assert d1 == d2 and d1  # read from the session, stable
    assert scratch_path(spark, "x").startswith(d1.rstrip("/")) and scratch_path(spark, "x") != scratch_path(spark, "x")
    conf = cluster_conf(100 * 2**40)
    assert int(conf["spark.sql.shuffle.partitions"]) == 409600
    assert conf["spark.sql.adaptive.skewJoin.enabled"] == "true"


def test_processing_time_runners(spark):
    from terrastate.sources.clicks import read_clicks
    from terrastate.streaming import ownership as so
    from terrastate.streaming import runners

    log, clicks = scratch_path(spark, "pt-log"), d.clicks_a(spark, SF_SMALL)
    clicks.write.parquet(log)
    stream = read_clicks(log, spark, stream=True, schema=clicks.schema)

    delivered = scratch_path(spark, "pt-delivered")
    q = runners.batched_delivery(stream, scratch_path(spark, "pt-owners"), so.batch_files(delivered), interval="1 second")
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert spark.read.parquet(delivered).count() == 350  # every change of clicks_a, delivered once

    runs = scratch_path(spark, "pt-audit")
    q = runners.periodic_audit(stream, lambda: ow.current_ownership(d.clicks_a(spark, SF_SMALL)), runs,
                               interval="1 second")
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    audited = spark.read.parquet(runs)
    assert audited.select("run").distinct().count() >= 1
    assert audited.filter(F.col("run") == audited.agg(F.max("run")).first()[0]).count() == 15


def _owners(spark, rows):
    return spark.createDataFrame(rows, "tile_id bigint, country_id string, timestamp_ns bigint")


def test_interrupted_tile_country_files_are_written_again(spark):
    folder = scratch_path(spark, "tc-cut")
    tiles = spark.createDataFrame([(1,), (2,)], "tile_id bigint")
    mapping = spark.createDataFrame([(1, "fr"), (2, None)], "tile_id bigint, country_code string")
    for name in ("tile_to_country", "country_to_tiles"):
        mapping.write.json(f"{folder}/{name}/_temporary/0")
    got = writers.load_or_build_tile_country(spark, folder, tiles, lambda: mapping)
    assert rows(got) == rows(mapping)


def test_dedup_stream_drops_no_click_that_was_never_seen(spark):
    from terrastate.sources.clicks import read_clicks
    from terrastate.streaming import ownership as so
    from terrastate.streaming import runners

    hour = 3_600_000_000_000
    schema = "tile_id bigint, country_id string, timestamp_ns bigint, click_id string, arrival_ns bigint"
    log, out, at, index = (scratch_path(spark, n) for n in ("late-log", "late-out", "late-ckpt", "late-ids"))
    batches = ([(1, "a", 1, "1", 100 * hour), (2, "a", 1, None, 100 * hour), (3, "a", 1, None, 100 * hour)],
               [(1, "a", 1, "2", 101 * hour), (1, "a", 1, "1", 101 * hour), (4, "a", 1, "", 101 * hour), (5, "a", 1, "", 101 * hour), (1, "a", 1, "2", 100 * hour)],
               [(1, "a", 1, "3", 90 * hour), (6, "a", 1, None, 90 * hour), (1, "a", 1, "2", 90 * hour)])
    for rows_ in batches:
        spark.createDataFrame(rows_, schema).write.mode("append").parquet(log)
        stream = read_clicks(log, spark, stream=True, schema=spark.read.parquet(log).schema)
        runners.start(stream, so.dedup_sink(index, so.batch_files(out)), checkpoint=at).awaitTermination()
    got = [(r.click_id, r.arrival_ns // hour) for r in spark.read.parquet(out).collect()]
    assert sorted(got, key=str) == sorted([("1", 100), (None, 100), (None, 100), ("2", 100), ("", 101), ("", 101), ("3", 90), (None, 90)], key=str)


def test_ownership_diff_stream_over_order_keys_whose_click_ids_pass_64_bits(spark, tmp_path):
    """An id of 20 digits overflowed; on equal times the least id owns the tile, also beyond 64 bits."""
    day, us = 1_700_000_000_000_000, 1  # microseconds
    big = 54_000_000  # a multiple of 3: the replica misses it
    lines = [(big, 1, 1, 1, day), (big + 1, 2, 2, 1, day), (big + 1, 7, 1, 2, day), (5, 1, 2, 1, day - 10 ** 9),
             # the same time on tile 3: 1 us less and 100 order keys more; (big + 1) has the least id
             (big + 1, 3, 2, 1, day), (big + 101, 3, 1, 1, day - us), (big + 201, 3, 1, 1, day - 2 * us),
             # on tile 4 the replica misses the owner (a key that 3 divides) and takes the other of the same time
             (big, 4, 1, 1, day), (big + 100, 4, 2, 1, day - us)]
    tables = {"lineitem": pa.table({"l_orderkey": pa.array([x[0] for x in lines], pa.int64()), "l_partkey": pa.array([x[1] for x in lines], pa.int64()),
                                    "l_suppkey": pa.array([x[2] for x in lines], pa.int64()), "l_linenumber": pa.array([x[3] for x in lines], pa.int32()),
                                    "l_shipdate": pa.array([x[4] for x in lines], pa.timestamp("us"))}),
              "supplier": pa.table({"s_suppkey": pa.array([1, 2], pa.int64()), "s_nationkey": pa.array([10, 20], pa.int32())}),
              "nation": pa.table({"n_nationkey": pa.array([10, 20], pa.int32()), "n_name": ["ONE", "TWO"]})}
    for name, rows in tables.items():
        pq.write_table(rows, tmp_path / f"{name}.parquet")
    got = load_all()["ownership_diff_stream"].build(spark, str(tmp_path)).collect()
    assert sorted(tuple(r) for r in got) == [(1, "one", "two"), (4, "one", "two"), (7, "one", None)]
