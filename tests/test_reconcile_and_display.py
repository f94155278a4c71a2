"""Reconciliation closes the diff; display and lookup helpers."""

from pyspark.sql import functions as F

from conftest import SF_SMALL
from terrastate.operators import geo, leaderboard as lb, ownership as ow, reconcile as rc
from terrastate.sources import clicks as src
from terrastate.sources import derived as d


def test_sync_plan_applied_empties_the_diff(spark):
    a_clicks, b_clicks = d.clicks_b(spark, SF_SMALL), d.clicks_b_replica(spark, SF_SMALL)
    a, b = ow.current_ownership(a_clicks), ow.current_ownership(b_clicks)
    diff = rc.ownership_diff(a, b)
    assert diff.count() == 79 and diff.filter(F.col("local_country").isNull()).count() == 20
    # Stamp the plan's requests later than anything in B's log (S4, deterministic form), replay into B.
    later = b_clicks.agg(F.max("timestamp_ns")).first()[0] + 1
    plan = rc.sync_plan(diff).withColumn("t", F.lit(later)).withColumn("id", F.col("tile_id") + 10**9)
    stamped = src.stamp_clicks(plan, click_id="id", timestamp_ns="t").select(
        "tile_id", "country_id", "timestamp_ns", F.col("click_id").cast("bigint").alias("click_id"),
        F.col("timestamp_ns").alias("arrival_ns"))
    b_after = ow.current_ownership(b_clicks.unionByName(stamped))
    assert rc.ownership_diff(a, b_after).count() == 0


def test_mirror_and_retake(spark):
    changes = spark.createDataFrame([(1, "fr", "ru"), (2, "es", "fr")],
                                    "tile_id bigint, country_id string, previous_country_id string")
    assert sorted(tuple(r) for r in rc.mirror_changes(changes).collect()) == [(1, "fr"), (2, "es")]
    tc = spark.createDataFrame([(1, "fr"), (2, "ru"), (3, "ru")], "tile_id bigint, country_code string")
    bad = rc.unauthorized_changes(changes, tc, "ru", "ru")
    assert [tuple(r) for r in rc.retake_requests(bad, "ru").collect()] == [(2, "ru")]


def test_display_and_scores(spark):
    own = spark.createDataFrame([(i, "xx" if i < 6 else "yy", 1) for i in range(10)],
                                "tile_id bigint, country_id string, timestamp_ns bigint")
    countries = spark.createDataFrame([("xx", "A Country With A Very Long Name"), ("yy", "Short")],
                                      "code string, name string")
    top = lb.leaderboard_display(own, countries, total=10, k=1).collect()
    assert [(r.rank, r.country_id, r.display_name, r.tiles, r.percent) for r in top] == [
        (1, "xx", "A Country With A V", 6, 60.0)]
    assert lb.country_score(own, "zz").first().score == 0
    assert lb.country_score(own, "yy").first().score == 4


def test_tile_lookups(spark):
    tc = spark.createDataFrame([(1, "fr"), (2, None), (3, "fr")], "tile_id bigint, country_code string")
    assert sorted(r.tile_id for r in geo.tiles_of_country(tc, "fr").collect()) == [1, 3]
    assert geo.country_of_tile(tc, 2).first().country_code is None
    assert [r.tile_id for r in geo.unassigned_tiles(tc).collect()] == [2]
    chunks = geo.country_tiles(tc, chunk=2).collect()
    assert sorted((r.chunk_no, r.tiles) for r in chunks) == [(0, [1]), (1, [3])]


def test_code_lists_and_totals(spark):
    from terrastate.operators import dims

    countries = spark.createDataFrame([("fr", "France"), ("ru", "Russia"), ("fr", "France")], "code string, name string")
    assert sorted(r.code for r in dims.codes(countries).collect()) == ["fr", "ru"]
    assert dims.size(countries).first().countries == 2
    tc = spark.createDataFrame([(1, "fr"), (2, None), (3, "fr"), (4, "ru")], "tile_id bigint, country_code string")
    assert sorted(r.country_code for r in geo.country_codes(tc).collect()) == ["fr", "ru"]
    assert tuple(geo.tile_totals(tc).first()) == (4, 3, 1)
