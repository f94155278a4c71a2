"""Ownership, classification and leaderboards: the reference's own unit cases
(including the commented-out ones) and a sequential-fold oracle."""

import random

from pyspark.sql import functions as F

from fold import fold
from terrastate.operators import leaderboard as lb
from terrastate.operators import ownership as ow

SCHEMA = "tile_id bigint, country_id string, timestamp_ns bigint, click_id bigint, arrival_ns bigint"


def clicks_df(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def owners(df):
    return {r.tile_id: r.country_id for r in ow.current_ownership(df).collect()}


def board(df):
    return {r.country_id: r.score for r in lb.leaderboard(ow.current_ownership(df)).collect()}


def test_hot_tile_last_writer_wins(spark):
    rows = [(1, f"COUNTRY{i % 5}", 1000 + i, i, random.Random(i).randint(0, 10**6)) for i in range(100)]
    assert owners(clicks_df(spark, rows)) == {1: "COUNTRY4"}


def test_two_countries_leaderboard(spark):
    rows = [(i, f"COUNTRY{i % 2}", 10 + 10 * i, i, i) for i in range(10)]
    df = clicks_df(spark, rows)
    assert board(df) == {"COUNTRY0": 5, "COUNTRY1": 5}
    score = lb.country_score(ow.current_ownership(df), "COUNTRY2").first()
    assert score.score == 0


def test_index_moves_and_empty_removal(spark):
    rows = [(1, "country1", 1, 1, 1), (1, "country2", 2, 2, 2), (2, "country2", 3, 3, 3), (3, "country2", 4, 4, 4)]
    df = clicks_df(spark, rows)
    assert board(df) == {"country2": 3}
    inc = {r.country_id: r.score for r in lb.leaderboard_incremental(ow.classify_clicks(df)).collect()}
    assert inc == {"country2": 3}
    one = clicks_df(spark, [(1, "country1", 1, 1, 1), (1, "country2", 2, 2, 2)])
    assert {r.country_id: r.score for r in lb.leaderboard_incremental(ow.classify_clicks(one)).collect()} == {"country2": 1}


def test_mass_move(spark):
    rows = [(i, "country1", 10 + i, i, i) for i in range(10)] + [(i, "country2", 100 + i, 100 + i, 100 + i) for i in range(10)]
    assert board(clicks_df(spark, rows)) == {"country2": 10}


def test_save_get_counts_range_update(spark):
    one = clicks_df(spark, [(1, "country1", 5, 1, 1)])
    c = ow.classify_clicks(one).first()
    assert c.applied and c.previous_country is None
    assert ow.get_tile(ow.current_ownership(one), 1).first().country_id == "country1"
    five = clicks_df(spark, [(i, f"country{i % 2}", 10 + i, i, i) for i in range(5)])
    assert board(five) == {"country0": 3, "country1": 2}
    ten = clicks_df(spark, [(i, f"country{i % 3}", 10 + i, i, i) for i in range(10)])
    rng = ow.ownerships_by_range(ow.current_ownership(ten), 2, 6).collect()
    assert sorted((r.tile_id, r.country_id) for r in rng) == [(t, f"country{t % 3}") for t in range(2, 7)]
    upd = clicks_df(spark, [(1, "country1", 1, 1, 1), (1, "country2", 2, 2, 2)])
    prev = {r.click_id: r.previous_country for r in ow.classify_clicks(upd).collect()}
    assert prev == {1: None, 2: "country1"}
    assert owners(upd) == {1: "country2"}


def test_concurrent_one_tile_one_owner(spark):
    rows = [(1, f"c{i}", 7, i, 100 - i) for i in range(10)]  # equal times: first arrival wins
    assert owners(clicks_df(spark, rows)) == {1: "c9"}


def _random_log(seed, n=3000, tiles=12, tie_every=3):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        ts = rnd.randint(0, 400)
        if i % tie_every == 0:
            ts = (ts // 50) * 50  # many equal times
        rows.append((rnd.randint(0, tiles - 1), rnd.choice("abcde"), ts, i, rnd.randint(0, 10_000)))
    return rows


def _check_against_fold(spark, rows, **kw):
    df = clicks_df(spark, rows)
    expect, state, expect_board = fold([dict(zip(["tile_id", "country_id", "timestamp_ns", "click_id", "arrival_ns"], r))
                                       for r in rows])
    got = {r.click_id: (r.applied, r.previous_country, r.previous_ts) for r in ow.classify_clicks(df, **kw).collect()}
    assert got == expect
    assert owners(df) == {t: c for t, (c, _) in state.items()}
    inc = {r.country_id: r.score for r in lb.leaderboard_incremental(ow.classify_clicks(df, **kw)).collect()}
    assert inc == expect_board


def test_classify_matches_fold_with_ties(spark):
    _check_against_fold(spark, _random_log(1))


def test_classify_cut_into_many_parts(spark):
    for n in (1, 3, 40):
        _check_against_fold(spark, _random_log(2), buckets=n)


def test_classify_one_instant_is_cut_by_the_other_order_columns(spark):
    rnd = random.Random(7)
    rows = [(1, rnd.choice("abcd"), rnd.randint(0, 300), i, 5) for i in range(1000)]
    _check_against_fold(spark, rows, buckets=50)
    parts = clicks_df(spark, rows).repartitionByRange(50, "tile_id", "arrival_ns", "click_id").groupBy(F.spark_partition_id()).count()
    assert parts.agg(F.max("count")).first()[0] <= 60


def test_classify_string_order_is_the_same_at_any_size(spark):
    rows = _random_log(6, n=400, tiles=3)
    df = clicks_df(spark, rows).withColumn("seq", F.format_string("%09d", F.col("arrival_ns") * 1000 + F.col("click_id") % 1000)).withColumn(
        "seq", F.concat(F.lit("s"), "seq"))
    results = [sorted(ow.classify_clicks(df, ("seq", "click_id"), buckets=n).select("click_id", "applied", "previous_country", "previous_ts").collect())
               for n in (1, 20)]
    assert results[0] == results[1]


def test_changes_modes(spark):
    rows = [(1, "a", 10, 1, 1), (1, "b", 5, 2, 2), (1, "b", 20, 3, 3), (1, "b", 30, 4, 4)]
    cls = ow.classify_clicks(clicks_df(spark, rows))
    default = [(r.click_id, r.previous_country_id) for r in ow.ownership_changes(cls).orderBy("click_id").collect()]
    parity = [(r.click_id, r.previous_country_id) for r in ow.ownership_changes(cls, parity=True).orderBy("click_id").collect()]
    assert default == [(3, "a")]  # first claim silent, same-country click silent
    assert parity == [(2, "a"), (3, "a")]  # stale click 2 also notifies


def test_dedup_and_bootstrap(spark):
    rows = [(1, "a", 10, 1, 5), (1, "a", 10, 1, 9), (2, "b", 3, 2, 1)]
    d = ow.dedup_clicks(clicks_df(spark, rows)).collect()
    assert sorted((r.click_id, r.arrival_ns) for r in d) == [(1, 5), (2, 1)]
    snap = spark.createDataFrame([(1, "s", 10)], "tile_id bigint, country_id string, timestamp_ns bigint")
    log = clicks_df(spark, [(1, "a", 10, 1, 1), (2, "b", 1, 2, 2)])
    got = {r.tile_id: r.country_id for r in ow.bootstrap_ownership(snap, log).collect()}
    assert got == {1: "s", 2: "b"}  # equal time: the snapshot (earliest) keeps the tile


def test_pages_parity_fixture(spark):
    from terrastate.sources import derived as d
    from conftest import SF_SMALL

    own = ow.current_ownership(d.clicks_b(spark, SF_SMALL))
    pages = ow.ownership_pages(own, tile_count=200, page_size=50, parity=True)
    rows = pages.collect()
    assert len(rows) == 202
    tiles = [r.tile_id for r in rows]
    assert 0 not in tiles and all(tiles.count(t) == 2 for t in (51, 101, 151))
    assert ow.ownership_pages(own, page_size=50).count() == 200


def test_leaderboard_fixture_values(spark):
    from terrastate.sources import derived as d
    from conftest import SF_SMALL

    top = lb.leaderboard_ranked(ow.current_ownership(d.clicks_b(spark, SF_SMALL)), k=3).collect()
    assert [(r.country_id, r.score) for r in top] == [("nation_21", 27), ("nation_18", 26), ("nation_19", 24)]
    a = {r.country_id: r.score for r in lb.leaderboard(ow.current_ownership(d.clicks_a(spark, SF_SMALL))).collect()}
    assert a == {"purchase": 5, "click": 3, "error": 3, "signup": 2, "view": 2}


def test_classify_fixture_counts(spark):
    from terrastate.sources import derived as d
    from conftest import SF_SMALL

    cls = ow.classify_clicks(d.clicks_a(spark, SF_SMALL)).cache()
    assert cls.filter("applied").count() == 430
    assert cls.filter(F.col("previous_country").isNull()).count() == 15
    assert ow.ownership_changes(cls).count() == 350
    assert ow.ownership_changes(cls, parity=True).count() == 809


def test_property_classify_equals_fold(spark):
    """Property: on any small log (ties, shuffled arrivals), both plans equal the fold."""
    from hypothesis import HealthCheck, given, settings, strategies as st

    click = st.tuples(st.integers(0, 3), st.sampled_from("abc"), st.integers(0, 6), st.integers(0, 50))

    @settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
    @given(st.lists(click, min_size=1, max_size=40))
    def check(raw):
        rows = [(t, c, ts, i, arr) for i, (t, c, ts, arr) in enumerate(raw)]
        _check_against_fold(spark, rows)
        _check_against_fold(spark, rows, buckets=7)

    check()


def test_classify_keeps_columns_of_any_name(spark):
    rows = [(1, "a", 10, 1, 1, "mine", "p", "c", "s"), (1, "b", 20, 2, 2, "yours", "q", "d", "t")]
    df = spark.createDataFrame(rows, SCHEMA + ", _bucket string, _Prev string, _carry string, _seen string")
    df = df.withColumn("_part", F.lit("part")).withColumn("_since", F.lit("since")).withColumn("_owner", F.lit("owner")).withColumn("_previous", F.lit("x"))
    for n in (None, 3):
        got = ow.classify_clicks(df, buckets=n)
        assert got.columns == [*df.columns, "applied", "previous_country", "previous_ts"]
        assert sorted(tuple(r)[:-3] for r in got.collect()) == sorted(tuple(r) for r in df.collect())


def test_classify_with_owners_from_before(spark):
    before = spark.createDataFrame([(1, "z", 50), (2, "y", 5), (4, "w", 1)], "tile_id bigint, country_id string, timestamp_ns bigint")
    rows = [(1, "a", 50, 1, 1), (1, "b", 60, 2, 2), (1, "c", 55, 3, 3), (2, "a", 6, 4, 1), (3, "a", 1, 5, 1), (3, "b", 1, 6, 2)]
    want = {1: (False, "z", 50), 2: (True, "z", 50), 3: (False, "b", 60), 4: (True, "y", 5), 5: (True, None, None), 6: (False, "a", 1)}
    for n in (None, 1, 4):
        got = ow.classify_clicks(clicks_df(spark, rows), buckets=n, before=before).collect()
        assert {r.click_id: (r.applied, r.previous_country, r.previous_ts) for r in got} == want


def test_a_null_country_is_an_owner(spark):
    rows = [(1, "a", 1, 1, 1), (1, None, 2, 2, 2), (1, "b", 3, 3, 3)]
    for n in (None, 3):
        got = {r.click_id: (r.applied, r.previous_country, r.previous_ts) for r in ow.classify_clicks(clicks_df(spark, rows), buckets=n).collect()}
        assert got == {1: (True, None, None), 2: (True, "a", 1), 3: (True, None, 2)}


def test_clicks_without_an_id_are_not_one_click(spark):
    rows = [(1, "a", 1, None, 1), (1, "a", 1, None, 1), (2, "a", 1, 7, 9), (2, "a", 1, 7, 3)]
    got = sorted(tuple(r) for r in ow.dedup_clicks(clicks_df(spark, [r for r in rows if r[3]])).collect())
    assert got == [(2, "a", 1, 7, 3)]
    assert ow.dedup_clicks(clicks_df(spark, rows)).count() == 3
    text = clicks_df(spark, rows).withColumn("click_id", F.when(F.col("click_id").isNull(), F.lit("")).otherwise(F.col("click_id").cast("string")))
    assert ow.dedup_clicks(text).count() == 3


def test_arrival_log_is_classified_where_it_lies(spark):
    import pytest

    from terrastate.operators.arrivals import ArrivalLog
    from terrastate.session import list_names, scratch_path

    rows = sorted(_random_log(9), key=lambda r: (r[4], r[3]))
    log = ArrivalLog(spark, scratch_path(spark, "arrivals"))
    for at in range(0, 3000, 1000):
        assert log.append(clicks_df(spark, rows[at:at + 1000]), parts=7) == at // 1000
    expect, _, _ = fold([dict(zip(["tile_id", "country_id", "timestamp_ns", "click_id", "arrival_ns"], r)) for r in rows])

    def found(df):
        return {r.click_id: (r.applied, r.previous_country, r.previous_ts) for r in df.collect()}

    files = [list_names(spark, f"{log.path}/{k}") for k in ("rows", "bests", "published")]
    assert found(log.classified()) == expect
    assert found(log.classified(first=2)) == {r[3]: expect[r[3]] for r in rows[2000:]}
    assert files == [list_names(spark, f"{log.path}/{k}") for k in ("rows", "bests", "published")]  # nothing was written
    with pytest.raises(ValueError):
        log.append(clicks_df(spark, rows[:5]))
    assert found(log.classified()) == expect and log.clicks().count() == 3000
