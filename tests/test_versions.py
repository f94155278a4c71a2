"""Versioned stores: writers killed at every step, bytes written, replays, redelivery, and the kept-up diff."""

import random

import pytest

from terrastate.operators import ownership as ow
from terrastate.operators.reconcile import ownership_diff
from terrastate.session import list_names, scratch_path
from terrastate.sinks import versions as V
from terrastate.streaming import ownership as so
from terrastate.streaming import runners

OWNERS = "tile_id bigint, country_id string, timestamp_ns bigint"
CLICKS = "tile_id bigint, country_id string, timestamp_ns bigint, click_id bigint, arrival_ns bigint"


class Killed(Exception):
    pass


def steps(monkeypatch, at):
    """Every write of data or manifest and every removal counts; number ``at`` is not done but kills the writer."""
    count = [0]

    def guard(fn):
        def run(*a, **k):
            count[0] += 1
            if count[0] == at:
                raise Killed
            return fn(*a, **k)
        return run

    monkeypatch.setattr(V, "write_text", guard(V.write_text))
    monkeypatch.setattr(V, "remove_path", guard(V.remove_path))
    monkeypatch.setattr(V.Versions, "write", guard(V.Versions.write))
    return count


def in_the_end(step):
    """A step that is done again where the writer was killed."""
    try:
        step()
    except Killed:
        step()


def owners(spark, rows):
    return spark.createDataFrame(rows, OWNERS)


def stored(store):
    return {r.tile_id: (r.country_id, r.timestamp_ns) for r in store.read().collect()}


def bytes_of(spark, path):
    fs = spark._jvm.org.apache.hadoop.fs.FileSystem.get(spark._jsc.hadoopConfiguration())
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return fs.getContentSummary(p).getLength() if fs.exists(p) else 0


def test_a_batch_writes_its_own_rows_only(spark):
    store = V.SnapshotStore(spark, scratch_path(spark, "snap"))
    store.add(owners(spark, [(t, "a", 10) for t in range(50_000)]), 0)
    before = bytes_of(spark, f"{store.path}/data")
    store.add(owners(spark, [(1, "b", 20), (2, "b", 5), (3, "b", 10)]), 1)
    assert bytes_of(spark, f"{store.path}/data") - before < 10_000 < before
    got = stored(store)
    assert len(got) == 50_000 and got[1] == ("b", 20) and got[2] == ("a", 10) and got[3] == ("a", 10)  # equal time: the stored one
    plan = ow.ownerships_by_range(store.read(), 5, 9)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("GreaterThanOrEqual(tile_id,5)") >= 2  # the range reaches the files of both folders


def test_killed_at_every_step_nothing_is_lost(spark, monkeypatch):
    rng = random.Random(1)
    batches = [[(t, rng.choice("abc"), rng.randrange(100)) for t in rng.sample(range(6), 3)] for _ in range(3)]
    at = killed = 0
    while True:
        at += 1
        store, expect, died = V.SnapshotStore(spark, scratch_path(spark, "kill"), fan=2, keep=1), {}, False
        with monkeypatch.context() as m:
            steps(m, at)
            for b, rows in enumerate(batches):
                after = dict(expect)
                for t, c, ts in rows:
                    if t not in after or ts > after[t][1]:
                        after[t] = (c, ts)
                try:
                    store.add(owners(spark, rows), b)
                except Killed:
                    died = True
                    assert stored(store) in (expect, after)  # as before, or whole
                    store.add(owners(spark, rows), b)  # the batch comes again
                expect = after
                assert stored(store) == expect
        killed += died
        if not died:
            break
    assert killed >= 6
    named = {f.name for n in store._numbers() for f in store.version(n).folders}
    assert set(list_names(spark, f"{store.path}/data")) == named  # what the killed writer left is gone


def test_levels_keep_folders_few(spark):
    store = V.SnapshotStore(spark, scratch_path(spark, "levels"), fan=3)
    for b in range(10):
        store.add(owners(spark, [(b % 5, f"c{b}", b)]), b)
        assert len(store.latest().folders) <= 2 * 3
    assert stored(store) == {t: (f"c{b}", b) for t, b in ((0, 5), (1, 6), (2, 7), (3, 8), (4, 9))}


def test_a_retried_batch_is_classified_from_the_version_before_it(spark, monkeypatch):
    batches = [[(1, "a", 10, 1, 1)], [(1, "b", 20, 2, 2), (1, "c", 15, 3, 3)], [(1, "d", 30, 4, 4), (2, "d", 1, 5, 5)]]
    want = {1: (True, None), 2: (True, "a"), 3: (False, "b"), 4: (True, "b"), 5: (True, None)}
    for at in (2, 4):
        state, out = scratch_path(spark, "retry-state"), scratch_path(spark, "retry-out")
        sink = so.classify_sink(state, so.batch_files(out))
        with monkeypatch.context() as m:
            steps(m, at)
            for b, rows in enumerate(batches):
                df = spark.createDataFrame(rows, CLICKS)
                for _ in range(2):  # once more, as after a failure of the stream's own commit
                    in_the_end(lambda: sink(df, b))
        got = spark.read.parquet(out).collect()
        assert {r.click_id: (r.applied, r.previous_country) for r in got} == want and len(got) == 5
        assert stored(V.SnapshotStore(spark, state)) == {1: ("d", 30), 2: ("d", 1)}


def test_leaderboard_totals_survive_retries(spark):
    state = scratch_path(spark, "board")
    sink = so.leaderboard_sink(state)
    for b, rows in enumerate([[(1, "a", 10, 1, 1), (2, "a", 10, 2, 2)], [(1, "b", 20, 3, 3)], [(2, "b", 30, 4, 4)]]):
        for _ in range(2):
            sink(spark.createDataFrame(rows, CLICKS), b)
    assert {r.country_id: r.score for r in so.leaderboard_totals(spark, state).read().collect()} == {"b": 2}


HOUR = 3_600_000_000_000


def test_retention_reads_no_store_and_replays_exactly(spark, monkeypatch):
    batches = [[(i, "a", 1, i, (10 + i) * HOUR + 5) for i in range(4)], [(9, "a", 1, 9, 11 * HOUR)], [(5, "a", 1, 5, 16 * HOUR + 5), (6, "a", 1, 6, 3 * HOUR)]]
    for at in (2, 5):
        log = V.RetainedLog(spark, scratch_path(spark, "kept"), 4 * HOUR, fan=2)
        with monkeypatch.context() as m:
            steps(m, at)
            m.setattr(V.Versions, "folder", None)  # a read of a folder would fail
            m.setattr(V.Versions, "merged", lambda self, folders: _union_of(self, folders))
            for b, rows in enumerate(batches):
                df = spark.createDataFrame(rows, CLICKS)
                in_the_end(lambda: log.add_batch(df, b))
        assert sorted(r.click_id for r in log.read().collect()) == [3, 5]  # 16:00 - 4 h: 13:00 stays, 12:00 doesn't
        hours = sorted({f.bucket for f in log.latest().folders})
        assert hours == [12, 13, 16]


def _union_of(store, folders):
    return store.spark.read.schema(store.schema).parquet(*[f"{store.path}/data/{f.name}" for f in folders])


def test_outbox_delivers_once(spark):
    rows = spark.createDataFrame([(1, "a", "b", 7, 70, 2), (2, "c", "d", 8, 80, 1)], runners.CHANGE_SCHEMA)
    box = V.Outbox(spark, scratch_path(spark, "outbox"), runners.CHANGE_SCHEMA)
    for batch in (0, 0, 1, 0, 1):
        box.put(rows, batch)
    got = sorted(tuple(r) for r in box.pending().collect())
    assert [r[0] for r in got] == [0, 0, 1, 1] and [r[2] for r in got] == [2, 1, 2, 1]  # positions follow the arrivals
    assert box.pending(after=0).count() == 2
    box.acknowledge(0)
    assert box.pending().count() == 2 and box.put(rows, 1).batch == 1 and box.pending().count() == 2


def test_redelivery(spark, monkeypatch):
    """A record failing twice then passing is applied once; one failing three times is a reject."""
    from pyspark.sql import functions as F

    names = [scratch_path(spark, n) for n in ("done", "given-up", "ledger")]
    now = [100]
    fails = F.when(F.col("id") == 1, F.when(F.col("attempt") < 3, F.lit("down"))).when(F.col("id") == 2, F.lit("broken"))
    sink = runners.redelivery_sink(lambda df: df.withColumn("error", fails), *names, ack_wait_ns=10, clock=lambda: now[0])

    def batch(ids, b, kill=0):
        df = spark.createDataFrame([(i,) for i in ids], "id bigint")
        with monkeypatch.context() as m:
            steps(m, kill)
            in_the_end(lambda: sink(df, b))

    batch([1, 2, 3], 0, kill=1)
    now[0] = 105
    batch([4], 1)  # not due yet
    now[0] = 110
    batch([], 2, kill=2)
    now[0] = 125
    batch([5], 3, kill=1)
    batch([], 4)
    done = sorted((r.id, r.attempt) for r in spark.read.parquet(names[0]).collect())
    assert done == [(1, 3), (3, 1), (4, 1), (5, 1)]
    assert [(r.id, r.attempt, r.reason) for r in spark.read.parquet(names[1]).collect()] == [(2, 3, "broken")]


def test_the_diff_kept_up_equals_the_whole_diff(spark, monkeypatch):
    rng = random.Random(4)
    path, clicks = scratch_path(spark, "diff"), []
    sink = runners.difference_sink(path)
    for b in range(4):
        rows = [(rng.randrange(8), rng.choice("ab"), rng.randrange(50), 100 * b + i, 100 * b + i, rng.choice(["prod", "local"])) for i in range(6)]
        clicks += rows
        df = spark.createDataFrame(rows, CLICKS + ", side string")
        with monkeypatch.context() as m:
            steps(m, rng.randrange(9))
            in_the_end(lambda: sink(df, b))
        every = spark.createDataFrame(clicks, CLICKS + ", side string")
        full = ownership_diff(*[ow.current_ownership(every.filter(every.side == s)) for s in ("prod", "local")])
        want = sorted((r.tile_id, r.prod_country, r.local_country or "") for r in full.collect())
        got = sorted((r.tile_id, r.prod_country, r.local_country or "") for r in runners.difference(spark, path).collect())
        assert got == want
        assert runners.difference_stores(spark, path)[2].latest().info["size"] == len(want)
    assert runners.audit_difference(spark, path) == 0
    view = runners.difference_stores(spark, path)[2]
    wrong = spark.createDataFrame([(100, "x", None, True)], runners.DIFFERENCE)
    view.add(wrong, view.latest().batch)
    assert runners.audit_difference(spark, path) == 1 and runners.audit_difference(spark, path) == 0


def test_stream_plans_have_no_python(spark):
    df = spark.createDataFrame([(1, "a", 10, 1, 1)], CLICKS)
    plans = []
    sink = so.classify_sink(scratch_path(spark, "p"), lambda rows, b: plans.append(rows._jdf.queryExecution().executedPlan().toString()))
    sink(df, 0)
    sink(df, 1)
    assert len(plans) == 2 and not any("Python" in p or "Pandas" in p or "Arrow" in p for p in plans)


@pytest.mark.parametrize("hot_tile", [10, 10**6])
def test_one_tile_with_all_clicks(spark, hot_tile):
    rows = [(1, f"c{i % 3}", (i * 37) % 500, i, i) for i in range(600)]
    out = scratch_path(spark, "hot-out")
    sink = so.classify_sink(scratch_path(spark, "hot"), so.batch_files(out), hot_tile=hot_tile)
    for b in range(2):
        sink(spark.createDataFrame(rows[300 * b:300 * (b + 1)], CLICKS), b)
    from fold import fold

    expect, _, _ = fold([dict(zip(["tile_id", "country_id", "timestamp_ns", "click_id", "arrival_ns"], r)) for r in rows])
    assert {r.click_id: (r.applied, r.previous_country, r.previous_ts) for r in spark.read.parquet(out).collect()} == expect
