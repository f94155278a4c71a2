"""Registered queries that run Structured Streaming end to end (O2, O3-stream,
O4-stream, L4-stream, K1 on a stream).

Each query follows a log that grows: the earlier half of the clicks (by arrival)
is appended to it and the stream catches up, then the later half is appended and
the stream goes on from its checkpoint.  Both appends are ordinary distributed
writes.  The stream's output is read back, so each result can be compared with
the batch oracle (stream = batch)."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrastate.operators.arrivals import ArrivalLog
from terrastate.operators.ownership import classify_clicks, current_ownership, ownership_changes
from terrastate.operators.reconcile import ownership_diff
from terrastate.plans.ownership_queries import RETENTION_NS
from terrastate.plans.registry import register
from terrastate.plans.sql import CLICKS_A, classified, own, with_
from terrastate.session import scratch_path
from terrastate.sinks import writers
from terrastate.sinks.versions import Outbox, RetainedLog, SnapshotStore
from terrastate.sources import derived as d
from terrastate.sources.clicks import read_clicks
from terrastate.streaming import ownership as so
from terrastate.streaming import runners


def geo_queries_sql(name: str) -> str:
    from terrastate.plans import geo_queries  # noqa: F401
    from terrastate.plans.registry import QUERIES

    return QUERIES[name].oracle


def follow(spark, sf, run, clicks=None) -> None:
    """``run(stream, checkpoint)`` starts a query on the growing log of ``clicks``
    (default ``clicks_a``); it is started again, from its checkpoint, after the
    second append."""
    clicks = d.clicks_a(spark, sf) if clicks is None else clicks
    path, checkpoint = scratch_path(spark, "click-log"), scratch_path(spark, "stream")
    middle = clicks.agg(F.percentile_approx("arrival_ns", 0.5)).scalar()
    for part in (F.col("arrival_ns") <= middle, F.col("arrival_ns") > middle):
        clicks.filter(part).write.mode("append").parquet(path)
        run(read_clicks(path, spark, stream=True, schema=clicks.schema), checkpoint).awaitTermination()


def stored_tile_country(spark, sf):
    """The tile mapping as K3 keeps it: computed once, read by every micro-batch."""
    from terrastate.plans.geo_queries import tile_country

    folder = scratch_path(spark, "tile-country")
    return writers.load_or_build_tile_country(spark, folder, d.tiles(spark, sf), lambda: tile_country(spark, sf))


@register("click_log_stream", "S1", with_(CLICKS_A) + "SELECT * FROM clicks_a")
def q_click_log_stream(spark, sf):
    """The log followed from its start, across a restart."""
    out = scratch_path(spark, "log-copy")
    follow(spark, sf, lambda log, at: runners.start(log, path=out, checkpoint=at))
    return spark.read.parquet(out)


@register("retained_clicks_stream", "T1", with_(CLICKS_A) + f"""
SELECT * FROM clicks_a WHERE arrival_ns > (SELECT max(arrival_ns) FROM clicks_a) - {RETENTION_NS}""")
def q_retained_clicks_stream(spark, sf):
    """What the store holds after the log was followed to its end."""
    store = scratch_path(spark, "retained")
    follow(spark, sf, lambda log, at: runners.start(log, runners.retention_sink(store, RETENTION_NS), checkpoint=at))
    return RetainedLog(spark, store, RETENTION_NS).read()


@register("snapshot_files", "K1", with_(CLICKS_A, own("clicks_a", "own_a")) + "SELECT * FROM own_a")
def q_snapshot_files(spark, sf):
    """The batch sink: a version, its upsert, read back."""
    clicks, base = d.clicks_a(spark, sf), scratch_path(spark, "snapshot")
    half = clicks.agg(F.percentile_approx("arrival_ns", 0.5)).scalar()
    writers.write_snapshot(current_ownership(clicks.filter(F.col("arrival_ns") <= half)), base)
    return writers.upsert_snapshot(spark, base, current_ownership(clicks.filter(F.col("arrival_ns") > half)), f"{base}-next")


@register("notification_files", "K2", with_(CLICKS_A, classified("clicks_a", "cls")) + """
SELECT tile_id, country_id, previous_country AS previous_country_id, click_id, timestamp_ns, arrival_ns FROM cls
WHERE previous_country IS NOT NULL AND previous_country <> country_id AND applied""")
def q_notification_files(spark, sf):
    """The batch sink, written twice (a retry) and read by a listener."""
    path = scratch_path(spark, "notifications")
    changes = ownership_changes(classify_clicks(d.clicks_a(spark, sf)))
    writers.write_notifications(changes, path)
    return writers.write_notifications(changes, path).pending().drop("batch", "position")


@register("ownership_stream", "O2", with_(CLICKS_A, own("clicks_a", "own_a")) + "SELECT * FROM own_a")
def q_ownership_stream(spark, sf):
    snapshot = scratch_path(spark, "snapshot")
    follow(spark, sf, lambda log, at: runners.start(so.ownership_stream(log), runners.snapshot_upsert_sink(snapshot), mode="update", checkpoint=at))
    return SnapshotStore(spark, snapshot).read()


@register("classify_stream", "O3", with_(CLICKS_A, classified("clicks_a", "cls")) + "SELECT * FROM cls")
def q_classify_stream(spark, sf):
    out, state = scratch_path(spark, "classified"), scratch_path(spark, "owners")
    follow(spark, sf, lambda log, at: runners.start(log, so.classify_sink(state, so.batch_files(out)), checkpoint=at))
    return spark.read.parquet(out).drop("batch")


@register("changes_stream", "O4", with_(CLICKS_A, classified("clicks_a", "cls")) + """
SELECT tile_id, country_id, previous_country AS previous_country_id, click_id, timestamp_ns, arrival_ns FROM cls
WHERE previous_country IS NOT NULL AND previous_country <> country_id AND applied""")
def q_changes_stream(spark, sf):
    outbox, state = scratch_path(spark, "changes"), scratch_path(spark, "owners")
    follow(spark, sf, lambda log, at: runners.start(log, runners.notification_sink(state, outbox), checkpoint=at))
    return Outbox(spark, outbox, runners.CHANGE_SCHEMA).pending().drop("batch", "position")


@register("leaderboard_stream", "L4", with_(CLICKS_A, own("clicks_a", "own_a"))
          + "SELECT country_id, count(*) AS score FROM own_a GROUP BY country_id")
def q_leaderboard_stream(spark, sf):
    state = scratch_path(spark, "leaderboard")
    follow(spark, sf, lambda log, at: runners.start(log, so.leaderboard_sink(state), checkpoint=at))
    return so.leaderboard_totals(spark, state).read()


@register("mirror_changes_stream", "R5", with_(CLICKS_A, classified("clicks_a", "cls")) + """
SELECT tile_id, country_id FROM cls WHERE applied AND previous_country IS NOT NULL AND previous_country <> country_id""")
def q_mirror_changes_stream(spark, sf):
    out, state = scratch_path(spark, "mirror"), scratch_path(spark, "owners")
    deliver = so.batch_files(out, lambda rows: runners.mirror(ownership_changes(rows)))
    follow(spark, sf, lambda log, at: runners.start(log, so.classify_sink(state, deliver), checkpoint=at))
    return spark.read.parquet(out).drop("batch")


@register("unauthorized_changes_stream", "R4", geo_queries_sql("unauthorized_changes"))
def q_unauthorized_changes_stream(spark, sf):
    from terrastate.plans.geo_queries import TARGET, WANTED

    out, state, tc = scratch_path(spark, "watch"), scratch_path(spark, "owners"), stored_tile_country(spark, sf)
    deliver = so.batch_files(out, lambda rows: runners.watch_country(ownership_changes(rows), tc, TARGET, WANTED))
    follow(spark, sf, lambda log, at: runners.start(log, so.classify_sink(state, deliver), checkpoint=at), d.clicks_b(spark, sf))
    return spark.read.parquet(out).drop("batch")


@register("dedup_clicks_stream", "O5", with_(CLICKS_A) + "SELECT tile_id, country_id, timestamp_ns, click_id FROM clicks_a")
def q_dedup_clicks_stream(spark, sf):
    c = d.clicks_a(spark, sf)
    twice = c.unionByName(c.withColumn("arrival_ns", F.col("arrival_ns") + F.lit(1_000_000_000)))
    out, index = scratch_path(spark, "dedup"), scratch_path(spark, "ids")
    deliver = so.batch_files(out, lambda rows: rows.select("tile_id", "country_id", "timestamp_ns", "click_id"))
    follow(spark, sf, lambda log, at: runners.start(log, so.dedup_sink(index, deliver), checkpoint=at), twice)
    return spark.read.parquet(out).drop("batch")


@register("reject_table_stream", "T4", with_(CLICKS_A) + """
SELECT click_id AS source_id, 'truncated length-delimited field' AS reason FROM clicks_a WHERE click_id % 101 = 0""")
def q_reject_table_stream(spark, sf):
    raw = scratch_path(spark, "payload-log")
    d.payloads(spark, sf).write.parquet(raw)
    valid, rejects = scratch_path(spark, "valid"), scratch_path(spark, "rejects")
    stream = spark.readStream.schema("source_id bigint, payload binary").option("maxFilesPerTrigger", 1).parquet(raw)
    q = runners.start(stream, runners.quarantine_sink(valid, rejects), name="quarantine")
    q.awaitTermination()
    return spark.read.parquet(rejects).drop("batch")


@register("redelivery_stream", "T4", with_(CLICKS_A) + """
SELECT click_id AS source_id, 3 AS attempt, 'truncated length-delimited field' AS reason, false AS handled FROM clicks_a WHERE click_id % 101 = 0
UNION ALL
SELECT click_id, CASE WHEN click_id % 7 = 0 THEN 3 ELSE 1 END, NULL, true FROM clicks_a WHERE click_id % 101 <> 0""")
def q_redelivery_stream(spark, sf):
    """Payloads decoded batch by batch. Broken ones fail at each of three deliveries; with every seventh the store is down
    at the first two. What has been handled and what was given up, with the number of the last attempt."""
    from terrastate.sources.clicks import decode_payloads

    raw, done, rejects, ledger = (scratch_path(spark, n) for n in ("payload-log", "handled", "rejects", "ledger"))
    now = [0]

    def handle(records):
        down = F.when((F.col("source_id") % 7 == 0) & (F.col("attempt") < 3), F.lit("store is down"))
        return decode_payloads(records.withColumn("body", F.col("payload")), "body").withColumn("error", F.coalesce("error", down))

    def clock():
        now[0] += runners.ACK_WAIT_NS
        return now[0]

    sink = runners.redelivery_sink(handle, done, rejects, ledger, clock=clock)
    checkpoint = scratch_path(spark, "stream")
    payloads = d.payloads(spark, sf)
    for part in (0, 1, 2, 3):  # the log grows; what waits is delivered again with what comes
        payloads.filter(F.pmod(F.xxhash64("source_id"), F.lit(2)) == part if part < 2 else F.lit(False)).write.mode("append").parquet(raw)
        stream = spark.readStream.schema("source_id bigint, payload binary").parquet(raw)
        runners.start(stream, sink, checkpoint=checkpoint).awaitTermination()
    handled = spark.read.parquet(done).select("source_id", "attempt", F.lit(None).cast("string").alias("reason"), F.lit(True).alias("handled"))
    return handled.unionByName(spark.read.parquet(rejects).select("source_id", "attempt", "reason", F.lit(False).alias("handled")))


@register("ownership_diff_stream", "T6", geo_queries_sql("ownership_diff"))
def q_ownership_diff_stream(spark, sf):
    """Both environments' clicks followed by one stream; the diff is kept up tile by tile."""
    path = scratch_path(spark, "difference")
    clicks = (d.clicks_b(spark, sf, wide=True).withColumn("side", F.lit("prod"))
              .unionByName(d.clicks_b_replica(spark, sf, wide=True).withColumn("side", F.lit("local"))))
    follow(spark, sf, lambda log, at: runners.start(log, runners.difference_sink(path, audit_every=2), checkpoint=at), clicks)
    return runners.difference(spark, path)


@register("periodic_diff", "T6", geo_queries_sql("ownership_diff"))
def q_periodic_diff(spark, sf):
    """The whole diff of two environments' snapshots, taken again and again beside the streams that keep them."""
    prod, local, runs = scratch_path(spark, "prod"), scratch_path(spark, "local"), scratch_path(spark, "diff-runs")
    owners = current_ownership(d.clicks_b_replica(spark, sf))
    SnapshotStore(spark, local).add(owners)

    def diff():
        return ownership_diff(SnapshotStore(spark, prod).read(), SnapshotStore(spark, local).read())

    def run(log, at):
        runners.start(so.ownership_stream(log), runners.snapshot_upsert_sink(prod), mode="update", checkpoint=f"{at}/snapshot").awaitTermination()
        return runners.periodic_audit(log, diff, runs, checkpoint=f"{at}/diff", available_now=True)

    follow(spark, sf, run, d.clicks_b(spark, sf))
    all_runs = spark.read.parquet(runs)
    last = all_runs.agg(F.max("run")).scalar()
    return all_runs.filter(F.col("run") == last).drop("run")


@register("periodic_audit", "T6", geo_queries_sql("claim_audit"))
def q_periodic_audit(spark, sf):
    """The snapshot is kept by K1's sink; next to it the claim audit (R3) is run
    again and again; the last run is the audit of the final state."""
    from terrastate.operators.reconcile import claim_audit
    from terrastate.plans.geo_queries import TARGET, WANTED

    snapshot, runs = scratch_path(spark, "audit-snapshot"), scratch_path(spark, "audit-runs")
    tc = stored_tile_country(spark, sf)

    def audit():
        return claim_audit(tc, SnapshotStore(spark, snapshot).read(), TARGET, WANTED)

    def run(log, at):
        runners.start(so.ownership_stream(log), runners.snapshot_upsert_sink(snapshot), mode="update",
                      checkpoint=f"{at}/snapshot").awaitTermination()
        return runners.periodic_audit(log, audit, runs, checkpoint=f"{at}/audit", available_now=True)

    follow(spark, sf, run, d.clicks_b(spark, sf))
    all_runs = spark.read.parquet(runs)
    last = all_runs.agg(F.max("run")).scalar()
    return all_runs.filter(F.col("run") == last).drop("run")


@register("change_batches_stream", "T3", with_(CLICKS_A, classified("clicks_a", "cls")) + """
SELECT tile_id, country_id, previous_country AS previous_country_id, click_id, timestamp_ns, arrival_ns FROM cls
WHERE previous_country IS NOT NULL AND previous_country <> country_id AND applied""")
def q_change_batches_stream(spark, sf):
    """Changes handed to a listener batch by batch; everything delivered, once."""
    out, state = scratch_path(spark, "delivered"), scratch_path(spark, "owners")
    follow(spark, sf, lambda log, at: runners.batched_delivery(log, state, so.batch_files(out), checkpoint=at, available_now=True))
    return spark.read.parquet(out).drop("batch")


@register("classify_log", "O3", with_(CLICKS_A, classified("clicks_a", "cls")) + "SELECT * FROM cls")
def q_classify_log(spark, sf):
    """A log stored in two generations and classified where it lies: a call writes nothing."""
    log, clicks = ArrivalLog(spark, scratch_path(spark, "arrival-log")), d.clicks_a(spark, sf)
    middle = clicks.agg(F.percentile_approx("arrival_ns", 0.5)).scalar()
    for part in (F.col("arrival_ns") <= middle, F.col("arrival_ns") > middle):
        log.append(clicks.filter(part))
    return log.classified()
