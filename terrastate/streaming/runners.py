"""Starting and sinking stream queries (K1, K2, R4, R5, T3, T4, T6 on streams).

Every sink writes to caller-given shared folders; checkpoints live under the
session's ``spark.checkpoint.dir`` unless given.  ``foreachBatch`` bodies are
idempotent per ``batch_id``: they overwrite the batch's own output folder or
publish a version that starts from the one before the batch, so a micro-batch
that is run again after a failure at any step gives the same result.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from terrastate.operators.ownership import DEFAULT_ORDER, current_ownership, ownership_changes
from terrastate.operators.reconcile import mirror_changes, ownership_diff, unauthorized_changes
from terrastate.session import remove_path, scratch_path
from terrastate.sinks.versions import LatestStore, Outbox, RetainedLog, SnapshotStore, Versions, columns_of
from terrastate.streaming.ownership import classify_sink

CHANGE_SCHEMA = "tile_id bigint, country_id string, previous_country_id string, click_id bigint, timestamp_ns bigint, arrival_ns bigint"
ACK_WAIT_NS = 30_000_000_000  # fixed value: the default wait for an acknowledgement


def _checkpoint(spark: SparkSession, checkpoint: str | None, name: str) -> str:
    return checkpoint or scratch_path(spark, f"stream-{name}")


def start(df: DataFrame, sink: Callable[[DataFrame, int], None] | None = None, *, path: str | None = None,
          fmt: str = "parquet", mode: str = "append", checkpoint: str | None = None, available_now: bool = True,
          processing_time: str | None = None, name: str = "query") -> StreamingQuery:
    """Start a stream either into files (append) or through ``foreachBatch``."""
    w = df.writeStream.outputMode(mode).option("checkpointLocation", _checkpoint(df.sparkSession, checkpoint, name))
    if processing_time:
        w = w.trigger(processingTime=processing_time)
    elif available_now:
        w = w.trigger(availableNow=True)
    if sink is not None:
        return w.foreachBatch(sink).start()
    return w.format(fmt).start(path)


def snapshot_upsert_sink(snapshot_path: str) -> Callable[[DataFrame, int], None]:
    """K1 on a stream: each batch's owners (one row per tile) become one more folder of the ``SnapshotStore``.

    A batch writes its own rows only, and is in the snapshot from the moment its manifest is published; a sink killed at any
    step leaves the version before.  Adding a batch again changes nothing, so a restart may start from any version."""
    def sink(batch: DataFrame, batch_id: int) -> None:
        SnapshotStore(batch.sparkSession, snapshot_path).add(batch, batch_id)
    return sink


def retention_sink(path: str, retention_ns: int, time_col: str = "arrival_ns") -> Callable[[DataFrame, int], None]:
    """T1 on a stream: each batch goes into the ``RetainedLog``."""
    def sink(batch: DataFrame, batch_id: int) -> None:
        RetainedLog(batch.sparkSession, path, retention_ns, time_col).add_batch(batch, batch_id)
    return sink


def notification_sink(state_path: str, outbox_path: str, schema: str = CHANGE_SCHEMA, order_cols: tuple[str, ...] = DEFAULT_ORDER,
                      parity: bool = False) -> Callable[[DataFrame, int], None]:
    """K2 / O4 on a stream: the change notifications of each batch of clicks, put into the outbox once."""
    def deliver(classified: DataFrame, batch_id: int) -> None:
        outbox = Outbox(classified.sparkSession, outbox_path, schema, order_cols)
        outbox.put(ownership_changes(classified, parity=parity), batch_id)
    return classify_sink(state_path, deliver, order_cols)


def difference_sink(path: str, audit_every: int = 0) -> Callable[[DataFrame, int], None]:
    """The ownership diff (R1) of two environments, kept up as their clicks arrive.

    The batch holds clicks of both, told apart by ``side`` ("prod" or "local").  Owners of either side are snapshots; for the
    tiles a batch touches, and no others, the diff is taken again and becomes one more folder of the view.  The number of
    tiles that differ is kept in the view's manifest: +1 and -1 for each tile whose answer changed.  Every ``audit_every``
    batches the whole diff is taken and compared (``audit_difference``)."""
    def sink(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        prod, local, view = difference_stores(spark, path)
        clicks = batch.persist()
        try:
            for store, side in ((prod, "prod"), (local, "local")):
                store.add(current_ownership(clicks.filter(F.col("side") == side)), batch_id)
            touched = clicks.select("tile_id").distinct()
            now = _difference(prod.read().join(touched, "tile_id", "left_semi"), local.read(), touched)
            parent = view.before(batch_id)
            was = view.read(parent).join(touched, "tile_id", "left_semi").select("tile_id", F.col("differs").alias("differed"))
            rows = now.join(was, "tile_id", "left").persist()
            step = F.col("differs").cast("int") - F.coalesce("differed", F.lit(False)).cast("int")
            size = parent.info.get("size", 0) + (rows.agg(F.sum(step)).first()[0] or 0)
            view.add(rows.drop("differed"), batch_id, parent, {"size": size})
            rows.unpersist()
            if audit_every and (batch_id + 1) % audit_every == 0:
                audit_difference(spark, path)
        finally:
            clicks.unpersist()
    return sink


DIFFERENCE = "tile_id bigint, prod_country string, local_country string, differs boolean"


def difference_stores(spark: SparkSession, path: str) -> tuple[SnapshotStore, SnapshotStore, LatestStore]:
    return SnapshotStore(spark, f"{path}/prod"), SnapshotStore(spark, f"{path}/local"), LatestStore(spark, f"{path}/view", DIFFERENCE, "tile_id")


def _difference(prod: DataFrame, local: DataFrame, tiles: DataFrame) -> DataFrame:
    """The diff's answer for every tile of ``tiles``; a tile that only the local side owns does not differ."""
    diff = ownership_diff(prod, local).withColumn("differs", F.lit(True))
    return tiles.join(diff, "tile_id", "left").select("tile_id", "prod_country", "local_country", F.coalesce("differs", F.lit(False)).alias("differs"))


def difference(spark: SparkSession, path: str) -> DataFrame:
    """R1 as the view holds it: (tile_id, prod_country, local_country)."""
    return difference_stores(spark, path)[2].read().filter("differs").drop("differs")


def audit_difference(spark: SparkSession, path: str) -> int:
    """Take the whole diff; where the view is wrong, publish the right rows.  The number of wrong tiles."""
    prod, local, view = difference_stores(spark, path)
    version = view.latest()
    kept = view.read(version).filter("differs").drop("differs")
    full = ownership_diff(prod.read(), local.read()).select(*kept.columns)
    wrong = full.exceptAll(kept).unionByName(kept.exceptAll(full)).select("tile_id").distinct().persist()
    try:
        n = wrong.count()
        if n:
            right = _difference(prod.read().join(wrong, "tile_id", "left_semi"), local.read(), wrong)
            view.add(right, version.batch, version, {"size": full.count()})
        return n
    finally:
        wrong.unpersist()


def watch_country(changes: DataFrame, tile_country: DataFrame, target: str, wanted: str) -> DataFrame:
    """R4 on a stream: stream-static semi join with the target's tiles."""
    return unauthorized_changes(changes, tile_country, target, wanted)


def mirror(changes: DataFrame) -> DataFrame:
    """R5 on a stream."""
    return mirror_changes(changes)


def batched_delivery(clicks: DataFrame, state_path: str, deliver: Callable[[DataFrame, int], None], interval: str = "1 second",
                     checkpoint: str | None = None, available_now: bool = False) -> StreamingQuery:
    """Pending changes handed to ``deliver`` in periodic batches (``available_now``: until the log's present end)."""
    sink = classify_sink(state_path, lambda rows, batch_id: deliver(ownership_changes(rows), batch_id))
    return start(clicks, sink, checkpoint=checkpoint, processing_time=None if available_now else interval, name="delivery")


def quarantine_sink(valid_path: str, reject_path: str, payload_col: str = "payload") -> Callable[[DataFrame, int], None]:
    """T4: decode a batch of raw payloads; valid clicks and rejects (with reason)
    go to their tables in the same batch.  Output folders are per batch id, so
    a retried batch overwrites its own files instead of duplicating them."""
    from terrastate.sources.clicks import decode_payloads

    def sink(batch: DataFrame, batch_id: int) -> None:
        spark, staged = batch.sparkSession, scratch_path(batch.sparkSession, f"decoded-{batch_id}")
        decode_payloads(batch, payload_col).write.parquet(staged)  # one decode, two readers
        decoded = spark.read.parquet(staged)
        keep = [c for c in batch.columns if c != payload_col]
        decoded.filter("error IS NULL").drop("error").write.mode("overwrite").parquet(f"{valid_path}/batch={batch_id}")
        decoded.filter("error IS NOT NULL").select(*keep, F.col("error").alias("reason")).write.mode("overwrite").parquet(
            f"{reject_path}/batch={batch_id}")
        remove_path(spark, staged)
    return sink


def redelivery_sink(handle: Callable[[DataFrame], DataFrame], done_path: str, reject_path: str, ledger_path: str, max_deliver: int = 3,
                    ack_wait_ns: int = ACK_WAIT_NS, clock: Callable[[], int] = time.time_ns) -> Callable[[DataFrame, int], None]:
    """T4: a record that can't be handled is delivered again after ``ack_wait_ns``, ``max_deliver`` times in all, then rejected.

    ``handle`` gets records with ``attempt`` (1, 2, ...) and returns them with its own columns and ``error`` (null: handled).
    What failed waits in a ledger with its number of attempts and the time of the next; what is due goes along with the next
    batch.  Handled records, rejects (``error`` as reason, ``attempt``) and then the ledger are written under the batch's id;
    a retried batch starts from the ledger before it, so nothing is handled twice or lost."""
    def sink(batch: DataFrame, batch_id: int) -> None:
        spark, now = batch.sparkSession, clock()
        ledger = Versions(spark, ledger_path)
        ledger.schema = f"{columns_of(batch)}, attempt int, due_ns bigint"
        pending = ledger.read(ledger.before(batch_id))
        due = pending.filter(F.col("due_ns") <= now).withColumn("attempt", F.col("attempt") + 1).drop("due_ns")
        staged = scratch_path(spark, f"handled-{batch_id}")
        handle(batch.withColumn("attempt", F.lit(1)).unionByName(due)).write.parquet(staged)  # handled once, read by three
        handled = spark.read.parquet(staged)
        handled.filter("error IS NULL").drop("error").write.mode("overwrite").parquet(f"{done_path}/batch={batch_id}")
        failed = handled.filter("error IS NOT NULL").select(*batch.columns, "attempt", F.col("error").alias("reason"))
        failed.filter(F.col("attempt") >= max_deliver).write.mode("overwrite").parquet(f"{reject_path}/batch={batch_id}")
        again = failed.filter(F.col("attempt") < max_deliver).drop("reason").withColumn("due_ns", F.lit(now + ack_wait_ns))
        ledger.replace(pending.filter(F.col("due_ns") > now).unionByName(again), batch_id)
        remove_path(spark, staged)
    return sink


def periodic_audit(trigger_stream: DataFrame, audit: Callable[[], DataFrame], out_path: str,
                   interval: str = "120 seconds", checkpoint: str | None = None, available_now: bool = False) -> StreamingQuery:
    """A full audit (R3) or diff (R1) recomputed on a processing-time
    trigger next to the live stream; each run is written under its batch id."""
    def sink(batch: DataFrame, batch_id: int) -> None:
        audit().write.mode("overwrite").parquet(f"{out_path}/run={batch_id}")
    return start(trigger_stream, sink, checkpoint=checkpoint, processing_time=None if available_now else interval, name="audit")
