"""Ownership on streams.

O2 is a streaming aggregate.  What needs the owner from before each click runs
micro-batch by micro-batch: the batch operator over the batch's clicks, with the
owners of the tiles they touch carried in from a versioned store.  So a tile's
clicks of one batch spread over tasks as in batch, no Python runs, and the state
is ordinary files.  The store's version says which batch it holds; a retried
batch starts from the version before it and overwrites its own output.

Arrival order across micro-batches is the log order; within a micro-batch it is
``order_cols``.  There is no state timeout: a late click is accepted and ignored
when it is not newer than the state (T2), never dropped by a watermark.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, functions as F

from terrastate.functions.names import free_name
from terrastate.operators.leaderboard import score_deltas
from terrastate.operators.ownership import DEFAULT_ORDER, HOT_TILE, _owner_key, classify_clicks, current_ownership, dedup_clicks, has_id
from terrastate.sinks.versions import SnapshotStore, Versions

Sink = Callable[[DataFrame, int], None]


def ownership_stream(clicks: DataFrame, order_cols: Sequence[str] = DEFAULT_ORDER) -> DataFrame:
    """O2: current owner per tile as a streaming aggregate (update mode).

    Within a batch the winner is the same struct minimum as O1; the state keeps
    it across batches, so the result equals O1 over everything read so far."""
    best = clicks.groupBy("tile_id").agg(F.min(_owner_key(clicks, order_cols)).alias("best"))
    return best.select("tile_id", F.col("best.country_id").alias("country_id"),
                       (-F.col("best.neg_ts")).alias("timestamp_ns"))


def classify_sink(state_path: str, deliver: Sink, order_cols: Sequence[str] = DEFAULT_ORDER, hot_tile: int = HOT_TILE) -> Sink:
    """O3 on a stream: ``deliver`` gets every batch's clicks with ``applied``, ``previous_country`` and ``previous_ts``.

    ``deliver`` must write the same output when it gets a batch again; the owners are published after it."""
    def sink(batch: DataFrame, batch_id: int) -> None:
        clicks = batch.persist()
        try:
            store = SnapshotStore(batch.sparkSession, state_path)
            parent = store.before(batch_id)
            before = store.read(parent).join(clicks.select("tile_id").distinct(), "tile_id", "left_semi") if parent.folders else None
            deliver(classify_clicks(clicks, order_cols, before=before, hot_tile=hot_tile), batch_id)
            store.add(current_ownership(clicks, order_cols), batch_id, parent)
        finally:
            clicks.unpersist()
    return sink


def batch_files(path: str, shape: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> Sink:
    """A ``deliver`` that writes ``shape`` of each batch to a folder of its own; a batch that comes again overwrites it."""
    def deliver(rows: DataFrame, batch_id: int) -> None:
        shape(rows).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
    return deliver


def leaderboard_sink(state_path: str, order_cols: Sequence[str] = DEFAULT_ORDER) -> Sink:
    """L4 on a stream: the +1/-1 deltas of applied clicks added to the totals of the batch before."""
    def deliver(classified: DataFrame, batch_id: int) -> None:
        totals = leaderboard_totals(classified.sparkSession, state_path)
        deltas = score_deltas(classified).select("country_id", F.col("delta").alias("score"))
        every = totals.read(totals.before(batch_id)).unionByName(deltas)
        totals.replace(every.groupBy("country_id").agg(F.sum("score").alias("score")).filter("score <> 0").coalesce(1), batch_id)
    return classify_sink(f"{state_path}/owners", deliver, order_cols)


def leaderboard_totals(spark, state_path: str) -> Versions:
    """The totals kept by ``leaderboard_sink``: a row per country, so one small file a batch."""
    totals = Versions(spark, f"{state_path}/totals")
    totals.schema = "country_id string, score bigint"
    return totals


def dedup_sink(index_path: str, deliver: Sink, id_col: str = "click_id", order_cols: Sequence[str] = DEFAULT_ORDER) -> Sink:
    """O5 on a stream: ``deliver`` gets the clicks whose id no earlier batch had, the first delivery of each.

    The ids seen are files sorted by id, merged by level; a batch is anti-joined with the files and row groups in its range
    of ids.  Nothing is held in memory and nothing expires, so no click that was never seen is dropped, however late it is.
    A null or empty id says nothing; such clicks all pass."""
    def sink(batch: DataFrame, batch_id: int) -> None:
        spark, kind = batch.sparkSession, batch.schema[id_col].dataType.simpleString()
        clicks = batch.persist()
        try:
            index = IdIndex(spark, index_path, id_col, kind)
            parent = index.before(batch_id)
            fresh = dedup_clicks(clicks, order_cols, id_col)
            if parent.folders:
                low, high = clicks.filter(has_id(clicks, id_col)).agg(F.min(id_col), F.max(id_col)).first()
                known = index.read(parent).filter(F.col(id_col).between(F.lit(low), F.lit(high)))
                seen = free_name(fresh, "seen")
                marked = fresh.join(known.withColumn(seen, F.lit(True)), id_col, "left")
                fresh = marked.filter(F.col(seen).isNull()).select(*clicks.columns)
            deliver(fresh, batch_id)
            index.add(fresh.filter(has_id(fresh, id_col)).select(id_col), batch_id, parent)
        finally:
            clicks.unpersist()
    return sink


class IdIndex(Versions):
    """Ids seen, each once: folders sorted by id over their files."""

    def __init__(self, spark, path: str, id_col: str, kind: str):
        super().__init__(spark, path)
        self.id_col, self.schema = id_col, f"`{id_col}` {kind}"

    def laid_out(self, rows: DataFrame) -> DataFrame:
        return rows.repartitionByRange(self.id_col).sortWithinPartitions(self.id_col)
