"""Versioned stores: data folders written once and small manifests that name them.

Layout under one folder::

    data/<name>/*.parquet     rows, written once, never changed
    versions/<number>.json    a manifest: the data folders of that version, oldest first

A version is published by renaming its finished manifest into ``versions``; until
then nothing refers to the new data and the former version stays as it was, so a
writer may be killed at any step.  A micro-batch adds a folder with its own rows
(bytes in proportion to them).  Folders are merged by level: ``fan`` of one level
(and one bucket) become one of the next, so a row is rewritten about log(rows)
times, whatever the number of batches.  Data that no kept version names is
removed, also what a killed writer left behind.

A version knows the last micro-batch it holds.  A sink whose result depends on
the state starts batch b from ``before(b)``: a retried batch starts from where it
started first.  One writer at a time; readers need no coordination.
"""

from __future__ import annotations

import json
import re
import uuid
from dataclasses import dataclass, field
from itertools import groupby

from pyspark.sql import DataFrame, SparkSession, functions as F

from terrastate.session import list_names, read_text, remove_path, write_text


@dataclass(frozen=True)
class Folder:
    """``bucket``: folders of different buckets (such as hours) are never merged."""

    name: str
    level: int = 0
    bucket: int | None = None


@dataclass(frozen=True)
class Version:
    """``batch``: the last micro-batch it holds (-1: none); ``info``: small facts about the rows."""

    number: int
    batch: int
    folders: tuple[Folder, ...]
    info: dict = field(default_factory=dict)


HOUR_NS = 3_600_000_000_000
EMPTY = Version(0, -1, ())


class Versions:
    """``fan``: folders of one level that are merged into one of the next; ``keep``: versions that stay readable."""

    schema: str = ""

    def __init__(self, spark: SparkSession, path: str, fan: int = 8, keep: int = 3):
        self.spark, self.path, self.fan, self.keep = spark, path.rstrip("/"), fan, keep

    # --- versions ---------------------------------------------------------------------

    def _numbers(self) -> list[int]:
        names = list_names(self.spark, f"{self.path}/versions")
        return sorted(int(m[1]) for n in names if (m := re.fullmatch(r"([0-9]+)\.json", n)))

    def version(self, number: int) -> Version:
        told = json.loads(read_text(self.spark, f"{self.path}/versions/{number}.json"))
        return Version(number, told["batch"], tuple(Folder(*f) for f in told["folders"]), told["info"])

    def latest(self) -> Version:
        numbers = self._numbers()
        return self.version(numbers[-1]) if numbers else EMPTY

    def before(self, batch: int) -> Version:
        """The newest version without micro-batch ``batch``."""
        for n in reversed(self._numbers()):
            if (v := self.version(n)).batch < batch:
                return v
        return EMPTY

    def publish(self, batch: int, folders: tuple[Folder, ...], info: dict | None = None) -> Version:
        """Make the folders the next version: the manifest appears whole or not at all."""
        numbers = self._numbers()
        new = Version((numbers[-1] if numbers else 0) + 1, batch, folders, info or {})
        told = {"batch": batch, "folders": [[f.name, f.level, f.bucket] for f in folders], "info": new.info}
        write_text(self.spark, f"{self.path}/versions/{new.number}.json", json.dumps(told))
        return new

    # --- rows -------------------------------------------------------------------------

    def folder(self, f: Folder) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/data/{f.name}")

    def merged(self, folders: list[Folder]) -> DataFrame:
        """The rows of some folders, oldest first, as one; stores that keep one row of each kind choose it here."""
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/data/{f.name}" for f in folders])

    def laid_out(self, rows: DataFrame) -> DataFrame:
        """How a folder's rows are dealt to its files."""
        return rows

    def read(self, version: Version | None = None) -> DataFrame:
        version = version or self.latest()
        if not version.folders:
            return self.spark.createDataFrame([], self.schema)
        return self.folder(version.folders[0]) if len(version.folders) == 1 else self.merged(list(version.folders))

    def write(self, rows: DataFrame, level: int = 0, bucket: int | None = None) -> Folder:
        f = Folder(f"{level}-{uuid.uuid4().hex[:12]}", level, bucket)
        self.laid_out(rows).write.parquet(f"{self.path}/data/{f.name}")
        return f

    def add(self, rows: DataFrame, batch: int = -1, parent: Version | None = None, info: dict | None = None) -> Version:
        """Add one folder of rows to ``parent`` (the latest version) and publish."""
        parent = parent or self.latest()
        return self.tidy(self.publish(batch, (*parent.folders, self.write(rows)), info or parent.info))

    def replace(self, rows: DataFrame, batch: int, info: dict | None = None) -> Version:
        """Publish a version that holds these rows and no others."""
        version = self.publish(batch, (self.write(rows),), info)
        self.clean(version)
        return version

    def tidy(self, version: Version) -> Version:
        """Merge levels that are full, publish the result as a version of its own, and remove what is no longer named."""
        folders: list[Folder] = []
        for _, group in groupby(sorted(version.folders, key=lambda f: (f.bucket is not None, f.bucket or 0)), key=lambda f: f.bucket):
            own = list(group)  # in order of age, levels falling
            while own and len(run := [f for f in own if f.level == own[-1].level]) >= self.fan:
                own = own[:-len(run)] + [self.write(self.merged(run), run[-1].level + 1, run[-1].bucket)]
            folders += own
        if {f.name for f in folders} != {f.name for f in version.folders}:
            version = self.publish(version.batch, tuple(folders), version.info)
        self.clean(version)
        return version

    def clean(self, version: Version) -> None:
        """Remove old manifests, then data that none names.  The last ``keep`` versions stay, and the newest one of an earlier
        micro-batch, from which a retry starts."""
        numbers = self._numbers()
        kept = set(numbers[-self.keep:]) | {self.before(version.batch).number}
        for n in numbers:
            if n not in kept:
                remove_path(self.spark, f"{self.path}/versions/{n}.json")
        named = {f.name for n in numbers if n in kept for f in self.version(n).folders}
        for name in list_names(self.spark, f"{self.path}/data"):
            inner = {n.partition("/")[2] for n in named if n.partition("/")[0] == name}
            if not inner:
                remove_path(self.spark, f"{self.path}/data/{name}")
            elif "" not in inner:  # a write by buckets: they go one by one
                for bucket in list_names(self.spark, f"{self.path}/data/{name}"):
                    if "=" in bucket and bucket not in inner:
                        remove_path(self.spark, f"{self.path}/data/{name}/{bucket}")


class SnapshotStore(Versions):
    """K1: ownership rows, one per tile.  Of a tile's rows that of greatest time counts, on equal times that of the oldest
    folder (the stored owner stays), so adding a batch again changes nothing.  Folders are sorted by tile over their files: a
    range filter on the tile passes the merge and skips files and row groups."""

    def __init__(self, spark: SparkSession, path: str, fan: int = 8, keep: int = 3, time: str = "bigint"):
        super().__init__(spark, path, fan, keep)
        self.schema = f"tile_id bigint, country_id string, timestamp_ns {time}"

    def laid_out(self, rows: DataFrame) -> DataFrame:
        rows = rows.select("tile_id", "country_id", "timestamp_ns")
        return rows.repartitionByRange("tile_id").sortWithinPartitions("tile_id")

    def merged(self, folders: list[Folder]) -> DataFrame:
        rows = _aged(self, folders)
        best = F.max(F.struct("timestamp_ns", (-F.col("age")).alias("age"), "country_id"))
        return rows.groupBy("tile_id").agg(best.alias("b")).select("tile_id", "b.country_id", "b.timestamp_ns")


class LatestStore(Versions):
    """One row per key: that of the newest folder."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str, fan: int = 8, keep: int = 3):
        super().__init__(spark, path, fan, keep)
        self.schema, self.key = schema, key
        self.columns = [f.name for f in spark.createDataFrame([], schema).schema]

    def laid_out(self, rows: DataFrame) -> DataFrame:
        return rows.select(*self.columns).repartitionByRange(self.key).sortWithinPartitions(self.key)

    def merged(self, folders: list[Folder]) -> DataFrame:
        newest = F.max_by(F.struct(*self.columns), "age")
        return _aged(self, folders).groupBy(self.key).agg(newest.alias("b")).select("b.*")


class RetainedLog(Versions):
    """The clicks of the last ``retention_ns``, measured back from the newest entry.

    Clicks lie in folders of an hour.  The newest time stands in the manifest, so no batch reads what is stored: it writes its
    own clicks and drops the folders of the hours that lie wholly before the cut; readers filter the one hour that the cut
    runs through."""

    def __init__(self, spark: SparkSession, path: str, retention_ns: int, time_col: str = "arrival_ns", fan: int = 8, keep: int = 3):
        super().__init__(spark, path, fan, keep)
        self.retention_ns, self.time_col = retention_ns, time_col

    def add_batch(self, clicks: DataFrame, batch: int) -> Version:
        parent = self.before(batch)
        self.schema = parent.info.get("schema") or columns_of(clicks)
        seen = [x for x in (parent.info.get("newest"), clicks.agg(F.max(self.time_col)).first()[0]) if x is not None]
        if not seen:
            return parent
        newest = max(seen)
        cut = newest - self.retention_ns
        name = f"0-{uuid.uuid4().hex[:12]}"
        hour = F.floor(F.col(self.time_col) / HOUR_NS).cast("bigint")
        (clicks.filter(F.col(self.time_col) > cut).withColumn("hour", hour).repartition("hour")
         .write.partitionBy("hour").parquet(f"{self.path}/data/{name}"))
        hours = sorted(int(n[5:]) for n in list_names(self.spark, f"{self.path}/data/{name}") if n.startswith("hour="))
        folders = [*parent.folders, *(Folder(f"{name}/hour={h}", 0, h) for h in hours)]
        folders = [f for f in folders if f.bucket >= cut // HOUR_NS]
        return self.tidy(self.publish(batch, tuple(folders), {"newest": newest, "schema": self.schema}))

    def read(self, version: Version | None = None) -> DataFrame:
        version = version or self.latest()
        self.schema = version.info["schema"]
        return super().read(version).filter(F.col(self.time_col) > version.info["newest"] - self.retention_ns)


class Outbox(Versions):
    """K2: notifications on their way to listeners, keyed by (batch, position).

    A batch is published once, whole and last: putting it again, by a retry or after a restart, changes nothing.  Listeners
    read on behind the last batch they know; ``acknowledge`` removes what all of them have."""

    def __init__(self, spark: SparkSession, path: str, schema: str, order_cols: tuple[str, ...] = ("arrival_ns", "click_id"), keep: int = 3):
        super().__init__(spark, path, 1 << 30, keep)
        self.schema, self.order_cols = f"batch bigint, position bigint, {schema}", order_cols

    def put(self, rows: DataFrame, batch: int) -> Version:
        latest = self.latest()
        if latest.batch >= batch:
            return latest
        ordered = rows.repartitionByRange(*self.order_cols).sortWithinPartitions(*self.order_cols)
        numbered = ordered.select(F.lit(batch).cast("bigint").alias("batch"), F.monotonically_increasing_id().alias("position"), "*")
        version = self.publish(batch, (*latest.folders, self.write(numbered, bucket=batch)))
        self.clean(version)
        return version

    def pending(self, after: int = -1) -> DataFrame:
        """Notifications of the batches behind ``after``; other batches' folders are not read."""
        version = self.latest()
        return self.read(Version(version.number, version.batch, tuple(f for f in version.folders if f.bucket > after)))

    def acknowledge(self, batch: int) -> Version:
        version = self.latest()
        version = self.publish(version.batch, tuple(f for f in version.folders if f.bucket > batch))
        self.clean(version)
        return version


def columns_of(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def _aged(store: Versions, folders: list[Folder]) -> DataFrame:
    """Rows with the age of their folder: 0 is the oldest."""
    rows = [store.folder(f).withColumn("age", F.lit(k)) for k, f in enumerate(folders)]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out
