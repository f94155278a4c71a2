"""Session helpers.

Library code never changes cluster settings.  ``build_session`` is for local
runs and tests only; on a cluster the caller owns the session.
"""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession

# Settings that matter for every plan in this package.  AQE re-plans joins from
# runtime sizes (broadcast only below the threshold, sort-merge beyond it),
# coalesces small shuffle partitions and splits skewed join partitions.
SCALE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(master: str | None = None, shuffle_partitions: int = 8,
                  app_name: str = "terrastate", extra: dict | None = None) -> SparkSession:
    """Local session with the UI off (no server is opened)."""
    master = master or os.environ.get("TERRASTATE_MASTER", "local[8]")
    builder = (SparkSession.builder.master(master).appName(app_name)
               .config("spark.ui.enabled", "false")
               .config("spark.ui.showConsoleProgress", "false")
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
               .config("spark.driver.memory", os.environ.get("TERRASTATE_DRIVER_MEMORY", "16g")))
    for k, v in {**SCALE_CONF, **(extra or {})}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``, read from the session.

    Only a session in one process (master ``local[...]``: tests, the bench) gets
    a scratch folder where it is unset; on a cluster that is an error, because
    executors would each write to their own disk.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    current = sc.getCheckpointDir()
    if current:
        return current
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir() or configured
    if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = tempfile.mkdtemp(prefix="terrastate-ckpt-")
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir() or path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A unique sub-folder of the checkpoint folder for written intermediate tables."""
    import uuid

    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex[:12]}"


def _file_system(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, on whatever file system the path names."""
    fs, p = _file_system(spark, path)
    return fs.exists(p)


def remove_path(spark: SparkSession, path: str) -> None:
    """Remove an intermediate folder that this library wrote itself."""
    fs, p = _file_system(spark, path)
    fs.delete(p, True)


def estimated_bytes(df: DataFrame) -> int:
    """The planner's estimate of a table's size (file sizes for a plain scan, a product for joins); no job runs."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def list_names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none where it isn't there."""
    fs, p = _file_system(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []


def read_text(spark: SparkSession, path: str) -> str:
    """A small text file, such as a manifest."""
    fs, p = _file_system(spark, path)
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small text file that appears whole or not at all: written beside its place under another name, then renamed."""
    import uuid

    fs, p = _file_system(spark, path)
    aside = spark._jvm.org.apache.hadoop.fs.Path(p.getParent(), f"_{p.getName()}.{uuid.uuid4().hex[:8]}")
    stream = fs.create(aside, False)
    stream.write(bytearray(text.encode()))
    stream.close()
    if not fs.rename(aside, p):
        raise OSError(f"could not publish {path}")


def cluster_conf(input_bytes: int, executors: int = 1000, cores_per_executor: int = 8) -> dict[str, str]:
    """Suggested settings for a cluster run over ``input_bytes`` of click log.

    Returned, never applied: the deployment owns its session.  Scan splits of
    256 MB; an initial shuffle width giving ~256 MB per reducer that AQE then
    coalesces (advisory size) or splits (skew join); broadcast only below
    64 MB; RocksDB state for the streaming operators (state per tile).
    """
    split = 256 * 1024 * 1024
    slots = executors * cores_per_executor
    shuffle = max(slots, -(-input_bytes // split))
    return {
        "spark.sql.files.maxPartitionBytes": str(split),
        "spark.sql.shuffle.partitions": str(shuffle),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(split),
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.autoBroadcastJoinThreshold": str(64 * 1024 * 1024),
        "spark.sql.adaptive.autoBroadcastJoinThreshold": str(64 * 1024 * 1024),
        "spark.sql.streaming.stateStore.providerClass":
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        "spark.sql.session.timeZone": "UTC",
    }
