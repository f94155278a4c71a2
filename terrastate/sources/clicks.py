"""Click log sources and decoding.

S1 reads the log in batch or as a stream; S2 decodes binary payloads into
typed clicks plus a reject table; S3 takes the tile id from the log subject;
S4 stamps requests into clicks; S5 parses the cold store's sorted-set rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from terrastate import schemas
from terrastate.functions import wire

CLICK_COLUMNS = ("tile_id", "country_id", "timestamp_ns", "click_id", "arrival_ns")
SUBJECT_PREFIX = "clicks.tile."  # fixed value


def read_clicks(source: DataFrame | str, spark: SparkSession | None = None, stream: bool = False,
                fmt: str = "parquet", schema: T.StructType = schemas.CLICK,
                max_files_per_trigger: int | None = None) -> DataFrame:
    """The whole log from its start; with ``stream=True`` it is then followed.

    The position in the log is the streaming checkpoint, as a durable consumer
    would keep it.  Schemas are explicit; a DataFrame is projected to the click columns.
    """
    if isinstance(source, DataFrame):
        return source.select(*[c for c in CLICK_COLUMNS if c in source.columns])
    if spark is None:
        raise ValueError("a path source needs the session")
    if stream:
        reader = spark.readStream.schema(schema).format(fmt)
        if max_files_per_trigger:
            reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
        return reader.load(source)
    return spark.read.schema(schema).format(fmt).load(source)


# --- S2: binary payloads ---------------------------------------------------------------

TYPES = {"tile": T.LongType(), "time": T.LongType(), "text": T.StringType()}


def _decode_batches(payload_col: str, keep: list[str], kind: str, wide: bool):
    names = [name for name, _, _ in wire.RECORDS[kind]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = batch.column(payload_col).cast(pa.large_binary())
            offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset:col.offset + len(col) + 1]
            data = np.frombuffer(col.buffers()[2] or b"", np.uint8)
            columns, reason = wire.decode_batch(data, offsets[:-1], offsets[1:], col.is_null().to_numpy(zero_copy_only=False), kind, wide)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), *columns, reason], names=[*keep, *names, "error"])
    return run


def decode_payloads(df: DataFrame, payload_col: str = "payload", kind: str = "click", wide: bool = False) -> DataFrame:
    """Every row decoded as ``kind`` (click, request, batch_request);
    ``error`` is null for valid records.  Runs per Arrow batch inside the
    tasks; other columns pass through.  With ``wide``, times are decimal(20,0)
    and any unsigned 64-bit time is valid; else those above 63 bits are rejects."""
    keep = [c for c in df.columns if c != payload_col]
    types = TYPES | ({"time": T.DecimalType(20, 0)} if wide else {})
    out = [T.StructField(name, types[type_]) for name, _, type_ in wire.RECORDS[kind]]
    schema = T.StructType([df.schema[c] for c in keep] + out + [T.StructField("error", T.StringType())])
    return df.mapInArrow(_decode_batches(payload_col, keep, kind, wide), schema)


def split_payloads(df: DataFrame, payload_col: str = "payload", kind: str = "click", wide: bool = False) -> tuple[DataFrame, DataFrame]:
    """(valid records, rejects with reason).  Both sides read one
    decode pass when the caller caches or writes it; no shuffle either way."""
    decoded = decode_payloads(df, payload_col, kind, wide)
    valid = decoded.filter(F.col("error").isNull()).drop("error")
    rejects = decoded.filter(F.col("error").isNotNull()).select(
        *[c for c in df.columns if c != payload_col], F.col("error").alias("reason"))
    return valid, rejects


# --- S3: subject -> tile id ---------------------------------------------------------------

U32_MAX = 4_294_967_295


WIDE = "decimal(20,0)"  # holds every unsigned 64-bit number


def _is_unsigned(text):
    """An unsigned decimal integer with an optional '+', and nothing else (no line end behind it)."""
    return text.rlike(r"\A\+?[0-9]+\z")


def _unsigned(text, max_value: int | None = None):
    """An unsigned decimal integer (optional '+') as bigint, else null."""
    v = F.when(_is_unsigned(text), text.try_cast("bigint"))
    return F.when(v <= F.lit(max_value), v) if max_value is not None else v


def _unsigned_wide(text):
    """An unsigned 64-bit integer as ``WIDE``, else null."""
    v = F.when(_is_unsigned(text), text.try_cast("decimal(38,0)"))
    return F.when(v <= F.expr("CAST(18446744073709551615 AS DECIMAL(38,0))"), v).cast(WIDE)


def subject_tile_id(df: DataFrame, subject_col: str = "subject", prefix: str = SUBJECT_PREFIX) -> DataFrame:
    """S3: adds ``subject_tile_id`` (null unless the subject is ``<prefix><id>``
    with an unsigned 32-bit id) and ``subject_error``."""
    rest = F.substring(F.col(subject_col), len(prefix) + 1, 1 << 30)
    parsed = F.when(F.col(subject_col).startswith(prefix), _unsigned(rest, U32_MAX))
    return (df.withColumn("subject_tile_id", parsed)
            .withColumn("subject_error", F.when(parsed.isNull(), F.lit("bad subject"))))


# --- S4: stamping -------------------------------------------------------------------------

def stamp_clicks(requests: DataFrame, click_id: str | None = None, timestamp_ns: str | None = None) -> DataFrame:
    """Request -> click with a new v4 id, server time in ns and the log subject.

    Live form uses ``uuid()`` and the query's current time; the deterministic
    form takes both from the named columns (for replays and tests)."""
    cid = F.col(click_id).cast("string") if click_id else F.expr("uuid()")
    ts = F.col(timestamp_ns).cast("bigint") if timestamp_ns else F.unix_micros(F.current_timestamp()) * F.lit(1000)
    return requests.select(
        "tile_id", "country_id",
        ts.alias("timestamp_ns"),
        cid.alias("click_id"),
        F.concat(F.lit(SUBJECT_PREFIX), F.col("tile_id").cast("string")).alias("subject"),
    )


# --- S5: sorted-set snapshot rows ---------------------------------------------------------

def parse_snapshot(df: DataFrame, member_col: str = "member", score_col: str = "score",
                   strict: bool = False, wide: bool = False) -> DataFrame:
    """("country:timestamp_ns", tile score) -> ownership rows.

    A member without exactly two parts or with a time that is not an unsigned
    64-bit integer is skipped; a score that is not an unsigned 32-bit integer is
    an error in ``strict`` mode (``raise_error``) and skipped otherwise.  With
    ``wide`` the time is a decimal(20,0), which holds all of them; a bigint
    doesn't hold the upper half: such members are skipped, in ``strict`` mode
    an error."""
    parts = F.split(F.col(member_col), ":")
    full = _unsigned_wide(parts.getItem(1))
    ts = full if wide else full.try_cast("bigint")
    if strict and not wide:
        ts = F.when(full.isNotNull() & ts.isNull() & (F.size(parts) == 2), F.raise_error(
            F.concat(F.lit("time beyond 63 bits: "), F.col(member_col))).cast("bigint")).otherwise(ts)
    tile = _unsigned(F.col(score_col), U32_MAX)
    if strict:  # the score is only read for members that are otherwise valid
        member_ok = (F.size(parts) == 2) & ts.isNotNull()
        tile = F.when(member_ok, F.coalesce(
            tile, F.raise_error(F.concat(F.lit("bad score: "), F.col(score_col))).cast("bigint")))
    out = df.select(tile.alias("tile_id"), parts.getItem(0).alias("country_id"), ts.alias("timestamp_ns"),
                    F.size(parts).alias("_n"))
    return (out.filter((F.col("_n") == 2) & F.col("timestamp_ns").isNotNull() & F.col("tile_id").isNotNull())
            .drop("_n"))
