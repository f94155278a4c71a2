"""Protocol-buffer wire format of the click records.

Encoding is written with Spark built-ins (varints from shifts and masks, bytes
via ``unhex``), so it stays in the JVM.  Decoding reads whole Arrow batches inside
``mapInArrow``: all records in step, with numpy over the batch's byte buffer.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, functions as F

WIRE_VARINT, WIRE_LEN = 0, 2


# --- encode with Spark expressions ---------------------------------------------------

def _bound(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once a row, however often ``use`` mentions it."""
    return F.transform(F.array(value), use)[0]


def _byte_hex(byte: Column) -> Column:
    """Two hex digits of a bigint below 256."""
    return F.substring(F.hex(byte.bitwiseOR(F.lit(256).cast("bigint"))), 2, 2)


def _varint_hex(v: Column) -> Column:
    """Hex string of the base-128 varint of a bigint (two's complement for negatives; null: empty)."""
    low7, more = F.lit(127).cast("bigint"), F.lit(128).cast("bigint")

    def digits(x: Column) -> Column:
        out = _byte_hex(F.shiftrightunsigned(x, 63))
        for i in reversed(range(9)):
            group = F.shiftrightunsigned(x, 7 * i)
            out = (F.when(F.shiftrightunsigned(x, 7 * (i + 1)) == 0, _byte_hex(group))
                   .otherwise(F.concat(_byte_hex(group.bitwiseAND(low7).bitwiseOR(more)), out)))
        return F.coalesce(out, F.lit(""))

    return _bound(v, digits)


def _tag_hex(field: int, wire: int) -> str:
    tag = (field << 3) | wire
    out = []
    while True:
        b = tag & 0x7F
        tag >>= 7
        out.append(b | (0x80 if tag else 0))
        if not tag:
            return "".join(f"{x:02X}" for x in out)


def _field_hex(field: int, value: Column, kind: str) -> Column:
    """One field; proto3 omits default values (0 and the empty string)."""
    if kind == "varint":
        body = F.concat(F.lit(_tag_hex(field, WIRE_VARINT)), _varint_hex(value.cast("bigint")))
        return F.when(value == 0, F.lit("")).otherwise(body)
    data = F.hex(F.encode(value, "UTF-8"))
    body = F.concat(F.lit(_tag_hex(field, WIRE_LEN)), _varint_hex(F.octet_length(value).cast("bigint")), data)
    return F.when(value == "", F.lit("")).otherwise(body)


def encode_request(tile_id: Column, country_id: Column) -> Column:
    """Binary ClickRequest record (tile 1, country 2)."""
    return F.unhex(F.concat(_field_hex(1, tile_id, "varint"), _field_hex(2, country_id, "string")))


def encode_click(tile_id: Column, country_id: Column, timestamp_ns: Column, click_id: Column) -> Column:
    """Binary Click record; a time beyond 63 bits comes as a decimal."""
    beyond = F.expr("CAST(18446744073709551616 AS DECIMAL(21,0))")
    timestamp_ns = F.when(timestamp_ns <= F.lit(2 ** 63 - 1), timestamp_ns.try_cast("bigint")).otherwise((timestamp_ns - beyond).try_cast("bigint"))
    return F.unhex(F.concat(
        _field_hex(1, tile_id, "varint"), _field_hex(2, country_id, "string"),
        _field_hex(3, timestamp_ns, "varint"), _field_hex(4, click_id, "string")))


# --- decode (a whole Arrow batch at a time) ----------------------------------------------

class WireError(ValueError):
    pass


#: Field numbers of the record kinds (proto3), in the order in which they are checked.
RECORDS = {
    "click": [("tile_id", 1, "tile"), ("country_id", 2, "text"), ("timestamp_ns", 3, "time"), ("click_id", 4, "text")],
    "request": [("tile_id", 1, "tile"), ("country_id", 2, "text")],
    "batch_request": [("start_tile_id", 1, "tile"), ("end_tile_id", 2, "tile")],
}
REASONS = [None, "truncated varint", "varint too long", "field number 0", "truncated length-delimited field", "truncated fixed64",
           "truncated fixed32", "unsupported wire type", "string field with varint wire type", "integer field with length wire type",
           "negative tile id", "time out of range", "invalid utf-8", "null payload"]
_CODE = {r: i for i, r in enumerate(REASONS)}


class _Cursors:
    """One cursor a record over the batch's bytes; a record stops at its first error."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, nulls: np.ndarray):
        self.data, self.pos, self.ends = data, starts.astype(np.int64), ends.astype(np.int64)
        self.error = np.where(nulls, _CODE["null payload"], 0)

    def fail(self, rows: np.ndarray, reason: str) -> None:
        self.error[rows] = _CODE[reason]

    def open(self) -> np.ndarray:
        return np.flatnonzero((self.error == 0) & (self.pos < self.ends))

    def varints(self, rows: np.ndarray) -> np.ndarray:
        """The varint at each row's cursor, which moves behind it."""
        value, reading = np.zeros(len(rows), np.uint64), np.arange(len(rows))
        for shift in range(0, 70, 7):
            r = rows[reading]
            short = self.pos[r] >= self.ends[r]
            self.fail(r[short], "truncated varint")
            reading, r = reading[~short], r[~short]
            byte = self.data[self.pos[r]].astype(np.uint64)
            self.pos[r] += 1
            value[reading] |= (byte & np.uint64(127)) << np.uint64(shift)
            reading = reading[byte > 127]
            if not len(reading):
                return value
        self.fail(rows[reading], "varint too long")
        return value

    def skip(self, rows: np.ndarray, n: np.ndarray, reason: str) -> np.ndarray:
        """Moves the cursors on; the rows that had enough bytes left."""
        enough = n <= (self.ends[rows] - self.pos[rows]).astype(np.uint64)
        self.fail(rows[~enough], reason)
        self.pos[rows[enough]] += n[enough].astype(np.int64)
        return enough


def decode_batch(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, nulls: np.ndarray, kind: str,
                 wide: bool = False) -> tuple[list[pa.Array], pa.Array]:
    """Columns of all records of ``kind`` in a batch, and why each reject is one.  ``wide``: times as decimal(20,0).

    All records are read in step, field by field: as many numpy passes as the
    longest record has fields.  The last value of a field wins; fields of other
    numbers are skipped.  A reject has nulls in all columns.
    """
    n, fields = len(starts), RECORDS[kind]
    number_of = {number: k for k, (_, number, _) in enumerate(fields)}
    value = np.zeros((len(fields), n), np.uint64)  # of varints, and where a text ends
    begin = np.zeros((len(fields), n), np.int64)
    wire_of = np.full((len(fields), n), -1)  # no such field: the default value
    c = _Cursors(data, starts, ends, nulls)
    while len(rows := c.open()):
        key = c.varints(rows)
        rows, key = rows[ok := c.error[rows] == 0], key[ok]
        number, wire = key >> np.uint64(3), (key & np.uint64(7)).astype(np.int64)
        c.fail(rows[number == 0], "field number 0")
        c.fail(rows[(number > 0) & ~np.isin(wire, (0, 1, 2, 5))], "unsupported wire type")
        for w, size, reason in ((1, 8, "truncated fixed64"), (5, 4, "truncated fixed32")):
            at = rows[(wire == w) & (number > 0)]
            c.skip(at, np.full(len(at), size, np.uint64), reason)
        for w in (WIRE_VARINT, WIRE_LEN):
            picked = (wire == w) & (number > 0)
            at, which = rows[picked], number[picked]
            read = c.varints(at)
            ok = c.error[at] == 0
            at, which, read = at[ok], which[ok], read[ok]
            first = c.pos[at]
            if w == WIRE_LEN:
                ok = c.skip(at, read, "truncated length-delimited field")
                at, which, read, first = at[ok], which[ok], c.pos[at[ok]].astype(np.uint64), first[ok]
            for field, k in number_of.items():
                mine = which == field
                value[k, at[mine]], begin[k, at[mine]], wire_of[k, at[mine]] = read[mine], first[mine], w

    def reject(where: np.ndarray, reason: str) -> None:
        c.error[(c.error == 0) & where] = _CODE[reason]

    texts: dict[int, pa.Array] = {}
    for k, (_, _, type_) in enumerate(fields):
        if type_ == "text":
            reject(wire_of[k] == WIRE_VARINT, "string field with varint wire type")
    for k, (_, _, type_) in enumerate(fields):
        if type_ == "text":
            texts[k], bad = _texts(data, np.where(wire_of[k] == WIRE_LEN, begin[k], 0), np.where(wire_of[k] == WIRE_LEN, value[k].astype(np.int64), 0))
            reject(bad, "invalid utf-8")
            continue
        reject(wire_of[k] == WIRE_LEN, "integer field with length wire type")
        if type_ == "tile":  # a signed 32-bit integer that is not negative
            value[k] &= np.uint64(0xFFFFFFFF)
            reject(value[k] >= np.uint64(1 << 31), "negative tile id")
        elif not wide:  # unsigned 64-bit on the wire, but a bigint column holds 63 bits
            reject(value[k] >= np.uint64(1 << 63), "time out of range")
    bad = c.error > 0

    def column(k: int) -> pa.Array:
        if k in texts:
            return pc.if_else(pa.array(~bad), texts[k], None)
        if wide and fields[k][2] == "time":
            return pa.array(np.where(bad, 0, value[k]), pa.uint64(), mask=bad).cast(pa.decimal128(20, 0))
        return pa.array(value[k].astype(np.int64), mask=bad)

    columns = [column(k) for k in range(len(fields))]
    return columns, pa.array(REASONS, pa.string()).take(pa.array(c.error))


def _texts(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Strings cut from the batch's bytes, and which of them are not UTF-8 (empty here)."""
    def gather(b: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        offsets = np.concatenate([[0], np.cumsum(e - b)])
        return data[np.arange(offsets[-1]) + np.repeat(b - offsets[:-1], e - b)], offsets

    raw, offsets = gather(begin, end)
    bad = np.zeros(len(begin), bool)
    head = raw[offsets[:-1][end > begin]]
    try:
        if ((head & 0xC0) == 0x80).any():
            raise UnicodeDecodeError("utf-8", b"", 0, 1, "a text starts inside a character")
        raw.tobytes().decode("utf-8")
    except UnicodeDecodeError:  # rare: tell which
        for i, (b, e) in enumerate(zip(begin.tolist(), end.tolist())):
            try:
                data[b:e].tobytes().decode("utf-8")
            except UnicodeDecodeError:
                bad[i] = True
        raw, offsets = gather(begin, np.where(bad, begin, end))
    return pa.Array.from_buffers(pa.string(), len(begin), [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(raw.tobytes())]), bad


def decode_record(buf: bytes, kind: str) -> dict:
    """One record as a dict; raises WireError on malformed input (tests and small tools)."""
    data = np.frombuffer(buf, np.uint8)
    columns, reason = decode_batch(data, np.array([0]), np.array([len(buf)]), np.array([False]), kind)
    if reason[0].as_py() is not None:
        raise WireError(reason[0].as_py())
    return {name: col[0].as_py() for (name, _, _), col in zip(RECORDS[kind], columns)}


def _embedded_hex(field: int, msg_hex: Column) -> Column:
    """A nested message as a length-delimited field."""
    return _bound(msg_hex, lambda m: F.concat(F.lit(_tag_hex(field, WIRE_LEN)), _varint_hex((F.length(m) / 2).cast("bigint")), m))


def leaderboard_entry_hex(country_id: Column, score: Column) -> Column:
    """``entries`` item of the leaderboard reply: country (1), score (2)."""
    return _embedded_hex(1, F.concat(_field_hex(1, country_id, "string"), _field_hex(2, score, "varint")))


def ownership_hex(tile_id: Column, country_id: Column, timestamp_ns: Column) -> Column:
    """``ownerships`` item of an ownership state: tile (1), country (2), time (3)."""
    return _embedded_hex(1, F.concat(_field_hex(1, tile_id, "varint"), _field_hex(2, country_id, "string"),
                                     _field_hex(3, timestamp_ns, "varint")))
