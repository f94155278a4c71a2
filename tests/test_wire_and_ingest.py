"""Wire samples, payload decode, subjects and snapshot parsing."""

from pyspark.sql import functions as F

import wire_reader
from terrastate.functions import wire
from terrastate.sources import clicks as src


def test_wire_goldens():
    assert wire.decode_record(bytes([8, 213, 153, 6, 18, 2, 102, 114]), "request") == {"tile_id": 101589, "country_id": "fr"}
    assert wire.decode_record(bytes([8, 145, 78, 16, 161, 156, 1]), "batch_request") == {"start_tile_id": 10001, "end_tile_id": 20001}


def test_encode_decode_roundtrip_and_rejects(spark):
    df = spark.createDataFrame([(101589, "fr", 1733000000000000000, "abc"), (0, "", 1, "x"), (5, "ru", 2, "")],
                               "tile_id bigint, country_id string, timestamp_ns bigint, click_id string")
    enc = df.select(F.monotonically_increasing_id().alias("k"),
                    wire.encode_click(F.col("tile_id"), F.col("country_id"), F.col("timestamp_ns"), F.col("click_id")).alias("payload"))
    bad = spark.createDataFrame([(99, bytearray([8, 213])), (98, bytearray([18, 5, 65]))], "k bigint, payload binary")
    valid, rejects = src.split_payloads(enc.unionByName(bad))
    got = sorted((r.tile_id, r.country_id, r.timestamp_ns, r.click_id) for r in valid.collect())
    assert got == sorted([(101589, "fr", 1733000000000000000, "abc"), (0, "", 1, "x"), (5, "ru", 2, "")])
    reasons = {r.k: r.reason for r in rejects.collect()}
    assert reasons == {99: "truncated varint", 98: "truncated length-delimited field"}
    # the request sample decodes as a click too (same first two fields)
    sample = bytes([8, 213, 153, 6, 18, 2, 102, 114])
    assert wire.decode_record(sample, "click")["tile_id"] == 101589


def test_subjects(spark):
    subs = ["clicks.tile.12", "clicks.tile.13", "click.tile.5", "clicks.tile.x", "clicks.tile.-3", "clicks.tile.+7",
            "clicks.tile.4294967295", "clicks.tile.4294967296", "clicks.tile."]
    df = spark.createDataFrame([(s, 1) for s in subs], "subject string, tile_id bigint")
    out = {r.subject: r.subject_tile_id for r in src.subject_tile_id(df).collect()}
    assert out == {"clicks.tile.12": 12, "clicks.tile.13": 13, "click.tile.5": None, "clicks.tile.x": None,
                   "clicks.tile.-3": None, "clicks.tile.+7": 7, "clicks.tile.4294967295": 4294967295,
                   "clicks.tile.4294967296": None, "clicks.tile.": None}


def test_stamp_live_and_deterministic(spark):
    req = spark.createDataFrame([(1, "fr"), (2, "ru")], "tile_id bigint, country_id string")
    live = src.stamp_clicks(req).collect()
    assert len({r.click_id for r in live}) == 2 and all(r.timestamp_ns > 1_600_000_000_000_000_000 for r in live)
    assert live[0].subject == "clicks.tile.1"


def test_parse_snapshot(spark):
    df = spark.createDataFrame([("fr:100", "3"), ("a:b:1", "4"), ("x:notanumber", "5"), ("ru:7", "bad"),
                                ("es:+8", "9"), ("de:-1", "10"), ("it:5", "5.0")],
                               "member string, score string")
    got = sorted((r.tile_id, r.country_id, r.timestamp_ns) for r in src.parse_snapshot(df).collect())
    assert got == [(3, "fr", 100), (9, "es", 8)]
    import pytest

    with pytest.raises(Exception):
        src.parse_snapshot(df, strict=True).collect()
    clean = df.filter(~F.col("score").isin("bad", "5.0"))  # bad scores only on invalid members: no error
    bad_member = spark.createDataFrame([("a:b:c", "oops")], "member string, score string")
    assert len(src.parse_snapshot(clean.unionByName(bad_member), strict=True).collect()) == 2


def test_leaderboard_reply_golden(spark):
    """The published reply: five entries, 46 bytes, a 75-byte JSON body."""
    import base64
    import json

    from terrastate.operators.leaderboard import leaderboard_reply

    board = spark.createDataFrame([("fr", 16478), ("sd", 1), ("ru", 31473), ("sr", 544), ("es", 874)],
                                  "country_id string, score bigint")
    r = leaderboard_reply(board).first()
    assert (r.entries, r.bytes, len(r.data)) == (5, 46, 64)
    assert len(json.dumps({"data": r.data}, separators=(",", ":"))) == 75
    assert wire_reader.decode_leaderboard(base64.b64decode(r.data)) == [
        ("ru", 31473), ("fr", 16478), ("es", 874), ("sr", 544), ("sd", 1)]


def test_page_payload_decodes(spark):
    import base64

    from terrastate.sinks.writers import page_payloads

    pages = spark.createDataFrame([(0, 0, "fr", 5), (0, 3, "ru", 1733000000000000000), (1, 10, "es", 7)],
                                  "page_no bigint, tile_id bigint, country_id string, timestamp_ns bigint")
    got = {r.page_no: base64.b64decode(r.data) for r in page_payloads(pages).collect()}
    first = got[0]
    key, pos = wire_reader._read_varint(first, 0)
    n, pos = wire_reader._read_varint(first, pos)
    assert wire_reader.decode_fields(first[pos:pos + n]) == {2: b"fr", 3: 5}  # tile 0 omitted (proto3 default)
    assert wire_reader.decode_fields(first[pos + n + 2:]) == {1: 3, 2: b"ru", 3: 1733000000000000000}


def test_request_payloads(spark):
    sample = bytearray([8, 213, 153, 6, 18, 2, 102, 114])
    rng = bytearray([8, 145, 78, 16, 161, 156, 1])
    df = spark.createDataFrame([(1, sample), (2, bytearray([18, 9, 1]))], "k bigint, payload binary")
    valid, rejects = src.split_payloads(df, kind="request")
    assert [(r.tile_id, r.country_id) for r in valid.collect()] == [(101589, "fr")]
    assert [r.k for r in rejects.collect()] == [2]
    b = spark.createDataFrame([(1, rng)], "k bigint, payload binary")
    got = src.decode_payloads(b, kind="batch_request").first()
    assert (got.start_tile_id, got.end_tile_id, got.error) == (10001, 20001, None)


def _varint(v):
    out = bytearray()
    while True:
        out.append((v & 127) | (128 if v > 127 else 0))
        v >>= 7
        if not v:
            return bytes(out)


def _ownership(tile, country, ts):
    def field(tag, v):
        return b"" if v == 0 else bytes([tag]) + (b"" if v is None else _varint(v & ((1 << 64) - 1)))

    text = country.encode()
    msg = field(8, tile) + (b"\x12" + _varint(len(text)) + text if text else b"") + field(24, ts)
    return b"\x0a" + _varint(len(msg)) + msg


def test_ownership_bytes_at_every_varint_length(spark):
    edges = [0, 1] + [v for k in range(1, 10) for v in ((1 << 7 * k) - 1, (1 << 7 * k))][:-1] + [-1, -(1 << 63), None]
    cases = [(tile, "fr", ts) for tile, ts in zip(edges, reversed(edges))] + [(7, c, 9) for c in ("", "é" * 64, "x" * 127, "x" * 128, "y" * 20_000)]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "k int, tile_id bigint, country_id string, timestamp_ns bigint")
    got = df.select("k", wire.ownership_hex(F.col("tile_id"), F.col("country_id"), F.col("timestamp_ns")).alias("hex")).collect()
    assert {r.k: bytes.fromhex(r.hex) for r in got} == {i: _ownership(*c) for i, c in enumerate(cases)}


def test_encoders_work_out_each_value_once(spark):
    """A field is tested, measured and written: no more. Repeated per varint group it cost 3 ms an ownership."""
    df = spark.createDataFrame([(1, "fr", 2, "x")], "tile_id bigint, country_id string, timestamp_ns bigint, click_id string")
    cols = [F.col(c) for c in df.columns]
    for made, inputs in ((wire.ownership_hex(*cols[:3]), df.columns[:3]), (wire.leaderboard_entry_hex(cols[1], cols[0]), df.columns[:2]),
                         (wire.encode_request(*cols[:2]), df.columns[:2])):
        plan = df.select(made.alias("out"))._jdf.queryExecution().analyzed().expressions().toString()
        assert all(1 <= plan.count(f"{c}#") <= 3 for c in inputs), {c: plan.count(f"{c}#") for c in inputs}


def test_out_of_range_values_and_wrong_types_are_rejects(spark):
    minus = _varint((1 << 64) - 1)
    cases = [(1, b"\x08" + minus, "negative tile id"), (2, b"\x08\x01\x18" + _varint((1 << 64) - 1), "time out of range"),
             (3, b"\x08\x01\x18" + _varint((1 << 63) - 1), None), (4, b"\x0a\x01a", "integer field with length wire type")]
    df = spark.createDataFrame([(k, bytearray(p)) for k, p, _ in cases], "k bigint, payload binary")
    assert {r.k: r.error for r in src.decode_payloads(df).collect()} == {k: e for k, _, e in cases}
    batch = [(1, b"\x08\x01\x10\x05", None), (2, b"\x0a\x01a", "integer field with length wire type"), (3, b"\x08" + minus, "negative tile id"), (4, None, "null payload")]
    df = spark.createDataFrame([(k, None if p is None else bytearray(p)) for k, p, _ in batch], "k bigint, payload binary")
    assert {r.k: r.error for r in src.decode_payloads(df, kind="batch_request").collect()} == {k: e for k, _, e in batch}


def test_batch_decode_equals_the_per_record_reader():
    import random

    import numpy as np

    rnd = random.Random(11)

    def field():
        n, w = rnd.randint(0, 6), rnd.choice([0, 0, 0, 2, 2, 2, 1, 5, 3])
        body = {0: lambda: _varint(rnd.choice([0, 1, 300, (1 << 31) - 1, 1 << 31, (1 << 63) - 1, 1 << 63, (1 << 64) - 1])),
                1: lambda: bytes(rnd.randint(0, 8)), 5: lambda: bytes(rnd.randint(0, 4)), 3: lambda: b"",
                2: lambda: (lambda t: _varint(len(t) + (rnd.random() < 0.05)) + t)(rnd.choice([b"", b"fr", "é漢".encode(), b"\xff", b"\xc3"]))}[w]()
        return _varint((n << 3) | w) + body

    records = [b"".join(field() for _ in range(rnd.randint(0, 5))) for _ in range(4000)] + [b"\x80" * 12, b"", b"\x08"]
    data, ends = np.frombuffer(b"".join(records), np.uint8), np.cumsum([len(r) for r in records])
    for kind, fields in wire.RECORDS.items():
        columns, reason = wire.decode_batch(data, np.concatenate([[0], ends[:-1]]), ends, np.zeros(len(records), bool), kind)
        for i, r in enumerate(records):
            try:
                f, why = wire_reader.decode_fields(r), None
            except wire_reader.WireError as e:
                f, why = None, str(e).replace(" 3", "").replace(" 4", "").replace(" 6", "").replace(" 7", "") if "unsupported" in str(e) else str(e)
            got = reason[i].as_py()
            if f is None:
                assert got == why, (r, got, why)
                continue
            checks = [isinstance(f.get(n, b"" if t == "text" else 0), bytes if t == "text" else int) for _, n, t in fields]
            good = all(checks)
            if good:
                want = []
                for _, n, t in fields:
                    v = f.get(n, b"" if t == "text" else 0)
                    if t == "text":
                        try:
                            v = v.decode()
                        except UnicodeDecodeError:
                            good = False
                    elif t == "tile":
                        v &= 0xFFFFFFFF
                        good &= v < 1 << 31
                    else:
                        v &= 0xFFFFFFFFFFFFFFFF
                        good &= v < 1 << 63
                    want.append(v)
            assert (got is None) == good, (r, got)
            assert [c[i].as_py() for c in columns] == (want if good else [None] * len(fields))
