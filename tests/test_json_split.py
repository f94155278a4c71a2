"""One JSON document read by byte ranges, against the parse in one piece; numbers and texts at their limits."""

import json
import random

import pytest
from pyspark.sql import functions as F

from terrastate.session import scratch_path, write_text
from terrastate.sources import clicks as src
from terrastate.sources import geo
from terrastate.sources.json_split import _pieces, flat_numbers, objects_in_lists


@pytest.fixture(params=[16, 61, 1000, 1 << 27])
def ranges(spark, request):
    """Byte ranges of so many bytes."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")
    before = [spark.conf.get(n, None) for n in names]
    for n, v in zip(names, (str(request.param), "0", "1")):
        spark.conf.set(n, v)
    yield request.param
    for n, v in zip(names, before):
        spark.conf.unset(n) if v is None else spark.conf.set(n, v)


def stored(spark, text):
    path = f"{scratch_path(spark, 'document')}/document.json"
    write_text(spark, path, text)
    return path


def test_flat_arrays(spark, ranges):
    rng = random.Random(1)
    doc = {"positions": [round(rng.uniform(-1, 1), rng.randrange(1, 9)) for _ in range(60)], "none": [], "uvs": [rng.choice([0, 1, 1e-7, 2.5e10, -3]) for _ in range(40)]}
    for indent in (None, 1):
        got = flat_numbers(spark, stored(spark, json.dumps(doc, indent=indent))).collect()
        assert sorted((r.key, r.i, r.number) for r in got) == sorted((k, i, float(x)) for k, v in doc.items() for i, x in enumerate(v))
    if ranges < 100:
        assert _pieces(spark, stored(spark, json.dumps(doc)), ",").select("range").distinct().count() > 4


def test_tiles_of_a_document(spark, ranges):
    doc = {"positions": [i / 7 for i in range(33)], "uvs": [i / 9 for i in range(22)]}
    got = geo.tiles_from_document(spark, stored(spark, json.dumps(doc))).orderBy("tile_id").collect()
    assert [tuple(r) for r in got] == [(t, *doc["positions"][3 * t:3 * t + 3], *doc["uvs"][2 * t:2 * t + 2]) for t in range(11)]
    bad = stored(spark, json.dumps({"positions": [1.0] * 9, "uvs": [1.0] * 4}))
    with pytest.raises(Exception, match="lengths do not match"):
        geo.tiles_from_document(spark, bad).collect()
    assert geo.tiles_from_document(spark, bad, strict=False).count() == 2


ODD = ["", "}", "{", "\"", "\\", "\\\"}", "a{b}c", "]}, {", "é漢", "{\"x\":1}"]


def test_objects_of_a_list(spark, ranges):
    rng = random.Random(2)

    def thing(depth=0):
        return {rng.choice(ODD) or "k": rng.choice([rng.choice(ODD), 1.5, None, [1, [2]], thing(depth + 1) if depth < 3 else {}]) for _ in range(rng.randrange(3))}

    docs = [{"head } {\"": {"in": {"deep": 1}}, "list": [thing() for _ in range(25)], "x": "}", "tail": {}, "n": [1, 2]}, {"list": []}, {"list": [{}]},
            {"list": [{"a": "{\\"}, {}], "b": [{"c": 1}]}]
    for doc in docs:
        want = [v for v in doc.values() if isinstance(v, dict)] + [x for v in doc.values() if isinstance(v, list) for x in v if isinstance(x, dict)]
        for indent in (None, 2):
            got = [json.loads(r.value) for r in objects_in_lists(spark, stored(spark, json.dumps(doc, indent=indent, ensure_ascii=False))).collect()]
            assert sorted(map(json.dumps, got)) == sorted(map(json.dumps, want))


def test_feature_collection_equals_its_lines(spark, ranges):
    features = [{"type": "Feature", "id": i, "properties": {"ISO_A2": f"c{i}", "ADMIN": "Feature }{ \"" + "x" * i},
                 "geometry": {"type": "MultiPolygon", "coordinates": [[[[0, 0], [i + 1, 0], [0, i + 1], [0, 0]]]] * (1 + i % 3)}} for i in range(8)]
    doc = {"type": "FeatureCollection", "crs": {"type": "name", "properties": {"name": "Feature"}}, "features": features}
    lines = spark.createDataFrame([(json.dumps(f),) for f in features], "value string")
    want = sorted(map(str, geo.country_polygons(lines).drop("feature_row").collect()))
    got = geo.country_polygons(geo.read_features(spark, stored(spark, json.dumps(doc)), collection=True))
    assert sorted(map(str, got.drop("feature_row").collect())) == want and len(want) == sum(1 + i % 3 for i in range(8))


def test_repeated_features_are_features_of_their_own(spark):
    f = json.dumps({"type": "Feature", "geometry": {"type": "MultiPolygon", "coordinates": [[[[0, 0], [1, 0], [0, 1]]]]}})
    rows = geo.country_polygons(spark.createDataFrame([(f,), (f,), (f.replace("1", "2"),)], "value string")).collect()
    assert len({r.feature_row for r in rows}) == 3 and len({r.feature_id for r in rows}) == 2


def test_a_line_end_is_no_part_of_a_number(spark):
    from terrastate.operators.osm import extract_cities

    subjects = spark.createDataFrame([("clicks.tile.12",), ("clicks.tile.12\n",), ("clicks.tile.+7",), ("clicks.tile.\n12",), ("clicks.tile.4294967296",)], "subject string")
    assert [r.subject_tile_id for r in src.subject_tile_id(subjects).collect()] == [12, None, 7, None, None]
    members = spark.createDataFrame([("fr:12", "3"), ("fr:12\n", "4"), ("fr:12", "5\n"), ("f\nr:1", "6")], "member string, score string")
    assert [tuple(r) for r in src.parse_snapshot(members).collect()] == [(3, "fr", 12), (6, "f\nr", 1)]
    nodes = spark.createDataFrame([(1, 0.0, 0.0, {"place": "city", "name": "a", "population": "12\n"}, False)],
                                  "id long, lat double, lon double, tags map<string,string>, dense boolean")
    assert extract_cities(nodes).first().population is None


def test_greatest_unsigned_time(spark):
    from decimal import Decimal

    from terrastate.functions.wire import encode_click
    from terrastate.operators.ownership import current_ownership

    times = [0, 1, 2 ** 63 - 1, 2 ** 63, 2 ** 64 - 1]
    rows = spark.createDataFrame([(t, "c", Decimal(x), str(t)) for t, x in enumerate(times)], "tile_id bigint, country_id string, timestamp_ns decimal(20,0), click_id string")
    sent = rows.select(encode_click(F.col("tile_id"), F.col("country_id"), F.col("timestamp_ns"), F.col("click_id")).alias("payload"), F.lit(0).alias("arrival_ns"))
    valid, rejects = src.split_payloads(sent, wide=True)
    assert rejects.count() == 0
    got = current_ownership(valid, ("arrival_ns", "click_id")).collect()
    assert sorted((r.tile_id, int(r.timestamp_ns)) for r in got) == list(enumerate(times))
    narrow, rejects = src.split_payloads(sent)
    assert narrow.count() == 3 and {r.reason for r in rejects.collect()} == {"time out of range"}
    members = spark.createDataFrame([(f"c:{x}", "1") for x in (2 ** 64 - 1, 2 ** 64)], "member string, score string")
    assert [int(r.timestamp_ns) for r in src.parse_snapshot(members, wide=True).collect()] == [2 ** 64 - 1]
    assert src.parse_snapshot(members).collect() == []
    with pytest.raises(Exception, match="beyond 63 bits"):
        src.parse_snapshot(members, strict=True).collect()
