"""Countries, map elements and points."""

from pyspark.sql import functions as F

from terrastate.functions import scalar as fx
from terrastate.operators import dims, osm, points


def test_flags_and_display(spark):
    df = spark.createDataFrame([("fr", "France"), ("gb-eng", "England"), ("xx", "A very long country name indeed")],
                               "code string, name string")
    out = {r.code: r for r in dims.decorate(df).collect()}
    assert out["fr"].flag == "\U0001F1EB\U0001F1F7"
    assert out["gb-eng"].flag == "\U0001F1EC\U0001F1E7-\U0001F1EA\U0001F1F3\U0001F1EC"
    assert out["xx"].display_name == "A very long countr"
    assert out["fr"].label == "\U0001F1EB\U0001F1F7  France"
    assert [r.code for r in dims.search(df, "FRA").collect()] == ["fr"]


def test_country_dim_json(spark):
    df = spark.createDataFrame([('{"af": "Afghanistan", "fr": "France"}',)], "value string")
    assert sorted((r.code, r.name) for r in dims.country_dim(df).collect()) == [("af", "Afghanistan"), ("fr", "France")]


def test_cities_and_roads(spark):
    nodes = spark.createDataFrame([
        (1, 1.0, 2.0, {"place": "city", "name": "A", "population": "+12"}, False, 0),
        (2, 1.0, 2.0, {"place": "town", "name": "B", "population": "1e3"}, True, 0),
        (3, 1.0, 2.0, {"place": "village", "name": "C"}, False, 0),
        (4, 1.0, 2.0, {"place": "city"}, False, 0)],
        "id bigint, lat double, lon double, tags map<string,string>, dense boolean, block_id bigint")
    got = {r.id: r.population for r in osm.extract_cities(nodes).collect()}
    assert got == {1: 12, 2: None}
    assert [r.id for r in osm.extract_cities(nodes, include_dense=False).collect()] == [1]
    assert osm.city_point(osm.extract_cities(nodes)).first().geom == "POINT(2.0 1.0)"
    ways = spark.createDataFrame([(7, [3, 1, 2], {"highway": "primary"}, 0), (8, [1], {"name": "x"}, 0)],
                                 "id bigint, refs array<bigint>, tags map<string,string>, block_id bigint")
    roads = osm.extract_roads(ways).collect()
    assert [(r.id, r.name, r.nodes) for r in roads] == [(7, None, [3, 1, 2])]


def test_points_pipeline(spark):
    pts = spark.createDataFrame([(0, 2.0, 0.0, 0.0), (1, 1.0, 0.0, 0.0), (2, 0.0, 3.0, 0.0)],
                                "ordinal bigint, x double, y double, z double")
    unit = points.normalize_points(pts)
    kept = points.dedup_points(unit).collect()
    assert sorted(r.ordinal for r in kept) == [0, 2]
    uv = {r.ordinal: (r.u, r.v) for r in points.xyz_to_uv(unit).collect()}
    assert uv[0] == (1.0, 0.5) and uv[2] == (1.0, 1.0)
    code = {r.ordinal: (r.u, r.v) for r in points.xyz_to_uv(unit, convention="code").collect()}
    assert code[0] == (0.5, 0.5) and code[2][1] == 0.0
    mask = spark.createDataFrame([(0, 0, 10), (1, 0, 200)], "px int, py int, red int")
    p = spark.createDataFrame([(0, 0.1, 0.2), (1, 0.9, 0.2), (2, 1.5, 0.2), (3, -0.1, 0.2)], "ordinal bigint, u double, v double")
    assert sorted(r.ordinal for r in points.land_filter(p, mask, 2, 1).collect()) == [0, 3]


def test_percent():
    assert fx.DEFAULT_TILE_TOTAL == 120000
