"""Geometry: coordinate parsing, polygons, point-in-polygon rules and fixtures."""

import json

import pytest
from pyspark.sql import functions as F

from terrastate.operators import geo
from terrastate.sources import geo as gsrc


def features(spark, feats):
    return spark.createDataFrame([(json.dumps(f),) for f in feats], "value string")


def square(x0, y0, s):
    return [[x0, y0], [x0 + s, y0], [x0 + s, y0 + s], [x0, y0 + s], [x0, y0]]


def tiles_at(spark, pts):
    # inverse of G1: u = lon/360 + 0.5, v = lat/180 + 0.5
    return spark.createDataFrame([(i, lon / 360 + 0.5, lat / 180 + 0.5) for i, (lon, lat) in enumerate(pts)],
                                 "tile_id bigint, u double, v double")


def test_coordinates_sample(spark):
    row = {"positions": [-0.5943395495414734, 0.8018954992294312, 0.06102520972490311],
           "uvs": [0.5162845253944397, 0.796174943447113], "length": 1}
    df = spark.read.schema("positions array<double>, uvs array<double>").json(spark.sparkContext.parallelize([json.dumps(row)]))
    t = gsrc.tiles_from_coordinates(df).collect()
    assert len(t) == 1 and t[0].tile_id == 0
    ll = geo.tile_lonlat(gsrc.tiles_from_coordinates(df)).first()
    assert round(ll.lon, 6) == 5.862429 and round(ll.lat, 6) == 53.311490


def test_coordinates_bad_lengths(spark):
    df = spark.createDataFrame([([1.0, 2.0], [0.5, 0.5])], "positions array<double>, uvs array<double>")
    with pytest.raises(Exception):
        gsrc.tiles_from_coordinates(df).collect()
    assert gsrc.tiles_from_coordinates(df, strict=False).count() == 0


def test_holes_polygon_kinds_and_overlap(spark):
    big = {"type": "Feature", "id": 1, "properties": {"ISO_A2": "BG", "ADMIN": "Big"},
           "geometry": {"type": "MultiPolygon", "coordinates": [[square(0, 0, 10), square(4, 4, 2)]]}}
    small = {"type": "Feature", "id": 2, "properties": {"ISO_A2": "SM", "ADMIN": "Small"},
             "geometry": {"type": "MultiPolygon", "coordinates": [[square(1, 1, 2)]]}}
    poly = {"type": "Feature", "id": 3, "properties": {"ADMIN": "Plain"},
            "geometry": {"type": "Polygon", "coordinates": [square(20, 20, 5)]}}
    short = {"type": "Feature", "id": 4, "properties": {"ISO_A2": "XX"},
             "geometry": {"type": "MultiPolygon", "coordinates": [[[[50, 50], [51, 51]]]]}}
    f = features(spark, [big, small, poly, short])
    rings = gsrc.country_polygons(f)
    assert sorted(r.feature_id for r in rings.select("feature_id").distinct().collect()) == [1, 2]
    tiles = tiles_at(spark, [(5.0, 5.0), (2.0, 2.0), (7.0, 1.0), (22.0, 22.0), (-5.0, -5.0)])
    tc = {r.tile_id: r.country_code for r in geo.tile_country(tiles, rings).collect()}
    # hole counts as inside; overlap -> smaller envelope; Polygon feature ignored by default
    assert tc == {0: "bg", 1: "sm", 2: "bg", 3: None, 4: None}
    with_poly = gsrc.country_polygons(f, kinds=("MultiPolygon", "Polygon"))
    tc2 = {r.tile_id: r.country_code for r in geo.tile_country(tiles, with_poly).collect()}
    assert tc2[3] == ""  # missing ISO_A2 -> empty code


def test_fixture_assignment(spark):
    from conftest import SF_SMALL
    from terrastate.plans import geo_queries as gq

    tc = gq.tile_country(spark, SF_SMALL).cache()
    assert tc.filter(F.col("country_code").isNotNull()).count() == 102
    assert tc.count() == 200
    assert tc.filter(F.col("country_code") == "nation_5").count() == 4
    assert tc.filter(F.col("country_code").isNotNull()).select("country_code").distinct().count() == 25


def _brute(points, rings):
    """Even-odd rule from all abscissas at which a ring cuts the point's parallel:
    a ring holds the point if an odd number of them lie east of it."""
    import numpy as np

    lon, lat = np.array(points).T
    out = {t: [] for t in range(len(points))}
    for code, ring in rings:
        a = np.array(ring)
        b = np.roll(a, 1, axis=0)
        a, b = a[a[:, 1] != b[:, 1]], b[a[:, 1] != b[:, 1]]
        cuts = (a[:, 1] > lat[:, None]) ^ (b[:, 1] > lat[:, None])
        where = (b[:, 0] - a[:, 0]) * (lat[:, None] - a[:, 1]) / (b[:, 1] - a[:, 1]) + a[:, 0]
        for t in np.flatnonzero((cuts & (where > lon[:, None])).sum(axis=1) % 2):
            out[int(t)].append(code)
    return out


def test_layouts_match_brute_force_on_random_rings(spark):
    import random

    rnd = random.Random(7)
    feats, rings = [], []
    for f in range(6):
        cx, cy = rnd.uniform(-20, 20), rnd.uniform(-20, 20)
        pts = []
        m = rnd.randint(8, 40)
        for i in range(m):  # star-shaped, wiggly, vertices snapped to half-degrees (many on cell lines)
            import math
            a = 2 * math.pi * i / m
            r = rnd.uniform(2, 12)
            pts.append([round((cx + r * math.cos(a)) * 2) / 2, round((cy + r * math.sin(a)) * 2) / 2])
        pts.append(pts[0])
        code = f"C{f}"
        rings.append((code, [tuple(p) for p in pts]))
        feats.append({"type": "Feature", "id": f, "properties": {"ISO_A2": code},
                      "geometry": {"type": "MultiPolygon", "coordinates": [[pts]]}})
    grid = [(x / 2, y / 2) for x in range(-70, 71, 3) for y in range(-70, 71, 3)]
    rand = [(rnd.uniform(-35, 35), rnd.uniform(-35, 35)) for _ in range(1500)]
    points = grid + rand
    tiles = tiles_at(spark, points)
    polys = gsrc.country_polygons(features(spark, feats))
    brute = _brute([((r.u - 0.5) * 360.0, (r.v - 0.5) * 180.0) for r in tiles.orderBy("tile_id").collect()], rings)
    env = {r.feature_id: r.area for r in geo.country_envelopes(polys).collect()}
    area = {f"c{i}": env[i] for i in range(6)}  # keyed by lower-cased code
    expect = {t: (min(h, key=lambda c: (area[c.lower()], c.lower())).lower() if h else None) for t, h in brute.items()}
    assert sum(v is not None for v in expect.values()) > 300  # many points inside, some in overlaps
    assert sum(len(h) > 1 for h in brute.values()) > 10
    for layout in ("runs", "east"):
        for band, cell in ((1.0, 1.0), (0.5, 3.0), (0.5, 0.5)):
            got = {r.tile_id: r.country_code
                   for r in geo.tile_country(tiles, polys, band, cell, layout=layout).collect()}
            assert got == expect, (layout, band, cell)


def test_read_features_lines_and_collection(spark, tmp_path):
    feats = [{"type": "Feature", "id": i, "properties": {"ISO_A2": f"C{i}", "ADMIN": f"Country {i}"},
              "geometry": {"type": "MultiPolygon", "coordinates": [[square(10 * i, 0, 5)]]}} for i in range(3)]
    lines = tmp_path / "f.jsonl"
    lines.write_text("\n".join(json.dumps(f) for f in feats))
    coll = tmp_path / "c.geojson"
    coll.write_text(json.dumps({"type": "FeatureCollection", "features": feats}, indent=1))
    a = gsrc.country_polygons(gsrc.read_features(spark, str(lines)))
    b = gsrc.country_polygons(gsrc.read_features(spark, str(coll), collection=True))
    key = lambda df: sorted((r.feature_id, r.country_code, r.name, len(r.ring)) for r in df.collect())
    assert key(a) == key(b) == [(i, f"C{i}", f"Country {i}", 5) for i in range(3)]


def test_read_coordinates_file(spark, tmp_path):
    rows = [{"first_tile": 0, "positions": [1.0, 0.0, 0.0, 0.0, 1.0, 0.0], "uvs": [0.5, 0.5, 0.25, 1.0]},
            {"first_tile": 2, "positions": [0.0, 0.0, 1.0], "uvs": [0.75, 0.5]}]
    f = tmp_path / "coords.jsonl"
    f.write_text("\n".join(json.dumps(r) for r in rows))
    t = gsrc.tiles_from_coordinates(gsrc.read_coordinates(spark, str(f))).orderBy("tile_id").collect()
    assert [(r.tile_id, r.x, r.y, r.z, r.u, r.v) for r in t] == [
        (0, 1.0, 0.0, 0.0, 0.5, 0.5), (1, 0.0, 1.0, 0.0, 0.25, 1.0), (2, 0.0, 0.0, 1.0, 0.75, 0.5)]
