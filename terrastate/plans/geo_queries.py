"""Registered queries: geometry, tile assignment and audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrastate.operators import geo
from terrastate.operators import leaderboard as lb
from terrastate.operators import ownership as ow
from terrastate.operators import reconcile as rc
from terrastate.plans.registry import QUERIES, register
from terrastate.plans.sql import (CLICKS_A, CLICKS_B, CLICKS_B_REPLICA, CROSSINGS, RINGS, TILE_COUNTRY, TILE_POINTS,
                                  TILES, classified, own, with_)
from terrastate.session import scratch_path
from terrastate.sinks import writers
from terrastate.sources import derived as d
from terrastate.sources.geo import country_polygons, read_features, tiles_from_coordinates, tiles_from_document
from terrastate import schemas

TARGET, WANTED = "nation_5", "nation_9"  # fixed parameters of the audit fixture
REACH = 5.0  # degrees around a tile, in the query of near countries
CHUNK = 100  # tiles per country-tiles row in the registered query


def polygons(spark, sf):
    return country_polygons(d.country_features_json(spark, sf))


def tile_country(spark, sf):
    return geo.tile_country(d.tiles(spark, sf), polygons(spark, sf))


_TC = with_(TILES, RINGS, TILE_POINTS, CROSSINGS, TILE_COUNTRY)


@register("tiles_from_coordinates", "S6", with_(TILES) + """
SELECT tile_id, round(cos(radians((v - 0.5) * 180.0)) * cos(radians((u - 0.5) * 360.0)), 6) AS x,
       round(sin(radians((v - 0.5) * 180.0)), 6) AS y,
       round(cos(radians((v - 0.5) * 180.0)) * sin(radians((u - 0.5) * 360.0)), 6) AS z, u, v FROM tiles""")
def q_tiles_from_coordinates(spark, sf):
    rows = d.coordinates_json(spark, sf).select(F.from_json("value", schemas.COORDINATES).alias("c")).select("c.*")
    t = tiles_from_coordinates(rows)
    return t.select("tile_id", *[F.round(c, 6).alias(c) for c in ("x", "y", "z")], "u", "v")


@register("tiles_from_document", "S6", with_(TILES) + """
SELECT tile_id, round(cos(radians((v - 0.5) * 180.0)) * cos(radians((u - 0.5) * 360.0)), 6) AS x,
       round(sin(radians((v - 0.5) * 180.0)), 6) AS y,
       round(cos(radians((v - 0.5) * 180.0)) * sin(radians((u - 0.5) * 360.0)), 6) AS z, u, v FROM tiles""")
def q_tiles_from_document(spark, sf):
    """The one-object file, written and read back by byte ranges."""
    path = scratch_path(spark, "coordinates")
    d.coordinates_document(spark, sf, path)
    return tiles_from_document(spark, path).select("tile_id", *[F.round(c, 6).alias(c) for c in ("x", "y", "z")], "u", "v")


@register("country_polygons_document", "S7", with_(RINGS) + """
SELECT feature_id, country_code, name, ring_id,
       string_agg(CAST(x AS VARCHAR) || ' ' || CAST(y AS VARCHAR), ',' ORDER BY pos) AS ring
FROM ring_pts GROUP BY ALL""")
def q_country_polygons_document(spark, sf):
    """One FeatureCollection document, written and read back by byte ranges."""
    path = scratch_path(spark, "features")
    d.features_document(spark, sf, path)
    p = country_polygons(read_features(spark, path, collection=True))
    txt = F.array_join(F.transform("ring", lambda q: F.concat(q["x"].cast("string"), F.lit(" "), q["y"].cast("string"))), ",")
    return p.select("feature_id", "country_code", "name", "ring_id", txt.alias("ring"))


@register("country_polygons", "S7", with_(RINGS) + """
SELECT feature_id, country_code, name, ring_id,
       string_agg(CAST(x AS VARCHAR) || ' ' || CAST(y AS VARCHAR), ',' ORDER BY pos) AS ring
FROM ring_pts GROUP BY ALL""")
def q_country_polygons(spark, sf):
    p = polygons(spark, sf)
    txt = F.array_join(F.transform("ring", lambda q: F.concat(q["x"].cast("string"), F.lit(" "), q["y"].cast("string"))), ",")
    return p.select("feature_id", "country_code", "name", "ring_id", txt.alias("ring"))


@register("uv_to_lonlat", "G1", with_(TILES, TILE_POINTS) + "SELECT * FROM tile_points")
def q_uv_to_lonlat(spark, sf):
    return geo.tile_lonlat(d.tiles(spark, sf))


@register("country_envelope", "G2", with_(RINGS) + "SELECT * FROM envelopes")
def q_country_envelope(spark, sf):
    return geo.country_envelopes(polygons(spark, sf))


@register("point_in_ring", "G3", with_(TILES, RINGS, TILE_POINTS, CROSSINGS) + """
SELECT c.* FROM crossings c JOIN tile_points p USING (tile_id) JOIN envelopes v USING (feature_id)
WHERE p.lon BETWEEN v.min_x AND v.max_x""")
def q_point_in_ring(spark, sf):
    return geo.ring_crossings(d.tiles(spark, sf), polygons(spark, sf))


@register("spatial_candidates_near", "G4", with_(TILES, RINGS, TILE_POINTS) + f"""
SELECT * FROM (SELECT p.tile_id, v.feature_id, v.country_code, v.area,
  pow(greatest(v.min_x - p.lon, 0, p.lon - v.max_x), 2) + pow(greatest(v.min_y - p.lat, 0, p.lat - v.max_y), 2) AS dist2
  FROM tile_points p CROSS JOIN envelopes v) WHERE dist2 <= {REACH * REACH}""")
def q_spatial_candidates_near(spark, sf):
    """Also the countries whose envelope is near, by distance."""
    return geo.spatial_candidates(d.tiles(spark, sf), polygons(spark, sf), reach=REACH)


@register("spatial_candidates", "G4", with_(TILES, RINGS, TILE_POINTS) + """
SELECT p.tile_id, v.feature_id, v.country_code, CAST(0 AS DOUBLE) AS dist2, v.area FROM tile_points p JOIN envelopes v
  ON p.lon BETWEEN v.min_x AND v.max_x AND p.lat BETWEEN v.min_y AND v.max_y""")
def q_spatial_candidates(spark, sf):
    return geo.spatial_candidates(d.tiles(spark, sf), polygons(spark, sf))


@register("tile_country", "G5", _TC + "SELECT * FROM tile_country")
def q_tile_country(spark, sf):
    return tile_country(spark, sf)


@register("unassigned_tiles", "G6", _TC + "SELECT tile_id FROM tile_country WHERE country_code IS NULL ORDER BY tile_id")
def q_unassigned_tiles(spark, sf):
    return geo.unassigned_tiles(tile_country(spark, sf))


@register("country_tiles", "G7", _TC + f"""
SELECT country_code, CAST(floor(tile_id / {CHUNK}) AS BIGINT) AS chunk_no,
       string_agg(CAST(tile_id AS VARCHAR), ',' ORDER BY tile_id) AS tiles
FROM tile_country WHERE country_code IS NOT NULL GROUP BY 1, 2""")
def q_country_tiles(spark, sf):
    ct = geo.country_tiles(tile_country(spark, sf), chunk=CHUNK)
    return ct.select("country_code", "chunk_no", F.array_join(F.col("tiles").cast("array<string>"), ",").alias("tiles"))


@register("country_tile_stats", "L6", _TC + """
SELECT country_code, count(*) AS tiles, count(country_code) AS assigned, CAST(grouping(country_code) AS INTEGER) AS is_total
FROM tile_country GROUP BY GROUPING SETS ((), (country_code))""")
def q_country_tile_stats(spark, sf):
    return lb.country_tile_stats(tile_country(spark, sf))


@register("tile_country_files", "K3", _TC + "SELECT * FROM tile_country")
def q_tile_country_files(spark, sf):
    folder = scratch_path(spark, "tile-country")
    for name in ("tile_to_country", "country_to_tiles"):  # what an interrupted write leaves: no finished files
        spark.createDataFrame([], "tile_id bigint, country_code string").write.json(f"{folder}/{name}/_temporary/0")
    writers.load_or_build_tile_country(spark, folder, d.tiles(spark, sf), lambda: tile_country(spark, sf))
    return writers.load_or_build_tile_country(spark, folder, d.tiles(spark, sf), lambda: tile_country(spark, sf))


# --- reconciliation ------------------------------------------------------------------

_DIFF = with_(CLICKS_B, CLICKS_B_REPLICA, own("clicks_b", "own_b"), own("clicks_b_replica", "own_r")) + """,
diff AS (SELECT a.tile_id, a.country_id AS prod_country, b.country_id AS local_country
         FROM own_b a LEFT JOIN own_r b USING (tile_id) WHERE b.country_id IS DISTINCT FROM a.country_id)
"""


def _diff(spark, sf):
    return rc.ownership_diff(ow.current_ownership(d.clicks_b(spark, sf)),
                             ow.current_ownership(d.clicks_b_replica(spark, sf)))


@register("ownership_diff", "R1", _DIFF + "SELECT * FROM diff")
def q_ownership_diff(spark, sf):
    return _diff(spark, sf)


@register("sync_plan", "R2", _DIFF + "SELECT tile_id, prod_country AS country_id FROM diff")
def q_sync_plan(spark, sf):
    return rc.sync_plan(_diff(spark, sf))


@register("claim_audit", "R3", _TC.rstrip("\n") + ",\n" + CLICKS_B + ",\n" + own("clicks_b", "own_b") + f"""
SELECT t.tile_id, '{WANTED}' AS country_id FROM tile_country t LEFT JOIN own_b o USING (tile_id)
WHERE t.country_code = '{TARGET}' AND (o.country_id IS NULL OR o.country_id <> '{WANTED}')""")
def q_claim_audit(spark, sf):
    return rc.claim_audit(tile_country(spark, sf), ow.current_ownership(d.clicks_b(spark, sf)), TARGET, WANTED)


@register("unauthorized_changes", "R4", _TC.rstrip("\n") + ",\n" + CLICKS_B + ",\n" + classified("clicks_b", "cls") + f"""
SELECT c.tile_id, c.country_id, c.previous_country AS previous_country_id, c.click_id, c.timestamp_ns, c.arrival_ns
FROM cls c WHERE c.applied AND c.previous_country IS NOT NULL AND c.previous_country <> c.country_id
  AND c.country_id <> '{WANTED}'
  AND c.tile_id IN (SELECT tile_id FROM tile_country WHERE country_code = '{TARGET}')""")
def q_unauthorized_changes(spark, sf):
    changes = ow.ownership_changes(ow.classify_clicks(d.clicks_b(spark, sf)))
    return rc.unauthorized_changes(changes, tile_country(spark, sf), TARGET, WANTED)


@register("mirror_changes", "R5", with_(CLICKS_A, classified("clicks_a", "cls")) + """
SELECT tile_id, country_id FROM cls WHERE applied AND previous_country IS NOT NULL AND previous_country <> country_id""")
def q_mirror_changes(spark, sf):
    return rc.mirror_changes(ow.ownership_changes(ow.classify_clicks(d.clicks_a(spark, sf))))


@register("tile_country_east", "G5", _TC + "SELECT * FROM tile_country")
def q_tile_country_east(spark, sf):
    """G5 with the plain east-ray edge layout (every edge east of a tile in its band)."""
    return geo.tile_country(d.tiles(spark, sf), polygons(spark, sf), layout="east")


@register("tile_totals", "G7", _TC + """
SELECT count(*) AS total, count(country_code) AS assigned, count(*) - count(country_code) AS unassigned
FROM tile_country""")
def q_tile_totals(spark, sf):
    return geo.tile_totals(tile_country(spark, sf))


_SHARED = with_(TILES, RINGS, TILE_POINTS) + """,
shapes AS (SELECT n_nationkey, n_name, copy, f AS ring_no, x0 + 36 AS cx, y0 + 18 AS cy, CASE f WHEN 0 THEN 1.5 ELSE 0.25 END AS k
           FROM boxes, range(2) r(f), range(2) c(copy) WHERE copy = 0 OR n_nationkey % 2 = 0),
corners AS (SELECT *, pos, cx + k * CASE pos WHEN 1 THEN -36 WHEN 3 THEN 36 ELSE 0 END AS x,
                   cy + k * CASE pos WHEN 0 THEN -18 WHEN 4 THEN -18 WHEN 2 THEN 18 ELSE 0 END AS y FROM shapes, range(5) t(pos)),
sides AS (SELECT a.n_nationkey, a.n_name, a.copy, a.ring_no, a.x AS xi, a.y AS yi, b.x AS xj, b.y AS yj
          FROM corners a JOIN corners b ON (a.n_nationkey, a.copy, a.ring_no) = (b.n_nationkey, b.copy, b.ring_no) AND b.pos = (a.pos + 4) % 5),
hits AS (SELECT p.tile_id, s.n_nationkey, s.n_name, s.copy, s.ring_no FROM tile_points p JOIN sides s
         ON (s.yi > p.lat) <> (s.yj > p.lat) AND p.lon < (s.xj - s.xi) * (p.lat - s.yi) / (s.yj - s.yi) + s.xi
         GROUP BY ALL HAVING count(*) % 2 = 1),
best AS (SELECT tile_id, min(lower(n_name)) AS country_code FROM hits GROUP BY tile_id)
"""  # all envelopes are of one size, so the smallest code wins


@register("tile_country_shared", "G5", _SHARED + "SELECT t.tile_id, country_code FROM tiles t LEFT JOIN best USING (tile_id)")
def q_tile_country_shared(spark, sf):
    """Repeated features without ids, features that share one, overlaps and inner rings."""
    shapes = country_polygons(d.shared_features_json(spark, sf))
    return geo.tile_country(d.tiles(spark, sf), shapes)


@register("country_tiles_lookup", "G7", _TC + f"SELECT tile_id FROM tile_country WHERE country_code = '{TARGET}'")
def q_country_tiles_lookup(spark, sf):
    return geo.tiles_of_country(tile_country(spark, sf), TARGET)


@register("assigned_country_codes", "G7", _TC + "SELECT DISTINCT country_code FROM tile_country WHERE country_code IS NOT NULL")
def q_assigned_country_codes(spark, sf):
    return geo.country_codes(tile_country(spark, sf))


@register("retake_requests", "R4", QUERIES["unauthorized_changes"].oracle.replace(
    "SELECT c.tile_id, c.country_id, c.previous_country AS previous_country_id, c.click_id, c.timestamp_ns, c.arrival_ns",
    f"SELECT c.tile_id, '{WANTED}' AS country_id"))
def q_retake_requests(spark, sf):
    """R4's answer: one request per offending change."""
    return rc.retake_requests(q_unauthorized_changes(spark, sf), WANTED)
