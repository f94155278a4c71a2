"""Registered queries: ingest (S2-S5, T4, T5), countries (S8, D1, F1-F6), map
elements (S9, M1-M3, L7, K5) and globe points (G8-G11, K4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrastate.functions.wire import encode_click
from terrastate.operators import dims, osm, points
from terrastate.operators import ownership as ow
from terrastate.operators import reconcile as rc
from terrastate.plans.registry import register
from terrastate.plans.sql import CLICKS_A, CLICKS_B, TILES, own, with_
from terrastate.session import scratch_path
from terrastate.sinks import writers
from terrastate.sinks.versions import SnapshotStore
from terrastate.sources import clicks as src
from terrastate.sources import derived as d
from terrastate.sources import osm as osm_source

SEARCH = "ion_1"  # fixed parameter of the search query

# --- ingest ------------------------------------------------------------------------------

_SUBJECTS = """subjects AS (
  SELECT CASE WHEN click_id % 89 = 0 THEN 'click.tile.' ELSE 'clicks.tile.' END
         || CAST(CASE WHEN click_id % 97 = 0 THEN tile_id + 1 ELSE tile_id END AS VARCHAR) AS subject,
         tile_id, country_id, timestamp_ns, click_id
  FROM clicks_a),
parsed AS (
  SELECT *, CASE WHEN regexp_matches(subject, '^clicks\\.tile\\.\\+?[0-9]+$')
                 AND TRY_CAST(substr(subject, 13) AS BIGINT) <= 4294967295
            THEN TRY_CAST(substr(subject, 13) AS BIGINT) END AS subject_tile_id
  FROM subjects)"""


@register("click_payload_ingest", "S2", with_(CLICKS_A) + """
SELECT click_id AS source_id, tile_id, country_id, timestamp_ns, CAST(click_id AS VARCHAR) AS click_id
FROM clicks_a WHERE click_id % 101 <> 0""")
def q_click_payload_ingest(spark, sf):
    valid, _ = src.split_payloads(d.payloads(spark, sf))
    return valid


@register("reject_table", "T4", with_(CLICKS_A) + """
SELECT click_id AS source_id, 'truncated length-delimited field' AS reason FROM clicks_a WHERE click_id % 101 = 0""")
def q_reject_table(spark, sf):
    _, rejects = src.split_payloads(d.payloads(spark, sf))
    return rejects


@register("subject_tile_id", "S3", with_(CLICKS_A, _SUBJECTS) + """
SELECT subject, tile_id, country_id, timestamp_ns, click_id, subject_tile_id,
       CASE WHEN subject_tile_id IS NULL THEN 'bad subject' END AS subject_error FROM parsed""")
def q_subject_tile_id(spark, sf):
    return src.subject_tile_id(d.subjects(spark, sf))


@register("divergence_audit", "T5", with_(CLICKS_A, _SUBJECTS) + """
SELECT subject, tile_id, country_id, timestamp_ns, click_id, subject_tile_id,
       CASE WHEN subject_tile_id IS NULL THEN 'bad subject' END AS subject_error
FROM parsed WHERE subject_tile_id IS DISTINCT FROM tile_id""")
def q_divergence_audit(spark, sf):
    return rc.divergence_audit(src.subject_tile_id(d.subjects(spark, sf)))


@register("stamp_clicks", "S4", with_(CLICKS_A) + """
SELECT tile_id, country_id, arrival_ns AS timestamp_ns, CAST(click_id AS VARCHAR) AS click_id,
       'clicks.tile.' || CAST(tile_id AS VARCHAR) AS subject FROM clicks_a""")
def q_stamp_clicks(spark, sf):
    c = d.clicks_a(spark, sf)
    return src.stamp_clicks(c, click_id="click_id", timestamp_ns="arrival_ns")


@register("unsigned_times", "S5", with_(CLICKS_A) + """,
wide AS (SELECT tile_id, country_id, click_id, arrival_ns, CASE WHEN click_id % 10 = 0 THEN 18446744073709551615::HUGEINT
           ELSE timestamp_ns::HUGEINT + 9223372036854775808::HUGEINT END AS ts FROM clicks_a)
SELECT tile_id, country_id, CAST(ts AS VARCHAR) AS timestamp_ns FROM (
  SELECT *, row_number() OVER (PARTITION BY tile_id ORDER BY ts DESC, arrival_ns, click_id) AS rn FROM wide) WHERE rn = 1""")
def q_unsigned_times(spark, sf):
    """Unsigned 64-bit times from payload through ownership and the stored snapshot to its textual rows and back."""
    c = d.unsigned_clicks(spark, sf)
    sent = c.select("arrival_ns", F.col("click_id").alias("place"),
                    encode_click(F.col("tile_id"), F.col("country_id"), F.col("timestamp_ns"), F.col("click_id").cast("string")).alias("payload"))
    valid, _ = src.split_payloads(sent, wide=True)
    store = SnapshotStore(spark, scratch_path(spark, "unsigned"), time=src.WIDE)
    store.add(ow.current_ownership(valid, ("arrival_ns", "place")))
    members = store.read().select(F.concat_ws(":", "country_id", F.col("timestamp_ns").cast("string")).alias("member"), F.col("tile_id").cast("string").alias("score"))
    return src.parse_snapshot(members, strict=True, wide=True).withColumn("timestamp_ns", F.col("timestamp_ns").cast("string"))


@register("parse_snapshot", "S5", with_(CLICKS_B, own("clicks_b", "own_b")) + "SELECT * FROM own_b")
def q_parse_snapshot(spark, sf):
    return src.parse_snapshot(d.snapshot_strings(spark, sf))


# --- countries ------------------------------------------------------------------------------

_DIM = "dim AS (SELECT lower(n_name) AS code, n_name AS name FROM nation)"


def _dim(spark, sf):
    return dims.country_dim(d.country_dim_json(spark, sf))


@register("country_dim", "S8", with_(_DIM) + "SELECT * FROM dim")
def q_country_dim(spark, sf):
    return _dim(spark, sf)


@register("country_lookup", "D1", with_(CLICKS_A, CLICKS_B, _DIM, own("clicks_a", "own_a"), own("clicks_b", "own_b")) + """,
keys AS (SELECT country_id, count(*) AS score FROM (SELECT * FROM own_a UNION ALL SELECT * FROM own_b) GROUP BY 1)
SELECT k.country_id, k.score, dim.name FROM keys k LEFT JOIN dim ON dim.code = k.country_id""")
def q_country_lookup(spark, sf):
    owners = ow.current_ownership(d.clicks_a(spark, sf)).unionByName(ow.current_ownership(d.clicks_b(spark, sf)))
    keys = owners.groupBy("country_id").agg(F.count(F.lit(1)).alias("score"))
    return dims.lookup(keys, _dim(spark, sf))


@register("country_contains", "D1", with_(CLICKS_A, CLICKS_B, _DIM) + """
SELECT DISTINCT country_id FROM (SELECT country_id FROM clicks_a UNION ALL SELECT country_id FROM clicks_b)
WHERE country_id IN (SELECT code FROM dim)""")
def q_country_contains(spark, sf):
    ids = d.clicks_a(spark, sf).select("country_id").unionByName(d.clicks_b(spark, sf).select("country_id")).distinct()
    return dims.contains(ids, _dim(spark, sf))


@register("country_codes", "D1", with_(_DIM) + "SELECT DISTINCT code FROM dim")
def q_country_codes(spark, sf):
    return dims.codes(_dim(spark, sf))


@register("country_count", "D1", with_(_DIM) + "SELECT count(DISTINCT code) AS countries FROM dim")
def q_country_count(spark, sf):
    return dims.size(_dim(spark, sf))


_FLAGS_FROM = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_FLAGS_TO = "".join(chr(0x1F1E6 + i) for i in range(26))


@register("country_display", "F1", with_(_DIM) + f"""
SELECT code, name, lower(code) AS code_lower, translate(upper(code), '{_FLAGS_FROM}', '{_FLAGS_TO}') AS flag,
       CASE WHEN length(name) > 18 THEN trim(substring(name, 1, 18)) ELSE name END AS display_name,
       translate(upper(code), '{_FLAGS_FROM}', '{_FLAGS_TO}') || '  ' || name AS label FROM dim""")
def q_country_display(spark, sf):
    return dims.decorate(_dim(spark, sf))


@register("search_countries", "F2", with_(_DIM) + f"SELECT * FROM dim WHERE contains(lower(name), '{SEARCH}')")
def q_search_countries(spark, sf):
    return dims.search(_dim(spark, sf), SEARCH)


@register("display_name", "F3", """
SELECT p_partkey, CASE WHEN length(p_name || ' ' || p_type || ' ' || p_brand) > 18
    THEN trim(substring(p_name || ' ' || p_type || ' ' || p_brand, 1, 18))
    ELSE p_name || ' ' || p_type || ' ' || p_brand END AS display_name FROM part""")
def q_display_name(spark, sf):
    from terrastate.functions.scalar import display_name

    p = d.table(spark, sf, "part")
    full = F.concat_ws(" ", "p_name", "p_type", "p_brand")
    return p.select("p_partkey", display_name(full).alias("display_name"))


@register("percent", "F4", with_(CLICKS_B, own("clicks_b", "own_b")) + """
SELECT country_id, round(CAST(count(*) AS DOUBLE) / 120000 * 100.0, 2) AS percent FROM own_b GROUP BY 1""")
def q_percent(spark, sf):
    from terrastate.functions.scalar import percent_of
    from terrastate.operators.leaderboard import leaderboard

    board = leaderboard(ow.current_ownership(d.clicks_b(spark, sf)))
    return board.select("country_id", percent_of(F.col("score")).alias("percent"))


# --- map elements ---------------------------------------------------------------------------

_NODES = """nodes AS (
  SELECT p_partkey AS id, (CAST((p_partkey*104729) % 10009 AS DOUBLE) / 10009.0 - 0.5) * 180.0 AS lat,
         (CAST((p_partkey*7919) % 10007 AS DOUBLE) / 10007.0 - 0.5) * 360.0 AS lon,
         CASE p_size % 4 WHEN 0 THEN 'city' WHEN 1 THEN 'town' WHEN 2 THEN 'village' END AS place,
         p_name AS name,
         CASE WHEN p_partkey % 13 = 0 THEN 'n/a' ELSE CAST(p_size * 1000 AS VARCHAR) END AS population,
         p_partkey % 3 = 0 AS dense, CAST(floor(p_partkey / 100) AS BIGINT) AS block_id
  FROM part)"""

_CITIES = _NODES + """,
cities AS (
  SELECT id, name, lat, lon, TRY_CAST(CASE WHEN regexp_matches(population, '^[+-]?[0-9]+$') THEN population END AS BIGINT)
         AS population FROM nodes WHERE place IN ('city', 'town') AND name IS NOT NULL)"""

_WAYS = """ways AS (
  SELECT o_orderkey AS id,
         CASE WHEN starts_with(o_orderpriority, '1') THEN 'primary' WHEN starts_with(o_orderpriority, '2') THEN 'secondary' END AS highway,
         CASE WHEN o_orderstatus = 'F' THEN 'Road ' || CAST(o_orderkey AS VARCHAR) END AS name,
         coalesce((SELECT string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY l_linenumber, l_partkey)
                   FROM lineitem WHERE l_orderkey = o_orderkey), '') AS nodes,
         CAST(floor(o_orderkey / 100) AS BIGINT) AS block_id
  FROM orders)"""


def _nodes(spark, sf):
    return d.osm_nodes(spark, sf)


@register("osm_elements", "S9", with_(_NODES) + """
SELECT id, lat, lon, place, name, population, dense, block_id FROM nodes""")
def q_osm_elements(spark, sf):
    n = _nodes(spark, sf)
    t = F.col("tags")
    return n.select("id", "lat", "lon", t["place"].alias("place"), t["name"].alias("name"),
                    t["population"].alias("population"), "dense", "block_id")


def _stored(spark, elements, name, read, fmt):
    """Elements laid down as files, and read by the source's reader."""
    path = scratch_path(spark, name)
    elements.write.format(fmt).save(path)
    return read(spark, path, fmt)


@register("osm_nodes_source", "S9", with_(_NODES) + """
SELECT id, lat, lon, place, name, population, dense, block_id FROM nodes""")
def q_osm_nodes_source(spark, sf):
    n = _stored(spark, d.osm_nodes(spark, sf), "osm-nodes", osm_source.read_nodes, "parquet")
    t = F.col("tags")
    return n.select("id", "lat", "lon", t["place"].alias("place"), t["name"].alias("name"),
                    t["population"].alias("population"), "dense", "block_id")


@register("osm_ways_source", "S9", with_(_WAYS) + "SELECT id, nodes, highway, name, 'paved' AS surface, block_id FROM ways")
def q_osm_ways_source(spark, sf):
    w = _stored(spark, d.osm_ways(spark, sf), "osm-ways", osm_source.read_ways, "json")
    t = F.col("tags")
    return w.select("id", F.array_join(F.col("refs").cast("array<string>"), ",").alias("nodes"), t["highway"].alias("highway"),
                    t["name"].alias("name"), t["surface"].alias("surface"), "block_id")


@register("osm_relations_source", "S9", """
SELECT c_custkey AS id, lower(c_mktsegment) AS type, CAST(floor(c_custkey / 100) AS BIGINT) AS block_id FROM customer""")
def q_osm_relations_source(spark, sf):
    r = _stored(spark, d.osm_relations(spark, sf), "osm-relations", osm_source.read_relations, "json")
    return r.select("id", F.col("tags")["type"].alias("type"), "block_id")


@register("extract_cities", "M1", with_(_CITIES) + "SELECT * FROM cities")
def q_extract_cities(spark, sf):
    return osm.extract_cities(_nodes(spark, sf))


@register("extract_cities_plain", "M1", with_(_CITIES) + " SELECT c.* FROM cities c JOIN nodes n USING (id) WHERE NOT n.dense")
def q_extract_cities_plain(spark, sf):
    return osm.extract_cities(_nodes(spark, sf), include_dense=False)


@register("extract_roads", "M2", with_(_WAYS) + "SELECT id, name, nodes FROM ways WHERE highway IS NOT NULL")
def q_extract_roads(spark, sf):
    r = osm.extract_roads(d.osm_ways(spark, sf))
    return r.select("id", "name", F.array_join(F.col("nodes").cast("array<string>"), ",").alias("nodes"))


@register("city_point", "M3", with_(_CITIES) + """
SELECT *, 'POINT(' || CAST(lon AS VARCHAR) || ' ' || CAST(lat AS VARCHAR) || ')' AS geom FROM cities""")
def q_city_point(spark, sf):
    return osm.city_point(osm.extract_cities(_nodes(spark, sf)))


@register("element_counts", "L7", with_(_NODES) + """
SELECT block_id, kind, count(*) AS n FROM (
  SELECT block_id, CASE WHEN dense THEN 'dense_node' ELSE 'node' END AS kind FROM nodes
  UNION ALL SELECT CAST(floor(o_orderkey / 100) AS BIGINT), 'way' FROM orders
  UNION ALL SELECT CAST(floor(c_custkey / 100) AS BIGINT), 'relation' FROM customer) GROUP BY 1, 2""")
def q_element_counts(spark, sf):
    return osm.element_counts(_nodes(spark, sf), d.osm_ways(spark, sf), d.osm_relations(spark, sf))


@register("cities_sink", "K5", with_(_CITIES) + """
SELECT *, 'SRID=4326;POINT(' || CAST(lon AS VARCHAR) || ' ' || CAST(lat AS VARCHAR) || ')' AS geom FROM cities""")
def q_cities_sink(spark, sf):
    return writers.city_records(osm.extract_cities(_nodes(spark, sf)))


@register("roads_sink", "K5", with_(_WAYS) + """
SELECT id, name, '[' || nodes || ']' AS nodes FROM ways WHERE highway IS NOT NULL""")
def q_roads_sink(spark, sf):
    return writers.road_records(osm.extract_roads(d.osm_ways(spark, sf)))


# --- globe points ---------------------------------------------------------------------------

_RAW = TILES + """,
tile_xyz AS (
  SELECT tile_id, cos(radians((v - 0.5) * 180.0)) * cos(radians((u - 0.5) * 360.0)) AS x,
         sin(radians((v - 0.5) * 180.0)) AS y, cos(radians((v - 0.5) * 180.0)) * sin(radians((u - 0.5) * 360.0)) AS z
  FROM tiles),
base AS (
  SELECT t.tile_id, t.tile_id * 2 AS ordinal, x * CAST(1 + p_size % 3 AS DOUBLE) AS x,
         y * CAST(1 + p_size % 3 AS DOUBLE) AS y, z * CAST(1 + p_size % 3 AS DOUBLE) AS z
  FROM tile_xyz t JOIN part ON p_partkey = t.tile_id),
raw AS (SELECT ordinal, x, y, z FROM base UNION ALL SELECT ordinal + 1, x, y, z FROM base WHERE tile_id % 10 = 0),
unit AS (SELECT ordinal, x / sqrt(x*x + y*y + z*z) AS x, y / sqrt(x*x + y*y + z*z) AS y, z / sqrt(x*x + y*y + z*z) AS z FROM raw),
uv AS (SELECT *, round(1.0 - atan2(z, x) / (2 * pi()), 6) AS u, round(0.5 + asin(y) / pi(), 6) AS v FROM unit)"""


def _unit(spark, sf):
    return points.normalize_points(d.raw_points(spark, sf))


def _rounded(df, cols=("x", "y", "z")):
    """Trig results are compared at 6 places (the engines' libm may differ in the last bit)."""
    return df.select(*[F.round(c, 6).alias(c) if c in cols else F.col(c) for c in df.columns])


@register("normalize_points", "G9", with_(_RAW) + "SELECT ordinal, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z FROM unit")
def q_normalize_points(spark, sf):
    return _rounded(_unit(spark, sf))


@register("xyz_to_uv", "G8", with_(_RAW) + "SELECT ordinal, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z, u, v FROM uv")
def q_xyz_to_uv(spark, sf):
    return _rounded(points.xyz_to_uv(_unit(spark, sf)))


@register("xyz_to_uv_code", "G8", with_(_RAW) + """
SELECT ordinal, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z, round(0.5 + atan2(z, x) / (2 * pi()), 6) AS u,
       round(0.5 - asin(y) / pi(), 6) AS v FROM unit""")
def q_xyz_to_uv_code(spark, sf):
    """The point script's own formula."""
    return _rounded(points.xyz_to_uv(_unit(spark, sf), convention="code"))


@register("dedup_points", "G10", with_(_RAW) + """
SELECT min(ordinal) AS ordinal, round(arg_min(x, ordinal), 6) AS x, round(arg_min(y, ordinal), 6) AS y,
       round(arg_min(z, ordinal), 6) AS z
FROM unit GROUP BY round(x, 6), round(y, 6), round(z, 6)""")
def q_dedup_points(spark, sf):
    return _rounded(points.dedup_points(_unit(spark, sf)))


_LAND = _RAW + """,
mask AS (SELECT CAST(i % 36 AS INTEGER) AS px, CAST(i // 36 AS INTEGER) AS py,
                CAST(((i % 36) * 37 + (i // 36) * 91) % 256 AS INTEGER) AS red FROM range(36 * 18) t(i)),
land AS (
  SELECT uv.* FROM uv JOIN mask ON mask.px = greatest(floor(u * 36), 0) AND mask.py = greatest(floor(v * 18), 0)
  WHERE red < 128)"""


def _land(spark, sf):
    pts = points.xyz_to_uv(_unit(spark, sf))
    return points.land_filter(pts, d.land_mask(spark), d.MASK_W, d.MASK_H, d.MASK_THRESHOLD)


@register("land_filter", "G11", with_(_LAND) + "SELECT ordinal, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z, u, v FROM land")
def q_land_filter(spark, sf):
    return _rounded(_land(spark, sf))


@register("land_points_export", "K4", with_(_LAND) + "SELECT ordinal, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z, u, v FROM land")
def q_land_points_export(spark, sf):
    return _rounded(writers.land_point_records(_land(spark, sf)))


@register("lower_code", "F5", """
SELECT DISTINCT n_name AS code, lower(n_name) AS code_lower FROM nation""")
def q_lower_code(spark, sf):
    from terrastate.functions.scalar import lower_code

    polys = d.country_features_json(spark, sf).select(F.get_json_object("value", "$.properties.ISO_A2").alias("code"))
    return polys.distinct().select("code", lower_code(F.col("code")).alias("code_lower"))


@register("display_label", "F6", with_(_DIM) + f"""
SELECT code, translate(upper(code), '{_FLAGS_FROM}', '{_FLAGS_TO}') || '  ' || name AS label FROM dim""")
def q_display_label(spark, sf):
    from terrastate.functions.scalar import display_label

    return _dim(spark, sf).select("code", display_label(F.col("code"), F.col("name")).alias("label"))


@register("click_request_ingest", "S2", with_(CLICKS_A) + """
SELECT tile_id, country_id, arrival_ns AS timestamp_ns, CAST(click_id AS VARCHAR) AS click_id,
       'clicks.tile.' || CAST(tile_id AS VARCHAR) AS subject FROM clicks_a""")
def q_click_request_ingest(spark, sf):
    """Binary click requests (as posted by clients) decoded and stamped (S2 + S4)."""
    from terrastate.functions.wire import encode_request

    c = d.clicks_a(spark, sf)
    posted = c.select("click_id", "arrival_ns", encode_request(F.col("tile_id"), F.col("country_id")).alias("payload"))
    requests, _ = src.split_payloads(posted, kind="request")
    return src.stamp_clicks(requests, click_id="click_id", timestamp_ns="arrival_ns")
