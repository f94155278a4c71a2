"""DuckDB SQL for the oracle side of every registered query.

The fragments restate, in plain SQL over the driver's views, the same derived
inputs that ``terrastate.sources.derived`` builds with Spark.  Output rules:
``sum`` cast to BIGINT, trig rounded to 6 places, arrays as joined strings,
time as bigint nanoseconds.
"""

CLICKS_A = """clicks_a AS (
  SELECT user_id AS tile_id, event_type AS country_id, epoch_us(ts)*1000 AS timestamp_ns, event_id AS click_id,
         epoch_us(ts)*1000 + CAST(json_extract(props,'$.k') AS BIGINT)*3600000000000 AS arrival_ns
  FROM events)"""

CLICKS_B_ENV = """clicks_b_env AS (
  SELECT l_partkey AS tile_id, lower(n_name) AS country_id,
         epoch_us(l_shipdate)*1000 + l_orderkey*10 + l_linenumber AS timestamp_ns,
         ((l_orderkey*10 + l_linenumber)*10000000 + l_partkey)*10000 + l_suppkey AS click_id,
         epoch_us(l_shipdate)*1000 + l_orderkey*10 + l_linenumber AS arrival_ns,
         l_orderkey
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey)"""

CLICKS_B = CLICKS_B_ENV + """,
clicks_b AS (SELECT tile_id, country_id, timestamp_ns, click_id, arrival_ns FROM clicks_b_env)"""

CLICKS_B_REPLICA = """clicks_b_replica AS (
  SELECT tile_id, country_id, timestamp_ns, click_id, arrival_ns FROM clicks_b_env
  WHERE l_orderkey % 3 <> 0 AND tile_id % 10 <> 7)"""


def own(src: str, name: str) -> str:
    """Last-writer-wins owner per tile of clicks view ``src``."""
    return f"""{name} AS (
  SELECT tile_id, country_id, timestamp_ns FROM (
    SELECT *, row_number() OVER (PARTITION BY tile_id ORDER BY timestamp_ns DESC, arrival_ns, click_id) AS rn
    FROM {src}) WHERE rn = 1)"""


def classified(src: str, name: str) -> str:
    """Each click with applied / previous_country / previous_ts: running max of
    earlier times, then the last applied country (an independent formulation)."""
    return f"""{name}_r AS (
  SELECT *, max(timestamp_ns) OVER (PARTITION BY tile_id ORDER BY arrival_ns, click_id
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen
  FROM {src}),
{name}_a AS (SELECT *, (seen IS NULL OR timestamp_ns > seen) AS applied FROM {name}_r),
{name} AS (
  SELECT tile_id, country_id, timestamp_ns, click_id, arrival_ns, applied,
         last_value(CASE WHEN applied THEN country_id END IGNORE NULLS) OVER (PARTITION BY tile_id
           ORDER BY arrival_ns, click_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous_country,
         seen AS previous_ts
  FROM {name}_a)"""


TILES = """tiles AS (
  SELECT p_partkey AS tile_id,
         CAST((p_partkey*7919) % 10007 AS DOUBLE) / 10007.0 AS u,
         CAST((p_partkey*104729) % 10009 AS DOUBLE) / 10009.0 AS v
  FROM part)"""

# Diamond of each nation: x0 = -180 + 72*(key % 5), y0 = -90 + 36*floor(key / 5).
RINGS = """boxes AS (
  SELECT n_nationkey, n_name, CAST(-180.0 + 72.0*(n_nationkey % 5) AS DOUBLE) AS x0,
         CAST(-90.0 + 36.0*floor(n_nationkey / 5) AS DOUBLE) AS y0
  FROM nation),
ring_pts AS (
  SELECT CAST(n_nationkey AS BIGINT) AS feature_id, n_name AS country_code, n_name AS name, 0 AS ring_id, pos,
         CASE pos WHEN 0 THEN x0+36 WHEN 1 THEN x0 WHEN 2 THEN x0+36 WHEN 3 THEN x0+72 ELSE x0+36 END AS x,
         CASE pos WHEN 0 THEN y0 WHEN 1 THEN y0+18 WHEN 2 THEN y0+36 WHEN 3 THEN y0+18 ELSE y0 END AS y
  FROM boxes, range(5) t(pos)),
edges AS (
  SELECT a.feature_id, a.country_code, a.ring_id, a.x AS xi, a.y AS yi, b.x AS xj, b.y AS yj
  FROM ring_pts a JOIN ring_pts b ON a.feature_id = b.feature_id AND a.ring_id = b.ring_id
   AND b.pos = CASE WHEN a.pos = 0 THEN 4 ELSE a.pos - 1 END),
envelopes AS (
  SELECT feature_id, country_code, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y,
         (max(x) - min(x)) * (max(y) - min(y)) AS area
  FROM ring_pts GROUP BY feature_id, country_code)"""

TILE_POINTS = """tile_points AS (
  SELECT tile_id, (u - 0.5) * 360.0 AS lon, (v - 0.5) * 180.0 AS lat FROM tiles)"""

CROSSINGS = """crossings AS (
  SELECT p.tile_id, e.feature_id, e.country_code, e.ring_id, count(*) AS crossings
  FROM tile_points p JOIN edges e
    ON ((e.yi > p.lat) <> (e.yj > p.lat)) AND p.lon < (e.xj - e.xi) * (p.lat - e.yi) / (e.yj - e.yi) + e.xi
  GROUP BY ALL)"""

TILE_COUNTRY = """inside AS (
  SELECT DISTINCT tile_id, feature_id, country_code FROM crossings WHERE crossings % 2 = 1),
picked AS (
  SELECT i.tile_id, lower(i.country_code) AS country_code,
         row_number() OVER (PARTITION BY i.tile_id ORDER BY v.area, lower(i.country_code), i.feature_id) AS rn
  FROM inside i JOIN envelopes v USING (feature_id)),
tile_country AS (
  SELECT t.tile_id, p.country_code FROM tiles t LEFT JOIN picked p ON t.tile_id = p.tile_id AND p.rn = 1)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"
