"""Tile -> country assignment by point-in-polygon.

Even-odd ray casting: edge (i, j = i-1, cyclic) of a ring is crossed by the ray
from point (x, y) towards +x when ``(yi > y) != (yj > y)`` and
``x < (xj - xi) * (y - yi) / (yj - yi) + xi``; a point is inside a ring when
the count is odd, and inside a country when it is inside any of its rings
(holes count as inside, as in the reference).

Plan (no nested loop): a tile has exactly one grid key (latitude band,
longitude cell), and polygon edges are replicated to the keys where they
matter, so the spatial join is an equi-join on the key with the exact test as
join condition.  The replicated edge table grows with the polygon data only,
never with the tiles; AQE broadcasts it when small and sort-merges beyond.

Two edge layouts give the same parity:

* ``east`` (G3's crossing counts): an edge goes to every cell from its ring's
  west edge to itself, so a tile meets all edges east of it in its band.
* ``runs`` (G5's default): per longitude column only the edges overlapping the
  column are kept as they are; each maximal chain of consecutive edges lying
  entirely east of the column is replaced by its two end vertices.  Along a
  chain the half-open span test ``(ya > y) != (yb > y)`` telescopes to
  ``[P.y > y] xor [Q.y > y]``, and every edge east of the column is crossed by
  the ray whenever it spans ``y``, so the two end markers carry the chain's
  parity exactly.  A tile then meets the edges of its own cell plus two
  markers per eastward excursion of the ring, however detailed the coastline
  east of it is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from terrastate.functions.scalar import uv_to_lat, uv_to_lon

DEFAULT_BAND_DEG = 1.0
DEFAULT_CELL_DEG = 1.0
EAST_MARGIN = 1e-9  # an edge counts as east of a column only this far past its boundary


def tile_lonlat(tiles: DataFrame) -> DataFrame:
    """G1: (tile_id, lon, lat) from uv."""
    return tiles.select("tile_id", uv_to_lon(F.col("u")).alias("lon"), uv_to_lat(F.col("v")).alias("lat"))


def ring_points(polygons: DataFrame) -> DataFrame:
    return polygons.select("feature_id", "country_code", "ring_id", F.posexplode("ring").alias("pos", "p")) \
        .select("feature_id", "country_code", "ring_id", "pos", F.col("p.x").alias("x"), F.col("p.y").alias("y"))


def country_envelopes(polygons: DataFrame) -> DataFrame:
    """Bounding box of every feature over all its rings, and its area."""
    pts = ring_points(polygons)
    env = pts.groupBy("feature_id", "country_code").agg(
        F.min("x").alias("min_x"), F.max("x").alias("max_x"), F.min("y").alias("min_y"), F.max("y").alias("max_y"))
    return env.withColumn("area", (F.col("max_x") - F.col("min_x")) * (F.col("max_y") - F.col("min_y")))


def ring_vertices(polygons: DataFrame) -> DataFrame:
    """One row per vertex k of every ring with its neighbours ``prev`` (k-1),
    ``prev2`` (k-2) and ``next`` (k+1), cyclic, and the ring's box.

    Ring-level values are computed once per ring and the neighbours come from
    rotated copies zipped with the ring, so an exploded row never carries the
    whole ring: linear in the ring size, also for coastlines of 10^5 vertices.
    """
    rotated = polygons.selectExpr(
        "feature_id", "country_code", "ring_id", "ring",
        "concat(slice(ring, -1, 1), slice(ring, 1, size(ring) - 1)) AS prev",
        "concat(slice(ring, -2, 2), slice(ring, 1, size(ring) - 2)) AS prev2",
        "concat(slice(ring, 2, size(ring) - 1), slice(ring, 1, 1)) AS next",
        "array_min(transform(ring, p -> p.x)) AS ring_min_x",
        "array_max(transform(ring, p -> p.x)) AS ring_max_x",
        "array_min(transform(ring, p -> p.y)) AS ring_min_y",
    )
    return rotated.selectExpr(
        "feature_id", "country_code", "ring_id", "ring_min_x", "ring_max_x", "ring_min_y",
        "posexplode(arrays_zip(ring, prev, prev2, next)) AS (k, v)",
    ).selectExpr(
        "feature_id", "country_code", "ring_id", "ring_min_x", "ring_max_x", "ring_min_y", "k",
        "v.ring AS pi", "v.prev AS pj", "v.prev2 AS pjj", "v.next AS pii",
    )


def ring_edges(polygons: DataFrame) -> DataFrame:
    """Edges (xi, yi) -> (xj, yj) with j the previous vertex, plus the ring's box.
    Horizontal edges can never be crossed and are dropped."""
    return (ring_vertices(polygons)
            .select("feature_id", "country_code", "ring_id",
                    F.col("pi.x").alias("xi"), F.col("pi.y").alias("yi"),
                    F.col("pj.x").alias("xj"), F.col("pj.y").alias("yj"), "ring_min_x", "ring_max_x")
            .filter(F.col("yi") != F.col("yj")))


def _band(lat, band_deg):
    return F.floor(lat / F.lit(band_deg)).cast("bigint")


def _cell(lon, cell_deg):
    return F.floor(lon / F.lit(cell_deg)).cast("bigint")


def keyed_edges(polygons: DataFrame, band_deg: float = DEFAULT_BAND_DEG, cell_deg: float = DEFAULT_CELL_DEG) -> DataFrame:
    """Edges replicated to every (band, cell) key where a point may cross them."""
    e = ring_edges(polygons)
    bands = F.sequence(_band(F.least("yi", "yj"), band_deg), _band(F.greatest("yi", "yj"), band_deg))
    cells = F.sequence(_cell(F.col("ring_min_x"), cell_deg), _cell(F.greatest("xi", "xj"), cell_deg) + 1)
    return e.withColumn("band", F.explode(bands)).withColumn("cell", F.explode(cells))


def _crossing(lon, lat):
    return (((F.col("yi") > lat) != (F.col("yj") > lat))
            & (lon < (F.col("xj") - F.col("xi")) * (lat - F.col("yi")) / (F.col("yj") - F.col("yi")) + F.col("xi")))


def _keyed_points(tiles: DataFrame, band_deg: float, cell_deg: float) -> DataFrame:
    p = tile_lonlat(tiles)
    return p.withColumn("band", _band(F.col("lat"), band_deg)).withColumn("cell", _cell(F.col("lon"), cell_deg))


def ring_crossings(tiles: DataFrame, polygons: DataFrame, band_deg: float = DEFAULT_BAND_DEG,
                   cell_deg: float = DEFAULT_CELL_DEG) -> DataFrame:
    """Crossing count per (tile, ring) for tiles inside the ring's box (only
    pairs with at least one crossing)."""
    pts = _keyed_points(tiles, band_deg, cell_deg).alias("p")
    edges = keyed_edges(polygons, band_deg, cell_deg).alias("e")
    cond = ((F.col("p.band") == F.col("e.band")) & (F.col("p.cell") == F.col("e.cell"))
            & _crossing(F.col("p.lon"), F.col("p.lat"))
            & (F.col("p.lon") >= F.col("e.ring_min_x")) & (F.col("p.lon") <= F.col("e.ring_max_x")))
    j = pts.join(edges, cond, "inner")
    return j.groupBy(F.col("p.tile_id").alias("tile_id"), F.col("e.feature_id").alias("feature_id"),
                     F.col("e.country_code").alias("country_code"), F.col("e.ring_id").alias("ring_id")) \
        .agg(F.count(F.lit(1)).alias("crossings"))


def spatial_candidates(tiles: DataFrame, polygons: DataFrame, band_deg: float = DEFAULT_BAND_DEG,
                       cell_deg: float = DEFAULT_CELL_DEG, reach: float = 0.0) -> DataFrame:
    """(tile, feature) pairs whose envelope is at most ``reach`` degrees from
    the point, with its squared distance (0 inside) and area.  With no reach
    these are the only countries the exact test needs; with one, the order by
    distance tells the nearest countries of a point that lies in none.
    Envelopes, grown by the reach, are exploded to grid keys; equi-join on the key."""
    env = country_envelopes(polygons)
    keyed_env = (env.withColumn("band", F.explode(F.sequence(_band(F.col("min_y") - reach, band_deg), _band(F.col("max_y") + reach, band_deg))))
                 .withColumn("cell", F.explode(F.sequence(_cell(F.col("min_x") - reach, cell_deg), _cell(F.col("max_x") + reach, cell_deg)))))
    pts = _keyed_points(tiles, band_deg, cell_deg)
    dx = F.greatest(F.col("min_x") - F.col("lon"), F.lit(0.0), F.col("lon") - F.col("max_x"))
    dy = F.greatest(F.col("min_y") - F.col("lat"), F.lit(0.0), F.col("lat") - F.col("max_y"))
    return (pts.join(keyed_env, ["band", "cell"]).select("tile_id", "feature_id", "country_code", (dx * dx + dy * dy).alias("dist2"), "area")
            .filter(F.col("dist2") <= reach * reach))


def _ordered_edges(polygons: DataFrame, cell_deg: float) -> DataFrame:
    """Every edge k (vertex k-1 -> vertex k, cyclic) with its neighbours' east
    limits and the ring's box (ids and coordinates only: the rows are the
    build side of the spatial join, so they are kept narrow).

    ``east_max`` of an edge is the last longitude column whose whole width lies
    west of the edge (so every point of that column sees the edge on its east
    side): ``ceil((min(xi, xj) - margin) / w) - 2``.
    """
    w, m = repr(float(cell_deg)), repr(EAST_MARGIN)

    def east_max(xa, xb):
        return f"CAST(ceil((least({xa}, {xb}) - {m}) / {w}) - 2 AS BIGINT)"

    return ring_vertices(polygons).selectExpr(
        "feature_id", "ring_id", "pi.x AS xi", "pi.y AS yi", "pj.x AS xj", "pj.y AS yj",
        east_max("pi.x", "pj.x") + " AS east_max",
        east_max("pj.x", "pjj.x") + " AS east_max_prev",
        east_max("pii.x", "pi.x") + " AS east_max_next",
        f"CAST(floor(ring_min_x / {w}) AS BIGINT) AS col_lo",
        f"CAST(floor(ring_max_x / {w}) AS BIGINT) AS col_hi",
        "ring_min_y",
    )


def column_edges(polygons: DataFrame, band_deg: float = DEFAULT_BAND_DEG, cell_deg: float = DEFAULT_CELL_DEG) -> DataFrame:
    """The ``runs`` layout as rows keyed by (band, cell).

    Per column, every edge is east (column <= its ``east_max``), local, or
    west (never crossed).  Local edges are kept as they are (``marker`` false).
    East edges form chains; a chain's parity is ``[P.y > y] xor [Q.y > y]``
    for its first vertex P and last vertex Q, and since xor is a sum mod 2
    the chain ends need no pairing: each run start / run end is one marker
    row counting ``[marker y > y]``.  Edge k starts a run in the columns
    ``(east_max(k-1), east_max(k)]`` (marker at vertex k-1) and ends one in
    ``(east_max(k+1), east_max(k)]`` (marker at vertex k).  All of this is
    row-local: no window, no aggregate, no shuffle.
    """
    e = _ordered_edges(polygons, cell_deg)
    # One SQL expression (parsed once in the JVM) instead of many small Column calls.
    w, b, m2 = repr(float(cell_deg)), repr(float(band_deg)), repr(2 * EAST_MARGIN)

    def cells(lo, hi, cond="true"):
        return f"CASE WHEN {cond} AND {lo} <= {hi} THEN sequence({lo}, {hi}) ELSE CAST(array() AS array<bigint>) END"

    def rows(cs, xi, yi, xj, yj, marker):
        return (f"transform({cs}, c -> named_struct('cell', c, 'xi', {xi}, 'yi', {yi}, 'xj', {xj}, 'yj', {yj}, "
                f"'marker', {marker}))")

    hi = f"least(CAST(floor((greatest(xi, xj) + {m2}) / {w}) AS BIGINT), col_hi)"
    top = "least(east_max, col_hi)"
    none = "CAST(NULL AS DOUBLE)"
    local = rows(cells("greatest(east_max + 1, col_lo)", hi, "yi <> yj"), "xi", "yi", "xj", "yj", "false")
    starts = rows(cells("greatest(east_max_prev + 1, col_lo)", top), none, "yj", none, "ring_min_y", "true")  # at vertex k-1
    ends = rows(cells("greatest(east_max_next + 1, col_lo)", top), none, "yi", none, "ring_min_y", "true")    # at vertex k
    out = (e.selectExpr("feature_id", "ring_id", f"explode(concat({local}, {starts}, {ends})) AS r")
           .select("feature_id", "ring_id", "r.*"))
    # Local edges cover the bands they span; markers every band from the ring's bottom up to the marker.
    band = (f"explode(sequence(CAST(floor(least(yi, yj) / {b}) AS BIGINT), "
            f"CAST(floor(greatest(yi, yj) / {b}) AS BIGINT))) AS band")
    return out.selectExpr("*", band)


def tile_country(tiles: DataFrame, polygons: DataFrame, band_deg: float = DEFAULT_BAND_DEG,
                 cell_deg: float = DEFAULT_CELL_DEG, layout: str = "runs") -> DataFrame:
    """(tile_id, country_code) for every tile; country_code lower-cased,
    null when no ring holds the tile.  Overlaps: smallest envelope, then code.

    One LEFT join keeps the unassigned tiles, so no second join against the
    tile table is needed; both aggregates are keyed by tile (partial first).
    ``layout`` picks the edge replication (see the module notes).  Each feature
    row is tested on its own (column ``feature_row``), whatever ids repeat.
    """
    if "feature_row" in polygons.columns:
        polygons = polygons.withColumn("feature_id", F.col("feature_row"))
    pts = _keyed_points(tiles, band_deg, cell_deg).alias("p")
    lon, lat = F.col("p.lon"), F.col("p.lat")
    if layout == "runs":
        edges = column_edges(polygons, band_deg, cell_deg).alias("e")
        above = F.col("e.yi") > lat
        spans = above != (F.col("e.yj") > lat)
        east_of_point = lon < (F.col("e.xj") - F.col("e.xi")) * (lat - F.col("e.yi")) / (F.col("e.yj") - F.col("e.yi")) + F.col("e.xi")
        hit = (F.col("e.marker") & above) | (~F.col("e.marker") & spans & east_of_point)
    elif layout == "east":
        edges = keyed_edges(polygons, band_deg, cell_deg).alias("e")
        hit = _crossing(lon, lat)
    else:
        raise ValueError(layout)
    cond = (F.col("p.band") == F.col("e.band")) & (F.col("p.cell") == F.col("e.cell")) & hit
    j = pts.join(edges, cond, "left")
    per_ring = (j.groupBy(F.col("p.tile_id").alias("tile_id"), F.col("e.feature_id").alias("feature_id"),
                          F.col("e.ring_id").alias("ring_id"))
                .agg(F.count(F.col("e.yi")).alias("crossings")))
    # Code and envelope area join the (tile, ring) parities, not the edge rows;
    # the envelope table has one row per feature.
    env = country_envelopes(polygons).select("feature_id", F.lower("country_code").alias("code"), "area")
    inside = (per_ring.join(env, "feature_id", "left")
              .withColumn("_in", F.when(F.col("crossings") % 2 == 1, F.struct("area", "code", "feature_id"))))
    best = inside.groupBy("tile_id").agg(F.min("_in").alias("best"))
    return best.select("tile_id", F.col("best.code").alias("country_code"))


def unassigned_tiles(tc: DataFrame) -> DataFrame:
    """Tiles in no country, sorted."""
    return tc.filter(F.col("country_code").isNull()).select("tile_id").orderBy("tile_id")


def country_tiles(tc: DataFrame, chunk: int = 10_000) -> DataFrame:
    """Per country its sorted tiles, in chunks of ``chunk`` consecutive ids
    (a country holding a third of the globe still yields bounded rows)."""
    from terrastate.sinks.writers import country_tile_chunks

    return country_tile_chunks(tc, chunk)


def tiles_of_country(tc: DataFrame, code: str) -> DataFrame:
    return tc.filter(F.col("country_code") == F.lit(code)).select("tile_id")


def country_of_tile(tc: DataFrame, tile_id: int) -> DataFrame:
    return tc.filter(F.col("tile_id") == F.lit(tile_id))


def country_codes(tc: DataFrame) -> DataFrame:
    """Codes of the countries that hold tiles."""
    return tc.filter(F.col("country_code").isNotNull()).select("country_code").distinct()


def tile_totals(tc: DataFrame) -> DataFrame:
    """One row with total, assigned and unassigned tile counts."""
    return tc.agg(F.count(F.lit(1)).alias("total"), F.count("country_code").alias("assigned"),
                  (F.count(F.lit(1)) - F.count("country_code")).alias("unassigned"))
