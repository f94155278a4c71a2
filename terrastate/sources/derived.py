"""Engine inputs derived by Spark from the driver's tables.

Every function reads the Parquet tables under ``sf_dir`` and returns a lazily
planned DataFrame whose size grows with them; nothing is made up on the driver
except the 36 x 18 land mask raster, which only the land filter reads next to
the derived points.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from terrastate.functions.scalar import epoch_ns, uv_to_lat, uv_to_lon

HOUR_NS = 3_600_000_000_000

# Fixed values of the derived geometry: tile hashing primes and the box of each nation.
U_MULT, U_MOD = 7919, 10007
V_MULT, V_MOD = 104729, 10009
BOX_W, BOX_H, BOXES_PER_ROW = 72.0, 36.0, 5

LINE_PARTS, LINE_SUPPLIERS = 10_000_000, 10_000  # fixed values: room for part and supplier numbers in a click id
WIDE_ID = "decimal(38,0)"

# Fixed values of the land mask fixture.
MASK_W, MASK_H, MASK_THRESHOLD = 36, 18, 128


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# --- clicks --------------------------------------------------------------------

def clicks_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as clicks arriving k hours late (k from ``props``): many stale clicks."""
    ev = table(spark, sf_dir, "events")
    ts = epoch_ns(ev, "ts")
    k = F.get_json_object("props", "$.k").cast("bigint")
    return ev.select(
        F.col("user_id").alias("tile_id"),
        F.col("event_type").alias("country_id"),
        ts.alias("timestamp_ns"),
        F.col("event_id").alias("click_id"),
        (ts + k * F.lit(HOUR_NS)).alias("arrival_ns"),
    )


def clicks_b_env(spark: SparkSession, sf_dir: str, wide: bool = False) -> DataFrame:
    """Line items as clicks on parts by supplier nation, with the orderkey kept
    for the environment split.  ``wide``: the same click ids as decimals, which
    hold those of order keys beyond 9,223,371 too; for results without ids."""
    li = table(spark, sf_dir, "lineitem")
    sup = table(spark, sf_dir, "supplier")
    nat = table(spark, sf_dir, "nation")
    ts = epoch_ns(li, "l_shipdate") + F.col("l_orderkey") * F.lit(10) + F.col("l_linenumber")
    # an order line repeats, but not on the same part of the same supplier
    order_key = F.col("l_orderkey").cast(WIDE_ID) if wide else F.col("l_orderkey")
    line_id = ((order_key * 10 + F.col("l_linenumber")) * LINE_PARTS + F.col("l_partkey")) * LINE_SUPPLIERS + F.col("l_suppkey")
    joined = (li.join(sup, li.l_suppkey == sup.s_suppkey)
              .join(nat, sup.s_nationkey == nat.n_nationkey))
    return joined.select(
        F.col("l_partkey").alias("tile_id"),
        F.lower("n_name").alias("country_id"),
        ts.alias("timestamp_ns"),
        (line_id.cast(WIDE_ID) if wide else line_id).alias("click_id"),
        ts.alias("arrival_ns"),
        F.col("l_orderkey"),
    )


def clicks_b(spark: SparkSession, sf_dir: str, wide: bool = False) -> DataFrame:
    """Environment A: all clicks."""
    return clicks_b_env(spark, sf_dir, wide).drop("l_orderkey")


def clicks_b_replica(spark: SparkSession, sf_dir: str, wide: bool = False) -> DataFrame:
    """Environment B: a replica that missed some clicks and some tiles."""
    c = clicks_b_env(spark, sf_dir, wide)
    return (c.filter(((F.col("l_orderkey") % 3) != 0) & ((F.col("tile_id") % 10) != 7))
            .drop("l_orderkey"))


# --- geometry --------------------------------------------------------------------

def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One tile per part: uv from two multiplicative hashes, xyz on the unit sphere."""
    p = table(spark, sf_dir, "part")
    u = (F.col("p_partkey") * F.lit(U_MULT) % F.lit(U_MOD)).cast("double") / F.lit(float(U_MOD))
    v = (F.col("p_partkey") * F.lit(V_MULT) % F.lit(V_MOD)).cast("double") / F.lit(float(V_MOD))
    t = p.select(F.col("p_partkey").alias("tile_id"), u.alias("u"), v.alias("v"))
    lon = F.radians(uv_to_lon(F.col("u")))
    lat = F.radians(uv_to_lat(F.col("v")))
    return t.select("tile_id",
                    (F.cos(lat) * F.cos(lon)).alias("x"), F.sin(lat).alias("y"), (F.cos(lat) * F.sin(lon)).alias("z"),
                    "u", "v")


def _diamond(nat: DataFrame) -> DataFrame:
    x0 = F.lit(-180.0) + F.lit(BOX_W) * (F.col("n_nationkey") % BOXES_PER_ROW)
    y0 = F.lit(-90.0) + F.lit(BOX_H) * F.floor(F.col("n_nationkey") / BOXES_PER_ROW)
    pts = [(x0 + BOX_W / 2, y0), (x0, y0 + BOX_H / 2), (x0 + BOX_W / 2, y0 + BOX_H),
           (x0 + BOX_W, y0 + BOX_H / 2), (x0 + BOX_W / 2, y0)]
    return nat.select("n_nationkey", "n_name",
                      F.array(*[F.array(px.cast("double"), py.cast("double")) for px, py in pts]).alias("ring"))


def country_features_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One GeoJSON MultiPolygon feature per nation (a diamond in its box), as a
    ``value`` string column like ``spark.read.text`` of a JSON-lines file."""
    d = _diamond(table(spark, sf_dir, "nation"))
    feature = F.struct(
        F.lit("Feature").alias("type"),
        F.col("n_nationkey").cast("bigint").alias("id"),
        F.create_map(F.lit("ISO_A2"), F.col("n_name"), F.lit("ADMIN"), F.col("n_name")).alias("properties"),
        F.struct(F.lit("MultiPolygon").alias("type"),
                 F.array(F.array(F.col("ring"))).alias("coordinates")).alias("geometry"),
    )
    return d.select(F.to_json(feature).alias("value"))


def shared_features_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features that are easy to confuse: nations with an even key come twice and
    have no id, the others share one id; every feature has an outer ring half as
    wide again as its box (so neighbours overlap) and a small inner ring."""
    even = F.col("n_nationkey") % 2 == 0
    copies = F.explode(F.when(even, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    d = _diamond(table(spark, sf_dir, "nation")).select("*", copies)

    def scaled(factor: float):
        cx, cy = (F.col("ring")[1][0] + F.col("ring")[3][0]) / 2, (F.col("ring")[0][1] + F.col("ring")[2][1]) / 2
        return F.transform("ring", lambda p: F.array(cx + (p[0] - cx) * factor, cy + (p[1] - cy) * factor))

    feature = F.struct(
        F.lit("Feature").alias("type"), F.when(~even, F.lit(7).cast("bigint")).alias("id"),
        F.create_map(F.lit("ISO_A2"), F.col("n_name"), F.lit("ADMIN"), F.col("n_name")).alias("properties"),
        F.struct(F.lit("MultiPolygon").alias("type"), F.array(F.array(scaled(1.5), scaled(0.25))).alias("coordinates")).alias("geometry"))
    return d.select(F.to_json(feature).alias("value"))


def coordinates_json(spark: SparkSession, sf_dir: str, chunk: int = 1000) -> DataFrame:
    """The tile coordinate file as JSON rows, one per chunk of ``chunk`` tiles:
    ``{"first_tile", "positions", "uvs"}``.  Chunks keep any single row bounded."""
    t = tiles(spark, sf_dir)
    grouped = (t.groupBy(F.floor(F.col("tile_id") / chunk).alias("chunk"))
               .agg(F.array_sort(F.collect_list(F.struct("tile_id", "x", "y", "z", "u", "v"))).alias("ts")))
    return grouped.select(F.to_json(F.struct(
        F.col("ts")[0]["tile_id"].alias("first_tile"),
        F.flatten(F.transform("ts", lambda r: F.array(r["x"], r["y"], r["z"]))).alias("positions"),
        F.flatten(F.transform("ts", lambda r: F.array(r["u"], r["v"]))).alias("uvs"),
    )).alias("value"))


def _document(parts: list[DataFrame], path: str) -> None:
    """One text file of the lines of ``parts`` (place, value), in their order."""
    lines = parts[0].withColumn("part", F.lit(0))
    for k, p in enumerate(parts[1:], 1):
        lines = lines.unionByName(p.withColumn("part", F.lit(k)))
    lines.repartition(1).sortWithinPartitions("part", "place").select("value").write.text(path)


def _line(spark: SparkSession, text: str) -> DataFrame:
    return spark.range(1).select(F.col("id").alias("place"), F.lit(text).alias("value"))


def coordinates_document(spark: SparkSession, sf_dir: str, path: str) -> None:
    """The tile coordinate file as it is published: one object with two flat arrays."""
    t = tiles(spark, sf_dir)

    def numbers(*names: str) -> DataFrame:
        text = F.concat_ws(",", *[F.col(n).cast("string") for n in names])
        return t.select(F.col("tile_id").alias("place"), F.concat(F.when(F.col("tile_id") > 0, ",").otherwise(""), text).alias("value"))

    _document([_line(spark, '{"positions":['), numbers("x", "y", "z"), _line(spark, '],"uvs":['), numbers("u", "v"), _line(spark, "]}")], path)


def features_document(spark: SparkSession, sf_dir: str, path: str) -> None:
    """The country features as one ``FeatureCollection`` document, with other objects and odd strings beside them."""
    head = '{"type":"FeatureCollection","name":"a } \\"{ in a string","crs":{"type":"name","properties":{"name":"}{"}},"features":['
    f = country_features_json(spark, sf_dir).withColumn("place", F.get_json_object("value", "$.id").cast("bigint"))
    rows = f.select("place", F.concat(F.when(F.col("place") > 0, ",").otherwise(""), "value").alias("value"))
    _document([_line(spark, head), rows, _line(spark, '],"bbox":[0,1]}')], path)


def country_dim_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Country dimension as JSON objects code -> name (one object per nation)."""
    n = table(spark, sf_dir, "nation")
    return n.select(F.to_json(F.create_map(F.lower("n_name"), F.col("n_name"))).alias("value"))


# --- map elements ------------------------------------------------------------------

PLACES = ("city", "town", "village")  # fixed values: p_size % 4 picks one, 3 = no place tag


def osm_nodes(spark: SparkSession, sf_dir: str, block_size: int = 100) -> DataFrame:
    p = table(spark, sf_dir, "part")
    u = (F.col("p_partkey") * F.lit(U_MULT) % F.lit(U_MOD)).cast("double") / F.lit(float(U_MOD))
    v = (F.col("p_partkey") * F.lit(V_MULT) % F.lit(V_MOD)).cast("double") / F.lit(float(V_MOD))
    place = (F.when(F.col("p_size") % 4 == 0, F.lit(PLACES[0]))
             .when(F.col("p_size") % 4 == 1, F.lit(PLACES[1]))
             .when(F.col("p_size") % 4 == 2, F.lit(PLACES[2])))
    population = F.when(F.col("p_partkey") % 13 == 0, F.lit("n/a")).otherwise((F.col("p_size") * 1000).cast("string"))
    tags = F.map_filter(F.create_map(F.lit("place"), place, F.lit("name"), F.col("p_name"),
                                     F.lit("population"), population), lambda k, val: val.isNotNull())
    return p.select(
        F.col("p_partkey").alias("id"),
        uv_to_lat(v).alias("lat"),
        uv_to_lon(u).alias("lon"),
        tags.alias("tags"),
        (F.col("p_partkey") % 3 == 0).alias("dense"),
        F.floor(F.col("p_partkey") / block_size).cast("bigint").alias("block_id"),
    )


def osm_ways(spark: SparkSession, sf_dir: str, block_size: int = 100) -> DataFrame:
    """Orders as ways over their parts' nodes, in (linenumber, partkey) order."""
    o = table(spark, sf_dir, "orders")
    li = table(spark, sf_dir, "lineitem")
    refs = (li.groupBy("l_orderkey")
            .agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("items"))
            .select(F.col("l_orderkey").alias("o_orderkey"),
                    F.transform("items", lambda s: s["l_partkey"]).alias("refs")))
    highway = (F.when(F.col("o_orderpriority").startswith("1"), F.lit("primary"))
               .when(F.col("o_orderpriority").startswith("2"), F.lit("secondary")))
    name = F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("Road "), F.col("o_orderkey").cast("string")))
    tags = F.map_filter(F.create_map(F.lit("highway"), highway, F.lit("name"), name,
                                     F.lit("surface"), F.lit("paved")), lambda k, val: val.isNotNull())
    return (o.join(refs, "o_orderkey", "left")
            .select(F.col("o_orderkey").alias("id"),
                    F.coalesce(F.col("refs"), F.array().cast("array<bigint>")).alias("refs"),
                    tags.alias("tags"),
                    F.floor(F.col("o_orderkey") / block_size).cast("bigint").alias("block_id")))


def osm_relations(spark: SparkSession, sf_dir: str, block_size: int = 100) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("id"),
                    F.create_map(F.lit("type"), F.lower("c_mktsegment")).alias("tags"),
                    F.floor(F.col("c_custkey") / block_size).cast("bigint").alias("block_id"))


# --- points and raster ------------------------------------------------------------

def raw_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tile points pushed off the sphere by 1-3x; every 10th point delivered twice
    (the repeat has the next ordinal, so the original comes first)."""
    t = tiles(spark, sf_dir)
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("tile_id"), "p_size")
    scale = (F.lit(1) + F.col("p_size") % 3).cast("double")
    base = t.join(p, "tile_id").select(
        (F.col("tile_id") * 2).alias("ordinal"),
        (F.col("x") * scale).alias("x"), (F.col("y") * scale).alias("y"), (F.col("z") * scale).alias("z"),
        "tile_id")
    again = base.filter(F.col("tile_id") % 10 == 0).withColumn("ordinal", F.col("ordinal") + 1)
    return base.unionByName(again).drop("tile_id")


def land_mask(spark: SparkSession, width: int = MASK_W, height: int = MASK_H) -> DataFrame:
    """Raster as rows (px, py, red); red = (px*37 + py*91) % 256."""
    r = spark.range(width * height)
    px = F.col("id") % width
    py = F.floor(F.col("id") / width)
    return r.select(px.cast("int").alias("px"), py.cast("int").alias("py"),
                    ((px * 37 + py * 91) % 256).cast("int").alias("red"))


# --- raw ingest inputs -------------------------------------------------------------

SUBJECT_PREFIX = "clicks.tile."  # fixed value: log subject per tile


def subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log subjects of ``clicks_a``: every 97th subject names the next tile,
    every 89th has a broken prefix."""
    c = clicks_a(spark, sf_dir)
    sub_tile = F.when(F.col("click_id") % 97 == 0, F.col("tile_id") + 1).otherwise(F.col("tile_id"))
    prefix = F.when(F.col("click_id") % 89 == 0, F.lit("click.tile.")).otherwise(F.lit(SUBJECT_PREFIX))
    return c.select(F.concat(prefix, sub_tile.cast("string")).alias("subject"), "tile_id", "country_id",
                    "timestamp_ns", "click_id")


def snapshot_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cold store's sorted-set rows ("country:ts", score) of the final
    ownership of ``clicks_b``, plus two malformed members."""
    from terrastate.operators.ownership import current_ownership

    own = current_ownership(clicks_b(spark, sf_dir))
    good = own.select(F.concat_ws(":", "country_id", F.col("timestamp_ns").cast("string")).alias("member"),
                      F.col("tile_id").cast("string").alias("score"))
    bad = spark.createDataFrame([("a:b:1", "0"), ("x:notanumber", "0")], "member string, score string")
    return good.unionByName(bad)


def unsigned_clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``clicks_a`` with times in the upper half of the unsigned 64-bit range, every tenth the greatest there is."""
    most, half = F.expr("CAST(18446744073709551615 AS DECIMAL(20,0))"), F.expr("CAST(9223372036854775808 AS DECIMAL(20,0))")
    late = (F.col("timestamp_ns") + half).cast("decimal(20,0)")
    return clicks_a(spark, sf_dir).withColumn("timestamp_ns", F.when(F.col("click_id") % 10 == 0, most).otherwise(late))


PAYLOAD_TRUNCATE_EVERY = 101  # fixed value: every 101st payload loses its last byte


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Binary Click records of ``clicks_a`` encoded in Spark; every 101st one is
    truncated by a byte so it cannot be decoded."""
    from terrastate.functions.wire import encode_click

    c = clicks_a(spark, sf_dir)
    enc = encode_click(F.col("tile_id"), F.col("country_id"), F.col("timestamp_ns"), F.col("click_id").cast("string"))
    cut = F.when(F.col("click_id") % PAYLOAD_TRUNCATE_EVERY == 0,
                 enc.substr(F.lit(1), F.octet_length(enc) - 1)).otherwise(enc)
    return c.select(F.col("click_id").alias("source_id"), cut.alias("payload"))
