"""Geometry sources: tile coordinates (S6) and country polygons."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F, types as T

from terrastate import schemas
from terrastate.sources.json_split import flat_numbers, objects_in_lists

FEATURE_RAW = T.StructType([
    T.StructField("type", T.StringType()),
    T.StructField("id", T.LongType()),
    T.StructField("properties", T.MapType(T.StringType(), T.StringType())),
    T.StructField("geometry", T.StructType([
        T.StructField("type", T.StringType()),
        T.StructField("coordinates", T.StringType()),  # kept as JSON text; depth depends on the type
    ])),
])
MULTI = T.ArrayType(T.ArrayType(T.ArrayType(T.ArrayType(T.DoubleType()))))
SINGLE = T.ArrayType(T.ArrayType(T.ArrayType(T.DoubleType())))


def tiles_from_coordinates(df: DataFrame, strict: bool = True) -> DataFrame:
    """Coordinate rows ``(first_tile, positions, uvs)`` -> one row per tile
    (tile id = ordinal in the file).  ``positions`` must hold xyz triplets,
    ``uvs`` pairs, with equal vertex counts; a bad row fails the job in
    ``strict`` mode and is dropped otherwise.  A single-object file is one row
    with ``first_tile`` 0; large files come as many chunk rows."""
    first = F.col("first_tile") if "first_tile" in df.columns else F.lit(0).cast("bigint")
    npos, nuv = F.size("positions"), F.size("uvs")
    ok = ((npos % 3) == 0) & ((nuv % 2) == 0) & ((npos / 3) == (nuv / 2))
    checked = df.withColumn("_ok", ok)
    if strict:
        checked = checked.withColumn("_ok", F.when(F.col("_ok"), F.lit(True)).otherwise(
            F.raise_error(F.lit("coordinates: positions/uvs lengths do not match")).cast("boolean")))
    rows = checked.filter(F.col("_ok")).select(
        first.alias("_first"), "positions", "uvs",
        F.explode(F.sequence(F.lit(0), (npos / 3).cast("int") - 1)).alias("i"))
    rows = rows.filter(F.size("positions") > 0)
    p, uv, i = F.col("positions"), F.col("uvs"), F.col("i")
    return rows.select(
        (F.col("_first") + i).cast("bigint").alias("tile_id"),
        F.element_at(p, i * 3 + 1).alias("x"), F.element_at(p, i * 3 + 2).alias("y"), F.element_at(p, i * 3 + 3).alias("z"),
        F.element_at(uv, i * 2 + 1).alias("u"), F.element_at(uv, i * 2 + 2).alias("v"))


def read_coordinates(spark, path: str) -> DataFrame:
    """Coordinate rows of JSON lines, one chunk of tiles a line."""
    return spark.read.schema(schemas.COORDINATES).json(path)


def tiles_from_document(spark, path: str, strict: bool = True) -> DataFrame:
    """One document ``{"positions": [...], "uvs": [...]}``, however large and on however few lines, read in many tasks ->
    one row per tile (tile id = ordinal).  Lengths that don't match fail the job in ``strict`` mode; otherwise only tiles
    with all five numbers are kept."""
    numbers = flat_numbers(spark, path).filter(F.col("key").isin("positions", "uvs"))
    per = F.when(F.col("key") == "positions", 3).otherwise(2)
    rows = numbers.select(F.floor(F.col("i") / per).cast("bigint").alias("tile_id"), "key", (F.col("i") % per).alias("axis"), "number")
    pick = {"x": ("positions", 0), "y": ("positions", 1), "z": ("positions", 2), "u": ("uvs", 0), "v": ("uvs", 1)}
    tiles = rows.groupBy("tile_id").agg(*[F.max(F.when((F.col("key") == k) & (F.col("axis") == a), F.col("number"))).alias(n) for n, (k, a) in pick.items()])
    whole = F.col("x").isNotNull()
    for n in ("y", "z", "u", "v"):
        whole = whole & F.col(n).isNotNull()
    if strict:  # a tile that lacks a number tells that the lengths don't match
        whole = F.when(whole, F.lit(True)).otherwise(F.raise_error(F.lit("coordinates: positions/uvs lengths do not match")).cast("boolean"))
    return tiles.filter(whole)


def country_polygons(features: DataFrame, value_col: str = "value", kinds: tuple[str, ...] = ("MultiPolygon",),
                     min_vertices: int = 3) -> DataFrame:
    """GeoJSON features (one JSON text per row) -> one row per ring.

    Parity default keeps ``MultiPolygon`` features only; ``kinds`` may add
    ``Polygon``.  Code from ``ISO_A2``, name from ``ADMIN`` (fixed values),
    missing -> "".  ``feature_id`` is the file's id (or a hash of the text) and
    may repeat; ``feature_row`` is unique to each feature row.
    Parts and holes are flattened into one ring list; rings with fewer than
    ``min_vertices`` vertices are dropped (they can hold no point).
    """
    # Every feature row is a feature of its own.  Hashes are counted; only the texts whose hash repeats are numbered.
    texts = features.select(F.col(value_col).alias("v"), F.xxhash64(value_col).alias("_text_id"))
    again = texts.groupBy("_text_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("_text_id")
    number = F.row_number().over(Window.partitionBy("_text_id").orderBy(F.lit(0)))
    f = (texts.join(again, "_text_id", "left_anti").withColumn("feature_row", F.col("_text_id"))
         .unionByName(texts.join(again, "_text_id", "left_semi").withColumn("feature_row", F.xxhash64("v", number)))
         .select(F.from_json("v", FEATURE_RAW).alias("f"), "_text_id", "feature_row").select("f.*", "_text_id", "feature_row"))
    gtype = F.col("geometry.type")
    f = f.filter(gtype.isin(*kinds))
    coords = F.when(gtype == "MultiPolygon", F.from_json(F.col("geometry.coordinates"), MULTI)) \
        .otherwise(F.array(F.from_json(F.col("geometry.coordinates"), SINGLE)))
    # Features without an "id" are keyed by a hash of their text (deterministic, unlike a row counter).
    fid = F.coalesce(F.col("id"), F.col("_text_id"))
    rings = f.select(
        fid.alias("feature_id"), "feature_row",
        F.coalesce(F.col("properties")["ISO_A2"], F.lit("")).alias("country_code"),
        F.coalesce(F.col("properties")["ADMIN"], F.lit("")).alias("name"),
        F.posexplode(F.flatten(coords)).alias("ring_id", "ring"))
    pts = F.transform("ring", lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))
    return (rings.select("feature_id", "feature_row", "country_code", "name", F.col("ring_id").cast("int"), pts.alias("ring"))
            .filter(F.size("ring") >= min_vertices))


def read_features(spark, path: str, collection: bool = False) -> DataFrame:
    """GeoJSON features as one JSON text per row (``value``), the input of
    ``country_polygons``.  JSON-lines files (one feature per line) split across
    tasks, and so does a single ``FeatureCollection`` document
    (``collection=True``): its objects are cut out by byte ranges."""
    if not collection:
        return spark.read.text(path)
    found = objects_in_lists(spark, path).select("value")
    return found.filter(F.get_json_object("value", "$.type") == "Feature")
