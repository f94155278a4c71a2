"""Explicit schemas of every record type (never inferred)."""

from pyspark.sql import types as T

# A click: the event of the log.  ``arrival_ns`` + ``click_id`` give the arrival
# order (the order a single consumer would have applied the clicks in).
CLICK = T.StructType([
    T.StructField("tile_id", T.LongType(), False),
    T.StructField("country_id", T.StringType(), False),
    T.StructField("timestamp_ns", T.LongType(), False),
    T.StructField("click_id", T.StringType(), False),
    T.StructField("arrival_ns", T.LongType(), True),
])

# Coordinates file: flat xyz triplets and uv pairs.  ``first_tile`` lets one
# file be split into many rows (chunks), so no single row has to hold the globe.
COORDINATES = T.StructType([
    T.StructField("first_tile", T.LongType()),
    T.StructField("positions", T.ArrayType(T.DoubleType())),
    T.StructField("uvs", T.ArrayType(T.DoubleType())),
])

OSM_NODE = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("lat", T.DoubleType(), False),
    T.StructField("lon", T.DoubleType(), False),
    T.StructField("tags", T.MapType(T.StringType(), T.StringType()), False),
    T.StructField("dense", T.BooleanType(), False),
    T.StructField("block_id", T.LongType(), False),
])

OSM_WAY = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("refs", T.ArrayType(T.LongType()), False),
    T.StructField("tags", T.MapType(T.StringType(), T.StringType()), False),
    T.StructField("block_id", T.LongType(), False),
])

OSM_RELATION = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("tags", T.MapType(T.StringType(), T.StringType()), False),
    T.StructField("block_id", T.LongType(), False),
])
