"""One big JSON document read in many tasks.

The text source cuts a file by byte ranges at any one-byte separator, so a
document on a single line splits as well: at the commas of a flat array of
numbers, at the closing braces of a list of objects.  A task finds its own start
there; what it can't know, because it depends on all text before, is settled by
a summary of one row per byte range: how many numbers stand before it, whether
it begins inside a string (both cases are counted) and how deeply nested.
Everything is built-in expressions; windows run within a byte range, and over the
summaries of a file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

RANGE = ("file", "range")


def _pieces(spark: SparkSession, path: str, separator: str) -> DataFrame:
    """(file, range, text): the text between separators; ``range`` is the first byte of the range it was read with."""
    return spark.read.option("lineSep", separator).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("range"), F.col("value").alias("text"))


def _earlier(keys=("file",), order: str = "range"):
    return Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)


def _same_range(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b, list(RANGE))


def flat_numbers(spark: SparkSession, path: str) -> DataFrame:
    """(file, key, i, number): the numbers of an object of flat arrays, each with its key and place in its array."""
    pieces = _pieces(spark, path, ",")
    number = F.regexp_extract("text", r"(-?[0-9][-+.0-9eE]*)[\s\]}]*\z", 1).try_cast("double")
    key = F.regexp_extract("text", r'"([^"]*)"\s*:\s*\[', 1)
    # numbered after the filter, in the scan's own order: consecutive within a range
    rows = (pieces.select(*RANGE, number.alias("number"), F.when(key != "", key).alias("key")).filter("number IS NOT NULL")
            .withColumn("id", F.monotonically_increasing_id()))
    ranges = rows.groupBy(*RANGE).agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    ranges = ranges.withColumn("before", F.coalesce(F.sum("n").over(_earlier()), F.lit(0))).drop("n")
    placed = _same_range(rows, ranges).select("file", "key", "number", (F.col("before") + F.col("id") - F.col("first")).alias("at"))
    # an object has few keys: the places where their arrays begin are one short list a file
    begins = placed.filter("key IS NOT NULL").groupBy("file").agg(F.array_sort(F.collect_list(F.struct("at", "key"))).alias("begins"))
    mine = F.element_at(F.filter("begins", lambda b: b["at"] <= F.col("at")), -1)
    return placed.drop("key").join(begins, "file").select("file", mine["key"].alias("key"), (F.col("at") - mine["at"]).alias("i"), "number")


def _count(text: Column, char: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))


def objects_in_lists(spark: SparkSession, path: str) -> DataFrame:
    """(file, value): the text of every object that lies directly in the document's top object or in a list of it."""
    ended = r'"[^"]*(?:"|\z)'  # a string, or the beginning of one
    plain = F.regexp_replace("text", r"(?s)\\.", "")  # without escaped characters
    outside, inside = F.regexp_replace(plain, ended, ""), F.regexp_replace(F.regexp_replace(plain, r'\A[^"]*(?:"|\z)', ""), ended, "")
    rows = _pieces(spark, path, "}").withColumn("id", F.monotonically_increasing_id()).select(
        *RANGE, "id", "text", (_count(plain, '"') % 2).alias("flips"), _count(outside, "{").alias("opens0"), _count(inside, "{").alias("opens1"))

    # whether each piece begins inside a string (if its range does not), and how the depth changes up to its brace, in either case
    here = _earlier(RANGE, "id")
    rows = rows.withColumn("turned", F.coalesce(F.sum("flips").over(here), F.lit(0)) % 2)
    for h in (0, 1):
        starts = (F.col("turned") + h) % 2
        closes = F.when((starts + F.col("flips")) % 2 == 0, 1).otherwise(0)  # a brace in a string closes nothing
        rows = rows.withColumn(f"closes{h}", closes).withColumn(f"step{h}", F.when(starts == 0, F.col("opens0")).otherwise(F.col("opens1")) - closes)
    ranges = rows.groupBy(*RANGE).agg(*[F.sum(c).alias(c) for c in ("flips", "step0", "step1")])
    ranges = ranges.withColumn("begins", F.coalesce(F.sum("flips").over(_earlier()), F.lit(0)) % 2)
    ranges = ranges.withColumn("step", F.when(F.col("begins") == 0, F.col("step0")).otherwise(F.col("step1")))
    ranges = ranges.withColumn("depth", F.coalesce(F.sum("step").over(_earlier()), F.lit(0)))
    rows = _same_range(rows.drop("flips", "opens0", "opens1"), ranges.select(*RANGE, "begins", F.col("depth").alias("above")))
    for c in ("step", "closes"):
        rows = rows.withColumn(c, F.when(F.col("begins") == 0, F.col(f"{c}0")).otherwise(F.col(f"{c}1")))

    # depth behind each piece's brace; an object ends with a brace that leads back to 1
    upto = Window.partitionBy(*RANGE).orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("depth", F.col("above") + F.sum("step").over(upto))
    ends = (F.col("depth") == 1) & (F.col("closes") == 1)
    rows = rows.withColumn("ends", ends.cast("int")).select(*RANGE, "id", "text", "ends")
    rows = rows.withColumn("done", F.coalesce(F.sum("ends").over(here), F.lit(0)))
    counts = rows.groupBy(*RANGE).agg(F.sum("ends").alias("n")).withColumn("earlier", F.coalesce(F.sum("n").over(_earlier()), F.lit(0))).drop("n")
    rows = _same_range(rows, counts).withColumn("number", F.col("done") + F.col("earlier"))

    # the pieces of one object, with their braces, from any number of ranges
    found = rows.groupBy("file", "number").agg(F.max("ends").alias("whole"), F.array_sort(F.collect_list(F.struct("range", "id", "text"))).alias("parts"))
    text = F.concat(F.array_join(F.transform("parts", lambda p: p["text"]), "}"), F.lit("}"))
    ahead = r'\A(?:[^"{]++|"(?:[^"\\]++|\\.)*+")*+'  # what stands before a brace, strings as wholes
    text = F.when(F.col("number") == 0, F.regexp_replace(text, ahead + r"\{", "")).otherwise(text)
    return found.filter("whole = 1").select("file", F.regexp_replace(text, ahead, "").alias("value"))
