"""Document fingerprints by order MinHash.

DataFrame functions only.  A text's k-mers are runs of ``k`` words (a shorter
text is one k-mer); each is numbered by its occurrence, so a repeated k-mer is
several items.  Items are hashed and dealt by their hash to ``sketches`` bins;
in each bin the ``order`` items of least hash are taken in text order and hashed
together.  Two texts agree in a bin if they share its least items and have them
in the same order, so likeness falls with moved passages as with changed ones.

Words are what stands between spaces, line feeds and tabs.  All steps are linear
in the text but two sorts of its items.

Results: equal texts have equal fingerprints and likeness 1; an empty or null
text has only empty bins, alike only to another such text; texts are compared
in the bins that either fills; repeated rows and null ids get a row each; an
empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terrastate.llm.common import partitions_for, text_rows

SKETCHES, ORDER, K = 32, 2, 2
DIGITS = 8  # hex digits of a bin
EMPTY = "0" * DIGITS
#: A packed item: bin (5 bits), 28 bits of hash, 30 bits of place (no string holds more words).
PLACE_BITS, HASH_BITS = 30, 28
NULL_RANGES = 1024  # ranges of the rows without id


def add_fingerprint(rows: DataFrame, text: str, out: str) -> DataFrame:
    """``rows`` with the fingerprint of column ``text`` in column ``out``.

    One step a column, so that no array is computed twice.
    """
    keep = [F.col(c) for c in rows.columns]
    low = (1 << PLACE_BITS) - 1

    def step(df: DataFrame, value: Column, *held: str) -> DataFrame:
        return df.select(*keep, *held, value.alias("_x"))

    words = F.split(F.replace(F.replace(F.col(text), F.lit("\n"), F.lit(" ")), F.lit("\t"), F.lit(" ")), " ")
    df = step(rows, F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w)))
    # hash of each k-mer above its place
    shifted = F.col("_x")
    for j in range(1, K):
        shifted = F.zip_with(shifted, F.slice("_x", j + 1, F.greatest(F.size("_x"), F.lit(1))), lambda a, b: F.xxhash64(a, b))
    grams = F.slice(shifted, 1, F.greatest(F.size("_x") - (K - 1), F.lit(1)))
    df = step(df, F.sort_array(F.transform(grams, lambda h, i: F.shiftleft(F.shiftrightunsigned(h, PLACE_BITS), PLACE_BITS).bitwiseOR(
        i.cast("long").bitwiseAND(F.lit(low))))))
    # sorted by hash, equal k-mers are runs in text order: number them
    starts = F.filter(F.sequence(F.lit(0), F.greatest(F.size("_x") - 1, F.lit(0))), lambda j: (F.size("_x") > 0) & (
        (j == 0) | (F.shiftrightunsigned(F.get("_x", j), PLACE_BITS) != F.shiftrightunsigned(F.get("_x", j - 1), PLACE_BITS))))
    df = df.select(*keep, "_x", starts.alias("_s"))
    numbers = F.flatten(F.transform("_s", lambda s, r: F.sequence(F.lit(1), F.coalesce(F.get("_s", r + 1), F.size("_x")) - s)))
    df = step(df, F.zip_with("_x", numbers, lambda x, o: F.shiftleft(F.shiftrightunsigned(F.xxhash64(
        F.shiftrightunsigned(x, PLACE_BITS), o), 64 - 5 - HASH_BITS), PLACE_BITS).bitwiseOR(x.bitwiseAND(F.lit(low)))))
    df = step(df, F.sort_array("_x"))
    # the first items of each bin
    bins = lambda x: F.shiftrightunsigned(x, PLACE_BITS + HASH_BITS)
    heads = F.filter(F.sequence(F.lit(0), F.greatest(F.size("_x") - 1, F.lit(0))), lambda j: (F.size("_x") > 0) & (
        (j == 0) | (bins(F.get("_x", j)) != bins(F.get("_x", j - 1)))))
    df = df.select(*keep, "_x", heads.alias("_s"))

    def signature(j: Column) -> Column:
        first, second = F.get("_x", j), F.get("_x", j + 1)
        second = F.when(bins(second) == bins(first), second)
        item = lambda x: F.shiftrightunsigned(x, PLACE_BITS)
        forward = second.isNull() | (first.bitwiseAND(F.lit(low)) < second.bitwiseAND(F.lit(low)))
        both = F.when(forward, F.xxhash64(item(first), item(second))).otherwise(F.xxhash64(item(second), item(first)))
        return F.struct(bins(first).cast("int").alias("bin"), F.right(F.lpad(F.lower(F.hex(both)), 16, "0"), F.lit(DIGITS)).alias("sig"))

    # each column is used twice or more outside of lambdas, or the optimizer would move its computation into one
    df = step(df, F.transform("_s", signature))
    empty = F.transform(F.array_except(F.sequence(F.lit(0), F.lit(SKETCHES - 1)), F.col("_x.bin")),
                        lambda b: F.struct(b.alias("bin"), F.lit(EMPTY).alias("sig")))
    return df.select(*keep, F.array_join(F.array_sort(F.concat("_x", empty))["sig"], "").alias(out))


def likeness(a: str, b: str) -> Column:
    """Share of the bins that either fingerprint fills in which they agree; 1 for equal ones."""
    part = lambda c, i: F.substr(F.col(c), i * DIGITS + 1, F.lit(DIGITS))
    bins = F.sequence(F.lit(0), F.lit(SKETCHES - 1))
    same = F.size(F.filter(bins, lambda i: (part(a, i) == part(b, i)) & (part(a, i) != EMPTY)))
    filled = F.size(F.filter(bins, lambda i: (part(a, i) != EMPTY) | (part(b, i) != EMPTY)))
    return F.when(F.col(a) == F.col(b), 1.0).otherwise(same / F.greatest(filled, F.lit(1)))


def with_next(spark: SparkSession, docs: DataFrame, per_task: int = 2_000, most_ranges: int = 1_000) -> DataFrame:
    """doc_id, text, fingerprint of each document and next_text, next_fingerprint
    of the one after it in order of descending doc_id (nulls last, ties by
    text); the first follows the last.

    Quantiles of the ids cut the order into at most ``most_ranges`` ranges, the
    hash of the text those without id; each is a window of its own, which is the
    only shuffle of the texts.  The last
    row of a range takes the first of the range after it: those heads (one a
    range) are found by id and read again.
    """
    rows = text_rows(docs)
    parts = min(most_ranges, partitions_for(spark, rows.count(), per_task))
    cuts = rows.select(F.percentile_approx("doc_id", [k / parts for k in range(1, parts)] or [0.5], 10_000).alias("c")).first().c or []
    cuts = sorted(set(cuts))
    ends = F.array(*[F.lit(int(c)).cast("long") for c in cuts]) if cuts else F.array().cast("array<bigint>")
    # range 0 has the largest ids; nulls come after all others, cut by the hash that orders them
    by_hash = F.shiftright(F.xxhash64("text"), 54).cast("int") + NULL_RANGES // 2
    range_of = F.when(F.col("doc_id").isNull(), F.lit(len(cuts) + 1) + by_hash).otherwise(
        F.lit(len(cuts)) - F.size(F.filter(ends, lambda c: c <= F.col("doc_id")))).alias("_r")

    first = F.min(F.struct(F.bitwise_not("doc_id").alias("d"), F.xxhash64("text").alias("h"))).alias("f")
    heads = rows.groupBy(range_of).agg(first).select("_r", F.col("f.d").alias("_d"), F.col("f.h").alias("_h")).orderBy("_r").collect()
    before = [heads[i - 1]._r for i in range(len(heads))]
    found = spark.createDataFrame([(b, h._d, h._h) for b, h in zip(before, heads)], "_r int, _d long, _h long")
    texts = (rows.join(F.broadcast(found), F.bitwise_not("doc_id").eqNullSafe(F.col("_d")) & (F.xxhash64("text") == F.col("_h")))
             .select("_r", "text").dropDuplicates(["_r"]))
    after = add_fingerprint(texts, "text", "fingerprint").select("_r", F.struct("text", "fingerprint").alias("_h"))

    here = Window.partitionBy("_r").orderBy(F.desc_nulls_last("doc_id"), F.xxhash64("text"), "text")
    led = add_fingerprint(rows, "text", "fingerprint").select("*", range_of).withColumn("_n", F.lead(F.struct("text", "fingerprint")).over(here))
    nxt = F.coalesce("_n", "_h")
    return led.join(after, "_r").select("doc_id", "text", "fingerprint", nxt["text"].alias("next_text"), nxt["fingerprint"].alias("next_fingerprint"))


def order_minhash(docs: DataFrame) -> DataFrame:
    """doc_id, text, fingerprint of each row."""
    return add_fingerprint(text_rows(docs), "text", "fingerprint")


def edited_fingerprints(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited text: the last half of its
    code points gives way to as many of the next document's first."""
    rows = with_next(spark, docs)
    half = F.floor(F.char_length("text") / 2).cast("int")
    edited = rows.withColumn("n_chars", F.char_length("text").cast("long")).withColumn(
        "edited", F.concat(F.left(F.col("text"), F.char_length("text") - half), F.left(F.col("next_text"), half)))
    return add_fingerprint(edited.select("doc_id", "n_chars", "edited", "fingerprint", "next_fingerprint"), "edited", "edited_fingerprint")
