"""SimHash near-duplicates by tiled exact comparison.

Fingerprints are exact 64-bit SimHashes of word shingles.  Distinct
fingerprints are dealt to tiles by the population counts of their four 16-bit
quarters; the sum of the four differences is a lower bound of the bit distance,
so tile pairs beyond the radius are skipped without looking inside.  The others
are compared in full with numpy exclusive-or and bit counts.  Large tiles are
cut by a hash of the fingerprint, so no task holds more than two small tiles at
a time, and a task emits a spanning set of the links it finds, never all pairs
of a group.  Equal fingerprints are one fingerprint, so a group of copies costs
one row.

Results: an empty or null text has fingerprint zero, linked like any other; a
text of fewer words than a shingle is one shingle; repeated rows and repeated
ids give a row each; a null id gives a row and never names a component unless
all ids of its component are null; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terrastate.functions.names import free_name
from terrastate.llm.common import materialize, text_rows
from terrastate.llm.components import components

SEED = 42
TILE = 1024


def word_spans(data: bytes) -> tuple[bytes, list[int], list[int]]:
    """ASCII-lower-cased words joined by one space, with each word's start and end."""
    words = data.lower().split()
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    return b" ".join(words), (ends - lengths).tolist(), ends.tolist()


def simhash(text: str, shingle: int = 3) -> int:
    """Unsigned SimHash: a bit is 1 if set in over half the shingle hashes."""
    joined, starts, ends = word_spans(text.encode("utf-8", "surrogatepass"))
    if not starts:
        return 0
    h, last = xxhash.xxh64_intdigest, ends[shingle - 1:] or ends[-1:]
    hashes = np.array([h(joined[s:e], SEED) for s, e in zip(starts, last)], np.uint64)
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65_536):
        bits = np.unpackbits(hashes[at:at + 65_536].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int64)
    ones = np.flatnonzero(2 * total > len(hashes))
    return int(np.bitwise_or.reduce(np.uint64(1) << ones.astype(np.uint64))) if len(ones) else 0


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, row_key (a hash of id and text), fp (the fingerprint's bits as a signed long) of each row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([simhash(t, shingle) for t in b.column("text").to_pylist()], np.uint64)
            yield pa.record_batch([b.column("doc_id"), b.column("row_key"), pa.array(fps.view(np.int64))], ["doc_id", "row_key", "fp"])

    rows = text_rows(docs).withColumn("row_key", F.xxhash64("doc_id", "text"))
    return rows.mapInArrow(run, "doc_id long, row_key long, fp long")


def spanning_links(a: np.ndarray, b: np.ndarray, radius: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Links between two tiles (or within one) at most ``radius`` bits apart;
    where they are many, a star for each linked group in place of all of them."""
    near = np.bitwise_count(a[:, None] ^ b[None, :]) <= radius
    if same:
        near &= np.tri(len(a), k=-1, dtype=bool)
    i, j = np.nonzero(near)
    if len(i) <= len(a) + len(b):
        return a[i], b[j]
    # least label of each group of the bipartite graph of rows and columns
    j = j if same else j + len(a)
    label = np.arange(len(a) if same else len(a) + len(b))
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    node = a if same else np.concatenate([a, b])
    out = np.flatnonzero(label != np.arange(len(label)))
    return node[out], node[label[out]]


def quarter_counts(column: str):
    return [F.bit_count(F.shiftrightunsigned(F.col(column), 16 * k).bitwiseAND(F.lit(0xFFFF).cast("long"))).cast("int") for k in range(4)]


def forward_offsets(radius: int) -> list[tuple[int, int, int, int]]:
    """Quarter differences within the radius; of each and its opposite one, so that a pair of tiles meets once."""
    near = (d for d in product(range(-radius, radius + 1), repeat=4) if sum(map(abs, d)) <= radius)
    return [d for d in near if d >= (0, 0, 0, 0)]


def fingerprint_links(spark: SparkSession, distinct: DataFrame, radius: int = 3, tile: int = TILE, partners: int = 512) -> DataFrame:
    """Spanning links (a, b) of the fingerprints in ``distinct`` (column fp, no repeats).

    ``partners``: about how many tiles one join key holds against a tile."""
    keys = [f"q{k}" for k in range(4)]
    parts = distinct.select("fp", *[q.alias(k) for k, q in zip(keys, quarter_counts("fp"))])
    sizes = parts.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / tile).alias("cuts"))  # 17^4 rows at most
    cut = parts.join(sizes, keys).withColumn("cut", F.pmod(F.xxhash64("fp"), F.col("cuts")))
    tiles = materialize(spark, cut.groupBy(*keys, "cut").agg(F.collect_list("fp").alias("fps")), "tiles")

    # which cells meet, without their fingerprints: cells and cuts only
    cells = materialize(spark, tiles.groupBy(*keys).agg(F.max("cut").alias("last")), "cells")
    offsets = F.array(*[F.struct(*[F.lit(x).alias(f"d{k}") for k, x in enumerate(d)]) for d in forward_offsets(radius)])
    left = (cells.select(F.explode(offsets).alias("d"), *[F.col(k).alias(f"a{k}") for k in keys], F.col("last").alias("last_a"))
            .select("*", *[(F.col(f"aq{k}") + F.col(f"d.d{k}")).alias(f"q{k}") for k in range(4)],
                    F.expr("d.d0 = 0 AND d.d1 = 0 AND d.d2 = 0 AND d.d3 = 0").alias("own")).drop("d"))
    met = materialize(spark, left.join(cells.withColumnRenamed("last", "last_b"), keys), "cell-pairs")
    # tiles that a tile meets lie in as many groups as keep each bounded, and every group has a copy of the tile
    groups = met.groupBy(*keys).agg(F.ceil(F.sum(F.col("last_a") + 1) / partners).alias("groups"))
    met = met.join(groups, keys).select("*", F.explode(F.sequence(F.lit(0).cast("long"), "last_a")).alias("cut_a"))
    met = met.select("*", F.explode(F.sequence(F.when(F.col("own"), F.col("cut_a")).otherwise(0), "last_b")).alias("cut"))
    met = met.withColumn("group", F.pmod(F.xxhash64(*[f"aq{k}" for k in range(4)], "cut_a"), F.col("groups")))
    first = tiles.select(*[F.col(k).alias(f"a{k}") for k in keys], F.col("cut").alias("cut_a"), F.col("fps").alias("a"))
    second = tiles.join(groups, keys).select(*keys, "cut", F.col("fps").alias("b"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1)).alias("group"))
    # by merge, never by broadcast: the sides with fingerprints are many times what the planner expects
    pairs = (met.hint("merge").join(first, [*[f"aq{k}" for k in range(4)], "cut_a"]).hint("merge").join(second, [*keys, "cut", "group"])
             .select("a", "b", F.expr("own AND cut_a = cut").alias("same")))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            arrays, bounds = [], []
            for name in ("a", "b"):
                col = batch.column(name)
                offs = col.offsets.to_numpy()
                arrays.append(col.values.to_numpy(zero_copy_only=False).view(np.uint64))
                bounds.append(offs.tolist())
            left, right = [], []
            for r, same in enumerate(batch.column("same").to_pylist()):
                x, y = spanning_links(arrays[0][bounds[0][r]:bounds[0][r + 1]], arrays[1][bounds[1][r]:bounds[1][r + 1]], radius, same)
                if len(x):
                    left.append(x)
                    right.append(y)
            if left:
                yield pa.record_batch([pa.array(np.concatenate(x).view(np.int64)) for x in (left, right)], ["a", "b"])

    return pairs.mapInArrow(compare, "a long, b long")


def simhash_components(spark: SparkSession, docs: DataFrame, shingle: int = 3, radius: int = 3) -> DataFrame:
    """doc_id, row_key, fp, root (the component's least fingerprint), component_id
    (smallest doc_id reachable by links of at most ``radius`` bits) of each row."""
    fps = materialize(spark, fingerprints(docs, shingle), "simhash")
    least = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(spark, fingerprint_links(spark, fps.select("fp").distinct(), radius))
    named = (least.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
             .select("fp", "least", F.coalesce("root", "fp").alias("root")))
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = named.select("fp", "root").join(ids, "root").select("fp", "root", "component_id")
    return fps.join(classes, "fp").select("doc_id", "row_key", "fp", "root", "component_id")


def keep_one_of_each(spark: SparkSession, docs: DataFrame, shingle: int = 3, radius: int = 3) -> DataFrame:
    """One row of each component, with all columns of ``docs``: the one of smallest doc_id, of repeated rows any.  Helper
    columns take names that no column has."""
    found = simhash_components(spark, docs, shingle, radius)
    first = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "row_key")).alias("f"))
    key, text, number = free_name(docs, "row_key"), F.coalesce(F.col("text").cast("string"), F.lit("")), free_name(docs, "number")
    keyed = docs.withColumn(key, F.xxhash64(F.col("doc_id").cast("long"), text))
    kept = keyed.join(first.select(F.col("f.row_key").alias(key)), key, "left_semi")
    # rows of equal id and text are copies of one row; the hash alone may be that of another row, which stays too
    copies = Window.partitionBy(key, F.col("doc_id"), F.sha2(text, 256)).orderBy(key)
    return kept.withColumn(number, F.row_number().over(copies)).filter(F.col(number) == 1).select(*docs.columns)


def hex_fingerprint(fp):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
