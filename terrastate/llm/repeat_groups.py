"""All maximal repeats of a corpus with all their occurrences.

A maximal repeat is a string of at least ``window`` bytes that stands in two or
more places (of any documents), whose occurrences neither all have the same byte
before them nor all the same byte behind them; a document's start and end differ
from everything.

``repeats`` finds the windows that occur again, a shard tells which of them also
have different bytes before them: there the repeats begin.  From each such place
a suffix runs to the end of the repeated windows, beyond which no two places
agree.  Suffixes are dealt by their first window, so all occurrences of a repeat
meet; equal ones are one row with a count.  Their sorted order with the
common-prefix lengths of neighbours is an enhanced suffix array, whose
common-prefix interval tree is scanned with a stack: a node's string stands in
all suffixes below it, and is a maximal repeat if what stands before them
differs.

Results: a row for each repeat and occurrence; null and empty texts have none;
repeated rows and null ids are places of their own; empty tables give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrastate.llm import repeats as R
from terrastate.llm.common import materialize
from terrastate.llm.suffix_dedup import GRAM, WINDOW, intervals

START = 256  # before a document
SENT = "shard int, chunk long, n int, head binary, units binary"
FLAGS = "chunk long, shard int, flags binary"
SUFFIXES = "key long, suffix binary, left int, doc_id long, offset long"
NODES = "key long, suffix_sha string, left int, repeat string, length long"


def left_bytes(u: R.Units, at: np.ndarray) -> np.ndarray:
    """The byte before each place, or ``START``."""
    raw = np.frombuffer(u.data, np.uint8)
    first = np.isin(at, u.starts)
    return np.where(first, START, raw[np.maximum(at - 1, 0)].astype(np.int64))


def distinct(u: R.Units, c: R.Contexts, window: int, shards: int):
    """Contexts with the byte before them, each kind once in order of shard: (order of kinds, kind of each context, texts, places)."""
    left, shard = left_bytes(u, c.first), R.shard_of(c.anchor, shards)
    found: dict[tuple, int] = {}
    kind, order, places = np.empty(len(c.first), np.int64), [], []
    for i in np.argsort(shard, kind="stable").tolist():
        a = int(c.first[i])
        k = found.setdefault((int(left[i]), u.data[a:a + int(c.count[i]) + window - 1]), len(order))
        if k == len(order):
            order.append(i)
            places.append(0)
        kind[i] = k
        places[k] += 1
    return np.array(order, np.int64), kind, [t for _, t in found], np.array(places, np.int64)


def send(p: R.Prepared) -> DataFrame:
    units, window, gram, shards = p.units, p.window, p.gram, p.shards

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                u = units(r["ids"], r["lengths"], r["z"])
                c = R.candidate_contexts(u, window, gram, shards, R.marks_of(r))
                order, _, texts, places = distinct(u, c, window, shards)
                shard, left = R.shard_of(c.anchor, shards)[order], left_bytes(u, c.first)[order]
                rows, cuts = [], np.flatnonzero(np.diff(shard, prepend=-1)).tolist()
                for lo, hi in zip(cuts, [*cuts[1:], len(order)]):
                    head = R.pack(left[lo:hi], np.minimum(places[lo:hi], 2), np.fromiter(map(len, texts[lo:hi]), np.int64, hi - lo))
                    rows.append((int(shard[lo]), r["chunk"], hi - lo, head, b"".join(texts[lo:hi])))
                yield pa.record_batch([pa.array(x, t) for x, t in zip(list(zip(*rows)) or [()] * 5, (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary()))],
                                      ["shard", "chunk", "n", "head", "units"])

    return p.chunks.select("chunk", "ids", "lengths", "z").join(p.marks, "chunk", "left").mapInArrow(run, SENT)


def judge(window: int):
    """Two bits of each window of each context: whether it stands elsewhere too, and after different bytes."""
    def meet(rows: pa.Table) -> pa.Table:
        n = rows.column("n").to_pylist()
        left, places, sizes = (np.concatenate(x) for x in zip(*[R.unpack(h, *[(np.int64, k)] * 3) for k, h in zip(n, rows.column("head").to_pylist())]))
        raw = np.frombuffer(b"".join(rows.column("units").to_pylist()), np.uint8)
        begin = np.cumsum(sizes) - sizes
        counts = sizes - window + 1
        owner = np.repeat(np.arange(len(sizes)), counts)
        at = begin[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
        with np.errstate(over="ignore"):
            hashes = R.gram_hashes(R.BYTE_CODE[raw], window)[at]
        before = np.where(at == begin[owner], left[owner], raw[np.maximum(at - 1, 0)])
        _, kind = np.unique(hashes, return_inverse=True)
        total = np.bincount(kind, weights=places[owner])
        low, high = np.full(len(total), START + 1), np.full(len(total), -1)
        np.minimum.at(low, kind, before)
        np.maximum.at(high, kind, before)
        again, differ = total[kind] > 1, (low != high)[kind] | (high == START)[kind]
        flags = np.zeros((2, len(sizes)), np.uint64)
        for row, bits in ((0, again), (1, again & differ)):
            place = (at - begin[owner]).astype(np.uint64)
            np.bitwise_or.at(flags[row], owner[bits], np.uint64(1) << place[bits])
        ends = np.cumsum(n).tolist()
        out = [R.pack(flags[0, hi - k:hi], flags[1, hi - k:hi]) for k, hi in zip(n, ends)]
        return pa.table({"chunk": rows.column("chunk"), "shard": rows.column("shard"), "flags": pa.array(out, pa.binary())})
    return meet


def suffixes(u: R.Units, row: dict, p_window: int, gram: int, shards: int) -> Iterator[tuple]:
    """(key, suffix, left, doc_id, offset) of each place of a chunk where a repeat begins."""
    c = R.candidate_contexts(u, p_window, gram, shards, R.marks_of(row))
    order, kind, _, _ = distinct(u, c, p_window, shards)
    if not len(order):
        return
    shard = R.shard_of(c.anchor, shards)[order]
    flags, by_shard = np.empty((2, len(order)), np.uint64), {f["shard"]: f["flags"] for f in row["flags"] or ()}
    cuts = np.flatnonzero(np.diff(shard, prepend=-1)).tolist()
    for lo, hi in zip(cuts, [*cuts[1:], len(order)]):
        flags[:, lo:hi] = R.unpack(by_shard[int(shard[lo])], (np.uint64, hi - lo), (np.uint64, hi - lo))
    bits = np.zeros((2, len(u.hashes) + 1), bool)
    for k in range(p_window - gram + 1):
        for f in (0, 1):
            bits[f, c.first[(c.count > k) & (flags[f][kind] >> np.uint64(k) & np.uint64(1) > 0)] + k] = True
    # the last repeated window of each run of them: runs end at documents, whose last windows are no windows
    stop = np.flatnonzero(bits[0] & ~np.append(bits[0][1:], False))
    at = np.flatnonzero(bits[1])
    past = stop[np.searchsorted(stop, at)] + p_window
    doc = np.searchsorted(u.starts, at, side="right") - 1
    with np.errstate(over="ignore"):
        keys = R.gram_hashes(u.hashes, p_window)[at].view(np.int64)
    for a, b, d, key, left in zip(at.tolist(), past.tolist(), doc.tolist(), keys.tolist(), left_bytes(u, at).tolist()):
        yield key, u.data[a:b], left, row["ids"][d], a - int(u.starts[d])


def tree_nodes(texts: list[bytes], left: list[int], places: list[int], window: int) -> Iterator[tuple[int, int, int]]:
    """(depth, first, past) over sorted suffixes of the nodes whose string is a maximal repeat."""
    lcp = [0]
    for a, b in zip(texts, texts[1:]):
        n = min(len(a), len(b))
        x, y = np.frombuffer(a, np.uint8, n), np.frombuffer(b, np.uint8, n)
        differ = np.flatnonzero(x != y)
        lcp.append(int(differ[0]) if len(differ) else n)
    whole = set()
    for depth, lo, hi in intervals(lcp, window):
        if len(set(left[lo:hi])) > 1 or left[lo] == START:
            yield depth, lo, hi
        whole.update(i for i in range(lo, hi) if len(texts[i]) == depth)
    for i, n in enumerate(places):  # documents that begin alike and are in no node of that length
        if n > 1 and left[i] == START and i not in whole:
            yield len(texts[i]), i, i + 1


def nodes(window: int):
    def meet(rows: pa.Table) -> pa.Table:
        r = sorted(zip(rows.column("suffix").to_pylist(), rows.column("left").to_pylist(), rows.column("places").to_pylist()))
        texts, left, places = [x[0] for x in r], [x[1] for x in r], [x[2] for x in r]
        key, out = rows.column("key")[0].as_py(), []
        named = [hashlib.sha256(t).hexdigest() for t in texts]
        for depth, lo, hi in tree_nodes(texts, left, places, window):
            name = hashlib.sha256(texts[lo][:depth]).hexdigest()
            out += [(key, named[i], left[i], name, depth) for i in range(lo, hi)]
        kinds = (pa.int64(), pa.string(), pa.int32(), pa.string(), pa.int64())
        return pa.table({n: pa.array(c, t) for n, c, t in zip([x.split()[0] for x in NODES.split(", ")], list(zip(*out)) or [()] * 5, kinds)})
    return meet


def repeat_groups(spark: SparkSession, docs: DataFrame, window: int = WINDOW, **sizes) -> DataFrame:
    """repeat (SHA-256 of its bytes), length, doc_id, offset (in bytes) of every occurrence of every maximal repeat."""
    gram = max(min(GRAM, window), window - 63)
    p = R.prepare(spark, docs, R.byte_units, window, gram, **sizes)
    flags = materialize(spark, send(p).groupBy("shard").applyInArrow(judge(window), FLAGS), "repeat-flags")
    ready = p.chunks.select("chunk", "ids", "lengths", "z").join(p.marks.join(R.by_chunk(flags, "flags"), "chunk", "full"), "chunk", "left")
    shards = p.shards

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.int64())
        for b in batches:
            for r in b.to_pylist():
                rows = list(suffixes(R.byte_units(r["ids"], r["lengths"], r["z"]), r, window, gram, shards))
                yield pa.record_batch([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 5, kinds)], [x.split()[0] for x in SUFFIXES.split(", ")])

    places = materialize(spark, ready.mapInArrow(run, SUFFIXES), "repeat-places")
    alike = places.groupBy("key", "suffix", "left").agg(F.count(F.lit(1)).alias("places"))
    found = alike.groupBy("key").applyInArrow(nodes(window), NODES)
    named = places.select("key", F.sha2("suffix", 256).alias("suffix_sha"), "left", "doc_id", "offset")
    return named.join(found, ["key", "suffix_sha", "left"]).select("repeat", "length", "doc_id", "offset")
