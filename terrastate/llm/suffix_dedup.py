"""Removal of long repeated byte strings by the common-prefix interval tree of an enhanced suffix array.

Candidate regions come from ``repeats``; each shard builds the suffix array of
its regions with the common-prefix lengths of neighbours, scans it with a stack
for the intervals of the common-prefix tree, and keeps those of at least
``window`` bytes whose occurrences have different bytes before them: the maximal
repeats, each with all its occurrences.  Every occurrence but those in the first
document that has the repeat is removed.

Results: a null or empty text has 0 bytes and nothing removed; documents with
the same id don't make each other's strings repeats; a null id counts as after
all others; repeated rows and null ids give a row each; an empty table no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from terrastate.llm import repeats as R

WINDOW, GRAM = 50, 16


@dataclass
class Repeat:
    """A maximal repeat: its length and its places (text, offset)."""

    length: int
    texts: np.ndarray
    offsets: np.ndarray


def common_prefixes(keys: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Bytes that each sorted suffix (a row of ``keys``) shares with the one before; the first shares none."""
    out = np.zeros(len(keys), np.int64)
    if len(keys) > 1:
        differ = keys[1:] != keys[:-1]
        full = ~differ.any(1)
        out[1:] = np.where(full, keys.shape[1], differ.argmax(1))
        out[1:] = np.minimum(out[1:], np.minimum(lengths[1:], lengths[:-1]))
    return out


def intervals(lcp: list[int], least: int) -> Iterator[tuple[int, int, int]]:
    """(depth, first, past the last) of each node of the common-prefix interval tree of at least ``least`` depth, children first."""
    stack: list[tuple[int, int]] = []
    for i, depth in enumerate([*lcp, 0]):
        start = i - 1
        while stack and stack[-1][0] > depth:
            d, start = stack.pop()
            yield d, start, i
        if depth >= least and (not stack or stack[-1][0] < depth):
            stack.append((depth, start))


def maximal_repeats(texts: list[bytes], copies: np.ndarray, counts: np.ndarray, window: int) -> Iterator[Repeat]:
    """Maximal repeats of at least ``window`` bytes among different texts with
    ``copies`` of each.  Suffixes start at the first ``counts`` offsets of a
    text; what stands before its first byte is not known, so it differs from all.
    """
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    flat = np.frombuffer(b"".join(texts), np.uint8)
    base = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(texts)), counts)
    offset = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    place = base[owner] + offset
    # a suffix takes part if its first bytes stand elsewhere too (by hash), or if it is a whole text with copies
    with np.errstate(over="ignore"):
        grams = R.gram_hashes(R.BYTE_CODE[flat], window)
    _, index, times = np.unique(grams[place], return_inverse=True, return_counts=True)
    take = (times[index] > 1) | ((offset == 0) & (copies[owner] > 1))
    owner, offset, place = owner[take], offset[take], place[take]
    if not len(owner):
        return
    left = sizes[owner] - offset
    width = int(left.max())
    padded = np.concatenate([flat, np.zeros(width, np.uint8)])
    suffixes = np.lib.stride_tricks.sliding_window_view(padded, width)
    for part in _parts(grams[place], width):
        o, f, n = owner[part], offset[part], left[part]
        keys = suffixes[place[part]]
        keys[np.arange(width) >= n[:, None]] = 0
        order = np.argsort(np.ascontiguousarray(keys).view(f"S{width}").ravel(), kind="stable")
        keys, o, f, n = keys[order], o[order], f[order], n[order]
        lcp = common_prefixes(keys, n)
        before = np.where(f > 0, padded[base[o] + f - 1].astype(np.int64), -1 - np.arange(len(o)))
        shared = np.zeros(len(o), bool)
        for depth, lo, hi in intervals(lcp.tolist(), window):
            if (before[lo:hi] != before[lo]).any() or before[lo] < 0:
                yield Repeat(depth, o[lo:hi], f[lo:hi])
            shared[lo:hi] |= n[lo:hi] == depth
        for i in np.flatnonzero((copies[o] > 1) & (f == 0)).tolist():  # a text with copies is a repeat as a whole
            yield Repeat(int(n[i]), o[i:i + 1], f[i:i + 1])


def _parts(grams: np.ndarray, width: int, most: int = 8 << 20) -> Iterator[np.ndarray]:
    """Suffixes in parts of bounded size; those with equal first bytes stay together."""
    parts = max(1, -(-len(grams) * width // most))
    if parts == 1:
        yield np.arange(len(grams))
        return
    part = (grams >> np.uint64(20)) % np.uint64(parts)
    for k in range(parts):
        yield np.flatnonzero(part == np.uint64(k))


def judge(shard: R.Shard) -> np.ndarray:
    """Bits of the windows of each context that also stand in a document of smaller id."""
    found: dict[bytes, int] = {}
    text = np.fromiter((found.setdefault(t, len(found)) for t in shard.units), np.int64, len(shard.units))
    first = np.full(len(found), R.NO_ID)
    np.minimum.at(first, text, shard.ids)
    counts = np.zeros(len(found), np.int64)
    counts[text] = shard.counts
    least = np.repeat(first[:, None], WINDOW - GRAM + 1, 1)  # smallest id that has each window
    for r in maximal_repeats(list(found), np.bincount(text, minlength=len(found)), counts, WINDOW):
        if len(r.texts) > 1:  # the copies of a single text have its smallest id already
            at = r.texts[:, None], r.offsets[:, None] + np.arange(r.length - WINDOW + 1)
            least[at] = np.minimum(least[at], first[r.texts].min())
    return R.window_bits((least[text] < shard.ids[:, None]) & (shard.counts[:, None] > np.arange(least.shape[1])))


def _documents(ids: list, u: R.Units, flagged: np.ndarray) -> Iterator[tuple]:
    """(doc_id, n_bytes, n_removed, n_spans, kept bytes) of each document of a chunk."""
    raw = np.frombuffer(u.data, np.uint8)
    bounds = u.starts.tolist()
    for doc_id, a, b in zip(ids, bounds, bounds[1:]):
        n = int(np.count_nonzero(flagged[a:b]))
        if not n:
            yield doc_id, b - a, 0, 0, u.data[a:b]
        else:
            cut = flagged[a:b]
            yield doc_id, b - a, n, int(cut[0]) + int((cut[1:] & ~cut[:-1]).sum()), raw[a:b][~cut].tobytes()


def _batch(rows: list[tuple], names: list[str], kinds: list) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, k) for c, k in zip(list(map(list, zip(*rows))) or [[]] * len(kinds), kinds)], names)


def _digest(row: dict, u: R.Units, flagged: np.ndarray) -> pa.RecordBatch:
    rows = [(d, n, r, s, hashlib.sha256(kept).hexdigest()) for d, n, r, s, kept in _documents(row["ids"], u, flagged)]
    return _batch(rows, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"], [pa.int64()] * 4 + [pa.string()])


def dedup_digest(spark: SparkSession, docs: DataFrame, **sizes) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each document."""
    return R.repeated_units(spark, docs, R.byte_units, judge, WINDOW, GRAM, False, _digest,
                            "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", **sizes)


def dedup_texts(spark: SparkSession, docs: DataFrame, **sizes) -> DataFrame:
    """The rows of ``docs``, with all their columns, their texts without the
    repeats.  A character cut in two by a removal goes as a whole; a column
    n_chars is the new length."""
    names = docs.columns
    carry = tuple(c for c in names if c not in ("text", "n_chars"))

    def finish(row: dict, u: R.Units, flagged: np.ndarray) -> pa.RecordBatch:
        kept = [data.decode("utf-8", "ignore") for *_, data in _documents(row["ids"], u, flagged)]
        made = {"text": kept, "n_chars": list(map(len, kept))} | {c: row[f"carry{k}"] for k, c in enumerate(carry)}
        return pa.record_batch([pa.array(made[c], t) for c, t in zip(names, types)], names)

    schema = T.StructType([T.StructField("n_chars", T.LongType()) if f.name == "n_chars" else f for f in docs.schema.fields])
    types = [to_arrow_type(f.dataType) for f in schema.fields]
    return R.repeated_units(spark, docs, R.byte_units, judge, WINDOW, GRAM, False, finish, schema, carry=carry, **sizes)


#: The registered query in plain SQL, over all windows (two hex digits a byte).
ORACLE_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
p AS (SELECT r, doc_id, unnest([md5(substr(x, 2 * i + 1, 100)) for i in range(CAST(length(x) // 2 - 49 AS BIGINT))]) AS h,
             unnest(range(CAST(length(x) // 2 - 49 AS BIGINT))) AS i FROM d WHERE length(x) >= 100),
f AS (SELECT r, i, doc_id, min(doc_id) OVER (PARTITION BY h) AS first FROM p),
gone AS (SELECT DISTINCT r, unnest(range(i, i + 50)) AS i FROM f WHERE first < doc_id),
spans AS (SELECT r, count(*) AS n_removed, count(*) FILTER (before IS NULL OR before < i - 1) AS n_spans
          FROM (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS before FROM gone) GROUP BY r),
bytes AS (SELECT r, unnest([substr(x, 2 * i + 1, 2) for i in range(CAST(length(x) // 2 AS BIGINT))]) AS b,
                 unnest(range(CAST(length(x) // 2 AS BIGINT))) AS i FROM d),
kept AS (SELECT r, string_agg(b, '' ORDER BY i) AS k FROM bytes ANTI JOIN gone USING (r, i) GROUP BY r)
SELECT doc_id, CAST(length(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(k, ''))) AS kept_sha256
FROM d LEFT JOIN spans USING (r) LEFT JOIN kept USING (r)"""
