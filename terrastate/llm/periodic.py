"""Maximal periodic runs of words, by internal pattern matching over dyadic blocks.

A run is a stretch of consecutive words whose words ``q`` apart are the same,
``q`` its smallest period, at least ``least`` words and ``times * q`` long, and
not to be made longer with that period.

A task takes documents of some hundred thousand words together; a word counts
as another word in each document, and a word of its own parts documents, so
nothing matches across them.  Blocks of 2**k words that occur again are named
by doubling (names of level k + 1 are pairs of names of level k; a block that
is alone has none, so on prose the levels soon run dry).  Places whose blocks of
eight occur again, sorted by their names level by level, are the suffix array:
the occurrences of every block of every level are one interval of it.  A
wavelet tree over the array answers the range successor: the next occurrence of
a block in its neighbouring window.

For every block of 2**k words (k from 3) at a multiple of its length, the
window is the next 2 * 2**k words.  A run of period q with 2**k <= q < 2**(k+1)
(k = 3 also takes all smaller ones) has such a block together with its copy q
words on, if ``times`` is 3 or more and ``least`` 22 or more.  Occurrences at
most half a block apart are a progression, whose step is the block's own
period: then only the distances that lay the ends of the two periodic stretches
on each other can be the period of a run, and the progression is stepped over
at once.  Others are candidates themselves.  A candidate is extended both ways
by the names of blocks, exactly.

Results: null or empty texts have no words, no runs and an empty text; repeated
documents and null ids give a row each; of stretches with several periods the
smallest counts; the empty table gives no rows.  Memory of a task is about 4
bytes for every word and level with repeats, of at least one whole document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrastate.llm.common import text_rows

LOWEST = 3
BATCH_WORDS = 200_000
WHITE = " \t\n\x0b\f\r"


def named_levels(symbols: np.ndarray) -> list[np.ndarray]:
    """For k = 0, 1, ...: the name of the block of 2**k symbols at each place, -1 where it is alone; up to the last level with names."""
    _, names, counts = np.unique(symbols, return_inverse=True, return_counts=True)
    level = np.where(counts[names] > 1, names, -1).astype(np.int32)
    out, half = [], 1
    while (active := np.flatnonzero(level >= 0)).size:
        out.append(level)
        active = active[active + half < len(level)]
        active = active[level[active + half] >= 0]
        pairs = level[active].astype(np.int64) << 32 | level[active + half]
        _, names, counts = np.unique(pairs, return_inverse=True, return_counts=True)
        again = counts[names] > 1
        level = np.full(len(level), -1, np.int32)
        level[active[again]] = names[again]
        half *= 2
    return out


class WaveletTree:
    """Bits of a permutation of 0..n-1 from the highest down, each level stably sorted by the one above."""

    def __init__(self, values: np.ndarray):
        self.size, self.levels = len(values), []
        for bit in reversed(range(max(1, int(len(values) - 1).bit_length()))):
            ones = (values >> bit) & 1
            self.levels.append((bit, np.concatenate([[0], np.cumsum(1 - ones)]), int((ones == 0).sum())))
            values = np.concatenate([values[ones == 0], values[ones == 1]])

    def successor(self, lo: np.ndarray, hi: np.ndarray, least: np.ndarray) -> np.ndarray:
        """For each query the smallest value of at least ``least`` at places lo to hi, or -1."""
        a, b, smaller = lo.copy(), hi.copy(), np.zeros(len(lo), np.int64)
        beyond = least >= self.size
        for bit, zeros, parted in self.levels:
            one = (least >> bit) & 1 == 1
            za, zb = zeros[a], zeros[b]
            smaller += np.where(one, zb - za, 0)
            a, b = np.where(one, a - za + parted, za), np.where(one, b - zb + parted, zb)
        none = beyond | (smaller >= hi - lo)
        a, b, k, value = lo.copy(), hi.copy(), np.where(none, 0, smaller), np.zeros(len(lo), np.int64)
        for bit, zeros, parted in self.levels:
            za, zb = zeros[a], zeros[b]
            one = k >= zb - za
            k = np.where(one, k - (zb - za), k)
            a, b = np.where(one, a - za + parted, za), np.where(one, b - zb + parted, zb)
            value |= np.where(one, 1 << bit, 0)
        return np.where(none, -1, value)


class Index:
    """Names of repeated blocks, the suffix array of the places with repeats, and its wavelet tree."""

    def __init__(self, symbols: np.ndarray):
        self.names = named_levels(symbols)
        if len(self.names) > LOWEST:
            self.places = np.flatnonzero(self.names[LOWEST] >= 0)
            deep = [level[self.places] for level in self.names[LOWEST:]]
            self.order = np.lexsort(deep[::-1])  # the suffix array: entries number the places
            self.rank = np.empty(len(self.order), np.int64)
            self.rank[self.order] = np.arange(len(self.order))
            self.sorted_names = [d[self.order] for d in deep]
            self.tree = WaveletTree(self.order.astype(np.int64))

    def interval(self, k: int, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bounds in the suffix array of the suffixes that begin with the named block of 2**k symbols at each place."""
        names = self.sorted_names[k - LOWEST]
        starts = np.flatnonzero(np.concatenate([[True], names[1:] != names[:-1]]))
        at = np.searchsorted(starts, self.rank[np.searchsorted(self.places, places)], "right") - 1
        return starts[at], np.concatenate([starts, [len(names)]])[at + 1]

    def next_place(self, lo: np.ndarray, hi: np.ndarray, after: np.ndarray) -> np.ndarray:
        """The next place of the interval behind ``after``, or -1."""
        found = self.tree.successor(lo, hi, np.searchsorted(self.places, after, "right"))
        return np.where(found < 0, -1, self.places[found])

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many symbols from ``a`` on equal those from ``b`` on (a < b)."""
        out = np.zeros(len(a), np.int64)
        for k in reversed(range(len(self.names))):
            names = self.names[k]
            x, y = a + out, np.minimum(b + out, len(names) - 1)
            out += np.where((names[x] >= 0) & (names[x] == names[y]) & (x != y), 1 << k, 0)
        return out

    def common_before(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many symbols before ``a`` equal those before ``b`` (a < b)."""
        out = np.zeros(len(a), np.int64)
        for k in reversed(range(len(self.names))):
            names = self.names[k]
            x, y = a - out - (1 << k), b - out - (1 << k)
            out += np.where((x >= 0) & (names[x] >= 0) & (names[x] == names[y]), 1 << k, 0)
        return out


def candidates(index: Index, k: int, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and distances that may be a run's period, of the blocks of 2**k symbols at ``blocks``."""
    size = 1 << k
    found: list[tuple[np.ndarray, np.ndarray]] = []
    at, (lo, hi), now = blocks, index.interval(k, blocks), blocks
    while at.size:
        new = index.next_place(lo, hi, now)
        near = (new >= 0) & (new < at + 2 * size)
        at, lo, hi, now, new = at[near], lo[near], hi[near], now[near], new[near]
        step = new - now
        row = 2 * step <= size
        found.append((at[~row], (new - at)[~row]))
        if row.any():
            p, c, d = at[row], now[row], step[row]
            right = c + d + index.common(c, c + d)
            own = c == p
            found.append((p[own], d[own]))
            # the ends of the block's own stretch of this period on those of the other
            q, e, f = p[~own], c[~own], d[~own]
            found.append((q, e - index.common_before(e, e + f) - (q - index.common_before(q, q + f))))
            found.append((q, right[~own] - (q + f + index.common(q, q + f))))
            new[row] = c + (right - size - c) // d * d  # the progression's last
        now = new
    p, q = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 2
    fits = (q >= (1 if k == LOWEST else size)) & (q < 2 * size)
    return p[fits], q[fits]


def runs_of(symbols: np.ndarray, starts: np.ndarray, least: int, times: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of all runs of texts that begin at ``starts`` and end with a symbol of their own."""
    index = Index(symbols)
    out = [np.zeros((0, 3), np.int64)]
    for k in range(LOWEST, len(index.names)):
        places = np.flatnonzero(index.names[k] >= 0)
        origin = starts[np.searchsorted(starts, places, "right") - 1]
        p, q = candidates(index, k, places[(places - origin) % (1 << k) == 0])
        if p.size:
            p, q = np.unique(np.stack([p, q]), axis=1)
            first, last = p - index.common_before(p, p + q), p + q + index.common(p, p + q)
            good = last - first >= np.maximum(least, times * q)
            out.append(np.stack([first, last, q], 1)[good])
    found = np.unique(np.concatenate(out), axis=0)  # by start, end, period: of a stretch the smallest period is first
    one = np.ones(len(found), bool)
    one[1:] = (found[1:, :2] != found[:-1, :2]).any(1)
    found = found[one]
    return found[:, 0], found[:, 1], found[:, 2]


RUNS = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def examine(ids: list, words: list[list[bytes]], least: int, times: int) -> pa.RecordBatch:
    """Runs and collapsed texts of documents taken together."""
    symbols, starts, used = [], [], 0
    for w in words:
        numbers: dict[bytes, int] = {}
        starts.append(len(symbols))
        symbols.extend([used + numbers.setdefault(x, len(numbers)) for x in w])
        used += len(numbers) + 1
        symbols.append(used - 1)
    starts = np.array(starts, np.int64)
    first, last, period = runs_of(np.array(symbols, np.int64), starts, least, times)
    of = np.searchsorted(starts, first, "right") - 1
    runs, texts = [[] for _ in ids], []
    gone = np.zeros(len(symbols) + 1, np.int64)  # changes in the number of runs that drop a word
    np.add.at(gone, first + period, 1)
    np.add.at(gone, last, -1)
    kept = np.cumsum(gone) == 0
    for d, s, e, q in sorted(zip(of.tolist(), first.tolist(), last.tolist(), period.tolist()), key=lambda r: (r[1], r[3])):
        runs[d].append({"start": s - int(starts[d]), "length": e - s, "period": q})
    for d, w in enumerate(words):
        if runs[d]:
            w = [x for x, k in zip(w, kept[starts[d]:starts[d] + len(w)].tolist()) if k]
        texts.append(b" ".join(w).decode())
    return pa.record_batch([pa.array(ids, pa.int64()), pa.array([len(w) for w in words], pa.int64()), pa.array(runs, pa.list_(_RUN)),
                            pa.array(texts, pa.string())], ["doc_id", "n_words", "runs", "collapsed"])


def periodic_runs(docs: DataFrame, least: int = 24, times: int = 3) -> DataFrame:
    """doc_id, n_words, runs (by start, then period) and the text with each run cut down to one period, of every document."""
    if times < 3 or least < 22:
        raise ValueError("blocks find the runs of at least three periods and 22 words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, words, size = [], [], 0
        for b in batches:
            for d, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                ids.append(d)
                words.append(t.encode().split())  # bytes part at the six white characters of ASCII only
                size += len(words[-1]) + 1
                if size >= BATCH_WORDS:
                    yield examine(ids, words, least, times)
                    ids, words, size = [], [], 0
        if ids:
            yield examine(ids, words, least, times)

    return text_rows(docs).mapInArrow(run, RUNS)


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """doc_id, text: the query's documents. With h = crc32(doc_id) divisible by ten, words from a = g % n on (g = h / 10, of n
    words) are those of a stretch of p = 1 + (n - a) / (3 + g % 8) words, again and again.  A null id counts as h = 0."""
    rows = text_rows(docs).withColumn("bare", F.btrim("text", F.lit(WHITE)))
    h = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(0))
    rows = rows.withColumn("g", F.when((h % 10 == 0) & (F.col("bare") != ""), F.floor(h / 10)))
    words = F.split("bare", r"[\x20\x09-\x0D]+")
    plain = rows.where("g IS NULL").select("doc_id", "text")
    rows = rows.where("g IS NOT NULL").select("doc_id", "g", words.alias("words")).withColumn("n", F.size("words")).withColumn("a", F.col("g") % F.col("n"))
    rows = rows.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    rows = rows.select("doc_id", F.expr("""array_join(concat(slice(words, 1, int(a)), slice(flatten(array_repeat(
        slice(words, int(a) + 1, int(p)), int(ceil((n - a) / p)))), 1, int(n - a))), ' ')""").alias("text"))
    return plain.unionByName(rows)


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the run of greatest exponent, and hashes of all runs and of the collapsed text."""
    best = F.expr("""aggregate(runs, CAST(NULL AS struct<start:bigint,length:bigint,period:bigint>), (b, r) ->
        CASE WHEN b IS NULL OR r.length * b.period > b.length * r.period THEN r ELSE b END)""")  # runs come by start, then period
    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    text = F.array_join(F.transform(line, lambda x: F.concat(x, F.lit("\n"))), "")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"), F.sha2(text, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"))
