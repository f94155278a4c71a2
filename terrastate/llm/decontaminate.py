"""Benchmark decontamination by greedy string tiling.

Texts are sequences of lower-cased words; in scripts without spaces between words
every letter is one.  Runs of ``min_match`` words that a benchmark item and a
document share are seeds; every pair that shares one is tiled: the longest
unmarked match of both sides is marked, again and again, found by running
Karp-Rabin hashes, so a passage told in another order is still covered.  A
document is contaminated by an item if the tiles cover at least ``threshold`` of
the item's words.  An item shorter than ``min_match`` is its own seed: it is
found where it stands as a whole.

The benchmark is the query set: it is cut into blocks of at most
``block_words`` words, each broadcast in turn to all documents, so what is
broadcast has a fixed bound and no document is shuffled.

Results: null or empty texts and items have no words and meet nothing, as do
items of fewer than ``least_words`` words (ordinary phrasing can't be told from
them); of repeated documents and items each row is met; null ids are reported
as null; very long texts and items cost about as much as they have words, for
each length of tile; empty tables give no rows.
"""

from __future__ import annotations

import re
from collections import defaultdict, deque
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrastate.llm.common import mix64, text_rows

#: Letters of scripts that put no space between words: each is a word.
SINGLE = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u2e80-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
WORD = re.compile(rf"(?=[^\W_])[{SINGLE}]|[^\W_{SINGLE}]+")
FOUND = "doc_id long, item_id long, item_words long, covered_words long, tiles int, coverage double"
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


class Rolling:
    """Karp-Rabin hashes of the unmarked runs of a sequence: of any length from one sum over all its words."""

    def __init__(self, words: list[int]):
        self.words, self.marked = words, bytearray(len(words))
        codes = mix64(np.array(words, np.uint64) * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(1))
        with np.errstate(over="ignore"):
            powers, self.back = (np.cumprod(np.full(len(words) + 1, b, np.uint64)) * np.uint64(pow(b, -1, 1 << 64)) for b in (BASE, INVERSE))
            self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes * powers[:-1], dtype=np.uint64)])

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and hashes of the unmarked runs of ``n`` words."""
        marks = np.concatenate([[0], np.cumsum(np.frombuffer(self.marked, np.uint8))])
        at = np.flatnonzero(marks[n:] == marks[:-n]) if n <= len(self.words) else np.zeros(0, np.int64)
        return at, mix64((self.sums[at + n] - self.sums[at]) * self.back[at])

    def longest(self) -> int:
        return max(map(len, bytes(self.marked).split(b"\x01")), default=0)

    def free(self, at: int, n: int) -> bool:
        return self.marked.find(1, at, at + n) < 0

    def mark(self, at: int, n: int) -> None:
        self.marked[at:at + n] = b"\x01" * n


def longest_match(a: Rolling, b: Rolling, least: int, most: int) -> int:
    """Length of the longest unmarked run of both, from ``least`` to ``most`` words; 0 if there is none."""
    def shared(n: int) -> bool:
        return bool(np.isin(b.windows(n)[1], a.windows(n)[1]).any())

    high = min(most, a.longest(), b.longest())
    if high < least or not shared(least):
        return 0
    low, step = least, 1
    while low + step <= high and shared(low + step):  # a run is shared if a longer one is
        low, step = low + step, 2 * step
    high = min(high, low + step - 1)
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if shared(middle) else (low, middle - 1)
    return low


def tile(item: list[int], text: list[int], min_match: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (place in item, place in text, length) of tiles, the longest first, none overlapping.

    The longest length that is left is found by bisection, all its matches are marked, and so on: as many rounds as tiles
    have different lengths, each about linear."""
    a, b = Rolling(item), Rolling(text)
    tiles: list[tuple[int, int, int]] = []
    most = min(len(item), len(text))
    while n := longest_match(a, b, min_match, most):
        (at, own), (there, other) = a.windows(n), b.windows(n)
        places: dict[int, deque[int]] = defaultdict(deque)
        for i, h in zip(at.tolist(), own.tolist()):
            places[h].append(i)
        found = np.isin(other, own)
        for j, h in zip(there[found].tolist(), other[found].tolist()):
            while places[h] and not a.free(places[h][0], n):
                places[h].popleft()
            if places[h] and b.free(j, n) and item[(i := places[h][0]):i + n] == text[j:j + n]:
                tiles.append((i, j, n))
                a.mark(i, n)
                b.mark(j, n)
        most = n - 1
    return tiles


class Block:
    """A bounded part of the benchmark: words as numbers, items, and the seeds that lead to them.  The seed of an item shorter
    than ``min_match`` is the whole item."""

    def __init__(self, items: list[tuple[int, str]], min_match: int, least_words: int):
        self.min_match, self.vocabulary, self.items = min_match, {}, []
        self.seeds: dict[int, dict[tuple, list[int]]] = defaultdict(lambda: defaultdict(list))  # by length
        for item_id, text in items:
            words = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text or "")]
            n = min(min_match, len(words))
            if n >= least_words:
                for s in {tuple(words[i:i + n]) for i in range(len(words) - n + 1)}:
                    self.seeds[n][s].append(len(self.items))
                self.items.append((item_id, words))
        self.seeds = {n: dict(s) for n, s in self.seeds.items()}

    def find(self, text: str, threshold: float) -> list[tuple]:
        """(item_id, words, covered words, tiles, coverage) of each item that contaminates the text."""
        get = self.vocabulary.get
        numbers = np.array([get(w, 0) for w in words_of(text)], np.int64)
        known = np.concatenate([[0], np.cumsum(numbers > 0)])
        out = []
        for n, seeds in self.seeds.items():
            if len(numbers) < n:
                continue
            starts = np.flatnonzero(known[n:] - known[:-n] == n)  # runs of n words that the benchmark uses
            hits: dict[int, list[int]] = defaultdict(list)
            for at in starts.tolist():
                for k in seeds.get(tuple(numbers[at:at + n].tolist()), ()):
                    hits[k].append(at)
            for k, at in hits.items():
                item_id, item = self.items[k]
                # a match of n words or more lies wholly in what the pair's seeds cover; a zero parts what isn't adjacent
                covered, last = [], -1
                for a in at:
                    if a > last:
                        covered.append(0)
                        covered.extend(numbers[a:a + n].tolist())
                    else:
                        covered.extend(numbers[last:a + n].tolist())
                    last = a + n
                tiles = tile(item, covered, n)
                total = sum(t[2] for t in tiles)
                if total >= threshold * len(item):
                    out.append((item_id, len(item), total, len(tiles), total / len(item)))
        return out


def benchmark_blocks(benchmark: DataFrame, block_words: int, id_col: str, text_col: str) -> Iterator[list[tuple[int, str]]]:
    """The benchmark's items in blocks of about ``block_words`` words."""
    block, size = [], 0
    items = benchmark.select(F.col(id_col).cast("long").alias("i"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    for r in items.toLocalIterator():  # the query set, one partition at a time
        block.append((r.i, r.t))
        size += len(words_of(r.t)) + 1
        if size >= block_words:
            yield block
            block, size = [], 0
    if block:
        yield block


def contamination(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, min_match: int = 5, threshold: float = 0.6,
                  block_words: int = 500_000, least_words: int = 3, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """doc_id, item_id, item_words, covered_words, tiles, coverage of each document and item that meet."""
    rows, found = text_rows(docs), []
    for items in benchmark_blocks(benchmark, block_words, id_col, text_col):
        shared = spark.sparkContext.broadcast(Block(items, min_match, least_words))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in batches:
                out = [(d, *hit) for d, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist())
                       for hit in shared.value.find(t, threshold)]
                columns = list(zip(*out)) or [()] * 6
                kinds = [pa.int64()] * 4 + [pa.int32(), pa.float64()]
                yield pa.record_batch([pa.array(list(c), k) for c, k in zip(columns, kinds)], [c.split()[0] for c in FOUND.split(", ")])

        found.append(rows.mapInArrow(run, FOUND))
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], FOUND)


def keep_clean(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, min_match: int = 5, threshold: float = 0.6,
               block_words: int = 500_000, least_words: int = 3, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that no item contaminates."""
    for items in benchmark_blocks(benchmark, block_words, id_col, text_col):
        shared = spark.sparkContext.broadcast(Block(items, min_match, least_words))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in batches:
                texts = b.column(b.schema.get_field_index("text")).to_pylist()
                yield b.filter(pa.array([not shared.value.find(t or "", threshold) for t in texts], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
