"""Search of long repeats without moving the corpus: chunks, anchors, contexts.

Both operators on repeated passages look for runs of ``window`` units (bytes or
words) that occur more than once in the corpus.  The steps they share:

1. Documents are gathered in chunks of a few megabytes, written once
   (compressed) to the shared checkpoint folder with the ids of their documents.
2. Winnowing: in each window the ``gram`` of least hash is its anchor, so equal
   windows have equal anchors.  Each chunk sends the distinct anchor hashes it
   holds, and gets back for each whether it occurs anywhere else, and whether it
   is *heavy*: held in more different surroundings than one shard should see,
   as a stock phrase is.  Windows of heavy anchors are marked once more, by the
   grams of next least hash up to the ``LEVELS``-th and by the whole window, and
   take the first of these that is not heavy.  What a window's anchor is thus
   depends on its own units and on counts over the whole corpus, never on the chunk.
3. Windows of repeated anchors are candidates.  A run of windows with the same
   anchor, with all their units, is a context.  Equal contexts of a chunk are one
   row (with the first document that holds it), dealt to shards by anchor; equal
   windows have equal anchors, so they meet in one shard.
4. A shard (the operator's part) says of each context which of its windows also
   occur in an earlier place; the chunk of the context gets that back.  Within a
   shard anchors are dealt once more, to parts, and a part is judged at a time.

A passage that a third of all documents share thus costs one row a chunk, and a
phrase that they share in other surroundings each time is spread over shards.
Chunks and shards both grow as the square root of the corpus (up to ``MOST_BYTES``),
so the rows between them, one for each chunk and shard at most, grow in
proportion to it.  Hashes only choose candidates; shards compare the units
themselves.

Memory: of a chunk a task holds its bytes, its runs and its contexts; what takes
many bytes a unit is worked out for ``BLOCK`` windows at a time.  Of a shard it
holds what was sent, compressed, the text of ``HELD_BYTES``, and what the judge
makes of one part, which is of a fixed size whatever the corpus.

Disk: what a step shuffled goes when its result is written.  Contexts are several
times the text where all of it is repeated; if they would be more than
``PASS_SHARE`` of the text, shards are judged in passes, some in each.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrastate.llm.common import materialize, mix64, partitions_for, text_rows

MOST_BYTES = 64 << 20
CHUNK_SQUARE, SHARD_SQUARE = 4_800, 76_000  # chunks (shards) hold the root of so many times the corpus: 2 and 8 MB of 840 MB
HEAVY, HEAVY_BYTES, LEVELS = 2_000, 256, 3
PART_BYTES, HEAVY_MOST = 1 << 19, 16 << 20  # text for which a shard has a part; a shard's size beyond which no more surroundings are allowed
BLOCK, HELD_BYTES, PASS_SHARE = 1 << 18, 16 << 20, 1.0
WORD_BYTES = 6  # of a word, about
NO_ID = np.iinfo(np.int64).max  # a null id counts as after all others
CHUNKS = "chunk long, ids array<long>, lengths array<long>, z binary"
ANCHORS = "shard int, level int, chunk long, n int, hashes binary, kinds binary"
MARKS = "chunk long, shard int, level int, marks binary, heavy int, again int"

_rng = np.random.default_rng(20)
BYTE_CODE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
MULTIPLIER = np.uint64(0xD6E8FEB86659FD93)
INVERSE = np.uint64(pow(0xD6E8FEB86659FD93, -1, 1 << 64))
LEVEL_CODE = _rng.integers(1, 1 << 63, LEVELS + 2, dtype=np.uint64)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays, byte planes apart (they compress far better), as one compressed value."""
    parts = []
    for a in arrays:
        raw = np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.itemsize)
        parts.append(np.ascontiguousarray(raw.T).tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def unpack(data: bytes, *kinds: tuple[type, int]) -> list[np.ndarray]:
    raw, at, out = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8), 0, []
    for kind, n in kinds:
        size = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(raw[at:at + n * size].reshape(size, n).T).view(kind).ravel())
        at += n * size
    return out


def chunk_documents(spark: SparkSession, docs: DataFrame, single_spaces: bool, chunk_bytes: int, carry: tuple[str, ...] = ()) -> DataFrame:
    """Chunks of whole documents as UTF-8, compressed; a long document is a chunk
    of its own.  ``single_spaces``: only the words of a text, joined by one
    space.  ``carry``: columns whose values go along, as carry0, carry1, ..."""
    kinds = [docs.schema[c].dataType.simpleString() for c in carry]
    schema = ", ".join([CHUNKS, *[f"carry{k} array<{t}>" for k, t in enumerate(kinds)]])
    rows = text_rows(docs) if not carry else docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        *[F.col(c).alias(f"carry{k}") for k, c in enumerate(carry)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        ids, texts, size = [], [], 0
        carried: list[list] = [[] for _ in carry]

        def out(types: list) -> pa.RecordBatch:
            z = zstandard.ZstdCompressor(level=3).compress(b"".join(texts))
            arrays = [pa.array([number]), pa.array([ids], pa.list_(pa.int64())), pa.array([list(map(len, texts))], pa.list_(pa.int64())), pa.array([z], pa.binary())]
            return pa.record_batch(arrays + [pa.array([v], pa.list_(t)) for v, t in zip(carried, types)],
                                   ["chunk", "ids", "lengths", "z", *[f"carry{k}" for k in range(len(carry))]])

        for b in batches:
            types = [b.schema.field(2 + k).type for k in range(len(carry))]
            for doc_id, text, *values in zip(*[c.to_pylist() for c in b.columns]):
                ids.append(doc_id)
                data = text.encode("utf-8", "surrogatepass")
                texts.append(b" ".join(data.split()) if single_spaces else data)
                for held, value in zip(carried, values):
                    held.append(value)
                size += len(texts[-1])
                if size >= chunk_bytes:
                    yield out(types)
                    number, ids, texts, size = number + 1, [], [], 0
                    carried = [[] for _ in carry]
        if ids:
            yield out(types)

    return materialize(spark, rows.mapInArrow(run, schema), "chunks")


@dataclass
class Units:
    """The units of a chunk: bytes or hashes, where each document starts, and the text."""

    codes: np.ndarray  # one a unit: a byte, or a hash as uint64
    starts: np.ndarray  # first unit of each document, and the end
    ids: np.ndarray  # doc_id of each document
    data: bytes
    places: np.ndarray | None = None  # for words: start and end of each in ``data``

    def __len__(self) -> int:
        return len(self.codes)

    def hashes_of(self, lo: int, hi: int) -> np.ndarray:
        own = self.codes[lo:hi]
        return BYTE_CODE[own] if own.dtype == np.uint8 else own

    @property
    def hashes(self) -> np.ndarray:
        return self.hashes_of(0, len(self))

    def blocks(self, window: int) -> Iterator[tuple[int, Units]]:
        """The windows of ``BLOCK`` starts at a time, as (first start, units by hash)."""
        for lo in range(0, len(self) - window + 1, BLOCK):
            hi = min(lo + BLOCK + window - 1, len(self))
            edges = self.starts[np.searchsorted(self.starts, lo, side="right"):np.searchsorted(self.starts, hi)]
            yield lo, Units(self.hashes_of(lo, hi), np.concatenate([[0], edges - lo, [hi - lo]]), self.ids[:0], b"")


def read_chunk(ids: list, lengths: list, z: bytes) -> tuple[bytes, np.ndarray, np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(z)
    return data, np.concatenate([[0], np.cumsum(np.array(lengths, np.int64))]), np.array([NO_ID if i is None else i for i in ids], np.int64)


def byte_units(ids: list, lengths: list, z: bytes) -> Units:
    data, starts, ids = read_chunk(ids, lengths, z)
    return Units(np.frombuffer(data, np.uint8), starts, ids, data)


def powers_of(base: np.uint64, most: int) -> np.ndarray:
    """The powers of an odd number from 0 to ``most``, modulo 2**64."""
    out = np.full(most + 1, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def word_units(ids: list, lengths: list, z: bytes) -> Units:
    """Words are runs of bytes other than ASCII white space; none crosses a document's end."""
    data, starts, ids = read_chunk(ids, lengths, z)
    raw = np.frombuffer(data, np.uint8)
    inside = ~_SPACE[raw]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edges = starts[(starts > 0) & (starts < len(raw))]
    first[edges] = inside[edges]
    begin = np.flatnonzero(first)
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    last[edges - 1] = inside[edges - 1]
    end = np.flatnonzero(last) + 1
    if len(begin):
        place = np.arange(len(raw)) - np.repeat(begin, np.diff(np.concatenate([[0], begin[1:], [len(raw)]])))
        power = powers_of(MULTIPLIER, int((end - begin).max()))
        value = np.where(inside, BYTE_CODE[raw] * power[np.clip(place, 0, len(power) - 1)], np.uint64(0))
        hashes = mix64(np.add.reduceat(value, begin))
    else:
        hashes = np.zeros(0, np.uint64)
    return Units(hashes, np.searchsorted(begin, starts), ids, data, np.stack([begin, end]))


def gram_hashes(h: np.ndarray, gram: int) -> np.ndarray:
    """Mixed hash of each run of ``gram`` units, by doubling."""
    total, size, power = h, 1, MULTIPLIER
    done, done_size = None, 0
    rest = gram
    while rest:
        if rest & 1:
            if done is None:
                done, done_size = total, size
            else:
                n = len(h) - done_size - size + 1
                done, done_size = done[:n] * power + total[done_size:done_size + n], done_size + size
        rest >>= 1
        if rest:
            n = len(h) - 2 * size + 1
            if n <= 0:
                return np.zeros(0, np.uint64)
            total = total[:n] * power + total[size:size + n]
            size, power = 2 * size, power * power
    return mix64(done)


def window_anchors(u: Units, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts of all windows that lie in one document, the anchor place of each, hash of each gram)."""
    n = len(u.hashes)
    if n < window:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        grams = gram_hashes(u.hashes, gram)
    key = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    width, span = window - gram + 1, 1
    while 2 * span <= width:
        key = np.minimum(key[:-span], key[span:])
        span *= 2
    if span < width:
        key = np.minimum(key[:len(key) - (width - span)], key[width - span:])
    inside = np.zeros(n + 1, np.int64)
    sizes = np.diff(u.starts)
    whole = sizes >= window
    np.add.at(inside, u.starts[:-1][whole], 1)
    np.add.at(inside, u.starts[1:][whole] - window + 1, -1)
    starts = np.flatnonzero(np.cumsum(inside[:n]) > 0)
    return starts, (key[starts] & np.uint64(0xFFFFFFFF)).astype(np.int64), grams


def shard_of(hashes: np.ndarray, shards: int) -> np.ndarray:
    return ((hashes >> np.uint64(40)) % np.uint64(shards)).astype(np.int64)


def distinct_anchors(hashes: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct anchor hashes in order of shard and hash, how often each occurs here, their shards, each anchor's index.

    What a shard sees of a hash are its low 32 bits; with the shard that is
    enough to keep chance repeats (which cost a comparison only) rare.
    """
    low = hashes & np.uint64(0xFFFFFFFF)
    shard = shard_of(hashes, shards)
    key, index, counts = np.unique((shard.astype(np.uint64) << np.uint64(32)) | low, return_inverse=True, return_counts=True)
    return (key & np.uint64(0xFFFFFFFF)).astype(np.uint32), counts, (key >> np.uint64(32)).astype(np.int64), index


@dataclass
class Contexts:
    """Runs of windows that share an anchor, by window order within a level."""

    first: np.ndarray  # first window's start (unit)
    count: np.ndarray  # windows in the run
    anchor: np.ndarray  # anchor hash

    def of(self, which: np.ndarray) -> Contexts:
        return Contexts(self.first[which], self.count[which], self.anchor[which])


    def moved(self, by: int) -> Contexts:
        return Contexts(self.first + by, self.count, self.anchor)


NO_CONTEXTS = Contexts(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64))


def joined(parts: list[Contexts]) -> Contexts:
    return Contexts(*[np.concatenate([getattr(p, f) for p in (NO_CONTEXTS, *parts)]) for f in ("first", "count", "anchor")])


def runs_of(starts: np.ndarray, places: np.ndarray, anchors: np.ndarray) -> Contexts:
    """Consecutive windows with one anchor place."""
    if not len(starts):
        return Contexts(starts, starts, np.zeros(0, np.uint64))
    change = np.flatnonzero(np.concatenate([[True], (places[1:] != places[:-1]) | (starts[1:] != starts[:-1] + 1)]))
    return Contexts(starts[change], np.diff(np.concatenate([change, [len(starts)]])), anchors[change])


def first_runs(u: Units, window: int, gram: int) -> Contexts:
    """The runs of all windows by their first anchors, in order (cut where a block ends)."""
    found = []
    for lo, block in u.blocks(window):
        starts, places, grams = window_anchors(block, window, gram)
        found.append(runs_of(starts, places, grams[places]).moved(lo))
    return joined(found)


def next_places(starts: np.ndarray, grams: np.ndarray, width: int, block: int = 1 << 15) -> list[np.ndarray]:
    """The (first) places of the grams of second, third, ... least hash in each window up to ``LEVELS``, -1 where it has fewer."""
    out = [np.empty(len(starts), np.int64) for _ in range(LEVELS - 1)]
    none, low = np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64(32)
    for at in range(0, len(starts), block):
        part = starts[at:at + block]
        key = ((grams[part[:, None] + np.arange(width)] >> low) << low) | np.arange(width, dtype=np.uint64)
        best = key.min(1)
        for places in out:
            key[(key >> low) <= (best >> low)[:, None]] = none
            best = key.min(1)
            places[at:at + block] = np.where(best == none, -1, part + (best & np.uint64(0xFFFFFFFF)).astype(np.int64))
    return out


Marks = dict[int, dict[int, bytes]]  # by level and shard


@dataclass
class Level:
    """Anchors of some windows at one level: which of the windows have one, and their runs."""

    number: int
    has: np.ndarray
    runs: Contexts


def further_levels(u: Units, starts: np.ndarray, window: int, gram: int) -> list[Level]:
    """The levels behind the first of the windows at ``starts`` (ascending), whose first anchor is heavy; the last one is the
    whole window."""
    found: dict[int, list[Level]] = {number: [] for number in range(2, LEVELS + 2)}
    for lo, block in u.blocks(window):
        own = starts[np.searchsorted(starts, lo):np.searchsorted(starts, lo + BLOCK)] - lo
        if len(own):
            for level in _block_levels(block, own, window, gram):
                found[level.number].append(Level(level.number, level.has, level.runs.moved(lo)))
    return [Level(number, np.concatenate([x.has for x in own]), joined([x.runs for x in own])) for number, own in found.items()]


def _block_levels(u: Units, starts: np.ndarray, window: int, gram: int) -> Iterator[Level]:
    with np.errstate(over="ignore"):
        grams = gram_hashes(u.codes, gram)
        whole = mix64(gram_hashes(u.codes, window)[starts] ^ LEVEL_CODE[0])
    for number, places in enumerate(next_places(starts, grams, window - gram + 1), 2):
        has = places >= 0
        yield Level(number, has, runs_of(starts[has], places[has], mix64(grams[places[has]] ^ LEVEL_CODE[number])))
    yield Level(LEVELS + 1, np.ones(len(starts), bool), Contexts(starts, np.ones(len(starts), np.int64), whole))


def heavy_starts(runs: Contexts, heavy: np.ndarray) -> np.ndarray:
    cut = runs.of(heavy)
    return np.repeat(cut.first, cut.count) + np.arange(int(cut.count.sum())) - np.repeat(np.cumsum(cut.count) - cut.count, cut.count)


def to_mark(u: Units, window: int, gram: int, shards: int, marks: Marks) -> list[Level]:
    """The levels to be marked next: the first, or those behind it of the windows whose first anchor is heavy."""
    runs = first_runs(u, window, gram)
    if not marks:
        return [Level(1, np.ones(0, bool), runs)]
    again, heavy = marked(runs.anchor, shards, marks.get(1, {}))
    starts = heavy_starts(runs, again & heavy)
    return further_levels(u, starts, window, gram) if len(starts) else []


def candidate_contexts(u: Units, window: int, gram: int, shards: int, marks: Marks) -> Contexts:
    """Contexts of the windows whose anchor, the first that is not heavy, occurs again."""
    runs = first_runs(u, window, gram)
    if not len(runs.first):
        return runs
    again, heavy = marked(runs.anchor, shards, marks.get(1, {}))
    found = [runs.of(again & ~heavy)]
    starts = heavy_starts(runs, again & heavy)
    if not len(starts):
        return found[0]
    undecided = np.ones(len(starts), bool)
    for level in further_levels(u, starts, window, gram):
        at = np.flatnonzero(level.has)
        run_again, run_heavy = marked(level.runs.anchor, shards, marks.get(level.number, {}))
        run = np.repeat(np.arange(len(level.runs.first)), level.runs.count)  # of each window that has this level
        own = undecided[at] & ~run_heavy[run]
        take = own & run_again[run]
        found.append(runs_of(starts[at[take]], run[take], level.runs.anchor[run[take]]))
        undecided[at[own]] = False
    return joined(found)


def marked(anchors: np.ndarray, shards: int, known: dict[int, bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Whether each anchor occurs again, and whether it is heavy."""
    low, _, shard, index = distinct_anchors(anchors, shards)
    bits = np.zeros((2, len(low)), bool)
    cuts = np.flatnonzero(np.diff(shard, prepend=-1)).tolist()
    for lo, hi in zip(cuts, [*cuts[1:], len(low)]):
        raw = np.frombuffer(known[int(shard[lo])], np.uint8).reshape(2, -1)
        bits[:, lo:hi] = np.unpackbits(raw, axis=1, count=hi - lo)
    return bits[0][index], bits[1][index]


def surroundings(u: Units, runs: Contexts, index: np.ndarray, counts: np.ndarray, window: int) -> np.ndarray:
    """In how many different contexts each distinct anchor stands here (by hash); 0 where it stands once."""
    out = np.zeros(len(counts), np.int64)
    often = np.flatnonzero(counts[index] > 1)
    if len(often):
        pairs = np.unique(np.stack([index[often].astype(np.uint64), text_hashes(u, runs.of(often), window)]), axis=1)
        np.add.at(out, pairs[0].astype(np.int64), 1)
    return out


def text_hashes(u: Units, runs: Contexts, window: int) -> np.ndarray:
    """A hash of all units of each run."""
    order = np.argsort(runs.first, kind="stable")
    a = runs.first[order]
    b = a + runs.count[order] + window - 1
    most = min(BLOCK, len(u)) + 2 * window
    powers, back, text = powers_of(MULTIPLIER, most), powers_of(INVERSE, most), np.empty(len(a), np.uint64)
    for lo in range(0, len(u), BLOCK):
        own = slice(*np.searchsorted(a, [lo, lo + BLOCK]).tolist())
        if own.start < own.stop:
            first, past = a[own] - lo, b[own] - lo
            h = u.hashes_of(lo, lo + int(past.max()))
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * powers[:len(h)], dtype=np.uint64)])
            text[order[own]] = mix64((total[past] - total[first]) * back[first]) ^ (past - first).astype(np.uint64)
    return text


def rows_of(batch: pa.RecordBatch) -> Iterator[dict]:
    """The rows of a batch, one in memory at a time."""
    for i in range(batch.num_rows):
        yield {name: column[i].as_py() for name, column in zip(batch.schema.names, batch.columns)}


UnitsOf = Callable[[list, list, bytes], Units]


def repeated_anchors(chunks: DataFrame, units: UnitsOf, window: int, gram: int, shards: int, most: int) -> DataFrame:
    """(chunk, shard, level, marks, heavy): two bits for each distinct anchor hash of the chunk in the shard, of the levels
    that are to be marked next: whether it occurs again, and whether in more than ``most`` surroundings."""
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in rows_of(b):
                u = units(r["ids"], r["lengths"], r["z"])
                rows = []
                for level in to_mark(u, window, gram, shards, marks_of(r)):
                    low, counts, shard, index = distinct_anchors(level.runs.anchor, shards)
                    with np.errstate(over="ignore"):
                        kinds = np.minimum(surroundings(u, level.runs, index, counts, window), 255).astype(np.uint8)
                    cuts = np.flatnonzero(np.diff(shard, prepend=-1))
                    for lo, hi in zip(cuts.tolist(), [*cuts[1:].tolist(), len(low)]):
                        rows.append((int(shard[lo]), level.number, r["chunk"], hi - lo, pack(np.diff(low[lo:hi], prepend=np.uint32(0))), pack(kinds[lo:hi])))
                kinds_of = (pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
                yield pa.record_batch([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 6, kinds_of)], ["shard", "level", "chunk", "n", "hashes", "kinds"])

    def meet(rows):
        parts, kinds, n = [], [], rows.column("n").to_pylist()
        for size, data, held in zip(n, rows.column("hashes").to_pylist(), rows.column("kinds").to_pylist()):
            parts.append(np.cumsum(unpack(data, (np.uint32, size))[0], dtype=np.uint32))
            kinds.append(unpack(held, (np.uint8, size))[0])
        held = np.concatenate(kinds).astype(np.int64)
        _, index, counts = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
        again = (counts[index] > 1) | (held > 0)
        last = rows.column("level")[0].as_py() > LEVELS  # a whole window is in one surrounding only
        heavy = again & (np.bincount(index, weights=np.maximum(held, 1))[index] > most) & (not last)
        ends = np.cumsum(n).tolist()
        marks = [np.packbits([again[hi - size:hi], heavy[hi - size:hi]], axis=1).tobytes() for size, hi in zip(n, ends)]
        weights = [[int(x[hi - size:hi].sum()) for size, hi in zip(n, ends)] for x in (heavy, again)]
        return pa.table({"chunk": rows.column("chunk"), "shard": rows.column("shard"), "level": rows.column("level"), "marks": pa.array(marks, pa.binary()),
                         "heavy": pa.array(weights[0], pa.int32()), "again": pa.array(weights[1], pa.int32())})

    return chunks.mapInArrow(send, ANCHORS).groupBy("level", "shard").applyInArrow(meet, MARKS)


@dataclass
class Sent:
    """The distinct contexts of a chunk in order of shard and part, and how its contexts map to them."""

    shard: np.ndarray
    part: np.ndarray
    ids: np.ndarray  # of the first place: smallest doc_id, then smallest start in its document
    starts: np.ndarray
    counts: np.ndarray
    begin: np.ndarray  # where their bytes begin and end in the chunk
    past: np.ndarray
    group: np.ndarray  # of each context of the chunk: its distinct one
    first: np.ndarray  # whether it stands in that first place


def part_of(hashes: np.ndarray, parts: int) -> np.ndarray:
    return ((hashes >> np.uint64(16) & np.uint64(0xFFFFFF)) % np.uint64(parts)).astype(np.int64)


def distinct_contexts(u: Units, c: Contexts, window: int, shards: int, parts: int, positional: bool) -> Sent:
    """Distinct contexts; with ``positional`` the start in the document tells places apart, else the id alone."""
    doc = np.searchsorted(u.starts, c.first, side="right") - 1
    ids, starts = u.ids[doc], c.first - u.starts[doc]
    last = c.first + c.count + window - 2
    lo, hi = (c.first, last + 1) if u.places is None else (u.places[0][c.first], u.places[1][last])
    order = np.lexsort((starts, ids, part_of(c.anchor, parts), shard_of(c.anchor, shards)))
    group, first = grouped(u.data, lo[order], hi[order], text_hashes(u, c, window)[order])
    group[order], rep = group.copy(), order[first]
    same = ids == ids[rep][group] if len(rep) else np.zeros(0, bool)
    if positional and len(rep):
        same &= starts == starts[rep][group]
    return Sent(shard_of(c.anchor[rep], shards), part_of(c.anchor[rep], parts), ids[rep], starts[rep], c.count[rep], lo[rep], hi[rep], group, same)


def grouped(data: bytes, lo: np.ndarray, hi: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The group of each text of ``data`` (those that are equal), numbered as they come, and the first text of each group."""
    _, first, group = np.unique(hashes, return_index=True, return_inverse=True)
    rank = np.empty(len(first), np.int64)
    rank[np.argsort(first)] = np.arange(len(first))
    group, first = rank[group], np.sort(first)
    again = np.flatnonzero(first[group] != np.arange(len(group))) if len(group) else group
    rep = first[group[again]]
    texts = zip(lo[again].tolist(), hi[again].tolist(), lo[rep].tolist(), hi[rep].tolist())
    if all(data[a:b] == data[x:y] for a, b, x, y in texts):
        return group, first
    found: dict[bytes, int] = {}  # different texts of one hash
    group = np.fromiter((found.setdefault(data[a:b], len(found)) for a, b in zip(lo.tolist(), hi.tolist())), np.int64, len(lo))
    return group, np.unique(group, return_index=True)[1]


def send_contexts(chunks: DataFrame, p: Prepared, positional: bool, only: int) -> DataFrame:
    """Distinct contexts of each chunk (``chunks`` with their marks) for each shard of pass ``only``: how many of each part,
    their places and their texts."""
    units, window, gram, shards, parts, passes = p.units, p.window, p.gram, p.shards, p.parts, p.passes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in rows_of(b):
                u = units(r["ids"], r["lengths"], r["z"])
                c = candidate_contexts(u, window, gram, shards, marks_of(r))
                if passes > 1:
                    c = c.of(shard_of(c.anchor, shards) % passes == only)
                s = distinct_contexts(u, c, window, shards, parts, positional)
                rows, cuts = [], np.flatnonzero(np.diff(s.shard, prepend=-1)).tolist()
                for lo, hi in zip(cuts, [*cuts[1:], len(s.shard)]):
                    text = b"".join([u.data[x:y] for x, y in zip(s.begin[lo:hi].tolist(), s.past[lo:hi].tolist())])
                    sizes = s.past[lo:hi] - s.begin[lo:hi]
                    places = [s.starts[lo:hi]] if positional else []
                    head = pack(np.bincount(s.part[lo:hi], minlength=parts).astype(np.uint32), np.diff(s.ids[lo:hi], prepend=0),
                                s.counts[lo:hi].astype(np.uint8), sizes.astype(np.uint32), *places)
                    rows.append((int(s.shard[lo]), r["chunk"], hi - lo, head, zstandard.ZstdCompressor(level=3).compress(text)))
                yield pa.record_batch([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 5, (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary()))],
                                      ["shard", "chunk", "n", "head", "z"])

    return chunks.mapInArrow(run, "shard int, chunk long, n int, head binary, z binary")


def marks_of(row: dict) -> Marks:
    out: Marks = {}
    for m in row["marks"] or ():
        out.setdefault(m["level"], {})[m["shard"]] = m["marks"]
    return out


@dataclass
class Shard:
    """All contexts of a part of a shard, those of different chunks side by side."""

    ids: np.ndarray
    starts: np.ndarray
    counts: np.ndarray
    units: list[bytes]


#: Says of each context of a part of a shard, as bits by window, which of its windows also stand in an earlier place.
Judge = Callable[[Shard], np.ndarray]


def window_bits(flagged: np.ndarray) -> np.ndarray:
    """Rows of booleans, one a window, as the bits of a number."""
    packed = np.zeros((len(flagged), 8), np.uint8)
    bits = np.packbits(flagged, axis=1, bitorder="little")
    packed[:, :bits.shape[1]] = bits
    return packed.view("<u8").ravel()


def judged(contexts: DataFrame, judge: Judge, parts: int, positional: bool) -> DataFrame:
    """(chunk, shard, flags): the judge's bits for each context, in the order they were sent."""
    def meet(rows):
        n, z = rows.column("n").to_pylist(), rows.column("z")
        base = np.cumsum([0, *n])
        ids, counts, starts = np.empty(base[-1], np.int64), np.empty(base[-1], np.uint8), np.zeros(base[-1] * positional, np.int64)
        bounds = np.zeros((len(n), parts + 1), np.int64)  # of each row's parts, in contexts
        ends = []  # of each row's contexts, in bytes
        for r, (head, k) in enumerate(zip(rows.column("head"), n)):
            own = slice(base[r], base[r + 1])
            sent, step, counts[own], sizes, *at = unpack(head.as_py(), (np.uint32, parts), (np.int64, k), (np.uint8, k), (np.uint32, k), *[(np.int64, k)] * positional)
            ids[own], bounds[r, 1:] = np.cumsum(step), np.cumsum(sent)
            ends.append(np.concatenate([np.zeros(1, np.uint32), np.cumsum(sizes, dtype=np.uint32)]))
            if positional:
                starts[own] = at[0]
        places = np.stack([e[b] for e, b in zip(ends, bounds)]).astype(np.int64)  # of each row's parts, in bytes
        flags = np.empty(len(ids), np.uint64)
        for lo, hi in parts_together(np.diff(places, axis=1).sum(0)):
            texts = [zstandard.ZstdDecompressor().decompress(z[r].as_py())[places[r, lo]:places[r, hi]] for r in range(len(n))]
            for k in range(lo, hi):
                own, units = [], []
                for r in np.flatnonzero(bounds[:, k] < bounds[:, k + 1]).tolist():
                    a, b = bounds[r, k], bounds[r, k + 1]
                    own.append(np.arange(base[r] + a, base[r] + b))
                    cuts = (ends[r][a:b + 1].astype(np.int64) - places[r, lo]).tolist()
                    units += [texts[r][x:y] for x, y in zip(cuts, cuts[1:])]
                if own:
                    at = np.concatenate(own)
                    flags[at] = judge(Shard(ids[at], starts[at] if positional else np.zeros(len(at), np.int64), counts[at].astype(np.int64), units))
        out = [pack(flags[a:b]) for a, b in zip(base.tolist(), base[1:].tolist())]
        return pa.table({"chunk": rows.column("chunk"), "shard": rows.column("shard"), "flags": pa.array(out, pa.binary())})

    return contexts.groupBy("shard").applyInArrow(meet, "chunk long, shard int, flags binary")


def parts_together(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of parts whose texts are read at once: of ``HELD_BYTES`` or little more."""
    lo, held = 0, 0
    for k, size in enumerate(sizes.tolist()):
        held += size
        if held >= HELD_BYTES or k + 1 == len(sizes):
            yield lo, k + 1
            lo, held = k + 1, 0


def flagged_units(u: Units, row: dict, window: int, gram: int, shards: int, parts: int, positional: bool) -> np.ndarray:
    """Whether each unit of a chunk (a row with its marks and flags) lies in a flagged window."""
    c = candidate_contexts(u, window, gram, shards, marks_of(row))
    s = distinct_contexts(u, c, window, shards, parts, positional)
    covered = np.zeros(len(u) + 1, np.int32)
    if len(s.shard):
        flags, by_shard = np.empty(len(s.shard), np.uint64), {f["shard"]: f["flags"] for f in row["flags"] or ()}
        cuts = np.flatnonzero(np.diff(s.shard, prepend=-1)).tolist()
        for lo, hi in zip(cuts, [*cuts[1:], len(s.shard)]):
            flags[lo:hi] = unpack(by_shard[int(s.shard[lo])], (np.uint64, hi - lo))[0]
        # any place but the first has that first place before it
        bits = np.where(s.first, flags[s.group], np.uint64(0xFFFFFFFFFFFFFFFF))
        begins = np.zeros(len(u), bool)  # a flagged window
        for k in range(window - gram + 1):
            begins[c.first[(c.count > k) & (bits >> np.uint64(k) & np.uint64(1) > 0)] + k] = True
        np.cumsum(begins, dtype=np.int32, out=covered[1:])
    covered[window:] -= covered[:-window].copy() if len(u) >= window else 0
    return covered[1:] > 0


def by_chunk(rows: DataFrame, *values: str) -> DataFrame:
    return rows.groupBy("chunk").agg(F.collect_list(F.struct("shard", *values)).alias(values[-1]))


def sizes_for(total: int) -> tuple[int, int]:
    """Bytes of a chunk and of a shard for a corpus of ``total`` bytes: both grow as its square root, so the number of their
    pairs grows as the corpus."""
    return (min(max(math.isqrt(total * CHUNK_SQUARE), 256 << 10), MOST_BYTES), min(max(math.isqrt(total * SHARD_SQUARE), 1 << 20), MOST_BYTES))


@dataclass
class Prepared:
    """A corpus in chunks, its marks by chunk, and how windows are anchored and dealt."""

    chunks: DataFrame
    marks: DataFrame
    shards: int
    window: int
    gram: int
    units: UnitsOf
    parts: int = 1  # of a shard
    passes: int = 1  # in which shards are judged


def prepare(spark: SparkSession, docs: DataFrame, units: UnitsOf, window: int, gram: int, chunk_bytes: int | None = None,
            shard_bytes: int | None = None, carry: tuple[str, ...] = (), heavy: int = HEAVY, part_bytes: int = PART_BYTES,
            pass_share: float = PASS_SHARE) -> Prepared:
    """Steps 1 and 2.  ``heavy``: surroundings of an anchor up to which it is not heavy, or one for ``HEAVY_BYTES`` of a shard
    (of ``HEAVY_MOST`` at most) if that is more."""
    total = docs.agg(F.coalesce(F.sum(F.octet_length(F.col("text").cast("string"))), F.lit(0))).first()[0]
    own = sizes_for(total)
    chunks = chunk_documents(spark, docs, single_spaces=units is word_units, chunk_bytes=chunk_bytes or own[0], carry=carry)
    shards = partitions_for(spark, total, shard_bytes or own[1])
    texts = chunks.select("chunk", "ids", "lengths", "z")
    most = max(heavy, min(shard_bytes or own[1], HEAVY_MOST) // HEAVY_BYTES)
    no_marks = F.lit(None).cast("array<struct<shard:int,level:int,marks:binary>>").alias("marks")
    marks = materialize(spark, repeated_anchors(texts.select("*", no_marks), units, window, gram, shards, most), "marks")
    crowded = marks.filter("heavy > 0").select("chunk").distinct()
    if crowded.limit(1).count():  # only chunks with windows of heavy anchors go on
        todo = texts.join(crowded, "chunk", "left_semi").join(by_chunk(marks, "level", "marks"), "chunk")
        marks = marks.unionByName(materialize(spark, repeated_anchors(todo, units, window, gram, shards, most), "marks-2"))
    one = (1 if units is byte_units else WORD_BYTES) * (3 * window - gram) / 5  # of a context, compressed: 0.4 of the bytes of a middling run
    n = marks.filter("level <= 2").agg(F.sum(F.col("again") - F.col("heavy"))).first()[0] or 0
    passes = min(shards, math.ceil(n * one / (pass_share * total))) if n else 1
    return Prepared(chunks, by_chunk(marks, "level", "marks"), shards, window, gram, units, math.ceil((shard_bytes or own[1]) / part_bytes), passes)


def contexts_of(p: Prepared, positional: bool, only: int = 0) -> DataFrame:
    """Step 3: contexts of each chunk for each shard of pass ``only``."""
    texts = p.chunks.select("chunk", "ids", "lengths", "z").join(p.marks, "chunk", "left")
    return send_contexts(texts, p, positional, only)


def repeated_units(spark: SparkSession, docs: DataFrame, units: UnitsOf, judge: Judge, window: int, gram: int, positional: bool, finish, schema: str,
                   carry: tuple[str, ...] = (), **sizes) -> DataFrame:
    """``finish(row, units, flagged)`` for each chunk of ``docs``: a record batch of ``schema``."""
    p = prepare(spark, docs, units, window, gram, carry=carry, **sizes)
    passes = [materialize(spark, judged(contexts_of(p, positional, k), judge, p.parts, positional), "flags") for k in range(p.passes)]
    flags = reduce(DataFrame.unionByName, passes)
    ready = p.chunks.join(p.marks.join(by_chunk(flags, "flags"), "chunk", "full"), "chunk", "left")
    shards, parts = p.shards, p.parts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in rows_of(b):
                u = units(r["ids"], r["lengths"], r["z"])
                yield finish(r, u, flagged_units(u, r, window, gram, shards, parts, positional))

    return ready.mapInArrow(run, schema)
