"""Best-fit packing of tokenised documents into fixed-length sequences.

Hierarchical residual packing: each partition tokenises its documents, cuts the
longer ones, packs the pieces best-fit and emits them with their ids, written
once; bins that are nearly full stay as they are.  Underfull bins become items:
round by round they are dealt to fewer tasks, each packs the bins it gets
best-fit again, until one task holds what is left or a round no longer helps.  A
round's task gets a bounded number of pieces, without their ids, which are
joined by the pieces' first places once all are placed.

Results: a document is its ids and the end id, so an empty or null text is one
piece of one token; documents longer than a sequence are cut so that all pieces
but the first are full; repeated rows and null ids are packed as rows of their
own; an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrastate.llm.common import materialize, text_rows

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
COLUMNS = [c.split()[0] for c in PIECES.split(", ")]
#: A piece's place; ``open``: its bin has more free tokens than the slack; home: its place after the first round.
PLACES = "doc_id long, piece int, start long, length long, sequence_id long, offset long"
TOKENS = PLACES + ", ids_crc32 long, open boolean, ids array<int>"
MOVED = PLACES + ", ids_crc32 long, open boolean, home long, home_offset long"
HOME = ["home", "home_offset"]
BATCH_ROWS = 4096
_ENCODERS: dict = {}

#: How the byte-level BPE splits a text into pre-tokens.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Characters that every Unicode version since 5 classes alike: ASCII and Latin letters, Cyrillic, dashes and quotes, Han, Hangul.
UNSETTLED = re.compile("[^\n\x20-\x7e\xa1-\xac\xae-\u024f\u0400-\u045f\u2010-\u2027\u4e00-\u9fa5\uac00-\ud7a3]").search


def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte in the vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = (b for b in range(256) if b not in shown)
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


class IdEncoder:
    """Ids of whole texts as little-endian unsigned 32-bit bytes.

    Texts go through ``ranked_encoder`` of the same vocabulary.  A text with a
    special string goes through the library itself; one with a character outside
    ``UNSETTLED``'s classes, which libraries of another Unicode version may class
    another way, is split by the pattern, and the library's model encodes its
    pre-tokens, through a cache that starts anew at ``cache_size`` entries.
    """

    def __init__(self, path: str, cache_size: int = 400_000):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.model, self.split = self.tokenizer.model, regex.compile(PATTERN).findall
        self.alphabet, self.cache_size = byte_alphabet(), cache_size
        self.ranked = ranked_encoder(self.tokenizer)
        self.pretokens: dict[str, bytes] = {}

    def _pretoken(self, word: str) -> bytes:
        if len(self.pretokens) >= self.cache_size:
            self.pretokens.clear()
        mapped = word.encode().decode("latin-1").translate(self.alphabet)
        ids = self.pretokens[word] = array("I", [t.id for t in self.model.tokenize(mapped)]).tobytes()
        return ids

    def encode(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        if self.ranked is not None and UNSETTLED(text) is None:
            return array("I", self.ranked(text)).tobytes()
        get, new = self.pretokens.get, self._pretoken
        return b"".join([new(w) if (ids := get(w)) is None else ids for w in self.split(text)])


def ranked_encoder(tokenizer) -> Callable[[str], list[int]] | None:
    """The same vocabulary as byte strings with ranks, by another library that is much faster; None where
    the file is not such a plain byte-level one (merges in the order of their ids, split by ``PATTERN``, nothing else)."""
    import json

    import tiktoken

    told = json.loads(tokenizer.to_str())
    model, before = told["model"], told["pre_tokenizer"] or {}
    plain = (model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
             and told["normalizer"] is None and (before.get("type"), before.get("add_prefix_space"), before.get("use_regex")) == ("ByteLevel", False, True))
    if not plain:
        return None
    back = {c: b for b, c in byte_alphabet().items()}
    special = {t["content"] for t in told["added_tokens"]}
    ranks = {bytes(back[c] for c in w): i for w, i in model["vocab"].items() if w not in special}
    made = [model["vocab"]["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in model["merges"]]
    if not all(bytes([b]) in ranks for b in range(256)) or any(a >= b for a, b in zip(made, made[1:])):
        return None
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def cut_all(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, piece, start, length) of the pieces of documents of so many tokens each: only the first may be shorter than ``size``."""
    count = -(-lengths // size)
    owner = np.repeat(np.arange(len(lengths)), count)
    piece = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    short = (lengths - (count - 1) * size)[owner]
    return owner, piece, np.where(piece == 0, 0, short + (piece - 1) * size), np.where(piece == 0, short, size)


def best_fit(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Best-fit decreasing: bin and offset of each item, and the number of bins.
    Open bins stand in stacks by room; bit r of a mask says that stack r has one."""
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    stacks: list[list[int]] = [[] for _ in range(size + 1)]
    mask = count = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fits = mask >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            b = stacks[room].pop()
            if not stacks[room]:
                mask &= ~(1 << room)
        else:
            room, b, count = size, count, count + 1
        bins[i], offsets[i] = b, size - room
        if room > n:
            stacks[room - n].append(b)
            mask |= 1 << (room - n)
    return bins, offsets, count


def names_of(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def tokenise_and_pack(docs: DataFrame, path: str, size: int, end_id: int, flush: int, flush_tokens: int, slack: int) -> DataFrame:
    """Pieces of all documents with their ids, packed best-fit within each partition, ``flush`` pieces or ``flush_tokens`` tokens at a time."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _ENCODERS.get(path) or _ENCODERS.setdefault(path, IdEncoder(path))
        first = TaskContext.get().partitionId() << 32
        ids: list[int | None] = []
        data: list[bytes] = []  # each document's ids
        tokens = pieces = 0

        def packed() -> Iterator[pa.RecordBatch]:
            nonlocal first, tokens, pieces
            owner, piece, start, sizes = cut_all(np.array([len(d) // 4 for d in data], np.int64), size)
            buffer = b"".join(data)
            ends = np.concatenate([[0], np.cumsum(sizes)])
            view, at = memoryview(buffer), (4 * ends).tolist()
            crc = [zlib.crc32(view[x:y]) for x, y in zip(at, at[1:])]
            bins, offsets, count = best_fit(sizes, size)
            filled = np.bincount(bins, weights=sizes, minlength=count)
            lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.Array.from_buffers(pa.int32(), len(buffer) // 4, [None, pa.py_buffer(buffer)]))
            arrays = [pa.array(ids, pa.int64()).take(pa.array(owner)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(sizes),
                      pa.array(bins + first), pa.array(offsets), pa.array(crc, pa.int64()), pa.array(filled[bins] < size - slack), lists]
            first, tokens, pieces = first + count, 0, 0
            ids.clear()
            data.clear()
            batch = pa.record_batch(arrays, names_of(TOKENS))
            yield from (batch.slice(x, BATCH_ROWS) for x in range(0, batch.num_rows, BATCH_ROWS))

        for b in batches:
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                ids.append(doc_id)
                data.append(encoder.encode(text) + end)
                tokens += len(data[-1]) // 4
                pieces += 1 + len(data[-1]) // (4 * size)
                if tokens >= flush_tokens or pieces >= flush:
                    yield from packed()
        if ids:
            yield from packed()

    return text_rows(docs).mapInArrow(run, TOKENS)


def merge_round(under: DataFrame, tasks: int, size: int, slack: int) -> DataFrame:
    """Deal the underfull bins to ``tasks`` tasks; each packs its bins as items."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        rows = pa.Table.from_batches(parts).sort_by([("sequence_id", "ascending"), ("offset", "ascending")])
        old = rows.column("sequence_id").to_numpy()
        names, member = np.unique(old, return_inverse=True)
        used = np.bincount(member, weights=rows.column("length").to_numpy()).astype(np.int64)
        bins, offsets, count = best_fit(used, size)
        new = np.empty(count, np.int64)
        new[bins[::-1]] = names[::-1]  # a merged bin takes the number of one of its members
        filled = np.bincount(bins, weights=used, minlength=count)
        moved = {"sequence_id": new[bins[member]], "offset": rows.column("offset").to_numpy() + offsets[member], "open": (filled[bins] < size - slack)[member]}
        for name, values in moved.items():
            rows = rows.set_column(rows.column_names.index(name), name, pa.array(values))
        yield from rows.combine_chunks().to_batches()

    return under.repartition(tasks, F.xxhash64("sequence_id")).mapInArrow(run, MOVED)


def packed_pieces(spark: SparkSession, docs: DataFrame, path: str, size: int = 1024, end_id: int = 2, flush: int = 200_000,
                  per_task: int = 400_000, fan_in: int = 8, slack: int = 8, flush_tokens: int = 8 << 20) -> DataFrame:
    """Pieces with their sequence, place in it, token ids, and the CRC32 of these as little-endian unsigned 32-bit bytes.

    ``flush`` and ``flush_tokens``: pieces and tokens packed at once in the
    first round; ``per_task``: pieces a merging task gets; ``fan_in``: by how
    much the tasks shrink each round; ``slack``: free tokens up to which a bin
    counts as nearly full.
    """
    tokens = materialize(spark, tokenise_and_pack(docs, path, size, end_id, flush, flush_tokens, slack), "pieces")
    places, out = [*names_of(PLACES), "ids_crc32"], [*COLUMNS, "ids"]
    home = [F.col("sequence_id").alias("home"), F.col("offset").alias("home_offset")]
    under = tokens.filter("open").select(*places, "open", *home)
    moved: list[DataFrame] = []
    tasks = None
    before = None
    while True:
        rows, bins = under.agg(F.count(F.lit(1)), F.count_distinct("sequence_id")).first()
        least = max(1, -(-rows // per_task))
        if not rows or tasks == 1 or (before is not None and tasks == least and bins > 0.999 * before):
            break
        tasks = least if tasks is None and rows <= per_task else max(least, (tasks or tokens.rdd.getNumPartitions()) // fan_in)
        before = bins
        merged = materialize(spark, merge_round(under, tasks, size, slack), "merged")
        moved.append(merged.filter(~F.col("open")))
        under = merged.filter("open")
    homeless = _union([*moved, under]).select(*places, *HOME)
    ids = tokens.filter("open").select(*home, "ids")
    return tokens.filter(~F.col("open")).select(*out).unionByName(homeless.join(ids, HOME).select(*out))


def sequences(pieces: DataFrame) -> DataFrame:
    """(sequence_id, n_tokens, ids): the packed sequences, one a row, of ``packed_pieces``."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return (pieces.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.flatten(F.transform(parts, lambda x: x.ids)).alias("ids")))


def pack(spark: SparkSession, docs: DataFrame, path: str, **options) -> DataFrame:
    """The registered query's columns: ``packed_pieces`` without the ids themselves."""
    return packed_pieces(spark, docs, path, **options).select(*COLUMNS)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
