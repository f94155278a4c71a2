"""Token counts by map-side two-tier lookup.

The tokenizer's merges never cross from a non-space to a space, so a text's
count is the sum over its pre-tokens (a run of spaces with the word after it).
Tier one is a compact table of frequent pre-token lengths, broadcast; tier two
is a cache in each Python worker, filled by encoding what tier one misses.  No
pre-token is ever shuffled.

Results: a null or empty text has 0 bytes and 0 tokens; repeated rows and null
ids pass through, one output row per input row; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrastate.llm.common import text_rows

SCHEMA = "doc_id long, n_bytes long, n_tokens long"
_SPACED = re.compile(r" *[^ ]+| +$")
_MODELS: dict = {}


class PieceCounter:
    """Token counts of whole texts by the sentencepiece model at ``path``.

    ``table``: lengths of frequent pre-tokens; ``cache_size``: entries of the
    second tier, which starts anew when it is full.
    """

    def __init__(self, path: str, table: dict[str, int] | None = None, cache_size: int = 400_000):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = (self.model.id_to_piece(i) for i in range(self.model.get_piece_size()))
        #: Pre-tokens are independent only if no piece has a space after a non-space.
        self.separable = not any("▁" in p.lstrip("▁") for p in pieces)
        self.table, self.cache, self.cache_size = table or {}, {}, cache_size

    @staticmethod
    def pretokens(text: str) -> list[str]:
        """Words each preceded by one space; other runs of spaces stay in front
        of their word (less the one space that the model adds)."""
        if "▁" in text:
            text = text.replace("▁", " ")
        if "  " in text or text[:1] == " " or text[-1:] == " ":
            return [p[1:] for p in _SPACED.findall(" " + text)]
        return text.split(" ") if text else []

    def encode_lengths(self, words: list[str]) -> list[int]:
        """An empty pre-token is a single space at the end of a text: one piece."""
        return [len(ids) if w else 1 for w, ids in zip(words, self.model.encode(words, num_threads=1))]

    def count(self, texts: list[str]) -> list[int]:
        if not self.separable:
            return [len(ids) for ids in self.model.encode(texts, num_threads=1)]
        totals, missed, first, second = [], [], self.table, self.cache
        unknown: set[str] = set()
        for i, text in enumerate(texts):
            words = self.pretokens(text)
            found = list(map(first.get, words))
            n = 0
            if None in found:
                rest: list[str] = []
                for w, k in zip(words, found):
                    if k is None:
                        k = second.get(w)
                        if k is None:
                            rest.append(w)
                            k = 0
                    n += k
                if rest:
                    unknown.update(rest)
                    missed.append((i, rest))
            else:
                n = sum(found)
            totals.append(n)
        if unknown:
            if len(second) + len(unknown) > self.cache_size:
                second.clear()
            words = list(unknown)
            lengths = dict(zip(words, self.encode_lengths(words)))
            for i, rest in missed:
                totals[i] += sum(map(lengths.__getitem__, rest))
            room = self.cache_size - len(second)
            second.update(list(lengths.items())[:max(0, room)])
        return totals


def frequent_lengths(docs: DataFrame, path: str, sample_docs: int = 4_000, top: int = 60_000, tasks: int = 8) -> dict[str, int]:
    """Lengths of the most frequent pre-tokens of a sample of about
    ``sample_docs`` documents: at most ``top`` entries, so the broadcast has a
    fixed bound.  The sample only decides what tier one holds, never a count.
    """
    n = docs.count()
    if not n:
        return {}
    sample = docs.select("text").sample(min(1.0, sample_docs / n), seed=7).repartition(tasks)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for b in batches:
            for t in b.column(0).to_pylist():
                seen.update(PieceCounter.pretokens(t))
        best = seen.most_common(top)
        yield pa.record_batch([pa.array([w for w, _ in best], pa.string()), pa.array([k for _, k in best], pa.int64())], ["w", "k"])

    total: Counter = Counter()
    for w, k in sample.mapInArrow(local, "w string, k long").toLocalIterator():  # tasks x top rows at most
        total[w] += k
    words = [w for w, _ in total.most_common(top)]
    return dict(zip(words, PieceCounter(path).encode_lengths(words))) if words else {}


def token_counts(spark: SparkSession, docs: DataFrame, path: str, top: int = 60_000, batch_docs: int = 512) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens of each document."""
    rows = text_rows(docs)
    table = spark.sparkContext.broadcast(frequent_lengths(rows, path, top=top))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (path, id(table.value))
        counter = _MODELS.get(key)
        if counter is None:
            _MODELS.clear()
            counter = _MODELS[key] = PieceCounter(path, table.value)
        for b in batches:
            for at in range(0, b.num_rows, batch_docs):
                part = b.slice(at, batch_docs)
                tokens = counter.count(part.column("text").to_pylist())
                yield pa.record_batch([part.column("doc_id"), part.column("n_bytes"), pa.array(tokens, pa.int64())],
                                      ["doc_id", "n_bytes", "n_tokens"])

    return rows.withColumn("n_bytes", F.octet_length("text").cast("long")).mapInArrow(count, SCHEMA)
