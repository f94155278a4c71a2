"""Removal of repeated phrases by sharded Aho-Corasick automata.

Candidate regions come from ``repeats``; equal regions are one text with the
places of its copies.  Each shard confirms which windows recur in its texts,
compiles them into an Aho-Corasick automaton (a letter stands for a word), and
streams the texts of all documents through it to locate every occurrence.
Every occurrence but the first (smallest doc_id, then earliest in the document)
is removed; phrases may overlap themselves.  ``dedup_spans`` gives each
document's removed spans and the text that is left, ``dedup_texts`` the table
with its texts replaced.

Results: a null or empty text has no words and nothing removed; places in
documents with the same id are in order of their start; a null id counts as
after all others; repeated rows and null ids give a row each; an empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from terrastate.llm import repeats as R

WINDOW, GRAM = 20, 5
LETTERS = 0xD800 - 1  # letters below the surrogates, then those above
MOST_LETTERS = 0x10FFFF - 0x800 - 1


def letter(k: int) -> str:
    return chr(k + 1 if k < LETTERS else k + 0x801)


def recurring(texts: list[str], counts: np.ndarray, window: int) -> list[str]:
    """Confirms the windows that are found in several places of the (different) texts."""
    seen: dict[str, bool] = {}
    for t, n in zip(texts, counts.tolist()):
        for k in range(n):
            w = t[k:k + window]
            seen[w] = w in seen
    return [w for w, again in seen.items() if again]


def first_places(texts: list[str], counts: np.ndarray, ids: np.ndarray, starts: np.ndarray, phrases: list[str], window: int):
    """Streams the texts through the phrases' automaton: for each text and window
    the first place (doc_id, start) of its phrase; that of a window in one text
    only is the text's first place, which its copies share."""
    width = int(counts.max())
    first_id = np.repeat(ids[:, None], width, 1)
    first_start = starts[:, None] + np.arange(width)
    if not phrases:
        return first_id, first_start
    automaton = ahocorasick.Automaton()
    for k, p in enumerate(phrases):
        automaton.add_word(p, k)
    automaton.make_automaton()
    found = np.array([(k, i, end - window + 1) for i, t in enumerate(texts) for end, k in automaton.iter(t)], np.int64)
    phrase, text, at = found.reshape(-1, 3).T
    place_id, place_start = first_id[text, at], first_start[text, at]
    order = np.lexsort((place_start, place_id, phrase))
    head = order[np.concatenate([[True], np.diff(phrase[order]) > 0])]  # the first place of each phrase
    least = np.empty((len(phrases), 2), np.int64)
    least[phrase[head], 0], least[phrase[head], 1] = place_id[head], place_start[head]
    first_id[text, at], first_start[text, at] = least[phrase, 0], least[phrase, 1]
    return first_id, first_start


def judge_of(window: int) -> R.Judge:
    """Bits of the windows of each context that also stand in an earlier place."""
    def judge(shard: R.Shard) -> np.ndarray:
        found: dict[bytes, int] = {}
        text = np.fromiter((found.setdefault(t, len(found)) for t in shard.units), np.int64, len(shard.units))
        order = np.lexsort((shard.starts, shard.ids, text))
        head = order[np.concatenate([[True], np.diff(text[order]) > 0])]  # first place of each different text
        ids, starts, counts = shard.ids[head], shard.starts[head], shard.counts[head]
        first_id = np.empty((len(found), int(counts.max())), np.int64)
        first_start = np.empty_like(first_id)
        for part, spelled in alphabets(list(found), window, counts):
            a, b = first_places(spelled, counts[part], ids[part], starts[part], recurring(spelled, counts[part], window), window)
            first_id[part, :a.shape[1]], first_start[part, :b.shape[1]] = a, b
        a, b, k = first_id[text], first_start[text], np.arange(first_id.shape[1])
        own, start = shard.ids[:, None], shard.starts[:, None] + k
        return R.window_bits(((a < own) | ((a == own) & (b < start))) & (shard.counts[:, None] > k))
    return judge


def alphabets(texts: list[bytes], window: int, counts: np.ndarray, most: int = MOST_LETTERS) -> Iterator[tuple[np.ndarray, list[str]]]:
    """Texts spelled with a letter a word, in parts of at most ``most`` different words: all in one where they have no more,
    else those linked by shared windows together, so every window is met whole."""
    letters: dict[bytes, str] = {}
    spelled: list[str] = []
    for t in texts:
        spelled.append("".join([letters.get(w) or letters.setdefault(w, letter(len(letters))) for w in t.split(b" ")]) if len(letters) <= most else "")
    if len(letters) <= most:
        yield np.arange(len(texts)), spelled
        return
    owner: dict[tuple, int] = {}
    root = list(range(len(texts)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i, (t, n) in enumerate(zip(texts, counts.tolist())):
        words = t.split(b" ")
        for k in range(n):
            a, b = find(owner.setdefault(tuple(words[k:k + window]), i)), find(i)
            root[max(a, b)] = min(a, b)
    groups: dict[int, list[int]] = {}
    for i in range(len(texts)):
        groups.setdefault(find(i), []).append(i)
    for part in groups.values():
        own: dict[bytes, str] = {}
        out = ["".join([own.get(w) or own.setdefault(w, letter(len(own))) for w in texts[i].split(b" ")]) for i in part]
        if len(own) > most:
            raise ValueError("texts linked by shared windows have more different words than there are letters")
        yield np.array(part), out


SPANS = "array<struct<start:long,past:long>>"
_SPAN = pa.struct([("start", pa.int64()), ("past", pa.int64())])


def _documents(u: R.Units, n: int, flagged: np.ndarray) -> Iterator[tuple[int, list[dict], str]]:
    """Words, removed spans (in words) and the text that is left of each document of a chunk."""
    begin, end = u.places
    total = np.concatenate([[0], np.cumsum(flagged)])
    bounds = u.starts.tolist()
    for a, b in zip(bounds[:n], bounds[1:]):
        spans: list[dict] = []
        if total[b] == total[a]:
            kept = u.data[begin[a]:end[b - 1]] if b > a else b""  # words stand one space apart in the chunk
        else:
            own = np.diff(np.concatenate([[0], flagged[a:b].astype(np.int8), [0]]))
            spans = [{"start": x, "past": y} for x, y in zip(np.flatnonzero(own > 0).tolist(), np.flatnonzero(own < 0).tolist())]
            cuts = [0, *(v for span in spans for v in (span["start"], span["past"])), b - a]
            kept = b" ".join([u.data[begin[a + x]:end[a + y - 1]] for x, y in zip(cuts[::2], cuts[1::2]) if y > x])
        yield b - a, spans, kept.decode("utf-8", "surrogatepass")


def gram_of(window: int) -> int:
    """Words of an anchor: five, more where a window would have more than 64 of them."""
    return max(min(GRAM, window), window - 63)


def dedup_spans(spark: SparkSession, docs: DataFrame, window: int = WINDOW, **sizes) -> DataFrame:
    """doc_id, n_words, removed (spans in words: start, past the end), text (the words left, joined by one space) of each document."""
    def finish(row: dict, u: R.Units, flagged: np.ndarray) -> pa.RecordBatch:
        words, spans, texts = zip(*_documents(u, len(row["ids"]), flagged))
        return pa.record_batch([pa.array(row["ids"], pa.int64()), pa.array(words, pa.int64()), pa.array(spans, pa.list_(_SPAN)), pa.array(texts, pa.string())],
                               ["doc_id", "n_words", "removed", "text"])

    return R.repeated_units(spark, docs, R.word_units, judge_of(window), window, gram_of(window), True, finish,
                            f"doc_id long, n_words long, removed {SPANS}, text string", **sizes)


def dedup_texts(spark: SparkSession, docs: DataFrame, window: int = WINDOW, **sizes) -> DataFrame:
    """The rows of ``docs``, with all their columns, their texts without the repeats (words left, joined by one space); a
    column n_chars is the new length."""
    names = docs.columns
    carry = tuple(c for c in names if c not in ("text", "n_chars"))
    schema = T.StructType([T.StructField("n_chars", T.LongType()) if f.name == "n_chars" else f for f in docs.schema.fields])
    types = [to_arrow_type(f.dataType) for f in schema.fields]

    def finish(row: dict, u: R.Units, flagged: np.ndarray) -> pa.RecordBatch:
        kept = [text for _, _, text in _documents(u, len(row["ids"]), flagged)]
        made = {"text": kept, "n_chars": list(map(len, kept))} | {c: row[f"carry{k}"] for k, c in enumerate(carry)}
        return pa.record_batch([pa.array(made[c], t) for c, t in zip(names, types)], names)

    return R.repeated_units(spark, docs, R.word_units, judge_of(window), window, gram_of(window), True, finish, schema, carry=carry, **sizes)


def digest(found: DataFrame) -> DataFrame:
    """The registered query's columns of ``dedup_spans``."""
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s["past"] - s["start"])
    return found.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2("text", 256).alias("kept_sha256"))


#: The registered query in plain SQL, over all windows.
ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT r, doc_id, unnest(range(len(w) - 19)) AS i, w FROM d WHERE len(w) >= 20),
h AS (SELECT r, doc_id, i, md5(array_to_string(w[i + 1:i + 20], ' ')) AS h FROM p),
f AS (SELECT r, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS k FROM h),
gone AS (SELECT DISTINCT r, unnest(range(i, i + 20)) AS i FROM f WHERE k > 1),
words AS (SELECT r, doc_id, len(w) AS n_words, unnest(CASE WHEN len(w) > 0 THEN w ELSE [NULL] END) AS word,
          unnest(range(greatest(len(w), 1))) AS i FROM d),
kept AS (SELECT words.r, any_value(doc_id) AS doc_id, any_value(n_words) AS n_words, count(gone.r) AS n_removed,
         coalesce(string_agg(word, ' ' ORDER BY words.i) FILTER (gone.r IS NULL), '') AS kept
         FROM words LEFT JOIN gone ON words.r = gone.r AND words.i = gone.i GROUP BY words.r)
SELECT doc_id, n_words, n_removed, sha256(kept) AS kept_sha256 FROM kept"""
