"""Suffix-array dedup against brute force over all windows."""

import dataclasses
import hashlib
import random
import time
import tracemalloc

import numpy as np
import pytest
import zstandard

from fixtures_llm import make_docs
from terrastate.llm.common import SHUFFLE_CLEANUP, materialize
from terrastate.llm import repeats as R
from terrastate.llm import suffix_dedup as S


def brute(rows, w=50):
    first = {}
    for d, t in rows:
        b, key = (t or "").encode(), R.NO_ID if d is None else d
        for i in range(len(b) - w + 1):
            s = b[i:i + w]
            first[s] = min(first.get(s, key), key)
    out = []
    for d, t in rows:
        b, key = (t or "").encode(), R.NO_ID if d is None else d
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - w + 1):
            if first[b[i:i + w]] < key:
                gone[i:i + w] = True
        spans = int((gone[:-1] & ~np.concatenate([[False], gone[:-2]])).sum()) if len(b) else 0
        out.append((d, len(b), int(gone.sum()), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


def corpus(seed, n=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé ") for _ in range(rng.randint(2, 9)))
    passages = ["".join(word() for _ in range(rng.randint(8, 40))) for _ in range(8)]
    rows = []
    for i in range(n):
        parts = [word() for _ in range(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            a, b = sorted((rng.randint(0, len(p)), rng.randint(0, len(p))))
            parts.insert(rng.randint(0, len(parts)), p[a:b] if rng.random() < 0.6 else p)
        rows.append((rng.randint(0, 2 * n), "".join(parts)))
    rows += [(900, None), (901, ""), (902, "x" * 400), (1, "x" * 120), (1, "x" * 120), (None, passages[0]), (None, passages[0]), (3, passages[0]),
             (903, "ab" * 300), (904, rows[0][1]), (905, rows[0][1]), (906, "a" * 49), (907, "😀" * 60), (0, "😀" * 20)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,sizes", [(1, {}), (2, {"chunk_bytes": 700, "shard_bytes": 3000}), (3, {"chunk_bytes": 100, "shard_bytes": 1000}),
                                        (4, {"chunk_bytes": 700, "shard_bytes": 3000, "heavy": 2}), (5, {"chunk_bytes": 20_000, "shard_bytes": 1000, "heavy": 0})])
def test_matches_brute_force(spark, seed, sizes):
    rows = corpus(seed)
    got = S.dedup_digest(spark, make_docs(spark, rows).repartition(3), **sizes).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)


def test_empty_table_and_kept_texts(spark):
    assert S.dedup_digest(spark, make_docs(spark, [])).collect() == []
    p = "a passage that is longer than fifty bytes, surely; it repeats"
    docs = make_docs(spark, [(1, "x " + p), (2, p + " y"), (2, p + " y"), (None, None)])
    out = S.dedup_texts(spark, docs)
    assert out.columns == docs.columns
    got = sorted(((r.doc_id, r.text, r.n_chars, r.lang, r.score) for r in out.collect()), key=str)
    assert got == sorted([(1, "x " + p, len(p) + 2, "en", "z"), (2, " y", 2, "en", "z"), (2, " y", 2, "en", "z"), (None, "", 0, "en", "z")], key=str)


@pytest.fixture
def eager(monkeypatch):
    """Anchors are heavy by ``heavy`` alone, however large the shards."""
    monkeypatch.setattr(R, "HEAVY_BYTES", 1 << 60)


@pytest.mark.parametrize("heavy", [0, 1, 3, 20])
def test_heavy_anchors_change_no_result(spark, eager, heavy):
    rows = corpus(6)
    got = S.dedup_digest(spark, make_docs(spark, rows).repartition(3), chunk_bytes=900, shard_bytes=3000, heavy=heavy).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)


def stock_phrase(n):
    """A phrase of 44 bytes in other surroundings each time, beside repeated and single text."""
    rng = random.Random(1)
    text = lambda k: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(k))
    return [(i, text(150) + "as everybody in this great country knows well" + text(150)) for i in range(n)]


def test_a_stock_phrase_is_spread_over_shards_and_rows_grow_as_the_corpus(spark, eager):
    largest, sent, marked = [], [], []
    for n in (2_000, 8_000):
        docs = make_docs(spark, stock_phrase(n)).repartition(4)
        total = 345 * n
        chunk, shard = int((total * 100) ** 0.5), int((total * 300) ** 0.5)  # as the root of the corpus, small for the test
        p = R.prepare(spark, docs, R.byte_units, S.WINDOW, S.GRAM, chunk_bytes=chunk, shard_bytes=shard, heavy=100)
        rows = R.contexts_of(p, False).groupBy("shard").agg({"n": "sum", "*": "count"}).collect()
        largest.append(max(r["sum(n)"] for r in rows))
        sent.append(sum(r["count(1)"] for r in rows))
        marked.append(p.marks.selectExpr("sum(size(marks))").first()[0])
    # a shard holds twice as much of four times the corpus; without the levels one had 1,934 and 7,555 contexts
    assert largest[1] <= 2.2 * largest[0] and largest[1] < 400
    assert sent[1] <= 5 * sent[0] and marked[1] <= 5 * marked[0]


def test_sizes_grow_as_the_root():
    a, b = R.sizes_for(840 << 20), R.sizes_for(4 * 840 << 20)
    assert [round(y / x, 2) for x, y in zip(a, b)] == [2, 2] and R.sizes_for(10 ** 14) == (R.MOST_BYTES, R.MOST_BYTES)


def test_maximal_repeats_have_all_their_occurrences():
    texts = [b"-abcdefgh+", b"*abcdefgh+", b"/abcdefXX", b"abcdefgh"]
    got = {(r.length, tuple(sorted(zip(r.texts.tolist(), r.offsets.tolist())))) for r in S.maximal_repeats(
        texts, np.array([1, 1, 1, 2]), np.array([6, 6, 5, 4]), 5)}
    # ...which differ in the byte before: repeats that could be longer to the left are not among them
    assert got == {(9, ((0, 1), (1, 1))), (8, ((0, 1), (1, 1), (3, 0))), (6, ((0, 1), (1, 1), (2, 1), (3, 0))), (8, ((3, 0),))}


def test_intervals_are_the_nodes_of_the_tree():
    assert sorted(S.intervals([0, 3, 5, 5, 2, 0, 4], 1)) == [(2, 0, 5), (3, 0, 4), (4, 5, 7), (5, 1, 4)]


def test_a_chunk_takes_few_bytes_a_unit():
    """What takes many bytes a unit is worked out block by block; all at once it was over 60 bytes for each of a chunk."""
    data = random.Random(3).randbytes(3 << 20)
    z = zstandard.ZstdCompressor().compress(data)
    tracemalloc.start()
    try:
        level, = R.to_mark(R.byte_units([1], [len(data)], z), S.WINDOW, S.GRAM, 8, {})
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert level.runs.count.sum() == len(data) - S.WINDOW + 1 and peak < 30 * len(data)


def test_blocks_change_no_anchor(monkeypatch):
    rng = random.Random(4)
    texts = ["".join(rng.choice("abc ") for _ in range(rng.choice([0, 30, 49, 50, 51, 300, 2_000]))).encode() for _ in range(40)]
    u = R.Units(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]), np.arange(40), b"".join(texts))
    windows = lambda c: [(a + k, h) for a, n, h in zip(c.first.tolist(), c.count.tolist(), c.anchor.tolist()) for k in range(n)]
    whole, starts = windows(R.first_runs(u, 50, 16)), R.heavy_starts(c := R.first_runs(u, 50, 16), c.count > 3)
    levels = [(x.has.tolist(), windows(x.runs)) for x in R.further_levels(u, starts, 50, 16)]
    hashes = R.text_hashes(u, R.Contexts(starts, np.ones(len(starts), np.int64), starts), 50).tolist()
    for block in (1, 7, 100, 1_000):
        monkeypatch.setattr(R, "BLOCK", block)
        assert windows(R.first_runs(u, 50, 16)) == whole
        assert [(x.has.tolist(), windows(x.runs)) for x in R.further_levels(u, starts, 50, 16)] == levels
        assert R.text_hashes(u, R.Contexts(starts, np.ones(len(starts), np.int64), starts), 50).tolist() == hashes


def test_different_texts_of_one_hash_stay_apart():
    lo, hi = np.array([0, 3, 6, 9]), np.array([3, 6, 9, 12])
    group, first = R.grouped(b"abcabdabcabd", lo, hi, np.zeros(4, np.uint64))
    assert group.tolist() == [0, 1, 0, 1] and first.tolist() == [0, 1]
    group, first = R.grouped(b"abcabdabcabd", lo, hi, np.array([9, 3, 9, 3], np.uint64))
    assert group.tolist() == [0, 1, 0, 1] and first.tolist() == [0, 1]


def test_a_shard_is_judged_part_by_part(spark):
    """However large a shard, the judge sees a part of it; the whole shard at once had 16 times as much."""
    rows = corpus(7, 200)
    p = R.prepare(spark, make_docs(spark, rows), R.byte_units, S.WINDOW, S.GRAM, chunk_bytes=2_000, shard_bytes=1 << 20, part_bytes=1 << 16)
    size = lambda shard: np.full(len(shard.ids), len(shard.ids), np.uint64)
    got = R.judged(R.contexts_of(p, False), size, p.parts, False).collect()
    contexts = {r["shard"]: r["sum(n)"] for r in R.contexts_of(p, False).groupBy("shard").agg({"n": "sum"}).collect()}
    sent = {(r["chunk"], r["shard"]): r["n"] for r in R.contexts_of(p, False).collect()}
    for r in got:
        seen = R.unpack(r["flags"], (np.uint64, sent[r["chunk"], r["shard"]]))[0]
        assert seen.max() <= contexts[r["shard"]] / 4
    assert p.parts == 16 and len(got) == len(sent)


@pytest.mark.parametrize("sizes", [{"chunk_bytes": 900, "shard_bytes": 40_000, "part_bytes": 1_000},
                                   {"chunk_bytes": 900, "shard_bytes": 40_000, "part_bytes": 1_000, "heavy": 2},
                                   {"chunk_bytes": 700, "shard_bytes": 3000, "pass_share": 0.2}])
def test_parts_and_passes_change_no_result(spark, sizes):
    rows = corpus(8)
    got = S.dedup_digest(spark, make_docs(spark, rows).repartition(3), **sizes).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)


def test_shards_are_judged_in_passes_where_contexts_are_many(spark):
    """A pass sends the contexts of its own shards; in one pass a corpus of copies sent several times its size at once."""
    docs = make_docs(spark, corpus(9))
    p = R.prepare(spark, docs, R.byte_units, S.WINDOW, S.GRAM, chunk_bytes=700, shard_bytes=1000, pass_share=0.2)
    shards = [{r["shard"] for r in R.contexts_of(p, False, k).select("shard").distinct().collect()} for k in range(p.passes)]
    once = R.contexts_of(dataclasses.replace(p, passes=1), False).select("shard").distinct().collect()
    assert p.passes > 1 and all({s % p.passes for s in own} <= {k} for k, own in enumerate(shards))
    assert set().union(*shards) == {r["shard"] for r in once}


def test_what_a_step_shuffled_goes_when_it_is_written(spark):
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    held = lambda: {f.getName() for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(manager.getAllFiles()) if f.getName().startswith("shuffle_")}
    before = held()
    written = materialize(spark, spark.range(1_000).groupBy("id").count(), "held")
    for _ in range(50):
        if held() <= before:
            break
        time.sleep(0.1)
    assert held() <= before and written.count() == 1_000
    assert spark.conf.get(SHUFFLE_CLEANUP, None) is None
