"""Substring dedup against brute force over all windows."""

import hashlib
import random

import numpy as np
import pytest

from fixtures_llm import make_docs
from terrastate.llm import phrase_dedup as S
from terrastate.llm import repeats as R


def brute(rows, n=20):
    first = {}
    docs = [(d, R.NO_ID if d is None else d, (t or "").encode().split()) for d, t in rows]
    for _, key, w in docs:
        for i in range(len(w) - n + 1):
            s = tuple(w[i:i + n])
            first[s] = min(first.get(s, (key, i)), (key, i))
    out = []
    for d, key, w in docs:
        gone = [False] * len(w)
        for i in range(len(w) - n + 1):
            if first[tuple(w[i:i + n])] < (key, i):
                gone[i:i + n] = [True] * n
        out.append((d, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


def corpus(seed, n=50):
    rng = random.Random(seed)
    vocab = ["w%d" % i for i in range(300)] + ["é", "漢", "a,b"]
    passages = [[rng.choice(vocab) for _ in range(rng.randint(15, 70))] for _ in range(6)]
    rows = []
    for i in range(n):
        words = [rng.choice(vocab) for _ in range(rng.randint(0, 40))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            a, b = sorted((rng.randint(0, len(p)), rng.randint(0, len(p))))
            at = rng.randint(0, len(words))
            words[at:at] = p[a:b] if rng.random() < 0.5 else p
        rows.append((rng.randint(0, 2 * n), "".join(w + rng.choice([" ", "\n", "  ", "\t", "\x0b"]) for w in words)))
    p = " ".join(passages[0])
    rows += [(900, None), (901, ""), (902, "go " * 300), (903, "go " * 25), (1, p), (1, p), (None, p), (None, p), (904, "a b c " * 40),
             (905, "\n " + p), (906, "x " * 19), (907, p + " " + p), (0, "b c a " * 30), (908, " ".join(passages[1]))]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,sizes", [(1, {}), (2, {"chunk_bytes": 700, "shard_bytes": 3000}), (3, {"chunk_bytes": 100, "shard_bytes": 1000})])
def test_matches_brute_force(spark, seed, sizes):
    rows = corpus(seed)
    got = S.digest(S.dedup_spans(spark, make_docs(spark, rows).repartition(3), **sizes)).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)


@pytest.mark.parametrize("heavy", [0, 2])
def test_heavy_anchors_change_no_result(spark, monkeypatch, heavy):
    monkeypatch.setattr(R, "HEAVY_BYTES", 1 << 60)
    rows = corpus(7)
    got = S.digest(S.dedup_spans(spark, make_docs(spark, rows).repartition(3), chunk_bytes=900, shard_bytes=3000, heavy=heavy)).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)


def test_empty_table(spark):
    assert S.dedup_spans(spark, make_docs(spark, [])).collect() == []


def test_automaton_locates_every_occurrence():
    texts, counts = ["abcabcab", "xbcabx"], np.array([6, 4])
    phrases = S.recurring(texts, counts, 3)
    assert sorted(phrases) == ["abc", "bca", "cab"]
    ids, starts = S.first_places(texts, counts, np.array([5, 3]), np.array([0, 10]), phrases, 3)
    assert list(zip(ids[0].tolist(), starts[0].tolist())) == [(5, 0), (3, 11), (3, 12), (5, 0), (3, 11), (3, 12)]


def test_letters_are_all_different():
    picked = [0, 1, S.LETTERS - 1, S.LETTERS, S.LETTERS + 1, S.MOST_LETTERS]
    assert len({S.letter(k) for k in picked}) == len(picked) and not any(0xD800 <= ord(S.letter(k)) < 0xE000 for k in picked)


def brute_spans(rows, n):
    first, out = {}, []
    docs = [(d, R.NO_ID if d is None else d, (t or "").encode().split()) for d, t in rows]
    for _, key, w in docs:
        for i in range(len(w) - n + 1):
            s = tuple(w[i:i + n])
            first[s] = min(first.get(s, (key, i)), (key, i))
    for d, key, w in docs:
        gone = [False] * len(w)
        for i in range(len(w) - n + 1):
            if first[tuple(w[i:i + n])] < (key, i):
                gone[i:i + n] = [True] * n
        spans, k = [], 0
        while k < len(w):
            past = k
            while past < len(w) and gone[past]:
                past += 1
            if past > k:
                spans.append((k, past))
            k = past + 1
        out.append((d, len(w), spans, b" ".join(x for x, g in zip(w, gone) if not g).decode()))
    return sorted(out, key=str)


@pytest.mark.parametrize("window", [3, 20, 90])
def test_spans_and_texts_of_any_window(spark, window):
    rows = corpus(8)
    found = S.dedup_spans(spark, make_docs(spark, rows).repartition(2), window=window, chunk_bytes=900, shard_bytes=3000).collect()
    got = sorted(((r.doc_id, r.n_words, [(s.start, s.past) for s in r.removed], r.text) for r in found), key=str)
    want = brute_spans(rows, window)
    assert got == want
    docs = make_docs(spark, rows)
    texts = S.dedup_texts(spark, docs, window=window)
    assert texts.columns == docs.columns
    assert sorted(((r.doc_id, r.text, r.n_chars, r.score) for r in texts.collect()), key=str) == sorted(((d, t, len(t), "z") for d, _, _, t in want), key=str)


def test_more_words_than_letters():
    texts = [b"a b c d", b"x b c d", b"p q r s", b"p q r t", b"u v w y"]
    parts = list(S.alphabets(texts, 3, np.array([2] * 5), most=6))
    assert sorted(sorted(p.tolist()) for p, _ in parts) == [[0, 1], [2, 3], [4]]
    assert all(len(set("".join(s))) <= 6 for _, s in parts)
    whole = list(S.alphabets(texts, 3, np.array([2] * 5)))
    assert len(whole) == 1 and whole[0][0].tolist() == [0, 1, 2, 3, 4]
