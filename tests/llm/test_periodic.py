"""Periodic runs against the definition."""

import hashlib
import random
import re
import zlib

import numpy as np

from fixtures_llm import make_docs
from terrastate.llm import periodic as P

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_runs(words, least=24, times=3):
    n, found = len(words), {}
    for q in range(1, n // times + 1):
        i = 0
        while i < n - q:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, times * q):
                found.setdefault((i, j + q), q)  # smallest period first
            i = j
    return sorted((s, e - s, q) for (s, e), q in found.items())


def planted(doc_id, words):
    h = 0 if doc_id is None else zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    return words


def brute(doc_id, text):
    words = planted(doc_id, WORD.findall(text or ""))
    runs = brute_runs(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-np.float64(r[1]) / r[2], r[0], r[2]), default=(None,) * 3)
    return (doc_id, len(runs), *best, best[1] * 1000 // best[2] if runs else None,
            hashlib.sha256("".join(f"{a},{b},{c}\n" for a, b, c in runs).encode()).hexdigest(),
            hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in gone).encode()).hexdigest())


def found(texts):
    """Runs of texts (lists of words) taken together."""
    batch = P.examine(list(range(len(texts))), [[str(w).encode() for w in t] for t in texts], 24, 3)
    return [[(r["start"], r["length"], r["period"]) for r in runs] for runs in batch.column("runs").to_pylist()]


def test_random_texts_of_few_words():
    rng = random.Random(1)
    texts = []
    for _ in range(400):
        t = []
        while len(t) < rng.randrange(1, 300):
            unit = [rng.randrange(3) for _ in range(rng.choice([1, 2, 3, 5, 8, 13, 21, 40]))]
            t += unit * rng.randrange(1, 9) + unit[:rng.randrange(len(unit) + 1)]
            if rng.random() < 0.3:
                t += [rng.randrange(50) for _ in range(rng.randrange(9))]
        texts.append(t)
    assert found(texts) == [brute_runs(t) for t in texts]


def test_periodic_periods():
    """Periods whose own words are periodic: progressions whose ends must be laid on each other."""
    rng = random.Random(2)
    texts = []
    for _ in range(300):
        inner = [rng.randrange(2) for _ in range(rng.randrange(1, 5))]
        unit = inner * rng.randrange(2, 12) + [rng.randrange(4) for _ in range(rng.randrange(0, 4))]
        outer = unit * rng.randrange(1, 4) + [rng.randrange(3) for _ in range(rng.randrange(0, 3))]
        t = [rng.randrange(4) for _ in range(rng.randrange(20))] + outer * rng.randrange(2, 7) + outer[:rng.randrange(len(outer))]
        texts.append(t + [rng.randrange(4) for _ in range(rng.randrange(20))])
    assert found(texts) == [brute_runs(t) for t in texts]


def test_special_words():
    fib = ["a", "ab"]
    while len(fib[-1]) < 1500:
        fib.append(fib[-1] + fib[-2])
    thue = "a"
    for _ in range(9):
        thue += thue.translate(str.maketrans("ab", "ba"))
    texts = [list(fib[-1]), list(thue), ["x"] * 1000, list("ab" * 500), list("aab" * 7 + "aa"), list("abc" * 8), list("abc" * 7), [], ["x"] * 23, ["x"] * 24]
    assert found(texts) == [brute_runs(t) for t in texts]


def test_copies_beside_each_other_do_not_match():
    text = [str(i) for i in range(30)]
    assert found([text] * 6) == [[]] * 6


def test_successor():
    rng = np.random.default_rng(0)
    for n in (1, 2, 7, 64, 100):
        values = rng.permutation(n)
        tree = P.WaveletTree(values.astype(np.int64))
        lo = rng.integers(0, n, 200)
        hi = np.array([rng.integers(a, n) + 1 for a in lo])
        least = rng.integers(0, n + 3, 200)
        want = [min((v for v in values[a:b] if v >= x), default=-1) for a, b, x in zip(lo, hi, least)]
        assert tree.successor(lo, hi, least).tolist() == want


def run(spark, rows):
    return sorted((tuple(r) for r in P.digest(P.periodic_runs(P.with_planted_runs(make_docs(spark, rows)))).collect()), key=str)


def test_query_form(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice("abcdefgh") * rng.randrange(1, 4) for _ in range(rng.randrange(0, 200)))) for i in range(120)]
    rows += [(200, None), (201, ""), (202, " \t\n"), (None, "a b c d " * 30), (None, None), (203, "say it " * 40), (203, "say it " * 40), (204, "\x1fx y\x85 " * 20)]
    rows += [(i, "one two\tthree\x0bfour\x0cfive six " * 3) for i in range(300, 340)]
    assert run(spark, rows) == sorted((brute(*r) for r in rows), key=str)


def test_empty_table(spark):
    assert run(spark, []) == []


def test_very_long_texts(spark):
    rows = [(1, "x " * 300_000), (2, "y z " * 200_000 + "w")]
    got = run(spark, rows)
    assert [(r[0], r[1], r[2:6]) for r in got] == [(1, 1, (0, 300_000, 1, 300_000_000)), (2, 1, (0, 400_000, 2, 200_000_000))]


def test_query_on_the_table(spark):
    import duckdb

    from terrastate.llm.queries import QUERIES

    rows = duckdb.sql("SELECT doc_id, text FROM '/root/testdata/sf0.01/documents.parquet'").fetchall()
    got = {r[0]: tuple(r) for r in QUERIES["op12_periodic_runs"](spark, "/root/testdata/sf0.01").collect()}
    assert len(got) == len(rows)
    short = [r for r in rows if len(r[1] or "") < 12_000]
    assert [got[d] for d, _ in short] == [brute(d, t) for d, t in short]
