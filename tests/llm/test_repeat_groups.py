"""Maximal repeats with all their occurrences, against their definition."""

import hashlib
import random
from collections import defaultdict

import pytest

from fixtures_llm import make_docs
from terrastate.llm import repeat_groups as G
from terrastate.llm import repeats as R


def brute(rows, window):
    texts = [(d, (t or "").encode()) for d, t in rows]
    places = defaultdict(list)
    for n in range(window, max((len(t) for _, t in texts), default=0) + 1):
        here = defaultdict(list)
        for k, (_, t) in enumerate(texts):
            for i in range(len(t) - n + 1):
                here[t[i:i + n]].append((k, i))
        again = {s: p for s, p in here.items() if len(p) > 1}
        if not again:
            break
        places.update(again)
    out = []
    for s, p in places.items():
        left = [texts[k][1][i - 1] if i else ("start", k, i) for k, i in p]
        right = [texts[k][1][i + len(s)] if i + len(s) < len(texts[k][1]) else ("end", k) for k, i in p]
        if len(set(left)) > 1 and len(set(right)) > 1:
            out += [(hashlib.sha256(s).hexdigest(), len(s), texts[k][0], i) for k, i in p]
    return sorted(out, key=str)


def corpus(seed, n=40):
    rng = random.Random(seed)
    text = lambda k: "".join(rng.choice("abcd é") for _ in range(k))
    passages = [text(rng.randint(10, 60)) for _ in range(5)]
    rows = []
    for i in range(n):
        parts = [text(rng.randint(0, 30))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            a, b = sorted((rng.randint(0, len(p)), rng.randint(0, len(p))))
            parts += [p[a:b] if rng.random() < 0.5 else p, text(rng.randint(0, 20))]
        rows.append((i, "".join(parts)))
    return rows + [(900, None), (901, ""), (902, "x" * 60), (903, "ab" * 30), (1, passages[0]), (1, passages[0]), (None, passages[0]), (904, rows[3][1]), (905, rows[3][1])]


@pytest.mark.parametrize("seed,window,sizes", [(1, 12, {}), (2, 20, {"chunk_bytes": 300, "shard_bytes": 900}), (3, 15, {"chunk_bytes": 500, "shard_bytes": 900, "heavy": 1})])
def test_matches_the_definition(spark, monkeypatch, seed, window, sizes):
    monkeypatch.setattr(R, "HEAVY_BYTES", 1 << 60)
    rows = corpus(seed)
    monkeypatch.setattr(G, "GRAM", 6)
    got = G.repeat_groups(spark, make_docs(spark, rows).repartition(3), window=window, **sizes).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows, window)


def test_long_repeats_are_one_group(spark):
    rng = random.Random(4)
    long = "".join(rng.choice("abcdefgh ") for _ in range(5_000))
    rows = [(1, "x" + long + "y"), (2, "z" + long), (3, long[1000:1100] + "!")]
    got = {(r.length, r.doc_id, r.offset) for r in G.repeat_groups(spark, make_docs(spark, rows)).collect()}
    assert got == {(5000, 1, 1), (5000, 2, 1), (100, 1, 1001), (100, 2, 1001), (100, 3, 0)}
    assert G.repeat_groups(spark, make_docs(spark, [])).collect() == []
