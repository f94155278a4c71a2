"""Decontamination: tiling against its definition, planted passages, clean documents."""

import random

from fixtures_llm import make_docs
from terrastate.llm import decontaminate as D


def naive_tiles(item, text, n):
    """Greedy string tiling by its definition: mark a longest unmarked common run until none has ``n`` words."""
    im, tm, total = [False] * len(item), [False] * len(text), 0
    while True:
        best = 0, 0, 0
        for i in range(len(item)):
            for j in range(len(text)):
                k = 0
                while i + k < len(item) and j + k < len(text) and item[i + k] == text[j + k] and not im[i + k] and not tm[j + k]:
                    k += 1
                if k > best[0]:
                    best = k, i, j
        k, i, j = best
        if k < n:
            return total
        im[i:i + k] = [True] * k
        tm[j:j + k] = [True] * k
        total += k


def test_tiling_follows_its_definition():
    rng = random.Random(3)
    for _ in range(150):
        item = [rng.randint(1, 30) for _ in range(rng.randint(1, 25))]
        text = [rng.randint(1, 30) for _ in range(10)]
        for _ in range(3):
            a = rng.randrange(len(item))
            text += item[a:a + rng.randint(1, 12)] + [rng.randint(31, 40)]
        tiles = D.tile(item, text, 3)
        assert all(item[i:i + k] == text[j:j + k] and k >= 3 for i, j, k in tiles)
        assert len({x for i, _, k in tiles for x in range(i, i + k)}) == len({x for _, j, k in tiles for x in range(j, j + k)}) == sum(k for _, _, k in tiles)
        assert [k for _, _, k in tiles] == sorted((k for _, _, k in tiles), reverse=True)
        if tiles or naive_tiles(item, text, 3):
            assert abs(sum(k for _, _, k in tiles) - naive_tiles(item, text, 3)) <= 3  # ties may be broken otherwise


def corpus():
    rng = random.Random(8)
    vocab = ["w%d" % i for i in range(500)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randint(15, 50)))) for i in range(12)]
    filler = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    rows, dirty = [], {}
    for i, t in items:
        w = t.split()
        moved = w[len(w) // 2:] + ["xx"] + w[:len(w) // 2]
        rows += [(100 + i, filler(40) + " " + t + " " + filler(30)), (200 + i, filler(10) + " " + " ".join(moved).upper() + "! " + filler(5)),
                 (300 + i, filler(20) + " " + " ".join(w[:len(w) // 3]) + " " + filler(20)), (400 + i, filler(80))]
        dirty |= {100 + i: i, 200 + i: i}
    return items, rows, dirty


def bench(spark, items):
    return spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")


def test_planted_passages(spark):
    items, rows, dirty = corpus()
    for block_words in (500_000, 60):
        got = D.contamination(spark, make_docs(spark, rows), bench(spark, items), block_words=block_words).collect()
        assert {(r.doc_id, r.item_id) for r in got} == set(dirty.items())
        assert all(0.6 <= r.coverage <= 1 and r.covered_words == round(r.coverage * r.item_words) for r in got)
        kept = D.keep_clean(spark, make_docs(spark, rows), bench(spark, items), block_words=block_words)
        assert {r.doc_id for r in kept.collect()} == {d for d, _ in rows} - set(dirty)


def test_edge_rows(spark):
    items = [(1, "one two three four five six"), (1, "one two three four five six"), (2, None), (3, "too short"), (None, "seven eight nine ten eleven")]
    rows = [(1, None), (2, ""), (3, "too short"), (4, "ONE two, three four five six"), (4, "ONE two, three four five six"),
            (None, "x seven eight nine ten eleven"), (5, "word " * 50_000 + "one two three four five six")]
    got = sorted(((r.doc_id, r.item_id) for r in D.contamination(spark, make_docs(spark, rows), bench(spark, items)).collect()), key=str)
    assert got == sorted([(4, 1)] * 4 + [(None, None)] + [(5, 1)] * 2, key=str)
    docs = make_docs(spark, rows)
    kept = D.keep_clean(spark, docs, bench(spark, items))
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2, 3]
    assert D.contamination(spark, make_docs(spark, []), bench(spark, items)).count() == 0
    assert D.contamination(spark, make_docs(spark, rows), bench(spark, [])).count() == 0
    assert D.keep_clean(spark, make_docs(spark, rows), bench(spark, [])).count() == len(rows)


def test_the_longest_match_is_found():
    rng = random.Random(5)
    for _ in range(200):
        a, b = ([rng.randint(1, 4) for _ in range(rng.randint(1, 40))] for _ in range(2))
        want = max((n for n in range(1, 41) for i in range(len(a) - n + 1) for j in range(len(b) - n + 1) if a[i:i + n] == b[j:j + n]), default=0)
        assert D.longest_match(D.Rolling(a), D.Rolling(b), 1, 40) == want


def test_long_items_take_no_longer_than_their_words():
    import time

    rng = random.Random(6)
    item = [rng.randint(1, 3000) for _ in range(4000)]
    pieces = [item[a:a + rng.randint(20, 300)] for a in range(0, 4000, 150)]
    rng.shuffle(pieces)
    text = [w for p in pieces for w in [*p, 5000]]
    before = time.process_time()
    tiles = D.tile(item, text, 5)
    assert time.process_time() - before < 1  # 29 s by falling lengths
    assert sum(n for _, _, n in tiles) > 3000
    before = time.process_time()
    assert D.tile([1] * 4000, [1] * 9000, 5) == [(0, 0, 4000)] and sum(n for _, _, n in D.tile([1, 2] * 2000, [1, 2, 3] * 3000, 2)) == 4000
    assert time.process_time() - before < 1


def test_short_items_and_scripts_without_spaces(spark):
    items = [(1, "what is a quark"), (2, "北京是中国的首都"), (3, "Yes, sir"), (4, "東京タワー")]
    rows = [(1, "so: What is a quark? Nobody knows"), (2, "is a quark what"), (3, "他说北京是中国的首都。"), (4, "yes sir"), (5, "what is a muon"),
            (6, "中国的北京"), (7, "昨日東京タワーへ")]
    got = sorted((r.doc_id, r.item_id, r.item_words) for r in D.contamination(spark, make_docs(spark, rows), bench(spark, items)).collect())
    assert got == [(1, 1, 4), (3, 2, 8), (7, 4, 5)]
