"""Language-model scores: exact counts and base score, normalised model, better than the base on held-out texts."""

import math
import random
import zlib
from collections import Counter

import numpy as np

from fixtures_llm import make_docs
from terrastate.llm import lm


def held(d):
    return d is None or zlib.crc32(str(d).encode()) % 10 == 0


def brute(rows):
    toks = {i: [*(t or "").encode().lower().split(), b""] for i, (_, t) in enumerate(rows)}
    c = Counter(w for i, (d, _) in enumerate(rows) if not held(d) for w in toks[i])
    n, v = sum(c.values()), len(c)
    return sorted(((d, held(d), len(toks[i]), sum(c[w] > 0 for w in toks[i]), n,
                    round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in toks[i]), 6)) for i, (d, _) in enumerate(rows)), key=str)


def run(spark, rows, **options):
    out = lm.lm_scores(spark, make_docs(spark, rows), **({"steps": 60, "batch": 256} | options)).collect()
    assert all(math.isfinite(r.score) and r.score <= 1e-9 for r in out)
    return out, sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in out), key=str)


def corpus(n):
    rng = random.Random(8)
    langs = [["".join(rng.choice(a) for _ in range(rng.randint(1, 4))) for _ in range(400)] for a in ("abcd", "wxyzé")]
    return [(i, " ".join(rng.choice(langs[i % 2]).title() for _ in range(rng.randint(5, 60)))) for i in range(n)]


def test_counts_and_base_score_are_exact(spark):
    rows = corpus(120) + [(500, None), (501, ""), (502, "a\tA\x0ba b"), (502, "a\tA\x0ba b"), (None, "null id"), (503, "abc " * 20_000)]
    for top in (3, 5_000):
        assert run(spark, rows, top=top)[1] == brute(rows)


def test_better_than_the_base_on_held_out_texts(spark):
    out, _ = run(spark, corpus(600), steps=400, batch=512)
    out = [r for r in out if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_tables_without_training_texts(spark):
    assert run(spark, [])[0] == []
    only = [d for d in range(300) if held(d)][:3]
    out, exact = run(spark, [(d, "a b") for d in only])
    assert exact == brute([(d, "a b") for d in only]) and all(r.score == r.base_score == 0 for r in out)


def test_model_is_normalised_and_learns_contexts():
    model = lm.LogBilinear(8, 12, 3)
    cells = np.array([(a, b, (a + 3) % 8) for a in range(8) for b in range(8)])
    model.train(cells, np.ones(64), 1500, 256, 10, 0.05)
    table = model.log10_table()
    assert np.allclose((10 ** table).sum(-1), 1)
    assert table[cells[:, 0], cells[:, 1], cells[:, 2]].mean() > math.log10(1 / 8) + 0.3


def test_training_takes_every_cell_by_its_full_count():
    cells = np.array([(a, b, (a + b) % 6) for a in range(6) for b in range(6)])
    counts = np.where(np.arange(36) == 7, 1.0, 1e7)  # a cell that hardly any draw would meet

    def table(cells, counts, batch):
        model = lm.LogBilinear(6, 8, 3)
        model.train(cells, counts, 40, batch, 10, 0.05)
        return model.log10_table()

    whole = table(cells, counts, 1000)
    assert np.allclose(whole, table(cells, counts, 5), atol=1e-9)
    assert np.allclose(whole, table(cells[::-1], counts[::-1] * 3, 1000), atol=1e-3)
    rare = np.concatenate([counts, [2.0]])  # counts of a cell add up
    assert np.allclose(table(np.concatenate([cells, cells[7:8]]), rare, 1000), table(cells, counts + 2 * (np.arange(36) == 7), 1000), atol=1e-9)


def test_classes_follow_the_vocabulary():
    assert [lm.classes_of_a_kind(n) for n in (0, 1_000, 100_000, 10 ** 9)] == [lm.LEAST, lm.LEAST, 46, lm.MOST]
    assert 2 * lm.MOST <= 256  # a class is a byte
