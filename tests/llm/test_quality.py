"""Quality classifier: held-out accuracy, calibration, and defined edge cases."""

import random

import numpy as np

from fixtures_llm import make_docs
from terrastate.llm import quality as Q
from terrastate.llm.queries import QUERIES


def corpus(n=400):
    rng = random.Random(9)
    vocab = ["".join(rng.choice("abcdeiou") for _ in range(rng.randint(2, 9))) for _ in range(300)]
    rows, marks = [], []
    for i in range(n):
        words = [rng.choice(vocab) for _ in range(rng.randint(20, 80))]
        good = rng.random() < 0.7
        rows.append((i, " ".join(words) if good else " ".join(w.upper() + "!!" for w in words)))
        marks.append((i, int(good), 0))
    return rows, marks


def labels(spark, marks):
    return spark.createDataFrame(marks, "doc_id long, quality int, toxic int")


def test_learns_and_holds_out(spark):
    rows, marks = corpus()
    got = Q.quality_scores(spark, make_docs(spark, rows), labels(spark, marks)).collect()
    truth = {d: q for d, q, _ in marks}
    held = [r for r in got if r.held_out]
    assert len(got) == len(rows) and 40 < len(held) < 120
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)


def test_edge_rows(spark):
    rows, marks = corpus(120)
    rows += [(500, None), (501, ""), (501, ""), (None, "a b"), (502, "word " * 40_000), (503, "\n\n"), (504, "é漢😀")]
    marks += [(500, None, 0), (None, 1, 0), (501, 1, 0), (501, 0, 0), (9999, 1, 1)]
    got = Q.quality_scores(spark, make_docs(spark, rows), labels(spark, marks))
    assert got.count() == len(rows) and got.filter("score IS NULL OR score < 0 OR score > 1").count() == 0
    assert Q.quality_scores(spark, make_docs(spark, []), labels(spark, marks)).count() == 0
    alone = Q.quality_scores(spark, make_docs(spark, rows), labels(spark, [])).collect()
    assert {round(r.score, 2) for r in alone} == {0.5}
    only = Q.quality_scores(spark, make_docs(spark, rows), labels(spark, [(d, 1, 0) for d, _, _ in marks if d is not None])).collect()
    assert all(r.predicted == 1 for r in only)


def test_filter_agrees_with_the_scores(spark):
    rows, marks = corpus(150)
    docs, marks = make_docs(spark, rows), labels(spark, marks)
    kept = Q.keep_good(spark, docs, marks)
    assert kept.columns == docs.columns
    scored = Q.quality_scores(spark, docs, marks)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in scored.filter("predicted = 1").collect())


def test_isotonic_is_the_least_squares_fit():
    x = np.arange(6.0)
    knots, levels = Q.isotonic(x, np.array([0, 1, 0, 1, 1, 0.0]), np.ones(6))
    got = np.interp(x, knots, levels)
    assert (np.diff(got) >= 0).all() and np.allclose(got, [0, 0.5, 0.5, 2 / 3, 2 / 3, 2 / 3])


def test_registered_query_on_the_tables(spark):
    sf = "/root/testdata/sf0.001"
    got = QUERIES["op3_quality_classifier"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    assert sum(r.predicted == r.quality for r in got) >= 0.9 * len(got)
