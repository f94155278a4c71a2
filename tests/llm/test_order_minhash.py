"""Order MinHash fingerprints and edited texts against brute force."""

import hashlib
import random
import re

import pytest

from fixtures_llm import make_docs
from terrastate.llm import order_minhash as O


def edited_rows(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    out = []
    for i, (d, t) in enumerate(order):
        t, nxt = t or "", order[(i + 1) % len(order)][1] or ""
        h = len(t) // 2
        out.append((d, len(t), hashlib.sha256((t[:len(t) - h] + nxt[:h]).encode()).hexdigest()))
    return sorted(out, key=str)


def corpus(n=60):
    rng = random.Random(4)
    vocab = ["w%d" % i for i in range(200)] + ["é", "漢字", "😀"]
    rows = [(7 * i, " ".join(rng.choice(vocab) for _ in range(rng.randint(30, 200)))) for i in range(n)]
    return rows + [(5000, None), (5001, ""), (5002, "one"), (None, "null id text"), (5003, "again " * 20_000), (5004, "a\nb\tc  d")]


@pytest.mark.parametrize("per_task", [2_000, 9])
def test_next_document_and_edit(spark, per_task, monkeypatch):
    monkeypatch.setattr(O.with_next, "__defaults__", (per_task, 1_000))
    rows = corpus()
    got = O.edited_fingerprints(spark, make_docs(spark, rows)).collect()
    assert sorted(((r.doc_id, r.n_chars, hashlib.sha256(r.edited.encode()).hexdigest()) for r in got), key=str) == edited_rows(rows)


def test_repeated_ids_and_rows_keep_every_row(spark):
    rows = [(1, "a b c"), (1, "a b c"), (1, "x"), (None, "y"), (None, "y")]
    assert O.edited_fingerprints(spark, make_docs(spark, rows)).count() == 5
    assert O.edited_fingerprints(spark, make_docs(spark, [])).count() == 0
    one = O.edited_fingerprints(spark, make_docs(spark, [(3, "abcd")])).first()
    assert one.edited == "abab"


def test_fingerprints(spark):
    rng = random.Random(1)
    words = ["w%d" % i for i in range(400)]
    swapped = words[200:] + words[:200]
    changed = [w if rng.random() < 0.95 else "x" + w for w in words]
    shuffled = rng.sample(words, len(words))
    rows = [(0, " ".join(words)), (1, "\n".join(words)), (2, " ".join(changed)), (3, " ".join(shuffled)), (4, " ".join(swapped)), (5, ""), (6, None), (7, "z")]
    fp = {r.doc_id: r.fingerprint for r in O.order_minhash(make_docs(spark, rows)).collect()}
    assert all(len(f) == O.SKETCHES * O.DIGITS for f in fp.values()) and fp[0] == fp[1] and fp[5] == fp[6] != fp[7]
    pairs = spark.createDataFrame([(i, fp[0], fp[i]) for i in fp], "i long, a string, b string")
    near = {r.i: r.n for r in pairs.select("i", O.likeness("a", "b").alias("n")).collect()}
    assert near[1] == 1 and near[2] > 0.5 and near[3] < 0.1 and near[5] == near[7] == 0
    assert near[2] > near[4] > near[3]  # a moved half costs more than scattered changes, less than a shuffle


def test_occurrences_count(spark):
    rows = [(0, "a b " * 10), (1, "a b " * 11), (2, "a b " * 400)]
    fp = {r.doc_id: r.fingerprint for r in O.order_minhash(make_docs(spark, rows)).collect()}
    assert len(set(fp.values())) == 3


def test_no_python_in_the_plan(spark):
    plan = O.edited_fingerprints(spark, make_docs(spark, corpus()))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_rows_without_id_form_one_chain_too(spark):
    rows = [(None, f"text {i} of many") for i in range(150)] + [(i, f"own {i}") for i in range(20)]
    got = O.with_next(spark, make_docs(spark, rows), per_task=7).select("doc_id", "text", "next_text").collect()
    after, at, seen = {r.text: r.next_text for r in got}, "own 19", []
    while at not in seen:
        seen.append(at)
        at = after[at]
    assert len(got) == len(seen) == 170 and seen[:20] == [f"own {i}" for i in range(19, -1, -1)] and at == "own 19"
