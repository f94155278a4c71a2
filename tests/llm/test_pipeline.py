"""The pipeline's stages, each held against brute force on its own input."""

import os
import sys

import numpy as np

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import corpus_pipeline as P  # noqa: E402
from fixtures_llm import make_docs  # noqa: E402
from terrastate.llm import decontaminate, quality, repeats  # noqa: E402
from terrastate.llm.common import materialize, tokenizer_path  # noqa: E402
from test_packing import brute_pieces  # noqa: E402
from test_simhash import brute_components  # noqa: E402

SF = "/root/testdata/sf0.001"


def brute_kept(rows, w=50):
    """Texts without the bytes of any 50-byte string that also starts in a document of smaller id."""
    first = {}
    for d, t in rows:
        b = t.encode()
        for i in range(len(b) - w + 1):
            s = b[i:i + w]
            first[s] = min(first.get(s, repeats.NO_ID), d)
    out = {}
    for d, t in rows:
        b = t.encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - w + 1):
            if first[b[i:i + w]] < d:
                gone[i:i + w] = True
        out[d] = np.frombuffer(b, np.uint8)[~gone].tobytes().decode("utf-8", "ignore")
    return out


def test_each_stage_does_its_work(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, steps = docs.columns, {}
    for name, stage in P.STAGES:
        before = docs
        docs = materialize(spark, stage(spark, docs, SF), name)
        steps[name] = (before, docs)
        assert name == "best_fit_packing" or docs.columns == columns

    def ids(df):
        return sorted(r.doc_id for r in df.select("doc_id").collect())

    before, after = steps["quality_classifier"]
    scores = quality.quality_scores(spark, before, spark.read.parquet(f"{SF}/labels.parquet"))
    assert ids(after) == ids(scores.filter("predicted = 1")) and 0 < after.count() < before.count()

    before, after = steps["simhash_near_dedup"]
    assert ids(after) == sorted({c for _, _, c in brute_components([(r.doc_id, r.text) for r in before.collect()], 3)})

    before, after = steps["suffix_array_dedup"]
    kept = {r.doc_id: (r.text, r.n_chars) for r in after.collect()}
    assert kept == {d: (t, len(t)) for d, t in brute_kept([(r.doc_id, r.text) for r in before.collect()]).items()}

    before, after = steps["benchmark_decontamination"]
    found = decontaminate.contamination(spark, before, spark.read.parquet(f"{SF}/benchmark.parquet"))
    assert ids(after) == sorted(set(ids(before)) - {r.doc_id for r in found.collect()})

    before, after = steps["best_fit_packing"]
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in after.collect()), key=str) == brute_pieces(
        [(r.doc_id, r.text) for r in before.collect()], 1024)
    assert tokenizer_path("byte_bpe_50k.json")


def test_odd_rows_pass_through_every_stage(spark, tmp_path):
    sf = str(tmp_path)
    spark.createDataFrame([(1, 1, 0), (2, None, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, None), (None, "a b c d e f")], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    for rows in ([], [(1, None), (None, None), (None, "x y"), (2, ""), (2, ""), (3, "word " * 20_000), (3, "other"), (4, "a b c d e f")]):
        docs = make_docs(spark, rows)
        for name, stage in P.STAGES:
            out = materialize(spark, stage(spark, docs, sf), name)
            assert name == "best_fit_packing" or out.columns == docs.columns
            docs = out
        assert (docs.count() > 0) == bool(rows)


def test_the_last_stage_keeps_the_ids(spark):
    out = P.packing_stage(spark, make_docs(spark, [(1, "a b c"), (2, None)]), SF)
    assert sorted((r.doc_id, len(r.ids), r.ids[-1]) for r in out.collect()) == [(1, 4, 2), (2, 1, 2)]
