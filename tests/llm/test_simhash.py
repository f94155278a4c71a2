"""SimHash fingerprints and components against brute force."""

import random

import pytest
import xxhash
from pyspark.sql import functions as F

from fixtures_llm import make_docs
from terrastate.llm import simhash as S


def brute_fp(text):
    words = text.encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hs = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(rows, radius):
    fps = [brute_fp(t or "") for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                parent[max(find(i), find(j))] = min(find(i), find(j))
    groups = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(d)
    return sorted((d, f"{fps[i]:016x}", min(groups[find(i)])) for i, (d, _) in enumerate(rows))


def run(spark, rows, radius=3):
    out = S.simhash_components(spark, make_docs(spark, rows), 3, radius)
    return sorted(tuple(r) for r in out.select("doc_id", S.hex_fingerprint("fp"), "component_id").collect())


def corpus():
    rng = random.Random(5)
    vocab = ["w%d" % i for i in range(60)]
    rows = []
    for k in range(25):
        base = [rng.choice(vocab) for _ in range(rng.randint(1, 120))]
        rows.append((100 - k, " ".join(base)))
        for c in range(rng.randint(0, 4)):
            copy = list(base)
            copy[rng.randrange(len(copy))] = "Changed"
            rows.append((200 + 10 * k + c, "\n".join(copy)))
    return rows + [(900, ""), (901, None), (902, "one"), (903, "ONE"), (903, "ONE"), (904, "é x two"), (7, "long word " * 5000)]


def test_matches_brute_force(spark):
    rows = corpus()
    assert run(spark, rows) == brute_components(rows, 3)
    assert run(spark, rows, radius=12) == brute_components(rows, 12)


@pytest.mark.parametrize("partners", [512, 3])
def test_many_small_tiles_lose_no_link(spark, partners):
    rng = random.Random(2)
    base = [rng.getrandbits(63) for _ in range(40)]
    fps = sorted({b ^ (1 << rng.randrange(63)) ^ (1 << rng.randrange(63)) for b in base for _ in range(8)} | set(base))
    links = S.fingerprint_links(spark, spark.createDataFrame([(f,) for f in fps], "fp long"), 3, tile=2, partners=partners)
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in links.collect():
        parent[find(a)] = find(b)
    got = {f: find(f) for f in fps}
    for a in fps:
        for b in fps:
            if (a ^ b).bit_count() <= 3:
                assert got[a] == got[b]


def test_empty_table_and_null_ids(spark):
    assert run(spark, []) == []
    assert [r[2] for r in S.simhash_components(spark, make_docs(spark, [(None, "a b c d"), (4, "a b c d")])).select(
        "doc_id", "fp", "component_id").collect()] == [4, 4]


def test_one_row_of_each_group_stays(spark):
    rows = corpus()
    docs = make_docs(spark, rows)
    kept = S.keep_one_of_each(spark, docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, _, c in brute_components(rows, 3)})
    assert S.keep_one_of_each(spark, make_docs(spark, [(None, "a b c"), (None, "a b c"), (None, "q r s t")])).count() == 2
    assert S.keep_one_of_each(spark, make_docs(spark, [])).count() == 0


def test_columns_of_any_name_stay_as_they_are(spark):
    docs = make_docs(spark, corpus())
    for name in ("_row_key", "_n", "_Number", "root", "fp", "row_key"):
        docs = docs.withColumn(name, F.concat(F.lit(name), F.col("doc_id").cast("string")))
    kept = S.keep_one_of_each(spark, docs)
    assert kept.columns == docs.columns
    assert all(r["_row_key"] == f"_row_key{r.doc_id}" and r["_n"] == f"_n{r.doc_id}" and r["_Number"] == f"_Number{r.doc_id}" for r in kept.collect())
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, _, c in brute_components(corpus(), 3)})
