"""License scans against brute force, without any filter of the join."""

import random
import re

import pytest

from fixtures_llm import make_docs
from terrastate.llm import licenses as L


def lower(t):
    return (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def brute(rows, templates, threshold):
    out = []
    for d, t in rows:
        words = re.findall(L.WORD, lower(t))
        places = sorted((label, i) for p, label in L.PHRASES.items() for i in range(len(words)) if words[i:i + len(p.split())] == p.split())
        best = {}
        for line in lower(t).split("\n"):
            block = set(re.findall(L.WORD, line))
            for label, x in templates.items():
                x = set(x.split())
                if len(block & x) >= L.need(len(x), threshold):
                    best[label] = max(best.get(label, 0), len(block & x) / len(x))
        out.append((d, len(words), places, sorted((k, round(v, 9)) for k, v in best.items())))
    return sorted(out, key=str)


def run(spark, rows, templates, threshold):
    got = L.license_scan(spark, make_docs(spark, rows), templates, threshold=threshold).collect()
    return sorted(((r.doc_id, r.n_words, sorted((p.label, p.start) for p in r.places),
                    [(m.label, round(m.containment, 9)) for m in r.matches]) for r in got), key=str)


def corpus():
    rng = random.Random(6)
    vocab = sorted({w for t in L.TEMPLATES.values() for w in t.split()}) + ["zebra", "É", "x9"]
    rows = []
    for i in range(150):
        lines = []
        for _ in range(rng.randint(0, 5)):
            base = rng.choice(list(L.TEMPLATES.values())).split() if rng.random() < 0.6 else [rng.choice(vocab) for _ in range(rng.randint(1, 12))]
            line = [w for w in base if rng.random() < 0.9] + [rng.choice(vocab) for _ in range(rng.randint(0, 3))]
            rng.shuffle(line)
            lines.append(rng.choice([" ", "-", ", "]).join(w.upper() if rng.random() < 0.3 else w for w in line))
        rows.append((i, "\n".join(lines)))
    return rows + [(300, None), (301, ""), (302, "CC-BY cc  by. ALL rights\nreserved"), (302, "CC-BY cc  by. ALL rights\nreserved"), (None, "General public LICENSE"),
                   (303, "worK lİcense cc by"), (304, "the " * 30_000 + "cc by"), (305, "cc"), (306, "by cc")]


@pytest.mark.parametrize("threshold", [0.5, 0.8, 1.0])
def test_matches_brute_force(spark, threshold):
    assert run(spark, corpus(), L.TEMPLATES, threshold) == brute(corpus(), L.TEMPLATES, threshold)


def test_empty_table_and_digest(spark):
    assert run(spark, [], L.TEMPLATES, 0.8) == []
    r = L.digest(L.license_scan(spark, make_docs(spark, [(1, "CC BY and all rights reserved"), (2, "x")]))).orderBy("doc_id").collect()
    assert tuple(r[0]) == (1, 6, 2, 0, 3, "cc-by,reserved", "cc-by,reserved", 1.0)
    assert tuple(r[1]) == (2, 1, 0, None, None, "", "", 0.0)


def test_no_python_in_the_plan(spark):
    plan = L.digest(L.license_scan(spark, make_docs(spark, corpus())))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def brute_runs(rows, templates, threshold, run):
    out = []
    for d, t in rows:
        words, best = re.findall(L.WORD, lower(t)), {}
        for i in range(max(1, len(words) - run + 1)):
            block = set(words[i:i + run])
            for label, x in templates.items():
                x = set(x.split())
                if len(block & x) >= L.need(len(x), threshold):
                    best[label] = max(best.get(label, 0), len(block & x) / len(x))
        out.append((d, sorted((k, round(v, 9)) for k, v in best.items())))
    return sorted(out, key=str)


def wrapped():
    """Notices on two lines, also behind comment marks, and words that only a very long line joins."""
    rows = [(1, "x\nRedistribution and use in source and binary forms, with or without\nmodification, are permitted provided that"),
            (2, " * This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy"),
            (3, " ".join(["released", *["x"] * 40, "under", *["y"] * 40, "the", *["z"] * 40, "license"]))]
    rng = random.Random(8)
    for k, t in enumerate(L.TEMPLATES.values()):  # at every place of a stretch
        for before in range(40):
            words = ["zebra"] * before + [w for w in t.split() if rng.random() < 0.93] + ["x9"] * rng.randint(0, 40)
            rows.append((100 * k + 10 + before, "".join(w + rng.choice([" ", " ", "\n", "\n# "]) for w in words)))
    return rows


@pytest.mark.parametrize("threshold,run", [(0.8, L.longest(L.TEMPLATES)), (0.5, 7), (1.0, 17)])
def test_runs_match_brute_force(spark, threshold, run):
    rows = corpus() + wrapped()
    got = L.license_scan(spark, make_docs(spark, rows), L.TEMPLATES, threshold=threshold, run=run).collect()
    found = sorted(((r.doc_id, [(m.label, round(m.containment, 9)) for m in r.matches]) for r in got), key=str)
    assert found == brute_runs(rows, L.TEMPLATES, threshold, run)


def test_wrapped_notices_are_found(spark):
    scan = L.license_scan(spark, make_docs(spark, wrapped()[:3]), run=L.longest(L.TEMPLATES))
    assert {r.doc_id: r.labels for r in L.digest(scan).collect()} == {1: "bsd", 2: "mpl", 3: ""}
    assert not re.search("Python|Pandas|Arrow", scan._jdf.queryExecution().executedPlan().toString())


def test_runs_match_the_oracle(spark, tmp_path):
    import duckdb

    run = L.longest(L.TEMPLATES)
    docs = make_docs(spark, corpus()[:60] + wrapped()[:120])
    docs.write.parquet(str(tmp_path / "documents"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents/*.parquet')")
    rows = con.execute(L.oracle_sql(run=run)).fetchall()
    assert sorted(map(str, rows)) == sorted(str(tuple(r)) for r in L.digest(L.license_scan(spark, docs, run=run)).collect())


def brute_notices(rows, notices, threshold):
    out = []
    for d, t in rows:
        words, best = re.findall(L.WORD, lower(t)), {}
        for label, text, must in notices:
            x, must, run = set(text.split()), set(must.split()), L.run_length(text)
            for i in range(max(1, len(words) - run + 1)):
                block = set(words[i:i + run])
                if must <= block and len(block & x) >= L.need(len(x), threshold):
                    best[label] = max(best.get(label, 0), len(block & x) / len(x))
        out.append((d, len(words), sorted((k, round(v, 9)) for k, v in best.items())))
    return sorted(out, key=str)


def notice_corpus():
    """Notices with words left out and put in, over line ends, at any place of a stretch, beside other text."""
    rng, rows = random.Random(9), corpus()
    for k, (_, text, _) in enumerate(L.NOTICES):
        for n in range(14):
            words = ["zebra", "the", "of"] * rng.randint(0, 30)
            for w in text.split():
                words += [w] if rng.random() < 0.93 else [] if rng.random() < 0.5 else ["x9", w]
            words += [rng.choice(["the", "software", "x9"]) for _ in range(rng.randint(0, 60))]
            rows.append((1000 + 100 * k + n, "".join(w.upper() if rng.random() < 0.2 else w + rng.choice([" ", " ", ", ", "\n", "\n * "]) for w in words)))
    return rows


@pytest.mark.parametrize("threshold", [0.6, 0.8, 1.0])
def test_notices_match_brute_force(spark, threshold):
    rows = notice_corpus()
    got = L.notice_scan(spark, make_docs(spark, rows), threshold=threshold).collect()
    assert sorted(((r.doc_id, r.n_words, [(m.label, round(m.containment, 9)) for m in r.matches]) for r in got), key=str) == brute_notices(
        rows, L.NOTICES, threshold)


def test_notices_match_the_oracle(spark, tmp_path):
    import duckdb

    docs = make_docs(spark, notice_corpus())
    docs.write.parquet(str(tmp_path / "documents"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents/*.parquet')")
    rows = con.execute(L.notices_sql()).fetchall()
    assert sorted(map(str, rows)) == sorted(str(tuple(r)) for r in L.digest(L.notice_scan(spark, docs)).collect())


def test_unrelated_words_get_no_label(spark):
    rows = [(1, "the license was released under pressure"), (2, "under the weather we released a driving license"), (3, "MIT gave a license"),
            (4, "Released under\n# the MIT license."), (5, " ".join(["released", *["x"] * 9, "under", "the", *["y"] * 9, "mit", "license"])), *wrapped()[:2]]
    rows = [(k, t) for k, (_, t) in enumerate(rows, 1)]
    scan = L.notice_scan(spark, make_docs(spark, rows))
    assert {r.doc_id: r.labels for r in L.digest(scan).collect()} == {1: "", 2: "", 3: "", 4: "mit", 5: "", 6: "bsd", 7: "mpl"}
    assert not re.search("Python|Pandas|Arrow", scan._jdf.queryExecution().executedPlan().toString())


def test_notices_of_an_empty_table_and_bad_notices(spark):
    assert L.notice_scan(spark, make_docs(spark, [])).collect() == []
    for bad in ([("a", "one two", "")], [("a", "one two", "three")]):
        with pytest.raises(ValueError):
            L.notice_scan(spark, make_docs(spark, []), bad)
