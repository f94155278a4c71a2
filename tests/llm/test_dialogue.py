"""Conversation repair against an exhaustive search."""

import hashlib
import random
import re
import zlib
from functools import lru_cache

import pytest

from terrastate.llm import dialogue as D

LETTERS = {"u": "user", "a": "assistant"}


def brute_edits(rows):
    """Cheapest (cost, audit, texts) by plain recursion over rows and role strings, ties by the whole audit."""
    legal = re.compile(r"(s?(ua)+)?")

    @lru_cache(maxsize=None)
    def best(i, last):  # last: "" before all, else the last role initial
        found = []
        follow = {"": "su", "s": "u", "u": "a", "a": "u"}[last]
        if i == len(rows):
            if last in ("", "a"):
                found.append((0, "", ()))
        else:
            role, text, fault = rows[i]
            c, e, t = best(i + 1, last)
            found.append((c + 4, "D" + e, t))
            if fault not in ("blank", "duplicate"):
                more = 3 * (fault == "truncated")
                if role[:1] and role[:1] in follow:
                    c, e, t = best(i + 1, role[:1])
                    found.append((c + more, "K" + e, (f"{role}:{text}", *t)))
                for new in set(follow) - {"s"}:
                    c, e, t = best(i + 1, new)
                    found.append((c + 3 + more, "R" + e, (f"{LETTERS[new]}:{text}", *t)))
        depth = best_depth.get((i, last), 0)
        if depth < 1:  # an insert leads to another role; never round in a circle
            best_depth[(i, last)] = 1
            for new in set(follow) - {"s"}:
                if not best_depth.get((i, new)):
                    c, e, t = best.__wrapped__(i, new)
                    found.append((c + 3, "I" + e, (f"{LETTERS[new]}:", *t)))
            best_depth[(i, last)] = 0
        return min(found) if found else (10**9, "", ())

    best_depth = {}
    cost, audit, texts = best(0, "")
    kept = "".join(t[0] for t in texts)
    assert legal.fullmatch(kept)
    return cost, audit, texts


def brute(rows):
    """Expected rows of the query from (conv_id, turn, role, text)."""
    convs = {}
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        conv_s, turn_s = (" " if x is None else str(x) for x in (conv, turn))
        h = zlib.crc32(f"{conv_s}:{turn_s}".encode()) % 20
        kept = convs.setdefault(conv, [])
        if h == 1:
            text = ""
        if h == 2:
            text = re.sub("[.!?]", "", text)
        if h == 4:
            role = "user"
        kept.extend([(turn, role, text)] * (0 if h == 0 else 2 if h == 3 else 1))
    out = []
    for conv, kept in convs.items():
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, marked = set(), []
        for _, role, text in kept:
            solid = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else ""
            seen.add((role, text))
            marked.append((role, text, fault))
        cost, audit, texts = brute_edits(marked)
        turns = [t for t, _, _ in kept if t is not None]
        out.append((conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
                    *[sum(m[2] == k for m in marked) for k in ("blank", "duplicate", "truncated")],
                    sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(marked, marked[1:])),
                    cost, audit, hashlib.sha256("\n".join(texts).encode()).hexdigest()))
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0))


SCHEMA = "conv_id long, turn long, role string, text string, cost string, part string, audit string, known string"


def run(spark, rows, part_bytes=32 << 20):
    frame = spark.createDataFrame([(*r, "x", "y", "z", "w") for r in rows], SCHEMA)
    out = D.repair(spark, D.damaged(frame), part_bytes=part_bytes)
    return sorted((tuple(r) for r in out.collect()), key=lambda r: (r[0] is not None, r[0] or 0))


def some_rows(seed, convs, longest):
    rng = random.Random(seed)
    rows = []
    for c in range(convs):
        for t in range(rng.randrange(1, longest)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            text = rng.choice(["Yes.", "Well", "", " \t", None, "No!", "Ende? ", f"{t} ok.", f"{c}", "Same words here."])
            rows.append((c if c else None, rng.choice([t, t, t, t + 1, None]), role, text))
    rng.shuffle(rows)
    return rows


def test_edits_equal_an_exhaustive_search():
    rng = random.Random(3)
    for _ in range(300):
        made = D.Rows()
        for t in range(rng.randrange(0, 9)):
            made.add(t, rng.choice(["user", "assistant", "system", "x"]), rng.choice(["a.", "b", "", "c!", "d."]))
        marked, seen = [], set()
        for role, text in made.rows:
            fault = "blank" if not text else "duplicate" if (role, text) in seen else "truncated" if text[-1] not in ".!?" else ""
            seen.add((role, text))
            marked.append((role, text, fault))
        cost, audit, texts = brute_edits(marked)
        got = made.result()
        assert (got["cost"], got["audit"]) == (cost, audit)
        assert got["repaired_sha256"] == hashlib.sha256("\n".join(texts).encode()).hexdigest()


def test_runs_are_advanced_as_single_rows():
    for sym in range(9):
        v = D.END
        for n in range(1, 40):
            v = D.apply(D.power(sym, 0), v)
            assert D.advance(sym, n, D.END) == v == D.apply(D.run_matrix(sym, n), D.END)


@pytest.mark.parametrize("part_bytes", [32 << 20, 400, 1])
def test_whole_and_cut_conversations(spark, part_bytes):
    rows = some_rows(1, 30, 14)
    assert run(spark, rows, part_bytes) == brute(rows)


def test_one_conversation_with_most_rows(spark):
    rows = [(7, t, "user" if t % 2 else "assistant", "Again and again." if t % 3 else f"turn {t}") for t in range(200)]
    rows += [(c, t, "user", "Hi.") for c in (1, 9) for t in range(2)]
    assert run(spark, rows, 300) == brute(rows)


def test_equal_rows_and_nulls(spark):
    rows = [(5, 1, "user", "Same.")] * 60 + [(None, None, None, None)] * 3 + [(6, None, "system", "Be kind.")]
    assert run(spark, rows, 200) == brute(rows)


def test_empty_table_and_dropped_conversations(spark):
    assert run(spark, []) == []
    conv = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    assert run(spark, [(conv, 0, "user", "Gone.")]) == [(conv, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_long_text(spark):
    rows = [(1, 0, "user", "word " * 400_000 + "."), (1, 1, "assistant", "Fine.")]
    assert run(spark, rows) == brute(rows)


def test_query_on_the_table(spark):
    import duckdb

    from terrastate.llm.queries import QUERIES

    rows = duckdb.sql("SELECT conv_id, turn, role, text FROM '/root/testdata/sf0.01/conversations.parquet'").fetchall()
    out = QUERIES["op13_conversation_repair"](spark, "/root/testdata/sf0.01")
    assert sorted(tuple(r) for r in out.collect()) == brute(rows)
