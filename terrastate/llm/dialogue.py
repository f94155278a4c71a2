"""Repair of conversation structure by a run-length min-plus dynamic program.

A conversation is its rows in order of turn (nulls first; rows of one turn by
role, then by the first 64 characters and a hash of the text, so their order
never depends on the input's).  Every row has one fault at most, the first of:
*blank* (no character but white space), *duplicate* (role and text seen
earlier), *truncated* (the last character but white space ends no sentence).
The repaired roles read ``(s?(ua)+)?``: an optional system row, then user and
assistant in turns.  Edits: Keep 0, Rerole to user or assistant 3, Delete 4
(the only one for blank and duplicate rows), Insert an empty row 3; a
truncated row that stays costs 3 more.

A row is one of nine symbols (role initial and fault).  Costs still to pay are
a vector over four states (nothing yet, after system, user, assistant); a
symbol is a 4 x 4 min-plus matrix upon it.  Equal consecutive symbols are one
run, advanced by cached binary powers of its matrix; the choices inside a run
are unrolled afterwards, forwards, taking the ASCII-least edit that keeps to
the least cost (each letter leads to one state, so that is the least audit).

Rows are range-partitioned by conversation, turn, role, text and a row number
that parts equal rows, so no task grows with a conversation.  A task finishes
the conversations that lie wholly inside its range.  Those at its ends, which
may go on elsewhere, are written as *segments*: as matrices are associative,
each segment is one matrix, costs go back over a conversation's segments,
states forwards, and every segment is unrolled by itself.

Results: null role or text count as one space; null conversations are one
conversation of id null; null turns come first and count for no gap; rows
marked ``dropped`` only make their conversation appear; a conversation without
other rows has zeros, an empty audit and the hash of the empty text.  Repeated
rows are duplicates.  The empty table gives no rows.  Only the named columns
are read.  The hash of a conversation's repaired text is one sequential digest
by its nature: its pieces stream through one task, a piece at a time.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terrastate.llm.common import materialize, partitions_for

SOLID = re.compile(r"[^\x20\x09-\x0D]")
LAST_SOLID = re.compile(r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\Z")
#: States: nothing yet, after a system, a user, an assistant row.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}  # the row that may follow, of those that can be made
ROLE = {USER: "user", ASSISTANT: "assistant"}
INITIAL = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
REROLE, DELETE, INSERT, CUT = 3, 4, 3, 3
FAR = 1 << 40
#: Symbols: 0 goes in any case; else 2 * kind + cut + 1 with the kinds other, system, user, assistant.
GONE = 0
LEGAL = {"su", "ua", "au"}


def symbol(role: str, cut: bool) -> int:
    return 2 * INITIAL.get(role[:1], 0) + cut + 1


def kept_state(state: int, sym: int) -> int | None:
    """State after keeping a row of this symbol, None where its role may not stand."""
    kind = (sym - 1) >> 1
    if kind == SYSTEM:
        return SYSTEM if state == START else None
    return kind if kind and NEXT[state] == kind else None


def multiply(a: tuple, b: tuple) -> tuple:
    return tuple(tuple(min(x + b[k][j] for k, x in enumerate(row)) for j in range(4)) for row in a)


def apply(m: tuple, v: tuple) -> tuple:
    return tuple(min(x + y for x, y in zip(row, v)) for row in m)


UNIT = tuple(tuple(0 if i == j else FAR for j in range(4)) for i in range(4))
_ONE_INSERT = tuple(tuple(0 if i == j else INSERT if NEXT[i] == j else FAR for j in range(4)) for i in range(4))
INSERTS = multiply(_ONE_INSERT, _ONE_INSERT)  # more than two in a row lead where fewer do
#: Costs after the last row: nothing or an assistant may end it.
END = apply(INSERTS, (0, FAR, FAR, 0))


@lru_cache(maxsize=None)
def power(sym: int, k: int) -> tuple:
    """Transition of 2**k rows of one symbol."""
    if k:
        return multiply(power(sym, k - 1), power(sym, k - 1))
    rows = []
    for state in range(4):
        row = [FAR] * 4
        row[state] = DELETE
        if sym != GONE:
            extra = CUT * ((sym - 1) & 1)
            row[NEXT[state]] = min(row[NEXT[state]], REROLE + extra)
            if (new := kept_state(state, sym)) is not None:
                row[new] = min(row[new], extra)
        rows.append(tuple(row))
    return multiply(INSERTS, tuple(rows))


def run_matrix(sym: int, length: int) -> tuple:
    out, k = UNIT, 0
    while length:
        if length & 1:
            out = multiply(power(sym, k), out)
        length, k = length >> 1, k + 1
    return out


def advance(sym: int, length: int, v: tuple) -> tuple:
    """Costs before a run, from those behind it."""
    k = 0
    while length:
        if length & 1:
            v = apply(power(sym, k), v)
        length, k = length >> 1, k + 1
    return v


def runs_of(symbols: bytes) -> list[tuple[int, int]]:
    return [(s, sum(1 for _ in g)) for s, g in groupby(symbols)]


def matrix_of(symbols: bytes) -> tuple:
    out = UNIT
    for s, n in runs_of(symbols):
        out = multiply(out, run_matrix(s, n))
    return out


@lru_cache(maxsize=100_000)
def step(sym: int, behind: tuple) -> tuple[int, tuple]:
    """Costs before one row, less their least; ``behind`` has a least of zero (so there are few of them)."""
    v = apply(power(sym, 0), behind)
    return min(v), tuple(x - min(v) for x in v)


@lru_cache(maxsize=100_000)
def choose(sym: int, state: int, behind: tuple) -> tuple[str, int]:
    """The ASCII-least cheapest edits of one row, inserts before it included, and the state after it."""
    left = apply(power(sym, 0), behind)
    letters = ""
    while True:
        if DELETE + behind[state] == left[state]:
            return letters + "D", state
        if INSERT + left[NEXT[state]] == left[state]:
            letters, state = letters + "I", NEXT[state]
            continue
        extra = CUT * ((sym - 1) & 1)
        new = kept_state(state, sym)
        if new is not None and extra + behind[new] == left[state]:
            return letters + "K", new
        return letters + "R", NEXT[state]


def normal(v: tuple) -> tuple:
    low = min(v)
    return tuple(x - low for x in v)


def unroll(symbols: bytes, state: int, behind: tuple) -> tuple[str, int]:
    """Edits of a stretch of rows and the state after it, given the costs behind it."""
    runs = runs_of(symbols)
    ends = [normal(behind)]
    for s, n in reversed(runs[1:]):
        ends.append(normal(advance(s, n, ends[-1])))
    letters = []
    for (s, n), end in zip(runs, reversed(ends)):
        inside = [end]
        for _ in range(n - 1):
            inside.append(step(s, inside[-1])[1])
        while inside:
            edit, state = choose(s, state, inside.pop())
            letters.append(edit)
    return "".join(letters), state


def closing(state: int) -> str:
    """Inserts after the last row."""
    return {START: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}[state]


def repaired(rows: list[tuple[str, str]], audit: str, state: int) -> Iterator[str]:
    """``role:text`` of the rows that the edits leave or make."""
    at = iter(rows)
    for edit in audit:
        if edit == "I":
            state = NEXT[state]
            yield f"{ROLE[state]}:"
            continue
        role, text = next(at)
        if edit == "K":
            state = INITIAL[role[0]]
            yield f"{role}:{text}"
        elif edit == "R":
            state = NEXT[state]
            yield f"{ROLE[state]}:{text}"


class Rows:
    """Faults and figures of consecutive rows of one conversation."""

    def __init__(self):
        self.rows, self.symbols, self.fresh = [], bytearray(), []  # fresh: not yet seen in these rows
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first = self.last = self.low = self.high = None
        self.seen = set()

    def add(self, turn: int | None, role: str, text: str, known: bool | None = None) -> None:
        """``known`` tells whether role and text were seen before where these rows are only a part."""
        if self.rows and self.last + role[:1] not in LEGAL:
            self.illegal += 1
        if not self.rows:
            self.first = role[:1]
        self.last = role[:1]
        if turn is not None and turn != self.high:  # in order, so a turn is new or the last one
            self.turns, self.high = self.turns + 1, turn
            self.low = turn if self.low is None else self.low
        self.rows.append((role, text))
        solid = LAST_SOLID.search(text)
        fresh = solid is not None and (role, text) not in self.seen
        if solid is None:
            self.blank += 1
            self.symbols.append(GONE)
        elif not fresh if known is None else known:
            self.duplicate += 1
            self.symbols.append(GONE)
        else:
            cut = solid[1] not in ".!?"
            self.truncated += cut
            self.symbols.append(symbol(role, cut))
        if fresh:
            self.seen.add((role, text))
        self.fresh.append(fresh)

    def result(self) -> dict:
        """The whole row of a conversation that is all here."""
        symbols = bytes(self.symbols)
        audit, state = unroll(symbols, START, END)
        audit += closing(state)
        text = "\n".join(repaired(self.rows, audit, START))
        cost = END
        for s, n in reversed(runs_of(symbols)):
            cost = advance(s, n, cost)
        return {"gaps": self.high - self.low + 1 - self.turns if self.turns else 0, "blank": self.blank, "duplicate": self.duplicate,
                "truncated": self.truncated, "illegal": self.illegal, "cost": cost[START], "audit": audit,
                "repaired_sha256": hashlib.sha256(text.encode()).hexdigest()}


RESULT = ("gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")
RESULT_NAMES = [c.split()[0] for c in RESULT.split(", ")]
ROW = "turn long, role string, text string, copies int, fresh boolean, seq long, part long"
FIRST_PASS = f"conv_id long, {RESULT}, {ROW}"
_ARROW = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "double": pa.float64(), "binary": pa.binary()}


def to_batch(rows: list[dict], schema: str) -> pa.RecordBatch:
    fields = [pa.field(*(lambda n, t: (n, pa.list_(_ARROW[t[6:-1]]) if t.startswith("array") else _ARROW[t]))(*c.split())) for c in schema.split(", ")]
    return pa.RecordBatch.from_pylist(rows, schema=pa.schema(fields))


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for b in batches:
        yield from b.to_pylist()


def first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Conversations of one sorted part: whole ones finished, the first and the last one as they are."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    ready: list[dict] = []

    def open_rows(conv, rows):
        for seq, (r, fresh) in enumerate(rows):
            yield {"conv_id": conv, "turn": r["turn"], "role": r["role"], "text": r["text"], "copies": r["copies"], "fresh": fresh, "seq": seq, "part": part}

    def finish(conv, rows, inner: bool):
        made = Rows()
        if inner:
            for r in rows:
                for _ in range(r["copies"]):
                    made.add(r["turn"], r["role"], r["text"])
            return [{"conv_id": conv, **made.result()}]
        seen, marked = set(), []
        for r in rows:
            key = (r["role"], r["text"])
            marked.append((r, r["copies"] > 0 and key not in seen and SOLID.search(r["text"]) is not None))
            if r["copies"]:
                seen.add(key)
        return open_rows(conv, marked)

    conv, rows, number = None, [], 0
    for r in rows_of(batches):
        if rows and r["conv_id"] != conv:
            ready.extend(finish(conv, rows, number > 0))
            rows, number = [], number + 1
        conv = r["conv_id"]
        rows.append(r)
        if len(ready) >= 1_000:
            yield to_batch(ready, FIRST_PASS)
            ready = []
    if rows:
        ready.extend(finish(conv, rows, False))
    for at in range(0, len(ready), 1_000):
        yield to_batch(ready[at:at + 1_000], FIRST_PASS)


SEGMENT = ("conv_id long, part long, matrix array<long>, symbols binary, blank long, duplicate long, truncated long, illegal long, "
           "turns long, low long, high long, first string, last string")


def segment(table: pa.Table) -> pa.Table:
    """Figures, symbols and matrix of one conversation's rows in one part."""
    rows = sorted(table.to_pylist(), key=lambda r: r["seq"])
    made = Rows()
    for r in rows:
        for k in range(r["copies"]):
            made.add(r["turn"], r["role"], r["text"], known=r["known"] or k > 0)
    symbols = bytes(made.symbols)
    out = {"conv_id": rows[0]["conv_id"], "part": rows[0]["part"], "matrix": [x for row in matrix_of(symbols) for x in row], "symbols": symbols,
           "blank": made.blank, "duplicate": made.duplicate, "truncated": made.truncated, "illegal": made.illegal,
           "turns": made.turns, "low": made.low, "high": made.high, "first": made.first, "last": made.last}
    return pa.Table.from_batches([to_batch([out], SEGMENT)])


BACK = "conv_id long, part long, behind array<long>, gaps long, blank long, duplicate long, truncated long, illegal long, cost long"


def back(table: pa.Table) -> pa.Table:
    """Costs behind each of a conversation's segments, from the last to the first; its figures stand in the first's row."""
    rows = sorted(table.to_pylist(), key=lambda r: r["part"])
    behind, out = END, []
    for r in reversed(rows):
        out.append({"conv_id": r["conv_id"], "part": r["part"], "behind": list(normal(behind))})
        behind = apply(tuple(tuple(r["matrix"][i:i + 4]) for i in range(0, 16, 4)), behind)
    full = [r for r in rows if r["first"] is not None]
    timed = [r for r in rows if r["turns"]]
    # a turn that goes on in the next segment was counted in both
    turns = sum(r["turns"] for r in timed) - sum(a["high"] == b["low"] for a, b in zip(timed, timed[1:]))
    figures = {k: sum(r[k] for r in rows) for k in ("blank", "duplicate", "truncated", "illegal")}
    figures["illegal"] += sum(a["last"] + b["first"] not in LEGAL for a, b in zip(full, full[1:]))
    out[-1] |= figures | {"gaps": timed[-1]["high"] - timed[0]["low"] + 1 - turns if timed else 0, "cost": behind[START]}
    return pa.Table.from_batches([to_batch(out, BACK)])


WAYS = "conv_id long, part long, states array<long>, audits array<string>"


def ways(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edits of each segment from each of the four states, and the state after them."""
    for r in rows_of(batches):
        found = [unroll(r["symbols"], s, tuple(r["behind"])) for s in range(4)]
        yield to_batch([{"conv_id": r["conv_id"], "part": r["part"], "states": [s for _, s in found], "audits": [a for a, _ in found]}], WAYS)


FORTH = "conv_id long, part long, state long, close string"


def forth(table: pa.Table) -> pa.Table:
    """The state before each of a conversation's segments, and the inserts behind the last."""
    rows, state, out = sorted(table.to_pylist(), key=lambda r: r["part"]), START, []
    for k, r in enumerate(rows):
        after = r["states"][state]
        out.append({"conv_id": r["conv_id"], "part": r["part"], "state": state, "close": closing(after) if k == len(rows) - 1 else ""})
        state = after
    return pa.Table.from_batches([to_batch(out, FORTH)])


PIECE_BYTES = 1 << 16
PIECE = "conv_id long, part long, piece long, bytes binary"


def pieces(rows: pa.Table, edits: pa.Table) -> pa.Table:
    """Repaired text of one segment in pieces of about ``PIECE_BYTES``; each row's text ends with a line feed."""
    edit = edits.to_pylist()[0]
    texts = [(r["role"], r["text"]) for r in sorted(rows.to_pylist(), key=lambda r: r["seq"]) for _ in range(r["copies"])]
    out, held, size = [], [], 0
    for line in repaired(texts, edit["audit"], edit["state"]):
        held.append(line.encode() + b"\n")
        size += len(held[-1])
        if size >= PIECE_BYTES:
            out.append(b"".join(held))
            held, size = [], 0
    out.append(b"".join(held))
    rows = [{"conv_id": edit["conv_id"], "part": edit["part"], "piece": k, "bytes": b} for k, b in enumerate(out)]
    return pa.Table.from_batches([to_batch(rows, PIECE)])


DIGEST = "conv_id long, repaired_sha256 string"


def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each conversation's pieces, which come in order; the last line feed is held back."""
    for conv, group in groupby(rows_of(batches), key=lambda r: r["conv_id"]):
        sha, held = hashlib.sha256(), b""
        for r in group:
            if r["bytes"]:
                sha.update(held)
                sha.update(r["bytes"][:-1])
                held = b"\n"
        yield to_batch([{"conv_id": conv, "repaired_sha256": sha.hexdigest()}], DIGEST)


def same(a: DataFrame, b: DataFrame, *keys: str) -> Column:
    on = a[keys[0]].eqNullSafe(b[keys[0]])
    for k in keys[1:]:
        on = on & (a[k] == b[k])
    return on


def repair_segments(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """Conversations that may lie in several parts, a segment at a time."""
    # of equal rows of a conversation the first part's first one is no duplicate: one row a part meets the others here
    earlier = F.row_number().over(Window.partitionBy("conv_id", "role", "text").orderBy("part")) > 1
    marked = (rows.where("fresh").withColumn("known", earlier)
              .unionByName(rows.where("NOT fresh").withColumn("known", F.lit(True))))
    segments = materialize(spark, marked.groupBy("conv_id", "part").applyInArrow(segment, SEGMENT), "dialogue-segments")
    behind = materialize(spark, segments.drop("symbols").groupBy("conv_id").applyInArrow(back, BACK), "dialogue-costs")
    met = segments.join(behind, same(segments, behind, "conv_id", "part")).select(segments.conv_id, segments.part, "symbols", "behind")
    tried = materialize(spark, met.mapInArrow(ways, WAYS), "dialogue-ways")
    states = tried.select("conv_id", "part", "states").groupBy("conv_id").applyInArrow(forth, FORTH)
    edits = tried.join(states, same(tried, states, "conv_id", "part")).select(
        tried.conv_id, tried.part, "state", F.concat(F.get("audits", F.col("state").cast("int")), "close").alias("audit"))
    edits = materialize(spark, edits, "dialogue-edits")
    audits = edits.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "audit"))), lambda x: x["audit"]), "").alias("audit"))
    cut = rows.groupBy("conv_id", "part").cogroup(edits.groupBy("conv_id", "part")).applyInArrow(pieces, PIECE)
    hashes = (cut.repartition("conv_id").sortWithinPartitions("conv_id", "part", "piece").mapInArrow(digests, DIGEST))
    figures = behind.where("cost IS NOT NULL").drop("part", "behind")
    out = figures.join(audits, same(figures, audits, "conv_id")).drop(audits.conv_id)
    return out.join(hashes, same(out, hashes, "conv_id")).drop(hashes.conv_id).select("conv_id", *RESULT_NAMES)


def repair(spark: SparkSession, rows: DataFrame, part_bytes: int = 32 << 20) -> DataFrame:
    """Faults, cheapest edits and digest of every conversation.

    ``rows``: conv_id, turn, role, text, copies (how often the row stands there; 0: it is dropped).  Returns conv_id,
    gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.
    """
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                       F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
                       F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"), F.col("copies").cast("int").alias("copies"))
    total = rows.agg(F.sum(F.octet_length("text") + 64).alias("n")).first().n or 0
    order = ["conv_id", "turn", "role", F.substring("text", 1, 64), F.xxhash64("text"), "tie"]
    parts = (rows.withColumn("tie", F.monotonically_increasing_id())
             .repartitionByRange(partitions_for(spark, total, part_bytes), *order).sortWithinPartitions(*order).drop("tie"))
    seen = materialize(spark, parts.mapInArrow(first_pass, FIRST_PASS), "dialogue-parts")
    whole = seen.where("part IS NULL").select("conv_id", *RESULT_NAMES)
    return whole.unionByName(repair_segments(spark, seen.where("part IS NOT NULL").select("conv_id", *[c.split()[0] for c in ROW.split(", ")])))


def damaged(conversations: DataFrame) -> DataFrame:
    """The query's damage: by crc32(conv_id:turn) % 20, 0 drops the row, 1 empties its text, 2 takes out its sentence
    ends, 3 repeats it, 4 makes it the user's (null columns: one space)."""
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    h = F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn")).cast("binary")) % 20
    return conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.when(h == 4, F.lit("user")).otherwise(text_of("role")).alias("role"),
        F.when(h == 1, F.lit("")).when(h == 2, F.regexp_replace(text_of("text"), "[.!?]", "")).otherwise(text_of("text")).alias("text"),
        F.when(h == 0, 0).when(h == 3, 2).otherwise(1).alias("copies"))
