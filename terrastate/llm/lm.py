"""Language-model scores of whole texts by a log-bilinear neural model.

A token is a lower-cased word or the end of its text.  The model gives
P(class of the token | classes of the two before) times P(token | its class):
the most frequent words are classes of their own, all others fall in classes by
their first two characters; their number grows with the counted vocabulary, up to
``MOST`` of each kind.  The class model is log-bilinear (two context matrices
over class vectors), trained in numpy with noise-contrastive estimation: each
step goes over the class trigrams of all training texts by their full counts,
with the expected counts of the noise, so nothing is drawn; batched matrix
products then give the normalised log-probability of every class in every context.
Within a class a seen word has its share of the class's count, and what the
words seen once make up (Good-Turing) goes to the event of an unseen word.

The base score is the add-0.1 unigram score.  Counts cover every training text;
the counts of frequent words are broadcast (a fixed number), those of all others
are joined.

Results: a null or empty text is its end alone; repeated rows count and are
scored each; rows with a null id are held out; with no training text the base
score is zero and the model's score equals it; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrastate.llm.common import crc_mod, materialize, text_rows

END = ""  # no word is empty
#: Classes of one frequent word each (the end first), and as many by first characters.  A step of the training costs
#: the third power of their number, in time and in the cells of a task and of the broadcast table.
LEAST, MOST = 32, 48
PREFIX = 2
FLUSH = 400_000


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split()


def classes_of_a_kind(distinct: int) -> int:
    """Classes of each kind for so many different words: their cube root, between the bounds."""
    return min(MOST, max(LEAST, round(distinct ** (1 / 3))))


def shared_class(word: str, own: int) -> int:
    return own + zlib.crc32(word[:PREFIX].encode("utf-8", "surrogatepass")) % own


def shared_class_column(word, own: int):
    return (F.lit(own) + F.crc32(F.substring(word, 1, PREFIX).cast("binary")) % own).cast("int")


def word_counts(rows: DataFrame) -> DataFrame:
    """(w, c): occurrences of each token of ``rows``, summed in the mappers before the shuffle."""
    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def out() -> pa.RecordBatch:
            batch = pa.record_batch([pa.array(list(seen), pa.binary()).cast(pa.string()), pa.array(list(seen.values()), pa.int64())], ["w", "k"])
            seen.clear()
            return batch

        for b in batches:
            for t in b.column(0).to_pylist():
                seen.update(words_of(t))
                seen[b""] += 1
                if len(seen) > FLUSH:
                    yield out()
        if seen:
            yield out()

    return rows.select("text").mapInArrow(local, "w string, k long").groupBy("w").agg(F.sum("k").alias("c"))


def frequent_words(counts: DataFrame, top: int) -> list[tuple[str, int]]:
    """Words with their counts, the most frequent first: the end, and at most ``top``, namely
    all whose count lies above a bound found from a histogram by powers (a
    sorted limit would send ``top`` rows of every partition to the driver)."""
    power = F.floor(F.log2(F.col("c")) * 8).cast("int")
    size, least = 0, None
    for r in sorted(counts.groupBy(power.alias("power")).agg(F.count(F.lit(1)).alias("n")).collect(), reverse=True):  # 8 x 63 rows at most
        size += r.n
        if size > top:
            break
        least = r.power
    chosen = F.col("w") == END
    if least is not None:
        chosen |= power >= least
    return sorted(((r.w, r.c) for r in counts.filter(chosen).collect()), key=lambda r: (-r[1], r[0]))


class LogBilinear:
    """Class language model: s(c | a, b) = (r_a A + r_b B) . q_c + bias_c."""

    def __init__(self, classes: int, dim: int, seed: int):
        rng = np.random.default_rng(seed)
        self.params = {"context": rng.normal(0, 0.3, (classes, dim)), "A": np.eye(dim) * 0.5, "B": np.eye(dim) * 0.5,
                       "target": rng.normal(0, 0.1, (classes, dim)), "bias": np.zeros(classes)}
        self.slow = {k: np.zeros_like(v) for k, v in self.params.items()}
        self.fast = {k: np.zeros_like(v) for k, v in self.params.items()}

    def train(self, cells: np.ndarray, counts: np.ndarray, steps: int, batch: int, noise: int, rate: float) -> None:
        """Noise-contrastive estimation on trigrams (rows a, b, c of ``cells``) by their counts.  Each step takes
        all cells, and for the noise its expected counts; ``batch`` contexts are held at once."""
        p, n = self.params, len(p_bias := self.params["bias"])
        unigram = np.bincount(cells[:, 2], weights=counts, minlength=n) + 0.5
        unigram /= unigram.sum()
        p_bias[:] = np.log(unigram)
        log_noise = np.log(noise * unigram)
        true = np.bincount((cells[:, 0] * n + cells[:, 1]) * n + cells[:, 2], weights=counts / counts.sum(), minlength=n ** 3).reshape(n * n, n)
        used = np.flatnonzero(true.any(1))  # contexts that occur
        true = true[used]
        both = true + true.sum(1, keepdims=True) * noise * unigram
        a, b = used // n, used % n
        for step in range(1, steps + 1):
            grads = {k: np.zeros_like(v) for k, v in p.items()}
            dq = np.zeros((n * n, p["A"].shape[0]))
            left, right = p["context"] @ p["A"], p["context"] @ p["B"]
            for at in range(0, len(used), batch):
                part = slice(at, at + batch)
                q = left[a[part]] + right[b[part]]
                g = true[part] - both[part] / (1 + np.exp(-(q @ p["target"].T + p["bias"] - log_noise)))
                dq[used[part]] = g @ p["target"]
                grads["target"] += g.T @ q
                grads["bias"] += g.sum(0)
            da, db = (dq.reshape(n, n, -1).sum(axis) for axis in (1, 0))
            grads |= {"context": da @ p["A"].T + db @ p["B"].T, "A": p["context"].T @ da, "B": p["context"].T @ db}
            for k, d in grads.items():
                self.slow[k] += 0.1 * (d - self.slow[k])
                self.fast[k] += 0.001 * (d * d - self.fast[k])
                p[k] += rate * (1 - step / (steps + 1)) * (self.slow[k] / (1 - 0.9 ** step)) / (np.sqrt(self.fast[k] / (1 - 0.999 ** step)) + 1e-8)

    def log10_table(self) -> np.ndarray:
        """Normalised log10 P(c | a, b) for all a, b, c."""
        p = self.params
        q = (p["context"] @ p["A"])[:, None, :] + (p["context"] @ p["B"])[None, :, :]
        s = q @ p["target"].T + p["bias"]
        top = s.max(-1, keepdims=True)
        return (s - top - np.log(np.exp(s - top).sum(-1, keepdims=True))) / np.log(10)


def trigram_cells(classes: np.ndarray, number: int) -> np.ndarray:
    """Cell a*C*C + b*C + c of each token of a text, of C = ``number`` classes; the end class stands before its start."""
    padded = np.concatenate([np.zeros(2, np.int64), classes])
    return (padded[:-2] * number + padded[1:-1]) * number + padded[2:]


def lm_scores(spark: SparkSession, docs: DataFrame, top: int = 60_000, dim: int = 24, steps: int = 1_000,
              batch: int = 2_048, noise: int = 10, rate: float = 0.02, seed: int = 5) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each document.

    ``top``: frequent words whose counts are broadcast; ``steps``: how often
    the training goes over all trigrams; the rest is the model's size.
    """
    rows = text_rows(docs).withColumn("held_out", crc_mod(F.col("doc_id"), 10) == 0)
    counts = materialize(spark, word_counts(rows.filter(~F.col("held_out"))), "words")
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    frequent = frequent_words(counts, top)
    n_own = classes_of_a_kind(distinct)
    number = 2 * n_own
    own = [END] + [w for w, _ in frequent if w != END][:n_own - 1]
    own_class = {w: k for k, w in enumerate(own)}
    norm = total + 0.1 * (distinct + 1)

    # counts by class, over all words: tokens and words seen once
    class_of = F.coalesce(*[F.when(F.col("w") == w, F.lit(k)) for w, k in own_class.items()], shared_class_column(F.col("w"), n_own))
    sums = {r.k: (r.t, r.ones) for r in counts.groupBy(class_of.alias("k")).agg(
        F.sum("c").alias("t"), F.count_if(F.col("c") == 1).alias("ones")).collect()}
    tokens = np.array([sums.get(k, (0, 0))[0] for k in range(number)], np.float64)
    ones = np.array([sums.get(k, (0, 0))[1] for k in range(number)], np.float64)
    unseen = np.where(np.arange(number) < n_own, 0.0, (ones + 0.5) / (tokens + 1.0))
    unseen[(np.arange(number) >= n_own) & (tokens == 0)] = 1.0
    log_unseen = np.log10(np.maximum(unseen, 1e-300))
    log_share = np.log10(np.maximum(1 - unseen, 1e-300)) - np.log10(np.maximum(tokens, 1))  # add log10(c)

    f_class = np.array([own_class.get(w, shared_class(w, n_own)) for w, _ in frequent], np.int64)
    f_count = np.array([c for _, c in frequent], np.float64)
    shared_table = spark.sparkContext.broadcast((
        {w.encode("utf-8", "surrogatepass"): i for i, (w, _) in enumerate(frequent)}, f_class,
        np.log10((f_count + 0.1) / norm), np.log10(f_count) + log_share[f_class]))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, classes, base, inner = shared_table.value
        find, minus = index.get, repeat(-1)
        by_prefix: dict[str, int] = {}
        rid = TaskContext.get().partitionId() << 33
        end = np.array([find(b"", -1)])
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                out: list[tuple] = []
                for text in part.column("text").to_pylist():
                    words = words_of(text)
                    ids = np.concatenate([np.fromiter(map(find, words, minus), np.int64, len(words)), end])
                    seen = ids >= 0
                    k = np.zeros(len(ids), np.int64)
                    k[seen] = classes[ids[seen]]
                    rare: Counter = Counter()
                    for i in np.flatnonzero(~seen[:-1]).tolist():
                        rare[words[i]] += 1
                        start = words[i][:4 * PREFIX].decode("utf-8", "ignore")[:PREFIX]
                        c = by_prefix.get(start)
                        k[i] = c if c is not None else by_prefix.setdefault(start, shared_class(start, n_own))
                    out.append((rid, len(ids), int(seen.sum()), base[ids[seen]].sum(), inner[ids[seen]].sum(),
                                k.astype(np.uint8).tobytes(), [w.decode() for w in rare], list(rare.values())))
                    rid += 1
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.list_(pa.string()), pa.list_(pa.int64())]
                arrays = [pa.array(list(v), t) for v, t in zip(zip(*out), kinds)] if out else []
                if out:
                    yield pa.record_batch([part.column("doc_id"), part.column("held_out"), *arrays],
                                          ["doc_id", "held_out", "rid", "n_tokens", "known", "base", "inner", "classes", "rare", "times"])

    texts = materialize(spark, rows.mapInArrow(read, "doc_id long, held_out boolean, rid long, n_tokens long, known long, base double, "
                                                     "inner double, classes binary, rare array<string>, times array<long>"), "tokens")

    def trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(number ** 3, np.int64)
        for b in batches:
            for data in b.column(0).to_pylist():
                np.add.at(seen, trigram_cells(np.frombuffer(data, np.uint8).astype(np.int64), number), 1)
        cell = np.flatnonzero(seen)
        yield pa.record_batch([pa.array(cell), pa.array(seen[cell])], ["cell", "n"])

    cells = (texts.filter(~F.col("held_out")).select("classes").mapInArrow(trigrams, "cell long, n long")
             .groupBy("cell").agg(F.sum("n").alias("n")).toArrow())  # number^3 rows at most
    if cells.num_rows:
        cell, times = cells.column("cell").to_numpy(), cells.column("n").to_numpy().astype(np.float64)
        model = LogBilinear(number, dim, seed)
        model.train(np.column_stack([cell // number ** 2, cell // number % number, cell % number]), times,
                    steps, batch, noise, rate)
        log_class = spark.sparkContext.broadcast(model.log10_table().ravel())
    else:
        log_class = spark.sparkContext.broadcast(np.zeros(number ** 3))
        log_unseen = np.zeros(number)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lp = log_class.value
        names = ["doc_id", "held_out", "rid", "n_tokens", "known", "base", "inner"]
        for b in batches:
            outer = [lp[trigram_cells(np.frombuffer(d, np.uint8).astype(np.int64), number)].sum() for d in b.column("classes").to_pylist()]
            yield pa.record_batch([b.column(n) for n in names] + [pa.array(outer, pa.float64())], [*names, "outer"])

    scored = texts.select("doc_id", "held_out", "rid", "n_tokens", "known", "base", "inner", "classes").mapInArrow(
        score, "doc_id long, held_out boolean, rid long, n_tokens long, known long, base double, inner double, outer double")
    rare = (texts.select("rid", F.explode(F.arrays_zip("rare", "times")).alias("x"))
            .select("rid", F.col("x.rare").alias("w"), F.col("x.times").alias("times"))
            .join(counts, "w", "left").withColumn("k", shared_class_column(F.col("w"), n_own)))
    of_class = lambda values: F.element_at(F.array(*[F.lit(float(v)) for v in values]), F.col("k") + 1)
    rare = rare.groupBy("rid").agg(
        F.sum(F.when(F.col("c").isNotNull(), F.col("times")).otherwise(0)).alias("r_known"),
        F.sum(F.col("times") * F.log10((F.coalesce("c", F.lit(0)) + 0.1) / F.lit(float(norm)))).alias("r_base"),
        F.sum(F.col("times") * F.when(F.col("c").isNotNull(), F.log10("c") + of_class(log_share)).otherwise(of_class(log_unseen))).alias("r_inner"))
    # an end never seen in training (no training text at all) is one more unseen token, of probability one
    zero = lambda c: F.coalesce(c, F.lit(0))
    return scored.join(rare, "rid", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + zero("r_known")).cast("long").alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"), (F.col("base") + zero("r_base")).alias("base_score"),
        (F.col("inner") + F.col("outer") + zero("r_inner")).alias("score"))
