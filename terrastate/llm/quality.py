"""Quality scores from random Fourier features of document statistics.

Statistics of the whole text go through random Fourier features, which
approximate a Gaussian kernel; per-partition normal equations are summed and
solved as a ridge regression; isotonic calibration turns the fit into a
probability.  Labels, language, source and id are never inputs of a score.

The fit takes at most about ``fit_rows`` labelled rows (a documented bound; a
hash of the text decides beyond it); every document is scored.

Results: a null or empty text has the statistics of an empty text; a null label
doesn't count, and of repeated labels of a document the smallest does; repeated
rows and null ids get a row each; without a labelled row every score is 0.5, and
with one class only it is that class; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrastate.llm.common import crc_mod, materialize, text_rows

STATS = ("bytes words word_mean word_sd letters upper digits spaces lines punctuation symbols symbol_kinds high "
         "distinct top_word same_next upper_words symbol_ends distinct_pairs line_repeats line_mean capitals short_words").split()

FEW_WORDS = 8
_KIND = np.zeros(256, np.int64)  # 0 other, 1 lower, 2 upper, 3 digit, 4 space, 5 line feed, 6 punctuation, 7 symbol, 8 beyond ASCII
for _chars, _kind in ((range(97, 123), 1), (range(65, 91), 2), (range(48, 58), 3), (b" \t\r\x0b\x0c", 4), (b"\n", 5), (b".,;:'\"-()", 6),
                      (b"!?#$%&*+/<=>@[\\]^_`{|}~", 7), (range(128, 256), 8)):
    _KIND[list(_chars)] = _kind


def statistics(text: str) -> list[float]:
    """The values of ``STATS`` for a whole text."""
    data = text.encode("utf-8", "surrogatepass")
    n = max(1, len(data))
    per_byte = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    lower, upper, digit, space, line, punct, symbol, high = np.bincount(_KIND, weights=per_byte, minlength=9)[1:9] / n
    words = data.split()
    w = max(1, len(words))
    lengths = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    lines = [x for x in data.split(b"\n") if x]
    pairs = list(zip(words, words[1:]))
    seen: dict[bytes, int] = {}
    for x in words:
        seen[x] = seen.get(x, 0) + 1
    ends = sum(not (x[-1:].isalnum() or x[-1] > 127) for x in words)
    return [np.log1p(len(data)), np.log1p(len(words)), lengths.mean(), lengths.std(), lower, upper, digit, space, line, punct, symbol,
            float((per_byte[_KIND == 7] > 0).sum()), high, len(seen) / w, max(seen.values(), default=0) / w,
            sum(a == b for a, b in pairs) / w, sum(map(bytes.isupper, words)) / w, ends / w, len(set(pairs)) / max(1, len(pairs)),
            1 - len(set(lines)) / max(1, len(lines)), np.log1p(n / max(1, len(lines))), sum(x[:1].isupper() for x in words) / w,
            float((lengths <= 2).sum()) / w]


def document_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, stats (array of the values of ``STATS``), pick (a hash of the text) of each row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = np.array([statistics(t) for t in b.column("text").to_pylist()], np.float64).reshape(-1, len(STATS))
            offsets = pa.array(np.arange(len(values) + 1, dtype=np.int32) * len(STATS))
            yield pa.record_batch([b.column("doc_id"), b.column("pick"), pa.ListArray.from_arrays(offsets, pa.array(values.ravel()))],
                                  ["doc_id", "pick", "stats"])

    rows = text_rows(docs).withColumn("pick", F.xxhash64("text"))
    return rows.mapInArrow(run, "doc_id long, pick long, stats array<double>")


@dataclass
class QualityModel:
    """What scoring needs: a fixed number of coefficients."""

    mean: np.ndarray
    scale: np.ndarray
    frequencies: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    knots: np.ndarray  # raw fit
    levels: np.ndarray  # calibrated probability at each knot

    def features(self, stats: np.ndarray) -> np.ndarray:
        """Waves of the standardised statistics, these themselves, and a constant.
        Ratios over a few words say little: they are drawn towards the mean."""
        words = np.expm1(stats[:, STATS.index("words")])
        x = np.clip((stats - self.mean) / self.scale, -8, 8) * (words / (words + FEW_WORDS))[:, None]
        waves = np.cos(x @ self.frequencies + self.phases) * np.sqrt(2 / len(self.phases))
        return np.hstack([waves, x, np.ones((len(x), 1))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights if len(stats) else np.zeros(0)

    def score(self, stats: np.ndarray) -> np.ndarray:
        """Calibrated probability; a thousandth of the raw fit orders what calibration ties."""
        raw = self.raw(stats)
        return 0.999 * np.interp(raw, self.knots, self.levels) + 0.001 * np.clip(raw, 0, 1)


def isotonic(x: np.ndarray, positive: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots and levels of the non-decreasing fit."""
    blocks: list[list[float]] = []
    for at, p, t in zip(x, positive, total):
        blocks.append([p, t, at, at])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            p1, t1, _, right = blocks.pop()
            blocks[-1] = [blocks[-1][0] + p1, blocks[-1][1] + t1, blocks[-1][2], right]
    knots = np.array([k for _, _, left, right in blocks for k in (left, right)])
    return knots, np.repeat([p / t for p, t, _, _ in blocks], 2)


def fit(stats: DataFrame, labels: DataFrame, features: int = 256, width: float = 6.0, ridge: float = 3.0,
        fit_rows: int = 200_000, tasks: int = 8, seed: int = 11) -> QualityModel:
    """Fit on the labelled rows of ``stats`` that are not held out (crc32 of the id, mod 5, not 0).

    ``width``: of the Gaussian kernel in standard deviations; ``fit_rows``: bound of the sample.
    """
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).filter(
        F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    rows = stats.join(marks, "doc_id").filter(crc_mod(F.col("doc_id"), 5) != 0).select("pick", "stats", "quality")
    n = rows.count()
    d = len(STATS)
    if n > fit_rows:
        rows = rows.filter(F.pmod(F.xxhash64("pick"), F.lit(1_000_000)) < int(1_000_000 * fit_rows / n))
    rows = rows.repartition(tasks).persist()  # evenly, whatever texts repeat
    # fixed-size sums: tasks rows of moments, then tasks blocks of normal equations
    moments = np.array(rows.select(*[F.expr(f"stats[{i}] AS s{i}") for i in range(d)]).agg(
        *[F.avg(f"s{i}") for i in range(d)], *[F.stddev_pop(f"s{i}") for i in range(d)]).first(), np.float64)
    mean, scale = np.nan_to_num(moments[:d]), np.nan_to_num(moments[d:])
    scale = np.where(scale > 1e-9, scale, 1.0)
    rng = np.random.default_rng(seed)
    model = QualityModel(mean, scale, rng.normal(size=(d, features)) / width, rng.uniform(0, 2 * np.pi, features),
                         np.zeros(features + d + 1), np.array([0.0]), np.array([0.5]))
    size = features + d + 1
    if not n:
        rows.unpersist()
        return model

    def equations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size + 1))
        for b in batches:
            if b.num_rows:
                z = model.features(_matrix(b.column("stats")))
                total += z.T @ np.column_stack([z, b.column("quality").to_numpy(zero_copy_only=False)])
        yield pa.record_batch([pa.array([total.tobytes()], pa.binary())], ["block"])

    blocks = rows.select("stats", "quality").mapInArrow(equations, "block binary").toLocalIterator()
    total = sum(np.frombuffer(bytes(r.block)).reshape(size, size + 1) for r in blocks)
    penalty = np.full(size, ridge)
    penalty[-1] = 1e-6
    model.weights = np.linalg.solve(total[:, :size] + np.diag(penalty), total[:, size])

    def raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.round(np.clip(model.raw(_matrix(b.column("stats"))), -1, 2) * 2000).astype(np.int64)
            yield pa.record_batch([pa.array(at), b.column("quality")], ["at", "quality"])

    bins = (rows.select("stats", "quality").mapInArrow(raw, "at long, quality int").groupBy("at")
            .agg(F.sum("quality").alias("p"), F.count(F.lit(1)).alias("t")).orderBy("at").collect())  # 6,001 rows at most
    rows.unpersist()
    model.knots, model.levels = isotonic(np.array([b["at"] / 2000 for b in bins]), np.array([b["p"] for b in bins], np.float64),
                                         np.array([b["t"] for b in bins], np.float64))
    return model


def _matrix(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(STATS))


def score(stats: DataFrame, model: QualityModel) -> DataFrame:
    """doc_id, score of each row of statistics."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch([b.column("doc_id"), pa.array(model.score(_matrix(b.column("stats"))), pa.float64())], ["doc_id", "score"])

    return stats.select("doc_id", "stats").mapInArrow(run, "doc_id long, score double")


def quality_scores(spark: SparkSession, docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **options) -> DataFrame:
    """doc_id, held_out, score, predicted of each document."""
    stats = materialize(spark, document_statistics(docs), "quality")
    scored = score(stats, fit(stats, labels, **options))
    return scored.select("doc_id", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(spark: SparkSession, docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **options) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose score is at least ``threshold``: one pass
    over the texts to fit, one to filter, and no shuffle of a text."""
    stats = materialize(spark, document_statistics(docs), "quality")
    model = fit(stats, labels, **options)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(b.schema.get_field_index("text")).to_pylist()
            values = np.array([statistics(t or "") for t in texts], np.float64).reshape(-1, len(STATS))
            yield b.filter(pa.array(model.score(values) >= threshold))

    return docs.mapInArrow(run, docs.schema)
