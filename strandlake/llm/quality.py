"""Quality classifier: random Fourier features, ridge, isotonic calibration.

Statistics of a whole text (lengths, shares of character classes, repeats) are
standardised and mapped to cosines of random projections, whose inner products
approximate a Gaussian kernel. Ridge weights solve the normal equations, which are
sums over rows: each task sums its own rows for each of five folds, and the driver
adds at most `tasks` sets of matrices. Weights without a fold follow by subtraction;
they choose the ridge, and give the scores on which isotonic regression (pool adjacent
violators, on counts in fixed bins) calibrates: each row is scored by weights that
haven't seen it. So no step brings rows to the driver, and no sample is needed.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

STATISTICS = (
    "log_bytes", "log_words", "word_bytes", "upper", "digits", "symbols", "bangs", "pipes", "stops", "commas", "wide",
    "distinct", "top_word", "dup_lines", "dup_line_bytes", "log_lines", "line_words", "twice", "short_words", "edge_symbols",
)
_UPPER, _DIGITS, _SYMBOLS = bytes(range(65, 91)), b"0123456789", b"#*$%&<>@^~_=+{}[]\\/"
_ASCII = bytes(range(128))
_EDGE = re.compile(rb"[#*$%&!|]{2,}")


def statistics(text: str | None) -> list[float]:
    """The statistics of one text; all are finite, also for null and empty texts."""
    b = (text or "").encode("utf-8", "replace")
    n = max(1, len(b))
    words = b.split()
    w = max(1, len(words))
    share = lambda chars: (len(b) - len(b.translate(None, chars))) / n
    lines = [x for x in (line.strip() for line in b.split(b"\n")) if x]
    seen = Counter(lines)
    dup = [(c - 1, (c - 1) * len(x)) for x, c in seen.items() if c > 1]
    counts = Counter(words)
    pairs = Counter(zip(words, words[1:], words[2:]))
    twice = sum(c for c in pairs.values() if c > 1)
    m = max(1, len(lines))
    return [
        np.log1p(len(b)), np.log1p(len(words)), min(60.0, sum(map(len, words)) / w), share(_UPPER), share(_DIGITS), share(_SYMBOLS), share(b"!"), share(b"|"),
        share(b"."), share(b",;:"), len(b.translate(None, _ASCII)) / n, len(counts) / w, max(counts.values(), default=0) / w, sum(d[0] for d in dup) / m,
        sum(d[1] for d in dup) / n, np.log1p(len(lines)), np.log1p(len(words) / m), twice / w, sum(len(x) < 3 for x in words) / w, len(_EDGE.findall(b)) / w,
    ]


def with_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, x) for each row of docs (doc_id, text): what joins with labels are these
    few numbers, never texts. Null and empty texts have the statistics of no words; a very
    long text is counted whole, one at a time; columns beside these two are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [statistics(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "x"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, x array<double>")


def isotonic(total: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """The non-decreasing fit of ones / total, weighted by total, by pooling adjacent
    violators; bins without rows take the value of the pool before them."""
    pools: list[list[float]] = []
    for n, k in zip(total, ones):
        pools.append([float(n), float(k), 1])
        while len(pools) > 1 and (pools[-1][0] == 0 or pools[-2][0] == 0 or pools[-2][1] / pools[-2][0] >= pools[-1][1] / pools[-1][0]):
            n2, k2, c2 = pools.pop()
            pools[-1] = [pools[-1][0] + n2, pools[-1][1] + k2, pools[-1][2] + c2]
    return np.concatenate([np.full(int(c), k / n if n else 0.5) for n, k, c in pools])


class Model:
    """Standardisation, projections, ridge weights and the calibrated bins."""

    def __init__(self, mean, spread, projection, phase, weights, low, high, levels):
        self.mean, self.spread, self.projection, self.phase = mean, spread, projection, phase
        self.weights, self.low, self.high, self.levels = weights, low, high, levels

    def cosines(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.spread, -8, 8)
        return np.hstack([np.cos(z @ self.projection + self.phase) * np.sqrt(2 / len(self.phase)), z, np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.cosines(x) @ self.weights

    def bins(self, raw: np.ndarray) -> np.ndarray:
        return np.clip(((raw - self.low) / (self.high - self.low) * len(self.levels)).astype(int), 0, len(self.levels) - 1)

    def scores(self, x: np.ndarray) -> np.ndarray:
        """The calibrated level of the bin, moved by the raw score by less than the
        gap between levels matters, so that ties within a level keep an order."""
        raw = self.raw(x)
        place = np.clip((raw - self.low) / (self.high - self.low), 0, 1)
        return np.clip(self.levels[self.bins(raw)] * (1 - 2e-3) + 2e-3 * place, 0, 1)


def train(stats: DataFrame, labels: DataFrame, features: int = 256, ridges: tuple = (1e-4, 1e-3, 1e-2, 1e-1, 1.0), bandwidth: float = 6.0, tasks: int = 8, n_bins: int = 512, folds: int = 5, seed: int = 11) -> Model:
    """Fit on with_statistics() of documents joined with labels (doc_id, label 0/1).
    Folds go by a hash of the id. Null ids and labels don't count; of repeated ids and labels
    each pair counts. With one class alone scores are near its label; without labelled rows
    every score is 0.5. Other columns of labels are ignored; stats has these two."""
    known = labels.where("doc_id IS NOT NULL AND label IN (0, 1)").select(F.col("doc_id").alias("of"), F.col("label").cast("int").alias("label"))
    rows = stats.join(known, F.col("doc_id") == F.col("of")).withColumn("part", (F.col("label") + 2 * F.pmod(F.xxhash64("doc_id"), F.lit(folds))).cast("int"))
    data = common.written(rows.select("part", "x"), "training")
    d = len(STATISTICS)
    moments = data.select(*[f(F.col("x")[i]).alias(f"{n}{i}") for i in range(d) for n, f in (("m", F.avg), ("s", F.stddev_pop))], F.count("*").alias("n")).first()
    rng = np.random.default_rng(seed)
    if not moments["n"]:
        return Model(np.zeros(d), np.ones(d), np.zeros((d, 1)), np.zeros(1), np.zeros(d + 2), 0.0, 1.0, np.array([0.5]))
    mean = np.array([moments[f"m{i}"] for i in range(d)])
    spread = np.array([moments[f"s{i}"] or 0.0 for i in range(d)])
    spread[spread < 1e-9] = 1.0
    model = Model(mean, spread, rng.normal(size=(d, features)) / bandwidth, rng.uniform(0, 2 * np.pi, features), None, -0.5, 1.5, np.zeros(n_bins))
    shared = data.sparkSession.sparkContext.broadcast(model)
    width = features + d + 1

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, a = shared.value, np.zeros((folds, width, width + 1))
        squares = np.zeros(folds)
        for b in batches:
            if b.num_rows:
                z, part = m.cosines(b.column(1).flatten().to_numpy().reshape(b.num_rows, -1)), b.column(0).to_numpy()
                for k in range(folds):
                    own = part // 2 == k
                    y = (part[own] % 2).astype(float)
                    a[k] += z[own].T @ np.hstack([z[own], y[:, None]])
                    squares[k] += (y**2).sum()
        yield pa.RecordBatch.from_arrays([pa.array([a.tobytes()], pa.binary()), pa.array([squares.tobytes()], pa.binary())], names=["a", "squares"])

    parts = data.repartition(tasks).mapInArrow(sums, "a binary, squares binary").collect()
    by_fold = np.sum([np.frombuffer(r["a"]).reshape(folds, width, width + 1) for r in parts], axis=0)
    squares = np.sum([np.frombuffer(r["squares"]) for r in parts], axis=0)
    total = by_fold.sum(0)

    def solved(a: np.ndarray, ridge: float) -> np.ndarray:
        penalty = np.full(width, ridge * max(1.0, a[width - 1, width - 1]))
        penalty[-1] = 1e-9 * penalty[-1] + 1e-9
        return np.linalg.solve(a[:, :width] + np.diag(penalty), a[:, width])

    # Squared errors of a fold under weights without it, from the fold's sums alone.
    outside = {r: [solved(total - a, r) for a in by_fold] for r in ridges}
    error = lambda r: sum(w @ a[:, :width] @ w - 2 * w @ a[:, width] + y for w, a, y in zip(outside[r], by_fold, squares))
    best = min(ridges, key=error)
    model.weights = solved(total, best)
    fitted = data.sparkSession.sparkContext.broadcast((model, np.array(outside[best])))

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (m, weights), count = fitted.value, np.zeros((n_bins, 2), dtype=np.int64)
        for b in batches:
            if b.num_rows:
                part = b.column(0).to_numpy()
                z = m.cosines(b.column(1).flatten().to_numpy().reshape(b.num_rows, -1))
                np.add.at(count, (m.bins((z * weights[part // 2]).sum(1)), part % 2), 1)
        used = np.nonzero(count.sum(1))[0]
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(count[used, 0]), pa.array(count[used, 1])], names=["bin", "n0", "n1"])

    seen = data.mapInArrow(binned, "bin long, n0 long, n1 long").groupBy("bin").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).collect()
    counts = np.zeros((n_bins, 2))
    for r in seen:
        counts[r["bin"]] = r["n0"], r["n1"]
    model.levels = isotonic(counts.sum(1), counts[:, 1])
    return model


def score(stats: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, predicted) for each row of with_statistics(); null texts count as
    empty, repeated rows are scored each, an empty table gives no rows."""
    shared = stats.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            s = m.scores(b.column(1).flatten().to_numpy().reshape(b.num_rows, len(STATISTICS)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return stats.select("doc_id", "x").mapInArrow(run, "doc_id long, score double, predicted int")


def op4_fourier_quality(spark, sf_dir: str) -> DataFrame:
    stats = common.written(with_statistics(common.table(spark, sf_dir, "documents").select("doc_id", "text")), "statistics")
    labels = common.table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    learn = common.remainder(F.col("doc_id"), 3) != 1
    model = train(stats.where(learn), labels.where(learn))
    return score(stats, model).select("doc_id", (F.coalesce(common.remainder(F.col("doc_id"), 3), F.lit(0)) == 1).alias("held_out"), "score", "predicted")
