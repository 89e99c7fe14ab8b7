"""Toxicity by a counterfactual-regularised linear classifier.

Features are words and word prefixes, by their share of a text's words. Those that
occur unevenly among toxic and other labelled texts are chosen by counts over the
labelled training rows (a groupBy with partial counts); identity terms are always
among them. The weights minimise logistic loss with a ridge, plus a penalty on
score changes: in each labelled sentence with an identity term, the term is swapped
for each other term of its kind and for none, and the squared change of the score
is charged. So terms of a kind get like weights near zero, and a neutral mention of
a group doesn't raise a score.

The fit runs on the driver over a bounded sample: at most `fit_rows` labelled texts,
each as its chosen features only (at most `most_features`). Swaps are counted where the
texts are, for every sentence; equal changes are summed. Scoring passes over every whole text once.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

# Identity terms by kind, whose swap must not change a score.
IDENTITY_TERMS = {
    "religion": ["christian", "muslim", "jewish", "hindu", "buddhist", "atheist", "catholic", "protestant"],
    "origin": ["american", "mexican", "african", "asian", "european", "german", "french", "spanish", "arab", "chinese", "indian"],
    "colour": ["black", "white", "brown"],
    "gender": ["man", "woman", "men", "women", "male", "female", "transgender"],
    "orientation": ["gay", "lesbian", "straight", "bisexual", "homosexual", "heterosexual"],
    "ability": ["blind", "deaf", "disabled", "autistic"],
    "age": ["young", "old", "elderly"],
}
_WORDS = re.compile(r"[^\W\d_]+")
_SENTENCES = re.compile(r"[.!?\n]+")
PREFIXES = (3, 4, 5)
#: One word in 400.
SHARE = 0.0025


def features(text: str | None) -> set[str]:
    """Words (lower case) and their prefixes, the latter marked by a star."""
    return set(weighted(text))


def weighted(text: str | None) -> dict[str, float]:
    """Features with their weight: one for a share of `SHARE` of all words or more, and
    less in proportion, so that a rare chance word in a long text counts little."""
    words = _WORDS.findall((text or "").lower())
    found: Counter = Counter(words)
    for w, c in list(found.items()):
        for n in PREFIXES:
            if len(w) > n:
                found[w[:n] + "*"] += c
    unit = max(1.0, SHARE * len(words))
    return {f: min(1.0, c / unit) for f, c in found.items()}


def _without_copies(rows: DataFrame) -> DataFrame:
    """One row of each group of near copies, for the fit: the words of one toxic text
    and its copies would look like toxic words. Copies share, with likelihood near their
    similarity, the least and the largest hash of their runs of five words."""
    words = F.split(F.lower("text"), r"\s+")
    marked = rows.withColumn("_words", words).withColumn("_runs", F.transform("_words", lambda w, i: F.xxhash64(w, *[F.get("_words", i + k) for k in range(1, 5)])))
    marked = marked.withColumn("_a", F.coalesce(F.array_min("_runs"), F.lit(0))).withColumn("_z", F.coalesce(F.array_max("_runs"), F.lit(0))).drop("_words", "_runs")
    for mark in ("_a", "_z"):
        order = Window.partitionBy(mark).orderBy("doc_id", F.xxhash64("text"), "label")
        marked = marked.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
    return marked.drop("_a", "_z")


def _chosen(train: DataFrame, most: int, least_docs: int, least_z: float) -> list[str]:
    """The features whose document shares in the two classes differ most, in standard
    errors (two proportions): at most `most` of them, from `least_z` on, so that a small
    table gives few features and not many by chance. Only counts come to the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts: dict[str, list[int]] = {}
            for text, label in zip(b.column(0), b.column(1).to_pylist()):
                for f, x in weighted(text.as_py()).items():
                    if x >= 0.1:
                        counts.setdefault(f, [0, 0])[label] += 1
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array([c[0] for c in counts.values()], pa.int64()), pa.array([c[1] for c in counts.values()], pa.int64())], names=["f", "n0", "n1"])

    sizes = {int(r["label"]): r["n"] for r in train.groupBy("label").agg(F.count("*").alias("n")).collect()}
    a, b = max(1, sizes.get(1, 0)), max(1, sizes.get(0, 0))
    sums = train.select("text", "label").mapInArrow(count, "f string, n0 long, n1 long").groupBy("f").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    share = (F.col("n1") + F.col("n0")) / float(a + b)
    z = F.abs(F.col("n1") / a - F.col("n0") / b) / F.sqrt(share * (1.0 - share) * (1 / a + 1 / b) + 1e-12)
    best = sums.where(F.col("n0") + F.col("n1") >= least_docs).select("f", z.alias("z")).where(F.col("z") >= least_z).orderBy(F.col("z").desc(), "f").limit(most)
    return [r["f"] for r in best.collect()]


def swaps(text: str | None, place: dict[str, int]) -> Counter:
    """The changes of features that swaps in a text's sentences make, with how often each
    is made: in each sentence with an identity term, the term is swapped for each other
    term of its kind and left out. A change is the sorted places of features that come,
    as place + 1, and that go, as -(place + 1); empty where the score can't change."""
    made: Counter = Counter()
    for sentence in _SENTENCES.split((text or "").lower()):
        words = _WORDS.findall(sentence)
        for terms in IDENTITY_TERMS.values():
            for term in set(words).intersection(terms):
                old = {place[f] for f in features(sentence) if f in place}
                for other in [t for t in terms if t != term] + [""]:
                    new = {place[f] for f in features(" ".join(other if w == term else w for w in words)) if f in place}
                    made[tuple(sorted([p + 1 for p in new - old] + [-p - 1 for p in old - new]))] += 1
    return made


def _neutral_changes(place: dict[str, int]) -> Counter:
    """A bare mention of each identity term against none: keeps the weights of terms
    that no labelled sentence holds near zero too."""
    return Counter(tuple(sorted(-place[f] - 1 for f in features(term) if f in place)) for terms in IDENTITY_TERMS.values() for term in terms)


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, changes: dict[tuple[int, ...], int], n: int, ridge: float = 1e-4, penalty: float = 1.0, steps: int = 400) -> tuple[np.ndarray, float]:
    """Weights and intercept, by accelerated gradient descent on the mean logistic
    loss + ridge + penalty * mean squared score change over the swaps. rows: (places,
    values) of each text; changes: those of swaps(), with their counts."""
    lengths = np.array([len(r[0]) for r in rows], dtype=np.int64)
    row, col = np.repeat(np.arange(len(rows)), lengths), np.concatenate([np.zeros(0, np.int64), *(r[0] for r in rows)]).astype(np.int64)
    value = np.concatenate([np.zeros(0), *(r[1] for r in rows)]).astype(float)
    made = sorted(changes.items())
    times = np.array([k for _, k in made], dtype=float)
    p_row = np.repeat(np.arange(len(made)), [len(c) for c, _ in made])
    signed = np.array([x for c, _ in made for x in c], dtype=np.int64)
    p_col, p_sign = np.abs(signed) - 1, np.sign(signed).astype(float)
    y, w, b = labels.astype(float), np.zeros(n), 0.0
    share = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))  # classes weigh the same
    v, vb, t = w.copy(), b, 1.0
    scale = max(1.0, float(np.average(np.bincount(row, value**2, len(rows)), weights=share)) if len(rows) else 1.0)
    rate = 4.0 / (scale + 1 + 8 * penalty)
    for _ in range(steps):
        z = np.bincount(row, v[col] * value, len(rows)) + vb
        g = share * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y)
        grad = np.bincount(col, g[row] * value, n) + ridge * v
        if len(p_row):
            change = times * np.bincount(p_row, p_sign * v[p_col], len(made)) * (2 * penalty / times.sum())
            grad += np.bincount(p_col, p_sign * change[p_row], n)
        w2, b2, t2 = v - rate * grad, vb - rate * g.sum(), (1 + (1 + 4 * t * t) ** 0.5) / 2
        v, vb = w2 + (t - 1) / t2 * (w2 - w), b2 + (t - 1) / t2 * (b2 - b)
        w, b, t = w2, b2, t2
    return w, b


class Model:
    def __init__(self, place: dict[str, int], weights: np.ndarray, intercept: float, offset: float = 0.0):
        self.place, self.weights, self.intercept = place, weights, intercept + offset

    def scores(self, texts) -> np.ndarray:
        place, weights = self.place, self.weights
        z = np.array([math.fsum(weights[place[f]] * x for f, x in weighted(t).items() if f in place) for t in texts], dtype=float) + self.intercept
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def train(docs: DataFrame, labels: DataFrame, most_features: int = 2000, least_docs: int = 3, least_z: float = 4.0, fit_rows: int = 20_000, penalty: float = 1.0) -> Model:
    """Fit on docs (doc_id, text) joined with labels (doc_id, label 0/1). Rows of null
    ids or labels don't count; of repeated labels each counts. At most `fit_rows`
    labels are used (those of smallest hash, each class up to half): their ids are
    broadcast to where the texts are, so that no text is shuffled. A very long text is
    read whole, one at a time, and its words count by their share. With one class alone
    every text scores that class's rate; without labels, near 0. Columns of docs beside
    doc_id and text, and of labels beside doc_id and label, are ignored."""
    known = labels.where("doc_id IS NOT NULL AND label IN (0, 1)").select(F.col("doc_id").alias("of"), F.col("label").cast("int").alias("label"))
    picked = [known.where(F.col("label") == y).orderBy(F.xxhash64("of"), "of").limit(fit_rows // 2) for y in (0, 1)]
    sample = F.broadcast(picked[0].unionByName(picked[1]))  # at most fit_rows ids and labels
    rows = common.written(docs.select("doc_id", "text").join(sample, F.col("doc_id") == F.col("of")).select("doc_id", "text", "label"), "labelled")
    rows = common.written(_without_copies(rows), "labelled")
    vocabulary = _chosen(rows, most_features, least_docs, least_z)
    identity = [f for terms in IDENTITY_TERMS.values() for t in terms for f in sorted(features(t)) if not f.endswith("*")]
    place = {f: i for i, f in enumerate(dict.fromkeys([*vocabulary, *identity]))}
    shared = rows.sparkSession.sparkContext.broadcast(place)

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = shared.value
        for b in batches:
            places, values = [], []
            for text in b.column(0):
                own = [(at[f], x) for f, x in weighted(text.as_py()).items() if f in at]
                places.append(np.array([p for p, _ in own], "<i4").tobytes()), values.append(np.array([x for _, x in own], "<f8").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(places, pa.binary()), pa.array(values, pa.binary()), b.column(1)], names=["places", "values", "label"])

    def changed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = shared.value
        for b in batches:
            made: Counter = Counter()
            for text in b.column(0):
                made.update(swaps(text.as_py(), at))
            yield pa.RecordBatch.from_arrays([pa.array(list(map(list, made)), pa.list_(pa.int32())), pa.array(list(made.values()), pa.int64())], names=["change", "n"])

    sample = rows.select("text", "label").mapInArrow(reduce, "places binary, values binary, label int").collect()
    # Of all swaps in all sentences only the different changes, with their counts, leave the executors.
    made = rows.select("text").mapInArrow(changed, "change array<int>, n long").groupBy("change").agg(F.sum("n").alias("n")).collect()
    changes = _neutral_changes(place) + Counter({tuple(r["change"]): r["n"] for r in made})
    y = np.array([r["label"] for r in sample], dtype=int)
    if not len(y) or y.min() == y.max():  # one class only: its rate for all
        rate = float(y.mean()) if len(y) else 0.0
        return Model({}, np.zeros(0), float(np.log((rate + 1e-6) / (1 - rate + 1e-6))))
    weights, intercept = fit([(np.frombuffer(r["places"], "<i4"), np.frombuffer(r["values"], "<f8")) for r in sample], y, changes, len(place), penalty=penalty)
    return Model(place, weights, intercept)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, predicted) for each row of docs (doc_id, text). Null and empty texts
    get the score of no features; a very long text is scored whole, one at a time;
    repeated rows are scored each; null ids stay; columns other than these two are
    ignored; an empty table gives no rows."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            s = m.scores(t.as_py() for t in b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double, predicted int")


def op1_counterfactual_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = common.table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"))
    learn = common.remainder(F.col("doc_id"), 5) != 0
    model = train(docs.where(learn), labels.where(learn))
    out = score(docs, model)
    return out.select("doc_id", (F.coalesce(common.remainder(F.col("doc_id"), 5), F.lit(1)) == 0).alias("held_out"), "score", "predicted")
