"""Window minimizers of q-grams, and what is counted over them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlake.functions import alphabet as A
from strandlake.operators import qgrams as Q


def minimizers(qgrams: DataFrame, window: int, column: str = "value", q: int | None = None) -> DataFrame:
    """(hash, seq_id, pos): for each q-gram at position window - 1 or later in its
    sequence, the leftmost least value among the last `window` q-grams of its range;
    each once. A range that starts late in its sequence so gives least values of
    shorter windows too. Ranges with fewer than `window` q-grams give none.

    Positions of a range are consecutive, so a frame of rows is exact."""
    part = Window.partitionBy("seq_id", "range_start")
    least = F.min(F.struct(F.col(column).alias("hash"), F.col("pos").alias("pos"))).over(part.orderBy("pos").rowsBetween(1 - window, 0))
    rows = qgrams.withColumn("_n", F.count("*").over(part)).withColumn("_m", least).where((F.col("_n") >= window) & (F.col("pos") >= window - 1))
    return rows.select(F.col("_m.hash").alias("hash"), "seq_id", F.col("_m.pos").alias("pos")).distinct()


def least_in_windows(values: np.ndarray, run_start: np.ndarray, window: int) -> np.ndarray:
    """For each place the leftmost least value's place among the last `window` places of
    its run, or all that it has so far. run_start: the first place of each place's run.
    Widths double, so a window takes log2(window) passes."""
    n = len(values)
    here = np.arange(n)
    best, width = here.copy(), 1
    while width < window:
        step = min(width, window - width)  # the last step overlaps
        left = here - step
        may = left >= run_start
        other = best[np.where(may, left, here)]
        best = np.where(may & (values[other] <= values[best]), other, best)
        width += step
    return best


def _windowed(w: Q.Windows, values: np.ndarray, window: int) -> np.ndarray:
    """Places, in order and each once, of the minimizers of a batch's q-grams."""
    if not len(w.at):
        return np.zeros(0, np.int64)
    new = np.concatenate([[True], np.diff(w.at) != 1])
    first = np.flatnonzero(new)
    run = np.cumsum(new) - 1
    size = np.diff(np.concatenate([first, [len(w.at)]]))
    late = w.at - w.offsets[w.texts_of(w.at)] >= window - 1
    found = least_in_windows(values, first[run], window)[(size[run] >= window) & late]
    return found[np.concatenate([[True], np.diff(found) != 0])] if len(found) else found


def sequence_minimizers(sequences: DataFrame, q: int, window: int, kind: str = "code", alphabet: str = A.DNA) -> DataFrame:
    """(hash, seq_id, pos): the same rows as minimizers() over all q-grams, found where
    the q-grams are made. Those of a sequence stand in order there, so nothing is
    shuffled and only minimizers leave a task."""

    def made(ids: list, texts: list[str]) -> pa.RecordBatch:
        w = Q.Windows(ids, texts, q, alphabet)
        values = w.values(kind)
        best = _windowed(w, values, window)
        seq_id, pos, _ = w.places(w.at[best])
        return pa.RecordBatch.from_arrays([pa.array(values[best]), pa.array(seq_id), pa.array(pos)], names=["hash", "seq_id", "pos"])

    return Q.by_batch(sequences, made, "hash long, seq_id long, pos long")


def canonical_minimizers(sequences: DataFrame, q: int, window: int, kind: str = "code", bits: int = 62, alphabet: str = A.DNA) -> DataFrame:
    """(hash, seq_id, pos): minimizers over the smaller value of both strands (forward at
    a tie). Where the reverse strand's is smaller the row is that of the reverse
    sequence: seq_id 2 i + 1 and position length - (pos + q); forward sequences are 2 i.
    q-grams that equal their reverse complement are there for both strands, whatever the
    window. Made where the q-grams are, without a shuffle."""

    def made(ids: list, texts: list[str]) -> pa.RecordBatch:
        w = Q.Windows(ids, texts, q, alphabet)
        mask = np.int64((1 << bits) - 1)
        forward, reverse = w.values(kind) & mask, w.values(kind, True) & mask
        least = np.minimum(forward, reverse)
        best = _windowed(w, least, window)
        best, both = best[forward[best] != reverse[best]], np.flatnonzero(forward == reverse)
        place = np.concatenate([best, both, both])
        strand = np.concatenate([reverse[best] < forward[best], np.zeros(len(both), bool), np.ones(len(both), bool)])
        seq_id, pos, _ = w.places(w.at[place])
        length = w.lengths[w.texts_of(w.at[place])]
        columns = (least[place], seq_id * 2 + strand, np.where(strand, length - pos - q, pos))
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["hash", "seq_id", "pos"])

    return Q.by_batch(sequences, made, "hash long, seq_id long, pos long")


def without_replicates(rows: DataFrame, most: int, column: str = "hash") -> DataFrame:
    """Rows whose hash occurs at most `most` times. Counts go by a partial
    aggregation, so a very frequent hash is not one task's rows."""
    n = rows.groupBy(F.col(column).alias("_of")).agg(F.count("*").alias("_n")).where(F.col("_n") <= most)
    return rows.join(n, F.col(column) == F.col("_of"), "left_semi")


def run_lengths(rows: DataFrame, column: str = "hash") -> DataFrame:
    """(occurrences, hashes): how many hashes occur how often."""
    return rows.groupBy(column).agg(F.count("*").alias("occurrences")).groupBy("occurrences").agg(F.count("*").alias("hashes"))


def density(minimizer_rows: DataFrame, range_rows: DataFrame, q: int) -> DataFrame:
    """(minimizers, qgrams, qgrams_less_two, density): qgrams_less_two is two less for
    each range, a count that some reports divide by."""
    n = F.sum(F.col("len") - q + 1)
    total = range_rows.where(F.col("len") >= q).agg(n.alias("qgrams"), (n - 2 * F.count("*")).alias("qgrams_less_two"))
    return minimizer_rows.agg(F.count("*").alias("minimizers")).crossJoin(F.broadcast(total)).withColumn("density", F.round(F.col("minimizers") / F.col("qgrams"), 6))
