"""Alignment of pairs of sequences.

Pairs come from a join (triangle_pairs, restricted, or any other); what runs in Python
is the dynamic programming alone. A task takes its pairs in Arrow batches sorted by
the first sequence, and aligns one first sequence with many second ones at once: each
numpy step is a column of all these matrices. A gap of length n costs open + n * ext.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlake.functions import cigar as K
from strandlake.functions.scores import Scores, named

_LOW = -(1 << 40)


def local_ends(u: np.ndarray, vs: list[np.ndarray], scores: Scores, gap_open: int, gap_ext: int, stop: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(score, row, column) of the best local end of u (rows) with each of vs: the first
    column that reaches the best score, and its first row. `stop` ends at the first
    column that reaches this score."""
    b, m = len(vs), len(u)
    best, row, column = np.zeros(b, dtype=np.int64), np.zeros(b, dtype=np.int64), np.zeros(b, dtype=np.int64)
    if not m or not b:
        return best, row, column
    longest = max(map(len, vs))
    padded = np.full((b, longest), -1, dtype=np.int64)
    for i, v in enumerate(vs):
        padded[i, : len(v)] = v
    profile = np.vstack([scores.table[:, u], np.full((1, m), _LOW)])  # the last row pads
    slope = np.arange(m, dtype=np.int64) * gap_ext
    h, e = np.zeros((b, m), dtype=np.int64), np.full((b, m), _LOW, dtype=np.int64)
    every = np.arange(b)
    for j in range(longest):
        e = np.maximum(e - gap_ext, h - gap_open - gap_ext)
        now = np.zeros((b, m), dtype=np.int64)
        now[:, 1:] = h[:, :-1]
        now += profile[padded[:, j]]
        np.maximum(now, e, out=now)
        np.maximum(now, 0, out=now)
        if m > 1:  # gaps along u: the best opening above, each step dearer by gap_ext
            above = np.maximum.accumulate(now + slope, axis=1)[:, :-1] - slope[1:] - gap_open
            np.maximum(now[:, 1:], above, out=now[:, 1:])
        h = np.where(padded[:, j : j + 1] >= 0, now, 0)
        at = h.argmax(1)
        value = h[every, at]
        better = value > best
        best[better], row[better], column[better] = value[better], at[better], j
        if stop is not None and (best >= stop).all():
            break
    return best, row, column


def local_alignments(u: np.ndarray, vs: list[np.ndarray], scores: Scores, gap_open: int, gap_ext: int, ends_only: bool = False) -> list[tuple[int, int, int, int, int]]:
    """(score, u start, u length, v start, v length) for each of vs; lengths are 0 and
    starts are ends for ends_only."""
    best, row, column = local_ends(u, vs, scores, gap_open, gap_ext)
    out = []
    for k, v in enumerate(vs):
        s, i, j = int(best[k]), int(row[k]), int(column[k])
        if s == 0 or ends_only:
            out.append((s, i if s else 0, 0, j if s else 0, 0))
            continue
        _, r, c = local_ends(u[: i + 1][::-1], [v[: j + 1][::-1]], scores, gap_open, gap_ext, stop=s)
        out.append((s, i - int(r[0]), int(r[0]) + 1, j - int(c[0]), int(c[0]) + 1))
    return out


def global_alignment(u: np.ndarray, v: np.ndarray, scores: Scores, gap_open: int, gap_ext: int, expected: int | None = None) -> tuple[int, str]:
    """(score, CIGAR) of a best global alignment. D takes from u, I from v; preferred are
    matches, then deletions, then insertions, read from the end.

    Only a band around the diagonal is computed, and doubled until it is wide enough: until
    the expected score is reached or, without one, until no alignment that leaves the band
    can reach the score found, as it would need too many gaps. Of a band's rows only one
    is kept as numbers; of each cell the steps that lead to it, in a byte."""
    m, n = len(u), len(v)
    band, most = abs(m - n) + 8, int(scores.table.max())
    while True:
        score, text = _banded(u, v, scores, gap_open, gap_ext, band)
        if band >= max(m, n) or (expected is not None and score >= expected):
            return score, text
        if expected is None and score > _beyond(m, n, most, gap_open, gap_ext, band):
            return score, text
        band *= 2


def _beyond(m: int, n: int, most: int, gap_open: int, gap_ext: int, band: int) -> float:
    """No alignment that leaves the band scores more: it goes `out` characters off the
    diagonal and back to the end, and what it skips isn't matched."""
    differ = abs(m - n)
    out = band + 1 - differ
    gaps = max(differ, 2 * out - differ)
    return most * max(0, m + n - gaps) / 2 - gap_open * (2 if out > differ else 1) - gap_ext * gaps if most > 0 else -gap_ext * gaps


_DIAGONAL, _DELETED, _OPENS_D, _OPENS_I = 1, 2, 4, 8


def _banded(u, v, scores, gap_open, gap_ext, band) -> tuple[int, str]:
    m, n = len(u), len(v)
    band = min(band, max(m, n))
    width = min(n, 2 * band) + 2
    offsets = np.maximum(0, -((band * m - np.arange(m + 1) * n) // max(1, m)))  # each row's first column
    steps = np.zeros((m + 1, width), dtype=np.uint8)
    k = np.arange(width)
    slope, opening = k * gap_ext, gap_open + gap_ext

    def outside(i: int) -> np.ndarray:
        j = offsets[i] + k
        return (j > n) | (np.abs(j * max(1, m) - i * n) > band * max(1, m))

    h = np.where(k == 0, 0, -gap_open - gap_ext * k)
    h[outside(0)] = _LOW
    d = np.full(width, _LOW, dtype=np.int64)
    steps[0, 1:] = np.where(h[:-1] - opening == h[1:], _OPENS_I, 0)
    table, low = np.vstack([scores.table, scores.table[-1:]]), np.full(width + 2, _LOW, dtype=np.int64)
    letters = np.concatenate([v, np.zeros(width + 1, dtype=np.int64)])
    for i in range(1, m + 1):
        at, moved = int(offsets[i]), int(offsets[i] - offsets[i - 1])
        above, before = (np.concatenate([low[:1], x, low[: moved + 1]])[moved : moved + width + 1] for x in (h, d))
        opened = above[1:] - opening
        d = np.maximum(before[1:] - gap_ext, opened)
        diagonal = above[:-1] + (table[u[i - 1]][letters[at - 1 : at - 1 + width]] if at else np.concatenate([low[:1], table[u[i - 1]][letters[: width - 1]]]))
        now = np.maximum(d, diagonal)
        shut = outside(i)
        now[shut] = _LOW
        left = np.concatenate([low[:1], np.maximum.accumulate(now + slope)[:-1] - slope[1:] - gap_open])
        left[shut] = _LOW
        h = np.maximum(now, left)
        bits = np.where(h == diagonal, _DIAGONAL, 0) | np.where(h == d, _DELETED, 0) | np.where(d == opened, _OPENS_D, 0)
        bits[1:] |= np.where(h[:-1] - opening == left[1:], _OPENS_I, 0)
        steps[i] = bits
    score = int(h[n - offsets[m]])
    i, j, state, ops = m, n, "h", []
    while i or j:
        bits = int(steps[i, j - offsets[i]])
        if state == "h":
            if i and j and bits & _DIAGONAL:
                ops.append("=" if u[i - 1] == v[j - 1] and u[i - 1] < len(scores.characters) else "X")
                i, j = i - 1, j - 1
            else:
                state = "d" if i and bits & _DELETED else "i"
        elif state == "d":
            ops.append("D")
            state = "h" if bits & _OPENS_D else "d"
            i -= 1
        else:
            ops.append("I")
            state = "h" if bits & _OPENS_I else "i"
            j -= 1
    text, at = [], len(ops)
    while at:
        k = at - 1
        while k and ops[k - 1] == ops[at - 1]:
            k -= 1
        text.append(f"{at - k}{ops[at - 1]}")
        at = k
    return score, "".join(text)


_ALIGNED = "s_id long, q_id long, s_start int, s_len int, q_start int, q_len int, score int, strand string, cigar string"


def align_pairs(pairs: DataFrame, first: DataFrame, second: DataFrame | None = None, matrix: str = "blosum62", gap_open: int = 11, gap_ext: int = 1, both_strands: bool = False, ends_only: bool = False, with_cigar: bool = False) -> DataFrame:
    """(s_id, q_id, s_start, s_len, q_start, q_len, score, strand, cigar): a local
    alignment of each pair (a, b) of sequences (seq_id, sequence) of two tables, or of
    one with itself. With both_strands the second sequence's reverse complement is
    taken if its alignment is better in score, then in total length; q_start then is
    that of the forward sequence."""
    second = first if second is None else second
    a = first.select(F.col("seq_id").alias("a"), F.col("sequence").alias("_u"))
    b = second.select(F.col("seq_id").alias("b"), F.col("sequence").alias("_v"))
    rows = pairs.select("a", "b").join(a, "a").join(b, "b").select("a", "b", "_u", "_v")
    table = named(matrix)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = list(zip(*(batch.column(i).to_pylist() for i in range(4))))
            out, at = [], 0
            while at < len(data):
                end = at
                while end < len(data) and data[end][0] == data[at][0] and end - at < 64:
                    end += 1
                u_text, part = data[at][2], data[at:end]
                u = table.encode(u_text)
                vs = [table.encode(x[3]) for x in part]
                found = local_alignments(u, vs, table, gap_open, gap_ext, ends_only)
                if both_strands:
                    turned = [x[3][::-1].translate(str.maketrans("ACGTacgt", "TGCAtgca")) for x in part]
                    other = local_alignments(u, [table.encode(x) for x in turned], table, gap_open, gap_ext, ends_only)
                for k, x in enumerate(part):
                    s, us, ul, vstart, vl = found[k]
                    strand, v = "+", vs[k]
                    if both_strands and (other[k][0], other[k][2] + other[k][4]) > (s, ul + vl):
                        s, us, ul, vstart, vl = other[k]
                        strand, v = "-", table.encode(turned[k])
                    text = None
                    if with_cigar and ul:
                        text = global_alignment(u[us : us + ul], v[vstart : vstart + vl], table, gap_open, gap_ext, s)[1]
                    out.append((x[0], x[1], us, ul, len(x[3]) - vstart - vl if strand == "-" else vstart, vl, s, strand if both_strands else None, text))
                at = end
            types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string())
            columns = list(zip(*out)) or [()] * 9
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=[f.split()[0] for f in _ALIGNED.split(", ")])

    tasks = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(tasks, "a", (F.col("b") % 16)).sortWithinPartitions("a", "b").mapInArrow(run, _ALIGNED)


def best(alignments: DataFrame, k: int) -> DataFrame:
    """The k best: by score, then total length, then ids; a bounded heap a task."""
    return alignments.orderBy(F.col("score").desc(), (F.col("s_len") + F.col("q_len")).desc(), "s_id", "q_id").limit(k)


def best_per_sequence(alignments: DataFrame, k: int = 1) -> DataFrame:
    w = Window.partitionBy("s_id").orderBy(F.col("score").desc(), (F.col("s_len") + F.col("q_len")).desc(), "q_id")
    return alignments.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")


def with_bit_scores(alignments: DataFrame, gap_open: int = 11, gap_ext: int = 1, least: int | None = None) -> DataFrame:
    out = alignments.withColumn("bit_score", K.bit_score(F.col("score"), gap_open, gap_ext))
    return out if least is None else out.where(F.col("bit_score") >= least)


def report(alignments: DataFrame, first: DataFrame, second: DataFrame | None = None) -> DataFrame:
    """Coverages, identity and aligned substrings beside each alignment."""
    second = first if second is None else second
    a = first.select(F.col("seq_id").alias("s_id"), F.col("sequence").alias("_u"))
    b = second.select(F.col("seq_id").alias("q_id"), F.col("sequence").alias("_v"))
    d = alignments.join(a, "s_id").join(b, "q_id")
    return d.select(
        *alignments.columns, K.coverage(F.col("s_len"), F.length("_u")).alias("s_coverage"), K.coverage(F.col("q_len"), F.length("_v")).alias("q_coverage"),
        F.round(K.identity(F.col("cigar")), 2).alias("identity"), F.substr("_u", F.col("s_start") + 1, F.col("s_len")).alias("s_substring"), F.substr("_v", F.col("q_start") + 1, F.col("q_len")).alias("q_substring"),
    )


def display(u: str, v: str, cigar: str, width: int = 60) -> str:
    """Three lines a block: both sequences with gaps, and bars at equal characters."""
    if width < 8:
        raise ValueError("the width of an alignment is 8 or more")
    import re

    top, middle, bottom, i, j = "", "", "", 0, 0
    for n, op in re.findall(r"(\d+)([=XIDM])", cigar):
        n = int(n)
        a = "-" * n if op == "I" else u[i : i + n]
        b = "-" * n if op == "D" else v[j : j + n]
        top, bottom = top + a, bottom + b
        middle += "".join("|" if x == y else " " for x, y in zip(a, b))
        i, j = i + (op != "I") * n, j + (op != "D") * n
    blocks = [f"{top[k : k + width]}\n{middle[k : k + width]}\n{bottom[k : k + width]}" for k in range(0, len(top), width)]
    return "\n\n".join(blocks)
