"""q-gram enumeration.

Two forms give the same rows. The SQL form explodes substrings of valid runs and
suits short texts. The array form computes codes or hashes of a whole run at once
and streams them in Arrow batches; it is linear in the sequence length. Long
sequences may be cut with ranges.chunked() first: a q-gram belongs to the chunk in
which it starts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.functions import alphabet as A
from strandlake.functions import codes as C
from strandlake.operators.ranges import chunked, ranges


def qgram_rows(sequences: DataFrame, q: int, alphabet: str = A.DNA) -> DataFrame:
    """(seq_id, range_start, pos, qgram) of all valid q-grams, upper-cased for DNA.
    Runs shorter than q are dropped before anything is exploded."""
    r = ranges(sequences, A.valid(alphabet), least=q)
    run = F.translate(F.upper("run"), "U", "T") if alphabet == A.DNA else F.col("run")
    r = r.select("seq_id", F.col("start").alias("range_start"), run.alias("run"), F.explode(F.sequence(F.lit(0), F.col("len") - q)).alias("i"))
    return r.select("seq_id", "range_start", (F.col("range_start") + F.col("i")).alias("pos"), F.substr("run", F.col("i") + 1, F.lit(q)).alias("qgram"))


def windows_with_wildcards(sequences: DataFrame, q: int, columns: tuple[str, ...] | None = None, size: int = 1 << 18, batch_chars: int = 1 << 20) -> DataFrame:
    """(seq_id, pos, qgram, wildcards): every window of q characters, valid or not.
    `columns` names those that are wanted: others aren't made or moved.

    Sequences of a batch are joined, and the invalid characters of all windows are
    differences of one running count."""
    types = {"seq_id": pa.int64(), "pos": pa.int64(), "qgram": pa.string(), "wildcards": pa.int32()}
    names = list(columns or types)

    def made(keys: list, texts: list[str]) -> pa.RecordBatch:
        text = "\n".join(texts)
        before = np.concatenate([[0], np.cumsum(C.ranks(text) >= len(A.DNA), dtype=np.int32)])
        lengths = np.array([len(t) for t in texts], dtype=np.int64)
        starts = np.cumsum(lengths + 1) - lengths - 1
        n = np.maximum(lengths - q + 1, 0)
        local = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        at = local + np.repeat(starts, n)
        ids, offsets = np.array(keys, dtype=np.int64).reshape(-1, 2).T
        values = {
            "seq_id": lambda: np.repeat(ids, n), "pos": lambda: local + np.repeat(offsets, n),
            "qgram": lambda: [text[i : i + q] for i in at.tolist()], "wildcards": lambda: before[at + q] - before[at],
        }
        return pa.RecordBatch.from_arrays([pa.array(values[x](), types[x]) for x in names], names=names)

    kinds = {"qgram": "string", "wildcards": "int"}
    return by_batch(chunked(sequences, size, q - 1), made, ", ".join(f"{x} {kinds.get(x, 'long')}" for x in names), batch_chars, ("seq_id", "offset"))


def qgram_values(sequences: DataFrame, q: int, kind: str = "hash", alphabet: str = A.DNA, reverse: bool = False, columns: tuple[str, ...] | None = None, top_zero_bits: int = 0, batch_chars: int = 1 << 20) -> DataFrame:
    """(seq_id, range_start, pos, value[, rc_value]) of all valid q-grams by arrays.
    kind: `hash` (rolling hash) or `code` (integer code). rc_value is the value of the
    reverse complement. `columns` names those that are wanted: others aren't made or
    moved. top_zero_bits keeps only values whose top bits are zero.

    Sequences of a batch are joined, with an invalid character between two, and every
    window of the whole text is computed at once; windows with an invalid character go."""
    if kind == "code" and len(alphabet) ** q > 2**63:
        raise ValueError(f"codes of q-grams of length {q} don't fit 63 bits")
    names = list(columns or ["seq_id", "range_start", "pos", "value", *(["rc_value"] if reverse else [])])

    def made(ids: list, texts: list[str]) -> pa.RecordBatch:
        w = Windows(ids, texts, q, alphabet)
        at = w.at
        values = {n: w.values(kind, n == "rc_value") for n in names if n in ("value", "rc_value") or top_zero_bits and n == "value"}
        if top_zero_bits:
            first = values["value"] if "value" in values else w.values(kind)
            few = np.flatnonzero(first.view(np.uint64) >> np.uint64(64 - top_zero_bits) == 0)
            at, values = at[few], {n: v[few] for n, v in values.items()}
        if set(names) & {"seq_id", "range_start", "pos"}:
            seq_id, pos, start = w.places(at)
            values |= {"seq_id": seq_id, "pos": pos, "range_start": start}
        return pa.RecordBatch.from_arrays([pa.array(values[n], pa.int64()) for n in names], names=names)

    return by_batch(sequences, made, ", ".join(f"{n} long" for n in names), batch_chars)


class Windows:
    """The valid q-grams of a batch of sequences, joined with an invalid character
    between two: `at` are their starts in the joined text."""

    def __init__(self, ids: list, texts: list[str], q: int, alphabet: str):
        self.ids, self.q, self.alphabet = np.asarray(ids, dtype=np.int64), q, alphabet
        self.lengths = np.array([len(t) for t in texts], dtype=np.int64)
        self.offsets = np.cumsum(np.concatenate([[0], self.lengths + 1]))[:-1]
        r = C.ranks("\n".join(texts), alphabet)
        self.bad = r >= len(alphabet)
        self.clean = np.where(self.bad, 0, r)
        before = np.concatenate([[0], np.cumsum(self.bad)])
        self.at = np.flatnonzero(before[q:] == before[:-q]) if len(r) >= q else np.zeros(0, np.int64)

    def values(self, kind: str, reverse: bool = False) -> np.ndarray:
        """Rolling hashes (kind `hash`) or integer codes (`code`) of the q-grams."""
        if not len(self.at):
            return np.zeros(0, np.int64)
        if kind == "hash":
            return C.window_hashes(self.clean, self.q, self.alphabet, reverse).view(np.int64)[self.at]
        return C.window_codes(self.clean, self.q, len(self.alphabet), reverse)[self.at]

    def texts_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.offsets, at, side="right") - 1

    def places(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(sequence, position, start of the valid run) of joined positions."""
        of = self.texts_of(at)
        last_bad = np.maximum.accumulate(np.where(self.bad, np.arange(len(self.bad)), -1))
        return self.ids[of], at - self.offsets[of], last_bad[at] + 1 - self.offsets[of]


def by_batch(sequences: DataFrame, made, schema: str, batch_chars: int = 1 << 20, keys: tuple[str, ...] = ("seq_id",)) -> DataFrame:
    """made(ids, texts) for sequences of about `batch_chars` characters at a time; null
    and empty ones are left out. Of several keys, ids are tuples."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts, held = [], [], 0
            named = [b.column(i).to_pylist() for i in range(len(keys))]
            for seq_id, sequence in zip(named[0] if len(keys) == 1 else zip(*named), b.column(len(keys)).to_pylist()):
                if sequence:
                    ids.append(seq_id), texts.append(sequence)
                    held += len(sequence)
                if held >= batch_chars:
                    yield made(ids, texts)
                    ids, texts, held = [], [], 0
            if texts:
                yield made(ids, texts)

    return sequences.select(*keys, "sequence").mapInArrow(run, schema)


def constant_distance(qgrams: DataFrame, window: int) -> DataFrame:
    """Every window-th q-gram of each range, from its first on."""
    return qgrams.where((F.col("pos") - F.col("range_start")) % window == 0)


def counts(qgrams: DataFrame, column: str = "qgram") -> DataFrame:
    return qgrams.groupBy(column).agg(F.count("*").alias("n"))


def suffix_count(sequences: DataFrame, p: int) -> DataFrame:
    """How many suffixes of length p or more all sequences have."""
    n = F.when(F.length("sequence") >= p, F.length("sequence") - p + 1).otherwise(0)
    return sequences.agg(F.coalesce(F.sum(n), F.lit(0)).cast("long").alias("suffixes"))


def suffixes(sequences: DataFrame) -> DataFrame:
    """(seq_id, pos): every suffix."""
    return sequences.where(F.length("sequence") > 0).select("seq_id", F.explode(F.sequence(F.lit(0), F.length("sequence") - 1)).alias("pos"))


def characters(sequences: DataFrame) -> DataFrame:
    """(seq_id, pos, char): every character."""
    return sequences.where(F.length("sequence") > 0).select("seq_id", F.posexplode(F.filter(F.split("sequence", ""), lambda c: c != "")).alias("pos", "char"))


def numbers_without(spark, n: int, excluded: DataFrame) -> DataFrame:
    """0 to n - 1 without the numbers in column `number` of excluded."""
    return spark.range(n).select(F.col("id").alias("number")).join(excluded.select("number"), "number", "left_anti")
