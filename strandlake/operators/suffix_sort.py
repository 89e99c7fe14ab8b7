"""Suffixes in order, by recursive naming of a sample: a difference cover modulo 3.

Suffixes at positions 1 and 2 modulo 3 are the sample, two thirds of all. They are named by
their first HEAD characters. If all names differ, names are ranks; else the names of every
third position are shorter texts, whose suffixes have the order of the sample's, and those
are sorted the same way, each level two thirds of the one before. A level of at most LOCAL
symbols is sorted in one task. So the number of levels follows from the size of the texts
alone; a long repeat costs no more of them than a text without any.

The other suffixes, at 0 modulo 3, are a character and a sampled suffix, or two characters
and a sampled suffix of the other class. So two range-partitioned sorts, each of them
together with one class of the sample, tell how many of the other side come before each
suffix, and counts add up to ranks: no comparison but of sort keys.

Suffixes end where their text ends; one that is another's prefix comes first, and equal
ones go by seq_id."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlake.operators.stats import counted_in_order, ranked
from strandlake.sources.tables import written

#: Characters by which suffixes are named first.
HEAD = 32
#: Symbols that one task sorts.
LOCAL = 1 << 20
_CHUNK = 1 << 16


def heads(texts: DataFrame, n: int = HEAD, size: int = 256) -> DataFrame:
    """(seq_id, pos, head): the first n characters of each suffix, fewer at the end of a
    text. They are cut out of chunks of `size` starts, not of the whole text each."""
    chunks = texts.where(F.length("sequence") > 0).select("seq_id", "sequence", F.explode(F.sequence(F.lit(0), F.length("sequence") - 1, F.lit(size))).alias("at"))
    chunks = chunks.select("seq_id", "at", F.substr("sequence", F.col("at") + 1, F.lit(size + n - 1)).alias("chunk"))
    starts = chunks.select("seq_id", "at", "chunk", F.explode(F.sequence(F.lit(0), F.least(F.lit(size), F.length("chunk")) - 1)).alias("i"))
    return starts.select("seq_id", (F.col("at") + F.col("i")).alias("pos"), F.substr("chunk", F.col("i") + 1, F.lit(n)).alias("head"))


def local_ranks(text: np.ndarray, symbols: np.ndarray) -> np.ndarray:
    """Ranks of the suffixes of texts, given one after another: `text` is each symbol's
    text, ascending. Ranks by 1, 2, 4, ... symbols, in memory; equal suffixes by text."""
    n = len(symbols)
    at, end = np.arange(n), np.searchsorted(text, text, side="right")
    _, rank = np.unique(symbols, return_inverse=True)
    different, step = -1, 1
    while True:
        after = at + step
        second = np.where(after < end, rank[np.minimum(after, n - 1)] + 1, 0)
        values, rank = np.unique(rank * (n + 1) + second, return_inverse=True)
        if len(values) in (n, different):
            break
        different, step = len(values), 2 * step
    out = np.empty(n, dtype=np.int64)
    out[np.lexsort((text, rank))] = at
    return out


def _in_one_task(named: DataFrame) -> DataFrame:
    """(t, k, p, rank) of (t, k, p, name), which has at most LOCAL rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        if table.num_rows:
            t, k, p, name = (c.to_numpy() for c in table.columns)
            own = np.cumsum(np.r_[0, (np.diff(t) != 0) | (np.diff(k) != 0)])
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (t, k, p, local_ranks(own, name))], names=["t", "k", "p", "rank"])

    return named.repartition(1).sortWithinPartitions("t", "k", "p").mapInArrow(run, "t long, k long, p long, rank long")


def _triples(named: DataFrame) -> DataFrame:
    """Names (t, k, p, name) as a level of its own: two symbols and a head of three. Chunks
    of positions have the next chunk's first two rows too, so windows are bounded."""
    chunk = F.floor(F.col("p") / _CHUNK)
    both = F.when((F.col("p") % _CHUNK < 2) & (F.col("p") >= _CHUNK), F.array(chunk, chunk - 1)).otherwise(F.array(chunk))
    rows = named.select("t", "k", "p", "name", F.explode(both).alias("chunk"))
    w = Window.partitionBy("t", "k", "chunk").orderBy("p")
    second, third = (F.coalesce(F.lead("name", i).over(w), F.lit(-1)) for i in (1, 2))
    rows = rows.select("t", "k", "p", "chunk", F.col("name").alias("c0"), second.alias("c1"), third.alias("c2")).where(F.col("chunk") == chunk)
    return written(rows.select("t", "k", "p", "c0", "c1", F.struct("c0", "c1", "c2").alias("head")), "symbols")


def _solved(level: DataFrame, none) -> DataFrame:
    """(t, k, p, rank) of a level's suffixes (t, k, p, c0, c1, head): ranks are 0, 1, ...
    without ties. `none` stands for a missing symbol and is less than any."""
    sample = level.where("p % 3 <> 0").select("t", "k", "p", "head")
    values = ranked(sample.select("head").distinct(), "head").select(F.col("head").alias("_head"), F.col("rank").alias("name"))
    named = written(sample.join(values, F.col("head") == F.col("_head")).select("t", "k", "p", "name"), "names")
    size = named.agg(F.count("*").alias("n"), F.max("name").alias("top")).first()
    if not size["n"] or size["top"] + 1 == size["n"]:
        ranks = named.withColumnRenamed("name", "rank")
    else:
        shorter = named.select("t", (F.col("k") * 2 + F.col("p") % 3 - 1).alias("k"), F.floor(F.col("p") / 3).alias("p"), "name")
        below = _in_one_task(shorter) if size["n"] <= LOCAL else _solved(_triples(shorter), F.lit(-1))
        ranks = written(below.select("t", F.floor(F.col("k") / 2).alias("k"), (F.col("p") * 3 + F.col("k") % 2 + 1).alias("p"), "rank"), "ranks")
    # Each sampled rank goes to its own position and to the two before it.
    slots = F.array(*[F.struct((F.col("p") - i).alias("p"), *[(F.col("rank") if i == j else F.lit(None).cast("long")).alias(f"r{j}") for j in range(3)]) for i in range(3)])
    given = ranks.select("t", "k", F.explode(slots).alias("x")).select("t", "k", "x.*").where("p >= 0")
    own = level.select("t", "k", "p", "c0", "c1")
    keys = own.unionByName(given, allowMissingColumns=True).groupBy("t", "k", "p").agg(*[F.max(c).alias(c) for c in ("c0", "c1", "r0", "r1", "r2")])
    place = F.col("p") % 3
    keys = written(keys.withColumn("zero", place == 0), "keys")
    missing = lambda c: F.coalesce(c, F.lit(-1))
    keep = ["t", "k", "p", "r0"]
    first = counted_in_order(keys.where(place < 2).withColumn("_r", missing("r1")), keep, "zero", "c0", "_r", "t")
    second = counted_in_order(keys.where(place != 1).withColumn("_r", missing("r2")).withColumn("_c", F.coalesce("c1", none)), keep, "zero", "c0", "_c", "_r", "t")
    value = lambda both: F.when(F.col("zero"), both).otherwise(F.col("r0") + F.col("_n1"))
    parts = first.select("t", "k", "p", value(F.col("_n0") + F.col("_n1")).alias("n")).unionByName(second.select("t", "k", "p", value(F.col("_n0")).alias("n")))
    return written(parts.groupBy("t", "k", "p").agg(F.sum("n").alias("rank")), "ranks")


def in_order(texts: DataFrame) -> DataFrame:
    """(seq_id, pos, head, rank) of all suffixes of texts (seq_id, sequence)."""
    first = written(heads(texts).select(F.col("seq_id").alias("t"), F.lit(0).cast("long").alias("k"), F.col("pos").cast("long").alias("p"), F.substr("head", F.lit(1), F.lit(1)).alias("c0"), F.substr("head", F.lit(2), F.lit(1)).alias("c1"), "head"), "heads")
    ranks = _solved(first, F.lit("")).select(F.col("t").alias("_t"), F.col("p").alias("_p"), "rank")
    return written(first.join(ranks, (F.col("t") == F.col("_t")) & (F.col("p") == F.col("_p"))).select(F.col("t").alias("seq_id"), F.col("p").cast("int").alias("pos"), "head", "rank"), "suffixes")
