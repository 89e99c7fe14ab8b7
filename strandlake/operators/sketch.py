"""Distinct counts and frequency moments of q-grams by a sampled counting sketch.

A hash is sampled if its top s bits are zero, and its lowest r bits are its slot. No
table of 2**r slots is made: used slots are groups of an aggregation, so one task's
partial counts and another's merge like any other sum, also over a stream."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Largest count of a slot.
SATURATED = 65_535


def slots(hashes: DataFrame, s: int = 7, r: int = 27, column: str = "value") -> DataFrame:
    """(slot, n) of sampled hashes; the sample is taken before the shuffle."""
    h = F.col(column)
    kept = hashes if s == 0 else hashes.where(F.shiftrightunsigned(h, 64 - s) == 0)
    return kept.groupBy(h.bitwiseAND(F.lit((1 << r) - 1)).alias("slot")).agg(F.count("*").alias("n"))


def merged(*parts: DataFrame) -> DataFrame:
    """Slots of several inputs as one."""
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    return both.groupBy("slot").agg(F.sum("n").alias("n"))


def slot_histogram(slot_rows: DataFrame) -> DataFrame:
    """(count, slots): how many slots have a count, which saturates."""
    return slot_rows.groupBy(F.least("n", F.lit(SATURATED)).alias("count")).agg(F.count("*").alias("slots"))


def f0(slot_rows: DataFrame, s: int = 7, r: int = 27) -> DataFrame:
    """One row: distinct hashes as estimated from the share of empty slots. An error
    if no slot is empty."""
    empty = (F.lit(float(1 << r)) - F.count("*")) / float(1 << r)
    estimate = F.when(F.count("*") < (1 << r), -F.ln(empty) * float(1 << (s + r)))
    checked = F.coalesce(estimate, F.raise_error(F.lit("no slot of the sketch is empty")).cast("double"))
    return slot_rows.agg(checked.alias("f0"))


def bitmaps(hashes: DataFrame, *keys: str, s: int = 2, r: int = 22, column: str = "value") -> DataFrame:
    """(keys, bucket, bits): the state of a distinct count of each group, as bitmaps of
    32,768 slots. Bitmaps are built before the shuffle and joined behind it, so a group of
    any size is a few rows a task; states of several inputs merge by merged_bitmaps()."""
    h = F.col(column)
    kept = hashes.where(h.isNotNull() & (F.shiftrightunsigned(h, 64 - s) == 0 if s else F.lit(True)))
    slot = h.bitwiseAND(F.lit((1 << r) - 1))
    return kept.groupBy(*keys, F.bitmap_bucket_number(slot).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits"))


def merged_bitmaps(*parts: DataFrame) -> DataFrame:
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    keys = [c for c in both.columns if c != "bits"]
    return both.groupBy(*keys).agg(F.bitmap_or_agg("bits").alias("bits"))


def f0_by_group(states: DataFrame, *keys: str, s: int = 2, r: int = 22) -> DataFrame:
    """(keys, f0) of bitmaps(): distinct hashes of each group, from the share of empty
    slots; null if none is empty. Groups without a sampled hash have no row."""
    used = F.sum(F.bitmap_count("bits"))
    empty = (F.lit(float(1 << r)) - used) / float(1 << r)
    return states.groupBy(*keys).agg(F.when(used < (1 << r), -F.ln(empty) * float(1 << (s + r))).alias("f0"))


def moments(histogram: dict[int, int], s: int = 7, r: int = 27) -> dict:
    """f0, f1 and f[i], the estimated numbers of distinct hashes that occur i times,
    from a slot histogram (at most 65,535 entries). Each f[i] needs all before it."""
    size = 1 << r
    empty = size - sum(histogram.values())
    if empty <= 0:
        raise ValueError("no slot of the sketch is empty")
    most = max(histogram, default=0)
    share = [empty / size] + [histogram.get(i, 0) / size for i in range(1, most + 1)]
    log0 = math.log(share[0])
    distinct = -log0 * float(1 << (s + r))
    used = [j for j in range(1, most + 1) if share[j]]
    f = [0.0] * (most + 1)
    for i in range(1, most + 1):
        # The sum over j < i of j f[j] share[i - j], by the non-zero shares.
        convolved = sum((i - k) * f[i - k] * share[k] for k in used if k < i)
        f[i] = -share[i] / (share[0] * log0) - convolved / (i * share[0]) if log0 else 0.0
    f = [x * distinct for x in f]
    return {"f0": distinct, "f1": sum(i * x for i, x in enumerate(f)), "f": f, "repeats": distinct + 2 * (distinct - (f[1] if most else 0.0))}


def moments_table(slot_rows: DataFrame, s: int = 7, r: int = 27, most: int | None = 999) -> DataFrame:
    """(i, f_i) up to `most`, or all if that is None."""
    spark = slot_rows.sparkSession
    histogram = {row["count"]: row["slots"] for row in slot_histogram(slot_rows).collect()}  # at most 65,535 rows
    f = moments(histogram, s, r)["f"]
    return spark.createDataFrame([(i, x) for i, x in enumerate(f) if 0 < i and (most is None or i <= most)], "i int, f_i double")
