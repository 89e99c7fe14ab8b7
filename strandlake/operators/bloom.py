"""Bloom filters as tables of set bits."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.functions.codes import seeded_fnv, unsigned


def parameters(error: float, elements: int, hashes: int | None = None) -> tuple[int, int]:
    """(bits, hash functions) for an error rate, or bits for a given number of them."""
    if hashes is not None:
        return int(-elements * hashes / math.log(1 - error ** (1 / hashes))), hashes
    return int(elements * math.log(error) * -2.081368), int(math.log(error) * -1.4426950408889634)


def positions(value, bits: int, hashes: int):
    """The bit of each hash function, of a BIGINT column."""
    return F.array(*[(unsigned(seeded_fnv(value, i)) % F.lit(bits).cast("decimal(38,0)")).cast("long") for i in range(hashes)])


def blocked_positions(value, bits: int, hashes: int, block: int = 512):
    """All bits within one block, which the first hash function picks."""
    blocks = max(1, bits // block)
    at = (unsigned(seeded_fnv(value, 0)) % F.lit(blocks).cast("decimal(38,0)")).cast("long") * block
    return F.array(*[at + (unsigned(seeded_fnv(value, i + 1)) % F.lit(block).cast("decimal(38,0)")).cast("long") for i in range(hashes)])


def one_hash_positions(value, bits: int, hashes: int, block: int = 512):
    """One hash per value: its remainder picks the block, its 9-bit fields the bits."""
    h = seeded_fnv(value, 0)
    blocks = max(1, bits // block)
    at = (unsigned(h) % F.lit(blocks).cast("decimal(38,0)")).cast("long") * block
    second = seeded_fnv(value, 1)
    return F.array(*[at + F.pmod(F.shiftrightunsigned(h if i < 7 else second, 9 * (i % 7)), F.lit(block)) for i in range(hashes)])


def build(values: DataFrame, column: str, bits: int, hashes: int, kind=positions) -> DataFrame:
    """(bit): set bits. Parts of a filter merge by union and distinct."""
    return values.select(F.explode(kind(F.col(column).cast("long"), bits, hashes)).alias("bit")).distinct()


def contains(values: DataFrame, column: str, filter_bits: DataFrame, bits: int, hashes: int, kind=positions) -> DataFrame:
    """values with `contained`: all bits of the value are set. Bits are joined by
    their position; one row a value and function, none collected."""
    v = values.select(F.col(column)).distinct()
    asked = v.select(column, F.explode(F.array_distinct(kind(F.col(column).cast("long"), bits, hashes))).alias("bit"))
    hit = asked.join(filter_bits.withColumn("_set", F.lit(1)), "bit", "left").groupBy(column).agg((F.count("*") == F.count("_set")).alias("contained"))
    return values.join(hit, column)


def statistics(filter_bits: DataFrame, bits: int, elements: int, hashes: int) -> DataFrame:
    """(set_bits, fill, false_positive_rate, bits_per_element)."""
    n = F.count("*")
    return filter_bits.agg(n.alias("set_bits"), F.round(n / bits, 6).alias("fill"), F.round(F.pow(n / bits, F.lit(float(hashes))), 9).alias("false_positive_rate"), F.round(F.lit(bits / max(1, elements)), 6).alias("bits_per_element"))


def interleaved(values: DataFrame, column: str, bin_column: str, bits: int, hashes: int) -> DataFrame:
    """(bit, bins): for each bit position the bins (0 to 63) that set it, as a word."""
    each = values.select(F.call_function("shiftleft", F.lit(1).cast("long"), F.col(bin_column).cast("int")).alias("b"), F.explode(positions(F.col(column).cast("long"), bits, hashes)).alias("bit"))
    return each.groupBy("bit").agg(F.bit_or("b").alias("bins"))


def interleaved_membership(values: DataFrame, column: str, words: DataFrame, bits: int, hashes: int) -> DataFrame:
    """(value, bins): the bins whose filters hold the value, as a word."""
    v = values.select(column).distinct()
    asked = v.select(column, F.explode(F.array_distinct(positions(F.col(column).cast("long"), bits, hashes))).alias("bit"))
    return asked.join(words, "bit", "left").groupBy(column).agg(F.bit_and(F.coalesce("bins", F.lit(0).cast("long"))).alias("bins"))
