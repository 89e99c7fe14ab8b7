"""Shortest words over an alphabet that no sequence has."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.functions import alphabet as A
from strandlake.functions import codes as C
from strandlake.operators.qgrams import qgram_values


def longest_needed(total_length: int, alphabet_size: int = 4) -> int:
    """A q at which some word must be missing."""
    return max(1, math.ceil(math.log(total_length + 1, alphabet_size) - 1e-12))


def _present(sequences: DataFrame, q: int, alphabet: str, both_strands: bool) -> DataFrame:
    rows = qgram_values(sequences, q, "code", alphabet, columns=("value", "rc_value") if both_strands else ("value",))
    seen = rows.select(F.col("value").alias("code"))
    if both_strands:
        seen = rows.select(F.explode(F.array("value", "rc_value")).alias("code"))
    return seen.distinct()


def missing_words(sequences: DataFrame, q: int, alphabet: str = A.DNA, both_strands: bool = False) -> DataFrame:
    """(word) of length q that don't occur; both_strands counts reverse complements."""
    spark = sequences.sparkSession
    every = spark.range(len(alphabet) ** q).select(F.col("id").alias("code"))
    left = every.join(_present(sequences, q, alphabet, both_strands), "code", "left_anti")
    return left.select((C.decode_code(F.col("code"), q) if alphabet == A.DNA else C.decode_protein_code(F.col("code"), q)).alias("word"))


def shortest_missing(sequences: DataFrame, alphabet: str = A.DNA, both_strands: bool = False) -> tuple[int, DataFrame]:
    """(q, words): the least q with a missing word. If a word is missing, so is every
    word that extends it; so q is found by halving, with one count a step."""
    total = sequences.agg(F.coalesce(F.sum(F.length("sequence")), F.lit(0)).alias("n")).first()["n"]
    low, high = 1, longest_needed(total * (2 if both_strands else 1), len(alphabet))
    while low < high:
        q = (low + high) // 2
        if _present(sequences, q, alphabet, both_strands).count() < len(alphabet) ** q:
            high = q
        else:
            low = q + 1
    return low, missing_words(sequences, low, alphabet, both_strands)
