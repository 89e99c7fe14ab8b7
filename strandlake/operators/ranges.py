"""Maximal runs of valid or invalid characters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.functions import alphabet as A


def ranges(sequences: DataFrame, inside: str = A.valid(A.DNA), invert: bool = False, least: int = 1) -> DataFrame:
    """(seq_id, range_no, start, len, run): maximal runs of characters in the class
    `inside`, or outside of it if `invert`; only runs of `least` or more.

    The text is cut once into alternating runs; starts are running sums of lengths in
    the row's own array, so nothing is shuffled."""
    outside = inside.replace("[^", "[") if inside.startswith("[^") else "[^" + inside[1:]
    parts = F.regexp_extract_all("sequence", F.lit(f"({inside}+|{outside}+)"), 1)
    taken = outside if invert else inside
    cut = sequences.select("seq_id", parts.alias("parts"))
    step = F.aggregate(
        "parts", F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,run:string>>)").alias("runs")),
        lambda a, p: F.struct((a["at"] + F.length(p)).alias("at"), F.when(p.rlike(f"^{taken}") & (F.length(p) >= least), F.concat(a["runs"], F.array(F.struct(a["at"].alias("start"), p.alias("run"))))).otherwise(a["runs"]).alias("runs")),
    )["runs"]
    out = cut.select("seq_id", F.posexplode(step).alias("range_no", "x"))
    return out.select("seq_id", F.col("range_no").cast("int").alias("range_no"), F.col("x.start").alias("start"), F.length("x.run").alias("len"), F.col("x.run").alias("run"))


def wildcard_ranges(sequences: DataFrame) -> DataFrame:
    return ranges(sequences, invert=True)


def backward_ranges(sequences: DataFrame, inside: str = A.valid(A.DNA)) -> DataFrame:
    return ranges(sequences, inside).orderBy("seq_id", F.col("start").desc())


def non_n_ranges(sequences: DataFrame, least: int = 1) -> DataFrame:
    """(seq_id, start, end) of runs without N; `end` is the run's last position."""
    found = ranges(sequences, "[^N]", least=least)
    return found.select("seq_id", "start", (F.col("start") + F.col("len") - 1).alias("end"))


def non_n_summary(sequences: DataFrame, least: int = 1) -> DataFrame:
    n = F.col("end") - F.col("start") + 1
    return non_n_ranges(sequences, least).agg(F.count("*").alias("ranges"), F.sum(n).cast("long").alias("total_length"), F.max(n).alias("max_length"))


def chunked(sequences: DataFrame, size: int, overlap: int) -> DataFrame:
    """Sequences cut into chunks that share `overlap` characters: (seq_id, offset,
    sequence). Makes one very long sequence many tasks' work; windows of up to
    overlap + 1 characters are each in the chunk where they start."""
    n = F.greatest(F.ceil((F.length("sequence") - overlap) / F.lit(size)), F.lit(1)).cast("int")
    pieces = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct((i * size).cast("long").alias("offset"), F.substr(F.col("sequence"), i * size + 1, F.lit(size + overlap)).alias("sequence")))
    return sequences.select("seq_id", F.explode(pieces).alias("c")).select("seq_id", "c.offset", "c.sequence")
