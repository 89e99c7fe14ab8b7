"""Sketches and counts over streams of sequences.

A sketch's slot counts are plain sums, so a stream updates them with a streaming
aggregation, whose state is one row a used slot."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from strandlake.operators.qgrams import qgram_values
from strandlake.operators.sketch import slots


def fasta_stream(spark: SparkSession, folder: str) -> DataFrame:
    """(seq_id, header, sequence) of FASTA files as they arrive in a folder; a record
    is what stands between two header signs."""
    raw = spark.readStream.option("lineSep", "\n>").text(folder).where(F.trim("value") != "")
    parts = F.split(F.regexp_replace("value", "^>", ""), "\n", 2)
    return raw.select(F.xxhash64("value").alias("seq_id"), parts[0].alias("header"), F.regexp_replace(F.get(parts, 1), r"\s", "").alias("sequence"))


def slot_stream(sequences: DataFrame, q: int = 32, s: int = 7, r: int = 27) -> DataFrame:
    """(slot, n) over all sequences so far, of a stream or a table."""
    return slots(qgram_values(sequences, q, columns=("value",), top_zero_bits=s), s, r)


def windowed_counts(events: DataFrame, time: str, key: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts by key in tumbling windows; rows later than the watermark are dropped."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), key).agg(F.count("*").alias("n"))


def into_table(sequences: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Append a stream of sequences to a Parquet table, once per input file."""
    return sequences.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
