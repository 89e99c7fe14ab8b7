"""Writers of sequences and indexes."""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.functions import alphabet as A


def fasta_text(width: int = 0, short: bool = False) -> Column:
    header = A.short_header(F.col("header")) if short else F.col("header")
    return F.concat(F.lit(">"), header, F.lit("\n"), A.wrapped(F.col("sequence"), width))


def fastq_text() -> Column:
    return F.concat_ws("\n", F.concat(F.lit("@"), F.col("header")), F.col("sequence"), F.lit("+"), F.col("quality"))


def compression(level: int) -> str:
    """0 is plain text; 1 to 9 gzip; more is an error."""
    if not 0 <= level <= 9:
        raise ValueError("a compression level is 0 to 9")
    return "gzip" if level else "none"


def write_fasta(sequences: DataFrame, path: str, width: int = 0, short: bool = False, level: int = 0, files: int | None = None) -> None:
    """In order of seq_id over the part files, whose names sort in that order. FASTQ
    rows convert to FASTA the same way."""
    ordered = sequences.repartitionByRange(files, "seq_id") if files else sequences.repartitionByRange("seq_id")
    ordered.sortWithinPartitions("seq_id").select(fasta_text(width, short).alias("value")).write.option("compression", compression(level)).text(path)


def write_fastq(sequences: DataFrame, path: str, level: int = 0, files: int | None = None) -> None:
    ordered = sequences.repartitionByRange(files, "seq_id") if files else sequences.repartitionByRange("seq_id")
    ordered.sortWithinPartitions("seq_id").select(fastq_text().alias("value")).write.option("compression", compression(level)).text(path)


def write_parts(sequences: DataFrame, parts: DataFrame, path: str, width: int = 0) -> None:
    """A folder for each part (seq_id, part) of the sequences."""
    rows = sequences.join(parts.select(F.col("seq_id").alias("_id"), "part"), F.col("seq_id") == F.col("_id"))
    rows.repartition("part").sortWithinPartitions("part", "seq_id").select("part", fasta_text(width).alias("value")).write.partitionBy("part").text(path)


def write_index(table: DataFrame, path: str, parameters: dict, by: str | None = None, buckets: int = 200) -> None:
    """A Parquet table with the parameters that it was made with. With `by`, rows are in
    buckets by the hash of that column, one sorted file each: two such indexes of as many
    buckets are joined, and one is grouped, without another shuffle."""
    spark = table.sparkSession
    if by is None:
        table.write.parquet(f"{path}/table")
    else:
        name = f"index_{uuid.uuid4().hex}"
        table.repartition(buckets, by).write.bucketBy(buckets, by).sortBy(by).option("path", f"{path}/table").saveAsTable(name)
        spark.sql(f"DROP TABLE {name}")  # the name alone: its files are the index
    facts = [(json.dumps(parameters, sort_keys=True), by, buckets if by else None)]
    spark.createDataFrame(facts, "parameters string, by string, buckets int").coalesce(1).write.parquet(f"{path}/parameters")


def read_index(spark: SparkSession, path: str, parameters: dict) -> DataFrame:
    """The table, if it was made with these parameters; else an error. Buckets are known
    to Spark by a name in the session's catalog."""
    facts = spark.read.parquet(f"{path}/parameters").first()
    made = json.loads(facts["parameters"])
    if made != parameters:
        raise ValueError(f"{path}: the index was made with {made}, not {parameters}")
    plain = spark.read.parquet(f"{path}/table")
    if facts["by"] is None:
        return plain
    name, where = f"index_{hashlib.sha256(path.encode()).hexdigest()[:32]}", path.replace("'", "\\'")
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema)
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet CLUSTERED BY (`{facts['by']}`) SORTED BY (`{facts['by']}`) INTO {facts['buckets']} BUCKETS LOCATION '{where}/table'")
    return spark.table(name)
