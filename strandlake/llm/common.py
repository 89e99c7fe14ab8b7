"""What the operators of this subpackage share: the shared work folder, written
tables that cut lineage, and the fixed word rule."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but space and the ASCII controls 9 to 13.
#: bytes.split() without arguments splits at exactly these characters.
WORD = r"[^\x20\x09-\x0D]+"

_local_folder: list[str] = []


def work_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share.
    Only where it is unset, as in local tests, a temporary folder is made."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _local_folder:
        _local_folder.append("file://" + tempfile.mkdtemp(prefix="strandlake-"))
    return _local_folder[0]


def new_path(spark: SparkSession, label: str) -> str:
    return f"{work_folder(spark)}/{label}-{uuid.uuid4().hex}"


#: Rows of whole texts that Python gets at once, where this module runs the job.
BATCH_ROWS = 2000


def written(df: DataFrame, label: str, block_bytes: int = 0) -> DataFrame:
    """Write df as Parquet to the shared folder and read it again: lineage ends
    here, and a lost executor costs no more than the tasks that read the table. While
    it is written, Arrow batches have at most BATCH_ROWS rows, as texts may be long.
    block_bytes: what a task holds of a file before it writes it, if not Parquet's 128 MB."""
    spark = df.sparkSession
    path, key = new_path(spark, label), "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    try:
        if not 0 < int(before) <= BATCH_ROWS:
            spark.conf.set(key, str(BATCH_ROWS))
        writer = df.write.option("parquet.block.size", block_bytes) if block_bytes else df.write
        writer.parquet(path)
    finally:
        spark.conf.set(key, before)
    return spark.read.schema(df.schema).parquet(path)


#: A table of keys is joined by broadcast for at most this many keys.
HOT_KEYS = 10_000


def hot_split_join(rows: DataFrame, keyed: DataFrame, key: str, of: str, n: str, total: int, how: str = "inner") -> DataFrame:
    """rows joined with `keyed` on rows.key = keyed.of, where a key may hold a large share
    of all rows. keyed has a row a key and its number of rows in column n, total is their
    sum. Keys with more than one row in HOT_KEYS are fewer than HOT_KEYS, whatever the
    size: those are broadcast, and their rows stay where they are. The rest are shuffled.
    how: inner or left. rows is read twice, so it should be a written table."""
    hot = F.col(n) * HOT_KEYS > F.lit(total)
    few = F.broadcast(keyed.where(hot))
    heavy = rows.join(few, F.col(key) == F.col(of))
    light = rows.join(F.broadcast(keyed.where(hot).select(F.col(of).alias("_hot"))), F.col(key) == F.col("_hot"), "left_anti")
    return heavy.unionByName(light.join(keyed.where(~hot), F.col(key) == F.col(of), how))


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(n)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the driver, as it is scanned; but if the scan has no more parts than
    there are cores, its rows are dealt out to all cores. The parts of so small a table
    are less than a row group of a file, so most would be empty and one task would do all
    the work. Rows and results are the same either way."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if 1 < cores and df.rdd.getNumPartitions() <= cores else df
