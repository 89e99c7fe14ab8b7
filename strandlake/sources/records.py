"""Readers of sequence files: Python data sources for FASTA and FASTQ, and scans of
lines, archives, match tables and typed binary columns.

    register(spark)
    spark.read.format("fasta").load("/data/*.fa.gz")

Each file is a partition, or several: a plain file is cut into byte ranges, and a
range begins at the first record that starts in it. Compressed files aren't cut. The
record's number in its range, and the range's first byte, give every record a
seq_id that grows in file order; `dense_ids` turns these into 0, 1, 2, ..."""

from __future__ import annotations

import fnmatch
import glob
import gzip
import io
import os
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

_SCHEMA = "file string, at long, header string, sequence string, quality string"


class CorruptSequence(ValueError):
    """A record that can't be read; the message has its file and line."""


def located(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a path or address (file, hdfs, s3, gs, ...), and the path there."""
    return pyarrow.fs.FileSystem.from_uri(path) if "://" in path else (pyarrow.fs.LocalFileSystem(), os.path.abspath(path))


def opened(path: str) -> io.BufferedReader:
    where, name = located(path)
    return io.BufferedReader(where.open_input_file(name), 1 << 20)


def size_of(path: str) -> int:
    where, name = located(path)
    return where.get_file_info(name).size


def open_any(path: str) -> io.BufferedReader:
    """A file for reading; gzip by its first bytes, whatever its name."""
    f = opened(path)
    return gzip.open(f, "rb") if f.peek(2)[:2] == b"\x1f\x8b" else f


def is_fastq(path: str) -> bool:
    return path.endswith((".fq", ".fastq", ".fq.gz", ".fastq.gz"))


def fasta_records(lines, name: str, line_number: int = 0) -> Iterator[tuple[int, str, str]]:
    """(first line's number, header, sequence). Empty lines are skipped; a record
    without a sequence, or text before the first header, is an error."""
    header, parts, first, n = None, [], 0, line_number
    for raw in lines:
        n += 1
        line = raw.rstrip(b"\r\n")
        if not line:
            continue
        if line[:1] == b">":
            if header is not None:
                if not parts:
                    raise CorruptSequence(f"{name}, line {n}: corrupted sequence")
                yield first, header, b"".join(parts).decode("latin-1")
            header, parts, first = line[1:].decode("utf-8", "replace"), [], n
        elif header is None:
            raise CorruptSequence(f"{name}, line {n}: corrupted sequence")
        else:
            parts.append(b"".join(line.split()))
    if header is None or not parts:
        raise CorruptSequence(f"{name}, line {n + 1}: corrupted sequence")
    yield first, header, b"".join(parts).decode("latin-1")


def fastq_records(lines, name: str, line_number: int = 0) -> Iterator[tuple[int, str, str, str]]:
    """(first line's number, header, sequence, quality), four lines a record; the third
    line isn't looked at, nor are qualities. An incomplete last record is left out."""
    held, n = [], line_number
    for raw in lines:
        n += 1
        line = raw.rstrip(b"\r\n")
        if not line and not held:
            continue
        held.append(line)
        if len(held) == 1 and line[:1] != b"@":
            raise CorruptSequence(f"{name}, line {n}: corrupted sequence")
        if len(held) == 4:
            yield n - 3, held[0][1:].decode("utf-8", "replace"), held[1].decode("latin-1"), held[3].decode("latin-1")
            held = []


class _Range(InputPartition):
    def __init__(self, path: str, start: int, end: int | None):
        self.path, self.start, self.end = path, start, end


def record_start(f, at: int, size: int, fastq: bool) -> int:
    """The byte of the first record that starts at `at` or later. A FASTQ record is a
    line with @ whose second next line begins with +."""
    if at == 0:
        return 0
    f.seek(at - 1)
    f.readline()  # to the start of a line
    while f.tell() < size:
        here = f.tell()
        line = f.readline()
        if not fastq:
            if line[:1] == b">":
                return here
        elif line[:1] == b"@":
            after = f.tell()
            f.readline()
            if f.readline()[:1] == b"+":
                return here
            f.seek(after)
    return size


def byte_ranges(path: str, parts: int, fastq: bool) -> list[tuple[int, int]]:
    """Byte ranges of whole records, of about equal size; compressed files are refused."""
    size = size_of(path)
    with opened(path) as f:
        if f.read(2) == b"\x1f\x8b":
            raise ValueError(f"{path}: a compressed file cannot be split")
        cuts = sorted({record_start(f, size * i // parts, size, fastq) for i in range(parts)} | {size})
    return list(zip(cuts, cuts[1:]))


def _paths(pattern: str) -> list[str]:
    """Files of a path, a folder or a pattern, or of several with commas, in order.
    Addresses keep their scheme and host, but for those of local files."""
    found = sorted(p for x in pattern.split(",") for p in _found(x.removeprefix("file://")))
    return [p for p in found if not os.path.basename(p).startswith(("_", "."))]


def _found(pattern: str) -> list[str]:
    if "://" not in pattern:
        names = glob.glob(os.path.join(pattern, "*")) if os.path.isdir(pattern) else glob.glob(pattern) or [pattern]
        missing = [p for p in names if not os.path.exists(p)]
    else:
        names, missing = _remote(*located(pattern), pattern)
    if missing:
        raise FileNotFoundError(f"{missing[0]}: cannot open file")
    return names


def _remote(where: pyarrow.fs.FileSystem, name: str, address: str) -> tuple[list[str], list[str]]:
    """Addresses of the files that a path or pattern of a file system stands for, and
    those of none. Patterns are in the last part only."""
    front = address[: -len(name)] if address.endswith(name) else address.split("://")[0] + "://"
    files = lambda folder: [i.path for i in where.get_file_info(pyarrow.fs.FileSelector(folder)) if i.type == pyarrow.fs.FileType.File]
    folder, last = os.path.split(name)
    if any(c in last for c in "*?["):
        names = [p for p in files(folder) if fnmatch.fnmatch(os.path.basename(p), last)]
    else:
        kind = where.get_file_info(name).type
        names = files(name) if kind == pyarrow.fs.FileType.Directory else [name] if kind == pyarrow.fs.FileType.File else []
    return [front + p for p in names], [] if names else [address]


class _Reader(DataSourceReader):
    def __init__(self, options, fastq: bool):
        self.paths, self.fastq = options["path"], fastq
        self.range_bytes = int(options.get("rangebytes", 64 << 20))

    def partitions(self):
        out = []
        for path in _paths(self.paths):
            with opened(path) as f:
                packed = f.read(2) == b"\x1f\x8b"
            size = size_of(path)
            if packed or size <= self.range_bytes:
                out.append(_Range(path, 0, None))
            else:
                out += [_Range(path, a, b) for a, b in byte_ranges(path, -(-size // self.range_bytes), self.fastq)]
        return out

    def read(self, partition):
        with open_any(partition.path) as f:
            if partition.end is not None:
                f.seek(partition.start)
                f = io.BytesIO(f.read(partition.end - partition.start))
            rows, held = [], 0
            records = fastq_records(f, partition.path) if self.fastq else fasta_records(f, partition.path)
            for r in records:
                rows.append((partition.path, partition.start + r[0], r[1], r[2], r[3] if self.fastq else None))
                held += len(r[2])
                if held > 8 << 20:
                    yield self.batch(rows)
                    rows, held = [], 0
            if rows:
                yield self.batch(rows)

    @staticmethod
    def batch(rows) -> pa.RecordBatch:
        types = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["file", "at", "header", "sequence", "quality"])


class FastaSource(DataSource):
    """Options: path (a file, a folder, a pattern, or several with commas), rangeBytes."""

    @classmethod
    def name(cls) -> str:
        return "fasta"

    def schema(self) -> str:
        return _SCHEMA

    def reader(self, schema):
        return _Reader({k.lower(): v for k, v in self.options.items()}, False)


class FastqSource(FastaSource):
    @classmethod
    def name(cls) -> str:
        return "fastq"

    def reader(self, schema):
        return _Reader({k.lower(): v for k, v in self.options.items()}, True)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FastaSource)
    spark.dataSource.register(FastqSource)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(seq_id, header, sequence, quality): FASTQ by the file name, else FASTA."""
    register(spark)
    kinds = {is_fastq(p) for p in _paths(path)}
    if len(kinds) > 1:
        raise ValueError("FASTA and FASTQ files cannot be read together")
    return dense_ids(spark.read.format("fastq" if kinds.pop() else "fasta").load(path))


def dense_ids(records: DataFrame) -> DataFrame:
    """Numbers 0, 1, ... in order of file and place, by a range-partitioned sort."""
    from strandlake.operators.stats import ranked

    return ranked(records, "file", "at").select(F.col("rank").alias("seq_id"), "header", "sequence", "quality")


def lines(spark: SparkSession, paths: list[str] | str, skip_empty: bool = False) -> DataFrame:
    """(value): lines of files as though joined; gzip by file name."""
    found = spark.read.text(paths)
    return found.where(F.length("value") > 0) if skip_empty else found


def match_table(spark: SparkSession, path: str) -> DataFrame:
    """(match_id, p_start, p_len, s_start, s_len, weight) from lines of five integers
    (starts and last positions on both sides, and a weight); other lines fail."""
    from strandlake.operators.stats import ranked

    rows = spark.read.text(path).where(~F.col("value").startswith("#") & (F.trim("value") != ""))
    f = F.split(F.trim("value"), r" +")
    whole = F.when((F.size(f) == 5) & F.forall(f, lambda x: x.rlike("^-?[0-9]+$")), f).otherwise(F.raise_error(F.concat(F.lit("not five integers: "), F.col("value"))).cast("array<string>"))
    n = rows.select(F.monotonically_increasing_id().alias("at"), whole.alias("f")).select("at", *[F.col("f")[i].cast("long").alias(f"c{i}") for i in range(5)])
    return ranked(n, "at").select(F.col("rank").alias("match_id"), F.col("c0").alias("p_start"), (F.col("c1") - F.col("c0") + 1).alias("p_len"), F.col("c2").alias("s_start"), (F.col("c3") - F.col("c2") + 1).alias("s_len"), F.col("c4").cast("double").alias("weight"))


def tagged_fields(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated rows under the columns that a line `# Fields: a, b, ...` names."""
    head = spark.read.text(path).where(F.col("value").startswith("# Fields:")).limit(1).collect()
    if not head:
        raise ValueError(f"{path}: no line of fields")
    names = [x.strip() for x in head[0]["value"].split(":", 1)[1].split(",")]
    return spark.read.schema(", ".join(f"`{n}` string" for n in names)).option("sep", "\t").option("comment", "#").option("mode", "FAILFAST").csv(path)


def pair_list(spark: SparkSession, path: str) -> DataFrame:
    """(a, b) of a tab-separated file; lines with # are skipped, no pair is an error."""
    pairs = spark.read.schema("a string, b string").option("sep", "\t").option("comment", "#").csv(path)
    if not pairs.limit(1).count():
        raise ValueError(f"{path}: no pairs")
    return pairs


def _pieces(spark: SparkSession, pieces: list[tuple[str, int, int]]) -> DataFrame:
    """A row and a partition for each piece (file, start, end) that a task reads."""
    rows = spark.createDataFrame(pieces, "file string, start long, end long")
    return rows.repartitionByRange(max(1, len(pieces)), "file", "start")


def tar_members(spark: SparkSession, path: str) -> DataFrame:
    """(archive, member, content) of tar files, plain or compressed (gz, bz2, xz). An
    archive is one task's work; it is read as a stream, a member at a time."""
    import tarfile

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for archive in b.column(0).to_pylist():
                with opened(archive) as f, tarfile.open(fileobj=f, mode="r|*") as tar:
                    for m in tar:
                        if m.isfile():
                            yield pa.RecordBatch.from_arrays([pa.array([archive]), pa.array([m.name]), pa.array([tar.extractfile(m).read()], pa.binary())], names=["archive", "member", "content"])

    return _pieces(spark, [(p, 0, 0) for p in _paths(path)]).mapInArrow(run, "archive string, member string, content binary")


def binary_column(spark: SparkSession, path: str, dtype: str = "<u4", piece: int = 1 << 24) -> DataFrame:
    """(file, at, value) of files that hold one column of fixed-width numbers. Pieces of
    `piece` numbers are tasks of their own, so a file may have any size."""
    import numpy as np

    width = np.dtype(dtype).itemsize

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, start, end in zip(*(b.column(i).to_pylist() for i in range(3))):
                with opened(name) as f:
                    f.seek(start * width)
                    for at in range(start, end, 1 << 20):
                        v = np.frombuffer(f.read(width * min(1 << 20, end - at)), dtype=dtype).astype(np.int64)
                        yield pa.RecordBatch.from_arrays([pa.array([name] * len(v)), pa.array(np.arange(at, at + len(v))), pa.array(v)], names=["file", "at", "value"])

    pieces = []
    for p in _paths(path):
        size = size_of(p)
        if size % width:
            raise ValueError(f"{p}: its size, {size}, is no multiple of {width}")
        pieces += [(p, at, min(at + piece, size // width)) for at in range(0, size // width, piece)]
    return _pieces(spark, pieces).mapInArrow(run, "file string, at long, value long")
