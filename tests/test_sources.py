"""Readers, writers and streams: round trips and corrupt input."""

import gzip
import io
import tarfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake.operators import partition
from strandlake.sources import records, sinks
from strandlake.streaming import sketches


@pytest.fixture
def sequences(spark):
    data = [(i, f"seq{i} number {i}", "ACGTN"[i % 5 :] * (1 + i * 7 % 40), "I" * len("ACGTN"[i % 5 :] * (1 + i * 7 % 40))) for i in range(60)]
    return spark.createDataFrame(data, "seq_id long, header string, sequence string, quality string")


def key(df):
    return sorted((r["seq_id"], r["header"], r["sequence"]) for r in df.collect())


@pytest.mark.parametrize("width,level,files", [(0, 0, 1), (60, 0, 3), (7, 6, 2)])
def test_fasta_round_trip(spark, sequences, tmp_path, width, level, files):
    path = str(tmp_path / "out")
    sinks.write_fasta(sequences, path, width, level=level, files=files)
    assert key(records.read(spark, path)) == key(sequences)


def test_fastq_round_trip_and_ranges(spark, sequences, tmp_path):
    path = str(tmp_path / "out")
    sinks.write_fastq(sequences, path, files=1)
    part = next(p for p in (tmp_path / "out").iterdir() if p.name.startswith("part-"))
    named = part.rename(tmp_path / "reads.fastq")
    records.register(spark)
    cut = records.dense_ids(spark.read.format("fastq").option("rangeBytes", 300).load(str(named)))
    assert key(cut) == key(sequences)
    assert cut.agg(F.sum(F.length("quality"))).first()[0] == sequences.agg(F.sum(F.length("sequence"))).first()[0]
    for n in (1, 3, 10):
        got = records.byte_ranges(str(named), n, True)
        assert got[0][0] == 0 and got[-1][1] == named.stat().st_size and all(a[1] == b[0] for a, b in zip(got, got[1:]))
    assert key(records.read(spark, str(named))) == key(sequences)


@pytest.mark.parametrize("text,line", [("", 1), (">only a header\n", 2), ("ACGT\n", 1), (">a\n>b\nACGT\n", 2), (">a\nAC\n>b\n>c\nAC\n", 4)])
def test_corrupt_records_name_their_line(text, line):
    with pytest.raises(records.CorruptSequence, match=f", line {line}: corrupted sequence"):
        list(records.fasta_records(io.BytesIO(text.encode()), "f"))


def test_records_of_odd_files(spark, tmp_path):
    assert [r[1:] for r in records.fasta_records(io.BytesIO(b"\n>a b\r\nAC GT\r\n\nTT"), "f")] == [("a b", "ACGTTT")]
    assert [r[1:] for r in records.fastq_records(io.BytesIO(b"@a\nAC\nanything\nII\n@b\nA\n+\n"), "f")] == [("a", "AC", "II")]
    with pytest.raises(records.CorruptSequence):
        list(records.fastq_records(io.BytesIO(b"a\nAC\n+\nII\n"), "f"))
    with pytest.raises(FileNotFoundError, match="cannot open file"):
        records.read(spark, str(tmp_path / "none.fa"))
    packed = tmp_path / "x.fa.gz"
    packed.write_bytes(gzip.compress(b">a\nACGT\n"))
    assert key(records.read(spark, str(packed))) == [(0, "a", "ACGT")]
    with pytest.raises(ValueError, match="cannot be split"):
        records.byte_ranges(str(packed), 2, False)
    with pytest.raises(ValueError):
        sinks.compression(10)


def test_tables_of_text(spark, tmp_path):
    (tmp_path / "m.txt").write_text("# c\n1 5 2 6 9\n7 9 8 10 4\n")
    assert [tuple(r) for r in records.match_table(spark, str(tmp_path / "m.txt")).orderBy("match_id").collect()] == [(0, 1, 5, 2, 5, 9.0), (1, 7, 3, 8, 3, 4.0)]
    (tmp_path / "bad.txt").write_text("1 5 2 6\n")
    with pytest.raises(Exception, match="not five integers"):
        records.match_table(spark, str(tmp_path / "bad.txt")).collect()
    (tmp_path / "t.tsv").write_text("# Fields: s.id, score\na\t5\nb\t6\n")
    assert [tuple(r) for r in records.tagged_fields(spark, str(tmp_path / "t.tsv")).collect()] == [("a", "5"), ("b", "6")]
    (tmp_path / "p.tsv").write_text("# only\n")
    with pytest.raises(ValueError):
        records.pair_list(spark, str(tmp_path / "p.tsv"))
    np.arange(9, dtype="<u4").tofile(tmp_path / "v.bin")
    assert [r["value"] for r in records.binary_column(spark, str(tmp_path / "v.bin")).orderBy("at").collect()] == list(range(9))
    assert [(r["at"], r["value"]) for r in records.binary_column(spark, f"file://{tmp_path}/v.bin", piece=2).orderBy("at").collect()] == [(i, i) for i in range(9)]
    (tmp_path / "odd.bin").write_bytes(b"12345")
    with pytest.raises(ValueError, match="no multiple of 4"):
        records.binary_column(spark, str(tmp_path / "odd.bin"))
    with tarfile.open(tmp_path / "a.tar.bz2", "w:bz2") as tar:
        for name in ("x", "y"):
            info = tarfile.TarInfo(name)
            info.size = 3
            tar.addfile(info, io.BytesIO(name.encode() * 3))
    assert sorted((r["member"], bytes(r["content"])) for r in records.tar_members(spark, str(tmp_path / "a.tar.bz2")).collect()) == [("x", b"xxx"), ("y", b"yyy")]
    assert records.lines(spark, [str(tmp_path / "m.txt"), str(tmp_path / "bad.txt")], True).count() == 4


def test_addresses_of_file_systems(tmp_path):
    import pyarrow.fs

    for name in ("a.fa", "b.fa", "c.txt"):
        (tmp_path / name).write_text(name)
    at = lambda name: records._remote(pyarrow.fs.LocalFileSystem(), f"{tmp_path}{name}", f"store://host{tmp_path}{name}")
    full = lambda *names: [f"store://host{tmp_path}/{n}" for n in names]
    assert sorted(at("")[0]) == full("a.fa", "b.fa", "c.txt")
    assert sorted(at("/*.fa")[0]) == full("a.fa", "b.fa")
    assert at("/c.txt") == (full("c.txt"), [])
    assert at("/none") == ([], full("none"))
    assert records.opened(f"file://{tmp_path}/a.fa").read() == b"a.fa" and records.size_of(f"file://{tmp_path}/c.txt") == 5


def test_parts_and_indexes(spark, sequences, tmp_path):
    parts = partition.in_parts(sequences, 4)
    sinks.write_parts(sequences, parts, str(tmp_path / "parts"), 30)
    assert sorted(p.name for p in (tmp_path / "parts").iterdir() if p.name.startswith("part=")) == [f"part={i}" for i in range(4)]
    sinks.write_index(parts, str(tmp_path / "index"), {"q": 5})
    assert sinks.read_index(spark, str(tmp_path / "index"), {"q": 5}).count() == 60
    with pytest.raises(ValueError, match="made with"):
        sinks.read_index(spark, str(tmp_path / "index"), {"q": 6})


def test_stream_of_files_equals_the_table(spark, sequences, tmp_path):
    folder = tmp_path / "in"
    sinks.write_fasta(sequences.where("length(sequence) > 0"), str(folder), files=3)
    stream = sketches.slot_stream(sketches.fasta_stream(spark, str(folder)), 5, 0, 12)
    query = stream.writeStream.format("memory").queryName("slots").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    got = sorted((r["slot"], r["n"]) for r in spark.table("slots").collect())
    assert got == sorted((r["slot"], r["n"]) for r in sketches.slot_stream(sequences, 5, 0, 12).collect())
    table = sketches.into_table(sketches.fasta_stream(spark, str(folder)), str(tmp_path / "table"), str(tmp_path / "state"))
    table.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "table")).count() == 60


def test_stored_buckets_are_joined_without_a_shuffle(spark, tmp_path):
    rows = [(i * 7919 % 211, i % 9, i) for i in range(2000)]
    table = spark.createDataFrame(rows, "hash long, seq_id long, pos long")
    for name, part in (("one", table), ("two", table.where("pos % 3 = 0"))):
        sinks.write_index(part, str(tmp_path / name), {"q": 12}, by="hash", buckets=5)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        one, two = (sinks.read_index(spark, str(tmp_path / name), {"q": 12}) for name in ("one", "two"))
        joined = one.join(two.select("hash", two["pos"].alias("other")), "hash")
        assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
        assert joined.count() == sum(a[0] == b[0] for a in rows for b in rows if b[2] % 3 == 0)
        assert sinks.read_index(spark, str(tmp_path / "one"), {"q": 12}).count() == 2000
        with pytest.raises(ValueError):
            sinks.read_index(spark, str(tmp_path / "one"), {"q": 13})
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
