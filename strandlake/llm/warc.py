"""Deterministic sharded WARC writer and reader.

Pages are range-sorted by id. Exact ranks of the ids (not sampled bounds) cut them into
ranges of `per_range` pages, and a range's records go as gzip members, one per record,
into files that are rolled once their compressed size passes a limit. So files and
their bytes depend on the rows alone, not on the number of tasks or their bounds: each
task writes some whole ranges. A file is written under a temporary name that holds the
task attempt, then moved to its name; a second attempt writes the same file. The
manifest (a Parquet table: name, records, bytes, digest) is committed last by Spark's
own protocol, and a reader takes only the files that it names.

Records of equal payloads of at least `revisit_from` bytes become one response, of
the smallest id, and revisits. Which ids are revisits is found on digests alone: a
payload that a large share of all pages hold is not one task's rows, and payloads are
shuffled once, by the range sort.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.operators.stats import ranked

from . import common

_MANIFEST = "file string, records long, bytes long, sha256 string, first_id long, last_id long"
_RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
_SPACE = uuid.UUID("5b1f0f0e-6f7c-5f0e-9d4e-2f4b0c9a7d11")


def _store(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One record, uncompressed. Its id follows from the page's id and digest."""
    kind = "response" if refers_to is None else "revisit"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    own = uuid.uuid5(_SPACE, f"{page_id} {digest}")
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{own}>", f"WARC-Date: {date}",
        f"WARC-Target-URI: {(url or 'urn:none').translate(str.maketrans({chr(13): '%0D', chr(10): '%0A'}))}",
        f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        *([f"X-Page-Id: {page_id}"] if page_id is not None else []), *(["X-No-Url: 1"] if url is None else []),
        *([f"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(_SPACE, f'{refers_to} {digest}')}>", f"X-Refers-To-Page-Id: {refers_to}"] if refers_to is not None else []),
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> Iterator[tuple]:
    """The records of one file, checked against their digests."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        fields = dict(line.split(": ", 1) for line in data[at:end].decode().split("\r\n")[1:])
        block = data[end + 4 : end + 4 + int(fields["Content-Length"])]
        at = end + 8 + len(block)
        if hashlib.sha256(block).hexdigest() != fields["WARC-Block-Digest"][7:]:
            raise ValueError(f"corrupt record {fields['WARC-Record-ID']}")
        head, _, payload = block.partition(b"\r\n\r\n")
        size = int(dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])["Content-Length"])
        page, refers = fields.get("X-Page-Id"), fields.get("X-Refers-To-Page-Id")
        full = fields["WARC-Type"] == "response"
        if full and hashlib.sha256(payload).hexdigest() != fields["WARC-Payload-Digest"][7:]:
            raise ValueError(f"corrupt payload of {fields['WARC-Record-ID']}")
        yield (page and int(page), None if "X-No-Url" in fields else fields["WARC-Target-URI"], size, fields["WARC-Payload-Digest"][7:], fields["WARC-Type"], refers and int(refers), payload if full else None)


def _range_starts(ids: DataFrame, per_range: int) -> DataFrame:
    """(page_id, number): the ids at which ranges of about `per_range` rows start, by exact
    ranks. Rows of one id are never parted."""
    ranks = ranked(ids.select("page_id"), "page_id")
    return ranks.where(F.col("rank") % per_range == 0).groupBy("page_id").agg(F.min(F.floor(F.col("rank") / per_range)).alias("number"))


def write_archives(pages: DataFrame, folder: str, roll_bytes: int = 32 << 20, revisit_from: int = 100, per_range: int = 4096, date: str = "2020-01-01T00:00:00Z") -> DataFrame:
    """Write `pages` (page_id, url, html) and return the manifest. Two writes of equal
    rows give equal files and manifests, whatever the number of tasks.

    Other columns are ignored, whatever their names. A null html is empty, a null url is
    marked as such; a page without an id is always a response, and such pages are dealt to
    ranges by digest and url; of repeated rows of one id and payload the first by url is
    the response and the rest revisit it. A very long html is one record, and its file is
    rolled after it. An empty table gives an empty manifest."""
    spark = pages.sparkSession
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    pages = pages.withColumn("digest", F.sha2(F.col("html").cast("binary"), 256))
    facts = common.written(pages.select("page_id", "digest", (F.octet_length("html") >= revisit_from).alias("large")), "pages")
    named, large = F.col("page_id").isNotNull(), F.col("large")
    sizes = facts.agg(F.count_if(~named).alias("none"), F.count_if(named & large).alias("large")).first()
    candidates = facts.where(named & large).select("page_id", "digest")
    groups = common.written(candidates.groupBy(F.col("digest").alias("of")).agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1"), "payloads")
    links = common.hot_split_join(candidates, groups, "digest", "of", "n", sizes["large"]).select("page_id", "digest", "refers_to").distinct()
    starts = common.written(_range_starts(facts.where(named), per_range), "ranges")
    # Tasks take runs of whole ranges: at most four bounds for each shuffle partition.
    most = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    every = max(1, -(-starts.count() // most))
    bounds = np.array([r["page_id"] for r in starts.where(F.col("number") % every == 0).orderBy("number").select("page_id").collect()], dtype=np.int64)
    none_ranges = max(1, -(-sizes["none"] // per_range))

    @F.pandas_udf("int")
    def part_of(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, ids.fillna(0).to_numpy(np.int64), side="right").astype(np.int32))

    text, number = F.lit(None).cast("string"), F.lit(None).cast("long")
    rows = pages.select("page_id", "url", "html", "digest", number.alias("refers_to"), F.lit(2).alias("kind"))
    rows = rows.unionByName(links.select("page_id", text.alias("url"), text.alias("html"), "digest", "refers_to", F.lit(1).alias("kind")))
    rows = rows.unionByName(starts.select("page_id", text.alias("url"), text.alias("html"), F.lit("").alias("digest"), F.col("number").alias("refers_to"), F.lit(0).alias("kind")))
    dealt = F.pmod(F.xxhash64("digest", "url"), F.lit(none_ranges)).cast("int")
    rows = rows.withColumn("part", F.when(named, part_of("page_id") + none_ranges).otherwise(dealt))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _store(folder)
        attempt = TaskContext.get().taskAttemptId()
        store.create_dir(base, recursive=True)
        open_file, name, shard, rolled, link, linked, origin, done = None, "", "", 0, None, None, False, []

        def close() -> None:
            nonlocal open_file
            if open_file is None:
                return
            out, seen, sha, first, last, n = open_file
            out.close()
            commit_file(store, f"{base}/.{name}.{attempt}", f"{base}/{name}")
            done.append((name, n, seen, sha.hexdigest(), first, last))
            open_file = None

        def begin(new: str) -> None:
            nonlocal shard, rolled
            close()
            shard, rolled = new, 0

        for batch in batches:
            for page_id, url, html, digest, refers, kind, part in zip(*(batch.column(i) for i in range(7))):
                page_id, kind, digest = page_id.as_py(), kind.as_py(), digest.as_py()
                if kind == 0:  # a range starts
                    begin(f"part-{refers.as_py():08d}")
                    continue
                if kind == 1:
                    link, linked = refers.as_py(), (page_id, digest)
                    origin = link == page_id  # the next row is the response that the others revisit
                    continue
                if page_id is None and shard != f"none-{part.as_py():08d}":
                    begin(f"none-{part.as_py():08d}")
                to = link if linked == (page_id, digest) and not origin else None
                origin, payload = False, html.as_py().encode()
                if open_file is None:
                    name = f"{shard}-{rolled:05d}.warc.gz"
                    open_file, rolled = [store.open_output_stream(f"{base}/.{name}.{attempt}", compression=None), 0, hashlib.sha256(), page_id, page_id, 0], rolled + 1
                member = gzip.compress(record(page_id, url.as_py(), payload, digest, to, date), 6, mtime=0)
                open_file[0].write(member)
                open_file[2].update(member)
                open_file[1], open_file[4], open_file[5] = open_file[1] + len(member), page_id, open_file[5] + 1
                if open_file[1] >= roll_bytes:
                    close()
        close()
        columns = list(zip(*done)) or [()] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()))], names=["file", "records", "bytes", "sha256", "first_id", "last_id"])

    # A part is some whole ranges, so the sampled bounds of this sort only share out work;
    # with four times as many partitions as parts, each part gets one of its own.
    spread = rows.repartitionByRange(4 * (len(bounds) + none_ranges), "part")
    manifest = spread.sortWithinPartitions("part", "page_id", F.col("kind") > 0, "digest", "kind", "url").mapInArrow(write, _MANIFEST)
    manifest.write.parquet(f"{folder}/manifest")
    remove_leftovers(folder)
    return spark.read.schema(_MANIFEST).parquet(f"{folder}/manifest")


def commit_file(store, temporary: str, final: str) -> None:
    """Give a whole file its final name. All attempts of a file have the same bytes, so one
    that is there stays, at every moment, and the temporary one goes: a manifest may name
    it already."""
    there = lambda: store.get_file_info(final).type.name != "NotFound"
    if not there():
        try:
            store.move(temporary, final)
            return
        except OSError:
            if not there():  # else another attempt came first
                raise
    store.delete_file(temporary)


def remove_leftovers(folder: str) -> int:
    """Remove temporary files of attempts that were killed, once the manifest is there."""
    from pyarrow import fs

    store, base = _store(folder)
    left = [f.path for f in store.get_file_info(fs.FileSelector(base)) if f.type == fs.FileType.File and f.base_name.startswith(".") and ".warc.gz." in f.base_name]
    for path in left:
        store.delete_file(path)
    return len(left)


def members(data: bytes, step: int = 8192) -> Iterator[bytes]:
    """The decompressed gzip members of a file, a few kilobytes fed at a time."""
    view, at = memoryview(data), 0
    while at < len(data):
        member, parts = zlib.decompressobj(31), []
        while not member.eof:
            piece = view[at : at + step]
            if not piece:
                raise ValueError("an archive ends within a record")
            parts.append(member.decompress(piece))
            at += len(piece)
        at -= len(member.unused_data)
        yield b"".join(parts)


def read_archives(spark: SparkSession, folder: str, with_payload: bool = True) -> DataFrame:
    """The records of the files that the manifest names, a task per few files. Digests
    are checked in any case; payloads are returned if asked for, else null."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _store(folder)
        types = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
        names = "page_id url payload_bytes payload_digest record_type refers_to payload".split()

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

        for batch in batches:
            for name in batch.column(0).to_pylist():
                with store.open_input_stream(f"{base}/{name}", compression=None) as f:
                    data, rows, size = f.read(), [], 0
                for member in members(data):
                    for row in parse(member):
                        rows.append(row if with_payload else (*row[:6], None))
                        size += len(rows[-1][6] or b"") + 200
                    if size > 8 << 20:
                        yield batch_of(rows)
                        rows, size = [], 0
                if rows:
                    yield batch_of(rows)

    manifest = spark.read.schema(_MANIFEST).parquet(f"{folder}/manifest").select("file")
    return manifest.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "file").mapInArrow(read, _RECORDS)


def op10_warc_writer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as archives in the shared folder and read back."""
    folder = common.new_path(spark, "warc")
    write_archives(common.table(spark, sf_dir, "pages"), folder)
    return read_archives(spark, folder, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP10_SQL = """
WITH d AS (SELECT page_id, url, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, url, octet_length(encode(html)) AS payload_bytes, sha256(html) AS payload_digest FROM d),
m AS (SELECT *, page_id IS NOT NULL AND payload_bytes >= 100 AS able,
             min(CASE WHEN payload_bytes >= 100 THEN page_id END) OVER (PARTITION BY payload_digest) AS least,
             row_number() OVER (PARTITION BY payload_digest, page_id ORDER BY url NULLS FIRST) AS n FROM h),
r AS (SELECT *, able AND (page_id <> least OR n > 1) AS again FROM m)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN again THEN least END AS refers_to
FROM r
"""
