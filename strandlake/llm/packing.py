"""Packing by minimum bin slack.

Documents become token ids (one closing id each), cut at multiples of the
capacity. The remaining pieces are packed window by window: the longest piece
left opens a sequence, and a subset-sum table over the lengths left (a bitset
held in one integer, counts split in powers of two) finds the multiset that
fills the sequence closest to capacity; walking the table back gives the count
of each length. What doesn't go into a window's sequences moves to the next.

Only (doc_id, start, length, checksum) rows are shuffled, never ids or texts.
Rows go to packing tasks by a hash of id and start, so a hot document or source
spreads evenly, and each task holds one window of piece records at a time.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
_PACKED = _PIECES + ", sequence_id long, offset long"
_encoders: dict = {}
_BLANK_RUN = 10_000
_BLANKS = re.compile(rf"\s{{{_BLANK_RUN}}}")


def encoder(path: str, added: str | None = None):
    """A function from a text to its ids, without special tokens put around it. A
    .tiktoken file of ranks gives the same ids as the .json file of the same vocabulary,
    about four times as fast; `added` is that .json file, whose added tokens are
    recognised wherever they stand in a text, as its own library does. Texts with a very
    long run of blanks go to that library, as the other one's pattern recurses on each."""
    if (path, added) not in _encoders:
        if path.endswith(".tiktoken"):
            import base64
            import json

            import public_tokenizers
            import tiktoken

            with open(path, "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
            special = {}
            if added:
                with open(added, encoding="utf-8") as f:
                    special = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
            made = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
            slow = encoder(added) if added else None

            def encode(text: str) -> list[int]:
                if slow and len(text) >= _BLANK_RUN and _BLANKS.search(text):
                    return slow(text)
                return made.encode(text, allowed_special="all") if any(t in text for t in special) else made.encode_ordinary(text)

            _encoders[path, added] = encode
        else:
            from tokenizers import Tokenizer

            whole = Tokenizer.from_file(path)
            _encoders[path, added] = lambda text: whole.encode(text, add_special_tokens=False).ids
    return _encoders[path, added]


def pieces(docs: DataFrame, path: str, capacity: int = 2048, closing_id: int = 1, added: str | None = None) -> DataFrame:
    """A row per piece: each document's ids and the closing id, cut every
    `capacity` ids. A null text is empty: one piece with the closing id. `path` and
    `added` are encoder()'s. A text is encoded whole, one at a time."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, added)
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.array([*encode(text.as_py() or ""), closing_id], dtype="<u4")
                for start in range(0, len(ids), capacity):
                    part = ids[start : start + capacity]
                    rows.append((doc_id, start, len(part), zlib.crc32(part.tobytes()), len(ids)))
            columns = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(cut, _PIECES)


def fullest(counts: dict[int, int], lengths: list[int], room: int, base: int) -> dict[int, int]:
    """How many pieces of each length fill `room` best, beside `base` ids that are
    there. lengths: those with a count, longest first. Best is an exact fill, then
    a total at a power of two (it needs no padding), then the largest total."""
    mask, sums, steps = (1 << (room + 1)) - 1, 1, []
    for length in lengths:
        if length > room:
            continue
        left, times = min(counts[length], room // length), 1
        while left > 0 and not sums >> room & 1:
            times = min(times, left)
            steps.append((length, times, sums))
            sums |= (sums << length * times) & mask
            left, times = left - times, times * 2
        if sums >> room & 1:
            break
    goal = sums.bit_length() - 1
    if goal < room:
        powers = [p - base for p in (1 << i for i in range((base + room).bit_length())) if p >= base and sums >> (p - base) & 1]
        goal = max(powers, default=goal)
    taken: dict[int, int] = defaultdict(int)
    for length, times, before in reversed(steps):
        if not before >> goal & 1:
            taken[length] += times
            goal -= length * times
    return taken


def pack_window(waiting: dict[int, list], capacity: int, keep: int) -> Iterator[list]:
    """Take sequences (lists of pieces) from the waiting pieces, by length, until
    at most `keep` pieces are left."""
    counts = {length: len(rows) for length, rows in waiting.items() if rows}
    total = sum(counts.values())
    lengths = sorted(counts, reverse=True)
    while total > keep:
        first = lengths[0]
        counts[first] -= 1
        chosen = fullest(counts, [x for x in lengths if counts[x]], capacity - first, first)
        sequence = [waiting[first].pop()]
        for length, times in chosen.items():
            counts[length] -= times
            sequence += [waiting[length].pop() for _ in range(times)]
        total -= len(sequence)
        lengths = [x for x in lengths if counts[x]]
        yield sequence


def pack(piece_rows: DataFrame, capacity: int = 2048, window: int = 4096, per_task: int = 8192) -> DataFrame:
    """Give each piece a sequence and an offset. Runs agree: rows go to tasks by a
    hash of (doc_id, start, checksum) and are packed in that order."""
    spark = piece_rows.sparkSession
    count = piece_rows.count()
    tasks = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), count // per_task))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 40
        waiting: dict[int, list] = defaultdict(list)
        held = 0

        def out(sequences: Iterator[list]) -> Iterator[pa.RecordBatch]:
            nonlocal number, held
            rows = []
            for sequence in sequences:
                at = 0
                for row in sequence:
                    rows.append((*row, number, at))
                    at += row[2]
                number += 1
                held -= len(sequence)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=[*"doc_id start length ids_crc32 doc_tokens sequence_id offset".split()])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                waiting[row[2]].append(row)
                held += 1
                if held >= window:
                    yield from out(pack_window(waiting, capacity, window // 4))
        yield from out(pack_window(waiting, capacity, 0))

    key = [F.xxhash64("doc_id", "start", "ids_crc32"), F.col("doc_id"), F.col("start"), F.col("ids_crc32")]
    return piece_rows.repartition(tasks, key[0]).sortWithinPartitions(*key).mapInArrow(run, _PACKED)


def pack_documents(docs: DataFrame, path: str, capacity: int = 2048, added: str | None = None) -> DataFrame:
    """Pack documents (doc_id, text) into sequences of at most `capacity` ids.

    Columns other than these two are ignored, whatever their names. Empty tables give no
    rows; null and empty texts give a piece with the closing id; a very long text gives a
    piece for each `capacity` ids, which are dealt out like any others; repeated rows are
    packed each; a null id stays null."""
    return pack(common.written(pieces(docs, path, capacity, added=added), "pieces"), capacity)


def op9_min_bin_slack_packing(spark, sf_dir: str) -> DataFrame:
    """Packing of all documents with the 50k byte-level BPE vocabulary."""
    import public_tokenizers

    return pack_documents(common.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), added=public_tokenizers.path("byte_bpe_50k.json"))
