"""Removal of long repeated byte strings by merging Burrows-Wheeler order.

Every window of `length` bytes has an anchor: the leftmost least of the hashes of
its 32-byte grams. Equal windows have equal anchors at equal offsets, so a window
can only repeat among the occurrences of its anchor. That deals suffixes into
buckets by content, in place of a range partition of a global order:

1. Each text gives its anchors with a fingerprint of the context that windows at the
   anchor can cover. Anchors met once are done. Occurrences with equal context are
   repeats whole, and one of them stands for all in what follows, so thousands of
   copies are one context.
2. For anchors with two or more different contexts the context bytes are fetched. A
   task holds contexts of whole buckets, aligned at the anchors, as shards of rows.
   A shard's suffixes are put in order for each column by one pass from the right:
   the order at a column is that of the next column, stably partitioned by the byte
   in front (the Burrows-Wheeler column). Shards are merged the same way: the
   interleave of shards at a column is refined from that of the next one by the
   merged Burrows-Wheeler bytes, without comparing or sorting a suffix again, and
   common prefixes of neighbours follow from the range minima of those before. As
   rows are aligned, one refinement a column suffices. Neighbours with `length`
   bytes or more in common are repeated intervals.
   An anchor with very many different contexts is divided before they are fetched into
   tasks: its windows by where they start, in quarters, and its contexts by the bytes that
   all windows of a quarter cover. Equal windows stay together, so this loses none; in the
   end a part is small or holds windows that are equal whole.
3. Repeated intervals of a text are merged and cut out.

Shuffled are anchors (about one in 85 bytes), and contexts at the ends of repeats.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import common

GRAM = 32
_RNG = np.random.default_rng(20240229)
_TABLE = _RNG.integers(0, 2**64, 256, dtype=np.uint64)
_BASE, _BASE2 = np.uint64(0x9E3779B97F4A7C15 | 1), np.uint64(0xD1342543DE82EF95 | 1)


def _inverse(x: np.uint64) -> np.uint64:
    return np.uint64(pow(int(x), -1, 2**64))


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n or more; kept between calls."""
    up, down = _powers.get(int(base), (np.ones(1, np.uint64), np.ones(1, np.uint64)))
    if len(up) < n:
        size = max(n, 1 << 16)
        up, down = (np.concatenate([[np.uint64(1)], np.full(size - 1, b, np.uint64)]).cumprod(dtype=np.uint64) for b in (base, _inverse(base)))
        if size <= 1 << 22:
            _powers[int(base)] = up, down
    return up, down


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def anchors(data: bytes, length: int, piece: int = 1 << 20) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, place, context fingerprint) of each anchor of a text. A text is gone
    through in overlapping pieces of about `piece` bytes, each with sums of its own, so
    that arrays are as long as a piece: hashes don't depend on where sums begin."""
    n, w = len(data), length - GRAM + 1
    if n < length:
        return (np.zeros(0, np.int64),) * 3
    places, hashes, prints = [], [], []
    for a in range(0, n - length + 1, piece):
        # Anchors of this piece begin in [a, end); their contexts reach `length` further.
        end = min(n - GRAM + 1, a + piece + w - 1)
        first, last = max(0, a - length), min(n, end + length)
        values = _TABLE[np.frombuffer(data, np.uint8, last - first, first)]
        sums = []
        for base in (_BASE, _BASE2):
            up, down = _power_tables(base, len(values) + 1)
            s = np.zeros(len(values) + 1, dtype=np.uint64)
            np.cumsum(values * up[: len(values)], out=s[1:])
            sums.append((s, down))
        (s, down), (s2, down2) = sums
        here = slice(a - first, end - first)
        h = _mix((s[GRAM:][here] - s[here]) * down[here])
        key = (h & ~np.uint64(0x1FFFFF)) | np.arange(len(h), dtype=np.uint64)  # leftmost among the least
        m = len(key)
        full = -(-m // w) * w
        padded = np.full(full, np.iinfo(np.uint64).max)
        padded[:m] = key
        rows = padded.reshape(-1, w)
        left = np.minimum.accumulate(rows, axis=1).ravel()
        right = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        least = np.minimum(right[: m - w + 1], left[w - 1 : m])
        own = np.unique(least & np.uint64(0x1FFFFF)).astype(np.int64)
        at = own + a
        low, high = np.maximum(0, at - (length - GRAM)), np.minimum(n, at + length)
        print_ = _mix((s2[high - first] - s2[low - first]) * down2[low - first] + np.uint64(31) * (at - low).astype(np.uint64) + np.uint64(1 << 20) * (high - at).astype(np.uint64))
        places.append(at), hashes.append(h[own].view(np.int64)), prints.append(print_.view(np.int64))
    at, pick = np.unique(np.concatenate(places), return_index=True)
    return np.concatenate(hashes)[pick], at, np.concatenate(prints)[pick]


def _keyed(docs: DataFrame, *carried) -> DataFrame:
    """Rows are told apart by a hash of id and text: equal rows have equal results."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *carried)
    return own.select(F.xxhash64("doc_id", "text").alias("rid"), "*")


def _anchor_rows(docs: DataFrame, length: int) -> DataFrame:
    """Anchor rows (h, fp, rid, at, state). Where a batch of texts has a context twice
    or more, its occurrences are known repeats (state 2, which go anywhere), and one row
    stands for them (state 1) beside those met once (state 0): an anchor that is in a
    large share of all texts is a row a batch, not a row an occurrence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h, rid, at, fp = [], [], [], []
            for key, text in zip(b.column(0).to_pylist(), b.column(1)):
                a, p, f = anchors(text.as_buffer().to_pybytes(), length)
                h.append(a), at.append(p), fp.append(f), rid.append(np.full(len(a), key))
            empty = np.zeros(0, np.int64)
            columns = [np.concatenate([*c, empty]).astype(np.int64) for c in (h, fp, rid, at)]
            order = np.lexsort((columns[1], columns[0]))
            columns = [c[order] for c in columns]
            n = len(order)
            new = np.ones(n, dtype=bool)
            new[1:] = (columns[0][1:] != columns[0][:-1]) | (columns[1][1:] != columns[1][:-1])
            many = np.bincount(np.cumsum(new) - 1)[np.cumsum(new) - 1] > 1 if n else new
            pick = np.concatenate([np.arange(n), np.flatnonzero(new & many)])
            state = np.concatenate([np.where(many, 2, 0), np.ones((new & many).sum(), np.int64)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*(pa.array(c[pick]) for c in columns), pa.array(state)], names=["h", "fp", "rid", "at", "state"])

    return docs.where(F.octet_length("text") >= length).select("rid", "text").mapInArrow(run, "h long, fp long, rid long, at long, state int")


def _sifted(rows: DataFrame) -> DataFrame:
    """From anchor rows, those of state 2 last and the rest sorted by (h, fp): kind 0
    for occurrences with an equal context elsewhere, 1 for others to be compared, 2 for
    one that stands for its equals. contexts: how many its anchor has to compare."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = [np.zeros(0, np.int64)] * 5

        def made(rid, at, h, kind, contexts) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(rid), pa.array(at), pa.array(h), pa.array(kind.astype(np.int32)), pa.array(contexts.astype(np.int64))], names=["rid", "at", "h", "kind", "contexts"])

        def full(c: list[np.ndarray]) -> pa.RecordBatch:
            h, fp, rid, at, state = c
            n = len(h)
            new_h, new_c = np.ones(n, dtype=bool), np.ones(n, dtype=bool)
            new_h[1:] = h[1:] != h[:-1]
            new_c[1:] = new_h[1:] | (fp[1:] != fp[:-1])
            bucket, context = np.cumsum(new_h) - 1, np.cumsum(new_c) - 1
            equals = np.bincount(context, weights=1 + (state == 1))[context] if n else np.zeros(0)
            contexts = np.bincount(bucket, weights=new_c)[bucket] if n else np.zeros(0)
            whole, compare = (equals > 1) & (state == 0), (contexts > 1) & new_c
            pick = np.concatenate([np.flatnonzero(whole), np.flatnonzero(compare)])
            return made(rid[pick], at[pick], h[pick], np.concatenate([np.zeros(whole.sum()), np.where(equals[compare] > 1, 2, 1)]), contexts[pick])

        for b in batches:
            new = [b.column(i).to_numpy() for i in range(5)]
            done = new[4] == 2
            if done.any():
                yield made(new[2][done], new[3][done], new[0][done], np.zeros(done.sum()), np.zeros(done.sum()))
            c = [np.concatenate([r, x[~done]]) for r, x in zip(rest, new)]
            if not len(c[0]):
                continue
            cut = int(np.searchsorted(c[0], c[0][-1]))
            yield full([x[:cut] for x in c])
            rest = [x[cut:] for x in c]
        yield full(rest)

    return rows.mapInArrow(run, "rid long, at long, h long, kind int, contexts long")


def shard_columns(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(orders, bwt) of one shard of rows: orders[c] are the rows in the order of their
    suffixes from column c on; bwt[c] the symbols at c in the order at c + 1."""
    rows, width = symbols.shape
    orders, bwt = np.empty((width + 1, rows), dtype=np.int32), np.empty((width, rows), dtype=np.uint16)
    orders[width] = np.arange(rows)
    for c in range(width - 1, -1, -1):
        bwt[c] = symbols[orders[c + 1], c]
        orders[c] = orders[c + 1][np.argsort(bwt[c], kind="stable")]
    return orders, bwt


def repeated_columns(symbols: np.ndarray, length: int, shard_rows: int = 512) -> np.ndarray:
    """symbols: rows aligned in columns, 0 outside of the text. True where `length`
    symbols from a column on, all in the text, also are another row's from there on."""
    rows, width = symbols.shape
    starts = [*range(0, rows, shard_rows)]
    shards = [shard_columns(symbols[a : a + shard_rows]) for a in starts]
    inside = np.cumsum(np.concatenate([np.zeros((rows, 1), np.int32), symbols == 0], axis=1, dtype=np.int32), axis=1)
    out = np.zeros((rows, width - length + 1), dtype=bool)
    interleave = np.repeat(np.arange(len(shards), dtype=np.int32), [len(o[0]) for o, _ in shards])
    common = np.zeros(rows + 1, dtype=np.int32)  # with the suffix before; one more place ends the last range
    for c in range(width - 1, -1, -1):
        merged = np.empty(rows, dtype=np.uint16)
        for s, (_, bwt) in enumerate(shards):
            merged[interleave == s] = bwt[c]
        order = np.argsort(merged, kind="stable")
        least = np.minimum.reduceat(common, order + 1)[:-1]
        front = merged[order]
        common = np.zeros(rows + 1, dtype=np.int32)
        common[1:rows] = np.where((front[1:] == front[:-1]) & (front[1:] > 0), least + 1, 0)
        interleave = interleave[order]
        if c <= width - length:
            row = np.empty(rows, dtype=np.int64)
            for s, (orders, _) in enumerate(shards):
                row[interleave == s] = orders[c] + starts[s]
            twice = (common[:rows] >= length) | (common[1:] >= length)
            out[row, c] = twice & (inside[row, c + length] == inside[row, c])
    return out


def _intervals(contexts: DataFrame, length: int, rows_at_once: int) -> DataFrame:
    """From (h, first, last, rid, at, kind, low, context) with the rows of an h together:
    repeated intervals (rid, a, b) of rows of kind 1, of windows that start in columns
    first to last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = length - GRAM
        width = left + length
        held: list[tuple] = []

        def solve(rows: list[tuple]) -> pa.RecordBatch:
            # A column more, in front of the anchor and so in every window, holds the number
            # of the row's part: a row that is in two parts doesn't meet itself.
            data = np.zeros((len(rows), width + 1), np.uint16)
            part, key = 0, None
            for i, (h, _, _, _, at, _, low, text) in enumerate(rows):
                part, key = part + (h != key), h
                first = left - (at - low)
                symbols = np.frombuffer(text, np.uint8).astype(np.uint16) + 1
                data[i, first:left], data[i, left] = symbols[: left - first], part
                data[i, left + 1 : first + len(text) + 1] = symbols[left - first :]
            hit = repeated_columns(data, length + 1)
            columns = np.arange(left + 1)
            hit &= (columns >= np.array([r[1] for r in rows])[:, None]) & (columns <= np.array([r[2] for r in rows])[:, None])
            edge = np.diff(np.concatenate([np.zeros((len(rows), 1), np.int8), hit.astype(np.int8), np.zeros((len(rows), 1), np.int8)], axis=1), axis=1)
            out = []
            (i, a), (_, b) = np.nonzero(edge == 1), np.nonzero(edge == -1)
            for row, x, y in zip(i.tolist(), a.tolist(), b.tolist()):
                _, _, _, rid, at, kind, _, _ = rows[row]
                if kind == 1:
                    out.append((rid, at - left + x, at - left + y - 1 + length))
            found = list(zip(*out)) or [(), (), ()]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in found], names=["rid", "a", "b"])

        for b in batches:
            for row in zip(*(b.column(i).to_pylist() for i in range(8))):
                if len(held) >= rows_at_once and row[0] != held[-1][0]:
                    yield solve(held)
                    held = []
                held.append(row)
        if held:
            yield solve(held)

    return contexts.mapInArrow(run, "rid long, a long, b long")


def _divided(contexts: DataFrame, length: int, most: int) -> tuple[DataFrame, DataFrame]:
    """Parts of anchors with more than `most` contexts, from rows (h, first, last, rid, at,
    kind, low, context): such rows in parts of at most `most`, and intervals (rid, a, b) of
    windows that are equal whole. A part's windows start in columns first to last, so all
    cover the bytes from `last` to `first + length`: rows that differ there have no window
    in common and are parted by a hash of them. A part still too large is divided again; of
    a single column all windows of a part are equal. A round quarters the columns."""
    left = length - GRAM
    parts, whole, rows = [], [], contexts
    while True:
        quarters = F.expr("filter(transform(sequence(0, 3), q -> struct(first + cast((last - first + 1) * q div 4 as int) AS f, first + cast((last - first + 1) * (q + 1) div 4 as int) - 1 AS l)), x -> x.f <= x.l)")
        rows = rows.select("h", "rid", "at", "kind", "low", "context", F.explode(quarters).alias("x")).select("h", F.col("x.f").alias("first"), F.col("x.l").alias("last"), "rid", "at", "kind", "low", "context")
        start = (F.col("last") - left + F.col("at") - F.col("low")).cast("int")  # of the covered bytes in the context
        size = F.lit(length) - (F.col("last") - F.col("first"))
        rows = rows.where((start >= 0) & (start + size <= F.octet_length("context"))).withColumn("h", F.xxhash64("h", "first", "last", F.substring("context", start + 1, size)))
        rows = common.written(rows, "parts")
        counts = common.written(rows.groupBy(F.col("h").alias("of")).agg(F.count("*").alias("n")).where("n > 1"), "counts")
        sized = common.hot_split_join(rows, counts, "h", "of", "n", rows.count()).drop("of")
        parts.append(sized.where(F.col("n") <= most).drop("n"))
        whole.append(sized.where((F.col("n") > most) & (F.col("first") == F.col("last")) & (F.col("kind") == 1)).select("rid", (F.col("at") - left + F.col("first")).alias("a"), (F.col("at") - left + F.col("first") + length).alias("b")))
        if not counts.where(F.col("n") > most).limit(1).count():
            break
        rows = sized.where((F.col("n") > most) & (F.col("first") < F.col("last"))).drop("n")
    return reduce(DataFrame.unionByName, parts), reduce(DataFrame.unionByName, whole)


def repeat_dedup(docs: DataFrame, length: int = 200, rows_at_once: int = 4000, most_contexts: int = 20_000, with_kept: bool = True, carry: tuple[str, ...] = ()) -> DataFrame:
    """(rid, doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans, kept) for each row
    of docs (doc_id, text): every byte covered by a string of `length` bytes that also
    starts anywhere else goes. spans are the removed runs, kept the bytes left (null
    unless asked for). `carry` names columns of docs that come along, as a struct `row`.
    A task compares about `rows_at_once` contexts at a time, and those of one anchor
    together up to `most_contexts`; anchors with more are divided.

    Null texts are empty. Repeated rows are documents each, so their long strings
    repeat. Texts shorter than `length` keep all; a very long text is gone through in
    pieces, and its spans are cut out by one task. Columns that aren't carried are
    ignored, whatever their names. An empty table gives no rows."""
    spark = docs.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = _keyed(docs)
    key = F.when(F.col("state") == 2, F.xxhash64("rid", "at")).otherwise(F.col("h"))
    found = _anchor_rows(keyed, length).repartition(tasks, key).sortWithinPartitions(F.col("state") == 2, "h", "fp", "rid", "at")
    sifted = common.written(_sifted(found), "anchors")
    back = length - GRAM
    wanted = sifted.where("kind > 0").groupBy(F.col("rid").alias("of")).agg(F.collect_set(F.struct("h", "at", "kind", "contexts")).alias("places"))
    texts = keyed.select("rid", "text").join(wanted, F.col("rid") == F.col("of")).select("rid", "places", F.col("text").cast("binary").alias("text")).dropDuplicates(["rid"])
    low = F.greatest(F.lit(0), F.col("p.at") - back)
    cut = texts.select("rid", "text", F.explode("places").alias("p")).select(
        F.col("p.h").alias("h"), F.lit(0).alias("first"), F.lit(back).alias("last"), "rid", F.col("p.at").alias("at"), F.col("p.kind").alias("kind"), low.alias("low"),
        F.substring(F.col("text"), (low + 1).cast("int"), (F.col("p.at") - low + length).cast("int")).alias("context"), F.col("p.contexts").alias("contexts"),
    )
    whole = sifted.where("kind = 0").select("rid", F.greatest(F.lit(0), F.col("at") - back).alias("a"), (F.col("at") + length).alias("b"))
    if sifted.where(F.col("contexts") > most_contexts).limit(1).count():
        cut = common.written(cut, "contexts")
        parts, equal = _divided(cut.where(F.col("contexts") > most_contexts).drop("contexts"), length, most_contexts)
        cut = cut.where(F.col("contexts") <= most_contexts).drop("contexts").unionByName(parts)
        whole = whole.unionByName(equal)
    else:
        cut = cut.drop("contexts")
    compared = _intervals(cut.repartition(tasks, "h").sortWithinPartitions("h", "rid", "at"), length, rows_at_once)
    runs = compared.unionByName(whole).groupBy(F.col("rid").alias("of")).agg(F.collect_set(F.struct("a", "b")).alias("runs"))
    whole_rows = _keyed(docs, F.struct(*[F.col(f"`{c}`") for c in carry] or [F.lit(0).alias("none")]).alias("row"))
    joined = whole_rows.join(runs, F.col("rid") == F.col("of"), "left").select("rid", "doc_id", "text", "runs", "row")

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for rid, doc_id, text, found in zip(*(b.column(i) for i in range(4))):
                data = text.as_buffer().to_pybytes()
                spans: list[list[int]] = []
                for x in sorted((r["a"], min(r["b"], len(data))) for r in found.as_py() or ()):
                    if x[1] - x[0] < length:
                        continue  # the context of an anchor by the text's end, too short for a window
                    if spans and x[0] <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], x[1])
                    else:
                        spans.append(list(x))
                at, kept = 0, []
                for a, z in spans:
                    kept.append(data[at:a])
                    at = z
                rest = b"".join([*kept, data[at:]])
                rows.append((rid.as_py(), doc_id.as_py(), len(data), len(data) - len(rest), len(spans), hashlib.sha256(rest).hexdigest(), [{"a": a, "b": z} for a, z in spans], rest if with_kept else None))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])), pa.binary())
            columns = list(zip(*rows)) or [()] * 8
            yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(columns, types)), b.column(4)], names="rid doc_id n_bytes n_removed n_spans kept_sha256 spans kept row".split())

    schema = "rid long, doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<a:long,b:long>>, kept binary"
    out = joined.mapInArrow(cut_out, StructType.fromDDL(schema).add("row", whole_rows.schema["row"].dataType))
    return out if carry else out.drop("row")


def op5_bwt_repeats(spark, sf_dir: str) -> DataFrame:
    return repeat_dedup(common.table(spark, sf_dir, "documents"), with_kept=False).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
