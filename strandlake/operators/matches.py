"""Seed matches, their maximal extension, and intervals."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlake.functions import alphabet as A
from strandlake.functions import codes as C
from strandlake.operators.stats import ranked
from strandlake.sources.tables import written


def seed_matches(reference: DataFrame, query: DataFrame, block: int = 4096) -> DataFrame:
    """(ref_id, query_id, ref_pos, query_pos, hash) of equal hashes, from two tables
    (hash, seq_id, pos).

    Rows of the query whose hash the reference lacks are left out where they are made, by a
    filter of its hashes, and what is left is written once: a small reference sends only so
    much of a large query through the shuffles as matches it.

    Hashes with very many pairs are joined in blocks: both sides are cut into blocks of
    about `block` rows, each row goes to all blocks of the other side, and each pair of
    blocks is a key of its own. Such a hash has more than `most` rows on one side, so there
    are fewer than 20,000 of them at any size, and the table of them is broadcast."""
    r = reference.select("hash", F.col("seq_id").alias("ref_id"), F.col("pos").alias("ref_pos"))
    q = query.select("hash", F.col("seq_id").alias("query_id"), F.col("pos").alias("query_pos"))
    known = written(r.groupBy("hash").agg(F.count("*").alias("a")), "known")
    q = within(q, known)
    count = written(known.join(q.groupBy("hash").agg(F.count("*").alias("b")), "hash"), "seeds")
    total = count.agg(F.sum(F.col("a") + F.col("b")).alias("n")).first()["n"] or 0
    most = max(block, total // 10_000)
    hot = count.where(F.col("a") * F.col("b") > most * most).select(F.col("hash").alias("_hash"), F.ceil(F.col("a") / block).cast("int").alias("_a"), F.ceil(F.col("b") / block).cast("int").alias("_b"))
    if not hot.limit(1).count():
        return r.join(q, "hash")
    few = F.broadcast(hot)
    here = F.col("hash") == F.col("_hash")
    dealt = lambda n, *of: F.pmod(F.xxhash64(*of), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = r.join(few, here).select("hash", "ref_id", "ref_pos", dealt("_a", "ref_id", "ref_pos").alias("_i"), every("_b").alias("_j"))
    right = q.join(few, here).select("hash", "query_id", "query_pos", every("_a").alias("_i"), dealt("_b", "query_id", "query_pos").alias("_j"))
    cold = r.join(few, here, "left_anti").join(q.join(few, here, "left_anti"), "hash")
    return cold.unionByName(left.join(right, ["hash", "_i", "_j"]).drop("_i", "_j"))


def within(rows: DataFrame, known: DataFrame, bits: int = 26) -> DataFrame:
    """Rows whose `hash` is in known, and a few others: a filter of 2**bits bits by one
    hash function, broadcast in words of 64, so at most 2**20 of them for any table. If
    over a quarter of all values would pass it, rows stay as they are; else what passes is
    written."""
    at = lambda: F.xxhash64("hash").bitwiseAND(F.lit((1 << bits) - 1))
    bit = lambda a: F.call_function("shiftleft", F.lit(1).cast("long"), a.bitwiseAND(F.lit(63)).cast("int"))
    if known.count() > 1 << bits - 2:
        return rows
    words = known.select(at().alias("_at")).groupBy(F.shiftrightunsigned("_at", 6).alias("_word")).agg(F.bit_or(bit(F.col("_at"))).alias("_bits"))
    found = rows.join(F.broadcast(words), F.shiftrightunsigned(at(), 6) == F.col("_word")).where(F.col("_bits").bitwiseAND(bit(at())) != 0)
    return written(found.select(rows.columns), "within")


def maximal_matches(qgrams: DataFrame, other: DataFrame, q: int, least: int, column: str = "value") -> DataFrame:
    """(ref_id, query_id, ref_end, query_end, length): maximal exact matches of `least`
    or more characters, from all q-grams (seq_id, pos, value) of either side by exact
    codes. Matches of a diagonal are runs of seeds at consecutive positions, so they
    come out as islands of a running number: no character is compared again."""
    s = seed_matches(qgrams.select(F.col(column).alias("hash"), "seq_id", "pos"), other.select(F.col(column).alias("hash"), "seq_id", "pos"))
    s = s.withColumn("diagonal", F.col("ref_pos") - F.col("query_pos"))
    along = Window.partitionBy("ref_id", "query_id", "diagonal").orderBy("ref_pos")
    s = s.withColumn("run", F.col("ref_pos") - F.row_number().over(along))
    runs = s.groupBy("ref_id", "query_id", "diagonal", "run").agg(F.max("ref_pos").alias("r"), F.max("query_pos").alias("p"), F.count("*").alias("n"))
    runs = runs.select("ref_id", "query_id", (F.col("r") + q - 1).alias("ref_end"), (F.col("p") + q - 1).alias("query_end"), (F.col("n") + q - 1).alias("length"))
    return runs.where(F.col("length") >= least)


def extended_matches(seeds: DataFrame, reference: DataFrame, query: DataFrame, q: int, least: int) -> DataFrame:
    """As maximal_matches, but from a sample of seeds (such as minimizers): each seed is
    verified and extended to both sides over valid characters, then duplicates go.
    Sequences meet a pair's seeds once, grouped by pair in an Arrow stream."""
    pairs = seeds.groupBy("ref_id", "query_id").agg(F.collect_list(F.struct("ref_pos", "query_pos")).alias("seeds"))
    rows = pairs.join(reference.select(F.col("seq_id").alias("ref_id"), F.col("sequence").alias("a")), "ref_id").join(query.select(F.col("seq_id").alias("query_id"), F.col("sequence").alias("b")), "query_id")

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for ref, other, a, b, places in zip(*(batch.column(i).to_pylist() for i in range(5))):
                x, y = C.ranks(a), C.ranks(b)
                for p in places:
                    i, j = p["ref_pos"], p["query_pos"]
                    if not (x[i : i + q] == y[j : j + q]).all() or (x[i : i + q] > 3).any():
                        continue
                    n = min(i, j)
                    u, v = x[i - n : i][::-1], y[j - n : j][::-1]
                    stop = np.flatnonzero((u != v) | (u > 3))
                    left = int(stop[0]) if len(stop) else n
                    m = min(len(x) - i, len(y) - j)
                    u, v = x[i : i + m], y[j : j + m]
                    stop = np.flatnonzero((u != v) | (u > 3))
                    right = int(stop[0]) if len(stop) else m
                    if left + right >= least:
                        found.append((ref, other, i + right - 1, j + right - 1, left + right))
            columns = list(zip(*sorted(set(found)))) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["ref_id", "query_id", "ref_end", "query_end", "length"])

    return rows.select("ref_id", "query_id", "a", "b", "seeds").mapInArrow(extend, "ref_id long, query_id long, ref_end long, query_end long, length long").distinct()


def colinear_gaps(first_end, first_query_end, second_start, second_query_start):
    """(ref gap, query gap) as expressions, or nulls if the second match doesn't begin
    after the first on both sides."""
    ok = (second_start > first_end) & (second_query_start > first_query_end)
    return F.when(ok, second_start - first_end - 1), F.when(ok, second_query_start - first_query_end - 1)


def _sweep(start: np.ndarray, end: np.ndarray, weight: np.ndarray, least: float, low: float, high: float) -> tuple[np.ndarray, bool]:
    """Which intervals have the largest weight at some point of [low, high) that they
    cover, if one of weight `least` covers all of it; and whether that one does."""
    keep = np.zeros(len(start), dtype=bool)
    order = np.argsort(start, kind="stable")
    points = np.unique(np.concatenate([start, end, [low]]))
    points = points[(points >= low) & (points < high)]
    heap: list[tuple] = []
    at, covers = 0, False
    for p in points.tolist():
        while at < len(order) and start[order[at]] <= p:
            i = int(order[at])
            if end[i] > start[i]:
                heapq.heappush(heap, (-weight[i], -end[i], i))
            at += 1
        while heap and end[heap[0][2]] <= p:
            heapq.heappop(heap)
        top = -heap[0][0] if heap else -np.inf
        covers |= least >= top and least > -np.inf
        if heap and top >= least:
            back = []
            while heap and -heap[0][0] == top:
                item = heapq.heappop(heap)
                if end[item[2]] > p:
                    keep[item[2]] = True
                    back.append(item)
            # Of those that tie only the one that ends last is needed from here on,
            # but others may win later points alone never: they end before it.
            for item in back[:1]:
                heapq.heappush(heap, item)
    return keep, covers


def maximum_intervals(intervals: DataFrame, slab: int = 1 << 18) -> DataFrame:
    """Intervals (group, id, start, len, weight) that have the largest weight of their
    group at some point that they cover; at equal weights all that tie stay. Other columns
    go along.

    A sweep over a group's ends, with a heap of open intervals: linear memory, no row for
    each point of each interval. A group of more than `slab` intervals is cut at starts
    into slabs of so many, which are swept apart. An interval is in the slabs where it
    begins and ends; of those that cover a slab from end to end, the sweep needs to know the
    largest weight alone, which is found for all slabs by ranges of a binary tree."""
    rows = written(intervals.where("len > 0").withColumn("_id", F.monotonically_increasing_id()), "intervals")
    huge = rows.groupBy(F.col("group").alias("_of")).agg(F.count("*").alias("n")).where(F.col("n") > slab)  # fewer than intervals / slab
    narrow = rows.select("group", "_id", F.col("start").cast("double").alias("low"), (F.col("start") + F.col("len")).cast("double").alias("high"), F.col("weight").cast("double").alias("weight"))
    of = F.col("group") == F.col("_of")
    if not huge.limit(1).count():
        pieces = narrow.select("group", F.lit(0).cast("long").alias("slab"), "_id", "low", "high", "weight", F.lit(-np.inf).alias("least"), F.lit(-np.inf).alias("from"), F.lit(np.inf).alias("to"))
        kept = _swept(pieces).where("_id >= 0").select(F.col("_id").alias("_kept"))
        return rows.join(kept, F.col("_id") == F.col("_kept"), "left_semi").select(intervals.columns)
    few = F.broadcast(huge.select("_of"))
    # Slabs of huge groups: their first starts, which are few.
    big = narrow.join(few, of, "left_semi")
    ranks = ranked(big.select("group", "low", "_id"), "group", "low", "_id")
    first = ranks.groupBy(F.col("group").alias("_of")).agg(F.min("rank").alias("_first"))
    cuts = ranks.join(F.broadcast(first), of).where((F.col("rank") - F.col("_first")) % slab == 0).select("group", "low").distinct()
    ordered = Window.partitionBy("group").orderBy("low")
    cuts = cuts.select("group", "low", F.row_number().over(ordered).alias("slab"), F.lead("low").over(ordered).alias("next"))
    bounds = written(cuts.select(F.col("group").alias("_of"), "slab", F.when(F.col("slab") == 1, -np.inf).otherwise(F.col("low")).alias("from"), F.coalesce("next", F.lit(np.inf)).alias("to")), "slabs")
    lists = F.broadcast(bounds.groupBy("_of").agg(F.array_sort(F.collect_list("from")).alias("_cuts")))  # a number for each slab

    @F.pandas_udf("array<long>")
    def places(cuts_: pd.Series, low: pd.Series, high: pd.Series) -> pd.Series:
        return pd.Series([[int(np.searchsorted(c, x, side="right")), int(np.searchsorted(c, y, side="left"))] for c, x, y in zip(cuts_, low, high)])

    placed = written(big.join(lists, of).withColumn("_at", places("_cuts", "low", "high")).select("group", "_id", "low", "high", "weight", F.col("_at")[0].alias("a"), F.col("_at")[1].alias("b")), "placed")
    depth = int(bounds.agg(F.max("slab").alias("n")).first()["n"]).bit_length()
    # Slabs a + 1 to b - 1 are covered whole: ranges [k 2^d, (k + 1) 2^d) of slabs that fill them.
    nodes = F.expr(f"""filter(flatten(transform(sequence(0, {depth}), d -> array(
        struct(d as d, shiftrightunsigned(a + shiftleft(1L, d), d) as k), struct(d as d, shiftrightunsigned(b, d) - 1 as k)))),
        x -> shiftleft(x.k, x.d) > a AND shiftleft(x.k + 1, x.d) <= b
             AND NOT (shiftleft(shiftrightunsigned(x.k, 1), x.d + 1) > a AND shiftleft(shiftrightunsigned(x.k, 1) + 1, x.d + 1) <= b))""")
    cover = placed.where("b - a > 1").select("group", "weight", F.explode(nodes).alias("x")).groupBy("group", "x").agg(F.max("weight").alias("w"))
    up = bounds.select("_of", "slab", F.explode(F.expr(f"transform(sequence(0, {depth}), d -> struct(d as d, shiftrightunsigned(slab, d) as k))")).alias("y"))
    least = up.join(cover, of & (F.col("x.d") == F.col("y.d")) & (F.col("x.k") == F.col("y.k"))).groupBy(F.col("_of").alias("_g"), F.col("slab").alias("_s")).agg(F.max("w").alias("w"))
    facts = F.broadcast(written(bounds.join(least, (F.col("_of") == F.col("_g")) & (F.col("slab") == F.col("_s")), "left").select("_of", F.col("slab").cast("long").alias("_slab"), "from", "to", F.coalesce("w", F.lit(-np.inf)).alias("least")), "slabs"))
    ends = placed.select("group", "_id", "low", "high", "weight", F.explode(F.array_distinct(F.array("a", "b"))).alias("slab"))
    pieces = ends.join(facts, of & (F.col("slab") == F.col("_slab"))).select("group", "slab", "_id", "low", "high", "weight", "least", "from", "to")
    swept = written(_swept(pieces), "swept")
    won = swept.where("_id < 0").select(F.col("group").alias("_of"), F.col("slab").alias("_slab"), F.col("weight").alias("_w"))
    small = narrow.join(few, of, "left_anti").select("group", F.lit(0).cast("long").alias("slab"), "_id", "low", "high", "weight", F.lit(-np.inf).alias("least"), F.lit(-np.inf).alias("from"), F.lit(np.inf).alias("to"))
    covering = placed.where("b - a > 1").join(won, of & (F.col("weight") == F.col("_w")) & (F.col("_slab") > F.col("a")) & (F.col("_slab") < F.col("b"))).select("_id")
    kept = swept.where("_id >= 0").select("_id").unionByName(covering).unionByName(_swept(small).where("_id >= 0").select("_id")).distinct().select(F.col("_id").alias("_kept"))
    return rows.join(kept, F.col("_id") == F.col("_kept"), "left_semi").select(intervals.columns)


def _swept(pieces: DataFrame) -> DataFrame:
    """(group, slab, _id, weight) of intervals that win in their slab, and with _id -1 of
    slabs where the one that covers it whole does. A task holds one slab at a time."""
    from strandlake.operators.chaining import by_group

    def work(key: tuple, c: list[np.ndarray]) -> list[tuple]:
        ids, low, high, weight, least, start, stop = c
        keep, covers = _sweep(low, high, weight, float(least[0]), float(start[0]) if np.isfinite(start[0]) else float(low.min()), float(stop[0]))
        out = [(*key, int(i), float(w)) for i, w in zip(ids[keep], weight[keep])]
        return [*out, (*key, -1, float(least[0]))] if covers else out

    columns = ["_id", "low", "high", "weight", "least", "from", "to"]
    return by_group(pieces, ["group", "slab"], ["low", "_id"], columns, "group long, slab long, _id long, weight double", ["group", "slab", "_id", "weight"], [pa.int64(), pa.int64(), pa.int64(), pa.float64()], work)


def overlaps(left: DataFrame, right: DataFrame, on: str, block: int = 4096) -> DataFrame:
    """(group, left_id, right_id, overlap) of intervals (group, id, start, len) that
    share a position. Both sides go to the blocks that they touch, so the join is an
    equi-join; a pair counts in the block of its first common position only."""
    side = lambda d, name: d.select(F.col(on).alias("group"), F.col("id").alias(f"{name}_id"), F.col("start").alias(f"{name}_start"), (F.col("start") + F.col("len")).alias(f"{name}_end"), F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("len") - 1) / block))).alias("block")).where(F.col(f"{name}_end") > F.col(f"{name}_start"))
    both = side(left.where("len > 0"), "left").join(side(right.where("len > 0"), "right"), ["group", "block"])
    first, last = F.greatest("left_start", "right_start"), F.least("left_end", "right_end")
    return both.where((last > first) & (F.floor(first / block) == F.col("block"))).select("group", "left_id", "right_id", (last - first).alias("overlap"))


def first_per(rows: DataFrame, key: str, *order) -> DataFrame:
    """The first row of each key in an order."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_r = 1").drop("_r")


def restricted(pairs: DataFrame, allowed: DataFrame) -> DataFrame:
    """Pairs (a, b) that are in `allowed`, in either order. An empty table restricts
    nothing; that is asked of the table once."""
    if not allowed.limit(1).count():
        return pairs
    both = allowed.select("a", "b").unionByName(allowed.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    return pairs.join(both, ["a", "b"], "left_semi")


def numbered(headers: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b) as ids, from pairs of headers or of numbers; an unknown header is an error."""
    known = headers.select(A.short_header(F.col("header")).alias("h"), "seq_id")
    out = pairs
    for side in ("a", "b"):
        named = known.select(F.col("h").alias(f"h_{side}"), F.col("seq_id").alias(f"id_{side}"))
        out = out.join(named, F.col(side) == F.col(f"h_{side}"), "left")
    pick = lambda side: F.when(A.all_digits(F.col(side)), F.col(side).cast("long")).otherwise(F.coalesce(F.col(f"id_{side}"), F.raise_error(F.concat(F.lit("unknown sequence "), F.col(side))).cast("long")))
    return out.select(pick("a").alias("a"), pick("b").alias("b"))
