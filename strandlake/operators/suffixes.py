"""Suffix and common-prefix tables of texts, and an index of them.

Suffixes are put in order by suffix_sort. They end where their text ends; a suffix that is
another's prefix comes first, and equal suffixes go by (seq_id, pos)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlake.operators import suffix_sort
from strandlake.operators.stats import counted_in_order
from strandlake.sources.tables import fresh_path, written

def suffix_array(texts: DataFrame) -> DataFrame:
    """(rank, seq_id, pos)."""
    return suffix_sort.in_order(texts).select("rank", "seq_id", "pos")


def shared_length(a: str, b: str) -> int:
    """Characters that two strings have in common at their start."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def _shared(rows: DataFrame, keep: list[str], name: str, a: str, b: str) -> DataFrame:
    """keep, and the shared length of two columns of strings; a null one is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (batch.column(len(keep) + i).to_pylist() for i in range(2))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array([shared_length(p or "", q or "") for p, q in zip(x, y)], pa.int64())], names=[*keep, name])

    types = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in keep)
    return rows.select(*keep, a, b).mapInArrow(run, f"{types}, {name} long")


def windows_at(rows: DataFrame, texts: DataFrame, seq_id: str, at: str, width: int, name: str) -> DataFrame:
    """rows with the next `width` characters of a text from a position, fewer at its end
    and none behind it: texts are cut into chunks of twice the width, one of which holds
    the window whole, and only chunks that are asked for meet in the join."""
    cut = texts.select(F.col("seq_id").alias("_id"), "sequence", F.explode(F.sequence(F.lit(0), F.floor(F.length("sequence") / width))).alias("_chunk"))
    cut = cut.select("_id", "_chunk", F.substr("sequence", (F.col("_chunk") * width + 1).cast("int"), F.lit(2 * width)).alias("_piece"))
    on = (F.col(seq_id) == F.col("_id")) & (F.floor(F.col(at) / width) == F.col("_chunk"))
    piece = F.substr("_piece", (F.col(at) % width + 1).cast("int"), F.lit(width))
    return rows.join(cut, on, "left").withColumn(name, F.coalesce(piece, F.lit(""))).drop("_id", "_chunk", "_piece")


def common_prefixes(texts: DataFrame, width: int = 256) -> DataFrame:
    """(rank, seq_id, pos, lcp): lcp with the suffix of the rank before; 0 at rank 0.

    Most are seen in the heads of both suffixes. Where heads are equal and whole, positions
    are taken in the order of the texts: if the suffix before that of pos is one further
    than the one before that of pos - 1, its lcp is one less. So only the first position of
    such a run is compared with the text, window by window, each four times as wide: lcps
    of first positions add up to little, however long repeats are."""
    order = suffix_sort.in_order(texts)
    before = order.select((F.col("rank") + 1).alias("_rank"), F.col("seq_id").alias("s2"), F.col("pos").alias("p2"), F.col("head").alias("head2"))
    pairs = order.join(before, F.col("rank") == F.col("_rank"), "left")
    pairs = written(_shared(pairs, ["rank", "seq_id", "pos", "s2", "p2"], "lcp", "head", "head2"), "prefixes")
    done = pairs.where(F.col("lcp") < suffix_sort.HEAD)
    # Runs along a diagonal, cut at blocks of positions so that no window is unbounded.
    diagonal = ["seq_id", "s2", F.col("pos") - F.col("p2"), F.floor(F.col("pos") / (1 << 16))]
    runs = pairs.where(F.col("lcp") >= suffix_sort.HEAD).withColumn("_run", F.col("pos") - F.row_number().over(Window.partitionBy(*diagonal).orderBy("pos")))
    run = ["seq_id", "s2", (F.col("pos") - F.col("p2")).alias("d"), F.floor(F.col("pos") / (1 << 16)).alias("block"), "_run"]
    runs = written(runs.select("rank", "pos", "p2", *run), "runs")
    keys = ["seq_id", "s2", "d", "block", "_run"]
    open_ = runs.groupBy(*keys).agg(F.min("pos").alias("first")).withColumn("l", F.lit(suffix_sort.HEAD).cast("long"))
    kept, found = [*keys, "first", "l"], None
    while True:
        open_ = written(open_, "open")
        if not open_.limit(1).count():
            break
        both = open_.withColumn("_x", F.col("first") + F.col("l")).withColumn("_y", F.col("first") - F.col("d") + F.col("l"))
        both = windows_at(windows_at(both, texts, "seq_id", "_x", width, "_a"), texts, "s2", "_y", width, "_b")
        seen = written(_shared(both, kept, "n", "_a", "_b"), "shared")
        ends = seen.where(F.col("n") < width).select(*keys, "first", (F.col("l") + F.col("n")).alias("l"))
        found = ends if found is None else found.unionByName(ends)
        open_, width = seen.where(F.col("n") == width).select(*keys, "first", (F.col("l") + F.col("n")).alias("l")), 4 * width
    long_ = runs.select("rank", "seq_id", "pos", F.lit(None).cast("long").alias("lcp"))
    if found is not None:
        of = found.select(*[F.col(c).alias(f"_{c}") for c in keys], "first", "l")
        same = [F.col(c) == F.col(f"_{c}") for c in keys]
        long_ = runs.join(of, same).select("rank", "seq_id", "pos", (F.col("l") - (F.col("pos") - F.col("first"))).alias("lcp"))
    return done.select("rank", "seq_id", "pos", "lcp").unionByName(long_).withColumn("lcp", F.col("lcp").cast("int"))


def is_ordered(table: DataFrame, texts: DataFrame) -> bool:
    """Whether (rank, seq_id, pos) has each suffix once, in order."""
    s = table.join(texts.select("seq_id", "sequence"), "seq_id").select("rank", "seq_id", "pos", F.expr("substring(sequence, pos + 1)").alias("suffix"))
    before = s.select((F.col("rank") + 1).alias("rank"), F.col("suffix").alias("was"))
    wrong = s.join(before, "rank").where("was > suffix").limit(1).count()
    want = texts.agg(F.sum(F.length("sequence")).alias("n")).first()["n"] or 0
    return wrong == 0 and table.select("seq_id", "pos").distinct().count() == want == table.count()


def positions_to_sequences(positions: DataFrame, offsets: DataFrame) -> DataFrame:
    """positions (pos) in the joined text to (pos, seq_id, relpos), by one sort of
    positions and offsets together and a running maximum in blocks: an as-of join that
    has no range condition. Positions of separators have no sequence."""
    top = offsets.select("offset", "seq_id", "length", F.lit(None).cast("long").alias("pos"), F.col("offset").alias("at"), F.lit(0).alias("kind"))
    ask = positions.select(F.lit(None).cast("long").alias("offset"), F.lit(None).cast("long").alias("seq_id"), F.lit(None).cast("long").alias("length"), F.col("pos").cast("long").alias("pos"), F.col("pos").cast("long").alias("at"), F.lit(1).alias("kind"))
    both = top.select(ask.columns).unionByName(ask).withColumn("_block", F.floor(F.col("at") / (1 << 20)))
    here = F.struct("offset", "seq_id", "length")
    last = F.max(F.when(F.col("kind") == 0, here)).over(Window.partitionBy("_block").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0))
    heads = top.withColumn("_block", F.floor(F.col("at") / (1 << 20))).groupBy("_block").agg(F.max(here).alias("_h"))
    blocks = both.select("_block").distinct().join(heads, "_block", "left").withColumn("_carry", F.max("_h").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))).select("_block", "_carry")
    found = both.withColumn("_own", last).where("kind = 1").join(blocks, "_block").withColumn("_x", F.coalesce("_own", "_carry"))
    inside = F.col("pos") - F.col("_x.offset") < F.col("_x.length")
    return found.where(inside).select("pos", F.col("_x.seq_id").alias("seq_id"), (F.col("pos") - F.col("_x.offset")).alias("relpos"))


def write_leaves(texts: DataFrame, path: str, size: int = 1024) -> None:
    """Store an index of texts: their suffixes in order, `size` of them a row, as (leaf,
    heads, seq_ids, positions), range-partitioned by leaf; and beside it the first head of
    each leaf. Searches route queries by first heads and read the leaves they need."""
    order = suffix_sort.in_order(texts).withColumn("leaf", F.floor(F.col("rank") / size))
    rows = F.array_sort(F.collect_list(F.struct("rank", "head", "seq_id", "pos")))
    leaves = order.groupBy("leaf").agg(rows.alias("_r")).select("leaf", F.col("_r.head").alias("heads"), F.col("_r.seq_id").alias("seq_ids"), F.col("_r.pos").alias("positions"))
    leaves.repartitionByRange("leaf").sortWithinPartitions("leaf").write.parquet(f"{path}/leaves")
    spark = texts.sparkSession
    spark.read.parquet(f"{path}/leaves").select("leaf", F.col("heads")[0].alias("head"), F.size("heads").alias("n")).write.parquet(f"{path}/fences")


def _placed(queries: DataFrame, leaves: DataFrame, fences: DataFrame, after: bool, size: int) -> DataFrame:
    """queries (q, head) with `place`, the number of suffixes whose head is less (or, with
    `after`, less or begins with it), and `near`, the longest prefix that head shares with
    the suffixes on either side. Fences and queries are sorted together, which gives each
    query its leaf; a leaf is then searched by bisection."""
    high = F.concat("head", F.lit("\U0010ffff" * 2)) if after else F.col("head")
    # A leaf whose first head is as large begins behind the place.
    rows = queries.select("q", high.alias("k"), F.lit(0).alias("kind"), F.lit(False).alias("fence"))
    rows = rows.unionByName(fences.select(F.lit(None).cast("long").alias("q"), F.col("head").alias("k"), F.lit(1).alias("kind"), F.lit(True).alias("fence")))
    leaf_of = counted_in_order(rows, ["q"], "fence", "k", "kind", "q").where(~F.col("fence")).select(F.col("q").alias("_q"), F.greatest(F.col("_n1") - 1, F.lit(0)).alias("_leaf"))
    routed = queries.join(leaf_of, F.col("q") == F.col("_q")).join(leaves.select("leaf", "heads"), F.col("_leaf") == F.col("leaf"), "left")
    following = fences.select((F.col("leaf") - 1).alias("_before"), F.col("head").alias("_next"))
    routed = routed.join(following, F.col("_leaf") == F.col("_before"), "left")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            place, near = [], []
            for i, (head, leaf, behind) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(4).to_pylist())):
                heads = b.column(3)[i]
                low, high_ = 0, len(heads) if heads.is_valid else 0
                while low < high_:
                    middle = (low + high_) // 2
                    own = heads[middle].as_py()
                    if own < head or (after and own.startswith(head)):
                        low = middle + 1
                    else:
                        high_ = middle
                sides = [heads[low - 1].as_py()] if low else []
                sides.append(heads[low].as_py() if heads.is_valid and low < len(heads) else behind or "")
                place.append(leaf * size + low)
                near.append(max(shared_length(head, s) for s in sides))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(place, pa.int64()), pa.array(near, pa.int64())], names=["q", "head", "place", "near"])

    return routed.select("q", "head", "_leaf", "heads", "_next").mapInArrow(search, "q long, head string, place long, near long")


def search_leaves(queries: DataFrame, texts: DataFrame, path: str, width: int = 256) -> DataFrame:
    """(query, length): the longest prefix of each query that occurs in a text of the index
    at `path`. Heads are placed among the suffixes; only queries that are longer than their
    head, and whose head occurs, are searched further: by bisection of the suffixes that
    begin with it, for all such queries at once, each step comparing one window of one
    suffix a query. No substring of a text is made but those windows."""
    spark = texts.sparkSession
    leaves, fences = spark.read.parquet(f"{path}/leaves"), spark.read.parquet(f"{path}/fences")
    size = fences.agg(F.max("n").alias("n")).first()["n"]
    q = written(queries.select("query").where("query is not null").distinct().withColumn("q", F.monotonically_increasing_id()), "queries")
    if size is None:
        return q.select("query", F.lit(0).alias("length"))
    own = q.select("q", F.substr("query", F.lit(1), F.lit(suffix_sort.HEAD)).alias("head"))
    low = written(_placed(own, leaves, fences, False, size), "placed")
    found = low.select("q", F.col("near").alias("best"))
    further = low.where(F.col("near") == suffix_sort.HEAD).select("q", "head", F.col("place").alias("low"))
    further = further.join(q.where(F.length("query") > suffix_sort.HEAD).select(F.col("q").alias("_q"), "query"), F.col("q") == F.col("_q")).drop("_q")
    if further.limit(1).count():
        high = _placed(further.select("q", "head"), leaves, fences, True, size).select(F.col("q").alias("_q"), F.col("place").alias("high"))
        state = further.join(high, F.col("q") == F.col("_q")).select("q", "query", "low", "high", *[F.lit(suffix_sort.HEAD).cast("long").alias(c) for c in ("at", "left", "right", "best")])
        # left and right: what the query shares with the suffixes beyond low and high, so
        # all between share the lesser of both, and comparing goes on from there.
        names, results = ["q", "query", "low", "high", "at", "left", "right", "best"], []

        def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows = []
                for number, query, lo, hi, at, left, right, best, text in zip(*(c.to_pylist() for c in b.columns)):
                    part = query[at : at + width]
                    n = shared_length(part, text)
                    best, middle = max(best, at + n), (lo + hi) // 2
                    if best == len(query):
                        lo = hi
                    elif n == width:  # as far as the window goes: the same suffix again
                        rows.append((number, query, lo, hi, at + n, left, right, best))
                        continue
                    elif text[n : n + 1] < part[n : n + 1]:
                        lo, left = middle + 1, at + n
                    else:
                        hi, right = middle, at + n
                    rows.append((number, query, lo, hi, min(left, right), left, right, best))
                columns = list(zip(*rows)) or [()] * 8
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if i == 1 else pa.int64()) for i, c in enumerate(columns)], names=names)

        while True:
            state = written(state, "search")
            results.append(state.where("low >= high").select("q", "best"))
            open_ = state.where("low < high").withColumn("_m", F.floor((F.col("low") + F.col("high")) / 2))
            if not open_.limit(1).count():
                break
            at = (F.col("_m") % size + 1).cast("int")
            asked = open_.join(leaves.select("leaf", "seq_ids", "positions"), F.floor(F.col("_m") / size) == F.col("leaf"))
            asked = asked.select(*names, F.element_at("seq_ids", at).alias("_s"), (F.element_at("positions", at) + F.col("at")).alias("_p"))
            state = windows_at(asked, texts, "_s", "_p", width, "_text").select(*names, "_text").mapInArrow(step, "q long, query string, low long, high long, at long, left long, right long, best long")
        for r in results:
            found = found.unionByName(r)
    best = found.groupBy(F.col("q").alias("_q")).agg(F.max("best").alias("best"))
    return q.join(best, F.col("q") == F.col("_q"), "left").select("query", F.coalesce("best", F.lit(0)).cast("int").alias("length"))


def longest_prefixes(queries: DataFrame, texts: DataFrame) -> DataFrame:
    """(query, length): the longest prefix of each query that occurs in a text, by an index
    that is made for these queries; see write_leaves() and search_leaves()."""
    path = fresh_path(texts.sparkSession, "index")
    write_leaves(texts, path)
    return search_leaves(queries, texts, path)


def prefix_intervals(table: DataFrame, block: int = 1 << 16) -> DataFrame:
    """(lcp, left, right): maximal rank intervals that share a prefix of lcp > 0
    characters, bottom up with a stack over (rank, lcp) in order.

    Blocks of ranks have stacks of their own and give the intervals that they hold
    whole. What is left of a block is each new least lcp since its start, which closes
    intervals from before, and what is open at its end: a few rows a block. Only those
    are read in order by one task, as a stream."""
    names = ["block", "at", "rank", "lcp", "left", "right"]

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        now, last, at, stack = None, 0, 0, []

        def left_open(rank: int, lcp: int, left: int | None) -> None:
            nonlocal at
            rows.append((now, at, rank, lcp, left, None))
            at += 1

        def finish() -> None:
            for lcp, left in stack[1:]:
                left_open(last, lcp, left)
            left_open(last, -1, None)

        for b in batches:
            for of, rank, lcp in zip(*(b.column(i).to_pylist() for i in range(3))):
                if of != now:
                    if now is not None:
                        finish()
                    now, at, stack = of, 0, []
                last = rank
                if not rank:
                    continue
                left = rank - 1
                while len(stack) > 1 and stack[-1][0] > lcp:
                    depth, left = stack.pop()
                    rows.append((now, None, None, depth, left, rank - 1))
                if not stack or stack[0][0] > lcp:
                    stack[:] = [(lcp, None)]  # a new least one: its left end may be in a block before
                    left_open(rank, lcp, None)
                elif stack[-1][0] < lcp:
                    stack.append((lcp, left))
            yield _long_batch(rows, names)
            rows.clear()
        if now is not None:
            finish()
        yield _long_batch(rows, names)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        stack, n = [(0, 0)], 0

        def close(lcp: int, rank: int) -> None:
            left = rank - 1
            while stack[-1][0] > lcp:
                depth, left = stack.pop()
                rows.append((depth, left, rank - 1))
            if stack[-1][0] < lcp:
                stack.append((lcp, left))

        for b in batches:
            for rank, lcp, left in zip(*(b.column(i).to_pylist() for i in range(3))):
                if left is not None:
                    stack.append((lcp, left))
                elif lcp >= 0:
                    close(lcp, rank)
                n = rank + 1
            yield _long_batch(rows, names[3:])
            rows.clear()
        close(0, n)
        yield _long_batch(rows, names[3:])

    ranks = table.select(F.floor(F.col("rank") / block).alias("block"), F.col("rank").cast("long").alias("rank"), F.col("lcp").cast("long").alias("lcp"))
    parts = written(ranks.repartition("block").sortWithinPartitions("block", "rank").mapInArrow(local, ", ".join(f"{n} long" for n in names)), "intervals")
    rest = parts.where("right is null").repartition(1).sortWithinPartitions("block", "at").select("rank", "lcp", "left")
    return parts.where("right is not null").select("lcp", "left", "right").unionByName(rest.mapInArrow(joined, "lcp long, left long, right long"))


def _long_batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)


def saturated(table: DataFrame, most: int = 255) -> tuple[DataFrame, DataFrame]:
    """From (rank, lcp) a byte for each rank, (rank, small), where `most` stands for that
    or more, and (rank, lcp) of the few larger ones. restored() undoes it."""
    small = table.select("rank", F.least("lcp", F.lit(most)).cast("smallint").alias("small"))
    return small, table.where(F.col("lcp") >= most).select("rank", "lcp")


def restored(small: DataFrame, large: DataFrame) -> DataFrame:
    """(rank, lcp) of saturated()."""
    over = large.select(F.col("rank").alias("_rank"), F.col("lcp").alias("_lcp"))
    return small.join(over, F.col("rank") == F.col("_rank"), "left").select("rank", F.coalesce("_lcp", F.col("small").cast("int")).cast("int").alias("lcp"))


def prefix_bits(table: DataFrame) -> DataFrame:
    """(seq_id, word, bits): the common prefixes in the order of the texts, as bits. With
    lcp[p] that of the suffix at p, lcp[p] + 2 p rises from p to p + 1, so a text of n
    characters is a bit vector with n ones at these places, 2 n and a few bits, kept in
    words of 64. The bit of p is its p-th one: see prefix_of_bits()."""
    at = F.col("lcp").cast("long") + 2 * F.col("pos").cast("long")
    one = F.call_function("shiftleft", F.lit(1).cast("long"), (at % 64).cast("int"))
    words = table.select("seq_id", F.floor(at / 64).alias("word"), one.alias("bit"))
    return words.groupBy("seq_id", "word").agg(F.bit_or("bit").alias("bits"))


def prefix_of_bits(words: DataFrame) -> DataFrame:
    """(seq_id, pos, lcp) from prefix_bits(): ranks of ones by running counts of words."""
    before = F.coalesce(F.sum(F.bit_count("bits")).over(Window.partitionBy("seq_id").orderBy("word").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ones = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.call_function("shiftrightunsigned", F.col("bits"), i).bitwiseAND(F.lit(1)) == 1)
    rows = words.withColumn("before", before).select("seq_id", "word", "before", F.posexplode(ones).alias("k", "i"))
    pos = F.col("before") + F.col("k")
    return rows.select("seq_id", pos.cast("int").alias("pos"), (F.col("word") * 64 + F.col("i") - 2 * pos).cast("int").alias("lcp"))


def skyline(table: DataFrame) -> DataFrame:
    """(rank, bar): a star for each shared character."""
    return table.select("rank", F.expr("repeat('*', lcp)").alias("bar"))
