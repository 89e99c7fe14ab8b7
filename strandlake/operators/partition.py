"""Splitting sequences into parts, and pairs of sequences into tiles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlake.operators.stats import counted_in_order, ranked
from strandlake.sources.tables import written


#: Rows in order that one step of greedy splitting looks at together.
BLOCK = 1 << 16


def _running(rows: DataFrame) -> DataFrame:
    """(seq_id, length, idx, before) of rows (seq_id, length): their place in order of
    seq_id and the lengths before it; written. A range-partitioned sort, sums along each
    partition, and the partitions' totals, which are few."""
    names = ["seq_id", "length", "_part", "_idx", "_before"]

    def along(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, rows_, total = TaskContext.get().partitionId(), 0, 0
        for b in batches:
            n = b.column(1).to_numpy()
            sums = np.cumsum(n)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(n), part)), pa.array(np.arange(len(n)) + rows_), pa.array(sums - n + total)], names=names)
            rows_, total = rows_ + len(n), total + int(n.sum())

    s = written(rows.repartitionByRange("seq_id").sortWithinPartitions("seq_id").mapInArrow(along, ", ".join(f"{n} long" for n in names)), "lengths")
    before = Window.orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)
    ends = s.groupBy(F.col("_part").alias("_of")).agg(F.count("*").alias("_n"), F.sum("length").alias("_s"))
    starts = ends.select("_of", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in ("_n", "_s")])
    at = s.join(F.broadcast(starts), F.col("_part") == F.col("_of"))
    return written(at.select("seq_id", "length", (F.col("_idx") + F.col("_n")).alias("idx"), (F.col("_before") + F.col("_s")).alias("before")), "sums")


def _hops(before: np.ndarray, limit: int) -> np.ndarray:
    """For each row of a block, where the next part begins if one begins here; the number
    of rows if that is behind the block."""
    return np.searchsorted(before, before + limit, side="left")


def _entries(rows: DataFrame, limit: int) -> DataFrame:
    """(idx, goal, parts): for each row of a block of rows at which a part may begin that
    is the block's first: the sum at or behind which the first part of a later block
    begins, and the parts that begin in this block. Those rows stand within the first
    `limit` of a block, as a part before began before the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for idx, before in _blocks(batches):
            n = len(idx)
            hop = _hops(before, limit)
            last, parts = np.arange(n), np.ones(n, dtype=np.int64)
            for i in range(n - 1, -1, -1):
                if hop[i] < n:
                    last[i], parts[i] = last[hop[i]], parts[hop[i]] + 1
            may = np.r_[True, before[:-1] < before[0] + limit]
            yield pa.RecordBatch.from_arrays([pa.array(idx[may]), pa.array(before[last[may]] + limit), pa.array(parts[may])], names=["idx", "goal", "parts"])

    return _by_block(rows).mapInArrow(run, "idx long, goal long, parts long")


def _by_block(rows: DataFrame) -> DataFrame:
    block = F.floor(F.col("idx") / BLOCK)
    return rows.select(block.alias("block"), "idx", "before").repartition(block).sortWithinPartitions("block", "idx", "before")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(idx, before) of one block after another."""
    rest: pa.Table | None = None
    for b in batches:
        t = pa.Table.from_batches([b])
        rest = t if rest is None else pa.concat_tables([rest, t])
        while rest.num_rows:
            blocks = rest["block"].to_numpy()
            cut = int(np.searchsorted(blocks, blocks[0], side="right"))
            if cut == len(blocks):
                break  # it may go on
            yield rest["idx"].slice(0, cut).to_numpy(), rest["before"].slice(0, cut).to_numpy()
            rest = rest.slice(cut)
    if rest is not None and rest.num_rows:
        yield rest["idx"].to_numpy(), rest["before"].to_numpy()


def greedy_parts(sequences: DataFrame, limit: int) -> DataFrame:
    """(seq_id, length, part): in order of seq_id, a part takes sequences while its length
    so far is below limit.

    A part's end depends on where it began, but where the next part begins follows from
    running sums, for any row at which a part might begin. So each block of rows tells, for
    the few rows at which its first part may begin, where the chain of parts leaves it;
    these pointers from block to block are doubled, and the chain from row 0 is read off
    them in as many joins. Blocks that it enters then list the parts that begin in them."""
    if limit < 1:
        raise ValueError("a part has at least one character")
    narrow = sequences.select(F.col("seq_id").cast("long").alias("seq_id"), F.length("sequence").cast("long").alias("length"))
    rows = _running(narrow)
    entries = written(_entries(rows, limit), "entries")
    # The row at or behind a sum: the number of rows whose sum is less.
    both = rows.select(F.lit(None).cast("long").alias("idx"), F.lit(None).cast("long").alias("parts"), F.col("before").alias("key"), F.lit(True).alias("row"))
    both = both.unionByName(entries.select("idx", "parts", F.col("goal").alias("key"), F.lit(False).alias("row")))
    goals = counted_in_order(both, ["idx", "parts"], "row", "key", "row", "idx").where(~F.col("row")).select("idx", F.col("_n1").alias("to"), "parts")
    jump = written(goals.join(entries.select(F.col("idx").alias("_to")), F.col("to") == F.col("_to")).select("idx", "to", "parts"), "jumps")
    jumps = []
    while jump.where("idx = 0").limit(1).count():
        jumps.append(jump)
        further = jump.select(F.col("idx").alias("_at"), F.col("to").alias("_to"), F.col("parts").alias("_parts"))
        jump = written(jump.join(further, F.col("to") == F.col("_at")).select("idx", F.col("_to").alias("to"), (F.col("parts") + F.col("_parts")).alias("parts")), "jumps")
    reached = entries.where("idx = 0").select("idx")
    for jump in reversed(jumps):
        reached = written(reached.unionByName(reached.join(jump, "idx").select(F.col("to").alias("idx"))), "reached")

    def starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for idx, before in _blocks(batches):
            mark, found = np.flatnonzero(before < 0), []
            if len(mark):
                at, own = idx[mark[0]], np.delete(idx, mark)
                hop = _hops(np.delete(before, mark), limit)
                i = int(at - own[0])
                while i < len(own):
                    found.append(int(own[i]))
                    i = int(hop[i])
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64())], names=["idx"])

    marked = rows.select("idx", "before").unionByName(reached.select("idx", F.lit(-1).cast("long").alias("before")))
    begun = _by_block(marked).mapInArrow(starts, "idx long")
    both = rows.select("seq_id", "length", "idx", F.lit(False).alias("start")).unionByName(begun.select(F.lit(None).cast("long").alias("seq_id"), F.lit(None).cast("long").alias("length"), "idx", F.lit(True).alias("start")))
    # A part's number is the number of parts that have begun, less one.
    parts = counted_in_order(both, ["seq_id", "length"], "start", "idx", F.desc("start")).where(~F.col("start"))
    return parts.select("seq_id", "length", (F.col("_n1") - 1).alias("part"))


def in_parts(sequences: DataFrame, parts: int, round_up: bool = True) -> DataFrame:
    """greedy_parts at a limit of all lengths / parts, rounded up or down."""
    total = sequences.agg(F.coalesce(F.sum(F.length("sequence")), F.lit(0)).alias("n")).first()["n"]
    limit = -(-total // parts) if round_up else total // parts
    return greedy_parts(sequences, max(1, limit))


def by_number(sequences: DataFrame, n: int) -> DataFrame:
    """seq_id is a dense number: parts of n sequences."""
    return sequences.withColumn("part", F.floor(F.col("seq_id") / n))


def part_width(parts: int) -> int:
    """Digits of a part's number in file names."""
    return max(1, len(str(max(0, parts - 1))))


def size_variance(part_rows: DataFrame) -> DataFrame:
    """Sum (not mean) of squared deviations of the parts' lengths."""
    by = part_rows.groupBy("part").agg(F.sum("length").alias("n"))
    return by.agg(F.round(F.coalesce(F.var_pop("n") * F.count("*"), F.lit(0.0)), 6).alias("variance"))


def _cut(cutlen: int, m: int, n: int) -> list[tuple[int, int, int, int]]:
    """Halve the longer side (rows at a tie, the first half the larger) until both
    sides are at most cutlen."""
    todo, done = [(0, m, 0, n)], []
    while todo:
        i, rows, j, columns = todo.pop()
        if rows <= cutlen and columns <= cutlen:
            done.append((i, rows, j, columns))
        elif rows < columns:
            half = -(-columns // 2)
            todo += [(i, rows, j, half), (i, rows, j + half, columns - half)]
        else:
            half = -(-rows // 2)
            todo += [(i, half, j, columns), (i + half, rows - half, j, columns)]
    return done


def tiles(spark, m: int, n: int | None = None, cutlen: int | None = None) -> DataFrame:
    """(i, rows, j, columns): tiles of the matrix of pairs of m and n sequences; of the
    upper triangle of m by m if n is None, where columns 0 is a diagonal tile. The
    default cutlen is a tenth of the larger side. The plan's size depends on the
    numbers alone."""
    cutlen = cutlen or max(1, max(m, n or m) // 10)
    if n is not None:
        rows = _cut(cutlen, m, n)
    else:
        own = [(i, min(cutlen, m - i), 0, 0) for i in range(0, m, cutlen)]
        rows = own + [(a[0], a[1], b[0], b[1]) for x, a in enumerate(own) for b in own[x + 1 :]]
    rows.sort(key=lambda t: (t[0] + t[2], t[0], t[2]))
    return spark.createDataFrame([(k, *t) for k, t in enumerate(rows)], "tile int, i int, rows int, j int, columns int")


def triangle_pairs(rows: DataFrame, id_column: str, block: int = 64) -> DataFrame:
    """(a, b) for all pairs a < b of a table, as a join of blocks of ids in order and
    then of rows within: an equi-join on tiles, where each row goes to as many tiles as there
    are blocks, instead of a nested loop over two whole tables."""
    ids = ranked(rows.select(F.col(id_column).alias("id")).where("id is not null").distinct(), "id")
    blocks = -(-ids.count() // block)
    own = ids.select("id", F.floor(F.col("rank") / block).cast("int").alias("own"))
    left = own.select(F.col("id").alias("a"), F.col("own").alias("i"), F.explode(F.sequence(F.col("own"), F.lit(max(0, blocks - 1)))).alias("j"))
    right = own.select(F.col("id").alias("b"), F.explode(F.sequence(F.lit(0), F.col("own"))).alias("i"), F.col("own").alias("j"))
    return left.join(right, ["i", "j"]).where("a < b").select("a", "b")
