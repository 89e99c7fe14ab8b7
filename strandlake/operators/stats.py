"""Statistics, distributions and orders of a table of sequences
(seq_id, header, sequence)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlake.functions import alphabet as A
from strandlake.sources.tables import written


def length() :
    return F.length("sequence")


def statistics(sequences: DataFrame) -> DataFrame:
    n = length()
    s = sequences.agg(F.count("*").alias("sequences_number"), F.min(n).alias("min_length"), F.max(n).alias("max_length"), F.sum(n).alias("total_length"))
    return s.select("*", A.bits_for(F.col("sequences_number")).alias("number_bits"), A.bits_for(F.col("max_length")).alias("length_bits"))


def mean_statistics(sequences: DataFrame) -> DataFrame:
    """Count, total, whole-number mean, least and largest length."""
    n = length()
    return sequences.agg(F.count("*").alias("sequences_number"), F.sum(n).alias("total_length"), F.expr("cast(sum(length(sequence)) div count(*) as bigint)").alias("mean_length"), F.min(n).alias("min_length"), F.max(n).alias("max_length"))


def length_ratios(sequences: DataFrame) -> DataFrame:
    """(length, n, percent) with four decimals."""
    by = sequences.groupBy(length().alias("length")).agg(F.count("*").alias("n"))
    return by.withColumn("percent", F.round(F.lit(100.0) * F.col("n") / F.sum("n").over(Window.partitionBy()), 4))


def length_distribution(sequences: DataFrame, bin_size: int = 1) -> DataFrame:
    """(bin, n): bin is length div bin_size."""
    return sequences.groupBy(F.expr(f"length(sequence) div {bin_size}").cast("long").alias("bin")).agg(F.count("*").alias("n"))


def _counted(sequences: DataFrame, letters: list[tuple[str, int]], name: str) -> DataFrame:
    """Sums of occurrences by lengths, without a row for each character."""
    n = lambda c: F.sum(F.length("sequence") - F.length(F.regexp_replace("sequence", c, "")))
    one = sequences.agg(*[n(c).alias(f"c{v}") for c, v in letters])
    return one.select(F.explode(F.array(*[F.struct(F.lit(v).alias(name), F.col(f"c{v}").alias("n")) for _, v in letters])).alias("x")).select(f"x.{name}", "x.n").where("n > 0")


def rank_distribution(sequences: DataFrame, alphabet: str = A.DNA) -> DataFrame:
    """(rank, n); characters without a rank are counted under the alphabet's size."""
    if alphabet == A.DNA:
        letters = [("[Aa]", 0), ("[Cc]", 1), ("[Gg]", 2), ("[TtUu]", 3), (A.invalid(A.DNA), 4)]
    else:
        letters = [(c, i) for i, c in enumerate(alphabet)] + [(A.invalid(alphabet), len(alphabet))]
    return _counted(sequences, letters, "rank")


def char_class_distribution(sequences: DataFrame) -> DataFrame:
    """(class, n) of A, C, T, G (in either case) as classes 0 to 3."""
    return _counted(sequences, [("[Aa]", 0), ("[Cc]", 1), ("[Tt]", 2), ("[Gg]", 3)], "class")


def in_length_range(sequences: DataFrame, least: int = 0, most: int = 0) -> DataFrame:
    """most 0: no upper limit."""
    kept = sequences.where(length() >= least)
    return kept.where(length() <= most) if most else kept


def ranked(sequences: DataFrame, *order) -> DataFrame:
    """sequences with their 0-based rank, by a range-partitioned sort and an offset for
    each partition: no task sees all rows. The sorted partitions are written once, each
    row with its partition and its place there, and counted on that table: a second
    plan of the sort would sample other bounds. Partitions are few, so offsets are
    broadcast."""
    place = F.monotonically_increasing_id()  # partition << 33 | place in the partition
    s = written(sequences.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place", place), "ranked")
    part = F.shiftright("_place", 33)
    ends = s.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    starts = ends.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return s.join(F.broadcast(starts), part == F.col("_part")).withColumn("rank", F.col("_before") + F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))).drop("_part", "_place", "_before")


def counted_in_order(rows: DataFrame, keep: list[str], flag: str, *keys) -> DataFrame:
    """`keep` columns of rows (numbers) and the flag, with the numbers of rows before it in
    the order of the keys, without and with the flag: _n0 and _n1. A range-partitioned
    sort, counts along each sorted partition, and the partitions' totals, which are few."""
    names = [*keep, flag, "_part", "_n0", "_n1"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seen = TaskContext.get().partitionId(), np.zeros(2, dtype=np.int64)
        for b in batches:
            one = b.column(len(keep)).to_numpy(zero_copy_only=False).astype(bool)
            with_, without = np.cumsum(one), np.cumsum(~one)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(one), part)), pa.array(without - ~one + seen[0]), pa.array(with_ - one + seen[1])], names=names)
            seen += [int((~one).sum()), int(one.sum())]

    types = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in [*keep, flag])
    s = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select(*keep, flag)
    s = written(s.mapInArrow(count, f"{types}, _part long, _n0 long, _n1 long"), "counted")
    before = Window.orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)
    ends = s.groupBy(F.col("_part").alias("_of")).agg(F.count_if(~F.col(flag)).alias("_a"), F.count_if(flag).alias("_b"))
    starts = ends.select("_of", F.coalesce(F.sum("_a").over(before), F.lit(0)).alias("_a"), F.coalesce(F.sum("_b").over(before), F.lit(0)).alias("_b"))
    return s.join(F.broadcast(starts), F.col("_part") == F.col("_of")).select(*keep, flag, (F.col("_n0") + F.col("_a")).alias("_n0"), (F.col("_n1") + F.col("_b")).alias("_n1"))


def by_header(sequences: DataFrame, short: bool = False) -> DataFrame:
    """Ranked by header, then seq_id. See duplicate_headers for the error case."""
    header = A.short_header(F.col("header")) if short else F.col("header")
    return ranked(sequences.withColumn("key", header), "key", "seq_id")


def by_length(sequences: DataFrame) -> DataFrame:
    return ranked(sequences.withColumn("length", length()), "length", "seq_id")


def duplicate_headers(sequences: DataFrame, short: bool = False) -> DataFrame:
    header = A.short_header(F.col("header")) if short else F.col("header")
    return sequences.groupBy(header.alias("header")).agg(F.count("*").alias("n")).where("n > 1")


def duplicate_files(paths: DataFrame, column: str = "path") -> DataFrame:
    """(name, n): file names, without their folders, that several paths end in."""
    return paths.groupBy(F.substring_index(column, "/", -1).alias("name")).agg(F.count("*").alias("n")).where("n > 1")


def bit_select(ranks: DataFrame, wanted: DataFrame) -> DataFrame:
    """(k, position, bit): where the k-th one (from 1) of a bit vector stands, from words
    in order (position, bits, rank), rank being the ones up to and with the word, and
    wanted (k). Words are found by an equi-join on blocks of ones, not by a range."""
    size = F.bit_count("bits")
    own = ranks.where(size > 0).select("position", "bits", F.col("rank"), (F.col("rank") - size).alias("before"))
    block = lambda c: F.floor(c / 1024)
    own = own.select("*", F.explode(F.sequence(block(F.col("before") + 1), block(F.col("rank")))).alias("_block"))
    asked = wanted.select("k").withColumn("_of", block(F.col("k")))
    hit = asked.join(own, (F.col("_of") == F.col("_block")) & (F.col("k") > F.col("before")) & (F.col("k") <= F.col("rank")))
    ones = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.call_function("shiftrightunsigned", F.col("bits"), i).bitwiseAND(F.lit(1)) == 1)
    return hit.select("k", "position", F.get(ones, (F.col("k") - F.col("before") - 1).cast("int")).alias("bit"))


def table_is_protein(sequences: DataFrame, most: int = 1000) -> DataFrame:
    """(is_protein): whether, among sequences before which fewer than `most` residues
    stand, one looks like protein. Only ids, lengths and flags of the first rows are
    sorted: at most `most` non-empty sequences matter."""
    rows = sequences.where(length() > 0).select("seq_id", length().cast("long").alias("n"), A.looks_protein(F.col("sequence"), most).alias("p")).orderBy("seq_id").limit(most)
    before = F.coalesce(F.sum("n").over(Window.orderBy("seq_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("before", before).where(F.col("before") < most).agg(F.coalesce(F.bool_or("p"), F.lit(False)).alias("is_protein"))


def both_strands(sequences: DataFrame) -> DataFrame:
    """Sequence i becomes 2 i, its reverse complement 2 i + 1."""
    strands = F.array(F.struct(F.lit(0).alias("strand"), F.col("sequence").alias("sequence")), F.struct(F.lit(1).alias("strand"), A.reverse_complement(F.col("sequence")).alias("sequence")))
    return sequences.select("seq_id", "header", F.explode(strands).alias("s")).select((F.col("seq_id") * 2 + F.col("s.strand")).alias("seq_id"), "header", F.col("s.sequence").alias("sequence"), F.col("s.strand").alias("strand"))


def paired(first: DataFrame, second: DataFrame) -> DataFrame:
    """Mates as sequences 2 i and 2 i + 1; an error if one file has more. The join is
    on seq_id, the ordinal."""
    b = second.select(F.col("seq_id").alias("_id"), F.col("header").alias("_header"), F.col("sequence").alias("_sequence"))
    both = first.select("seq_id", "header", "sequence").join(b, F.col("seq_id") == F.col("_id"), "full")
    whole = F.when(F.col("seq_id").isNull() | F.col("_id").isNull(), F.raise_error(F.lit("the files of a pair have unequal numbers of sequences")).cast("long")).otherwise(F.col("seq_id"))
    mates = F.array(F.struct(F.lit(0).alias("m"), F.col("header"), F.col("sequence")), F.struct(F.lit(1).alias("m"), F.col("_header").alias("header"), F.col("_sequence").alias("sequence")))
    return both.select(whole.alias("pair"), F.explode(mates).alias("x")).select((F.col("pair") * 2 + F.col("x.m")).alias("seq_id"), F.col("x.header").alias("header"), F.col("x.sequence").alias("sequence"))


def batches(sequences: DataFrame, n: int) -> DataFrame:
    """seq_id is a dense number: batch is seq_id div n."""
    return sequences.withColumn("batch", F.floor(F.col("seq_id") / n))


def concatenated_offsets(sequences: DataFrame) -> DataFrame:
    """(seq_id, length, offset): where each sequence starts if all are joined with one
    separator between two. Running sums go by blocks of ids, so only block sums meet in
    one task."""
    s = sequences.select("seq_id", length().cast("long").alias("length")).withColumn("_block", F.floor(F.col("seq_id") / 4096))
    inner = Window.partitionBy("_block").orderBy("seq_id").rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("_in", F.coalesce(F.sum(F.col("length") + 1).over(inner), F.lit(0)))
    total = s.groupBy("_block").agg(F.sum(F.col("length") + 1).alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_block", "_before")
    return s.join(total, "_block").select("seq_id", "length", (F.col("_before") + F.col("_in")).alias("offset"))
