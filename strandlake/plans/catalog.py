"""The queries of the library on the driver's tables, and their SQL.

Each runs over whole tables and whole texts. Operators that SQL can't express have no
SQL here and are tested against brute force."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandlake.functions import alphabet as A
from strandlake.functions import cigar as K
from strandlake.functions import codes as C
from strandlake.functions import digests
from strandlake.operators import align, bloom, chaining, edit, matches, minimizers, missing, partition, qgrams, ranges, sampling, sketch, stats, suffixes
from strandlake.plans import views as V

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch_f0(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# Statistics and orders.


@query(f"WITH {V.SQL_DOCUMENTS} SELECT count(*) AS sequences_number, min(length(sequence))::INTEGER AS min_length, max(length(sequence))::INTEGER AS max_length, sum(length(sequence))::BIGINT AS total_length, length(ltrim(bin(count(*)), '0'))::INTEGER AS number_bits, length(ltrim(bin(max(length(sequence))), '0'))::INTEGER AS length_bits FROM s")
def seq_stats(spark, sf_dir):
    return stats.statistics(V.documents(spark, sf_dir))


@query(f"WITH {V.SQL_DOCUMENTS} SELECT count(*) AS sequences_number, sum(length(sequence))::BIGINT AS total_length, (sum(length(sequence)) // count(*))::BIGINT AS mean_length, min(length(sequence))::INTEGER AS min_length, max(length(sequence))::INTEGER AS max_length FROM s")
def mean_stats(spark, sf_dir):
    return stats.mean_statistics(V.documents(spark, sf_dir))


@query(f"WITH {V.SQL_DOCUMENTS}, c AS (SELECT length(sequence)::INTEGER AS length, count(*) AS n FROM s GROUP BY 1) SELECT length, n, round(100.0::DOUBLE * n / sum(n) OVER (), 4) AS percent FROM c")
def length_ratios(spark, sf_dir):
    return stats.length_ratios(V.documents(spark, sf_dir))


@query(f"WITH {V.SQL_DOCUMENTS} SELECT length(sequence)::BIGINT AS bin, count(*) AS n FROM s GROUP BY 1")
def length_dist_bin1(spark, sf_dir):
    return stats.length_distribution(V.documents(spark, sf_dir))


@query(f"WITH {V.SQL_DOCUMENTS} SELECT (length(sequence) // 100)::BIGINT AS bin, count(*) AS n FROM s GROUP BY 1")
def length_dist_bin100(spark, sf_dir):
    return stats.length_distribution(V.documents(spark, sf_dir), 100)


@query(f"WITH {V.SQL_DOCUMENTS}, c AS (SELECT unnest(string_split(sequence, '')) AS c FROM s), r AS (SELECT CASE c WHEN 'A' THEN 0 WHEN 'C' THEN 1 WHEN 'G' THEN 2 WHEN 'T' THEN 3 ELSE 4 END AS rank FROM c WHERE c <> '') SELECT rank, count(*) AS n FROM r GROUP BY 1")
def rank_distribution(spark, sf_dir):
    return stats.rank_distribution(V.documents(spark, sf_dir))


@query(f"WITH {V.SQL_DOCUMENTS}, c AS (SELECT unnest(string_split(sequence, '')) AS c FROM s) SELECT ((ascii(c) >> 1) & 3)::INTEGER AS class, count(*) AS n FROM c WHERE c IN ('A', 'C', 'G', 'T') GROUP BY 1")
def char_class_distribution(spark, sf_dir):
    return stats.char_class_distribution(V.documents(spark, sf_dir))


@query(f"WITH {V.SQL_NATIONS}, c AS (SELECT unnest(string_split(sequence, '')) AS c FROM s) SELECT CASE WHEN instr('{A.PROTEIN}', c) > 0 THEN instr('{A.PROTEIN}', c) - 1 ELSE 20 END::INTEGER AS rank, count(*) AS n FROM c WHERE c <> '' GROUP BY 1")
def protein_rank_distribution(spark, sf_dir):
    return stats.rank_distribution(V.nations(spark, sf_dir), A.PROTEIN)


@query(f"WITH {V.SQL_DOCUMENTS} SELECT seq_id, header, row_number() OVER (ORDER BY header, seq_id) - 1 AS rank FROM s WHERE length(sequence) >= 100")
def sorted_by_header(spark, sf_dir):
    return stats.by_header(stats.in_length_range(V.documents(spark, sf_dir), 100)).select("seq_id", "header", "rank")


@query(f"WITH {V.SQL_DOCUMENTS} SELECT seq_id, length(sequence)::INTEGER AS length, row_number() OVER (ORDER BY length(sequence), seq_id) - 1 AS rank FROM s WHERE length(sequence) BETWEEN 50 AND 5000")
def sorted_by_length(spark, sf_dir):
    return stats.by_length(stats.in_length_range(V.documents(spark, sf_dir), 50, 5000)).select("seq_id", "length", "rank")


@query(f"WITH {V.SQL_DOCUMENTS} SELECT split_part(header, '|', 1) AS header, count(*) AS n FROM s GROUP BY 1 HAVING count(*) > 1")
def duplicate_headers(spark, sf_dir):
    d = V.documents(spark, sf_dir)
    return stats.duplicate_headers(d.withColumn("header", F.substring_index("header", "|", 1)))


@query("SELECT doc_id AS seq_id, regexp_matches(substr(upper(text), 1, 1000), '[LIFEQPXZ]') AS is_protein FROM documents")
def guess_protein(spark, sf_dir):
    return V.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq_id"), A.looks_protein(F.upper("text")).alias("is_protein"))


@query("WITH s AS (SELECT doc_id, text AS t FROM documents WHERE length(text) > 0), b AS (SELECT *, coalesce(sum(length(t)) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM s) SELECT coalesce(bool_or(regexp_matches(substr(t, 1, 1000), '[LIFEQPXZ]')), false) AS is_protein FROM b WHERE before < 1000")
def guess_protein_table(spark, sf_dir):
    return stats.table_is_protein(V.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq_id"), F.col("text").alias("sequence")))


@query(f"WITH {V.SQL_DOCUMENTS} SELECT seq_id, header, regexp_extract(header, '^(\\S*)', 1) AS short, CASE WHEN instr(header, '|') > 0 THEN split_part(header, '|', 2) ELSE regexp_extract(header, '^(\\S*)', 1) END AS bar FROM s")
def header_forms(spark, sf_dir):
    return V.documents(spark, sf_dir).select("seq_id", "header", A.short_header(F.col("header")).alias("short"), A.bar_header(F.col("header")).alias("bar"))


@query(f"WITH {V.SQL_DOCUMENTS} SELECT seq_id, md5(reverse(translate(sequence, 'ACGT', 'TGCA'))) AS rc FROM s")
def reverse_complement(spark, sf_dir):
    return V.documents(spark, sf_dir).select("seq_id", F.md5(A.reverse_complement(F.col("sequence")).cast("binary")).alias("rc"))


@query(f"WITH {V.SQL_DOCUMENTS} SELECT seq_id * 2 AS seq_id, 0 AS strand, md5(sequence) AS sequence FROM s UNION ALL SELECT seq_id * 2 + 1, 1, md5(reverse(translate(sequence, 'ACGT', 'TGCA'))) FROM s")
def both_strands(spark, sf_dir):
    return stats.both_strands(V.documents(spark, sf_dir)).select("seq_id", "strand", F.md5(F.col("sequence").cast("binary")).alias("sequence"))


@query(f"WITH {V.SQL_DOCUMENTS} SELECT seq_id, md5(translate(sequence, 'ACGTN', '01234')) AS ranks, md5(sequence) AS decoded FROM s")
def encoded_ranks(spark, sf_dir):
    d = V.documents(spark, sf_dir).withColumn("ranks", A.encode(F.col("sequence")))
    return d.select("seq_id", F.md5(F.col("ranks").cast("binary")).alias("ranks"), F.md5(F.translate("ranks", "01234", "ACGTN").cast("binary")).alias("decoded"))


@query(f"WITH {V.SQL_DOCUMENTS} SELECT seq_id, md5(translate(sequence, 'N', 'A')) AS unpacked, (ceil(length(sequence) / 4.0) * 2)::BIGINT AS hex_digits FROM s")
def packed_sequences(spark, sf_dir):
    d = V.documents(spark, sf_dir).withColumn("sequence", A.wildcards_as_a(F.col("sequence")))
    d = d.withColumn("hex", A.packed_hex(F.col("sequence")))
    return d.select("seq_id", F.md5(A.unpacked(F.col("hex"), F.length("sequence")).cast("binary")).alias("unpacked"), F.length("hex").cast("long").alias("hex_digits"))


@query(f"WITH {V.SQL_DOCUMENTS} SELECT seq_id // 100 AS batch, count(*) AS n, sum(length(sequence))::BIGINT AS total_length FROM s GROUP BY 1")
def batches_of_sequences(spark, sf_dir):
    return stats.batches(V.documents(spark, sf_dir), 100).groupBy("batch").agg(F.count("*").alias("n"), F.sum(F.length("sequence")).alias("total_length"))


@query(f"WITH {V.SQL_DOCUMENTS} SELECT seq_id, length(sequence)::BIGINT AS length, coalesce(sum(length(sequence) + 1) OVER (ORDER BY seq_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS offset FROM s")
def concatenated_offsets(spark, sf_dir):
    return stats.concatenated_offsets(V.documents(spark, sf_dir))


_OFFSETS = f"WITH {V.SQL_DOCUMENTS}, o AS (SELECT seq_id, length(sequence)::BIGINT AS n, coalesce(sum(length(sequence) + 1) OVER (ORDER BY seq_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS \"offset\" FROM s)"


@query(f"{_OFFSETS}, p AS (SELECT DISTINCT l_partkey * 997 AS pos FROM lineitem) SELECT pos, seq_id, pos - \"offset\" AS relpos FROM p JOIN o ON pos >= \"offset\" AND pos < \"offset\" + n")
def position_to_sequence(spark, sf_dir):
    offsets = stats.concatenated_offsets(V.documents(spark, sf_dir))
    positions = V.table(spark, sf_dir, "lineitem").select((F.col("l_partkey") * 997).alias("pos")).distinct()
    return suffixes.positions_to_sequences(positions, offsets)


@query("WITH t AS (SELECT conv_id, turn, role, text FROM conversations) SELECT a.conv_id, a.turn, md5(a.text) AS first, md5(b.text) AS second FROM t a JOIN t b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.turn % 2 = 0")
def paired_turns(spark, sf_dir):
    t = V.table(spark, sf_dir, "conversations")
    b = t.where("turn % 2 = 1").select(F.col("conv_id").alias("c"), (F.col("turn") - 1).alias("t"), F.col("text").alias("second"))
    both = t.where("turn % 2 = 0").join(b, (F.col("conv_id") == F.col("c")) & (F.col("turn") == F.col("t")))
    return both.select("conv_id", "turn", F.md5(F.col("text").cast("binary")).alias("first"), F.md5(F.col("second").cast("binary")).alias("second"))


@query(f"WITH {V.SQL_NATIONS} SELECT seq_id * 2 AS seq_id, header, sequence FROM s UNION ALL SELECT seq_id * 2 + 1, header, reverse(sequence) FROM s")
def paired_zip(spark, sf_dir):
    n = V.nations(spark, sf_dir)
    return stats.paired(n, n.withColumn("sequence", F.reverse("sequence")))


@query(f"WITH {V.SQL_DOCUMENTS} SELECT sum(greatest(length(sequence) - 20 + 1, 0))::BIGINT AS suffixes FROM s")
def suffix_count(spark, sf_dir):
    return qgrams.suffix_count(V.documents(spark, sf_dir), 20)


# Ranges and q-grams.

_RANGES = f"WITH {V.SQL_DOCUMENTS}, {V.sql_ranges()}"


@query(f"{_RANGES} SELECT seq_id, range_no, start, len, md5(run) AS run FROM r")
def valid_ranges(spark, sf_dir):
    return ranges.ranges(V.documents(spark, sf_dir)).withColumn("run", F.md5(F.col("run").cast("binary")))


@query(f"WITH {V.SQL_DOCUMENTS}, {V.sql_ranges(invert=True)} SELECT seq_id, range_no, start, len, run FROM r")
def wildcard_ranges(spark, sf_dir):
    return ranges.wildcard_ranges(V.documents(spark, sf_dir))


@query(f"{_RANGES} SELECT seq_id, range_no, start, len FROM r ORDER BY seq_id, start DESC")
def backward_ranges(spark, sf_dir):
    return ranges.backward_ranges(V.documents(spark, sf_dir)).drop("run")


_NON_N = f"WITH {V.SQL_DOCUMENTS}, {V.sql_ranges(inside='[^N]', least=40)}"


@query(f"{_NON_N} SELECT seq_id, start, (start + len - 1)::INTEGER AS \"end\" FROM r")
def non_n_ranges(spark, sf_dir):
    return ranges.non_n_ranges(V.documents(spark, sf_dir), 40)


@query(f"{_NON_N} SELECT count(*) AS ranges, sum(len)::BIGINT AS total_length, max(len)::INTEGER AS max_length FROM r")
def non_n_range_summary(spark, sf_dir):
    return ranges.non_n_summary(V.documents(spark, sf_dir), 40)


@query(f"{_RANGES}, {V.sql_qgrams(8)} SELECT qgram, count(*) AS n FROM g GROUP BY 1")
def qgram_counts_k8(spark, sf_dir):
    n = qgrams.counts(qgrams.qgram_values(V.documents(spark, sf_dir), 8, "code", columns=("value",)), "value")
    return n.select(C.decode_code(F.col("value"), 8).alias("qgram"), "n")


def _code_sums(rows: DataFrame, column: str) -> DataFrame:
    return rows.agg(F.count("*").alias("qgrams"), C.wrapped_sum(F.col(column)).alias("code_sum"))


@query(f"{_RANGES}, {V.sql_qgrams(12)} SELECT count(*) AS qgrams, (sum(({V.sql_code('qgram', 12)})::HUGEINT) % 18446744073709551616)::VARCHAR AS code_sum FROM g")
def qgram_codes_sum(spark, sf_dir):
    return _code_sums(qgrams.qgram_values(V.documents(spark, sf_dir), 12, "code", columns=("value",)), "value")


@query(f"{_RANGES}, {V.sql_qgrams(12)} SELECT count(*) AS qgrams, (sum(({V.sql_code('qgram', 12, True)})::HUGEINT) % 18446744073709551616)::VARCHAR AS code_sum FROM g")
def qgram_codes_rc_sum(spark, sf_dir):
    return _code_sums(qgrams.qgram_values(V.documents(spark, sf_dir), 12, "code", columns=("rc_value",)), "rc_value")


@query(f"WITH {V.SQL_BENCHMARK}, s AS (SELECT * FROM b), {V.sql_ranges()}, {V.sql_qgrams(9)} SELECT seq_id, pos, qgram, ({V.sql_code('qgram', 9)})::BIGINT AS code, ({V.sql_code('qgram', 9, True)})::BIGINT AS rc_code, qgram AS decoded FROM g")
def qgram_code_columns(spark, sf_dir):
    g = qgrams.qgram_rows(V.benchmark(spark, sf_dir), 9)
    g = g.select("seq_id", F.col("pos").cast("long").alias("pos"), "qgram", C.code(F.col("qgram")).alias("code"), C.reverse_code(F.col("qgram")).alias("rc_code"))
    return g.withColumn("decoded", C.decode_code(F.col("code"), 9))


@query(f"WITH {V.SQL_NATIONS}, {V.sql_ranges(inside='[' + A.PROTEIN + ']')}, g AS (SELECT seq_id, start + i AS pos, substr(run, i + 1, 3) AS qgram FROM (SELECT *, unnest(range(0, len - 2))::INTEGER AS i FROM r WHERE len >= 3)) SELECT seq_id, pos::BIGINT AS pos, qgram, ((instr('{A.PROTEIN}', substr(qgram, 1, 1)) - 1) * 400 + (instr('{A.PROTEIN}', substr(qgram, 2, 1)) - 1) * 20 + instr('{A.PROTEIN}', substr(qgram, 3, 1)) - 1)::BIGINT AS code, qgram AS decoded FROM g")
def protein_codes(spark, sf_dir):
    g = qgrams.qgram_rows(V.nations(spark, sf_dir), 3, A.PROTEIN).select("seq_id", F.col("pos").cast("long").alias("pos"), "qgram")
    g = g.withColumn("code", C.code(F.col("qgram"), A.PROTEIN))
    return g.withColumn("decoded", C.decode_protein_code(F.col("code"), 3))


@query(f"WITH {V.SQL_BENCHMARK_LETTERS}, {V.sql_ranges(inside='[' + A.PROTEIN + ']')}, g AS (SELECT seq_id, start + i AS pos, substr(run, i + 1, 3) AS qgram FROM (SELECT *, unnest(range(0, len - 2))::INTEGER AS i FROM r WHERE len >= 3)) SELECT seq_id, pos::BIGINT AS pos, qgram, ((instr('{A.PROTEIN}', substr(qgram, 1, 1)) - 1) * 400 + (instr('{A.PROTEIN}', substr(qgram, 2, 1)) - 1) * 20 + instr('{A.PROTEIN}', substr(qgram, 3, 1)) - 1)::BIGINT AS code, qgram AS decoded FROM g")
def benchmark_protein_codes(spark, sf_dir):
    g = qgrams.qgram_rows(V.benchmark_letters(spark, sf_dir), 3, A.PROTEIN).select("seq_id", F.col("pos").cast("long").alias("pos"), "qgram")
    g = g.withColumn("code", C.code(F.col("qgram"), A.PROTEIN))
    return g.withColumn("decoded", C.decode_protein_code(F.col("code"), 3))


@query(f"WITH {V.SQL_DOCUMENTS}, t AS (SELECT seq_id, regexp_replace(sequence, '[^ACGTUacgtu]', 'A', 'g') AS sequence FROM s), {V.sql_ranges(of='t')}, {V.sql_qgrams(10)} SELECT count(*) AS qgrams, (sum(({V.sql_code('qgram', 10)})::HUGEINT) % 18446744073709551616)::VARCHAR AS code_sum FROM g")
def wildcard_as_a_qgrams(spark, sf_dir):
    d = V.documents(spark, sf_dir).withColumn("sequence", A.wildcards_as_a(F.col("sequence")))
    return _code_sums(qgrams.qgram_values(d, 10, "code", columns=("value",)), "value")


@query(f"WITH {V.SQL_DOCUMENTS}, w AS (SELECT sequence, unnest(range(0, length(sequence) - 9)) AS i FROM s WHERE length(sequence) >= 10) SELECT (10 - length(replace(substr(sequence, (i + 1)::INTEGER, 10), 'N', '')))::INTEGER AS wildcards, count(*) AS n FROM w GROUP BY 1")
def windows_with_wildcards(spark, sf_dir):
    return qgrams.windows_with_wildcards(V.documents(spark, sf_dir), 10, columns=("wildcards",)).groupBy("wildcards").agg(F.count("*").alias("n"))


@query(f"{_RANGES}, {V.sql_qgrams(12)} SELECT count(*) AS qgrams, (sum(({V.sql_hash('qgram', 12)})::HUGEINT) % 18446744073709551616)::VARCHAR AS code_sum FROM g")
def rolling_hash_sum(spark, sf_dir):
    return _code_sums(qgrams.qgram_values(V.documents(spark, sf_dir), 12, columns=("value",)), "value")


@query(f"WITH {V.SQL_BENCHMARK}, s AS (SELECT * FROM b), {V.sql_ranges()}, {V.sql_qgrams(8)} SELECT seq_id, pos, ({V.sql_hash('qgram', 8)} & 9223372036854775807::UBIGINT)::BIGINT AS hash, ({V.sql_hash('qgram', 8, True)} & 9223372036854775807::UBIGINT)::BIGINT AS rc_hash FROM g")
def rolling_hash_columns(spark, sf_dir):
    g = qgrams.qgram_rows(V.benchmark(spark, sf_dir), 8)
    return g.select("seq_id", F.col("pos").cast("long").alias("pos"), C.masked(C.hash_qgram(F.col("qgram"), 8), 63).alias("hash"), C.masked(C.hash_qgram(A.reverse_complement(F.col("qgram")), 8), 63).alias("rc_hash"))


@query(f"{_RANGES}, {V.sql_qgrams(12)} SELECT seq_id, min(least({V.sql_hash('qgram', 12)} & 9223372036854775807::UBIGINT, {V.sql_hash('qgram', 12, True)} & 9223372036854775807::UBIGINT))::BIGINT AS hash FROM g GROUP BY 1")
def canonical_hash_min(spark, sf_dir):
    g = qgrams.qgram_values(V.documents(spark, sf_dir), 12, columns=("seq_id", "value", "rc_value"))
    return g.groupBy("seq_id").agg(F.min(C.canonical(F.col("value"), F.col("rc_value"))).alias("hash"))


@query(f"{_RANGES}, {V.sql_qgrams(12)} SELECT seq_id, range_start, pos, ({V.sql_code('qgram', 12)})::BIGINT AS value FROM g WHERE (pos - range_start) % 50 = 0")
def constant_distance_qgrams(spark, sf_dir):
    return qgrams.constant_distance(qgrams.qgram_values(V.documents(spark, sf_dir), 12, "code"), 50)


@query(f"{_RANGES}, {V.sql_qgrams(12)} SELECT count(DISTINCT qgram) AS distinct_qgrams, count(*) AS qgrams FROM g")
def distinct_qgrams(spark, sf_dir):
    return qgrams.qgram_values(V.documents(spark, sf_dir), 12, "code", columns=("value",)).agg(F.count_distinct("value").alias("distinct_qgrams"), F.count("*").alias("qgrams"))


@query()
def approx_distinct_qgrams(spark, sf_dir):
    return qgrams.qgram_values(V.documents(spark, sf_dir), 12, "code", columns=("value",)).agg(F.approx_count_distinct("value").alias("distinct_qgrams"))


@query(f"{_RANGES}, {V.sql_qgrams(14)}, {V.SQL_BENCHMARK}, {V.sql_ranges('x', 'b')}, {V.sql_qgrams(14, 'h', 'x')} SELECT qgram FROM g INTERSECT SELECT qgram FROM h")
def shared_qgrams(spark, sf_dir):
    """q-grams of both documents and benchmark."""
    d, b = (qgrams.qgram_values(t(spark, sf_dir), 14, "code", columns=("value",)) for t in (V.documents, V.benchmark))
    return d.intersect(b).select(C.decode_code(F.col("value"), 14).alias("qgram"))


@query("SELECT i AS number FROM range(0, 3000) t(i) WHERE i NOT IN (SELECT p_partkey FROM part)")
def numbers_without(spark, sf_dir):
    return qgrams.numbers_without(spark, 3000, V.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("number")))


@query()
def wyhash_sum(spark, sf_dir):
    return digests.digest_sum(V.documents(spark, sf_dir))


@query()
def xxh64_sum(spark, sf_dir):
    return digests.digest_sum(V.documents(spark, sf_dir), "xxh64")


# Sketches.

_S, _R = 2, 16


def _slots(spark, sf_dir):
    return sketch.slots(qgrams.qgram_values(V.documents(spark, sf_dir), 12, columns=("value",), top_zero_bits=_S), _S, _R)


_SLOTS = f"{_RANGES}, {V.sql_qgrams(12)}, h AS (SELECT {V.sql_hash('qgram', 12)} AS h FROM g), t AS (SELECT (h & {(1 << _R) - 1}::UBIGINT)::BIGINT AS slot, count(*) AS n FROM h WHERE h >> {64 - _S} = 0 GROUP BY 1)"


@query(f"{_RANGES}, {V.sql_qgrams(12)}, h AS (SELECT {V.sql_hash('qgram', 12)} AS h FROM g), t AS (SELECT (h & {(1 << 22) - 1}::UBIGINT)::BIGINT AS slot, count(*) AS n FROM h WHERE h >> 62 = 0 GROUP BY 1) SELECT round(-ln(({1 << 22} - count(*)) / {1 << 22}::DOUBLE) * {1 << 24}::DOUBLE, 3) AS f0 FROM t")
def sketch_f0(spark, sf_dir):
    """Flagship: estimated number of distinct q-grams of all documents."""
    s = sketch.slots(qgrams.qgram_values(V.documents(spark, sf_dir), 12, columns=("value",), top_zero_bits=2), 2, 22)
    return sketch.f0(s, 2, 22).select(F.round("f0", 3).alias("f0"))


@query(f"{_SLOTS} SELECT least(n, 65535)::BIGINT AS count, count(*) AS slots FROM t GROUP BY 1")
def sketch_slot_histogram(spark, sf_dir):
    return sketch.slot_histogram(_slots(spark, sf_dir)).select(F.col("count").cast("long").alias("count"), "slots")


@query()
def sketch_moments(spark, sf_dir):
    s = sketch.slots(qgrams.qgram_values(V.documents(spark, sf_dir), 12, columns=("value",), top_zero_bits=2), 2, 22)
    return sketch.moments_table(s, 2, 22)


@query(f"{_RANGES}, {V.sql_qgrams(32)} SELECT count(*) AS f1, (SELECT count(*) FROM s) AS sequences_number FROM g")
def sketch_f1(spark, sf_dir):
    d = V.documents(spark, sf_dir)
    return qgrams.qgram_values(d, 32, columns=("value",)).agg(F.count("*").alias("f1")).crossJoin(d.agg(F.count("*").alias("sequences_number")))


@query(f"{_SLOTS} SELECT slot, n FROM t")
def sketch_merged_parts(spark, sf_dir):
    """Sketches of two halves of the table as one."""
    d = V.documents(spark, sf_dir)
    halves = [sketch.slots(qgrams.qgram_values(d.where(F.col("seq_id") % 2 == i), 12, columns=("value",), top_zero_bits=_S), _S, _R) for i in (0, 1)]
    return sketch.merged(*halves)


# Missing words.


@query(f"{_RANGES}, {V.sql_qgrams(8)}, k AS (SELECT i FROM range(0, 65536) t(i)), c AS (SELECT DISTINCT ({V.sql_code('qgram', 8)})::BIGINT AS code FROM g) SELECT array_to_string(list_transform(range(0, 8), lambda j: substr('ACGT', ((i >> (2 * (7 - j))) & 3)::INTEGER + 1, 1)), '') AS word FROM k WHERE i NOT IN (SELECT code FROM c)")
def missing_words_k8(spark, sf_dir):
    return missing.missing_words(V.documents(spark, sf_dir), 8)


def _shortest_sql(top: int = 8) -> str:
    parts = []
    for q in range(1, top + 1):
        parts.append(f"SELECT {q} AS q, code FROM (SELECT i AS code FROM range(0, {4**q}) t(i)) WHERE code NOT IN (SELECT DISTINCT ({V.sql_code('substr(run, (i + 1)::INTEGER, %d)' % q, q)})::BIGINT FROM (SELECT run, unnest(range(0, len - {q} + 1)) AS i FROM r WHERE len >= {q}))")
    return f"WITH {V.SQL_PARTS}, {V.sql_ranges()}, m AS ({' UNION ALL '.join(parts)}), k AS (SELECT min(q) AS q FROM m) SELECT m.q::INTEGER AS q, array_to_string(list_transform(range(0, m.q), lambda j: substr('ACGT', ((code >> (2 * (m.q - 1 - j))) & 3)::INTEGER + 1, 1)), '') AS word FROM m JOIN k ON m.q = k.q"


@query(_shortest_sql())
def missing_words_shortest(spark, sf_dir):
    q, words = missing.shortest_missing(V.parts(spark, sf_dir))
    return words.select(F.lit(q).alias("q"), "word")


@query(f"WITH {V.SQL_PARTS}, {V.sql_ranges()}, {V.sql_qgrams(6)}, c AS (SELECT qgram FROM g UNION SELECT reverse(translate(qgram, 'ACGT', 'TGCA')) FROM g), k AS (SELECT array_to_string(list_transform(range(0, 6), lambda j: substr('ACGT', ((i >> (2 * (5 - j))) & 3)::INTEGER + 1, 1)), '') AS word FROM range(0, 4096) t(i)) SELECT word FROM k WHERE word NOT IN (SELECT qgram FROM c)")
def missing_words_both_strands(spark, sf_dir):
    return missing.missing_words(V.parts(spark, sf_dir), 6, both_strands=True)


# Minimizers and matches.


def _minimizer_sql(value: str, w: int, source: str = "g") -> str:
    return f"""m_w AS (SELECT seq_id, pos, count(*) OVER (PARTITION BY seq_id, range_start) AS n,
  min(struct_pack(h := {value}, p := pos)) OVER (PARTITION BY seq_id, range_start ORDER BY pos ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW) AS m FROM {source}),
m AS (SELECT DISTINCT m.h AS hash, seq_id, m.p AS pos FROM m_w WHERE n >= {w} AND pos >= {w - 1})"""


_MINIMIZERS = f"{_RANGES}, {V.sql_qgrams(12)}, {_minimizer_sql('(' + V.sql_code('qgram', 12) + ')::BIGINT', 10)}"


def _minimizers(spark, sf_dir):
    return minimizers.sequence_minimizers(V.documents(spark, sf_dir), 12, 10)


@query(f"{_MINIMIZERS} SELECT hash, seq_id, pos FROM m")
def minimizers_w10_k12(spark, sf_dir):
    return _minimizers(spark, sf_dir)


@query(f"{_MINIMIZERS}, c AS (SELECT hash FROM m GROUP BY 1 HAVING count(*) <= 3) SELECT hash, seq_id, pos FROM m WHERE hash IN (SELECT hash FROM c)")
def minimizer_replicate_filter(spark, sf_dir):
    return minimizers.without_replicates(_minimizers(spark, sf_dir), 3)


@query(f"{_MINIMIZERS}, c AS (SELECT hash, count(*) AS occurrences FROM m GROUP BY 1) SELECT occurrences, count(*) AS hashes FROM c GROUP BY 1")
def minimizer_run_stats(spark, sf_dir):
    return minimizers.run_lengths(_minimizers(spark, sf_dir))


@query(f"{_MINIMIZERS}, t AS (SELECT sum(len - 11)::BIGINT AS qgrams, (sum(len - 11) - 2 * count(*))::BIGINT AS qgrams_less_two FROM r WHERE len >= 12), c AS (SELECT count(*) AS minimizers FROM m) SELECT minimizers, qgrams, qgrams_less_two, round(minimizers / qgrams::DOUBLE, 6) AS density FROM c, t")
def minimizer_density(spark, sf_dir):
    return minimizers.density(_minimizers(spark, sf_dir), ranges.ranges(V.documents(spark, sf_dir)), 12)


@query(f"""WITH {V.SQL_BENCHMARK}, s AS (SELECT * FROM b), {V.sql_ranges()}, {V.sql_qgrams(8)},
v AS (SELECT seq_id, range_start, pos, ({V.sql_code('qgram', 8)})::BIGINT AS f, ({V.sql_code('qgram', 8, True)})::BIGINT AS r FROM g),
c AS (SELECT seq_id, range_start, pos, least(f, r) AS h, CASE WHEN r < f THEN 1 ELSE 0 END AS strand, f = r AS same FROM v),
{_minimizer_sql('h', 5, 'c')},
x AS (SELECT m.hash, m.seq_id, m.pos, c.strand FROM m JOIN c ON m.seq_id = c.seq_id AND m.pos = c.pos
      UNION SELECT h, seq_id, pos, unnest([0, 1]) FROM c WHERE same)
SELECT DISTINCT x.hash, x.seq_id * 2 + x.strand AS seq_id, CASE WHEN strand = 1 THEN length(sequence) - x.pos - 8 ELSE x.pos END::BIGINT AS pos FROM x JOIN s ON x.seq_id = s.seq_id""")
def canonical_minimizers(spark, sf_dir):
    return minimizers.canonical_minimizers(V.benchmark(spark, sf_dir), 8, 5)


_TWO = f"{_RANGES}, {V.sql_qgrams(20)}, {V.SQL_BENCHMARK}, {V.sql_ranges('x', 'b')}, {V.sql_qgrams(20, 'h', 'x')}"


def _both(spark, sf_dir, q=20):
    return (qgrams.qgram_values(t(spark, sf_dir), q, "code", columns=("seq_id", "pos", "value")) for t in (V.benchmark, V.documents))


@query(f"{_TWO}, {_minimizer_sql('(' + V.sql_code('qgram', 20) + ')::BIGINT', 10, 'h').replace('m_w', 'a_w').replace('m AS', 'a AS', 1).replace('m AS (SELECT DISTINCT', 'a AS (SELECT DISTINCT')}, {_minimizer_sql('(' + V.sql_code('qgram', 20) + ')::BIGINT', 10)} SELECT a.seq_id AS ref_id, m.seq_id AS query_id, a.pos AS ref_pos, m.pos AS query_pos, a.hash FROM a JOIN m ON a.hash = m.hash")
def seed_matches(spark, sf_dir):
    b, d = (minimizers.sequence_minimizers(t(spark, sf_dir), 20, 10) for t in (V.benchmark, V.documents))
    return matches.seed_matches(b, d)


_MEMS = f"""{_TWO}, j AS (SELECT h.seq_id AS ref_id, g.seq_id AS query_id, h.pos AS rp, g.pos AS qp FROM h JOIN g ON h.qgram = g.qgram),
e AS (SELECT j.*, rp - row_number() OVER (PARTITION BY ref_id, query_id, rp - qp ORDER BY rp) AS run FROM j),
n AS (SELECT ref_id, query_id, max(rp) + 19 AS ref_end, max(qp) + 19 AS query_end, count(*) + 19 AS length FROM e GROUP BY ref_id, query_id, rp - qp, run)"""


@query(f"{_MEMS} SELECT * FROM n WHERE length >= 24")
def maximal_matches(spark, sf_dir):
    b, d = _both(spark, sf_dir)
    return matches.maximal_matches(b, d, 20, 24)


@query(f"{_MEMS} SELECT * FROM n WHERE length >= 40")
def extended_minimizer_matches(spark, sf_dir):
    b, d = (minimizers.sequence_minimizers(t(spark, sf_dir), 20, 10) for t in (V.benchmark, V.documents))
    return matches.extended_matches(matches.seed_matches(b, d), V.benchmark(spark, sf_dir), V.documents(spark, sf_dir), 20, 40)


@query()
def local_chains(spark, sf_dir):
    return chaining.local_chains(maximal_matches(spark, sf_dir))


# Intervals.


def _intervals(spark, sf_dir):
    e = V.table(spark, sf_dir, "events")
    start = F.unix_timestamp("ts").cast("long")
    return e.select(F.col("user_id").alias("group"), F.col("event_id").alias("id"), start.alias("start"), (F.floor(F.abs(F.col("value")) * 1000) + 3600).cast("long").alias("len"), F.col("value").alias("weight")).where("weight IS NOT NULL")


_INTERVALS = "i AS (SELECT user_id AS \"group\", event_id AS id, floor(epoch(ts))::BIGINT AS start, (floor(abs(value) * 1000) + 3600)::BIGINT AS len, value AS weight FROM events WHERE value IS NOT NULL)"


@query(f"WITH {_INTERVALS}, p AS (SELECT \"group\", start AS x FROM i UNION SELECT \"group\", start + len FROM i), c AS (SELECT i.*, p.x, rank() OVER (PARTITION BY i.\"group\", p.x ORDER BY weight DESC) AS k FROM i JOIN p ON i.\"group\" = p.\"group\" AND p.x >= start AND p.x < start + len) SELECT DISTINCT id FROM c WHERE k = 1")
def nonredundant_matches(spark, sf_dir):
    return matches.maximum_intervals(_intervals(spark, sf_dir)).select("id")


@query(f"WITH {_INTERVALS} SELECT a.id AS left_id, b.id AS right_id, least(a.start + a.len, b.start + b.len) - greatest(a.start, b.start) AS overlap FROM i a JOIN i b ON a.\"group\" = b.\"group\" AND a.id < b.id AND a.start < b.start + b.len AND b.start < a.start + a.len")
def interval_overlap(spark, sf_dir):
    i = _intervals(spark, sf_dir)
    return matches.overlaps(i, i, "group", 1 << 17).where("left_id < right_id").select("left_id", "right_id", "overlap")


# Chains.


def _match_rows(spark, sf_dir):
    li = V.table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_orderkey").alias("group"), F.col("l_linenumber").cast("long").alias("match_id"), F.col("l_partkey").alias("p_start"), F.col("l_quantity").cast("long").alias("p_len"), F.col("l_suppkey").alias("s_start"), F.lit(3).cast("long").alias("s_len"), (F.col("l_quantity") * 7).alias("weight"))


_CHAIN = "WITH RECURSIVE i AS (SELECT l_orderkey AS \"group\", l_linenumber AS id, l_partkey AS ps, l_partkey + l_quantity::BIGINT - 1 AS pe, l_suppkey AS ss, l_suppkey + 2 AS se, l_quantity * 7 AS w FROM lineitem), c AS (SELECT \"group\", id, pe, se, w::DOUBLE AS score FROM i UNION ALL SELECT i.\"group\", i.id, i.pe, i.se, {step} FROM c JOIN i ON c.\"group\" = i.\"group\" AND c.pe < i.ps AND c.se < i.ss)"


@query(_CHAIN.format(step="c.score + i.w") + " SELECT \"group\", max(score) AS score FROM c GROUP BY 1")
def chain_global(spark, sf_dir):
    return chaining.chains(_match_rows(spark, sf_dir)).select("group", "score")


@query(_CHAIN.format(step="greatest(i.w, c.score + i.w - (i.ps - c.pe) - (i.ss - c.se))") + " SELECT \"group\", max(score) AS score FROM c GROUP BY 1")
def chain_local(spark, sf_dir):
    return chaining.chains(_match_rows(spark, sf_dir), local=True).select("group", "score")


@query("WITH m AS (SELECT l_orderkey AS g, l_linenumber AS n, l_partkey AS ps, l_partkey + l_quantity::BIGINT - 1 AS pe, l_suppkey AS ss, l_suppkey + 2 AS se FROM lineitem) SELECT a.g AS \"group\", a.n AS a, b.n AS b, b.ps - a.pe - 1 AS p_gap, b.ss - a.se - 1 AS s_gap FROM m a JOIN m b ON a.g = b.g AND b.ps > a.pe AND b.ss > a.se")
def colinear_pairs(spark, sf_dir):
    m = _match_rows(spark, sf_dir)
    end = lambda x: F.col(f"{x}_start") + F.col(f"{x}_len") - 1
    a = m.select("group", F.col("match_id").cast("int").alias("a"), end("p").alias("pe"), end("s").alias("se"))
    b = m.select("group", F.col("match_id").cast("int").alias("b"), "p_start", "s_start")
    p, s = matches.colinear_gaps(F.col("pe"), F.col("se"), F.col("p_start"), F.col("s_start"))
    return a.join(b, "group").select("group", "a", "b", p.alias("p_gap"), s.alias("s_gap")).where("p_gap IS NOT NULL")


# Pairs, edit distances, alignments.

_PAIRS = f"WITH {V.SQL_NATIONS}, p AS (SELECT x.seq_id AS a, y.seq_id AS b, x.sequence AS u, y.sequence AS v FROM s x JOIN s y ON x.seq_id < y.seq_id)"
_BENCHMARK_PAIRS = f"WITH {V.SQL_BENCHMARK_LETTERS}, p AS (SELECT x.seq_id AS a, y.seq_id AS b, x.sequence AS u, y.sequence AS v FROM s x JOIN s y ON x.seq_id < y.seq_id)"


@query(f"{_PAIRS} SELECT a, b FROM p")
def triangle_pairs(spark, sf_dir):
    return partition.triangle_pairs(V.nations(spark, sf_dir), "seq_id", block=8)


@query("SELECT n_nationkey::BIGINT AS a, r_regionkey::BIGINT AS b FROM nation, region")
def all_pairs(spark, sf_dir):
    n = V.nations(spark, sf_dir).select(F.col("seq_id").alias("a"))
    return n.crossJoin(V.table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("b")))


@query("WITH i AS (SELECT (row_number() OVER (ORDER BY x) - 1) AS k, x AS i FROM range(0, 1500, 150) t(x)), d AS (SELECT x.i, 150 AS rows, 0 AS j, 0 AS columns FROM i x UNION ALL SELECT x.i, 150, y.i, 150 FROM i x JOIN i y ON x.k < y.k) SELECT (row_number() OVER (ORDER BY i + j, i, j) - 1)::INTEGER AS tile, i::INTEGER AS i, rows, j::INTEGER AS j, columns FROM d")
def tile_partition(spark, sf_dir):
    return partition.tiles(spark, 1500, cutlen=150)


@query("""WITH RECURSIVE k AS (SELECT m, n, greatest(1, greatest(m, n) // 10) AS cut FROM (SELECT (SELECT count(*) FROM customer) AS m, (SELECT count(*) FROM supplier) AS n)),
t AS (SELECT 0::BIGINT AS i, m AS rows, 0::BIGINT AS j, n AS columns, cut FROM k
  UNION ALL SELECT CASE WHEN rows < columns OR h = 0 THEN i ELSE i + (rows + 1) // 2 END, CASE WHEN rows < columns THEN rows WHEN h = 0 THEN (rows + 1) // 2 ELSE rows // 2 END,
    CASE WHEN rows < columns AND h = 1 THEN j + (columns + 1) // 2 ELSE j END, CASE WHEN rows >= columns THEN columns WHEN h = 0 THEN (columns + 1) // 2 ELSE columns // 2 END, cut
  FROM t, (VALUES (0), (1)) x(h) WHERE rows > cut OR columns > cut)
SELECT (row_number() OVER (ORDER BY i + j, i, j) - 1)::INTEGER AS tile, i::INTEGER AS i, rows::INTEGER AS rows, j::INTEGER AS j, columns::INTEGER AS columns FROM t WHERE rows <= cut AND columns <= cut""")
def tile_partition_two_tables(spark, sf_dir):
    return partition.tiles(spark, V.table(spark, sf_dir, "customer").count(), V.table(spark, sf_dir, "supplier").count())


@query(f"{_PAIRS}, l AS (SELECT DISTINCT n_nationkey::BIGINT AS a, n_regionkey::BIGINT AS b FROM nation), o AS (SELECT a, b FROM l UNION SELECT b, a FROM l) SELECT p.a, p.b FROM p JOIN o ON p.a = o.a AND p.b = o.b")
def pair_restricted_join(spark, sf_dir):
    allowed = V.table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("a"), F.col("n_regionkey").cast("long").alias("b"))
    return matches.restricted(triangle_pairs(spark, sf_dir), allowed)


@query("SELECT n.n_nationkey::BIGINT AS a, (SELECT min(m.n_nationkey) FROM nation m WHERE m.n_name = n.n_name)::BIGINT AS b FROM nation n")
def headers_to_numbers(spark, sf_dir):
    n = V.nations(spark, sf_dir)
    named = n.groupBy("header").agg(F.min("seq_id").alias("seq_id")).withColumn("header", F.regexp_replace("header", " ", "_"))
    return matches.numbered(named, n.select(F.col("seq_id").cast("string").alias("a"), F.regexp_replace("header", " ", "_").alias("b")))


@query("SELECT c_nationkey::BIGINT AS nation, min(c_custkey) AS customer FROM customer GROUP BY 1")
def first_hit_per_query(spark, sf_dir):
    c = V.table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("long").alias("nation"), F.col("c_custkey").alias("customer"))
    return matches.first_per(c, "nation", "customer")


@query("WITH e AS (SELECT n_nationkey::BIGINT AS a, lead(n_nationkey) OVER (ORDER BY n_nationkey)::BIGINT AS b FROM nation) SELECT a, b FROM e WHERE a % 2 = 0 AND b IS NOT NULL")
def consecutive_pairs(spark, sf_dir):
    """Sequences 2 i and 2 i + 1, by an equi-join of their halves."""
    n = V.nations(spark, sf_dir)
    odd = n.where("seq_id % 2 = 1").select((F.col("seq_id") - 1).alias("a"), F.col("seq_id").alias("b"))
    return n.where("seq_id % 2 = 0").select(F.col("seq_id").alias("a")).join(odd, "a")


@query(f"{_PAIRS} SELECT a, b, levenshtein(u, v)::INTEGER AS distance FROM p")
def edit_distance_pairs(spark, sf_dir):
    n = V.nations(spark, sf_dir)
    p = triangle_pairs(spark, sf_dir).join(n.select(F.col("seq_id").alias("a"), F.col("sequence").alias("left")), "a").join(n.select(F.col("seq_id").alias("b"), F.col("sequence").alias("right")), "b")
    return edit.distances(p).select("a", "b", "distance")


@query(f"{_BENCHMARK_PAIRS} SELECT a, b, levenshtein(u, v)::INTEGER AS distance FROM p")
def benchmark_edit_distances(spark, sf_dir):
    n = V.benchmark_letters(spark, sf_dir)
    p = partition.triangle_pairs(n, "seq_id").join(n.select(F.col("seq_id").alias("a"), F.col("sequence").alias("left")), "a").join(n.select(F.col("seq_id").alias("b"), F.col("sequence").alias("right")), "b")
    return edit.distances(p).select("a", "b", "distance")


@query("WITH p AS (SELECT x.item_id AS a, y.item_id AS b, levenshtein(x.text, y.text) AS d FROM benchmark x JOIN benchmark y ON x.item_id < y.item_id) SELECT a, b, CASE WHEN d <= 60 THEN d ELSE -1 END::INTEGER AS distance FROM p")
def bounded_edit_distance(spark, sf_dir):
    b = V.benchmark_text(spark, sf_dir)
    p = partition.triangle_pairs(b, "seq_id").join(b.select(F.col("seq_id").alias("a"), F.col("sequence").alias("left")), "a").join(b.select(F.col("seq_id").alias("b"), F.col("sequence").alias("right")), "b")
    return edit.distances(p, 60).select("a", "b", "distance")


@query(f"{_PAIRS}, k AS (SELECT *, least(length(u), length(v)) AS n FROM p) SELECT a, b, hamming(left(u, n), left(v, n))::INTEGER AS mismatches, coalesce(list_min(list_filter(range(1, n + 1), lambda i: substr(u, i::INTEGER, 1) <> substr(v, i::INTEGER, 1))) - 1, n)::INTEGER AS prefix, coalesce(list_min(list_filter(range(1, n + 1), lambda i: substr(u, (length(u) - i + 1)::INTEGER, 1) <> substr(v, (length(v) - i + 1)::INTEGER, 1))) - 1, n)::INTEGER AS suffix FROM k")
def matching_characters(spark, sf_dir):
    n = V.nations(spark, sf_dir)
    p = triangle_pairs(spark, sf_dir).join(n.select(F.col("seq_id").alias("a"), F.col("sequence").alias("u")), "a").join(n.select(F.col("seq_id").alias("b"), F.col("sequence").alias("v")), "b")
    u, v = F.col("u"), F.col("v")
    return p.select("a", "b", A.hamming(u, v).cast("int").alias("mismatches"), A.common_prefix(u, v).cast("int").alias("prefix"), A.common_suffix(u, v).cast("int").alias("suffix"))


@query(f"{_BENCHMARK_PAIRS}, k AS (SELECT *, least(length(u), length(v)) AS n FROM p) SELECT a, b, hamming(left(u, n), left(v, n))::INTEGER AS mismatches, coalesce(list_min(list_filter(range(1, n + 1), lambda i: substr(u, i::INTEGER, 1) <> substr(v, i::INTEGER, 1))) - 1, n)::INTEGER AS prefix, coalesce(list_min(list_filter(range(1, n + 1), lambda i: substr(u, (length(u) - i + 1)::INTEGER, 1) <> substr(v, (length(v) - i + 1)::INTEGER, 1))) - 1, n)::INTEGER AS suffix FROM k")
def benchmark_matching_characters(spark, sf_dir):
    n = V.benchmark_letters(spark, sf_dir)
    p = partition.triangle_pairs(n, "seq_id").join(n.select(F.col("seq_id").alias("a"), F.col("sequence").alias("u")), "a").join(n.select(F.col("seq_id").alias("b"), F.col("sequence").alias("v")), "b")
    u, v = F.col("u"), F.col("v")
    return p.select("a", "b", A.hamming(u, v).cast("int").alias("mismatches"), A.common_prefix(u, v).cast("int").alias("prefix"), A.common_suffix(u, v).cast("int").alias("suffix"))


_PATTERNS = ["the", "tion", "ing", "and th"]


@query("WITH p AS (SELECT unnest(['" + "', '".join(_PATTERNS) + "']) AS pattern), c AS (SELECT pattern, sum((length(text) - length(replace(text, pattern, ''))) // length(pattern)) AS hits FROM p, documents GROUP BY 1) SELECT pattern, hits::BIGINT AS hits FROM c WHERE hits > 0")
def exact_pattern_count(spark, sf_dir):
    d = V.table(spark, sf_dir, "documents").select(F.col("text").alias("sequence"))
    p = spark.createDataFrame([(x,) for x in _PATTERNS], "pattern string")
    return edit.pattern_counts(d, p, 0).where("hits > 0")


@query()
def approx_pattern_count(spark, sf_dir):
    d = V.table(spark, sf_dir, "documents").select(F.col("text").alias("sequence"))
    return edit.pattern_counts(d, spark.createDataFrame([("thetion",), ("and the of",)], "pattern string"), 2)


@query()
def all_edit_scripts(spark, sf_dir):
    n = V.benchmark_letters(spark, sf_dir)
    p = partition.triangle_pairs(n, "seq_id").join(n.select(F.col("seq_id").alias("a"), F.col("sequence").alias("left")), "a").join(n.select(F.col("seq_id").alias("b"), F.col("sequence").alias("right")), "b")
    p = p.select("a", "b", (F.shiftleft(F.col("a").cast("long"), 31) + F.col("b")).alias("id"), "left", "right")
    return edit.all_scripts(p.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "a", "b"))


def _aligned(spark, sf_dir, **options):
    b = V.benchmark_letters(spark, sf_dir)
    return align.align_pairs(partition.triangle_pairs(b, "seq_id"), b, **options)


@query()
def local_alignments(spark, sf_dir):
    return _aligned(spark, sf_dir)


@query()
def local_alignment_ends(spark, sf_dir):
    return _aligned(spark, sf_dir, ends_only=True)


@query()
def local_alignments_top20(spark, sf_dir):
    return align.best(_aligned(spark, sf_dir), 20)


@query()
def local_alignments_best_per_sequence(spark, sf_dir):
    return align.best_per_sequence(_aligned(spark, sf_dir), 3)


@query()
def local_alignments_bits(spark, sf_dir):
    return align.with_bit_scores(_aligned(spark, sf_dir), least=12)


@query()
def local_alignments_report(spark, sf_dir):
    return align.report(_aligned(spark, sf_dir, with_cigar=True), V.benchmark_letters(spark, sf_dir))


@query()
def local_alignments_both_strands(spark, sf_dir):
    b = V.benchmark(spark, sf_dir)
    return align.align_pairs(partition.triangle_pairs(b, "seq_id"), b, matrix="unit_score_nuc", gap_open=3, gap_ext=2, both_strands=True)


@query(f"SELECT i::INTEGER AS raw, floor({0.267 / 0.6931471805599453!r}::DOUBLE * i - {__import__('math').log(0.041) / 0.6931471805599453!r}::DOUBLE + 0.5)::INTEGER AS bits FROM range(0, 2000) t(i)")
def bit_score_table(spark, sf_dir):
    return spark.range(2000).select(F.col("id").cast("int").alias("raw"), K.bit_score(F.col("id")).alias("bits"))


_CIGARS = ["10=1X5=2I3=", "7=", "3D4=1I2X", "1=1X1=1X1=", "20=5D20=5I20="]


@query("WITH c AS (SELECT unnest(['" + "', '".join(_CIGARS) + "']) AS cigar), o AS (SELECT cigar, unnest(regexp_extract_all(cigar, '\\d+[=XIDM]')) AS p FROM c), n AS (SELECT cigar, left(p, length(p) - 1)::INTEGER AS n, right(p, 1) AS op FROM o) SELECT cigar, sum(CASE WHEN op <> '=' THEN n ELSE 0 END)::INTEGER AS edits, sum(CASE WHEN op IN ('=', 'X') THEN 2 * n ELSE n END)::INTEGER AS both_lengths, round(100 - 200.0::DOUBLE * sum(CASE WHEN op <> '=' THEN n ELSE 0 END) / sum(CASE WHEN op IN ('=', 'X') THEN 2 * n ELSE n END), 6) AS identity, sum(CASE op WHEN '=' THEN 2 * n WHEN 'X' THEN -n ELSE -(3 + 2 * n) END)::INTEGER AS score, cigar AS rendered FROM n GROUP BY cigar")
def cigar_values(spark, sf_dir):
    c = spark.createDataFrame([(x,) for x in _CIGARS], "cigar string")
    x = F.col("cigar")
    return c.select("cigar", K.edits(x).alias("edits"), K.aligned_length(x).alias("both_lengths"), F.round(K.identity(x), 6).alias("identity"), K.script_score(x, 2, -1, 3, 2).alias("score"), K.render(K.operations(x)).alias("rendered"))


# Splitting.


@query(f"WITH {V.SQL_DOCUMENTS} SELECT seq_id, seq_id // 64 AS part FROM s")
def split_by_number(spark, sf_dir):
    return partition.by_number(V.documents(spark, sf_dir), 64).select("seq_id", "part")


_GREEDY = f"WITH RECURSIVE {V.SQL_DOCUMENTS}, n AS (SELECT seq_id, length(sequence)::BIGINT AS length, row_number() OVER (ORDER BY seq_id) AS k FROM s), l AS ({{limit}}), f AS (SELECT k, seq_id, length, 0::BIGINT AS part, length AS filled FROM n WHERE k = 1 UNION ALL SELECT n.k, n.seq_id, n.length, CASE WHEN f.filled >= l.x THEN f.part + 1 ELSE f.part END, CASE WHEN f.filled >= l.x THEN n.length ELSE f.filled + n.length END FROM f JOIN n ON n.k = f.k + 1, l)"


@query(_GREEDY.format(limit="SELECT 20000 AS x") + " SELECT seq_id, length, part FROM f")
def split_by_length(spark, sf_dir):
    return partition.greedy_parts(V.documents(spark, sf_dir), 20_000)


@query(_GREEDY.format(limit="SELECT ceil(sum(length) / 7.0)::BIGINT AS x FROM n") + " SELECT seq_id, length, part FROM f")
def split_by_parts(spark, sf_dir):
    return partition.in_parts(V.documents(spark, sf_dir), 7)


@query(_GREEDY.format(limit="SELECT (sum(length) // 7)::BIGINT AS x FROM n") + ", t AS (SELECT part, sum(length) AS n FROM f GROUP BY 1) SELECT round(var_pop(n) * count(*), 6) AS variance FROM t")
def split_variance(spark, sf_dir):
    return partition.size_variance(partition.in_parts(V.documents(spark, sf_dir), 7, round_up=False))


@query("SELECT doc_id AS seq_id FROM documents ORDER BY md5(doc_id::VARCHAR || '|42'), doc_id LIMIT 50")
def random_sample(spark, sf_dir):
    return sampling.random_sample(V.documents(spark, sf_dir).select("seq_id"), 50, 42)


@query(f"WITH {V.SQL_DOCUMENTS} SELECT seq_id FROM s WHERE regexp_matches(sequence, 'ACGTAC') AND starts_with(header, 'src1') AND length(sequence) BETWEEN 100 AND 3000")
def selected_sequences(spark, sf_dir):
    return sampling.select(V.documents(spark, sf_dir), pattern="ACGTAC", header="^src1", least=100, most=3000).select("seq_id")


# Bloom filters.


@query("SELECT 0.01 AS error, (n * ln(0.01) * -2.081368)::DOUBLE::BIGINT AS bits, 6 AS hashes FROM (SELECT count(*) AS n FROM part)".replace("(n * ln(0.01) * -2.081368)::DOUBLE::BIGINT", "floor(n * ln(0.01) * -2.081368)::BIGINT"))
def bloom_parameters(spark, sf_dir):
    bits, hashes = bloom.parameters(0.01, V.table(spark, sf_dir, "part").count())
    return spark.createDataFrame([(bits, hashes)], "bits long, hashes int").select(F.lit(0.01).cast("decimal(3,2)").alias("error"), "bits", "hashes")


_BITS, _HASHES = 16_384, 5


def _sql_fnv(value: str, seed: int) -> str:
    bytes_ = ", ".join(f"(({value}) >> {8 * i}) & 255" for i in range(8))
    return f"list_reduce([{((C.FNV_OFFSET ^ seed) * C.FNV_PRIME) & (2**64 - 1)}::UBIGINT] || [x::UBIGINT for x in [{bytes_}]], lambda a, b: (xor(a, b)::UHUGEINT * {C.FNV_PRIME}::UHUGEINT % 18446744073709551616::UHUGEINT)::UBIGINT)"


_BLOOM = "f AS (SELECT DISTINCT unnest([" + ", ".join(f"({_sql_fnv('s_suppkey', i)} % {_BITS})::BIGINT" for i in range(_HASHES)) + "]) AS bit FROM supplier)"


def _filter(spark, sf_dir):
    return bloom.build(V.table(spark, sf_dir, "supplier"), "s_suppkey", _BITS, _HASHES)


@query(f"WITH {_BLOOM} SELECT bit FROM f")
def bloom_bits(spark, sf_dir):
    return _filter(spark, sf_dir)


@query(f"WITH {_BLOOM}, k AS (SELECT DISTINCT l_partkey FROM lineitem), a AS (SELECT l_partkey, unnest([" + ", ".join(f"({_sql_fnv('l_partkey', i)} % {_BITS})::BIGINT" for i in range(_HASHES)) + "]) AS bit FROM k) SELECT l_partkey, bool_and(bit IN (SELECT bit FROM f)) AS contained FROM a GROUP BY 1")
def bloom_membership(spark, sf_dir):
    keys = V.table(spark, sf_dir, "lineitem").select("l_partkey").distinct()
    return bloom.contains(keys, "l_partkey", _filter(spark, sf_dir), _BITS, _HASHES)


@query(f"WITH {_BLOOM} SELECT count(*) AS set_bits, round(count(*) / {_BITS}::DOUBLE, 6) AS fill, round(pow(count(*) / {_BITS}::DOUBLE, {_HASHES}), 9) AS false_positive_rate, round({_BITS}::DOUBLE / (SELECT count(*) FROM supplier), 6) AS bits_per_element FROM f")
def bloom_statistics(spark, sf_dir):
    return bloom.statistics(_filter(spark, sf_dir), _BITS, V.table(spark, sf_dir, "supplier").count(), _HASHES)


def _bits_sql(bits: list[str]) -> str:
    """Membership of the suppliers of lineitem by the given bits of a value {v}."""
    of = lambda v: "[" + ", ".join(f"({b.format(v=v)})::BIGINT" for b in bits) + "]"
    return f"WITH f AS (SELECT DISTINCT unnest({of('s_suppkey')}) AS bit FROM supplier), k AS (SELECT DISTINCT l_suppkey FROM lineitem), a AS (SELECT l_suppkey, unnest({of('l_suppkey')}) AS bit FROM k) SELECT l_suppkey, bool_and(bit IN (SELECT bit FROM f)) AS contained FROM a GROUP BY 1"


_BLOCK = f"({_sql_fnv('{v}', 0)} % {_BITS // 512}) * 512"


@query(_bits_sql([f"{_BLOCK} + {_sql_fnv('{v}', i + 1)} % 512" for i in range(_HASHES)]))
def bloom_blocked(spark, sf_dir):
    s, keys = V.table(spark, sf_dir, "supplier"), V.table(spark, sf_dir, "lineitem").select("l_suppkey").distinct()
    f = bloom.build(s, "s_suppkey", _BITS, _HASHES, bloom.blocked_positions)
    return bloom.contains(keys, "l_suppkey", f, _BITS, _HASHES, bloom.blocked_positions)


@query(_bits_sql([f"{_BLOCK} + (({_sql_fnv('{v}', 0)} >> {9 * i}) & 511)" for i in range(_HASHES)]))
def bloom_one_hash(spark, sf_dir):
    s, keys = V.table(spark, sf_dir, "supplier"), V.table(spark, sf_dir, "lineitem").select("l_suppkey").distinct()
    f = bloom.build(s, "s_suppkey", _BITS, _HASHES, bloom.one_hash_positions)
    return bloom.contains(keys, "l_suppkey", f, _BITS, _HASHES, bloom.one_hash_positions)


@query("WITH b AS (SELECT s_nationkey::BIGINT AS bin, unnest([" + ", ".join(f"({_sql_fnv('s_suppkey', i)} % {_BITS})::BIGINT" for i in range(_HASHES)) + "]) AS bit FROM supplier), w AS (SELECT bit, bit_or(1::BIGINT << bin) AS bins FROM b GROUP BY 1), k AS (SELECT DISTINCT s_suppkey FROM supplier), a AS (SELECT s_suppkey, unnest([" + ", ".join(f"({_sql_fnv('s_suppkey', i)} % {_BITS})::BIGINT" for i in range(_HASHES)) + "]) AS bit FROM k) SELECT s_suppkey, bit_and(coalesce(bins, 0)) AS bins FROM a LEFT JOIN w USING (bit) GROUP BY 1")
def bloom_interleaved(spark, sf_dir):
    s = V.table(spark, sf_dir, "supplier")
    words = bloom.interleaved(s, "s_suppkey", "s_nationkey", _BITS, _HASHES)
    return bloom.interleaved_membership(s, "s_suppkey", words, _BITS, _HASHES)


# Suffix tables.

_SUFFIXES = "x AS (SELECT item_id AS seq_id, i::INTEGER AS pos, substr(text, (i + 1)::INTEGER) AS suffix FROM (SELECT item_id, text, unnest(range(0, length(text))) AS i FROM benchmark)), o AS (SELECT row_number() OVER (ORDER BY suffix, seq_id, pos) - 1 AS rank, * FROM x)"


@query(f"WITH {_SUFFIXES} SELECT rank, seq_id, pos FROM o")
def suffix_array(spark, sf_dir):
    return suffixes.suffix_array(V.benchmark_text(spark, sf_dir))


_PREFIXES = f"WITH {_SUFFIXES}, p AS (SELECT rank, seq_id, pos, suffix AS a, lag(suffix) OVER (ORDER BY rank) AS b FROM o), c AS (SELECT rank, seq_id, pos, CASE WHEN b IS NULL THEN 0 ELSE coalesce(list_min(list_filter(range(1, least(length(a), length(b)) + 1), lambda i: substr(a, i::INTEGER, 1) <> substr(b, i::INTEGER, 1))) - 1, least(length(a), length(b))) END::INTEGER AS lcp FROM p)"


@query(f"{_PREFIXES} SELECT rank, seq_id, pos, lcp FROM c")
def suffix_common_prefixes(spark, sf_dir):
    return suffixes.common_prefixes(V.benchmark_text(spark, sf_dir))


@query(f"""{_PREFIXES}, e AS (SELECT rank, lcp FROM c UNION ALL SELECT count(*), -1 FROM c),
l AS (SELECT x.rank, any_value(x.lcp) AS lcp, max(y.rank) AS lower FROM c x LEFT JOIN e y ON y.rank < x.rank AND y.lcp < x.lcp WHERE x.lcp > 0 GROUP BY 1),
h AS (SELECT x.rank, min(y.rank) AS upper FROM c x JOIN e y ON y.rank > x.rank AND y.lcp < x.lcp WHERE x.lcp > 0 GROUP BY 1)
SELECT DISTINCT lcp::BIGINT AS lcp, lower::BIGINT AS left, (upper - 1)::BIGINT AS right FROM l JOIN h USING (rank)""")
def suffix_prefix_intervals(spark, sf_dir):
    return suffixes.prefix_intervals(suffixes.common_prefixes(V.benchmark_text(spark, sf_dir)))


@query("WITH q AS (SELECT DISTINCT lower(n_name) AS query FROM nation), k AS (SELECT query, unnest(range(0, length(query) + 1)) AS n FROM q), h AS (SELECT DISTINCT query, n FROM k JOIN benchmark ON n = 0 OR contains(text, left(query, n::INTEGER))) SELECT query, max(n)::INTEGER AS length FROM h GROUP BY 1")
def longest_prefix_lookup(spark, sf_dir):
    q = V.table(spark, sf_dir, "nation").select(F.lower("n_name").alias("query"))
    return suffixes.longest_prefixes(q, V.benchmark_text(spark, sf_dir))


# Top k, permutations, bits.


@query("WITH r AS (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders) SELECT o_custkey, o_orderkey, o_totalprice FROM r WHERE k <= 3")
def topk_per_group(spark, sf_dir):
    o = V.table(spark, sf_dir, "orders")
    w = Window.partitionBy("o_custkey").orderBy(F.col("o_totalprice").desc(), "o_orderkey")
    return o.withColumn("k", F.row_number().over(w)).where("k <= 3").select("o_custkey", "o_orderkey", "o_totalprice")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def topk_global(spark, sf_dir):
    return V.table(spark, sf_dir, "orders").orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(100).select("o_orderkey", "o_totalprice")


@query("WITH u AS (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings) SELECT vec_id, string_agg(i::VARCHAR, ',' ORDER BY x, i) AS permutation FROM u GROUP BY 1")
def permutation_sort(spark, sf_dir):
    e = V.table(spark, sf_dir, "embeddings")
    order = F.array_sort(F.transform("embedding", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    return e.select("vec_id", F.array_join(F.transform(order, lambda s: s["i"].cast("string")), ",").alias("permutation"))


@query("SELECT p_partkey, bit_count(p_partkey)::INTEGER AS ones, sum(bit_count(p_partkey)) OVER (ORDER BY p_partkey ROWS UNBOUNDED PRECEDING)::BIGINT AS rank, CASE WHEN p_partkey = 0 THEN '0' ELSE ltrim(bin(p_partkey), '0') END AS bits FROM part")
def bit_ranks(spark, sf_dir):
    """Bit counts and their running sum, by blocks of keys."""
    p = V.table(spark, sf_dir, "part").select("p_partkey", F.bit_count("p_partkey").alias("ones")).withColumn("block", F.floor(F.col("p_partkey") / 4096))
    inner = F.sum("ones").over(Window.partitionBy("block").orderBy("p_partkey").rowsBetween(Window.unboundedPreceding, 0))
    before = p.groupBy("block").agg(F.sum("ones").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("block", "before")
    return p.withColumn("inner", inner).join(before, "block").select("p_partkey", "ones", (F.col("inner") + F.col("before")).alias("rank"), F.bin("p_partkey").alias("bits"))


@query("WITH c AS (SELECT floor(l_quantity / 10)::BIGINT AS bucket, count(*) AS n FROM lineitem GROUP BY 1) SELECT bucket, n, (sum(n) OVER (ORDER BY bucket) - n)::BIGINT AS start FROM c")
def bucket_boundaries(spark, sf_dir):
    c = V.table(spark, sf_dir, "lineitem").groupBy(F.floor(F.col("l_quantity") / 10).alias("bucket")).agg(F.count("*").alias("n"))
    return c.withColumn("start", F.sum("n").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n"))


@query("SELECT DISTINCT l_partkey, l_suppkey FROM lineitem")
def without_duplicates(spark, sf_dir):
    return V.table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").distinct()


# Files.


def _file_round_trip(spark, sf_dir, kind: str) -> DataFrame:
    from strandlake.sources import records, sinks, tables

    path = tables.fresh_path(spark, kind)
    d = V.documents(spark, sf_dir).where(F.length("sequence") > 0)
    if kind == "fasta":
        sinks.write_fasta(d, path, width=70)
    else:
        sinks.write_fastq(d.withColumn("quality", F.repeat(F.lit("I"), F.length("sequence"))), path)
    records.register(spark)
    back = records.dense_ids(spark.read.format(kind).load(path))
    return back.select(F.col("seq_id"), "header", F.md5(F.col("sequence").cast("binary")).alias("sequence"), F.length("quality").alias("quality_length") if kind == "fastq" else F.length("sequence").alias("length"))


@query(f"WITH {V.SQL_DOCUMENTS} SELECT row_number() OVER (ORDER BY seq_id) - 1 AS seq_id, header, md5(sequence) AS sequence, length(sequence)::INTEGER AS length FROM s WHERE length(sequence) > 0")
def fasta_roundtrip(spark, sf_dir):
    return _file_round_trip(spark, sf_dir, "fasta")


@query(f"WITH {V.SQL_DOCUMENTS} SELECT row_number() OVER (ORDER BY seq_id) - 1 AS seq_id, header, md5(sequence) AS sequence, length(sequence)::INTEGER AS quality_length FROM s WHERE length(sequence) > 0")
def fastq_roundtrip(spark, sf_dir):
    return _file_round_trip(spark, sf_dir, "fastq")
