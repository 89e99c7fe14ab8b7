"""The tables that the queries read: a sequence view of texts, the same in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LETTERS = "abcdefghijklmnopqrstuvwxyz\n"
BASES = "ACGTACGTACGTACGTACGTACGTACN"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Deal rows out to all cores if the scan has no more parts than there are cores: a
    part of so small a table is less than a row group of a file, and parts without the
    start of a row group are empty. Larger tables stay as they are scanned, unshuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 1 < cores and df.rdd.getNumPartitions() <= cores else df


def as_dna(text: Column) -> Column:
    return F.translate(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z\n]", ""), LETTERS, BASES)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq_id, header, sequence): letters by their place in the alphabet modulo 4 as
    A, C, G, T; line ends as N; all else left out."""
    header = F.concat_ws("|", "source", F.col("doc_id").cast("string"), "lang")
    raw = spread(table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text"))
    return raw.select(F.col("doc_id").alias("seq_id"), header.alias("header"), as_dna(F.col("text")).alias("sequence"))


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "benchmark").select("item_id", "text")).select(F.col("item_id").alias("seq_id"), F.col("item_id").cast("string").alias("header"), as_dna(F.col("text")).alias("sequence"))


def benchmark_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("seq_id"), F.coalesce("text", F.lit("")).alias("sequence"))


def benchmark_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole benchmark texts as protein sequences: their letters, in upper case."""
    letters = F.upper(F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z]", ""))
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("seq_id"), F.col("item_id").cast("string").alias("header"), letters.alias("sequence"))


def nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("seq_id"), F.col("n_name").alias("header"), F.upper(F.regexp_replace("n_name", "[^A-Za-z]", "")).alias("sequence"))


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("seq_id"), F.col("p_name").alias("header"), as_dna(F.col("p_name")).alias("sequence"))


def _sql_dna(text: str) -> str:
    return f"translate(regexp_replace(lower(coalesce({text}, '')), '[^a-z\n]', '', 'g'), '{LETTERS}', '{BASES}')"


SQL_DOCUMENTS = f"s AS (SELECT doc_id AS seq_id, concat_ws('|', source, doc_id::VARCHAR, lang) AS header, {_sql_dna('text')} AS sequence FROM documents)"
SQL_BENCHMARK = f"b AS (SELECT item_id AS seq_id, {_sql_dna('text')} AS sequence FROM benchmark)"
SQL_BENCHMARK_LETTERS = "s AS (SELECT item_id AS seq_id, upper(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g')) AS sequence FROM benchmark)"
SQL_NATIONS = "s AS (SELECT n_nationkey::BIGINT AS seq_id, n_name AS header, upper(regexp_replace(n_name, '[^A-Za-z]', '', 'g')) AS sequence FROM nation)"
SQL_PARTS = f"s AS (SELECT p_partkey AS seq_id, {_sql_dna('p_name')} AS sequence FROM part)"


def sql_ranges(name: str = "r", of: str = "s", inside: str = "[ACGTUacgtu]", least: int = 1, invert: bool = False) -> str:
    """CTE (seq_id, range_no, start, len, run)."""
    outside = "[^" + inside[1:] if not inside.startswith("[^") else "[" + inside[2:]
    taken = outside if invert else inside
    return f"""{name}_p AS (SELECT seq_id, regexp_extract_all(sequence, '{inside}+|{outside}+') AS parts FROM {of}),
{name}_u AS (SELECT seq_id, unnest(parts) AS run, generate_subscripts(parts, 1) AS i FROM {name}_p),
{name}_o AS (SELECT seq_id, run, length(run) AS len, sum(length(run)) OVER (PARTITION BY seq_id ORDER BY i) - length(run) AS start FROM {name}_u),
{name} AS (SELECT seq_id, (row_number() OVER (PARTITION BY seq_id ORDER BY start) - 1)::INTEGER AS range_no, start::INTEGER AS start, len::INTEGER AS len, run
  FROM {name}_o WHERE regexp_matches(run, '^{taken}') AND len >= {least})"""


def sql_qgrams(q: int, name: str = "g", of: str = "r") -> str:
    """CTE (seq_id, range_start, pos, qgram) over ranges."""
    return f"{name}_i AS (SELECT seq_id, start, run, unnest(range(0, len - {q} + 1)) AS i FROM {of} WHERE len >= {q}),\n{name} AS (SELECT seq_id, start::BIGINT AS range_start, (start + i)::BIGINT AS pos, translate(upper(substr(run, (i + 1)::INTEGER, {q})), 'U', 'T') AS qgram FROM {name}_i)"


def sql_code(qgram: str, q: int, reverse: bool = False) -> str:
    """Integer code of a q-gram; of its reverse complement."""
    digit = lambda i: f"(instr('{'TGCA' if reverse else 'ACGT'}', substr({qgram}, {i + 1}, 1)) - 1)::BIGINT"
    return " + ".join(f"{digit(i)} * {4 ** (i if reverse else q - 1 - i)}" for i in range(q))


def sql_hash(qgram: str, q: int, reverse: bool = False) -> str:
    """Rolling hash as UBIGINT."""
    from strandlake.functions.codes import seed_table

    total = ""
    for i, row in enumerate(seed_table(q)):
        place = f"substr({qgram}, {q - i if reverse else i + 1}, 1)"
        one = f"[{', '.join(f'{x}::UBIGINT' for x in row)}][instr('{'TGCA' if reverse else 'ACGT'}', {place})]"
        total = one if not total else f"xor({total}, {one})"
    return total
