"""A corpus from documents to packed training sequences, in five stages.

Each stage reads what the one before has kept, as Parquet in the shared folder.
All but the last return the columns of documents (extra columns of the input go
along, whatever their names); where a stage changes a text, n_chars follows it. Texts of
any length are handled whole, nulls may stand in any column, and an empty table stays
empty in every stage; what becomes of nulls, empty texts, ties and repeated rows is said
at each stage."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandlake.llm import common, jaccard, line_rules, mixing, packing, repeats


def _columns(df: DataFrame, docs: DataFrame, text) -> DataFrame:
    """The columns of docs from df._row, with another text and its length."""
    made = {"text": text, "n_chars": F.length(text).cast(dict(docs.dtypes).get("n_chars", "bigint"))}
    return df.select(*[made.get(c, F.col(f"_row.`{c}`")).alias(c) for c in docs.columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go, and lines above the limits from those kept. Null and empty
    texts have too few words and go. A null source is a source of its own; a null id
    matters nothing. Repeated rows are judged each, and count as documents each."""
    judged = line_rules.judge(docs).where("kept")
    return _columns(judged, docs, F.col("clean_text"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that link from 80 percent of equal five-word shingles
    on, the row of the smallest id stays; where rows repeat that id, the one of the least
    text hash, and of equal rows one. Decisions are by row: rows of one id that are in
    different groups are kept or dropped each by its own. Rows without an id and texts
    without a word (null and empty ones too) link with nothing and stay, repeated or not."""
    found = jaccard.jaccard_join(docs, n=5, percent=80)
    drop = found.where(~F.col("is_first")).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_text")).distinct()
    marked = docs.withColumn("_hash", F.xxhash64(F.col("text").cast("string")))
    rest = marked.join(drop, (F.col("doc_id").cast("long") == F.col("_id")) & (F.col("_hash") == F.col("_text")), "left_anti")
    able = F.col("doc_id").isNotNull() & F.coalesce(F.col("text").cast("string").rlike(common.WORD), F.lit(False))
    again = F.row_number().over(Window.partitionBy("doc_id", "_hash").orderBy(F.lit(0)))
    one = rest.where(able).withColumn("_at", again).where("_at = 1").select(docs.columns)
    return one.unionByName(rest.where(~able).select(docs.columns))


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Long repeated strings are cut out, of repeated rows too. Where a cut divides a
    character, the bytes left of it go too. Documents without a word left, or without one
    from the start (null and empty texts), go. Other columns may hold nulls."""
    cut = repeats.repeat_dedup(docs, carry=tuple(c for c in docs.columns if c != "text"))
    text = F.make_valid_utf8(F.col("kept").cast("string"))
    text = F.when(F.col("n_removed") > 0, F.regexp_replace(text, "\ufffd", "")).otherwise(text)
    done = cut.select("row", text.alias("_text")).where(F.col("_text").rlike(common.WORD))
    made = {"text": F.col("_text"), "n_chars": F.length("_text").cast(dict(docs.dtypes).get("n_chars", "bigint"))}
    return done.select(*[made.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time that the mix takes a document, with the words it takes. Null
    and empty texts have none and go. A null source is a source of its own, a null id is
    placed by its text, and repeated rows are documents each; where a source runs out
    among equal ids and texts, equal rows may take each other's place."""
    mixed = mixing.drawn(mixing.mix(docs), docs.columns)
    return _columns(mixed.select(F.struct(*docs.columns).alias("_row"), F.col("text").alias("_text")), docs, F.col("_text"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces in sequences of 2048 ids. Null and empty texts are their closing id, repeated
    rows are packed each, a null id stays null; other columns are ignored."""
    path = public_tokenizers.path
    return packing.pack_documents(docs, path("byte_bpe_50k.tiktoken"), added=path("byte_bpe_50k.json"))


STAGES = [
    ("line_frequency_rules", quality_rules),
    ("trie_jaccard", near_duplicates),
    ("bwt_repeats", repeated_strings),
    ("source_mixing", source_mix),
    ("min_bin_slack_packing", packed),
]

#: Suffix and subset-sum steps can't be stated in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
