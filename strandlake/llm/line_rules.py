"""Quality rules on cross-document line frequency. DataFrame functions only.

Base rules look at one text. Then each line with a word is normalised (ASCII case
folded, runs of blanks made one, ends trimmed) and hashed, and the distinct
documents of a host (the source column) that hold it are counted. Two limits apply to
lines of more than a few documents: a share of the host's documents, and a number of
documents that doesn't grow with the host, as a line of a thousand documents is no text
of its own on the largest host either. Lines above a limit are removed, and documents
that lose too large a share of their words are rejected as depleted.

Only (host, hash) rows are shuffled, after a partial count on the map side: a line
in a third of all documents is one row a task. The table of lines above the limit
is broadcast if a count shows it is small, and joined by a shuffle otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

_BLANK = r"[\x20\x09-\x0D]+"


def base_counts(text: Column) -> dict[str, Column]:
    """Expressions over one text, for columns that hold no other evaluation of it."""
    words = F.regexp_extract_all(text, F.lit(f"({common.WORD})"), 1)
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(common.WORD))
    return {"words": words, "lines": lines}


def normal_line(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(line, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), _BLANK, " "))


def with_base(docs: DataFrame, window: int = 5, least_words: int = 10, most_repeated_percent: int = 20) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and
    base_failed added. Null texts count as empty."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    d = docs.withColumn("_text", text)
    made = base_counts(F.col("_text"))
    d = d.withColumn("_words", made["words"]).withColumn("_lines", made["lines"])
    # Hashes of the windows; get() is null past the end, so the last places are cut.
    hashes = F.slice(F.transform(F.col("_words"), lambda w, i: F.xxhash64(w, *[F.get("_words", i + k) for k in range(1, window)])), F.lit(1), F.greatest(F.size("_words") - (window - 1), F.lit(0)))
    d = d.withColumn("_hashes", hashes)
    d = d.withColumn("_some", F.size(F.array_distinct("_hashes")) < F.size("_hashes"))
    # Places of windows that occur twice: in hash order, equal to a neighbour.
    sorted_ = F.when(F.col("_some"), F.sort_array(F.transform(F.col("_hashes"), lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(F.expr("cast(array() as array<struct<h:bigint,i:int>>)"))
    d = d.withColumn("_sorted", sorted_)
    twice = F.filter(F.col("_sorted"), lambda x, i: (x["h"] == F.get("_sorted", i - 1)["h"]) | (x["h"] == F.get("_sorted", i + 1)["h"]))
    d = d.withColumn("_places", F.sort_array(F.transform(twice, lambda x: x["i"])))
    gap = F.transform(F.col("_places"), lambda p, i: F.least(F.lit(window), F.coalesce(F.get("_places", i + 1) - p, F.lit(window))))
    d = d.withColumn("n_words", F.size("_words").cast("long")).withColumn("word_chars", F.length(F.regexp_replace("_text", _BLANK, "")).cast("long"))
    d = d.withColumn("n_symbols", F.regexp_count(F.col("_text"), F.lit("[#*$%&|<>]")).cast("long"))
    d = d.withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
    d = d.withColumn("n_repeat_words", F.aggregate(gap, F.lit(0), lambda a, x: a + x).cast("long"))
    d = d.withColumn("base_failed", (F.col("n_words") < least_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * most_repeated_percent))
    return d.drop("_hashes", "_some", "_sorted", "_places", "_words", "_text")


def frequent_lines(docs: DataFrame, host: str = "source", most_percent: float = 10.0, most_docs: int = 1000, least_docs: int = 10) -> DataFrame:
    """(host, line): hashes of normalised lines that more than `most_percent` of a
    host's documents hold, or more than `most_docs` of them; in either case more than
    `least_docs`."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lines = docs.select(F.coalesce(F.concat(F.lit("s"), F.col(host).cast("string")), F.lit("")).alias("host"), F.array_distinct(line_hashes(text)).alias("lines"))
    held = lines.select("host", F.explode("lines").alias("line")).groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") > least_docs)
    hosts = lines.groupBy(F.col("host").alias("of")).agg(F.count("*").alias("docs"))
    return held.join(hosts, F.col("host") == F.col("of")).where((F.col("n") * 100.0 > F.col("docs") * most_percent) | (F.col("n") > most_docs)).select("host", "line")


def line_hashes(text: Column) -> Column:
    """A hash for each line with a word."""
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(common.WORD))
    return F.transform(lines, lambda x: F.xxhash64(normal_line(x)))


def judge(docs: DataFrame, host: str = "source", most_percent: float = 10.0, most_docs: int = 1000, least_docs: int = 10, depleted_percent: int = 50, broadcast_rows: int = 50_000) -> DataFrame:
    """One row per row of `docs` (doc_id, text, the host): _row (its input columns
    as a struct), the base counts, base_failed, n_removed_words, kept, and clean_text
    (the text without its removed lines; the text itself where none goes).

    A null host is a host of its own; a null or empty text has no words and fails. A very
    long text is judged whole: its lines and words are arrays in one row. Repeated rows
    count as documents each, and a document's own repeats of a line count once. Columns
    beside these come along in _row, whatever their names. An empty table gives no rows."""
    frequent = common.written(frequent_lines(docs, host, most_percent, most_docs, least_docs), "lines")
    by_host = frequent.groupBy(F.col("host").alias("_of")).agg(F.collect_list("line").alias("_frequent")) if frequent.count() <= broadcast_rows else None
    own = docs.select(F.struct(*docs.columns).alias("_row"), F.col("text").cast("string").alias("text"), F.coalesce(F.concat(F.lit("s"), F.col(host).cast("string")), F.lit("")).alias("_host"))
    if by_host is not None:
        d = with_base(own.join(F.broadcast(by_host), F.col("_host") == F.col("_of"), "left").drop("_of"))
        d = d.withColumn("_frequent", F.coalesce("_frequent", F.expr("cast(array() as array<bigint>)")))
    else:  # too many for a broadcast: a document's own frequent lines come by a join
        own = own.withColumn("_id", F.xxhash64("_row"))
        mine = own.select("_id", "_host", F.explode(F.array_distinct(line_hashes(F.coalesce(F.col("text"), F.lit(""))))).alias("line"))
        mine = mine.join(frequent.withColumnRenamed("line", "of"), (F.col("line") == F.col("of")) & (F.col("_host") == F.col("host"))).groupBy(F.col("_id").alias("_of")).agg(F.collect_set("line").alias("_frequent"))
        d = with_base(own.join(mine, F.col("_id") == F.col("_of"), "left").drop("_of", "_id"))
        d = d.withColumn("_frequent", F.coalesce("_frequent", F.expr("cast(array() as array<bigint>)")))
    # A filter on `kept` must not be pushed below these columns, where each would be
    # written out again at every use: a row number, not deterministic, holds it here.
    d = d.withColumn("_place", F.monotonically_increasing_id())
    gone = F.when(F.size("_frequent") == 0, F.expr("cast(array() as array<string>)")).otherwise(F.filter("_lines", lambda x: F.array_contains(F.col("_frequent"), F.xxhash64(normal_line(x)))))
    d = d.withColumn("_gone", gone)
    d = d.withColumn("n_removed_words", F.aggregate("_gone", F.lit(0), lambda a, x: a + F.regexp_count(x, F.lit(common.WORD))).cast("long"))
    d = d.withColumn("kept", ~F.col("base_failed") & (F.col("n_removed_words") * 100 <= F.col("n_words") * depleted_percent) & (F.col("_place") >= 0))
    d = d.withColumn("_gone", F.array_distinct("_gone"))
    rest = F.array_join(F.filter(F.split(F.col("text"), "\n", -1), lambda x: ~F.array_contains("_gone", x)), "\n")
    d = d.withColumn("clean_text", F.when(F.size("_gone") == 0, F.col("text")).otherwise(rest))
    return d.drop("_frequent", "_gone", "_lines", "_host", "_place", "text")


def op2_line_frequency_rules(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return judge(docs).select(F.col("_row.doc_id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_removed_words")


OP2_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce('s' || source, '') AS host, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
g AS (SELECT rid, i, array_to_string(words[i:i + 4], ' ') AS gram FROM (SELECT rid, words, unnest(range(1, len(words) - 3)) AS i FROM w WHERE len(words) >= 5)),
r AS (SELECT rid, i FROM (SELECT *, count(*) OVER (PARTITION BY rid, gram) AS n FROM g) WHERE n > 1),
c AS (SELECT rid, sum(least(5, coalesce(lead_i - i, 5))) AS n FROM (SELECT *, lead(i) OVER (PARTITION BY rid ORDER BY i) AS lead_i FROM r) GROUP BY rid),
l AS (SELECT rid, host, unnest(lines) AS line FROM w),
k AS (SELECT *, trim(regexp_replace(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS norm FROM l),
f AS (SELECT host, norm FROM (SELECT host, norm, count(DISTINCT rid) AS n FROM k GROUP BY ALL) JOIN (SELECT host, count(*) AS docs FROM d GROUP BY host) USING (host)
      WHERE n > 10 AND (n * 100.0 > docs * 10.0 OR n > 1000)),
x AS (SELECT k.rid, sum(len(regexp_extract_all(line, '[^\x20\x09-\x0D]+'))) AS n FROM k JOIN f USING (host, norm) GROUP BY k.rid),
s AS (SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
        CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
        CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(x.n, 0) AS BIGINT) AS n_removed_words
      FROM w LEFT JOIN c USING (rid) LEFT JOIN x USING (rid)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND n_removed_words * 100 <= n_words * 50 AS kept, n_removed_words
FROM b
"""
