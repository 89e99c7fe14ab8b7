"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

DataFrame functions only. Words of a document are its size. A source's target is
its share of all words, capped at a multiple of its size; the excess is reshared.

A document's place is a hash of its id in [0, 128 * 128): its block is the upper
part. Blocks are what a source is drawn in: full passes take every block, and the
last, partial pass takes whole places in hash order up to the remaining words; at
the place where they run out, documents are taken in order, the last one in part.
The running sums that needs run over a source's 128 blocks, over the 128 places of
one block, and over the documents of one place: never over a hot source.

Block slots (source, block, pass) are then dealt to output shards by a binary tree:
a node stands for a range of shards, and a seeded permutation of its slots sends as
many left as the shards on the left are due. That draws the sources' quotas on either
side from the multivariate hypergeometric law and keeps their sums exact. The leaf's
slots are disjoint permuted blocks: a document is taken once for each slot of its
block, in the slot's shard, where documents are ordered by a seeded hash.

Ranks in a permutation are counted by buckets of the permuting hash, so that a node,
the root included, is never one task's rows; targets are found by sums over all
sources, round by round, not in a window over them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlake.operators.stats import ranked

from . import common

_BLOCKS = 128  # blocks a source, and places a block
_WEIGHTS = (5.0, 2.0, 1.0)


def _number(text: Column) -> Column:
    """28 bits of a text's md5."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 7), 16, 10).cast("int")


def place(doc_id: Column, text: Column, seed: str) -> Column:
    """A number below 2**14 from id and seed; of a null id, from its text."""
    own = F.coalesce(doc_id.cast("string"), F.md5(F.coalesce(text, F.lit("")).cast("binary")))
    return _number(F.concat(own, F.lit("|"), F.lit(seed))) % F.lit(_BLOCKS * _BLOCKS)


def source_key(source: Column) -> Column:
    """A text for each source that is not null, so that a null source joins too."""
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit(""))


def source_targets(sizes: DataFrame, most: float = 3.0, weights: tuple = _WEIGHTS) -> DataFrame:
    """(source, weight, source_size, target) from (source, source_size). Resharing ends
    at a level t where each source gets min(most * size, t * weight). t rises from the
    plain share: a round caps the sources below it and shares the rest among the others,
    until none is capped anew. A round is one sum over the sources."""
    s = ranked(sizes.select("source", F.col("source_size").cast("long").alias("source_size")), F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    s = common.written(s.select("source", "source_size", w.alias("weight"), (F.col("source_size") * F.lit(most)).alias("cap")), "weights")
    total = float(s.agg(F.sum("source_size").alias("n")).first()["n"] or 0)
    level, ratio = -1.0, F.col("cap") / F.col("weight")
    while True:
        r = s.agg(F.sum(F.when(ratio < level, F.col("cap"))).alias("capped"), F.sum(F.when(ratio >= level, F.col("weight"))).alias("open")).first()
        if not r["open"] or (now := (total - (r["capped"] or 0.0)) / r["open"]) == level:
            break
        level = now
    share = F.lit(level) * F.col("weight")
    return s.select("source", "weight", "source_size", F.when(F.col("cap") <= share, F.col("cap")).otherwise(share).alias("target"))


def dealt(slots: DataFrame, shards: int, seed: str) -> DataFrame:
    """slots (key, block, pass) with the shard that the splitting tree gives each."""
    slots = slots.select("key", "block", "pass", F.lit(0).alias("low"), F.lit(shards).alias("width"))
    name = F.concat(F.col("key"), F.lit("|"), F.col("block").cast("string"), F.lit("|"), F.col("pass").cast("string"))
    for level in range(max(0, (shards - 1).bit_length())):
        s = slots.withColumn("u", _number(F.concat(F.lit(f"{seed}|{level}|"), name))).withColumn("bucket", F.shiftright("u", 14))
        counts = s.groupBy(F.col("low").alias("l"), F.col("bucket").alias("b")).agg(F.count("*").alias("n"))
        node = Window.partitionBy("l")
        counts = counts.select("l", "b", F.coalesce(F.sum("n").over(node.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("n").over(node).alias("all"))
        s = s.withColumn("r", F.row_number().over(Window.partitionBy("low", "bucket").orderBy("u", "key", "block", "pass"))).join(counts, (F.col("low") == F.col("l")) & (F.col("bucket") == F.col("b")))
        left = F.shiftright("width", 1)
        right = F.col("before") + F.col("r") > F.call_function("div", F.col("all") * left, F.col("width"))
        slots = s.select("key", "block", "pass", F.when(right, F.col("low") + left).otherwise(F.col("low")).alias("low"), F.when(right, F.col("width") - left).otherwise(left).alias("width"))
    return slots.select("key", "block", "pass", F.col("low").alias("shard"))


def mix(docs: DataFrame, shards: int = 8, most: float = 3.0, seed: str = "mix", broadcast_rows: int = 10_000) -> DataFrame:
    """One row per row of `docs` (doc_id, text, source): _row (the row's input
    columns as a struct), size, source_size, target, taken, and copies: an array of
    (pass, words, shard, shard_order), one for each slot that takes the document. The
    last copy may have fewer words than the document; taken is the sum of their words.

    Null and empty texts have size 0 and are never taken; a very long text is one
    document, cut only where its source runs out; null sources are one source, the last;
    a null id is placed by its text. Repeated rows are documents each: at the place where
    a source runs out they are taken by id, then text. Columns beside these three come
    along in _row, whatever their names. An empty table gives no rows. The table of
    blocks is broadcast only up to `broadcast_rows` rows."""
    text = F.col("text").cast("string")
    size = F.coalesce(F.regexp_count(text, F.lit(common.WORD)), F.lit(0)).cast("long")
    own = docs.select(F.struct(*docs.columns).alias("_row"), F.col("doc_id").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size"), place(F.col("doc_id"), text, seed).alias("place"), F.xxhash64(text).alias("tie"))
    places = common.written(own.groupBy("source", "place").agg(F.sum("size").alias("words")).withColumn("key", source_key(F.col("source"))), "places")
    blocks = places.groupBy("source", "key", F.shiftright("place", 7).alias("block")).agg(F.sum("words").alias("words"))
    targets = source_targets(blocks.groupBy("source").agg(F.sum("words").alias("source_size")), most)
    # Full passes, and what the partial pass must take.
    t = targets.withColumn("passes", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("int"))
    t = t.select(source_key(F.col("source")).alias("of"), "source_size", "target", "passes", F.round(F.col("target") - F.col("passes") * F.col("source_size")).cast("long").alias("part_words"))
    # The block, then the place, at which the partial pass runs out of words: running
    # sums over a source's 128 blocks, and over the 128 places of one block.
    run = lambda d, by: d.withColumn("upto", F.sum("words").over(Window.partitionBy("key").orderBy(by).rowsBetween(Window.unboundedPreceding, 0)))
    inner = run(blocks.join(t, F.col("key") == F.col("of")).drop("of"), "block")
    end_block = inner.groupBy("key").agg(
        *[F.first(c).alias(c) for c in ("source_size", "target", "passes", "part_words")],
        F.min(F.when(F.col("upto") > F.col("part_words"), F.struct("block", (F.col("upto") - F.col("words")).alias("before")))).alias("e"),
    )
    end_block = common.written(end_block.select(F.col("key").alias("of"), "source_size", "target", "passes", "part_words", F.col("e.block").alias("end_block"), F.coalesce("e.before", F.lit(0)).alias("before")), "targets")
    inside = places.join(end_block, (F.col("key") == F.col("of")) & (F.shiftright("place", 7) == F.col("end_block")))
    end = run(inside, "place").groupBy("key").agg(F.min(F.when(F.col("upto") + F.col("before") > F.col("part_words"), F.struct("place", (F.col("part_words") - F.col("before") - F.col("upto") + F.col("words")).alias("words")))).alias("e"))
    ends = end_block.join(end, F.col("key") == F.col("of"), "left").select(
        "of", "source_size", "target", "passes",
        F.coalesce("e.place", F.lit(_BLOCKS * _BLOCKS)).alias("end_place"), F.coalesce("e.words", F.lit(0)).alias("end_words"),
    )
    # Slots: a source's blocks, once for each pass, dealt to shards by the tree.
    top = F.when(F.col("end_words") > 0, F.shiftright("end_place", 7)).otherwise(F.shiftright(F.col("end_place") - 1, 7))
    known = common.written(blocks.select("key", "block").join(ends, F.col("key") == F.col("of")).drop("of"), "blocks")
    slots = known.select("key", "block", F.explode(F.sequence(F.lit(1), F.col("passes") + 1)).alias("pass"), "passes", top.alias("top")).where((F.col("pass") <= F.col("passes")) | (F.col("block") <= F.col("top")))
    tree = dealt(slots, shards, seed).groupBy(F.col("key").alias("k"), F.col("block").alias("b")).agg(F.sort_array(F.collect_list(F.struct("pass", "shard"))).alias("slots"))
    facts = common.written(known.join(tree, (F.col("key") == F.col("k")) & (F.col("block") == F.col("b")), "left").drop("k", "b"), "slots")
    # Documents meet their block's facts by source and block: a hot source is 128 keys.
    if facts.count() <= broadcast_rows:
        facts = F.broadcast(facts)
    facts = facts.select(F.col("key").alias("of"), F.col("block").alias("at"), "source_size", "target", "passes", "end_place", "end_words", "slots")
    joined = own.withColumn("key", source_key(F.col("source"))).join(facts, (F.col("key") == F.col("of")) & (F.shiftright("place", 7) == F.col("at")))
    # Only documents at the place where their source runs out need a running sum.
    edge = (F.col("place") == F.col("end_place")) & (F.col("end_words") > 0)
    before = Window.partitionBy("key").orderBy("doc_id", "tie", "size").rowsBetween(Window.unboundedPreceding, -1)
    at_edge = joined.where(edge).withColumn("more", F.greatest(F.lit(0), F.least(F.col("size"), F.col("end_words") - F.coalesce(F.sum("size").over(before), F.lit(0)))))
    others = joined.where(~edge).withColumn("more", F.when(F.col("place") < F.col("end_place"), F.col("size")).otherwise(F.lit(0)))
    copy = lambda s: F.struct(
        s["pass"].alias("pass"), F.when(s["pass"] <= F.col("passes"), F.col("size")).otherwise(F.col("more")).alias("words"),
        s["shard"].alias("shard"), F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("tie"), s["pass"]).alias("shard_order"),
    )
    drawn_slots = F.coalesce(F.col("slots"), F.expr("cast(array() as array<struct<pass:int,shard:int>>)"))
    plan = at_edge.unionByName(others).withColumn("copies", F.filter(F.transform(drawn_slots, copy), lambda c: c["words"] > 0))
    taken = F.aggregate("copies", F.lit(0).cast("long"), lambda a, c: a + c["words"])
    return plan.select("_row", "size", "source_size", "target", taken.alias("taken"), "copies")


def drawn(mixed: DataFrame, row_columns: list[str]) -> DataFrame:
    """The mix itself: a row for each copy, with its text cut to the copy's words; columns
    as in the input, then pass, shard and shard_order. Rows of a shard stand together, in
    its shuffled order, over as many partitions as the session has: a range-partitioned
    sort, so that few shards don't mean few tasks. Equal copies of repeated rows may take
    each other's place."""
    rows = mixed.select("_row", F.col("size").alias("_size"), F.explode("copies").alias("_copy"))
    words = F.regexp_extract_all(F.col("_row.text"), F.lit(r"([^\x20\x09-\x0D]+[\x20\x09-\x0D]*)"), 1)
    cut = F.array_join(F.slice(words, F.lit(1), F.col("_copy.words").cast("int")), "")
    text = F.when(F.col("_copy.words") == F.col("_size"), F.col("_row.text")).otherwise(cut)
    out = rows.select(*[text.alias(c) if c == "text" else F.col(f"_row.`{c}`").alias(c) for c in row_columns], F.col("_copy.pass").alias("pass"), F.col("_copy.shard").alias("shard"), F.col("_copy.shard_order").alias("shard_order"))
    return out.repartitionByRange("shard", "shard_order").sortWithinPartitions("shard", "shard_order")


def op7_source_mixing(spark, sf_dir: str) -> DataFrame:
    """The mix of all documents; shards lists the shards of a document's copies."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    shards = F.array_join(F.transform("copies", lambda c: c["shard"].cast("string")), ",")
    return mix(docs).select(F.col("_row.doc_id").alias("doc_id"), "size", "source_size", "target", "taken", shards.alias("shards"))


_TREE = "\n".join(f"""q{i} AS (SELECT *, CAST('0x' || substr(md5('mix|{i}|' || key || '|' || block || '|' || pass), 1, 7) AS INTEGER) AS u FROM t{i}),
r{i} AS (SELECT *, row_number() OVER (PARTITION BY low ORDER BY u, key, block, pass) > (count(*) OVER (PARTITION BY low)) * (width // 2) // width AS goes FROM q{i}),
t{i + 1} AS (SELECT key, block, pass, CASE WHEN goes THEN low + width // 2 ELSE low END AS low, CASE WHEN goes THEN width - width // 2 ELSE width // 2 END AS width FROM r{i}),""" for i in range(3))

OP7_SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, source, coalesce('s' || source, '') AS key, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), md5(coalesce(text, ''))) || '|mix'), 1, 7) AS INTEGER) % 16384 AS place
  FROM documents),
s AS (SELECT source, key, sum(size) AS source_size, [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight
      FROM d GROUP BY source, key),
c AS (SELECT *, source_size * 3.0::DOUBLE AS cap, (sum(source_size) OVER ())::DOUBLE AS total FROM s),
v AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
               / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM c),
f AS (SELECT *, max(CASE WHEN cap / weight >= level THEN level END) OVER () AS free FROM v),
t AS (SELECT key, source_size, CASE WHEN free IS NULL OR cap <= free * weight THEN cap ELSE free * weight END AS target FROM f),
p AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS passes FROM t),
o AS (SELECT d.*, place // 128 AS block, p.source_size, p.target, p.passes, CAST(round(p.target - p.passes * p.source_size) AS BIGINT) AS part_words,
             sum(size) OVER (PARTITION BY d.key ORDER BY place, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS before
      FROM d JOIN p ON d.key = p.key),
m AS (SELECT *, greatest(0, least(size, part_words - before)) AS more FROM o),
l AS (SELECT key, place, any_value(part_words) AS part_words, sum(size) AS words FROM o GROUP BY key, place),
n AS (SELECT *, sum(words) OVER (PARTITION BY key ORDER BY place) AS upto FROM l),
e AS (SELECT key, coalesce(min(place) FILTER (upto > part_words), 16384) AS end_place,
             coalesce(min_by(part_words - upto + words, place) FILTER (upto > part_words), 0) AS end_words FROM n GROUP BY key),
k AS (SELECT DISTINCT m.key, block, passes, CASE WHEN end_words > 0 THEN end_place // 128 WHEN end_place = 0 THEN -1 ELSE (end_place - 1) // 128 END AS top FROM m JOIN e ON m.key = e.key),
b AS (SELECT key, block, unnest(range(1, passes + 2)) AS pass, passes, top FROM k),
t0 AS (SELECT key, block, pass, 0 AS low, 8 AS width FROM b WHERE pass <= passes OR block <= top),
{_TREE}
x AS (SELECT m.rid, string_agg(CAST(low AS VARCHAR), ',' ORDER BY pass) AS shards
      FROM m JOIN t3 ON m.key = t3.key AND m.block = t3.block WHERE (CASE WHEN pass <= passes THEN size ELSE more END) > 0 GROUP BY m.rid)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(source_size AS BIGINT) AS source_size, target,
       CAST(passes * size + more AS BIGINT) AS taken, coalesce(shards, '') AS shards
FROM m LEFT JOIN x ON m.rid = x.rid
"""
