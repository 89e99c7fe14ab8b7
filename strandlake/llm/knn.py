"""Exact top-k by inner product as a Voronoi join.

Pivots are a bounded sample of the data, more of them for more data. Every vector goes
to the cell of its nearest pivot; a cell's summary is its count and radius. For a query
q the score of any vector x of cell c lies within q.p_c -/+ |q| r_c. The cells with the
best lower bounds that hold k vectors together give a threshold, and q is sent only to
cells whose upper bound reaches it. A cell is cut into blocks of bounded size, and the
queries that reach it into chunks; a block is replicated to the chunks of its own cell
only, and not at all where no query comes. So a cell with a third of all rows is many
tasks' work. Each block solves its chunk exactly in integers; partial top-k lists merge
by aggregation.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


#: Components beyond this are held at it, so that they stay whole numbers of 64 bits.
_LARGEST = float(1 << 62)


def quantised(vectors: DataFrame, scale: int = 1024) -> DataFrame:
    """(vec_id, v): components x as floor(scale * x). Rows whose vector or id is
    null, or that hold a null or non-finite component, take no part. Components beyond
    2**62 are held at it. Vectors may differ in length: see voronoi_top_k."""
    x = F.col("embedding").cast("array<double>")
    fine = F.forall(x, lambda y: y.isNotNull() & ~F.isnan(y) & (F.abs(y) < F.lit(float("inf"))))
    whole = lambda y: F.floor(F.greatest(F.lit(-_LARGEST), F.least(F.lit(_LARGEST), y * F.lit(float(scale))))).cast("long")
    return vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & fine).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, whole).alias("v"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column, with zeros after their ends."""
    lengths = pa.compute.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    values = column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), width), dtype=np.int64)
    out[np.arange(width) < lengths[:, None]] = values
    return out


def top_scores(queries: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Exact integer inner products: in doubles where no sum can pass 2**53, else in 64
    bits, else in integers of any size that are held at the ends of 64 bits."""
    if data.size == 0 or queries.size == 0:
        return np.zeros((len(queries), len(data)), dtype=np.int64)
    most = max(abs(int(queries.max())), abs(int(queries.min()))) * max(abs(int(data.max())), abs(int(data.min()))) * queries.shape[1]
    if most < 2**53:
        return (queries.astype(np.float64) @ data.astype(np.float64).T).astype(np.int64)
    if most < 2**63:
        return queries @ data.T
    exact = queries.astype(object) @ data.astype(object).T
    return np.clip(exact, -(2**63), 2**63 - 1).astype(np.int64)


def _centres(points: np.ndarray, pivots: int) -> np.ndarray:
    """At most `pivots` points, by a few steps of k-means."""
    points = np.unique(points, axis=0)
    if len(points) <= pivots:
        return points
    centres = points[np.random.default_rng(7).choice(len(points), pivots, replace=False)]
    for _ in range(4):
        near = np.concatenate([((part**2).sum(1)[:, None] - 2 * part @ centres.T + (centres**2).sum(1)).argmin(1) for part in np.array_split(points, -(-len(points) // 1024))])
        centres = np.array([points[near == c].mean(0) if (near == c).any() else centres[c] for c in range(len(centres))])
    return centres


def voronoi_top_k(data: DataFrame, queries: DataFrame, k: int = 10, most_pivots: int = 1024, block: int = 32_768, chunk: int = 32_768) -> DataFrame:
    """(query_id, rank, vec_id, score): for each id of `queries` (vec_id, v) the k best
    rows of `data` (vec_id, v) other than its own id; ties to the smaller id.

    Vectors of different lengths count as ended by zeros; an empty one scores 0. Of query
    rows that repeat an id, the least vector is the query; of data rows that repeat an id,
    each is a candidate. Scores beyond 64 bits are held at their ends. Other columns are
    ignored. Empty tables give no rows.

    There are about sqrt(rows) / 4 pivots, `most_pivots` at most, from the 8 rows a pivot
    of smallest hash: pivots steer the work and never change the result. A block's rows
    are sent once for `chunk` queries, and a query once for `block` rows."""
    spark = data.sparkSession
    data = data.select("vec_id", "v")
    facts = data.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width")).first()
    if not facts["n"]:
        return data.select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.lit(0).cast("long").alias("score")).where("false")
    asked_ids = queries.select("vec_id").distinct()
    own_rows = data.select("vec_id").join(asked_ids, "vec_id", "left_semi").groupBy(F.col("vec_id").alias("of")).agg(F.count("*").alias("own"))
    queries = queries.groupBy("vec_id").agg(F.min("v").alias("v")).join(own_rows, F.col("vec_id") == F.col("of"), "left")
    queries = common.written(queries.select("vec_id", "v", F.coalesce("own", F.lit(0)).alias("own")), "queries")
    width = max(facts["width"], queries.agg(F.max(F.size("v")).alias("w")).first()["w"] or 0, 1)
    pivots = min(most_pivots, max(16, int(facts["n"] ** 0.5 / 4)))
    sample = data.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(8 * pivots).select("v").collect()
    points = _centres(np.array([r["v"] + [0] * (width - len(r["v"])) for r in sample], dtype=np.float64), pivots)
    shared = spark.sparkContext.broadcast(points)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        for b in batches:
            for at in range(0, b.num_rows, 2048):
                part = b.slice(at, 2048)
                v = _matrix(part.column(1), width).astype(np.float64)
                cell = ((v**2).sum(1)[:, None] - 2 * v @ p.T + (p**2).sum(1)).argmin(1)
                radius = np.sqrt(((v - p[cell]) ** 2).sum(1))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(cell, pa.int32()), pa.array(radius, pa.float64())], names=["vec_id", "v", "cell", "away"])

    placed = common.written(data.mapInArrow(assign, "vec_id long, v array<long>, cell int, away double"), "cells")
    summary = placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("away").alias("r")).orderBy("cell").collect()  # a row per pivot at most
    cells, counts = np.array([r["cell"] for r in summary]), np.array([r["n"] for r in summary], dtype=np.int64)
    radii = np.array([r["r"] for r in summary]) * (1 + 1e-9) + 1e-6

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value[cells]
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                q = _matrix(part.column(1), width).astype(np.float64)
                middle = q @ p.T
                norm = np.sqrt((q**2).sum(1))[:, None]
                spread = norm * (radii * (1 + 1e-9) + 1e-12 * np.sqrt((p**2).sum(1))) + 1e-3
                low, high = middle - spread, middle + spread
                order = np.argsort(-low, axis=1)
                reach = np.cumsum(counts[order], axis=1) >= k + part.column(2).to_numpy()[:, None]  # beside rows of the query's id
                last = np.where(reach.any(1), reach.argmax(1), len(cells) - 1)
                floor = np.take_along_axis(low, order, 1)[np.arange(len(q)), last]
                floor = np.where(reach.any(1), floor, -np.inf)
                row, col = np.nonzero(high >= floor[:, None])
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), pa.array(cells[col], pa.int32())], names=["query_id", "cell"])

    reached = common.written(queries.mapInArrow(send, "query_id long, cell int"), "reached")
    asked_of = {r["cell"]: r["n"] for r in reached.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # a row per pivot at most
    size = {int(c): (int(-(-n // block)), int(-(-asked_of[c] // chunk))) for c, n in zip(cells, counts) if c in asked_of}
    if not size:
        return data.select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.lit(0).cast("long").alias("score")).where("false")
    plan = spark.createDataFrame([(c, *s) for c, s in size.items()], "of int, blocks int, chunks int")
    numbers = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    stored = placed.join(F.broadcast(plan), F.col("cell") == F.col("of")).select("vec_id", "v", "cell", F.pmod(F.xxhash64("vec_id", "v"), F.col("blocks")).cast("int").alias("part"), F.explode(numbers("chunks")).alias("chunk"))
    asked = reached.join(F.broadcast(plan), F.col("cell") == F.col("of")).select("query_id", "cell", F.pmod(F.xxhash64("query_id"), F.col("chunks")).cast("int").alias("chunk"), F.explode(numbers("blocks")).alias("part"))
    asked = asked.join(queries, F.col("query_id") == F.col("vec_id")).select("query_id", "v", "cell", "part", "chunk")

    def solve(own: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if own.empty or asked.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        own = own.sort_values("vec_id", kind="stable")
        ids, asked_ids = own["vec_id"].to_numpy(np.int64), asked["query_id"].to_numpy(np.int64)
        stack = lambda vectors: np.array([np.pad(v, (0, width - len(v))) for v in vectors], dtype=np.int64)
        theirs, out = stack(own["v"]), []
        step = max(1, (1 << 21) // len(own))
        for at in range(0, len(asked), step):
            scores = top_scores(stack(asked["v"].iloc[at : at + step]), theirs)
            for q, row in zip(asked_ids[at : at + step], scores):
                other = np.nonzero(ids != q)[0]
                mine = row[other]
                if len(mine) > k:
                    least = np.partition(mine, len(mine) - k)[len(mine) - k]
                    keep = np.nonzero(mine >= least)[0]
                    keep = keep[np.lexsort((ids[other[keep]], ~mine[keep]))][:k]
                else:
                    keep = np.arange(len(mine))
                out.append(pd.DataFrame({"query_id": q, "vec_id": ids[other[keep]], "score": mine[keep]}))
        return pd.concat(out)

    found = stored.groupBy("cell", "part", "chunk").cogroup(asked.groupBy("cell", "part", "chunk")).applyInPandas(solve, "query_id long, vec_id long, score long")
    # ~score falls as score rises, and can't overflow as -score may.
    first = F.slice(F.sort_array(F.collect_list(F.struct(F.bitwise_not("score").alias("s"), "vec_id"))), 1, k).alias("best")
    some = found.groupBy("query_id", F.pmod(F.xxhash64("vec_id"), F.lit(64)).alias("salt")).agg(first)  # no list of all blocks' rows in one place
    best = some.select("query_id", F.explode("best").alias("x")).select("query_id", F.bitwise_not("x.s").alias("score"), F.col("x.vec_id").alias("vec_id")).groupBy("query_id").agg(first)
    return best.select("query_id", F.posexplode("best").alias("at", "x")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.bitwise_not("x.s").alias("score"))


def op8_voronoi_knn(spark, sf_dir: str) -> DataFrame:
    """Queries: ids divisible by 100; candidates: every other row."""
    data = quantised(common.table(spark, sf_dir, "embeddings"))
    return voronoi_top_k(data, data.where(F.col("vec_id") % 100 == 0))


OP8_SQL = """
WITH d AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(greatest(-4611686018427387904.0::DOUBLE, least(4611686018427387904.0::DOUBLE, 1024 * CAST(x AS DOUBLE)))) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
q AS (SELECT vec_id, min(v) AS v FROM d WHERE vec_id % 100 = 0 GROUP BY vec_id),
s AS (SELECT q.vec_id AS query_id, d.vec_id,
        CAST(coalesce(list_sum(list_transform(range(1, least(len(q.v), len(d.v)) + 1), lambda i: q.v[i] * d.v[i])), 0) AS BIGINT) AS score
      FROM q JOIN d ON q.vec_id <> d.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
