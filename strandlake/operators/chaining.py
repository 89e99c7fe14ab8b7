"""Chains of collinear matches.

Groups are independent. Rows are dealt out by group and sorted, and a task streams over
its groups in Arrow batches, as a call of Python for each of very many small groups
would cost more than its work. Within a group a sweep over positions keeps the best
chain ends in a prefix-maximum tree, so a group of n matches takes n log n steps."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.operators.stats import ranked
from strandlake.sources.tables import written

_NONE = -(1 << 63)


def by_group(rows: DataFrame, keys: list[str], order: list[str], columns: list[str], schema: str, names: list[str], types: list, work: Callable[[tuple, list[np.ndarray]], list[tuple]]) -> DataFrame:
    """work(key, columns of the group) for each group of keys, in `order` within it;
    what it returns are rows of `schema`. A task holds one group at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None

        def solved(t: pa.Table) -> pa.RecordBatch:
            key = [t.column(i).to_pylist() for i in range(len(keys))]
            data = [t.column(len(keys) + i).to_numpy() for i in range(len(columns))]
            both = list(zip(*key))
            edges = [0, *(i for i in range(1, len(both)) if both[i] != both[i - 1]), len(both)]
            out = [r for a, b in zip(edges, edges[1:]) if b > a for r in work(both[a], [c[a:b] for c in data])]
            made = list(zip(*out)) or [()] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(made, types)], names=names)

        for b in batches:
            t = pa.Table.from_batches([b])
            t = t if rest is None else pa.concat_tables([rest, t])
            if not t.num_rows:
                continue
            k = [t.column(i).to_numpy() for i in range(len(keys))]
            cut = int(np.argmax(np.logical_and.reduce([x == x[-1] for x in k])))  # the last group may go on
            if cut:
                yield solved(t.slice(0, cut))
            rest = t.slice(cut)
        if rest is not None and rest.num_rows:
            yield solved(rest)

    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kept = rows.select(*keys, *[F.col(c) for c in columns])
    return kept.repartition(tasks, *keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)



class _PrefixBest:
    """Best (value, item) over prefixes of positions; the first inserted wins a tie."""

    def __init__(self, n: int):
        self.value, self.item = np.full(n + 1, -np.inf), np.full(n + 1, -1, dtype=np.int64)

    def put(self, at: int, value: float, item: int) -> None:
        at += 1
        while at < len(self.value):
            if value > self.value[at]:
                self.value[at], self.item[at] = value, item
            at += at & -at

    def best(self, below: int) -> tuple[float, int]:
        """Over positions < below."""
        value, item = -np.inf, -1
        while below > 0:
            if self.value[below] > value:
                value, item = float(self.value[below]), int(self.item[below])
            below -= below & -below
        return value, item


def _sweep(p_start, p_len, s_start, s_len, weight, local: bool, p_end0=(), s_end0=(), score0=()) -> tuple[np.ndarray, np.ndarray]:
    """(score, before) of chains that end in each match, after `0` items: ends of chains
    from before, with their scores. before is a place among these items and then the
    matches, -1 where a chain begins; scores are those of the items and then the matches."""
    k, n = len(score0), len(p_start)
    p_end, s_end = (np.concatenate([np.asarray(a, dtype=np.int64), start + size - 1]) for a, start, size in ((p_end0, p_start, p_len), (s_end0, s_start, s_len)))
    ends, column = np.unique(s_end, return_inverse=True)
    tree = _PrefixBest(len(ends))
    score, before = np.concatenate([np.asarray(score0, dtype=float), np.zeros(n)]), np.full(k + n, -1, dtype=np.int64)
    ends_order, closed = np.argsort(p_end, kind="stable"), 0
    for j in np.lexsort((s_start, p_start)).tolist():
        while closed < k + n and p_end[ends_order[closed]] < p_start[j]:
            i = int(ends_order[closed])
            # Gap from i to j is (p_start_j - p_end_i) + (s_start_j - s_end_i).
            tree.put(int(column[i]), score[i] + (p_end[i] + s_end[i] if local else 0), i)
            closed += 1
        value, i = tree.best(int(np.searchsorted(ends, s_start[j], side="left")))
        joined = value + weight[j] - (p_start[j] + s_start[j] if local else 0)
        if i >= 0 and joined > weight[j]:
            score[k + j], before[k + j] = joined, i
        else:
            score[k + j] = weight[j]
    return score, before


def best_chain(p_start, p_len, s_start, s_len, weight, local: bool) -> tuple[float, list[int]]:
    """(score, places of the matches) of a best chain: each match ends before the next
    starts on both sides. A global chain's score is the sum of weights; a local one
    pays the distance from end to start on both sides, and may start anywhere."""
    if not len(p_start):
        return 0.0, []
    score, before = _sweep(p_start, p_len, s_start, s_len, weight, local)
    top = int(np.argmax(score))
    chain = [top]
    while before[chain[-1]] >= 0:
        chain.append(int(before[chain[-1]]))
    return float(score[top]), chain[::-1]


def staircase(p_end: np.ndarray, s_end: np.ndarray, score: np.ndarray, local: bool) -> np.ndarray:
    """Places of the chain ends that any match behind all of them may join: of those that
    end no later on the second side, only one with a larger value is of use."""
    value = score + (p_end + s_end if local else 0)
    order = np.lexsort((p_end, -value, s_end))
    best = np.maximum.accumulate(value[order])
    return order[np.r_[True, best[1:] > best[:-1]]] if len(order) else order


def chains(matches: DataFrame, local: bool = False, slab: int = 1 << 20) -> DataFrame:
    """(group, score, length, matches) from (group, match_id, p_start, p_len, s_start,
    s_len, weight): one best chain of each group.

    A group of more than `slab` matches is gone through slab by slab of positions on the
    first side, each in a task of its own: what goes on to the next slab are the chain ends
    that are still open and the staircase of the others. Small groups are a task's by the
    group."""
    m = matches.select(F.col("group").cast("long").alias("group"), F.col("match_id").cast("long").alias("match_id"), *["p_start", "p_len", "s_start", "s_len", "weight"])
    m = written(m, "matches")
    huge = m.groupBy(F.col("group").alias("_of")).agg(F.count("*").alias("n")).where(F.col("n") > slab)  # fewer than matches / slab
    if not huge.limit(1).count():
        return _small_chains(m, local)
    of = F.col("group") == F.col("_of")
    small = m.join(F.broadcast(huge), of, "left_anti")
    return _small_chains(small, local).unionByName(_huge_chains(m.join(F.broadcast(huge.select("_of")), of, "left_semi"), local, slab))


def _small_chains(m: DataFrame, local: bool) -> DataFrame:
    def work(key: tuple, c: list[np.ndarray]) -> list[tuple]:
        score, places = best_chain(*c[1:], local)
        return [(key[0], score, len(places), c[0][places].tolist())]

    columns = ["match_id", "p_start", "p_len", "s_start", "s_len", "weight"]
    return by_group(m, ["group"], ["match_id"], columns, "group long, score double, length int, matches array<long>", ["group", "score", "length", "matches"], [pa.int64(), pa.float64(), pa.int32(), pa.list_(pa.int64())], work)


def _huge_chains(m: DataFrame, local: bool, slab: int) -> DataFrame:
    """chains() of groups that no task may hold. Rows of both passes: kind 0 is what the
    slab before handed on, kind 1 a match of the slab."""
    order = ["group", "p_start", "s_start", "match_id"]
    ranks = ranked(m, *order)
    first = ranks.groupBy(F.col("group").alias("_of")).agg(F.min("rank").alias("_first"))
    rows = ranks.join(F.broadcast(first), F.col("group") == F.col("_of")).withColumn("slab", F.floor((F.col("rank") - F.col("_first")) / slab)).drop("_of", "_first", "rank")
    starts = rows.groupBy(F.col("group").alias("_of"), (F.col("slab") - 1).alias("_slab")).agg(F.min("p_start").alias("until"))  # a row for each slab
    rows = written(rows.join(F.broadcast(starts), (F.col("group") == F.col("_of")) & (F.col("slab") == F.col("_slab")), "left").withColumn("until", F.coalesce("until", F.lit(-1)).cast("long")).drop("_of", "_slab"), "slabs")
    slabs = rows.agg(F.max("slab").alias("n")).first()["n"] + 1

    def forward(key: tuple, c: list[np.ndarray]) -> list[tuple]:
        kind, ids, a, b, s, t, w, until = c
        old, own = kind == 0, kind == 1
        if not own.any():
            return []
        k = int(old.sum())
        score, before = _sweep(a[own], b[own], s[own], t[own], w[own], local, a[old], s[old], w[old])
        p_end, s_end = np.r_[a[old], a[own] + b[own] - 1], np.r_[s[old], s[own] + t[own] - 1]
        every = np.r_[ids[old], ids[own]]
        out = [(key[0], 1, int(i), int(every[x]) if x >= 0 else None, int(p), 0, float(v)) for i, x, p, v in zip(ids[own], before[k:], a[own], score[k:])]
        end = int(until[own][0])
        if end >= 0:
            closed = np.flatnonzero(p_end < end)
            kept = np.r_[np.flatnonzero(p_end >= end), closed[staircase(p_end[closed], s_end[closed], score[closed], local)]]
            out += [(key[0], 0, int(every[x]), None, int(p_end[x]), int(s_end[x]), float(score[x])) for x in kept]
        return out

    names = ["group", "kind", "match_id", "before", "p", "s", "score"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64()]
    columns = ["kind", "match_id", "p_start", "p_len", "s_start", "s_len", "weight", "until"]
    zero = F.lit(0).cast("long")
    state, done = None, []
    for k in range(slabs):
        here = rows.where(F.col("slab") == k).withColumn("kind", F.lit(1).cast("long"))
        here = here.select("group", "kind", "match_id", *[F.col(x).cast("long").alias(x) for x in columns[2:6]], F.col("weight").cast("double").alias("weight"), "until")
        if state is not None:
            here = here.unionByName(state.select("group", "kind", "match_id", F.col("p").alias("p_start"), zero.alias("p_len"), F.col("s").alias("s_start"), zero.alias("s_len"), F.col("score").alias("weight"), zero.alias("until")))
        out = written(by_group(here, ["group"], ["kind", "match_id"], columns, "group long, kind long, match_id long, before long, p long, s long, score double", names, types, forward), "chains")
        state = out.where("kind = 0")
        done.append(out.where("kind = 1"))

    def back(key: tuple, c: list[np.ndarray]) -> list[tuple]:
        kind, ids, before, p = c
        if not (kind == 0).any():
            return []
        at, out = int(ids[kind == 0][0]), []
        place = {int(i): x for x, i in enumerate(ids) if kind[x] == 1}
        while at in place:
            x = place[at]
            out.append((key[0], 1, at, int(p[x])))
            at = int(before[x])
        return out if at == _NONE else [*out, (key[0], 0, at, 0)]

    tops = [d.groupBy("group").agg(F.max(F.struct("score", (-F.col("match_id")).alias("id"))).alias("t")).select("group", "t.score", (-F.col("t.id")).alias("match_id")) for d in done]
    best = tops[0]
    for t in tops[1:]:
        best = best.unionByName(t)
    best = written(best.groupBy("group").agg(F.max(F.struct("score", (-F.col("match_id")).alias("id"))).alias("t")).select("group", "t.score", (-F.col("t.id")).alias("match_id")), "best")
    now, members = best.select("group", "match_id"), []
    for d in reversed(done):
        both = d.select("group", "kind", "match_id", F.coalesce("before", F.lit(_NONE)).alias("before"), "p").unionByName(now.select("group", zero.alias("kind"), "match_id", F.lit(_NONE).alias("before"), zero.alias("p")))
        out = written(by_group(both, ["group"], ["kind", "match_id"], ["kind", "match_id", "before", "p"], "group long, kind long, match_id long, p long", ["group", "kind", "match_id", "p"], types[:4], back), "members")
        now = out.where("kind = 0").select("group", "match_id")
        members.append(out.where("kind = 1"))
    every = members[0]
    for x in members[1:]:
        every = every.unionByName(x)
    chain = every.groupBy(F.col("group").alias("_of")).agg(F.array_sort(F.collect_list(F.struct("p", "match_id"))).alias("c"))
    return best.join(chain, F.col("group") == F.col("_of")).select("group", "score", F.size("c").alias("length"), F.col("c.match_id").alias("matches"))


def segment_chains(starts, query_starts, lengths, max_previous: int) -> list[tuple[float, list[int]]]:
    """All chains of one segment of exact matches in order of reference start. A match
    looks back over `max_previous` others; a step costs half the sum of both gaps and
    needs gaps that differ by under 100, or by 30 % of the larger. Scores are computed
    upwards and downwards and the direction of larger total is taken. Chains are then
    read off by descending score of their ends, and don't share matches."""
    n = len(starts)
    ends, query_ends = starts + lengths - 1, query_starts + lengths - 1

    def scored(up: bool) -> tuple[np.ndarray, np.ndarray]:
        score, before = lengths.astype(np.int64).copy(), np.arange(n)
        for j in range(n) if up else range(n - 1, -1, -1):
            near = range(j - 1, max(-1, j - max_previous - 1), -1) if up else range(j + 1, min(n, j + max_previous + 1))
            for i in near:
                a, b = (i, j) if up else (j, i)
                r, q = starts[b] - ends[a], query_starts[b] - query_ends[a]
                if r <= 0 or q <= 0:
                    continue
                differ = abs(r - q)
                if differ >= 100 and differ / max(r, q) > 0.3:
                    continue
                value = score[i] + lengths[j] - (r + q) // 2
                if value > score[j]:
                    score[j], before[j] = value, i
        return score, before

    up, down = scored(True), scored(False)
    is_up = up[0].sum() >= down[0].sum()
    score, before = up if is_up else down
    inner = {int(before[i]) for i in range(n) if before[i] != i}
    out, used = [], np.zeros(n, dtype=bool)
    for end in sorted((i for i in range(n) if i not in inner), key=lambda i: (-score[i], i)):
        chain, at = [], end
        while not used[at]:
            chain.append(at)
            used[at] = True
            if before[at] == at:
                break
            at = int(before[at])
        if chain:
            whole = not (used[before[chain[-1]]] and before[chain[-1]] not in chain)
            value = score[end] if whole else score[end] - score[before[chain[-1]]]
            out.append((float(value), chain[::-1] if is_up else chain))
    return out


def local_chains(mems: DataFrame, max_previous: int = 20) -> DataFrame:
    """(ref_id, query_id, chain, score, length, ref_start, ref_end, query_start,
    query_end) from maximal matches (ref_id, query_id, ref_end, query_end, length)."""

    names = "ref_id query_id chain score length ref_start ref_end query_start query_end".split()

    def work(key: tuple, c: list[np.ndarray]) -> list[tuple]:
        ends, query_ends, lengths = c[0], c[1], c[2]
        starts, query_starts = ends - lengths + 1, query_ends - lengths + 1
        order = np.lexsort((lengths, query_starts, starts))
        starts, query_starts, lengths, ends, query_ends = (x[order] for x in (starts, query_starts, lengths, ends, query_ends))
        found = segment_chains(starts, query_starts, lengths, max_previous)
        return [(*key, k, score, len(x), int(starts[x].min()), int(ends[x].max()), int(query_starts[x].min()), int(query_ends[x].max())) for k, (score, x) in enumerate(found)]

    types = [pa.int64(), pa.int64(), pa.int32(), pa.float64(), pa.int32(), *[pa.int64()] * 4]
    schema = "ref_id long, query_id long, chain int, score double, length int, ref_start long, ref_end long, query_start long, query_end long"
    return by_group(mems, ["ref_id", "query_id"], ["ref_end", "query_end"], ["ref_end", "query_end", "length"], schema, names, types, work)
