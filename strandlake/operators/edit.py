"""Edit distances and approximate pattern matching."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def distances(pairs: DataFrame, most: int | None = None) -> DataFrame:
    """pairs (.., left, right) with their unit edit distance; -1 beyond `most`."""
    return pairs.withColumn("distance", F.levenshtein("left", "right") if most is None else F.levenshtein("left", "right", most))


def _table(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Unit edit distances of all prefixes."""
    m, n = len(a), len(b)
    place = np.arange(n + 1, dtype=np.int32)
    d = np.empty((m + 1, n + 1), dtype=np.int32)
    d[0] = place
    for i in range(1, m + 1):
        now = d[i - 1] + 1
        np.minimum(now[1:], d[i - 1, :-1] + (b != a[i - 1]), out=now[1:])
        d[i] = np.minimum.accumulate(now - place) + place
    return d


def script_graph(a: str, b: str) -> tuple[int, int, np.ndarray, np.ndarray, np.ndarray]:
    """(distance, number of best edit scripts, i, j, steps): the graph of all of them. A
    place (i, j), prefixes of a and b, is there if a best script passes it, in order of i
    and j; steps has bit 1 for D from (i - 1, j), 2 for I from (i, j - 1), 4 for = or X."""
    x, y = (np.frombuffer(t.encode("utf-32-le", "surrogatepass"), dtype=np.uint32) for t in (a, b))
    d = _table(x, y)
    rest = _table(x[::-1], y[::-1])[::-1, ::-1]
    least = int(d[-1, -1])
    steps = np.zeros(d.shape, dtype=np.int8)
    steps[1:] |= (d[1:] == d[:-1] + 1).astype(np.int8)
    steps[:, 1:] |= (d[:, 1:] == d[:, :-1] + 1).astype(np.int8) << 1
    steps[1:, 1:] |= (d[1:, 1:] == d[:-1, :-1] + (x[:, None] != y)).astype(np.int8) << 2
    i, j = np.nonzero(d + rest == least)
    steps = steps[i, j]
    counts = {(0, 0): 1}
    for u, v, s in zip(i.tolist(), j.tolist(), steps.tolist()):
        if s:
            counts[u, v] = (counts[u - 1, v] if s & 1 else 0) + (counts[u, v - 1] if s & 2 else 0) + (counts[u - 1, v - 1] if s & 4 else 0)
    return least, counts[len(x), len(y)], i.astype(np.int32), j.astype(np.int32), steps


def each_script(a: str, b: str) -> Iterator[str]:
    """All best edit scripts as CIGAR strings, one at a time."""
    import itertools

    _, _, us, vs, steps = script_graph(a, b)
    at = dict(zip(zip(us.tolist(), vs.tolist()), steps.tolist()))
    stack = [(len(a), len(b), "")]
    while stack:
        i, j, tail = stack.pop()
        if not i and not j:
            yield "".join(f"{len(list(g))}{c}" for c, g in itertools.groupby(tail))
            continue
        s = at[i, j]
        if s & 1:
            stack.append((i - 1, j, "D" + tail))
        if s & 2:
            stack.append((i, j - 1, "I" + tail))
        if s & 4:
            stack.append((i - 1, j - 1, ("=" if a[i - 1] == b[j - 1] else "X") + tail))


def scripts(a: str, b: str) -> tuple[int, list[str]]:
    """(distance, all best edit scripts as CIGAR strings, sorted). Their number grows
    exponentially: script_graph() holds those of long pairs."""
    return script_graph(a, b)[0], sorted(each_script(a, b))


def all_scripts(pairs: DataFrame) -> DataFrame:
    """pairs (id, left, right) with distance, the exact number of best scripts (in
    decimal, as it may pass any integer type) and the graph that holds all of them
    (arrays i, j, steps; see script_graph). Nulls are empty."""
    names = ["id", "distance", "n_scripts", "i", "j", "steps"]
    types = (pa.int64(), pa.int32(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int8()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

        for b in batches:
            for key, x, y in zip(*(b.column(k).to_pylist() for k in range(3))):
                least, n, i, j, steps = script_graph(x or "", y or "")
                rows.append((key, least, int_text(n), i, j, steps))
                size += len(i)
                if size > 1 << 19:
                    yield batch_of(rows)
                    rows, size = [], 0
        if rows:
            yield batch_of(rows)

    return pairs.select(F.col("id").cast("long").alias("id"), "left", "right").mapInArrow(run, "id long, distance int, n_scripts string, i array<int>, j array<int>, steps array<tinyint>")


def int_text(n: int) -> str:
    """Decimal digits of any integer from 0 on; str() stops at 4,300 of them."""
    parts, base = [], 10**4000
    while n >= base:
        n, part = divmod(n, base)
        parts.append(f"{part:04000d}")
    return str(n) + "".join(reversed(parts))


#: Characters of a lane, and words of pattern bits that one array operation takes.
_LANE, _WORDS = 256, 1 << 14
_PAUSE = 0x110000  # matches nothing, and stands between texts


def batch_counts(texts: list[str], patterns: list[str], most: int) -> list[int]:
    """For each pattern the ends in the texts at which it matches with at most `most`
    edits. A pattern's column of the table of distances is a machine word of vertical
    differences, advanced by a character with a few word operations; texts are cut into
    lanes that start as many characters early as a match can have, and all lanes of many
    patterns advance together. Between two texts stand so many characters that match
    nothing that no match passes them."""
    if any(not 0 < len(p) <= 64 for p in patterns):
        raise ValueError("a pattern has 1 to 64 characters")
    if any(most > len(p) // 2 for p in patterns):
        raise ValueError("at most half of a pattern's characters may differ")
    longest = max(map(len, patterns), default=0)
    early, pause = longest + most, np.full(longest, _PAUSE, dtype=np.uint32)
    codes = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), dtype=np.uint32) for t in texts]
    joined = np.concatenate([x for c in codes for x in (c, pause)] or [pause])
    letters, number = np.unique(joined, return_inverse=True)
    lanes = -(-len(joined) // _LANE)
    padded = np.full(early + lanes * _LANE, np.searchsorted(letters, _PAUSE))
    padded[early : early + len(joined)] = number
    columns = np.ascontiguousarray(np.stack([padded[t : t + lanes * _LANE : _LANE][:lanes] for t in range(early + _LANE)])) if lanes else np.zeros((0, 0), dtype=np.int64)
    at_text = letters[columns] != _PAUSE
    one, out, step = np.uint64(1), [], max(1, _WORDS // max(1, lanes))
    for first in range(0, len(patterns), step):
        some = patterns[first : first + step]
        equal = np.zeros((len(some), len(letters)), dtype=np.uint64)
        for i, p in enumerate(some):
            for j, c in enumerate(p):
                k = int(np.searchsorted(letters, ord(c)))
                if k < len(letters) and letters[k] == ord(c):
                    equal[i, k] |= one << np.uint64(j)
        size = np.array([len(p) for p in some], dtype=np.int16)[:, None]
        top = (size - 1).astype(np.uint64)
        up, down = np.full((len(some), lanes), ~np.uint64(0)), np.zeros((len(some), lanes), dtype=np.uint64)
        distance = np.repeat(size, lanes, axis=1)
        hits = np.zeros(len(some), dtype=np.int64)
        for t, column in enumerate(columns):
            eq = equal[:, column]
            level = (((eq & up) + up) ^ up) | eq
            rise, fall = down | ~(level | up), up & level
            distance += (rise >> top & one).astype(np.int16)
            distance -= (fall >> top & one).astype(np.int16)
            rise, fall, steep = rise << one, fall << one, eq | down
            up, down = fall | ~(steep | rise), rise & steep
            if t >= early:
                hits += ((distance <= most) & at_text[t]).sum(axis=1)
        out += hits.tolist()
    return out


def batch_hits(texts: list[str], pattern: str, most: int) -> int:
    """batch_counts() of one pattern."""
    return batch_counts(texts, [pattern], most)[0]


def pattern_hits(text: str, pattern: str, most: int) -> int:
    """batch_hits() of one text."""
    return batch_hits([text], pattern, most)


def pattern_counts(texts: DataFrame, patterns: DataFrame, most: int, at_once: int = 10_000) -> DataFrame:
    """(pattern, hits) over all texts (sequence), for each distinct pattern. Patterns go
    out in lists of at most `at_once`, each of which reads the texts once."""
    listed = sorted({r["pattern"] for r in patterns.select("pattern").distinct().toLocalIterator()})

    def counted(some: list[str]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = dict.fromkeys(some, 0)
            for b in batches:
                held: list[str] = []
                for text in [*b.column(0).to_pylist(), None]:
                    if text:
                        held.append(text)
                    if held and (text is None or sum(map(len, held[-1:])) > 1 << 20 or len(held) >= 256):
                        for p, n in zip(some, batch_counts(held, some, most)):
                            sums[p] += n
                        held = []
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array(list(sums.values()), pa.int64())], names=["pattern", "hits"])

        return texts.select("sequence").mapInArrow(run, "pattern string, hits long").groupBy("pattern").agg(F.sum("hits").alias("hits"))

    out = counted(listed[:at_once])
    for i in range(at_once, len(listed), at_once):
        out = out.unionByName(counted(listed[i : i + at_once]))
    return out


def closed_gaps(matches: DataFrame, first: DataFrame, second: DataFrame) -> DataFrame:
    """(group, edits): the edits in the gaps between neighbours of a chain, from its
    matches (group, ordinal, p_start, p_len, s_start, s_len, p_id, s_id)."""
    from pyspark.sql import Window

    w = Window.partitionBy("group").orderBy("ordinal")
    g = matches.withColumn("_p", F.lag(F.col("p_start") + F.col("p_len")).over(w)).withColumn("_s", F.lag(F.col("s_start") + F.col("s_len")).over(w)).where("_p IS NOT NULL")
    g = g.join(first.select(F.col("seq_id").alias("p_id"), F.col("sequence").alias("_u")), "p_id").join(second.select(F.col("seq_id").alias("s_id"), F.col("sequence").alias("_v")), "s_id")
    gap = F.levenshtein(F.substr("_u", F.col("_p") + 1, F.col("p_start") - F.col("_p")), F.substr("_v", F.col("_s") + 1, F.col("s_start") - F.col("_s")))
    return g.groupBy("group").agg(F.sum(gap).alias("edits"))


def greedy_extension(u: str, v: str, most_error_percent: float = 20.0, history: int = 64, least_matches_percent: int = 55) -> tuple[int, int, int]:
    """(u length, v length, edits) of the longest polished common start of u and v.

    Fronts of edits 0, 1, 2, ... reach as far as they can on each diagonal; a diagonal
    whose last `history` columns hold too few matches is given up. An end is polished
    if no suffix of its history has more errors than the error rate allows."""
    m, n = len(u), len(v)
    bits = (1 << history) - 1
    least = history * least_matches_percent // 100
    match_gain, error_cost = most_error_percent, 200.0 - most_error_percent

    def slide(i: int, j: int, h: int) -> tuple[int, int]:
        """Over equal characters, by slices: each as wide again as the one before while
        they are equal, and the last one halved."""
        first, width = i, 16
        while i < m and j < n:
            most = min(width, m - i, n - j)
            if u[i : i + most] == v[j : j + most]:
                i, j, width = i + most, j + most, 2 * width
                continue
            low, high = 0, most - 1
            while low < high:
                middle = (low + high + 1) // 2
                if u[i + low : i + middle] == v[j + low : j + middle]:
                    low = middle
                else:
                    high = middle - 1
            i += low
            break
        over = min(i - first, history)
        return i, (h << over | (1 << over) - 1) & bits

    def polished(h: int, length: int) -> bool:
        total = 0.0
        for k in range(min(history, length)):
            total += match_gain * 2 if h >> k & 1 else -error_cost
            if total < 0:
                return False
        return True

    i, h = slide(0, 0, 0)
    front, best, d = {0: (i, h)}, (i, i, 0), 0
    while front:
        d, fresh = d + 1, {}
        for k in range(min(front) - 1, max(front) + 2):
            options = []
            for dk, di in ((k, 1), (k - 1, 1), (k + 1, 0)):  # mismatch, deletion, insertion
                if dk in front:
                    i, h = front[dk]
                    options.append((i + di, (h << 1) & bits))
            options = [(i, h) for i, h in options if i <= m and 0 <= i - k <= n]
            if not options:
                continue
            i, h = max(options)
            i, h = slide(i, i - k, h)
            if i + i - k >= 2 * history and h.bit_count() < least:
                continue
            fresh[k] = (i, h)
            if 2 * i - k > best[0] + best[1] and polished(h, max(i, i - k)):
                best = (i, i - k, d)
        front = fresh
        if d * 200.0 > most_error_percent * (m + n) + 200.0:
            break
    return best


def greedy_extensions(pairs: DataFrame, most_error_percent: float = 20.0, history: int = 64, least_matches_percent: int = 55) -> DataFrame:
    """(id, left_length, right_length, edits) for pairs (id, left, right): the longest
    polished common start of each, by greedy_extension(). Nulls are empty. To extend to
    the front, give reversed texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(key, *greedy_extension(u or "", v or "", most_error_percent, history, least_matches_percent)) for key, u, v in zip(*(b.column(i).to_pylist() for i in range(3)))]
            columns = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["id", "left_length", "right_length", "edits"])

    return pairs.select(F.col("id").cast("long").alias("id"), "left", "right").mapInArrow(run, "id long, left_length long, right_length long, edits long")


def combined_extensions(seeds: DataFrame, most_error_percent: float = 20.0, history: int = 64, least_matches_percent: int = 55) -> DataFrame:
    """(id, left_start, left_length, right_start, right_length, edits) from seeds (id, left,
    right, left_pos, right_pos, length): exact matches of two texts, each extended to its
    front and to its end by greedy_extension(), as one match. Nulls are empty; a seed that
    isn't an exact match within both texts is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        options = most_error_percent, history, least_matches_percent
        for b in batches:
            rows = []
            for key, u, v, i, j, k in zip(*(b.column(c).to_pylist() for c in range(6))):
                u, v = u or "", v or ""
                if not (0 <= i <= len(u) - k and 0 <= j <= len(v) - k) or u[i : i + k] != v[j : j + k]:
                    raise ValueError(f"no exact match: {key}")
                before = greedy_extension(u[:i][::-1], v[:j][::-1], *options)
                after = greedy_extension(u[i + k :], v[j + k :], *options)
                rows.append((key, i - before[0], before[0] + k + after[0], j - before[1], before[1] + k + after[1], before[2] + after[2]))
            columns = list(zip(*rows)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["id", "left_start", "left_length", "right_start", "right_length", "edits"])

    given = seeds.select(F.col("id").cast("long").alias("id"), "left", "right", *[F.col(c).cast("long").alias(c) for c in ("left_pos", "right_pos", "length")])
    return given.mapInArrow(run, "id long, left_start long, left_length long, right_start long, right_length long, edits long")
