"""Exact n-gram Jaccard join by prefix trees.

1. Each text becomes the set of its word n-grams (64-bit hashes). Texts with equal
   sets are one class, and only a class's smallest id goes on.
2. n-grams have one global order: those not seen twice in a sample first (a share
   of all texts, so that common n-grams of a larger table aren't taken for rare ones),
   then by count there, then by hash. Any order gives exact results; this one puts
   common n-grams last. Sets that reach the threshold share an n-gram among the
   first n - ceil(t n) + 1 of either, so sets meet in buckets by these. A common
   n-gram is dealt out by a salt. Sets of a large bucket, by size, are cut into blocks,
   and two blocks meet as a tile if their sizes allow a link.
3. In a bucket or tile, pairs are ruled out by a parity sketch (a bit for each hash
   value class, flipped by each n-gram): two sketches differ in no more bits than the
   sets differ in n-grams, so a pair whose sketches differ in more than the threshold
   allows can't link. A lower threshold allows more, so its sketches have more bits:
   where unlike sets pass by chance, their groups grow together with the table. Large
   buckets are compared by arrays.
4. What is left, in connected groups, is joined exactly. A group's sets, each in the
   global order from its common end, form a trie with runs of single children
   merged. A set walks the trie level by level, adding up the overlap of shared
   prefixes once, and leaves subtrees whose remaining lengths can't reach the
   threshold. A large group is cut into blocks by size, and tiles are the pairs of
   blocks whose sizes allow a link.
5. Exact links give each document its component, and the number of its links. Classes
   and components that hold a large share of all rows are joined by broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .components import components

_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]

def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of words."""
    return np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * _M[0]
    h = (h ^ (h >> np.uint64(29))) * _M[3]
    return h ^ (h >> np.uint64(32))


def shingles(text: str | None, n: int = 4) -> np.ndarray:
    """The sorted set of hashes of a text's word n-grams: A-Z lower-cased, words
    divided by ASCII blanks. A shorter text is one n-gram; without words, none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    h = word_hashes(words)
    size = min(n, len(h))
    total = np.full(len(h) - size + 1, size, dtype=np.uint64)
    for i in range(size):
        total = _mixed(total * _M[1] + h[i : len(h) - size + 1 + i])
    return np.unique(total)


def least_overlap(size: int, percent: int) -> int:
    """What any partner of a set of this size must share: percent of it, rounded up."""
    return -(-percent * size // 100)


def sketch_bits(size: int, percent: int) -> int:
    """Bits of a sketch, a power of two that grows with the size of the set: so many that
    the sketches of two unlike sets differ in more bits than a link allows (from 80 percent
    on by four standard deviations; below, small sets pass more often), up to 2^14 bits."""
    wanted = -(-20 * size * (100 - percent) // (3 * (100 + percent)))
    return 1 << max(7, min(14, max(1, wanted - 1).bit_length()))


def sketch(tokens: np.ndarray, percent: int = 85) -> tuple[int, int]:
    """(bits, parity sketch), of as many bits as `percent` needs."""
    bits = sketch_bits(len(tokens), percent)
    odd = np.bincount((tokens >> np.uint64(20)).astype(np.int64) & (bits - 1), minlength=bits) & 1
    return bits, int.from_bytes(np.packbits(odd.astype(np.uint8), bitorder="little").tobytes(), "little")


def may_link(a: tuple, b: tuple, percent: int) -> bool:
    """a, b: (size, bits, sketch). False only if the sets can't link."""
    (n, p, x), (m, q, y) = a, b
    if percent * max(n, m) > 100 * min(n, m):
        return False
    while p > q:
        p //= 2
        x = (x >> p) ^ (x & ((1 << p) - 1))
    while q > p:
        q //= 2
        y = (y >> q) ^ (y & ((1 << q) - 1))
    # |x n y| >= t |x u y|  <=>  |x ^ y| (1 + t) <= (1 - t) (n + m)
    return (x ^ y).bit_count() * (100 + percent) <= (100 - percent) * (n + m)


#: Buckets of so many sets are compared set by set, larger ones by arrays.
_FEW = 80


def parts(held: list[tuple], percent: int) -> list[int]:
    """held: (size, bits, sketch as bytes), sorted by size. For each the place of the first
    set of its part; parts are connected by the pairs that sketches don't rule out."""
    if len(held) > _FEW:
        return _array_parts(held, percent)
    sets, known = _Sets(len(held)), {}

    def value(i: int) -> tuple:
        if i not in known:
            known[i] = (held[i][0], held[i][1], int.from_bytes(held[i][2], "little"))
        return known[i]

    low = 0
    for j in range(1, len(held)):
        while percent * held[j][0] > 100 * held[low][0]:
            low += 1
        for i in range(j - 1, low - 1, -1):
            if sets.find(i) != sets.find(j) and may_link(value(i), value(j), percent):
                sets.join(i, j)
    return [sets.find(j) for j in range(len(held))]


def _array_parts(held: list[tuple], percent: int, cells: int = 1 << 17) -> list[int]:
    """The same by arrays, `cells` pairs at once. Bits grow with the size, so sets with
    sketches of one length are side by side; a longer sketch is folded to the shorter."""
    n = np.array([x[0] for x in held], dtype=np.int64)
    bits = np.array([x[1] for x in held], dtype=np.int64)
    low = np.searchsorted(n * 100, n * percent)  # the first set that is not too small
    edges = np.concatenate([[0], np.flatnonzero(np.diff(bits)) + 1, [len(held)]]).tolist()
    levels = []  # (first, end, word by word the sketches of these sets)
    for first, end in zip(edges, edges[1:]):
        words = np.frombuffer(b"".join(x[2] for x in held[first:end]), dtype="<u8")
        levels.append((first, end, np.ascontiguousarray(words.reshape(end - first, -1).T)))
    part = np.arange(len(held))
    for at, (first, end, longer) in enumerate(levels):
        for start, stop, shorter in reversed(levels[: at + 1]):
            if stop <= low[first]:
                break
            while len(longer) > len(shorter):
                longer = longer[: len(longer) // 2] ^ longer[len(longer) // 2 :]
            j = first
            while j < end:
                lo = max(start, int(low[j]))
                to = min(end, j + max(1, cells // max(1, min(end, stop) - lo)))
                hi = min(stop, to)
                if lo < hi:
                    differ = np.zeros((to - j, hi - lo), dtype=np.uint16)
                    for x, y in zip(longer, shorter):
                        differ += np.bitwise_count(x[j - first : to - first, None] ^ y[None, lo - start : hi - start])
                    sizes = n[j:to, None] + n[None, lo:hi]
                    ok = differ.astype(np.int64) * (100 + percent) <= (100 - percent) * sizes
                    here, there = np.arange(j, to)[:, None], np.arange(lo, hi)[None, :]
                    ok &= (there < here) & (there >= low[j:to, None])
                    for k in np.flatnonzero(ok.any(axis=1)).tolist():
                        joined = np.append(part[lo:hi][ok[k]], part[j + k])
                        if (joined != joined[0]).any():
                            part[np.isin(part, joined)] = joined.min()
                j = to
    return part.tolist()


class _Sets:
    """Disjoint sets of list places."""

    def __init__(self, n: int):
        self.of = list(range(n))

    def find(self, i: int) -> int:
        of = self.of
        while of[i] != i:
            of[i] = of[of[i]]
            i = of[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        self.of[max(i, j)] = min(i, j)
        return i != j


class Trie:
    """Sets of small integers, each sorted, as a tree with merged runs, kept as
    arrays by node: parent, tokens of its run, least and most set size below, and the
    tokens that sets below still have after it."""

    def __init__(self, sets: list[np.ndarray]):
        order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">u4").tobytes())
        parent, start, stop, source, leaves, depth_of = [-1], [0], [0], [0], [], [0]
        path = [0]  # nodes from the root
        previous = np.zeros(0, dtype=np.int64)
        for i in order:
            s = sets[i]
            k = min(len(s), len(previous))
            differ = np.flatnonzero(s[:k] != previous[:k])
            shared = int(differ[0]) if len(differ) else k
            while depth_of[path[-1]] > shared and depth_of[parent[path[-1]]] >= shared:
                path.pop()
            top = path[-1]
            if depth_of[top] > shared:  # the run is split at the shared depth
                up = parent[top]
                parent.append(up), source.append(source[top]), start.append(start[top]), stop.append(shared), depth_of.append(shared)
                parent[top], start[top] = len(parent) - 1, shared
                path[-1] = len(parent) - 1
                top = path[-1]
            if len(s) > depth_of[top]:
                parent.append(top), source.append(i), start.append(depth_of[top]), stop.append(len(s)), depth_of.append(len(s))
                path.append(len(parent) - 1)
            leaves.append((path[-1], i))
            previous = s
        n = len(parent)
        self.parent = np.array(parent)
        level = np.zeros(n, dtype=np.int64)
        children: dict[int, list[int]] = {}
        for c, p in enumerate(parent):
            if p >= 0:
                children.setdefault(p, []).append(c)
        levels, now = [], [0]
        while now:
            levels.append(now)
            now = [c for p in now for c in children.get(p, ())]
        for d, nodes in enumerate(levels):
            level[nodes] = d
        # Nodes renumbered by level, children of a node side by side.
        flat = [x for nodes in levels for x in nodes]
        new = np.empty(n, dtype=np.int64)
        new[flat] = np.arange(n)
        self.parent = np.array([new[parent[x]] if parent[x] >= 0 else -1 for x in flat])
        self.level_starts = np.concatenate([[0], np.cumsum([len(x) for x in levels])])
        runs = [sets[source[x]][start[x] : stop[x]] for x in flat]
        self.run_length = np.array([len(r) for r in runs], dtype=np.int64)
        self.run_start = np.concatenate([[0], np.cumsum(self.run_length)])[:-1]
        self.tokens = np.concatenate([*runs, np.zeros(0, np.int64)]).astype(np.int64)
        self.depth = np.array([depth_of[x] for x in flat])
        self.leaf_node = np.array([new[x] for x, _ in leaves], dtype=np.int64)
        self.leaf_set = np.array([i for _, i in leaves], dtype=np.int64)
        self.leaf_size = np.array([len(sets[i]) for i in self.leaf_set], dtype=np.int64)
        big = 1 << 60
        self.least, self.most = np.full(n, big), np.zeros(n, dtype=np.int64)
        np.minimum.at(self.least, self.leaf_node, self.leaf_size)
        np.maximum.at(self.most, self.leaf_node, self.leaf_size)
        for x in range(n - 1, 0, -1):
            p = self.parent[x]
            self.least[p] = min(self.least[p], self.least[x])
            self.most[p] = max(self.most[p], self.most[x])

    def partners(self, member: np.ndarray, size: int, percent: int) -> np.ndarray:
        """The stored sets that link with a query: member is a mask over tokens, size
        the number of its tokens (some may be in no stored set)."""
        overlap = np.zeros(len(self.parent), dtype=np.int64)
        alive = np.zeros(len(self.parent), dtype=bool)
        alive[0] = True
        for d in range(1, len(self.level_starts) - 1):
            nodes = np.arange(self.level_starts[d], self.level_starts[d + 1])
            nodes = nodes[alive[self.parent[nodes]]]
            # By length: neither set may be too large for the other.
            nodes = nodes[(self.most[nodes] * 100 >= percent * size) & (self.least[nodes] * percent <= 100 * size)]
            if not len(nodes):
                break
            lengths = self.run_length[nodes]
            ends = np.cumsum(lengths)
            at = np.repeat(self.run_start[nodes] - (ends - lengths), lengths) + np.arange(ends[-1])
            sums = np.add.reduceat(member[self.tokens[at]].astype(np.int64), ends - lengths)
            seen = overlap[self.parent[nodes]] + sums
            overlap[nodes] = seen
            # What is left below, of the query and of the largest set, bounds the overlap.
            most = seen + np.minimum(size - seen, self.most[nodes] - self.depth[nodes])
            alive[nodes] = most * (100 + percent) >= percent * (size + np.maximum(self.least[nodes], least_overlap(size, percent)))
        found = overlap[self.leaf_node]
        ok = alive[self.leaf_node] & (found * 100 >= percent * (size + self.leaf_size - found)) & (self.leaf_size > 0)
        return self.leaf_set[ok]


class Order:
    """The global order of n-grams: by their count in the sample (0 if not twice there),
    then by hash."""

    def __init__(self, tokens: np.ndarray, counts: np.ndarray):
        self.tokens, self.counts = tokens, counts  # sorted by token

    def count(self, tokens: np.ndarray) -> np.ndarray:
        if not len(self.tokens):
            return np.zeros(len(tokens), np.int64)
        at = np.minimum(np.searchsorted(self.tokens, tokens), len(self.tokens) - 1)
        return np.where(self.tokens[at] == tokens, self.counts[at], 0)

    def sorted(self, tokens: np.ndarray) -> np.ndarray:
        return tokens[np.lexsort((tokens, self.count(tokens)))]


def trie_join(left: list[np.ndarray], right: list[np.ndarray] | None, percent: int, order: Order) -> Iterator[tuple[int, np.ndarray]]:
    """For each set of `left` its partners in `right`; in `left` itself if that is None.
    The trie holds sets from the common end of the global order."""
    both = left if right is None else left + right
    values = order.sorted(np.unique(np.concatenate(both)))[::-1]
    by_hash = np.argsort(values)
    ranked = [np.sort(by_hash[np.searchsorted(values, s, sorter=by_hash)]) for s in both]
    trie = Trie(ranked if right is None else ranked[len(left) :])
    member = np.zeros(len(values), dtype=bool)
    for i, s in enumerate(ranked[: len(left)]):
        member[s] = True
        yield i, trie.partners(member, len(s), percent)
        member[s] = False


def _described(docs: DataFrame, n: int, percent: int, shared) -> DataFrame:
    """Per row: its id, set size, signature of the set, sketch, and first tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = shared.value
        for b in batches:
            rows = []
            for doc_id, text, text_hash in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist()):
                s = shingles(text.as_py(), n)
                if not len(s):
                    rows.append((doc_id, text_hash, 0, 0, 0, 0, None, None))
                    continue
                first = order.sorted(s)[: len(s) - least_overlap(len(s), percent) + 1]
                bits, parity = sketch(s, percent)
                sign = xxhash.xxh3_128_intdigest(s.tobytes())
                low, high = sign & (2**64 - 1), sign >> 64
                rows.append((doc_id, text_hash, len(s), low - (low >> 63 << 64), high - (high >> 63 << 64), bits, parity.to_bytes(bits // 8, "little"), first.view(np.int64)))
            columns = list(zip(*rows)) or [()] * 8
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["doc_id", "text_hash", "n_shingles", "sign1", "sign2", "bits", "sketch", "first"])

    return docs.mapInArrow(run, "doc_id long, text_hash long, n_shingles long, sign1 long, sign2 long, bits int, sketch binary, first array<long>")


def _global_order(docs: DataFrame, n: int, total: int, sample_docs: int, most: int) -> Order:
    """n-grams that occur twice or more in a sample of about sample_docs texts (of smallest
    hash), with their counts, the `most` most frequent ones: only the order of n-grams
    depends on them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [shingles(t.as_py(), n) for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*got, np.zeros(0, np.uint64)]).view(np.int64))], names=["token"])

    share = min(1.0, sample_docs / max(1, total))
    near = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) < int(share * (1 << 20)))
    seen = near.select("text").mapInArrow(run, "token long").groupBy("token").agg(F.count("*").alias("n")).where("n > 1")
    rows = seen.orderBy(F.col("n").desc(), "token").limit(most).toPandas()
    tokens = rows["token"].to_numpy(np.int64).view(np.uint64)
    by_hash = np.argsort(tokens)
    return Order(tokens[by_hash], rows["n"].to_numpy(np.int64)[by_hash])


def _parts(entries: DataFrame, tile: int) -> DataFrame:
    """(token, salt, block, a, n) for n-grams with two sets or more, from (token, salt, a,
    n) sorted by token, salt, n in each partition; salt -1: not dealt out. Block -1: all sets of an
    n-gram, `tile` at most. Else blocks of tile / 2 sets or less, by size. A long bucket is
    streamed, never held."""
    half = max(1, tile // 2)
    names = ["token", "salt", "block", "a", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = [np.zeros(0, np.int64) for _ in range(4)]
        sent = 0  # of the group at hand

        def batch_of(c: list[np.ndarray], block: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (c[0], c[1], block, c[2], c[3])], names=names)

        def whole(c: list[np.ndarray], before: int) -> pa.RecordBatch:
            """Groups that end here, the first of which has `before` rows sent."""
            n = len(c[0])
            new = np.ones(n, dtype=bool)
            new[1:] = (c[0][1:] != c[0][:-1]) | (c[1][1:] != c[1][:-1])
            edges = np.flatnonzero(np.concatenate([new, [True]]))
            size = np.diff(edges)
            of = np.cumsum(new) - 1
            size = size + np.where(np.arange(len(size)) == 0, before, 0)
            place = np.arange(n) - edges[:-1][of] + np.where(of == 0, before, 0)
            one = (size[of] <= tile) & (c[1] < 0)
            keep = ~one | (size[of] > 1)
            return batch_of([x[keep] for x in c], np.where(one, -1, place // half)[keep])

        for b in batches:
            c = [np.concatenate([r, b.column(i).to_numpy()]) for i, r in enumerate(rest)]
            if not len(c[0]):
                continue
            ends = np.flatnonzero((c[0] != c[0][-1]) | (c[1] != c[1][-1]))
            cut = int(ends[-1]) + 1 if len(ends) else 0  # the last group may go on
            if cut:
                yield whole([x[:cut] for x in c], sent)
                sent = 0
            rest = [x[cut:] for x in c]
            if len(rest[0]) > tile:
                now = len(rest[0]) // half * half - (half if len(rest[0]) % half == 0 else 0)
                yield batch_of([x[:now] for x in rest], (sent + np.arange(now)) // half)
                sent, rest = sent + now, [x[now:] for x in rest]
        if len(rest[0]):
            yield whole(rest, sent)

    return entries.mapInArrow(run, "token long, salt long, block long, a long, n long")


def _met(x: str, y: str, percent: int):
    """Whether sets of two blocks may be of sizes that link."""
    return (F.col(f"{y}.low") * percent <= F.col(f"{x}.high") * 100) & (F.col(f"{x}.low") * percent <= F.col(f"{y}.high") * 100)


def _bucketed(parts: DataFrame, percent: int) -> DataFrame:
    """(bucket, a): whole buckets as they are, and the rows of each two blocks that meet.
    Only rows of blocks, a key of which is tile / 2 rows at most, are joined."""
    blocks = parts.where("block >= 0").groupBy("token", "salt", "block").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    x, y = blocks.alias("x"), blocks.alias("y")
    order = F.struct("x.salt", "x.block") <= F.struct("y.salt", "y.block")
    pairs = x.join(y, (F.col("x.token") == F.col("y.token")) & order & _met("x", "y", percent))
    key = F.xxhash64("x.token", "x.salt", "x.block", "y.salt", "y.block").alias("bucket")
    end = lambda s: pairs.select(key, F.col(f"{s}.token").alias("t"), F.col(f"{s}.salt").alias("s"), F.col(f"{s}.block").alias("k"))
    wanted = end("x").unionByName(end("y")).distinct()
    large = parts.where("block >= 0").join(wanted, (F.col("token") == F.col("t")) & (F.col("salt") == F.col("s")) & (F.col("block") == F.col("k"))).select("bucket", "a")
    return parts.where("block = -1").select(F.col("token").alias("bucket"), "a").unionByName(large)


def _candidates(rows: DataFrame, percent: int) -> DataFrame:
    """(a, b): a spanning forest of the pairs of each bucket that sketches don't rule
    out, from (bucket, a, n, bits, sketch) with a bucket's rows side by side."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held, out = None, [], set()

        def close() -> None:
            held.sort(key=lambda x: x[1])
            for j, i in enumerate(parts([x[1:] for x in held], percent)):
                if i != j:
                    out.add((min(held[i][0], held[j][0]), max(held[i][0], held[j][0])))

        def batch() -> pa.RecordBatch:
            pairs = list(zip(*out)) or [(), ()]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in pairs], names=["a", "b"])

        for b in batches:
            for key, *row in zip(*(b.column(i).to_pylist() for i in range(5))):
                if key != bucket:
                    close()
                    bucket, held = key, []
                held.append(tuple(row))
            if len(out) > 50_000:
                yield batch()
        close()
        yield batch()

    return rows.mapInArrow(run, "a long, b long").distinct()


def _exact(members: DataFrame, n: int, percent: int, shared) -> DataFrame:
    """From (tile, side, a, weight, text), rows of a tile together: for each set with
    a partner (a, b, links, ...): a link of a spanning forest, and partial link counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, held, rows = None, [], []

        def close() -> None:
            alone = bool(held) and held[0][0] == 2  # a block with itself
            sides = [held, []] if alone else [[x for x in held if x[0] == s] for s in (0, 1)]
            if len(held) < 2 or not sides[0] or not (alone or sides[1]):
                return
            sets = [[shingles(x[3], n) for x in side] for side in sides]
            every = sides[0] + sides[1]
            union = _Sets(len(every))
            links = [0] * len(every)
            weights = np.array([x[2] for x in every], dtype=np.int64)
            shift = 0 if alone else len(sides[0])
            for i, partners in trie_join(sets[0], None if alone else sets[1], percent, shared.value):
                others = partners[partners != i] if not shift else partners + shift
                links[i] += int(weights[others].sum())
                for j in others.tolist():
                    union.join(i, j)
                    if shift:
                        links[j] += int(weights[i])
            for j, x in enumerate(every):
                if links[j]:
                    rows.append((x[1], every[union.find(j)][1], links[j]))

        def batch() -> pa.RecordBatch:
            columns = list(zip(*rows)) or [(), (), ()]
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["a", "b", "links"])

        for b in batches:
            for key, *row in zip(*(b.column(i).to_pylist() for i in range(5))):
                if key != tile:
                    close()
                    tile, held = key, []
                held.append(row)
            if len(rows) > 20_000:
                yield batch()
        close()
        yield batch()

    return members.mapInArrow(run, "a long, b long, links long")


def _tiles(groups: DataFrame, reps: DataFrame, percent: int, tile: int, tile_tokens: int) -> DataFrame:
    """(tile, side, node, weight, rep, rep_text): a group's sets in blocks by size, of
    bounded tokens and sets, and a tile for each two blocks whose sizes allow a link: side
    0 and 1, or 2 for a block with itself. Blocks follow from counts by group and size."""
    sized = groups.join(reps.select(F.col("a").alias("of"), "n", "weight", "rep", "rep_text"), F.col("node") == F.col("of")).select("component", "node", "n", "weight", "rep", "rep_text")
    sized = common.written(sized, "sized")
    part = F.greatest(F.col("n") / F.lit(float(tile_tokens)), F.lit(0.5 / tile))  # of a block, that a set fills
    sizes = sized.groupBy(F.col("component").alias("c"), F.col("n").alias("m")).agg(F.sum(part).alias("fill"))
    order = Window.partitionBy("c")
    sizes = sizes.select("c", "m", "fill", F.coalesce(F.sum("fill").over(order.orderBy("m").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("before"), F.sum("fill").over(order).alias("all"))
    at = F.col("before") + F.col("fill") * (F.pmod(F.xxhash64("node", F.lit(3)), F.lit(1 << 20)) / F.lit(float(1 << 20)))
    block = F.when(F.col("all") <= 1.0, F.lit(0)).otherwise(F.floor(at).cast("int"))
    placed = sized.join(sizes, (F.col("component") == F.col("c")) & (F.col("n") == F.col("m"))).withColumn("block", block).drop("c", "m", "fill", "before", "all")
    placed = common.written(placed, "placed")
    blocks = placed.groupBy("component", "block").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    x, y = blocks.alias("x"), blocks.alias("y")
    pairs = x.join(y, (F.col("x.component") == F.col("y.component")) & (F.col("x.block") <= F.col("y.block")) & _met("x", "y", percent))
    pairs = pairs.select(F.col("x.component").alias("c"), F.col("x.block").alias("i"), F.col("y.block").alias("j"))
    end = lambda k, side, pairs: pairs.select("c", F.col(k).alias("k"), F.xxhash64("c", "i", "j").alias("tile"), side.alias("side"))
    ends = end("i", F.when(F.col("i") == F.col("j"), 2).otherwise(0), pairs).unionByName(end("j", F.lit(1), pairs.where("i < j")))
    return placed.join(ends, (F.col("component") == F.col("c")) & (F.col("block") == F.col("k"))).select("tile", "side", "node", "weight", "rep", "rep_text")


def jaccard_join(docs: DataFrame, n: int = 4, percent: int = 85, sample_docs: int = 8192, sample_every: int = 32, most_common: int = 1_000_000, tile: int = 2048, tile_tokens: int = 4_000_000, salt_rows: int = 65_536) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links, text_hash, is_first) for each row of
    docs (doc_id, text).

    Documents link when percent of the union of their sets is shared. n_links counts
    the other rows that a row links with; text_hash is xxhash64 of the text, and is_first
    is true in rows of the least (doc_id, text_hash) of their component, so that one row
    of each may be kept also where ids repeat. Null and empty texts have no set and no
    link (and are first); texts shorter than n words are one n-gram; a
    very long text is one set, held by one task while it is compared. Rows of a null id
    are never linked: their component is null. Rows that repeat an id are documents each,
    under one id. Other columns are ignored, whatever their names. An empty table gives no
    rows."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("text_hash"))
    total = docs.count()
    # A share of the table, not a number of texts: an n-gram then escapes the sample up to
    # a number of texts, not a share, and no bucket grows with the table.
    sample_docs = max(sample_docs, total // sample_every)
    order = _global_order(docs, n, total, sample_docs, most_common)
    shared = spark.sparkContext.broadcast(order)
    facts = common.written(_described(docs, n, percent, shared).withColumn("class", F.xxhash64("sign1", "sign2")), "sets")
    able = facts.where("n_shingles > 0 AND doc_id IS NOT NULL")
    same = [F.first(c).alias(c) for c in ("bits", "sketch", "first")]  # equal in all rows of a class
    classes = able.groupBy("class").agg(F.min(F.struct("doc_id", "text_hash")).alias("r"), F.count("*").alias("weight"), F.first("n_shingles").cast("int").alias("n"), *same)
    reps = common.written(classes.select(F.col("class").alias("a"), "n", "bits", "sketch", "first", "weight", F.col("r.doc_id").alias("rep"), F.col("r.text_hash").alias("rep_text")), "reps")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    entries = reps.select(F.explode("first").alias("token"), "a", F.col("n").cast("long").alias("n"))
    # n-grams that the sample shows to be in very many sets are dealt out: at most most_common rows.
    salts = np.ceil(order.counts * (total / max(1, sample_docs)) / salt_rows).astype(np.int64) if total > sample_docs else np.zeros(len(order.counts), np.int64)
    many = salts > 1
    if many.any():
        dealt = spark.createDataFrame(pd.DataFrame({"of": order.tokens[many].view(np.int64), "salts": salts[many]}))
        entries = entries.join(F.broadcast(dealt), F.col("token") == F.col("of"), "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("a"), F.col("salts")), F.lit(-1)))
    else:
        entries = entries.withColumn("salt", F.lit(-1).cast("long"))
    entries = entries.select("token", "salt", "a", "n")
    parts = common.written(_parts(entries.repartition(tasks, "token", "salt").sortWithinPartitions("token", "salt", "n", "a"), tile), "buckets")
    near = _bucketed(parts, percent).join(reps.select(F.col("a").alias("of"), "n", "bits", "sketch"), F.col("a") == F.col("of")).select("bucket", "a", "n", "bits", "sketch")
    pairs = _candidates(near.repartition(tasks, "bucket").sortWithinPartitions("bucket"), percent)
    groups = common.written(components(pairs), "groups")
    spread = common.written(_tiles(groups, reps, percent, tile, tile_tokens), "spread")
    wanted = spread.select("rep", "rep_text").distinct()
    # A merge join at every size: its sides may spill, and texts are moved once.
    held = docs.join(wanted.hint("merge"), (F.col("doc_id") == F.col("rep")) & (F.col("text_hash") == F.col("rep_text"))).select(F.col("rep").alias("r"), F.col("rep_text").alias("t"), "text").dropDuplicates(["r", "t"])
    members = spread.join(held, (F.col("rep") == F.col("r")) & (F.col("rep_text") == F.col("t"))).select("tile", "side", "node", "weight", "text")
    exact = common.written(_exact(members.repartition(tasks, "tile").sortWithinPartitions("tile", "side", "node"), n, percent, shared), "links")
    # Back to documents: a node is a class; ids link the classes of repeated ids.
    final = components(exact.select("a", "b"))
    counts = exact.groupBy(F.col("a").alias("x")).agg(F.sum("links").alias("others"))
    named = reps.select("a", "weight", "rep", "rep_text").join(final, F.col("a") == F.col("node"), "left").join(counts, F.col("a") == F.col("x"), "left")
    named = common.written(named.select("a", F.struct("rep", "rep_text").alias("own"), "weight", F.coalesce("component", "a").alias("component"), F.coalesce("others", F.lit(0)).alias("others")), "named")
    least = named.groupBy(F.col("component").alias("c")).agg(F.min("own").alias("lead"), F.count("*").alias("members"))
    known = common.hot_split_join(named, least, "component", "c", "members", total).select(F.col("a").alias("of"), "lead", "weight", (F.col("weight") - 1 + F.col("others")).alias("links"))
    known = common.written(known, "known")
    out = common.hot_split_join(able.select("doc_id", "n_shingles", "text_hash", "class"), known, "class", "of", "weight", total)
    first = (F.col("doc_id") == F.col("lead.rep")) & (F.col("text_hash") == F.col("lead.rep_text"))
    out = out.select("doc_id", "n_shingles", F.col("lead.rep").alias("component_id"), F.col("links").cast("long").alias("n_links"), "text_hash", first.alias("is_first"))
    alone = facts.where("n_shingles = 0 OR doc_id IS NULL")  # linked with nothing, and in no join
    return out.unionByName(alone.select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links"), "text_hash", F.lit(True).alias("is_first")))


def op3_trie_jaccard(spark, sf_dir: str) -> DataFrame:
    """Four-word shingles of all documents, linked from 85 percent on."""
    return jaccard_join(common.table(spark, sf_dir, "documents")).drop("text_hash", "is_first")
