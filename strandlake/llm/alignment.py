"""Cross-tokenizer alignment by byte-owner arrays.

Each text is encoded by two tokenizers, A and B. np.repeat spreads token numbers over the
bytes that they own; where the pair of owners changes from one byte to the next, another
link (an overlapping pair of tokens) begins, and where both owners change at once, both
texts of tokens are cut. The texts of a batch are one stream of bytes, gone through in
windows, so memory doesn't depend on the longest text.

How many documents hold an id pair linked is summed in each task before it is shuffled by
pair. The most frequent pairs (at most `heavy`) go to all tasks as one sorted table; links
of other pairs, which few documents hold, are joined by pair in a shuffle, so that neither
side needs to fit anywhere and no key of the join is hot. Texts are encoded once, and their
ids are a written table, which both passes read.

Texts are encoded part by part: no token of either tokenizer reaches from a visible
character into a space that follows it, so what stands between two such places has the same
ids anywhere. Of all texts of a chunk each different part is encoded once.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

_JOINED = 1 << 12  # characters of parts that are encoded together
_WINDOW = 1 << 20  # bytes that have owners at once
_CHUNK = 1 << 21  # bytes of texts that are encoded together
_TOKENS = 1 << 18  # tokens of A that are one stream
_CUT = re.compile(r"(?<=\S) (?=\S)")
_BLANK_RUN = 10_000
_BLANKS = re.compile(rf"\s{{{_BLANK_RUN}}}")


class Tokens:
    """A tokenizer as two things: ids of texts with a space put before each, and the bytes
    of each id. whole_only: it can't be taken part by part."""

    def __init__(self, encode_all: Callable[[list[str]], list[list[int]]], pieces: list[bytes], whole_only: bool = False) -> None:
        self.encode_all, self.pieces, self.whole_only = encode_all, pieces, whole_only
        self.sizes = np.array([len(p) for p in pieces], dtype=np.int64)


def _byte_level() -> dict[str, int]:
    """Byte of each character of byte-level BPE: printable ones stand for themselves, the
    others for characters from 256 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@functools.cache
def byte_bpe(path: str, ranks: str | None = None) -> Tokens:
    """A byte-level BPE of a .json file. Strings of its special tokens are plain text.
    `ranks`: a .tiktoken file of the same vocabulary, which gives the same ids faster."""
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(path)
    slow.encode_special_tokens = True
    of = _byte_level()
    names = [slow.id_to_token(i) or "" for i in range(slow.get_vocab_size())]
    pieces = [bytes(of[c] for c in n) if all(c in of for c in n) else n.encode() for n in names]
    plain = lambda text: slow.encode(" " + text, add_special_tokens=False).ids
    if ranks is None:
        return Tokens(lambda texts: list(map(plain, texts)), pieces)
    import base64

    import public_tokenizers
    import tiktoken

    with open(ranks, "rb") as lines:
        known = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=known, special_tokens={})
    # The faster library's pattern recurses on each blank of a run.
    return Tokens(lambda texts: [plain(x) if len(x) >= _BLANK_RUN and _BLANKS.search(x) else fast.encode_ordinary(" " + x) for x in texts], pieces)


@functools.cache
def piece_bpe(path: str) -> Tokens:
    """A sentencepiece model that puts a space before texts."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    pieces = [bytes([int(n[3:5], 16)]) if model.is_byte(i) else n.replace("▁", " ").encode() for i, n in enumerate(names)]
    within = any("▁" in n.lstrip("▁") for n in names)
    return Tokens(lambda texts: model.encode(texts, num_threads=1), pieces, within)


class Both:
    """Two tokenizers that encode many texts at once, each different word once."""

    def __init__(self, a: Tokens, b: Tokens) -> None:
        self.a, self.b = a, b
        self.whole_only = a.whole_only or b.whole_only

    def parts(self, text: str) -> list[str]:
        """A text, cut at spaces between visible characters. A literal "▁" is a space to
        sentencepiece, so a text with one is a part."""
        return [text] if self.whole_only or "▁" in text else _CUT.split(text)

    def encoded(self, texts: list[bytes | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each tokenizer the ids of all texts, one after another, and where each text
        begins, and one more. A text has a space put before it; null and empty ones, and
        those that either tokenizer doesn't give back, have no ids."""
        plain = [(raw or b"").decode("utf-8", "replace") for raw in texts]
        cut = [self.parts(x) if x else [] for x in plain]
        starts = np.r_[0, np.cumsum([len(parts) for parts in cut], dtype=np.int64)]
        flat = pa.array([x for parts in cut for x in parts], pa.large_string()).dictionary_encode()
        different = flat.dictionary.to_pylist()
        alone = np.array([self.whole_only or not x or x[0].isspace() or x[-1].isspace() or "▁" in x for x in different], dtype=bool)
        order = np.argsort(alone, kind="stable")
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        of, tied = place[flat.indices.to_numpy()], len(alone) - int(alone.sum())
        parts = [different[i] for i in order.tolist()]
        own = [_Encoded(t, parts[:tied], parts[tied:]) for t in (self.a, self.b)]
        # Parts that don't come back, and marks of bytes that are no text, ask for a look at the whole.
        doubtful = np.r_[0, np.cumsum(~(own[0].good & own[1].good)[of])][starts]
        lost = np.zeros(len(texts), dtype=bool)
        for i in range(len(texts)):
            if doubtful[i + 1] > doubtful[i] or "\ufffd" in plain[i]:
                here = of[starts[i] : starts[i + 1]].tolist()
                lost[i] = any(b"".join([b"".join(map(e.pieces.__getitem__, e.ids_of(j).tolist())) for j in here]) != b" " + texts[i] for e in own)
        kept = ~np.repeat(lost, np.diff(starts))
        out = []
        for e in own:
            n = e.n[of] * kept
            ends = np.cumsum(n)
            total = int(ends[-1]) if len(ends) else 0
            out.append((e.ids[np.repeat(e.first[of] - ends + n, n) + np.arange(total)], np.r_[0, ends][starts]))
        return out


class _Encoded:
    """Ids of parts by one tokenizer: those of part i are ids[first[i] : first[i] + n[i]],
    and good[i] says that they give it back with a space before it. Tied parts begin and
    end with a visible character, so many of them are encoded as one text."""

    def __init__(self, t: Tokens, tied: list[str], loose: list[str]) -> None:
        self.pieces, self.good = t.pieces, np.ones(len(tied) + len(loose), dtype=bool)
        found, sizes, at = [], [], 0
        raw = [b" " + x.encode("utf-8", "replace") for x in (*tied, *loose)]
        length = np.array([len(x) for x in raw], dtype=np.int64)
        steps = np.flatnonzero(np.diff(np.cumsum(length[: len(tied)]) // _JOINED, prepend=-1)).tolist() + [len(tied)]
        blocks = [" ".join(tied[x:y]) for x, y in zip(steps, steps[1:])]
        for x, y, ids in zip(steps, steps[1:], t.encode_all(blocks)):
            ids, bounds = np.array(ids, dtype=np.int64), np.cumsum(length[x:y])
            ends = np.cumsum(t.sizes[ids])
            after = np.searchsorted(ends, bounds) + 1
            if after[-1] == len(ids) and (ends[after - 1] == bounds).all() and b"".join(map(t.pieces.__getitem__, ids.tolist())) == b"".join(raw[x:y]):
                found.append(ids)
                sizes.append(np.diff(after, prepend=0))
            else:
                self._singly(t, tied[x:y], raw[x:y], x, found, sizes)
        self._singly(t, loose, raw[len(tied) :], len(tied), found, sizes)
        self.ids, self.n = (np.concatenate([np.zeros(0, dtype=np.int64), *v]) for v in (found, sizes))
        self.first = np.cumsum(self.n) - self.n

    def _singly(self, t: Tokens, parts: list[str], raw: list[bytes], at: int, found: list, sizes: list) -> None:
        for i, ids in enumerate(t.encode_all(parts)):
            found.append(np.array(ids, dtype=np.int64))
            sizes.append(np.array([len(ids)]))
            self.good[at + i] = b"".join(map(t.pieces.__getitem__, ids)) == raw[i]

    def ids_of(self, i: int) -> np.ndarray:
        return self.ids[self.first[i] : self.first[i] + self.n[i]]


class Stream:
    """Texts of a chunk, given by their ids and the bytes of each id: the links of both
    tokenizers."""

    def __init__(self, a_sizes: np.ndarray, b_sizes: np.ndarray, a_ids: np.ndarray, a_start: np.ndarray, b_ids: np.ndarray, b_start: np.ndarray) -> None:
        self.texts, self.a_ids, self.b_ids = len(a_start) - 1, a_ids, b_ids
        self.na, self.nb = np.diff(a_start), np.diff(b_start)
        self.a_ends, self.b_ends = np.cumsum(a_sizes[a_ids]), np.cumsum(b_sizes[b_ids])
        self.a_of, self.b_of, self.cuts = self._links()
        #: First token, link and group of each text, and one more.
        self.a_start, self.b_start = a_start, b_start
        self.link_start = np.searchsorted(self.a_of, self.a_start)
        self.cut_start = np.searchsorted(self.cuts, self.link_start)

    def _owners(self, ends: np.ndarray, start: int, stop: int) -> np.ndarray:
        """Numbers of the tokens that own bytes [start, stop)."""
        first, last = np.searchsorted(ends, start, side="right"), np.searchsorted(ends, stop, side="left")
        edges = np.r_[start, np.minimum(ends[first : last + 1], stop)]
        return np.repeat(np.arange(first, last + 1), np.diff(edges))

    def _links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tokens (A, B) of each link, and the links that begin a group."""
        total = int(self.a_ends[-1]) if len(self.a_ends) else 0
        a, b, cuts, links, last = [], [], [], 0, (-1, -1)
        for start in range(0, total, _WINDOW):
            x, y = (self._owners(e, start, min(start + _WINDOW, total)) for e in (self.a_ends, self.b_ends))
            new_a, new_b = np.r_[x[0] != last[0], x[1:] != x[:-1]], np.r_[y[0] != last[1], y[1:] != y[:-1]]
            at = np.flatnonzero(new_a | new_b)
            a.append(x[at])
            b.append(y[at])
            cuts.append(np.flatnonzero((new_a & new_b)[at]) + links)
            links, last = links + len(at), (x[-1], y[-1])
        none = np.zeros(0, dtype=np.int64)
        return np.concatenate([none, *a]), np.concatenate([none, *b]), np.concatenate([none, *cuts])

    def pairs(self, of_b: int) -> np.ndarray:
        """Id pair of each link, as one number."""
        return self.a_ids[self.a_of] * of_b + self.b_ids[self.b_of]

    def links_of(self) -> np.ndarray:
        """Text of each link."""
        return np.repeat(np.arange(self.texts), np.diff(self.link_start))

    def groups(self, names: list[bytes], a_size: int, b_size: int) -> list[str]:
        """Digest of each text's groups. names: a's ids with "," and with "|", then b's
        with "," and with ";"."""
        if not len(self.cuts):
            return [""] * self.texts
        a_first, b_first = self.a_of[self.cuts], self.b_of[self.cuts]  # each group's first tokens
        a_last, b_last = np.zeros(len(self.a_ids), dtype=bool), np.zeros(len(self.b_ids), dtype=bool)
        a_last[np.r_[a_first[1:], len(self.a_ids)] - 1] = True
        b_last[np.r_[b_first[1:], len(self.b_ids)] - 1] = True
        a_group, b_group = np.searchsorted(a_first, np.arange(len(self.a_ids)), side="right") - 1, np.searchsorted(b_first, np.arange(len(self.b_ids)), side="right") - 1
        code = np.empty(len(self.a_ids) + len(self.b_ids), dtype=np.int64)
        code[np.arange(len(self.a_ids)) + b_first[a_group]] = self.a_ids + np.where(a_last, a_size, 0)
        code[np.arange(len(self.b_ids)) + np.r_[a_first[1:], len(self.a_ids)][b_group]] = self.b_ids + 2 * a_size + np.where(b_last, b_size, 0)
        out, starts = [], self.a_start + self.b_start
        for s, e in zip(starts[:-1].tolist(), starts[1:].tolist()):
            digest = hashlib.sha256()
            for at in range(s, e, _WINDOW):
                part = b"".join(map(names.__getitem__, code[at : min(e, at + _WINDOW)].tolist()))
                digest.update(part[:-1] if at + _WINDOW >= e else part)
            out.append(digest.hexdigest() if e > s else "")
        return out


def _chunks(sizes: Iterator[int], most: int) -> Iterator[tuple[int, int]]:
    """Runs of rows, as (first, end), each of about `most` in size."""
    start, size, i = 0, 0, -1
    for i, n in enumerate(sizes):
        size += n
        if size >= most:
            yield start, i + 1
            start, size = i + 1, 0
    if start <= i:
        yield start, i + 1


def encoded(docs: DataFrame, tokens: Callable[[], tuple[Tokens, Tokens]]) -> DataFrame:
    """(doc_id, a, b): ids of documents by both tokenizers; written. Texts are encoded
    once, as all that follows needs ids alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = Both(*tokens())
        for batch in batches:
            for first, end in _chunks(((len(x.as_buffer()) if x.is_valid else 0) for x in batch.column(1)), _CHUNK):
                lists = [pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(ids, pa.int32())) for ids, starts in both.encoded(batch.column(1).slice(first, end - first).to_pylist())]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), *lists], names=["doc_id", "a", "b"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    text = F.col("text").cast("string").cast("binary").alias("text")
    return common.written(docs.select("doc_id", text).mapInArrow(run, f"doc_id {kind}, a array<int>, b array<int>"), "ids", 16 << 20)


def _streams(batch: pa.RecordBatch, a_sizes: np.ndarray, b_sizes: np.ndarray) -> Iterator[tuple[int, Stream]]:
    """Rows of ids, in chunks of about _TOKENS tokens, with the place of the first."""
    flat = [(c.flatten().to_numpy().astype(np.int64), c.offsets.to_numpy().astype(np.int64) - c.offsets[0].as_py()) for c in batch.columns[-2:]]
    for first, end in _chunks(np.diff(flat[0][1]).tolist(), _TOKENS):
        own = [(ids[starts[first] : starts[end]], starts[first : end + 1] - starts[first]) for ids, starts in flat]
        yield first, Stream(a_sizes, b_sizes, *own[0], *own[1])


def pair_documents(ids: DataFrame, a_sizes: np.ndarray, b_sizes: np.ndarray, most: int = 1 << 18) -> DataFrame:
    """(a, b, docs): in how many rows of encoded() each id pair is linked; written. A task
    adds up its chunks, and sends what it has when that is more than `most` pairs."""
    sizes = len(a_sizes), len(b_sizes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, size = [], [], 0

        def sent() -> pa.RecordBatch:
            key, where = np.unique(np.concatenate([np.zeros(0, dtype=np.int64), *keys]), return_inverse=True)
            n = np.bincount(where, np.concatenate([np.zeros(0), *counts]), len(key)).astype(np.int64)
            keys[:], counts[:] = [key], [n]
            return pa.RecordBatch.from_arrays([pa.array(key // sizes[1]), pa.array(key % sizes[1]), pa.array(n)], names=["a", "b", "docs"])

        for batch in batches:
            for _, s in _streams(batch, a_sizes, b_sizes):
                own = np.unique(s.links_of() * (sizes[0] * sizes[1]) + s.pairs(sizes[1])) % (sizes[0] * sizes[1])
                key, n = np.unique(own, return_counts=True)
                keys.append(key)
                counts.append(n)
                size += len(key)
                if size > 4 * most:
                    out = sent()
                    size = len(keys[0])
                    if size > most:
                        yield out
                        keys.clear()
                        counts.clear()
                        size = 0
        yield sent()

    found = ids.select("a", "b").mapInArrow(run, "a long, b long, docs long").groupBy("a", "b").agg(F.sum("docs").alias("docs"))
    return common.written(found, "pairs")


def _heavy(pairs: DataFrame, heavy: int) -> int:
    """The least count such that at most `heavy` pairs have as many: counts are told apart
    in steps of a sixteenth of a power of two."""
    step = F.floor(F.log2("docs") * 16)
    rows = sorted(pairs.groupBy(step.alias("s")).agg(F.count("*").alias("n"), F.min("docs").alias("least")).collect(), key=lambda r: -r["s"])  # at most 16 x 63 rows
    least, n = (1 << 63) - 1, 0
    for r in rows:
        n += r["n"]
        if n > heavy:
            break
        least = r["least"]
    return least


def alignments(docs: DataFrame, tokens: Callable[[], tuple[Tokens, Tokens]], heavy: int = 1_000_000) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of documents
    (doc_id, text). tokens() gives both tokenizers, in each task. An id pair's count is the number of rows that hold it linked; n_best counts links
    whose count is the highest of their A id, count_sum adds up the counts of all links.

    Null and empty texts, and texts that tokens don't give back byte by byte, have no
    tokens: zeros and an empty digest. Equal rows are rows each and count each; a null id
    stays null; an empty table gives no rows; very long texts are gone through in windows;
    columns other than these two are ignored."""
    spark = docs.sparkSession
    ids = encoded(docs, tokens)
    a_sizes, b_sizes = (t.sizes for t in tokens())
    sizes = len(a_sizes), len(b_sizes)
    pairs = pair_documents(ids, a_sizes, b_sizes)
    top = pairs.groupBy("a").agg(F.max("docs").alias("top"))
    counted = common.written(pairs.join(top.withColumnRenamed("a", "_a"), F.col("a") == F.col("_a")).select("a", "b", "docs", (F.col("docs") == F.col("top")).alias("best")), "pairs")
    least = _heavy(counted, heavy)
    of_heavy = counted.where(F.col("docs") >= least).toArrow()  # at most `heavy` rows
    key = of_heavy["a"].to_numpy().astype(np.int64) * sizes[1] + of_heavy["b"].to_numpy()
    order = np.argsort(key)
    shared = spark.sparkContext.broadcast((key[order], of_heavy["docs"].to_numpy()[order], of_heavy["best"].to_numpy()[order].astype(np.int64)))
    light = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("n", pa.int64())]))
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "light"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, docs_of, best_of = shared.value
        known, docs_of, best_of = pd.Index(known), np.r_[docs_of, 0], np.r_[best_of, 0]
        numbers = [[b"%d" % i for i in range(n)] for n in sizes]
        written = [x + end for own, ends in zip(numbers, (b",|", b",;")) for end in (ends[:1], ends[1:]) for x in own]
        for batch in batches:
            for start, s in _streams(batch, a_sizes, b_sizes):
                own = s.pairs(sizes[1])
                at = known.get_indexer(own)
                add = lambda v: np.diff(np.r_[0, np.cumsum(v)][s.link_start])
                rest: list[list] = [[] for _ in range(s.texts)]
                others = np.flatnonzero(at < 0)
                if len(others):
                    of = s.links_of()[others]
                    row, n = np.unique(np.stack([of, own[others]], axis=1), axis=0, return_counts=True)
                    for (i, k), times in zip(row.tolist(), n.tolist()):
                        rest[i].append({"a": k // sizes[1], "b": k % sizes[1], "n": times})
                columns = [s.na, s.nb, np.diff(s.cut_start), np.diff(s.link_start), add(best_of[at]), add(docs_of[at])]
                digests = s.groups(written, *sizes)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, s.texts), *(pa.array(c, pa.int64()) for c in columns), pa.array(digests, pa.string()), pa.array(rest, light)], names=names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    longs = ", ".join(f"{n} long" for n in names[1:7])
    found = ids.mapInArrow(run, f"doc_id {kind}, {longs}, groups_sha256 string, light array<struct<a: int, b: int, n: bigint>>")
    found = common.written(found.withColumn("_row", F.monotonically_increasing_id()), "alignments")
    if counted.where(F.col("docs") < least).limit(1).count():
        links = found.select("_row", F.explode("light").alias("x")).select("_row", "x.*")
        few = counted.where(F.col("docs") < least).select(F.col("a").alias("_a"), F.col("b").alias("_b"), "docs", "best")
        sums = links.join(few, (F.col("a") == F.col("_a")) & (F.col("b") == F.col("_b"))).groupBy(F.col("_row").alias("_of"))
        sums = sums.agg(F.sum(F.col("n") * F.col("docs")).alias("_sum"), F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("_best"))
        found = found.join(sums, F.col("_row") == F.col("_of"), "left").withColumn("n_best", F.col("n_best") + F.coalesce("_best", F.lit(0))).withColumn("count_sum", F.col("count_sum") + F.coalesce("_sum", F.lit(0)))
    return found.select(*names[:-1])


def op13_byte_owner_alignment(spark, sf_dir: str) -> DataFrame:
    """The 50k byte-level BPE beside the 32k sentencepiece BPE, on all documents."""
    import public_tokenizers

    paths = [public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model")]
    return alignments(common.table(spark, sf_dir, "documents"), lambda: (byte_bpe(*paths[:2]), piece_bpe(paths[2])))
