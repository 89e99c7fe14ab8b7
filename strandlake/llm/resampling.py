"""Target-distribution importance resampling over hashed n-grams.

Identical texts are collapsed first: documents are grouped by their full text, with a
partial count before the shuffle, so a text of a third of all documents is one row a task.
Each distinct text is turned into counts of hashed n-grams once (at most `buckets` entries,
however long it is). Corpus counts are these times the text's multiplicity, summed by task
into one vector of `buckets` numbers and then by bucket. A text's weight is the sum of the
gains of its n-grams; weights are joined back to documents by the text's SHA-256 (texts of
very many documents by broadcast), and only then comes the noise of the document's id.

The draw is exact: a histogram of scores, refined where the cut falls, tells which scores
can't be drawn, and only the rest is sorted, in ranges.

CRCs of n-grams aren't taken string by string: CRC-32 is linear, so that of two joined
strings follows from both CRCs and the second one's length by four table lookups, for all
words of a batch at once.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.operators.stats import ranked

from . import common

#: A-Z to a-z; 0-9, a-z and all bytes beyond ASCII stay; the rest parts words.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_CHUNK = 1 << 18  # words that are hashed together
_PIECE = 1 << 21  # bytes of a very long text that become words at once
_SHORT = 63  # words of up to so many bytes have tables; n-grams with longer ones are hashed as strings


def _shift_tables(most: int) -> np.ndarray:
    """[n, k, b]: what byte k (from the lowest) with value b of a CRC-32 becomes after n
    zero bytes."""
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = np.where(step & 1, (step >> 1) ^ np.uint32(0xEDB88320), step >> 1)
    out = np.empty((most + 1, 4, 256), dtype=np.uint32)
    out[0] = np.arange(256, dtype=np.uint32) << (8 * np.arange(4, dtype=np.uint32))[:, None]
    for n in range(most):
        out[n + 1] = (out[n] >> 8) ^ step[out[n] & 255]
    return out


_SHIFTS = _shift_tables(_SHORT + 1)
_FLAT = _SHIFTS.ravel()
#: CRC of a space moved on by n bytes.
_SPACED = np.bitwise_xor.reduce([_SHIFTS[:, k, (zlib.crc32(b" ") >> 8 * k) & 255] for k in range(4)])


def _shifted(crc: np.ndarray, n: np.ndarray) -> np.ndarray:
    """CRCs moved on by n bytes each."""
    base = n << 10
    c = crc.astype(np.int64)
    return _FLAT[base + (c & 255)] ^ _FLAT[base + 256 + (c >> 8 & 255)] ^ _FLAT[base + 512 + (c >> 16 & 255)] ^ _FLAT[base + 768 + (c >> 24)]


def ngram_crcs(words: list[bytes], n: int) -> list[np.ndarray]:
    """CRC-32 of all runs of 1, 2, ... n consecutive words, joined by a space: an array for
    each size, by the run's last word; its first entries, where no run ends, mean nothing."""
    crc = np.fromiter(map(zlib.crc32, words), np.uint32, len(words))
    size = np.fromiter(map(len, words), np.int64, len(words))
    long_ = size > _SHORT
    size = np.minimum(size, _SHORT)
    spaced, out = _SPACED[size] ^ crc, [crc]
    for m in range(1, n):
        run = np.zeros_like(crc)
        run[m:] = _shifted(out[-1][m - 1 : -1], size[m:] + 1) ^ spaced[m:]
        out.append(run)
    for i in np.flatnonzero(long_).tolist():
        for m in range(1, n):
            for end in range(max(i, m), min(i + m + 1, len(words))):
                out[m][end] = zlib.crc32(b" ".join(words[end - m : end + 1]))
    return out


def _long_counts(data: bytes, n: int, buckets: int) -> tuple[int, np.ndarray]:
    """Words of a folded text and its counts by bucket, piece by piece."""
    total, counts, at, before = 0, np.zeros(buckets, dtype=np.int64), 0, []
    while at < len(data):
        end = data.find(b" ", at + _PIECE)
        end = len(data) if end < 0 else end
        own = data[at:end].split()
        at = end
        if own:
            start, own = len(before), before + own
            for m, crc in enumerate(ngram_crcs(own, n)):
                counts += np.bincount(crc[max(start, m) :] % np.uint32(buckets), minlength=buckets)
            total += len(own) - start
            before = own[max(0, len(own) - n + 1) :]
    return total, counts


def counted(texts: list[bytes], n: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(words, offsets, bucket, count): counts of text i stand at offsets[i] to
    offsets[i + 1], by ascending bucket."""
    total = np.zeros(len(texts), dtype=np.int64)
    parts: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    chunks: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    held: list[tuple[int, list[bytes]]] = []
    size = 0

    def flush() -> None:
        nonlocal size
        if size:
            of = np.repeat([i for i, _ in held], [len(w) for _, w in held])
            keys = []
            for m, crc in enumerate(ngram_crcs([x for _, w in held for x in w], n)):
                whole = of[m:] == of[: len(of) - m]
                keys.append((of[m:] * buckets + crc[m:] % np.uint32(buckets))[whole])
            key, times = np.unique(np.concatenate(keys), return_counts=True)
            chunks.append((key // buckets, key % buckets, times))
        held.clear()
        size = 0

    for i, text in enumerate(texts):
        data = text.translate(FOLD)
        if len(data) > _PIECE:
            total[i], counts = _long_counts(data, n, buckets)
            at = np.flatnonzero(counts)
            parts[i] = (at, counts[at])
            continue
        own = data.split()
        total[i] = len(own)
        held.append((i, own))
        size += len(own)
        if size >= _CHUNK:
            flush()
    flush()
    for i, (at, counts) in parts.items():
        chunks.append((np.full(len(at), i), at, counts))
    of, bucket, count = map(np.concatenate, zip(*chunks)) if chunks else (np.zeros(0, dtype=np.int64),) * 3
    if parts:  # long texts come last; put them in their place
        order = np.argsort(of, kind="stable")
        of, bucket, count = of[order], bucket[order], count[order]
    return total, np.searchsorted(of, np.arange(len(texts) + 1)), bucket, count


_TEXTS = "key binary, copies long, n_words long, bucket array<int>, n array<int>"


def distinct_texts(docs: DataFrame, n: int = 3, buckets: int = 10_000) -> DataFrame:
    """(key, copies, n_words, bucket, n): each different text once, by its SHA-256, with
    the number of its rows and the counts of its n-grams; written. A null text is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, offsets, bucket, count = counted([x.as_py() or b"" for x in batch.column(2)], n, buckets)
            lists = [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(v.astype(np.int32))) for v in (bucket, count)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(words), *lists], names=["key", "copies", "n_words", "bucket", "n"])

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    whole = docs.select(text.alias("text")).groupBy("text").agg(F.count("*").alias("copies"))
    return common.written(whole.select(_key(F.col("text")).alias("key"), "copies", F.col("text").cast("binary").alias("text")).mapInArrow(run, _TEXTS), "texts")


def _key(text):
    return F.unhex(F.sha2(text, 256))


def bucket_counts(texts: DataFrame, buckets: int = 10_000) -> DataFrame:
    """(bucket, n): over distinct_texts(), counts times copies; written. Each task sends
    one vector's entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            lists, counts = batch.column(1), batch.column(2).flatten().to_numpy(zero_copy_only=False)
            sizes = np.diff(lists.offsets.to_numpy())
            times = counts.astype(np.int64) * np.repeat(batch.column(0).to_numpy(), sizes)
            np.add.at(total, lists.flatten().to_numpy(), times)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    return common.written(texts.select("copies", "bucket", "n").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")), "counts")


def gains(corpus: DataFrame, target: DataFrame, buckets: int = 10_000, scale: int = 1000) -> DataFrame:
    """(bucket, gain) from both bucket_counts(): `scale` times the logarithm of the ratio
    of smoothed shares, rounded down. Buckets that neither holds have one too."""
    both = corpus.sparkSession.range(buckets).select(F.col("id").alias("bucket")).join(corpus.select("bucket", F.col("n").alias("s")), "bucket", "left").join(target.select("bucket", F.col("n").alias("t")), "bucket", "left")
    s, t = (F.coalesce(c, F.lit(0)).cast("double") for c in ("s", "t"))
    whole_s, whole_t = (float(c.agg(F.sum("n").alias("n")).first()["n"] or 0) for c in (corpus, target))
    ratio = (t + 1) * (whole_s + buckets) / ((s + 1) * (whole_t + buckets))
    return both.select("bucket", F.floor(scale * F.log(ratio)).cast("long").alias("gain"))


def weights(texts: DataFrame, gain: np.ndarray) -> DataFrame:
    """(key, copies, n_words, weight): sums of gains over a text's n-grams."""
    shared = texts.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            one = shared.value[lists.flatten().to_numpy()] * batch.column(4).flatten().to_numpy(zero_copy_only=False)
            sums = np.r_[0, np.cumsum(one)][lists.offsets.to_numpy() - lists.offsets[0].as_py()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(np.diff(sums))], names=["key", "copies", "n_words", "weight"])

    return texts.select("key", "copies", "n_words", "bucket", "n").mapInArrow(run, "key binary, copies long, n_words long, weight long")


def importance_scores(docs: DataFrame, target: DataFrame, n: int = 3, buckets: int = 10_000, seed: int = 42, scale: int = 1000) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) of documents (doc_id, text) for the
    distribution of the texts of `target` (text); written.

    Null and empty texts have no n-grams and weight 0; a text of one word has one. Equal
    rows are rows each, with equal scores; a null id counts as the empty text in the noise.
    An empty target makes all n-grams likelier than the corpus says by smoothing alone; an
    empty corpus gives no rows. Very long texts are counted in pieces; columns other than
    these are ignored."""
    texts = distinct_texts(docs, n, buckets)
    of_target = distinct_texts(target, n, buckets)
    found = gains(bucket_counts(texts, buckets), bucket_counts(of_target, buckets), buckets, scale).collect()  # `buckets` rows
    gain = np.zeros(buckets, dtype=np.int64)
    for r in found:
        gain[r["bucket"]] = r["gain"]
    weighed = common.written(weights(texts, gain).withColumnRenamed("key", "_of"), "weights")
    rows = common.written(docs.select("doc_id", _key(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("_key")), "keys")
    joined = common.hot_split_join(rows, weighed, "_key", "_of", "copies", rows.count())
    features = sum((F.greatest(F.col("n_words") - m, F.lit(0)) for m in range(1, n)), F.col("n_words"))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-scale * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")
    return common.written(joined.select("doc_id", "n_words", features.alias("n_features"), "weight", (F.col("weight") + noise).alias("score")), "scores")


def drawn(scores: DataFrame, k: int, least_words: int, bins: int = 4096) -> DataFrame:
    """`scores` with rank 1, 2, ... k of the highest scores among rows of at least
    `least_words` words, ties to the smaller id; null for all others. Rows of one id and
    score go by their other numbers."""
    able = scores.where(F.col("n_words") >= least_words)
    edge, above, top = None, 0, None  # scores >= edge may be drawn; `above` of them are >= top
    while k > 0:
        inside = able if edge is None else able.where((F.col("score") >= edge) & (F.col("score") < top))
        r = inside.agg(F.min("score").alias("a"), F.max("score").alias("b")).first()
        if r["a"] is None:
            break
        width = (r["b"] - r["a"]) // bins + 1
        histogram = sorted(inside.groupBy(F.floor((F.col("score") - r["a"]) / width).alias("bin")).agg(F.count("*").alias("n")).collect(), key=lambda x: -x["bin"])  # at most `bins` rows
        for row in histogram:
            edge, top = r["a"] + row["bin"] * width, r["a"] + (row["bin"] + 1) * width
            if above + row["n"] >= k:
                break
            above += row["n"]
        if width == 1 or row["n"] <= k:
            break
    near = (F.col("n_words") >= least_words) & (F.col("score") >= edge) if edge is not None else F.lit(False)
    rest = scores.where(~near).withColumn("rank", F.lit(None).cast("long"))
    order = [F.desc("score"), F.asc("doc_id"), F.asc("n_words"), F.asc("weight")]
    best = ranked(scores.where(near), *order)
    return best.withColumn("rank", F.when(F.col("rank") < k, F.col("rank") + 1)).unionByName(rest)


def resampled(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, n: int = 3, buckets: int = 10_000, seed: int = 42) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank): draw `percent` of the documents
    that have `least_words` words, without replacement, towards the target's distribution
    (the highest weights with Gumbel noise). Cases are those of importance_scores()."""
    scores = importance_scores(docs, target, n, buckets, seed)
    able = scores.where(F.col("n_words") >= least_words).count()
    return drawn(scores, percent * able // 100, least_words)


def op11_importance_resampling(spark, sf_dir: str) -> DataFrame:
    """Five percent of all documents drawn towards the benchmark texts."""
    found = resampled(common.table(spark, sf_dir, "documents"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")
