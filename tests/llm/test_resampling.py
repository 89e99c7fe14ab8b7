"""Importance resampling against plain counting of n-grams as strings."""

import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter

import pytest

from strandlake.llm import common, resampling

DATA = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features(text):
    w = WORD.findall((text or "").translate(LOW))
    return len(w), [" ".join(w[i : i + m]) for m in (1, 2, 3) for i in range(len(w) - m + 1)]


def buckets(found):
    return Counter(zlib.crc32(f.encode()) % 10000 for f in found)


def brute(rows, target, percent=5, least=20):
    """Sorted rows (doc_id, n_features, weight, score, rank)."""
    own, s, t = [(d, *features(x)) for d, x in rows], Counter(), Counter()
    for _, _, f in own:
        s += buckets(f)
    for x in target:
        t += buckets(features(x)[1])
    whole_s, whole_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (whole_s + 10000) / ((s[b] + 1) * (whole_t + 10000)))) for b in range(10000)]
    out = []
    for d, n, f in own:
        weight = sum(gain[b] * c for b, c in buckets(f).items())
        h = int(hashlib.sha256(f"42:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append([d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is not None, r[0], r[5]))
    for i, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = i + 1
    return sorted(map(str, (tuple(r[:5]) for r in out)))


def rows_of(df):
    return sorted(str(tuple(r)) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_op11_equals_brute_force(spark):
    rows = [(r["doc_id"], r["text"]) for r in common.table(spark, DATA, "documents").collect()]
    target = [r["text"] for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    assert rows_of(resampling.op11_importance_resampling(spark, DATA)) == brute(rows, target)


def odd_rows():
    rng = random.Random(3)
    text = lambda n: rng.choice([" ", "-", "\n"]).join(rng.choice("Ab cd ef gh é1 漢 x99 zz".split()) for _ in range(n))
    rows = [(i, text(rng.randint(0, 60))) for i in range(80)]
    copies = text(30)
    rows += [(200 + i, copies) for i in range(40)] + [(300, None), (301, ""), (302, " .,"), (303, "one"), (304, "Two words"), (None, text(25)), (305, "w" * 100 + " a b " + "v" * 64 + " " + text(20))]
    return rows + [(306, text(3000)), (5, rows[5][1]), (5, text(40))]


def test_odd_rows_and_pieces(spark, monkeypatch):
    rows = odd_rows()
    docs = spark.createDataFrame([(d, t, "k", 1, 2, 3) for d, t in rows], "doc_id long, text string, key string, copies int, n int, rank int")
    target = spark.createDataFrame([("cd ef gh", 1), (None, 2), ("", 3), ("cd ef gh", 4)], "text string, weight int")
    got = resampling.resampled(docs, target, percent=30, least_words=20)
    assert rows_of(got) == brute(rows, ["cd ef gh", None, "", "cd ef gh"], 30)
    assert resampling.resampled(docs.limit(0), target).count() == 0
    assert rows_of(resampling.resampled(docs, target.limit(0), percent=100, least_words=0)) == brute(rows, [], 100, 0)
    texts = [(t or "").encode() for _, t in rows]
    whole = resampling.counted(texts, 3, 10000)
    monkeypatch.setattr(resampling, "_PIECE", 50)
    monkeypatch.setattr(resampling, "_CHUNK", 70)
    assert all((a == b).all() for a, b in zip(whole, resampling.counted(texts, 3, 10000)))


def test_the_cut_is_exact_however_scores_lie(spark):
    rng = random.Random(8)
    scores = [10**9] * 3 + [rng.randint(-50, 50) for _ in range(300)] + [-(10**10)] * 5
    df = spark.createDataFrame([(i, 20 if i % 7 else 19, 1, 1, s) for i, s in enumerate(scores)], "doc_id long, n_words long, n_features long, weight long, score long")
    able = sorted((-s, i) for i, s in enumerate(scores) if i % 7)
    for k in (0, 1, 3, 50, len(able)):
        got = {r["doc_id"]: r["rank"] for r in resampling.drawn(df, k, 20, bins=8).collect()}
        assert got == {i: None for i in range(len(scores))} | {i: r + 1 for r, (_, i) in enumerate(able[:k])}


def test_crcs_of_joined_words():
    rng = random.Random(1)
    words = [bytes(rng.choice(b"abc019\xc3\xa9") for _ in range(rng.choice([1, 2, 5, 9, 62, 63, 64, 65, 200]))) for _ in range(300)]
    for m, crc in enumerate(resampling.ngram_crcs(words, 4)):
        assert all(int(crc[i]) == zlib.crc32(b" ".join(words[i - m : i + 1])) for i in range(m, len(words)))
    assert [len(x) for x in resampling.ngram_crcs([b"a"], 3)] == [1, 1, 1]
