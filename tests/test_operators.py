"""Operators against brute force, literal simulations and known numbers."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandlake.functions import alphabet as A
from strandlake.functions import cigar as K
from strandlake.functions import codes as C
from strandlake.functions.scores import named, read_matrix
from strandlake.operators import align, bloom, chaining, edit, matches, minimizers, missing, partition, qgrams, ranges, sampling, sketch, stats, suffix_sort, suffixes


def seqs(spark, texts):
    return spark.createDataFrame([(i, f"h{i} x", t) for i, t in enumerate(texts)], "seq_id long, header string, sequence string")


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def random_dna(rng, n, letters="ACGT"):
    return "".join(rng.choice(letters) for _ in range(n))


# Functions.


@given(st.text("ACGT", min_size=1, max_size=40))
@settings(max_examples=60, deadline=None)
def test_window_hashes_roll(text):
    q = min(len(text), 7)
    r = C.ranks(text)
    got = C.window_hashes(r, q)
    for i in range(len(text) - q + 1):
        h = 0
        for c in text[i : i + q]:  # the rolling definition
            h = C.turned(h) ^ C.DNA_SEEDS["ACGT".index(c)]
        assert h == int(got[i])
    turned = C.window_hashes(C.ranks(text[::-1].translate(str.maketrans("ACGT", "TGCA"))), q)
    assert turned[::-1].tolist() == C.window_hashes(r, q, reverse=True).tolist()


def test_windows_with_wildcards_by_arrays(spark):
    """Every window, over chunks and batches; one column alone is made without the others
    (each window was a row with its characters, and an expression searched them)."""
    rng = random.Random(14)
    texts = [random_dna(rng, 200, "ACGTN"), "", None, "ACGT", "ACGTA", "acguN\nZ\u00c1\u20ac\U0001f600ACGT", "N" * 60, random_dna(rng, 33)]
    want = sorted((i, p, t[p : p + 5], sum(c not in "ACGTUacgtu" for c in t[p : p + 5])) for i, t in enumerate(texts) for p in range(len(t or "") - 4))
    d = seqs(spark, texts)
    whole = qgrams.windows_with_wildcards(d, 5)
    assert whole.dtypes == [("seq_id", "bigint"), ("pos", "bigint"), ("qgram", "string"), ("wildcards", "int")]
    for w in (whole, qgrams.windows_with_wildcards(d, 5, size=7, batch_chars=20), qgrams.windows_with_wildcards(d, 5, size=28)):
        assert rows(w) == want
    few = qgrams.windows_with_wildcards(d, 5, ("wildcards",))
    assert rows(few) == sorted((w[3],) for w in want)
    assert "Generate explode(sequence" not in few._jdf.queryExecution().executedPlan().toString()


def test_hash_columns_equal_arrays(spark):
    rng = random.Random(1)
    texts = [random_dna(rng, 50, "ACGTN") for _ in range(5)] + ["acgtuACGTU", "", "NN"]
    d = seqs(spark, texts)
    arrays = rows(qgrams.qgram_values(d, 5, reverse=True))
    g = qgrams.qgram_rows(d, 5)
    columns = g.select("seq_id", "range_start", "pos", C.hash_qgram(F.col("qgram"), 5), C.hash_qgram(A.reverse_complement(F.col("qgram")), 5))
    assert arrays == rows(columns) and arrays
    codes = g.select("seq_id", "range_start", "pos", C.code(F.col("qgram")), C.reverse_code(F.col("qgram")))
    assert rows(qgrams.qgram_values(d, 5, "code", reverse=True)) == rows(codes)
    with pytest.raises(ValueError):
        qgrams.qgram_values(d, 32, "code")


def test_seeded_hash_columns(spark):
    values = [0, 1, 255, 2**40 + 7, 2**63 - 1, -1]
    d = spark.createDataFrame([(v,) for v in values], "v long")
    for seed in (0, 5):
        got = [r[0] % 2**64 for r in d.select(C.seeded_fnv(F.col("v"), seed)).collect()]
        assert got == [C.seeded_fnv_int(v % 2**64, seed) for v in values]


def test_digests(spark):
    from strandlake.functions.digests import digest_sum, digests, wyhash

    texts = ["", "A", "ACGT", "ACGTACGTA", "C" * 16, "ACG" * 11, "GATTACA" * 40]
    assert len({wyhash(t.encode()) for t in texts}) == len(texts)
    assert wyhash(b"") == 0x93228A4DE0EEC5A2  # of the published test vectors
    got = digests(seqs(spark, texts)).orderBy("seq_id").collect()
    assert [r["digest"] % 2**64 for r in got] == [wyhash(t.encode()) for t in texts]
    assert digest_sum(seqs(spark, texts)).first()[0] == str(sum(wyhash(t.encode()) for t in texts) % 2**64)


def test_scalar_functions(spark):
    d = spark.createDataFrame([("ab|cd|ef gh", "ACGTNacgt", "abcxef", "abdxzf")], "h string, s string, u string, v string")
    one = d.select(
        A.short_header(F.col("h")), A.bar_header(F.col("h")), A.encode(F.col("s")), A.reverse_complement(F.col("s")), A.common_prefix(F.col("u"), F.col("v")), A.common_suffix(F.col("u"), F.col("v")),
        A.hamming(F.col("u"), F.col("v")), A.wrapped(F.col("s"), 4), A.wildcards_as_a(F.col("s")), A.char_rank(F.lit("u")), A.rank_char(F.lit(2)), A.bits_for(F.lit(8)), A.bits_for(F.lit(0)), A.substring_view(F.col("s"), F.lit(1), F.lit(3)),
    ).first()
    assert tuple(one) == ("ab|cd|ef", "cd", "012340123", "tgcaNACGT", 2, 1, 2, "ACGT\nNacg\nt", "ACGTAacgt", 3, "G", 4, 0, "CGT")
    assert spark.range(1).select(A.bar_header(F.lit("x|rest of it"))).first()[0] == "rest of it"
    assert spark.range(1).select(K.packed_operations(F.lit("3=1X2D"))).first()[0] == [3 << 4 | 7, 1 << 4 | 8, 2 << 4 | 2]
    with pytest.raises(ValueError):
        K.bit_score(F.lit(1), 5, 5)


# Ranges and q-grams.


def test_ranges_of_odd_texts(spark):
    d = seqs(spark, ["NNACGNNTT", "", "ACGT", "NNN", "aXu"])
    assert rows(ranges.ranges(d)) == [(0, 0, 2, 3, "ACG"), (0, 1, 7, 2, "TT"), (2, 0, 0, 4, "ACGT"), (4, 0, 0, 1, "a"), (4, 1, 2, 1, "u")]
    assert rows(ranges.wildcard_ranges(d)) == [(0, 0, 0, 2, "NN"), (0, 1, 5, 2, "NN"), (3, 0, 0, 3, "NNN"), (4, 0, 1, 1, "X")]
    assert rows(ranges.non_n_ranges(d, 3)) == [(0, 2, 4), (2, 0, 3), (4, 0, 2)]


@pytest.mark.parametrize("parts", [1, 2, 7])
def test_chunks_hold_every_qgram_once(spark, parts):
    rng = random.Random(2)
    d = seqs(spark, [random_dna(rng, 1000), random_dna(rng, 9), "ACG", random_dna(rng, 205, "ACGTN")]).repartition(parts)
    q, size = 10, 64
    chunks = ranges.chunked(d, size, q - 1)
    numbered = chunks.select((F.col("seq_id") * 1_000_000 + F.col("offset")).alias("seq_id"), "sequence")
    got = qgrams.qgram_values(numbered, q).select(F.expr("seq_id div 1000000"), (F.col("seq_id") % 1_000_000 + F.col("pos")), "value")
    assert rows(got) == rows(qgrams.qgram_values(d, q).select("seq_id", "pos", "value"))


# Sketches, missing words, minimizers.


def test_moments_are_near_the_truth(spark):
    rng = random.Random(3)
    texts = [random_dna(rng, 3000) for _ in range(6)]
    d = seqs(spark, texts + texts[:2])
    s = sketch.slots(qgrams.qgram_values(d, 16), 0, 20)
    truth = {}
    for t in texts + texts[:2]:
        for i in range(len(t) - 15):
            truth[t[i : i + 16]] = truth.get(t[i : i + 16], 0) + 1
    assert sketch.f0(s, 0, 20).first()[0] == pytest.approx(len(truth), rel=0.02)
    f = {r["i"]: r["f_i"] for r in sketch.moments_table(s, 0, 20).collect()}
    assert f[1] == pytest.approx(sum(v == 1 for v in truth.values()), rel=0.02) and f[2] == pytest.approx(sum(v == 2 for v in truth.values()), rel=0.05)
    with pytest.raises(Exception, match="no slot"):
        sketch.f0(sketch.slots(qgrams.qgram_values(d, 16), 0, 4), 0, 4).collect()
    with pytest.raises(ValueError):
        sketch.moments({1: 16}, 0, 4)
    halves = [sketch.slots(qgrams.qgram_values(d.where(F.col("seq_id") % 2 == i), 16), 0, 20) for i in (0, 1)]
    assert rows(sketch.merged(*halves).select("slot", "n")) == rows(s.select("slot", "n"))


def test_missing_words(spark):
    rng = random.Random(4)
    d = seqs(spark, [sampling.de_bruijn("ACGT", 4)])
    assert missing.missing_words(d, 4).count() == 0
    q, words = missing.shortest_missing(d)
    assert q == 5 and words.count() == 4**5 - 255
    texts = [random_dna(rng, 60) for _ in range(3)]
    seen = {t[i : i + 3] for t in texts for i in range(58)}
    seen |= {w[::-1].translate(str.maketrans("ACGT", "TGCA")) for w in seen}
    import itertools

    assert {r[0] for r in missing.missing_words(seqs(spark, texts), 3, both_strands=True).collect()} == {"".join(w) for w in itertools.product("ACGT", repeat=3)} - seen
    protein = missing.missing_words(seqs(spark, ["ACDEFGHIKLMNPQRSTVW"]), 1, A.PROTEIN)
    assert [r[0] for r in protein.collect()] == ["Y"]


def simulated_minimizers(values, starts, w):
    """A literal sliding deque over each range; positions count from the sequence."""
    out = set()
    for start, part in zip(starts, values):
        if len(part) < w:
            continue
        window = []
        for i, v in enumerate(part):
            pos = start + i
            while window and window[-1][0] > v:
                window.pop()
            window.append((v, pos))
            while window[0][1] + w <= pos:
                window.pop(0)
            if pos >= w - 1:
                out.add(window[0])
    return out


def test_minimizers_equal_a_deque(spark):
    rng = random.Random(5)
    for w in (1, 3, 6):
        texts = [random_dna(rng, 80, "ACGTACGTACGTN") for _ in range(15)]
        g = qgrams.qgram_values(seqs(spark, texts), 4, "code")
        want = set()
        for i, t in enumerate(texts):
            r = C.ranks(t)
            found = C.runs(r, 4, 4)
            for v, p in simulated_minimizers([C.window_codes(r[a:b], 4).tolist() for a, b in found], [a for a, _ in found], w):
                want.add((v, i, p))
        assert set(rows(minimizers.minimizers(g, w))) == want
        found = rows(minimizers.sequence_minimizers(seqs(spark, texts), 4, w))
        assert len(found) == len(set(found)) and set(found) == want


def test_least_in_windows_is_the_leftmost_least():
    rng = random.Random(8)
    for window in (1, 2, 3, 5, 8, 13):
        values = np.array([rng.randint(0, 5) for _ in range(60)])
        starts = np.sort(np.array([0] + [rng.randint(0, 59) for _ in range(4)]))
        run_start = starts[np.searchsorted(starts, np.arange(60), side="right") - 1]
        got = minimizers.least_in_windows(values, run_start, window)
        for i in range(60):
            low = max(run_start[i], i - window + 1)
            assert got[i] == low + int(np.argmin(values[low : i + 1]))


def test_protein_codes_of_14_residues_come_back(spark):
    words = ["".join(random.Random(i).choice(A.PROTEIN) for _ in range(14)) for i in range(20)] + [A.PROTEIN[-1] * 14]
    d = spark.createDataFrame([(w,) for w in words], "w string")
    assert [r[0] for r in d.select(C.decode_protein_code(C.code(F.col("w"), A.PROTEIN), 14)).collect()] == words


# Statistics and partitions.


def test_common_prefixes_come_back_from_their_small_forms(spark):
    rng = random.Random(15)
    texts = [random_dna(rng, n, "ab") for n in (1, 70, 130)] + ["a" * 300]
    d = spark.createDataFrame(list(enumerate(texts)), "seq_id long, sequence string")
    table = suffixes.common_prefixes(d)
    want = sorted((r["rank"], r["lcp"]) for r in table.collect())
    for most in (255, 3):
        small, large = suffixes.saturated(table, most)
        assert large.count() == sum(x >= most for _, x in want) and sorted(map(tuple, suffixes.restored(small, large).collect())) == want
    one = spark.createDataFrame([(0, "abracadabra" * 30)], "seq_id long, sequence string")
    table = suffixes.common_prefixes(one)
    words = suffixes.prefix_bits(table)
    assert words.count() <= 2 * 330 / 64 + 2
    assert sorted(map(tuple, suffixes.prefix_of_bits(words).collect())) == sorted((r["seq_id"], r["pos"], r["lcp"]) for r in table.collect())


def test_bits_are_selected_by_their_rank(spark):
    rng = random.Random(16)
    words = [rng.getrandbits(63) if rng.random() < 0.7 else 0 for _ in range(90)]
    ranks, ones, total = [], [], 0
    for i, x in enumerate(words):
        ones += [(i, b) for b in range(64) if x >> b & 1]
        total += x.bit_count()
        ranks.append((i, x, total))
    d = spark.createDataFrame(ranks, "position long, bits long, rank long")
    got = {r["k"]: (r["position"], r["bit"]) for r in stats.bit_select(d, spark.range(1, total + 5).select(F.col("id").alias("k"))).collect()}
    assert got == {k + 1: x for k, x in enumerate(ones)}


def test_files_of_one_name(spark):
    d = spark.createDataFrame([("/a/x.fna",), ("/b/x.fna",), ("y.fna",)], "path string")
    assert rows(stats.duplicate_files(d)) == [("x.fna", 2)]


def test_extensions_of_pairs(spark):
    u = random_dna(random.Random(3), 200)
    v = u[:90] + "A" + u[90:150] + random_dna(random.Random(4), 50)
    d = spark.createDataFrame([(1, u, v), (2, u, u), (3, None, u)], "id long, left string, right string")
    assert rows(edit.greedy_extensions(d)) == [(1, *edit.greedy_extension(u, v)), (2, 200, 200, 0), (3, 0, 0, 0)]


def test_extensions_to_both_sides_are_one_match(spark):
    rng = random.Random(22)
    u, pre, post = random_dna(rng, 240), random_dna(rng, 50), random_dna(rng, 60)
    v = pre + u[20:90] + "A" + u[90:240] + post
    i, k = 130, 20
    j = v.index(u[i : i + k])
    seeds = spark.createDataFrame([(1, u, v, i, j, k), (2, u, u, 7, 7, 12), (3, None, None, 0, 0, 0)], "id long, left string, right string, left_pos int, right_pos int, length int")
    got = {r[0]: tuple(r)[1:] for r in edit.combined_extensions(seeds).collect()}
    before, after = edit.greedy_extension(u[:i][::-1], v[:j][::-1]), edit.greedy_extension(u[i + k :], v[j + k :])
    assert got[1] == (i - before[0], before[0] + k + after[0], j - before[1], before[1] + k + after[1], before[2] + after[2])
    assert got[1][0] <= 25 and got[1][1] >= 215 and got[2] == (0, 240, 0, 240, 0) and got[3] == (0, 0, 0, 0, 0)
    with pytest.raises(Exception, match="no exact match"):
        edit.combined_extensions(spark.createDataFrame([(1, "AC", "AG", 0, 0, 2)], "id long, left string, right string, left_pos int, right_pos int, length int")).collect()


def plain_extension(u, v, percent, history, least_percent):
    """greedy_extension() a character at a time."""
    bits, least = (1 << history) - 1, history * least_percent // 100

    def slide(i, j, h):
        while i < len(u) and j < len(v) and u[i] == v[j]:
            i, j, h = i + 1, j + 1, (h << 1 | 1) & bits
        return i, h

    def polished(h, length):
        total = 0.0
        for k in range(min(history, length)):
            total += 2 * percent if h >> k & 1 else percent - 200.0
            if total < 0:
                return False
        return True

    i, h = slide(0, 0, 0)
    front, best, d = {0: (i, h)}, (i, i, 0), 0
    while front:
        d, fresh = d + 1, {}
        for k in range(min(front) - 1, max(front) + 2):
            found = [(front[x][0] + y, front[x][1] << 1 & bits) for x, y in ((k, 1), (k - 1, 1), (k + 1, 0)) if x in front]
            found = [(i, h) for i, h in found if i <= len(u) and 0 <= i - k <= len(v)]
            if found:
                i, h = max(found)
                i, h = slide(i, i - k, h)
                if 2 * i - k < 2 * history or h.bit_count() >= least:
                    fresh[k] = (i, h)
                    if 2 * i - k > best[0] + best[1] and polished(h, max(i, i - k)):
                        best = (i, i - k, d)
        front = fresh
        if d * 200.0 > percent * (len(u) + len(v)) + 200.0:
            break
    return best


def test_extension_by_slices_equals_one_by_characters():
    rng = random.Random(23)
    for _ in range(60):
        u = random_dna(rng, rng.randint(0, 150), "AC")
        v = "".join(c if rng.random() > 0.1 else rng.choice(["", "A", c + "C"]) for c in u) + random_dna(rng, rng.randint(0, 20))
        for options in ((20.0, 64, 55), (10.0, 16, 30)):
            assert edit.greedy_extension(u, v, *options) == plain_extension(u, v, *options)


def test_functions_for_sql(spark):
    from strandlake.functions import surfaces

    surfaces.register(spark)
    rng = random.Random(17)
    texts = [random_dna(rng, 90, "ACGTN") for _ in range(6)] + [None]
    d = seqs(spark, texts)
    d.createOrReplaceTempView("surface_sequences")
    got = spark.sql("SELECT m.hash, s.seq_id, m.pos FROM surface_sequences s, LATERAL minimizers(s.sequence, 4, 3) m")
    assert rows(got) == rows(minimizers.sequence_minimizers(d, 4, 3)) and got.count()
    hashes = qgrams.qgram_values(seqs(spark, [random_dna(rng, 3000)]), 12, columns=("value",))
    hashes.createOrReplaceTempView("surface_hashes")
    want = sketch.f0(sketch.slots(hashes, 2, 22), 2, 22).first()["f0"]
    assert spark.sql("SELECT sketch_f0(value) AS f FROM surface_hashes").first()["f"] == pytest.approx(want)


def test_blosum62_is_whole():
    table = named("blosum62")
    at = {c: i for i, c in enumerate(table.characters)}
    score = lambda a, b: table.table[at[a], at[b]]
    assert len(at) == 24 and (table.table == table.table.T).all()
    assert (score("B", "D"), score("Z", "E"), score("X", "X"), score("*", "*"), score("*", "A"), score("W", "W")) == (4, 4, -1, 1, -4, 11)
    assert table.table[table.encode("J")[0]].max() == -4


def test_pattern_ends_equal_full_tables(spark):
    rng = random.Random(14)
    texts = [random_dna(rng, rng.randint(0, 40), "abc") for _ in range(60)] + ["", "abcabc" * 20, "\U0001f600ab\U0001f600"]
    patterns = ["ab", "abca", "ccba", "a" * 6, "abcabcabcabc", "\U0001f600a"]

    def ends(text, pattern, most):
        row = [0] * (len(text) + 1)
        for i, c in enumerate(pattern):
            new = [i + 1]
            for j, t in enumerate(text):
                new.append(min(row[j] + (c != t), row[j + 1] + 1, new[j] + 1))
            row = new
        return sum(x <= most for x in row[1:])

    for most in (0, 1):
        want = {p: sum(ends(t, p, most) for t in texts) for p in patterns}
        assert all(edit.batch_hits(texts, p, most) == want[p] for p in patterns)
        assert all(edit.pattern_hits(t, "abca", most) == ends(t, "abca", most) for t in texts)
        d = spark.createDataFrame([(t,) for t in [*texts, None]], "sequence string").repartition(3)
        listed = spark.createDataFrame([(p,) for p in patterns + patterns[:2]], "pattern string")
        for at_once in (10_000, 2):
            assert {r["pattern"]: r["hits"] for r in edit.pattern_counts(d, listed, most, at_once).collect()} == want
    with pytest.raises(ValueError):
        edit.batch_hits(["a"], "abc", 2)


def test_ranked_is_a_global_order(spark):
    rng = random.Random(6)
    d = spark.createDataFrame([(i, rng.randint(0, 50)) for i in range(500)], "seq_id long, k int").repartition(7)
    got = sorted((r["rank"], r["k"], r["seq_id"]) for r in stats.ranked(d, "k", "seq_id").collect())
    assert [g[0] for g in got] == list(range(500)) and [g[1:] for g in got] == sorted(g[1:] for g in got)


def test_ranks_of_many_partitions_are_whole(spark):
    """A second plan of a sampled range sort has other bounds: ranks must not depend on it."""
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        n = 300_000
        d = spark.range(n).select((F.col("id") * 7919 % 300_007).alias("k"))
        assert [r["rank"] for r in stats.ranked(d, "k").orderBy("k").select("rank").collect()] == list(range(n))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


@given(st.lists(st.integers(0, 30), max_size=40), st.integers(1, 60))
@settings(max_examples=15, deadline=None)
def test_greedy_parts_equal_a_fold(spark, lengths, limit):
    d = spark.createDataFrame([(i, "x" * n) for i, n in enumerate(lengths)], "seq_id long, sequence string")
    want, part, filled = [], 0, 0
    for i, n in enumerate(lengths):
        if filled >= limit:
            part, filled = part + 1, 0
        want.append((i, n, part))
        filled += n
    assert rows(partition.greedy_parts(d, limit)) == want


def test_tiles_cover_the_matrix_once(spark):
    for m, n, cut in ((7, 5, 2), (10, 10, 3), (1, 1, 4), (9, None, 4)):
        seen = []
        for r in partition.tiles(spark, m, n, cut).collect():
            if n is None and not r["columns"]:
                seen += [(a, b) for a in range(r["i"], r["i"] + r["rows"]) for b in range(a + 1, r["i"] + r["rows"])]
            else:
                seen += [(a, b) for a in range(r["i"], r["i"] + r["rows"]) for b in range(r["j"], r["j"] + r["columns"])]
        want = [(a, b) for a in range(m) for b in range(n)] if n is not None else [(a, b) for a in range(m) for b in range(a + 1, m)]
        assert sorted(seen) == want


def test_offsets_and_positions(spark):
    texts = ["ACG", "", "T" * 5, "GG"]
    d = seqs(spark, texts)
    offsets = stats.concatenated_offsets(d)
    joined = "|".join(texts)
    got = rows(suffixes.positions_to_sequences(spark.range(len(joined)).select(F.col("id").alias("pos")), offsets))
    assert [(p, texts[s][r]) for p, s, r in got] == [(i, c) for i, c in enumerate(joined) if c != "|"]


# Matches and chains.


def test_maximum_intervals_equal_the_definition(spark):
    rng = random.Random(7)
    data = [(g, i, rng.randint(0, 40), rng.randint(1, 12), float(rng.randint(1, 6))) for g in range(8) for i in range(25)]
    got = {(r["group"], r["id"]) for r in matches.maximum_intervals(spark.createDataFrame(data, "group long, id long, start long, len long, weight double")).collect()}
    want = set()
    for g in range(8):
        own = [x for x in data if x[0] == g]
        for p in range(60):
            over = [x for x in own if x[2] <= p < x[2] + x[3]]
            want |= {(g, x[1]) for x in over if x[4] == max(y[4] for y in over)}
    assert got == want
    a = spark.createDataFrame(data, "group long, id long, start long, len long, weight double")
    pairs = {tuple(r) for r in matches.overlaps(a, a, "group", 8).collect()}
    assert pairs == {(x[0], x[1], y[1], min(x[2] + x[3], y[2] + y[3]) - max(x[2], y[2])) for x in data for y in data if x[0] == y[0] and min(x[2] + x[3], y[2] + y[3]) > max(x[2], y[2])}


def test_matches_are_maximal(spark):
    rng = random.Random(8)
    core = random_dna(rng, 60)
    a = [random_dna(rng, 30) + core + random_dna(rng, 20), random_dna(rng, 80)]
    b = [random_dna(rng, 10) + core[5:50] + random_dna(rng, 30), core + "N" + core]
    x, y = seqs(spark, a), seqs(spark, b)
    want = set()
    for i, u in enumerate(a):
        for j, v in enumerate(b):
            for p in range(len(u)):
                for q in range(len(v)):
                    if p and q and u[p - 1] == v[q - 1] != "N":
                        continue
                    n = 0
                    while p + n < len(u) and q + n < len(v) and u[p + n] == v[q + n] != "N":
                        n += 1
                    if n >= 20:
                        want.add((i, j, p + n - 1, q + n - 1, n))
    gx, gy = qgrams.qgram_values(x, 12, "code"), qgrams.qgram_values(y, 12, "code")
    assert set(rows(matches.maximal_matches(gx, gy, 12, 20))) == want and want
    seeds = matches.seed_matches(minimizers.minimizers(gx, 5), minimizers.minimizers(gy, 5))
    assert set(rows(matches.extended_matches(seeds, x, y, 12, 20))) == want


def shuffled(spark, work) -> int:
    """Bytes that work() writes to shuffles."""
    context = spark.sparkContext
    store, bus, make = context._jsc.sc().statusStore(), context._jsc.sc().listenerBus(), context._jvm.java.util.ArrayList

    def stages():
        bus.waitUntilEmpty(30_000)
        every = store.stageList(make(), False, False, context._gateway.new_array(context._jvm.double, 0), make())
        return {(x.stageId(), x.attemptId()): x.shuffleWriteBytes() for x in (every.apply(i) for i in range(every.size()))}

    before = stages()
    work()
    return sum(n for k, n in stages().items() if k not in before)


def test_seeds_shuffle_only_what_the_reference_holds(spark):
    """All rows of a large query went through two shuffles, for a reference of a few."""
    few = spark.range(50).select((F.col("id") * 4000).alias("hash"), F.col("id").alias("seq_id"), F.lit(7).cast("long").alias("pos"))
    many = spark.range(200_000).select(F.col("id").alias("hash"), (F.col("id") % 100).alias("seq_id"), F.col("id").alias("pos"))
    found = []
    size = shuffled(spark, lambda: found.extend(rows(matches.seed_matches(few, many).select("ref_id", "query_id", "ref_pos", "query_pos", "hash"))))
    assert sorted(found) == [(i, 4000 * i % 100, 7, 4000 * i, 4000 * i) for i in range(50)]
    assert size < 200_000  # was 1,024,582


def test_chains_of_a_small_reference_shuffle_little(spark):
    rng = random.Random(12)
    core = random_dna(rng, 80)
    texts = [random_dna(rng, 2000) for _ in range(60)]
    texts[7] = texts[7][:500] + core[:40] + "N" + core[40:] + texts[7][500:]
    reference, query = (qgrams.qgram_values(seqs(spark, t), 16, "code") for t in ([core], texts))
    found = []
    size = shuffled(spark, lambda: found.extend(rows(chaining.local_chains(matches.maximal_matches(reference, query, 16, 20)).select("ref_id", "query_id", "chain", "ref_start", "ref_end"))))
    assert found == [(0, 7, 0, 0, 79)]
    assert size < 200_000  # was 2,656,373


def test_seeds_of_a_diagonal_are_dealt_out_once(spark):
    g = qgrams.qgram_values(seqs(spark, ["ACGTACGGT" * 4]), 12, "code")
    plan = matches.maximal_matches(g, g, 12, 20)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(ref_id") == 1, plan


def test_seeds_filter_passes_or_leaves_all(spark):
    """With a filter of 64 bits some values pass it by chance, with many known none is left out."""
    values = spark.range(2000).select(F.col("id").alias("hash"), F.col("id").alias("pos"))
    for known, whole in ((5, False), (100, True)):
        got = {r[0] for r in rows(matches.within(values, spark.range(known).select(F.col("id").alias("hash")), bits=6))}
        assert got >= set(range(known)) and (len(got) == 2000) == whole


@pytest.mark.parametrize("local", [False, True])
def test_chains_equal_all_chains(local):
    rng = random.Random(9)
    for _ in range(60):
        m = [(rng.randint(0, 30), rng.randint(1, 6), rng.randint(0, 30), rng.randint(1, 6), float(rng.randint(1, 20))) for _ in range(9)]
        best = [x[4] for x in m]
        for j in sorted(range(9), key=lambda k: m[k][0]):
            for i in range(9):
                pe, se = m[i][0] + m[i][1] - 1, m[i][2] + m[i][3] - 1
                if pe < m[j][0] and se < m[j][2]:
                    gap = (m[j][0] - pe + m[j][2] - se) if local else 0
                    best[j] = max(best[j], best[i] + m[j][4] - gap)
        score, chain = chaining.best_chain(*(np.array(c) for c in zip(*m)), local)
        assert score == max(best)
        total = 0.0
        for k, j in enumerate(chain):
            if k:
                i = chain[k - 1]
                pe, se = m[i][0] + m[i][1] - 1, m[i][2] + m[i][3] - 1
                assert pe < m[j][0] and se < m[j][2]
                total -= (m[j][0] - pe + m[j][2] - se) if local else 0
            total += m[j][4]
        assert total == score


def test_segment_chains_share_no_match():
    starts = np.array([0, 30, 60, 61, 500])
    chains = chaining.segment_chains(starts, np.array([0, 31, 60, 200, 510]), np.array([20, 20, 20, 20, 20]), 4)
    used = [i for _, c in chains for i in c]
    assert sorted(used) == list(range(5)) and chains[0][1][:3] == [0, 1, 2]


# Alignments and edits.


def full_local(u, v, table, o, e):
    h = np.zeros((len(u) + 1, len(v) + 1), dtype=int)
    d, i_ = np.full(h.shape, -10**6), np.full(h.shape, -10**6)
    for i in range(1, len(u) + 1):
        for j in range(1, len(v) + 1):
            d[i, j] = max(d[i - 1, j] - e, h[i - 1, j] - o - e)
            i_[i, j] = max(i_[i, j - 1] - e, h[i, j - 1] - o - e)
            h[i, j] = max(0, d[i, j], i_[i, j], h[i - 1, j - 1] + table.table[u[i - 1], v[j - 1]])
    return h


@pytest.mark.parametrize("name,o,e", [("blosum62", 11, 1), ("unit_score_aa", 0, 4), ("unit_score_nuc", 3, 2)])
def test_local_alignment_equals_full_matrices(name, o, e):
    rng = random.Random(10)
    table = named(name)
    letters = "ACGT" if "nuc" in name else A.PROTEIN
    for _ in range(12):
        base = random_dna(rng, 25, letters)
        u = table.encode(base)
        vs = [table.encode(random_dna(rng, rng.randint(1, 8), letters) + base[rng.randint(0, 9) :] + random_dna(rng, rng.randint(0, 5), letters)) for _ in range(4)] + [table.encode("")]
        for v, (score, us, ul, start, vl) in zip(vs, align.local_alignments(u, vs, table, o, e)):
            h = full_local(u, v, table, o, e)
            assert score == h.max()
            if score:
                j = int(np.flatnonzero(h.max(0) == score)[0])
                i = int(np.flatnonzero(h[:, j] == score)[0])
                assert (us + ul, start + vl) == (i, j)
                again, text = align.global_alignment(u[us : us + ul], v[start : start + vl], table, o, e, score)
                assert again == score and full_local(u[us : us + ul], v[start : start + vl], table, o, e).max() == score
                m = n = 0
                import re

                for k, op in re.findall(r"(\d+)([=XID])", text):
                    m, n = m + int(k) * (op != "I"), n + int(k) * (op != "D")
                assert (m, n) == (ul, vl)


def test_aligned_pairs(spark):
    u = "ACGTACGGTCAAGT"
    d = seqs(spark, [u, u[::-1].translate(str.maketrans("ACGT", "TGCA")), "GG" + u[:9]])
    p = partition.triangle_pairs(d, "seq_id", 2)
    got = {(r["s_id"], r["q_id"]): r for r in align.align_pairs(p, d, matrix="unit_score_nuc", gap_open=3, gap_ext=2, both_strands=True, with_cigar=True).collect()}
    assert got[0, 1]["strand"] == "-" and got[0, 1]["score"] == 28 and (got[0, 1]["q_start"], got[0, 1]["q_len"]) == (0, 14) and got[0, 1]["cigar"] == "14="
    assert got[0, 2]["strand"] == "+" and (got[0, 2]["s_start"], got[0, 2]["q_start"], got[0, 2]["q_len"]) == (0, 2, 9)
    assert align.display("ACGT", "AGT", "1=1D2=") == "ACGT\n| ||\nA-GT"
    with pytest.raises(ValueError):
        align.display("A", "A", "1=", 4)
    with pytest.raises(ValueError):
        named("none")
    text = "# c\n   A C\nA  4 -1\nC -1 5\n"
    assert read_matrix(text).table[0, 0] == 4 and read_matrix(text).table[1, 1] == 5


@given(st.text("abc", max_size=8), st.text("abc", max_size=8))
@settings(max_examples=60, deadline=None)
def test_edit_scripts_are_optimal(a, b):
    d, all_ = edit.scripts(a, b)
    import re

    for s in all_:
        i = j = cost = 0
        for n, op in re.findall(r"(\d+)([=XID])", s):
            for _ in range(int(n)):
                if op in "=X":
                    assert (a[i] == b[j]) == (op == "=")
                i, j, cost = i + (op != "I"), j + (op != "D"), cost + (op != "=")
        assert (i, j, cost) == (len(a), len(b), d)
    assert len(set(all_)) == len(all_) >= 1


def test_pattern_hits_equal_a_matrix():
    rng = random.Random(11)
    for _ in range(40):
        p, t, e = random_dna(rng, rng.randint(2, 9)), random_dna(rng, 40), 0
        e = rng.randint(0, len(p) // 2)
        row, hits = list(range(len(p) + 1)), 0
        for c in t:
            new = [0]
            for i in range(1, len(p) + 1):
                new.append(min(new[-1] + 1, row[i] + 1, row[i - 1] + (p[i - 1] != c)))
            row = new
            hits += row[-1] <= e
        assert edit.pattern_hits(t, p, e) == hits
    with pytest.raises(ValueError):
        edit.pattern_hits("A", "ACGT", 3)
    with pytest.raises(ValueError):
        edit.pattern_hits("A", "A" * 65, 1)


def test_extension_and_gaps(spark):
    rng = random.Random(12)
    u = random_dna(rng, 300)
    v = u[:100] + "A" + u[101:200] + random_dna(rng, 400)
    x, y, d = edit.greedy_extension(u, v)
    assert 195 <= x <= 215 and abs(x - y) <= 3 and d <= 8
    assert edit.greedy_extension(u, u) == (300, 300, 0)
    one, two = seqs(spark, ["AAAACCGGTTTT"]), seqs(spark, ["AAAACGTTTT"])
    m = spark.createDataFrame([(1, 0, 0, 4, 0, 4, 0, 0), (1, 1, 8, 4, 6, 4, 0, 0)], "group long, ordinal int, p_start int, p_len int, s_start int, s_len int, p_id long, s_id long")
    assert rows(edit.closed_gaps(m, one, two)) == [(1, 2)]


def test_bands_equal_whole_tables():
    rng = random.Random(20)
    for case in range(150):
        name = ("unit_score_nuc", "blosum62")[case % 2]
        t, letters = named(name), "ACGT" if case % 2 == 0 else "ARNDX"
        x = "".join(rng.choice(letters) for _ in range(rng.randint(0, 25)))
        y = "".join(c for c in x if rng.random() > 0.2) + "".join(rng.choice(letters) for _ in range(rng.choice([0, 0, 9]))) if case % 3 else "".join(rng.choice(letters) for _ in range(rng.randint(0, 25)))
        u, v = (t.index[np.frombuffer(z.encode(), np.uint8)] for z in (x, y))
        o, e = rng.choice([(3, 2), (11, 1), (0, 1)])
        low = -(1 << 40)
        h, d, a = (np.full((len(u) + 1, len(v) + 1), low) for _ in range(3))
        h[0, 0] = 0
        for i in range(len(u) + 1):
            for j in range(len(v) + 1):
                if i:
                    d[i, j] = max(d[i - 1, j] - e, h[i - 1, j] - o - e)
                if j:
                    a[i, j] = max(a[i, j - 1] - e, h[i, j - 1] - o - e)
                if i and j:
                    h[i, j] = h[i - 1, j - 1] + t.table[u[i - 1], v[j - 1]]
                if i or j:
                    h[i, j] = max(h[i, j], d[i, j], a[i, j])
        score, text = align.global_alignment(u, v, t, o, e)
        assert score == h[-1, -1] and align._banded(u, v, t, o, e, max(len(u), len(v))) == (score, text)
        assert align.global_alignment(u, v, t, o, e, score)[0] == score


def test_long_texts_are_aligned_in_little_memory():
    import tracemalloc

    rng = np.random.default_rng(21)
    u = rng.integers(0, 4, 20_000)
    v = np.delete(u.copy(), rng.integers(0, 20_000, 10))
    v[rng.integers(0, len(v), 10)] ^= 1
    tracemalloc.start()
    try:
        score, text = align.global_alignment(u, v, named("unit_score_nuc"), 3, 2)
        assert tracemalloc.get_traced_memory()[1] < 40 << 20
    finally:
        tracemalloc.stop()
    assert score > 2 * 20_000 - 200 and text.count("D") >= 1


def test_distinct_counts_of_groups_are_partial_and_merge(spark):
    from strandlake.functions import surfaces

    rng = random.Random(19)
    data = [(rng.choice("aaaab"), rng.getrandbits(64) - (1 << 63)) for _ in range(4000)] + [("c", 5), ("c", 5), ("c", None)]
    d = spark.createDataFrame(data + data[:500], "src string, value long")
    state = sketch.bitmaps(d, "src", s=0, r=14)
    plan = state._jdf.queryExecution().executedPlan().toString()
    assert "partial_bitmap_construct_agg" in plan
    halves = sketch.merged_bitmaps(*[sketch.bitmaps(d.where(F.pmod("value", F.lit(2)) == k), "src", s=0, r=14) for k in (0, 1)])
    got, again = ({r["src"]: r["f0"] for r in sketch.f0_by_group(x, "src", s=0, r=14).collect()} for x in (state, halves))
    want = {k: surfaces.f0_of_hashes(np.array([v for s, v in data if s == k and v is not None], dtype=np.int64), 0, 14) for k in "abc"}
    assert got == pytest.approx(want) and again == pytest.approx(want)
    d.createOrReplaceTempView("hashes")
    sql = spark.sql("SELECT src, -ln(1 - sum(bitmap_count(bits)) / 4194304D) * 16777216D AS f0 FROM (SELECT src, bitmap_bucket_number(value & 4194303) AS bucket, bitmap_construct_agg(bitmap_bit_position(value & 4194303)) AS bits FROM hashes WHERE shiftrightunsigned(value, 62) = 0 GROUP BY src, bucket) GROUP BY src")
    assert {r["src"]: r["f0"] for r in sql.collect()} == pytest.approx({r["src"]: r["f0"] for r in sketch.f0_by_group(sketch.bitmaps(d, "src"), "src").collect()})


@pytest.mark.parametrize("seed,slab", [(0, 10), (1, 3), (2, 25)])
def test_maximum_intervals_of_a_hot_group_slab_by_slab(spark, seed, slab):
    rng = random.Random(seed)
    data = [(g, i, rng.randint(0, 400), rng.choice([0, 1, 5, 9, 60, 300]), float(rng.randint(1, 9))) for g, n in ((1, 150), (2, 9), (3, 40)) for i in range(n)]
    data += [(4, i, 5, 7 + i % 3, 2.0) for i in range(60)] + [(1, 900, -10, 2000, 6.0), (1, 901, 0, 1500, 6.0)]
    got = {(r["group"], r["id"]) for r in matches.maximum_intervals(spark.createDataFrame(data, "group long, id long, start long, len long, weight double"), slab).collect()}
    want = set()
    for g in range(1, 5):
        own = [x for x in data if x[0] == g]
        for p in range(-10, 2000):
            over = [x for x in own if x[2] <= p < x[2] + x[3]]
            want |= {(g, x[1]) for x in over if x[4] == max(y[4] for y in over)}
    assert got == want


@pytest.mark.parametrize("local", [False, True])
def test_chains_of_huge_groups_go_slab_by_slab(spark, local):
    rng = random.Random(18)
    data = [(g, i, rng.randint(0, 300), rng.randint(1, 20), rng.randint(0, 300), rng.randint(1, 20), rng.randint(1, 30)) for g, n in ((1, 200), (2, 90), (3, 12), (4, 31)) for i in range(n)]
    data += [(5, i, 7, 3, i, 2, 4) for i in range(70)] + [(6, i, 5 * i, 5, 5 * i, 5, 9) for i in range(80)]  # one start for all; one chain of all
    d = spark.createDataFrame(data, "group long, match_id long, p_start long, p_len long, s_start long, s_len long, weight long")
    got = {r["group"]: r for r in chaining.chains(d, local, slab=30).collect()}
    assert sorted(got) == [1, 2, 3, 4, 5, 6]
    for g, r in got.items():
        own = {x[1]: x[2:] for x in data if x[0] == g}
        columns = [np.array(c) for c in zip(*own.values())]
        assert r["score"] == chaining.best_chain(*columns, local)[0] and r["length"] == len(r["matches"])
        chain = [own[i] for i in r["matches"]]
        assert all(a[0] + a[1] <= b[0] and a[2] + a[3] <= b[2] for a, b in zip(chain, chain[1:]))
        gaps = sum((b[0] - a[0] - a[1] + 1) + (b[2] - a[2] - a[3] + 1) for a, b in zip(chain, chain[1:])) if local else 0
        assert sum(c[4] for c in chain) - gaps == r["score"]


# Suffix tables.


def test_suffix_tables_equal_sorted_suffixes(spark):
    rng = random.Random(13)
    texts = [random_dna(rng, 40, "ab"), random_dna(rng, 7, "ab"), "", "abab" * 5, "abab" * 5]
    d = seqs(spark, texts)
    want = sorted((t[p:], i, p) for i, t in enumerate(texts) for p in range(len(t)))
    table = suffixes.common_prefixes(d)
    got = rows(table)
    assert [(s, p) for _, s, p, _ in got] == [w[1:] for w in want]

    def shared(a, b):
        n = 0
        while n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        return n

    lcp = [0] + [shared(a[0], b[0]) for a, b in zip(want, want[1:])]
    assert [g[3] for g in got] == lcp
    # Copies that differ from all else early, texts around the chunks' ends, and others.
    long = random_dna(rng, 600)
    many = [long, long, long[:287], long[:288], long[5:261], long[:40] + "é" + long[40:80], "x" * 90, "x" * 91, "y"]
    e = seqs(spark, many)
    ordered = sorted((t[p:], i, p) for i, t in enumerate(many) for p in range(len(t)))
    assert rows(suffixes.common_prefixes(e)) == [(r, i, p, shared(ordered[r - 1][0], x) if r else 0) for r, (x, i, p) in enumerate(ordered)]
    copies = [long, long]  # no round parts anything
    ordered = sorted((t[p:], i, p) for i, t in enumerate(copies) for p in range(len(t)))
    assert rows(suffixes.common_prefixes(seqs(spark, copies))) == [(r, i, p, shared(ordered[r - 1][0], x) if r else 0) for r, (x, i, p) in enumerate(ordered)]
    assert rows(suffixes.common_prefixes(seqs(spark, ["", ""]))) == []
    assert suffixes.is_ordered(suffixes.suffix_array(d), d)
    intervals = set()
    for i in range(len(lcp)):
        for j in range(i + 1, len(lcp)):
            inner = min(lcp[i + 1 : j + 1])
            if inner > (lcp[i] if i else 0) and (j + 1 == len(lcp) or lcp[j + 1] < inner):
                intervals.add((inner, i, j))
    for block in (1 << 16, 1, 2, 3, 7):  # blocks that hold all, a single rank, and parts of intervals
        assert rows(suffixes.prefix_intervals(table, block)) == sorted(intervals)
    for case in range(6):
        values = [0] + [rng.randrange(0, 2 + case) for _ in range(rng.randrange(1, 60))]
        whole = spark.createDataFrame(list(enumerate(values)), "rank long, lcp int").repartition(3)
        want_intervals = set()
        for i, v in enumerate(values):
            if v:
                left = max((k for k in range(i) if values[k] < v), default=0)
                right = next((k for k in range(i + 1, len(values)) if values[k] < v), len(values)) - 1
                want_intervals.add((v, left, right))
        assert rows(suffixes.prefix_intervals(whole, 1 + 2 * case)) == sorted(want_intervals)
    assert rows(suffixes.prefix_intervals(table.limit(0))) == []
    q = spark.createDataFrame([("ababb",), ("bbbbbbbbb",), ("xa",), ("",)], "query string")
    joined = [max(k for k in range(len(x) + 1) if any(x[:k] in t for t in texts)) for x in ("", "ababb", "bbbbbbbbb", "xa")]
    assert [r[1] for r in rows(suffixes.longest_prefixes(q, d))] == joined


def test_long_repeats_take_no_more_levels(spark, monkeypatch):
    rng = random.Random(14)
    base, other = random_dna(rng, 100_000), random_dna(rng, 100_000)
    levels, whole = [], suffix_sort._solved
    monkeypatch.setattr(suffix_sort, "_solved", lambda *a: levels.append(1) or whole(*a))
    for text in (base + "x" + base, base + "x" + other):
        levels.append(0)
        assert suffix_sort.in_order(seqs(spark, [text])).count() == len(text)
    assert levels == [0, 1, 0, 1]


def test_levels_that_no_task_may_sort_whole(spark, monkeypatch):
    monkeypatch.setattr(suffix_sort, "LOCAL", 60)
    monkeypatch.setattr(suffix_sort, "_CHUNK", 8)
    texts = ["ab" * 100, "ab" * 100, "a" * 90, "é", "", "abcab" * 30]
    want = sorted((t[p:], i, p) for i, t in enumerate(texts) for p in range(len(t)))
    got = suffix_sort.in_order(seqs(spark, texts)).orderBy("rank").collect()
    assert [(r["seq_id"], r["pos"]) for r in got] == [w[1:] for w in want] and [r["rank"] for r in got] == list(range(len(want)))


def test_suffixes_in_memory():
    rng = random.Random(15)
    for _ in range(50):
        texts = [[rng.randint(0, 2) for _ in range(rng.randint(1, 9))] for _ in range(rng.randint(1, 6))]
        of, symbols = np.array([i for i, t in enumerate(texts) for _ in t]), np.array([x for t in texts for x in t])
        want = sorted((t[p:], i, p) for i, t in enumerate(texts) for p in range(len(t)))
        places = {(i, p): k for k, (i, p) in enumerate((i, p) for i, t in enumerate(texts) for p in range(len(t)))}
        ranks = suffix_sort.local_ranks(of, symbols)
        assert [int(ranks[places[i, p]]) for _, i, p in want] == list(range(len(want)))


def test_index_finds_prefixes_longer_than_heads(spark, tmp_path):
    rng = random.Random(16)
    texts = ["ab" * 150, "ab" * 150, "a" * 120, "", "é" * 40, random_dna(rng, 200, "abc")]
    d = seqs(spark, texts)
    suffixes.write_leaves(d, str(tmp_path / "index"), size=16)
    queries = ["", "zz", "ab" * 200, "ab" * 120 + "x", "é" * 33, "é" * 60, "a" * 120 + "b", "q", texts[5][20:140], texts[5][7:90] + "z", None]
    got = suffixes.search_leaves(spark.createDataFrame([(q,) for q in queries], "query string"), d, str(tmp_path / "index"), width=64).collect()
    want = {q: max(k for k in range(len(q) + 1) if any(q[:k] in t for t in texts)) for q in queries if q is not None}
    assert {r["query"]: r["length"] for r in got} == want
    suffixes.write_leaves(d.limit(0), str(tmp_path / "none"))
    assert [r["length"] for r in suffixes.search_leaves(spark.createDataFrame([("ab",)], "query string"), d, str(tmp_path / "none")).collect()] == [0]


@pytest.mark.parametrize("n,limit,block", [(200, 50, 16), (200, 5, 16), (150, 2000, 7), (60, 1, 8), (1, 5, 8), (0, 5, 8)])
def test_greedy_parts_over_blocks(spark, monkeypatch, n, limit, block):
    rng = random.Random(n + limit)
    lengths = [rng.choice([0, 0, 1, 3, 9, 40]) for _ in range(n)]
    want, part, filled = [], 0, 0
    for i, x in enumerate(lengths):
        if filled >= limit:
            part, filled = part + 1, 0
        filled += x
        want.append((3 * i - 50, x, part))
    monkeypatch.setattr(partition, "BLOCK", block)
    d = spark.createDataFrame([(3 * i - 50, "x" * x) for i, x in enumerate(lengths)], "seq_id long, sequence string")
    assert rows(partition.greedy_parts(d, limit)) == want
    with pytest.raises(ValueError):
        partition.greedy_parts(d, 0)


def test_seeds_of_one_hot_qgram_are_dealt_out(spark):
    rng = random.Random(17)
    table = lambda n: [(7 if i % 3 == 0 else rng.randrange(8, 900), i // 50, i % 50) for i in range(n)]
    left, right = table(3000), table(2400)
    make = lambda t: spark.createDataFrame(t, "hash long, seq_id long, pos long")
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        for k, v in zip(before, ("false", "16", "-1")):
            spark.conf.set(k, v)
        got = matches.seed_matches(make(left), make(right), block=32)
        tasks = [r["n"] for r in got.where("hash = 7").groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
        assert len(tasks) > 8 and max(tasks) < 10 * sorted(tasks)[len(tasks) // 2]
        assert got.count() == got.distinct().count() == sum(a[0] == b[0] for a in left for b in right)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


# Bloom filters, samples.


def test_filters_have_no_false_negatives(spark):
    bits, k = bloom.parameters(0.01, 300)
    assert k == 6 and bits == int(300 * math.log(0.01) * -2.081368)
    assert bloom.parameters(0.01, 300, 4)[1] == 4
    v = spark.range(0, 3000, 10).select(F.col("id").alias("v"))
    others = spark.range(1, 3000, 10).select(F.col("id").alias("v"))
    for kind in (bloom.positions, bloom.blocked_positions, bloom.one_hash_positions):
        f = bloom.build(v, "v", bits, k, kind)
        assert bloom.contains(v, "v", f, bits, k, kind).where("contained").count() == 300
        assert bloom.contains(others, "v", f, bits, k, kind).where("contained").count() < 30


def test_samples(spark):
    d = seqs(spark, ["A"] * 40)
    got = [r["seq_id"] for r in sampling.random_sample(d, 10, 1).collect()]
    assert len(set(got)) == 10 and got == sorted(got)
    with pytest.raises(ValueError):
        sampling.random_sample(d, 41, 1)
    assert [r["seq_id"] for r in sampling.last(d, 2).collect()] == [39, 38]
    with pytest.raises(Exception, match="unequal"):
        stats.paired(d, d.where("seq_id < 39")).collect()
    with pytest.raises(Exception, match="unknown sequence"):
        matches.numbered(d, spark.createDataFrame([("nobody", "1")], "a string, b string")).collect()
