"""The numeric cores of the operators against brute force, without Spark."""

import random
import re
import zlib

import numpy as np
import pytest

from strandlake.llm import jaccard, language, mixing, packing, quality, repeats, toxicity, warc


def brute_repeats(texts, length):
    seen = {}
    for i, t in enumerate(texts):
        for a in range(len(t) - length + 1):
            seen.setdefault(t[a : a + length], []).append((i, a))
    gone = [bytearray(len(t)) for t in texts]
    for places in seen.values():
        if len(places) > 1:
            for i, a in places:
                gone[i][a : a + length] = b"\1" * length
    return gone


@pytest.mark.parametrize("seed", range(8))
def test_repeated_columns_equal_brute_force(seed):
    rng = np.random.default_rng(seed)
    rows, width, length = 40, 30, 8
    data = rng.integers(1, 3 + seed % 3, (rows, width)).astype(np.uint16)
    for i in range(rows):  # text ends
        data[i, : rng.integers(0, 6)] = 0
        data[i, width - rng.integers(0, 6) :] = 0
    for _ in range(12):
        i, j, a = rng.integers(0, rows), rng.integers(0, rows), rng.integers(6, 12)
        data[i, a : a + 10] = data[j, a : a + 10]
    got = repeats.repeated_columns(data, length, shard_rows=7)
    for c in range(width - length + 1):
        windows = [tuple(r[c : c + length]) for r in data]
        for i in range(rows):
            want = 0 not in windows[i] and windows.count(windows[i]) > 1
            assert got[i, c] == want


def test_one_global_order_serves_prefixes_and_trie():
    order = jaccard.Order(np.array([3, 7, 9], dtype=np.uint64), np.array([5, 2, 2]))
    tokens = np.array([9, 1, 3, 8, 7], dtype=np.uint64)
    assert order.sorted(tokens).tolist() == [1, 8, 7, 9, 3]
    assert jaccard.Order(np.zeros(0, np.uint64), np.zeros(0, np.int64)).sorted(tokens).tolist() == [1, 3, 7, 8, 9]


def test_every_window_has_an_anchor_of_its_content():
    rng = random.Random(3)
    base = bytes(rng.choice(b"abcd ") for _ in range(900))
    a, b = bytes(rng.choice(b"xyz") for _ in range(57)) + base, base + b"tail" * 80
    (ha, pa, _), (hb, pb, _) = repeats.anchors(a, 200), repeats.anchors(b, 200)
    inner = {(h, p - 57) for h, p in zip(ha.tolist(), pa.tolist()) if 57 + 168 <= p <= 57 + 700}
    assert inner <= {(h, p) for h, p in zip(hb.tolist(), pb.tolist())}
    small = repeats.anchors(a, 200, piece=64)
    assert small[0].tolist() == ha.tolist() and small[1].tolist() == pa.tolist()
    for piece in (64, 200, 777):
        assert all((x == y).all() for x, y in zip(repeats.anchors(a, 200, piece=piece), repeats.anchors(a, 200)))
    assert len(repeats.anchors(b"x" * 199, 200)[0]) == 0 and len(repeats.anchors(b"x" * 200, 200)[0]) == 1


def brute_links(sets, percent):
    return {(i, j) for i in range(len(sets)) for j in range(len(sets)) if i != j and len(sets[i] & sets[j]) * 100 >= percent * len(sets[i] | sets[j]) and sets[i] and sets[j]}


@pytest.mark.parametrize("seed", range(12))
def test_trie_join_equals_brute_force(seed):
    rng = np.random.default_rng(seed)
    base = [rng.integers(0, 400, rng.integers(1, 60)) for _ in range(6)]
    sets = []
    for _ in range(50):
        s = set(base[rng.integers(0, 6)].tolist())
        for _ in range(rng.integers(0, 6)):
            s.discard(rng.choice(sorted(s))) if len(s) > 1 and rng.random() < 0.5 else s.add(int(rng.integers(0, 400)))
        sets.append(s)
    arrays = [np.array(sorted(s), dtype=np.uint64) for s in sets]
    known = np.unique(rng.integers(0, 400, 80)).astype(np.uint64)
    order = jaccard.Order(known, rng.integers(2, 9, len(known)))
    for percent in (85, 50, 100):
        want = brute_links(sets, percent)
        got = {(i, j) for i, p in jaccard.trie_join(arrays, None, percent, order) for j in p.tolist() if i != j}
        assert got == want
        cross = {(i, j) for i, p in jaccard.trie_join(arrays[:20], arrays[20:], percent, order) for j in p.tolist()}
        assert cross == {(i, j - 20) for i, j in want if i < 20 <= j}
        described = [(len(a), *jaccard.sketch(a)) for a in arrays]
        assert all(jaccard.may_link(described[i], described[j], percent) for i, j in want)


@pytest.mark.parametrize("percent", [80, 85])
def test_unlike_sets_of_any_size_stay_apart(percent):
    rng = np.random.default_rng(percent)
    for size in (40, 63, 100, 127, 250, 340, 500, 511, 1000, 1023):
        sets = [np.unique(rng.integers(0, 1 << 63, size).astype(np.uint64)) for _ in range(120)]
        held = [(len(x), bits, value.to_bytes(bits // 8, "little")) for x in sets for bits, value in [jaccard.sketch(x, percent)]]
        assert jaccard.parts(held, percent) == list(range(120))


@pytest.mark.parametrize("percent", [50, 80, 85])
def test_parts_of_large_buckets_equal_those_set_by_set(percent, monkeypatch):
    rng = np.random.default_rng(percent)
    held = []
    for _ in range(90):
        whole = rng.integers(0, 1 << 63, int(np.exp(rng.uniform(1, 8)))).astype(np.uint64)
        for share in rng.uniform(0, 0.4, rng.integers(1, 4)):
            copy = np.where(rng.random(len(whole)) < share, rng.integers(0, 1 << 63, len(whole)).astype(np.uint64), whole)
            bits, value = jaccard.sketch(np.unique(copy), percent)
            held.append((len(np.unique(copy)), bits, value.to_bytes(bits // 8, "little")))
    held.sort(key=lambda x: x[0])
    got = jaccard.parts(held, percent)
    assert got == jaccard._array_parts(held, percent, cells=50)
    monkeypatch.setattr(jaccard, "_FEW", len(held))
    assert got == jaccard.parts(held, percent) != list(range(len(held)))


def test_shingles_follow_the_rule():
    assert len(jaccard.shingles(None)) == len(jaccard.shingles(" \t\n")) == 0
    assert len(jaccard.shingles("one two")) == 1
    assert jaccard.shingles("A b c d").tolist() == jaccard.shingles("a\tB  c\nd").tolist()
    assert jaccard.shingles("É b c d").tolist() != jaccard.shingles("é b c d").tolist()  # only A-Z are folded
    assert len(jaccard.shingles("a b c d e a b c d")) == 5 == len({tuple("abcdeabcd"[i : i + 4]) for i in range(6)})


def test_fullest_finds_the_best_sum():
    rng = random.Random(1)
    for _ in range(60):
        counts = {rng.randint(1, 30): rng.randint(1, 3) for _ in range(5)}
        room, base = rng.randint(1, 60), rng.randint(1, 40)
        sums = {0}
        for length, c in counts.items():
            sums = {s + k * length for s in sums for k in range(c + 1) if s + k * length <= room}
        cost = lambda s: 0 if (base + s) & (base + s - 1) == 0 else room - s
        taken = packing.fullest(counts, sorted(counts, reverse=True), room, base)
        total = sum(k * length for length, k in taken.items())
        assert all(k <= counts[length] for length, k in taken.items())
        assert total in sums and cost(total) == min(map(cost, sums))


def test_ids_equal_the_tokenizer_files():
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    json_file = P.path("byte_bpe_50k.json")
    fast, slow, plain = packing.encoder(P.path("byte_bpe_50k.tiktoken"), json_file), packing.encoder(json_file), Tokenizer.from_file(json_file)
    rng = random.Random(5)
    texts = ["", " ", "a" * 3000, "<|endoftext|>", "a <|endoftext|> b", "<|endoftext|><|endoftext|>\n", "<|endoftext", "naïve café 123 don't\n\n  x", "你好 \U0001f600 x́"]
    texts += ["".join(rng.choice([*"ab cd\n\t'sé1!    漢", "<|endoftext|>"]) for _ in range(200)) for _ in range(200)]
    texts += ["x" + " " * n + "<|endoftext|> y" for n in (9_999, 10_000, 400_000)] + ["a" * 200_000]
    for t in texts:
        want = plain.encode(t, add_special_tokens=False).ids
        assert list(fast(t)) == want and list(slow(t)) == want


def test_records_round_trip():
    payload = "<p>é</p>\r\n\r\nWARC/1.1".encode() * 9
    digest = __import__("hashlib").sha256(payload).hexdigest()
    data = warc.record(7, "http://x/\r\ny", payload, digest, None, "2020-01-01T00:00:00Z") + warc.record(9, None, payload, digest, 7, "2020-01-01T00:00:00Z") + warc.record(None, "u", b"", __import__("hashlib").sha256(b"").hexdigest(), None, "2020-01-01T00:00:00Z")
    rows = list(warc.parse(data))
    assert rows[0][0] == 7 and rows[0][2:] == (len(payload), digest, "response", None, payload)
    assert rows[1] == (9, None, len(payload), digest, "revisit", 7, None)
    assert rows[2][0] is None and rows[2][2] == 0
    with pytest.raises(ValueError):
        list(warc.parse(data.replace("é".encode(), b"ee", 1)))


def test_isotonic_is_the_pooled_fit():
    n, k = np.array([1, 1, 1, 0, 2, 1.0]), np.array([0, 1, 0, 0, 1, 1.0])
    assert quality.isotonic(n, k).tolist() == [0, 0.5, 0.5, 0.5, 0.5, 1.0]
    assert all(np.isfinite(quality.statistics(t)).all() and len(quality.statistics(t)) == len(quality.STATISTICS) for t in (None, "", "\n", "a", "# " * 5000))


def test_counterfactual_penalty_levels_identity_terms():
    rng = np.random.default_rng(0)
    rows, labels = [], []
    for i in range(400):  # feature 0 is toxic; 1 is a term that mostly goes with it, 2 its counterpart
        bad = i % 2
        places = sorted({3 + int(rng.integers(0, 20))} | ({0} if bad else set()) | ({1} if rng.random() < (0.6 if bad else 0.05) else {2} if rng.random() < 0.2 else set()))
        rows.append((np.array(places), np.ones(len(places))))
        labels.append(bad)
    changes = {(-2, 3): 1, (-2,): 1, (-3,): 1}  # feature 1 for 2, and each left out
    free, _ = toxicity.fit(rows, np.array(labels), changes, 23, penalty=0.0)
    held, _ = toxicity.fit(rows, np.array(labels), changes, 23, penalty=3.0)
    assert abs(held[1]) < 0.3 * abs(free[1]) and held[0] > 1


def test_swaps_count_every_sentence():
    place = {f: i for i, f in enumerate(sorted({f for terms in toxicity.IDENTITY_TERMS.values() for t in terms for f in toxicity.features(t)} | {"kind"}))}
    one, many = toxicity.swaps("A blind man is kind.", place), toxicity.swaps("A blind man is kind. " * 500, place)
    assert sum(one.values()) == 4 + 7 and many == {c: 500 * n for c, n in one.items()}
    assert tuple(sorted([-place["blind"] - 1, -place["bli*"] - 1, -place["blin*"] - 1])) in one
    assert sum(toxicity.swaps("none of them\n", place).values()) == 0 == sum(toxicity.swaps(None, place).values())


def test_words_are_pieces_of_one_script():
    assert language.words_of("² ½ Ⅷ ٣ 12 _") == [] == language.words_of(None)
    assert language.words_of("aB1c-éжД漢字ひら") == ["ab", "c", "é", "жд", "漢字", "ひら"]
    assert list(map(len, language.words_of("x" * 95))) == [40, 40, 15] == list(map(len, language.words_of("я" * 95)))
    for c in map(chr, range(0x3000)):
        assert bool(language.words_of(c)) == any(x.isalpha() for x in c.lower())


def test_viterbi_equals_brute_force():
    rng = np.random.default_rng(2)
    words = ["".join(rng.choice(list("abc"), 3)) for _ in range(12)]
    m = language.Model(["x", "y", "z"], {g: rng.normal(size=3).astype(np.float32) for w in words for g in language.grams(w)}, np.zeros(3, np.float32), {"latin": np.array([True, True, True])}, 1.5)
    texts = [[words[i] for i in rng.integers(0, 12, n)] for n in (5, 1, 0, 6, 3)]
    import itertools

    for words_, path in zip(texts, m.label(texts)):
        s = [m.scores[m.cache[w]] for w in words_]
        value = lambda p: sum(s[i][k] for i, k in enumerate(p)) - 1.5 * sum(a != b for a, b in zip(p, p[1:]))
        assert len(path) == len(words_)
        if words_:
            assert value(path) == pytest.approx(max(value(p) for p in itertools.product(range(3), repeat=len(words_))))
    assert language.script("д") == "cyrillic" and language.script("é") == "latin" and language.script("漢") == "han"


def test_anchors_of_a_very_long_text_take_little_memory():
    import tracemalloc

    data = np.random.default_rng(5).integers(97, 123, 24 << 20).astype(np.uint8).tobytes()
    tracemalloc.start()
    try:
        found = repeats.anchors(data, 200)
        assert tracemalloc.get_traced_memory()[1] < 12 * len(data)
    finally:
        tracemalloc.stop()
    assert len(found[0]) > len(data) // 200
