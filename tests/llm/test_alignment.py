"""Alignment against token spans compared one by one, with the untouched tokenizers."""

import hashlib
import os
import random
from collections import Counter

import numpy as np
import pytest

from strandlake.llm import alignment, common

P = pytest.importorskip("public_tokenizers")
DATA = "/root/testdata/sf0.001"
PATHS = [P.path(n) for n in ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model")]
COLUMNS = "n_a n_b n_groups n_links n_best count_sum groups_sha256".split()


@pytest.fixture(scope="module")
def plain():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(PATHS[0])
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=PATHS[2])


def tokens():
    return alignment.byte_bpe(*PATHS[:2]), alignment.piece_bpe(PATHS[2])


def spans(pieces):
    ends = np.cumsum([0, *map(len, pieces)]).tolist()
    return list(zip(ends, ends[1:]))


def encoded(plain, text):
    """Ids and token bytes of both, or nothing."""
    if not text:
        return None
    a, b = plain
    shown = {c: byte for byte, c in enumerate(byte_names())}
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    own = [bytes(shown[c] for c in a.id_to_token(i)) for i in ids_a]
    other = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
    return (ids_a, ids_b, own, other) if b"".join(own) == b"".join(other) == (" " + text).encode() else None


def byte_names():
    """The character of each byte: Tokenizer's own byte-level step shows it."""
    from tokenizers.pre_tokenizers import ByteLevel

    names, step = [None] * 256, ByteLevel(add_prefix_space=False, use_regex=False)
    for c in [chr(i) for i in range(0x800) if not 0xD800 <= i < 0xE000] + ["\u0800", "\uffff", "\U00010000", "\U0010ffff"] + [chr(i << 12) for i in range(1, 16) if not 13 <= i < 14] + [chr(i << 18) for i in range(1, 4)]:
        for byte, name in zip(c.encode(), step.pre_tokenize_str(c)[0][0]):
            names[byte] = name
    return [n if n is not None else chr(0xFFFFF - i) for i, n in enumerate(names)]


def brute(plain, rows):
    found, counts = [], Counter()
    for d, text in rows:
        r = encoded(plain, text)
        if r is None:
            found.append((d, None))
            continue
        ids_a, ids_b, own, other = r
        sa, sb = spans(own), spans(other)
        links, j = [], 0
        for i, (s, e) in enumerate(sa):
            while sb[j][1] <= s:
                j += 1
            k = j
            while k < len(sb) and sb[k][0] < e:
                links.append((ids_a[i], ids_b[k]))
                k += 1
        groups, last = [], 0
        for cut in sorted({e for _, e in sa} & {e for _, e in sb}):
            parts = [",".join(str(x) for x, (s, e) in zip(ids, where) if last <= s and e <= cut) for ids, where in ((ids_a, sa), (ids_b, sb))] if len(sa) < 3000 else None
            groups.append("|".join(parts) if parts else "")
            last = cut
        counts.update(set(links))
        found.append((d, (len(ids_a), len(ids_b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if len(sa) < 3000 else None)))
    top = Counter()
    for (a, _), n in counts.items():
        top[a] = max(top[a], n)
    return [(d, 0, 0, 0, 0, 0, 0, "") if v is None else (d, *v[:3], len(v[3]), sum(counts[x] == top[x[0]] for x in v[3]), sum(counts[x] for x in v[3]), v[4]) for d, v in found]


def agree(got, want):
    """Rows alike; digests of very long texts aren't computed plainly."""
    key = lambda r: str(r[:7])
    got, want = sorted(got, key=key), sorted(want, key=key)
    return len(got) == len(want) and all(g[:7] == w[:7] and w[7] in (None, g[7]) for g, w in zip(got, want))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_op13_equals_brute_force(spark, plain):
    rows = [(r["doc_id"], r["text"]) for r in common.table(spark, DATA, "documents").collect()]
    got = [tuple(r[c] for c in ["doc_id", *COLUMNS]) for r in alignment.op13_byte_owner_alignment(spark, DATA).collect()]
    assert agree(got, brute(plain, rows))


PARTS = ["a", "foo", "Bar", "'s", " ", "  ", "   ", "\n", "\t", "\r\n", "é", "e\u0301", "漢字", "\u3000", "\xa0", "ﬁ", "<|endoftext|>", "<s>", "</s>", "<unk>", "<0x41>", "▁", "1", "23", ".", "...", "\x00", "\x1c", "\x85", "🙂", "\u200b", "-", "can't", "\ufffd"]


def test_words_have_the_ids_of_whole_texts(plain):
    rng = random.Random(5)
    both = alignment.Both(*tokens())
    for _ in range(5000):
        text = "".join(rng.choice(PARTS) for _ in range(rng.randint(1, 14)))
        parts = both.parts(text)
        want = [plain[0].encode(" " + text, add_special_tokens=False).ids, plain[1].encode(text)]
        assert [[k for ids in t.encode_all(parts) for k in ids] for t in (both.a, both.b)] == want
        if encoded(plain, text):
            assert [ids.tolist() for ids, _ in both.encoded([text.encode()])] == want


@pytest.mark.parametrize("heavy,window", [(1_000_000, 1 << 20), (20, 13), (0, 1)])
def test_odd_rows_and_pairs_that_are_joined(spark, plain, monkeypatch, heavy, window):
    rng = random.Random(6)
    text = lambda n: "".join(rng.choice(PARTS) for _ in range(n))
    rows = [(i, text(rng.randint(0, 30))) for i in range(60)] + [(100 + i, "the same text, many times") for i in range(20)]
    rows += [(200, None), (201, ""), (202, " "), (None, "no id"), (3, rows[3][1]), (203, " " * 12000 + "x"), (204, "▁"), (205, "word " * 400)]
    docs = spark.createDataFrame([(d, t, 1, 2, 3) for d, t in rows], "doc_id long, text string, a int, docs int, light int")
    monkeypatch.setattr(alignment, "_WINDOW", window)  # in the driver's own streams; tasks keep theirs
    got = alignment.alignments(docs, tokens, heavy=heavy)
    assert agree([tuple(r[c] for c in ["doc_id", *COLUMNS]) for r in got.collect()], brute(plain, rows))
    assert alignment.alignments(docs.limit(0), tokens).count() == 0


@pytest.mark.parametrize("window", [1, 2, 7, 1000])
def test_windows_change_nothing(monkeypatch, window):
    rng = random.Random(7)
    texts = [("".join(rng.choice(PARTS) for _ in range(rng.randint(0, 20)))).encode() for _ in range(30)] + [None]
    both = alignment.Both(*tokens())
    names = [b"%d" % i + end for n, ends in ((50257, b",|"), (32000, b",;")) for end in (ends[:1], ends[1:]) for i in range(n)]
    ids = [x for pair in both.encoded(texts) for x in pair]
    whole = alignment.Stream(both.a.sizes, both.b.sizes, *ids)
    digests = whole.groups(names, 50257, 32000)
    monkeypatch.setattr(alignment, "_WINDOW", window)
    cut = alignment.Stream(both.a.sizes, both.b.sizes, *ids)
    assert all(np.array_equal(getattr(whole, n), getattr(cut, n)) for n in ("a_of", "b_of", "cuts", "link_start", "cut_start"))
    assert cut.groups(names, 50257, 32000) == digests
