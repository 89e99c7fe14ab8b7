"""The registered queries on the smallest tables: SQL where there is some, else brute
force or exact properties; and each stage of the pipeline on its own input."""

import hashlib
import math
import os
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake.llm import common, language, quality, toxicity
from strandlake.llm import queries as registry
from tests.llm.test_cores import brute_repeats

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def docs(spark):
    return [(r["doc_id"], r["text"] or "") for r in common.table(spark, DATA, "documents").select("doc_id", "text").collect()]


def test_names():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14)) and set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "labels", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got, want = QUERIES[name](spark, DATA), con.sql(SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = lambda d: sorted(str(tuple(r)) for r in d)
    assert rows(got.select(columns).collect()) == rows(want.select(", ".join(columns)).fetchall())


@pytest.mark.parametrize("number,n,held", [(1, 5, 0), (4, 3, 1), (6, 4, 2)])
def test_learned_queries_score_every_text(spark, docs, number, n, held):
    name = next(q for q in QUERIES if q.startswith(f"op{number}_"))
    rows = QUERIES[name](spark, DATA).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(d for d, _ in docs)
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % n == held) and 0 <= r["score"] <= 1
        if number != 6:
            assert r["predicted"] == (r["score"] >= 0.5)
    truth = {r["doc_id"]: r for r in common.table(spark, DATA, "labels").collect()}
    langs = {r["doc_id"]: r["lang"] for r in common.table(spark, DATA, "documents").collect()}
    right = [r["lang_pred"] == langs[r["doc_id"]] if number == 6 else r["predicted"] == truth[r["doc_id"]]["toxic" if number == 1 else "quality"] for r in rows if r["held_out"] and (number == 6 or r["doc_id"] in truth)]
    assert np.mean(right) > 0.85


def learning(spark, name, column, n, held):
    """The rows that a query may learn from."""
    docs = common.table(spark, DATA, "documents")
    learn = common.remainder(F.col("doc_id"), n) != held
    labels = common.table(spark, DATA, "labels").select("doc_id", F.col(column).alias("label")) if column else None
    return docs.where(learn), labels.where(learn) if column else None


def test_op1_scores_follow_plainly_from_its_weights(spark, docs):
    rows, labels = learning(spark, "op1", "toxic", 5, 0)
    model = toxicity.train(rows.select("doc_id", "text"), labels)
    got = {r["doc_id"]: r["score"] for r in QUERIES["op1_counterfactual_toxicity"](spark, DATA).collect()}
    assert len(model.place) > 50
    for doc_id, text in docs:
        words = re.findall(r"[^\W\d_]+", text.lower())
        z = model.intercept
        for feature, at in model.place.items():
            times = sum(w.startswith(feature[:-1]) and len(w) >= len(feature) for w in words) if feature.endswith("*") else words.count(feature)
            z += model.weights[at] * min(1.0, times / max(1.0, len(words) / 400))
        assert got[doc_id] == pytest.approx(1 / (1 + math.exp(-max(-40, min(40, z)))), abs=1e-9)
    terms = [model.weights[model.place[t]] for ts in toxicity.IDENTITY_TERMS.values() for t in ts]
    assert max(map(abs, terms)) < 0.5 * max(model.weights)


def test_op4_scores_follow_plainly_from_its_model(spark, docs):
    rows, labels = learning(spark, "op4", "quality", 3, 1)
    m = quality.train(quality.with_statistics(rows), labels)
    got = {r["doc_id"]: r["score"] for r in QUERIES["op4_fourier_quality"](spark, DATA).collect()}
    known = {r["doc_id"]: r["label"] for r in labels.collect()}
    z = {}
    for doc_id, text in docs:
        x = [max(-8.0, min(8.0, (v - a) / b)) for v, a, b in zip(quality.statistics(text), m.mean, m.spread)]
        z[doc_id] = [math.cos(sum(p * v for p, v in zip(column, x)) + f) * math.sqrt(2 / len(m.phase)) for column, f in zip(m.projection.T, m.phase)] + x + [1.0]
    raw = {d: float(np.dot(v, m.weights)) for d, v in z.items()}
    for d, r in raw.items():
        share = (r + 0.5) / 2
        level = m.levels[max(0, min(511, int(share * 512)))]
        assert got[d] == pytest.approx(max(0.0, min(1.0, level * 0.998 + 0.002 * max(0.0, min(1.0, share)))), abs=1e-6) or abs(share * 512 - round(share * 512)) < 1e-6
    # The weights solve the normal equations for one of the ridges.
    a, y = np.array([z[d] for d in known if d in z]), np.array([known[d] for d in known if d in z])
    gradient = a.T @ (a @ m.weights - y)
    assert min(np.abs(gradient + r * len(y) * np.r_[m.weights[:-1], 0]).max() for r in (1e-4, 1e-3, 1e-2, 1e-1, 1.0)) < 1e-5 * len(y)
    assert all(np.diff(m.levels) >= 0)


def test_op6_labels_follow_plainly_from_its_table(spark, docs):
    rows, _ = learning(spark, "op6", None, 4, 2)
    m = language.train(rows.select("doc_id", "text", "lang"))
    got = {r["doc_id"]: (r["lang_pred"], r["score"], r["n_spans"]) for r in QUERIES["op6_viterbi_language"](spark, DATA).collect()}
    for doc_id, text in sorted(docs, key=lambda d: len(d[1]))[:120]:
        words, best, back = re.findall(r"[^\W\d_]{1,40}", text.lower()), None, []  # one script in these tables
        for w in words:
            s = sum((m.matrix[m.index.get(g, len(m.index))] for g in language.grams(w)), np.zeros(len(m.langs), np.float32))
            s = [max(float(x - s.max()), -30.0) * 0.5 if m.allowed["latin"][k] else -1e4 for k, x in enumerate(s)]
            if best is None:
                best = s
                continue
            top = int(np.argmax(best))
            came = [k if best[k] >= best[top] - m.penalty else top for k in range(len(s))]
            best = [max(best[k], best[top] - m.penalty) + s[k] for k in range(len(s))]
            back.append(came)
        if not words:
            assert got[doc_id] == ("und", 0.0, 0)
            continue
        path = [int(np.argmax(best))]
        for came in reversed(back):
            path.append(came[path[-1]])
        path.reverse()
        letters = np.bincount(path, list(map(len, words)), len(m.langs))
        assert got[doc_id] == (m.langs[int(letters.argmax())], letters.max() / letters.sum(), 1 + sum(a != b for a, b in zip(path, path[1:])))


def sets_of(rows, n):
    out = []
    for _, text in rows:
        w = text.encode().lower().split()
        out.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set()))
    return out


def components(rows, n=4, percent=85):
    sets, root = sets_of(rows, n), list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(d, least.get(find(i), d))
    return {d: (len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows)}


def test_op3_equals_brute_force(spark, docs):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in QUERIES["op3_trie_jaccard"](spark, DATA).collect()}
    assert got == components(docs)


def repeats_of(texts):
    out = []
    for t, gone in zip(texts, brute_repeats(texts, 200)):
        kept = bytes(c for c, g in zip(t, gone) if not g)
        out.append((len(t), sum(gone), sum(1 for i in range(len(t)) if gone[i] and not (i and gone[i - 1])), kept))
    return out


def test_op5_equals_brute_force(spark, docs):
    want = {d: (*r[:3], hashlib.sha256(r[3]).hexdigest()) for (d, _), r in zip(docs, repeats_of([t.encode() for _, t in docs]))}
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in QUERIES["op5_bwt_repeats"](spark, DATA).collect()}
    assert got == want


def packed_right(rows, texts):
    """rows: pieces; texts: (doc_id, text), ids may repeat."""
    import public_tokenizers

    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {}
    for d, t in texts:
        ids.setdefault(d, []).append(np.array([*plain.encode(t, add_special_tokens=False).ids, 1], dtype="<u4"))
    places, fill = {}, {}
    for r in rows:
        assert any(zlib.crc32(x[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"] and len(x) == r["doc_tokens"] for x in ids[r["doc_id"]])
        places.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
        fill.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for d, xs in ids.items():
        assert sum(n for _, n in places[d]) == sum(map(len, xs))
    for parts in fill.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 2048
    total = sum(n for parts in fill.values() for _, n in parts)
    assert len(fill) <= -(-total // 2048) * 1.02 + 1


def test_op9_is_exact_and_tight(spark, docs):
    packed_right(QUERIES["op9_min_bin_slack_packing"](spark, DATA).collect(), docs)


def test_op10_is_a_round_trip(spark):
    pages = common.table(spark, DATA, "pages").collect()
    least = {}
    for p in pages:
        data = (p["html"] or "").encode()
        if len(data) >= 100:
            least[data] = min(p["page_id"], least.get(data, p["page_id"]))
    want = set()
    for p in pages:
        data = (p["html"] or "").encode()
        first = least.get(data, p["page_id"])
        want.add((p["page_id"], len(data), hashlib.sha256(data).hexdigest(), "response" if first == p["page_id"] else "revisit", None if first == p["page_id"] else first))
    assert {tuple(r) for r in QUERIES["op10_warc_writer"](spark, DATA).collect()} == want


def test_each_stage_equals_brute_force_on_its_input(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    rows = lambda d: [(r["doc_id"], r["text"] or "") for r in d.select("doc_id", "text").collect()]
    d = common.table(spark, DATA, "documents")
    columns = d.columns
    stages = dict(pipeline.STAGES)
    assert list(stages) == ["line_frequency_rules", "trie_jaccard", "bwt_repeats", "source_mixing", "min_bin_slack_packing"]

    before = d.collect()
    d = common.written(stages["line_frequency_rules"](spark, d, DATA), "stage")
    norm = lambda x: b" ".join(x.encode().lower().split())
    held, hosts = {}, {}
    for r in before:
        hosts[r["source"]] = hosts.get(r["source"], 0) + 1
        for x in {norm(x) for x in r["text"].split("\n")} - {b""}:
            held[r["source"], x] = held.get((r["source"], x), 0) + 1
    want = {}
    for r in before:
        w = r["text"].encode().split()
        seen, twice = {}, set()
        for i in range(len(w) - 4):
            seen.setdefault(tuple(w[i : i + 5]), []).append(i)
        for places in seen.values():
            if len(places) > 1:
                twice |= {i + k for i in places for k in range(5)}
        often = [x for x in r["text"].split("\n") if norm(x) and (n := held[r["source"], norm(x)]) > 10 and (n * 10 > hosts[r["source"]] or n > 1000)]
        lost = sum(len(x.encode().split()) for x in often)
        if len(w) >= 10 and 100 * len(twice) <= 20 * len(w) and 2 * lost <= len(w):
            want[r["doc_id"]] = "\n".join(x for x in r["text"].split("\n") if x not in often)
    assert dict(rows(d)) == want and d.columns == columns

    own = rows(d)
    d = common.written(stages["trie_jaccard"](spark, d, DATA), "stage")
    keep = {i for i, (_, c) in components(own, 5, 80).items() if i == c}
    assert sorted(rows(d)) == sorted(x for x in own if x[0] in keep) and d.columns == columns

    own = rows(d)
    d = common.written(stages["bwt_repeats"](spark, d, DATA), "stage")
    want = {}
    for (i, _), r in zip(own, repeats_of([t.encode() for _, t in own])):
        text = r[3].decode("utf-8", "ignore")
        if text.encode().split():
            want[i] = text
    assert dict(rows(d)) == want and d.columns == columns
    assert d.where("n_chars <> length(text)").count() == 0

    own = d.select("doc_id", "source", "text").collect()
    d = common.written(stages["source_mixing"](spark, d, DATA), "stage")
    size = lambda t: len(t.encode().split())
    there, taken = {r["doc_id"]: (r["source"], r["text"]) for r in own}, {}
    for i, t in rows(d):
        assert there[i][1].lstrip().startswith(t.strip()[:50])
        taken[i] = taken.get(i, 0) + size(t)
    assert all(n <= 3 * size(there[i][1]) for i, n in taken.items()) and d.columns == columns
    assert abs(sum(taken.values()) - sum(size(r["text"]) for r in own)) <= 20

    packed_right(stages["min_bin_slack_packing"](spark, d, DATA).collect(), rows(d))
    assert pipeline.run(spark, DATA).count() == stages["min_bin_slack_packing"](spark, d, DATA).count()
