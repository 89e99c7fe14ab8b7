"""The operators on small tables: brute force, and the odd cases of their docstrings."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake.llm import common, components, jaccard, knn, language, line_rules, mixing, packing, quality, repeats, toxicity, warc
from tests.llm.test_cores import brute_repeats

DOCS = "doc_id long, text string, source string, lang string, n_chars long, size long, place int, words int, kept string, label int"


def docs(spark, rows):
    """Rows (doc_id, text, source, lang), with extra columns whose names clash."""
    return spark.createDataFrame([(*r, 1, 2, 3, 4, "k", 9) for r in rows], DOCS)


def odd_rows(seed=0):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6))) for _ in range(60)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    base = [text(rng.randint(5, 90)) for _ in range(20)]
    rows = [(i, base[i % 20] if i % 3 else base[i % 20] + " " + text(2), f"s{i % 4}", "en") for i in range(60)]
    long_text = "\n".join(text(40) for _ in range(200))
    rows += [(100, None, "s0", None), (101, "", None, "en"), (102, " \n\t ", "s1", "en"), (103, "one", "s1", None), (104, long_text, "s0", "fr"), (105, long_text, None, "fr")]
    rows += [(None, "a text without an id of its own", "s0", "en"), (7, rows[7][1], "s3", "en"), (8, "another text of the same id", None, None), (106, "#$% " * 30 + "é" * 300, "s2", "de"), (107, "x" * 2000, "s2", "de")]
    return rows


def test_written_tables_live_in_the_shared_folder(spark):
    assert common.work_folder(spark) == spark.sparkContext.getConf().get("spark.checkpoint.dir")


def test_components_are_the_reachable_minima(spark):
    rng = random.Random(1)
    links = [(rng.randint(0, 80), rng.randint(0, 80)) for _ in range(50)] + [(i, i + 1) for i in range(100, 180)] + [(300, j) for j in range(301, 360)]
    parent = {x: x for p in links for x in p}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for p in links if p[0] != p[1] for x in p}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_jaccard(rows):
    sets = []
    for _, text, *_ in rows:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) > 3 else ({tuple(w)} if w else set()))
    n = len(rows)
    link = [[i != j and sets[i] and sets[j] and rows[i][0] is not None and rows[j][0] is not None and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]) for j in range(n)] for i in range(n)]
    group = list(range(n))
    for _ in range(n):
        for i in range(n):
            for j in range(n):
                if link[i][j]:
                    group[i] = group[j] = min(group[i], group[j])
    least = {g: min((rows[i][0] for i in range(n) if group[i] == g and rows[i][0] is not None), default=None) for g in set(group)}
    return sorted((str(rows[i][0]), len(sets[i]), str(least[group[i]]), sum(map(bool, link[i]))) for i in range(n))


@pytest.mark.parametrize("options", [{}, {"tile": 4, "tile_tokens": 60, "sample_docs": 10}, {"tile": 4, "tile_tokens": 300, "sample_docs": 60, "salt_rows": 8}])
def test_jaccard_join_equals_brute_force(spark, options):
    rows = odd_rows()
    rng = random.Random(4)
    base = [f"w{i}" for i in range(70)]
    for k in range(30):  # a group of near copies
        w = list(base)
        for _ in range(rng.randint(0, 2)):
            w[rng.randrange(70)] = f"x{rng.randrange(9)}"
        rows.append((1000 + k, " ".join(w), "s0", "en"))
    got = jaccard.jaccard_join(docs(spark, rows), **options)
    assert sorted((str(r[0]), r[1], str(r[2]), r[3]) for r in got.collect()) == brute_jaccard(rows)
    assert jaccard.jaccard_join(docs(spark, [])).count() == 0


def test_repeats_equal_brute_force(spark):
    rng = random.Random(2)
    passage = "".join(rng.choice("abcdé fgh\n") for _ in range(260))
    rows = odd_rows() + [(2000 + i, "".join(rng.choice("klmno ") for _ in range(rng.randint(0, 300))) + passage[rng.randint(0, 20) :] + "q" * i, "s0", "en") for i in range(12)]
    rows += [(3000, "ab" * 700, "s0", "en"), (3001, "".join(rng.choice("uvw") for _ in range(199)), "s0", "en"), (3002, passage + passage, "s1", "en")]
    texts = [(r[1] or "").encode() for r in rows]
    want = []
    for r, t, gone in zip(rows, texts, brute_repeats(texts, 200)):
        kept = bytes(c for c, g in zip(t, gone) if not g)
        spans = sum(1 for i in range(len(t)) if gone[i] and not (i and gone[i - 1]))
        want.append((str(r[0]), len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest(), kept))
    rows_of = lambda d: sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"], bytes(r["kept"])) for r in d.collect())
    for at_once in (50, 5, 2, 1):  # anchors with more contexts than that are divided
        assert rows_of(repeats.repeat_dedup(docs(spark, rows), rows_at_once=at_once, most_contexts=at_once)) == sorted(want)
    assert repeats.repeat_dedup(docs(spark, [])).count() == 0


def test_a_hot_anchor_is_divided_without_loss(spark):
    rng = random.Random(31)
    noise = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    heart, sides = noise(150), [noise(120) for _ in range(4)]
    texts = [noise(40) + rng.choice(sides)[rng.randint(0, 90) :] + heart + rng.choice(sides)[: rng.randint(0, 120)] + noise(30) for _ in range(70)]
    gone = brute_repeats([t.encode() for t in texts], 200)
    want = {i: sum(g) for i, g in enumerate(gone)}
    assert len(set(want.values())) > 20
    d = docs(spark, [(i, t, "s", "en") for i, t in enumerate(texts)])
    for at_once in (1000, 8, 3):
        assert {r["doc_id"]: r["n_removed"] for r in repeats.repeat_dedup(d, rows_at_once=at_once, most_contexts=at_once).collect()} == want


def test_line_rules_equal_a_plain_count(spark):
    rows = odd_rows() + [(500 + i, f"The  common LINE\nown line of words number {i} with more of them here to stay\n" + ("the common line\n" * (i % 3)), "hot", "en") for i in range(30)]
    got = {(str(r["_row"]["doc_id"]), r["_row"]["text"], r["_row"]["source"]): r for r in line_rules.judge(docs(spark, rows)).collect()}
    shuffled = {(str(r["_row"]["doc_id"]), r["_row"]["text"], r["_row"]["source"]): r for r in line_rules.judge(docs(spark, rows), broadcast_rows=-1).collect()}
    assert len(got) == len({(str(r[0]), r[1], r[2]) for r in rows})
    norm = lambda x: b" ".join(x.encode().lower().split())
    lines_of = lambda t: [x for x in (t or "").split("\n") if x.encode().split()]
    hosts = {}
    for r in rows:
        hosts.setdefault(r[2], []).append({norm(x) for x in lines_of(r[1])})
    for (doc_id, text, source), r in got.items():
        w = (text or "").encode().split()
        grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        covered = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(5)} if len(w) < 500 else None
        assert r["n_words"] == len(w) and r["word_chars"] == sum(len(x.decode()) for x in w)
        assert r["n_symbols"] == sum(c in "#*$%&|<>" for c in text or "")
        assert r["n_dup_lines"] == len(lines_of(text)) - len(set(lines_of(text)))
        if covered is not None:
            assert r["n_repeat_words"] == len(covered)
            assert r["base_failed"] == (len(w) < 10 or 100 * len(covered) > 20 * len(w))
        held = hosts[source]
        often = lambda x: (n := sum(norm(x) in h for h in held)) > 10 and n * 100 > 10 * len(held)
        gone = [x for x in lines_of(text) if often(x)]
        lost = sum(len(x.encode().split()) for x in gone)
        assert r["n_removed_words"] == lost == shuffled[doc_id, text, source]["n_removed_words"]
        assert r["kept"] == (not r["base_failed"] and lost * 100 <= 50 * len(w)) == shuffled[doc_id, text, source]["kept"]
        if text is not None:
            assert r["clean_text"] == "\n".join(x for x in text.split("\n") if x not in gone)
    many = [(i, f"own line {i} of ten words that stay here for good\n" + ("Menu  of the SITE\n" if i % 50 < 3 else ""), "large", "en") for i in range(600)]
    limited = line_rules.judge(docs(spark, many), most_docs=35)
    assert {r["n_removed_words"] for r in limited.collect() if "Menu" in r["_row"]["text"]} == {4}
    assert not line_rules.judge(docs(spark, many), most_docs=36).where("n_removed_words > 0").count()
    assert line_rules.judge(docs(spark, rows)).where("kept").count() == sum(r["kept"] for r in line_rules.judge(docs(spark, rows)).collect())
    assert line_rules.judge(docs(spark, [])).count() == 0


def test_mix_meets_targets_and_reruns_agree(spark):
    rows = odd_rows()
    d = docs(spark, rows)
    out = mixing.mix(d, shards=3).collect()
    assert len(out) == len(rows) and sorted(map(str, out)) == sorted(map(str, mixing.mix(d.repartition(7), shards=3).collect()))
    size = lambda t: len((t or "").encode().split())
    total = {}
    for r in rows:
        total[r[2]] = total.get(r[2], 0) + size(r[1])
    names = sorted(x for x in total if x is not None) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    want, free, all_words = {}, set(names), sum(total.values())
    while True:
        rest = all_words - sum(3 * total[s] for s in names if s not in free)
        over = {s for s in free if rest * weight[s] / sum(weight[f] for f in free) > 3 * total[s]}
        if not over:
            break
        free -= over
    for s in names:
        want[s] = rest * weight[s] / sum(weight[f] for f in free) if s in free else 3 * total[s]
    taken = {}
    for r in out:
        s = r["_row"]["source"]
        assert r["size"] == size(r["_row"]["text"]) and r["source_size"] == total[s] and r["target"] == pytest.approx(want[s])
        assert r["taken"] == sum(c["words"] for c in r["copies"]) <= 3 * r["size"]
        assert all(c["shard"] in (0, 1, 2) for c in r["copies"])
        taken[s] = taken.get(s, 0) + r["taken"]
    assert all(abs(taken[s] - want[s]) <= 1 for s in names)
    drawn = mixing.drawn(mixing.mix(d), d.columns).collect()
    order = [(r["shard"], r["shard_order"]) for r in drawn]
    assert order == sorted(order) and len({s for s, _ in order}) > 1  # partitions in order, rows in order
    assert sum(size(r["text"]) for r in drawn) == sum(taken.values())
    assert mixing.mix(docs(spark, [])).count() == 0
    slow = mixing.mix(d, shards=3, broadcast_rows=-1).collect()
    assert sorted(map(str, out)) == sorted(map(str, slow))
    again = [(None, "a b c", "s0", "en")] * 5 + [(1, "x " * 100_000, "s0", "en"), (1, "x " * 100_000, "s0", "en"), (2, None, None, None)]
    both = [mixing.mix(docs(spark, again).repartition(n)).collect() for n in (1, 3)]
    assert sorted(map(str, both[0])) == sorted(map(str, both[1])) and len(both[0]) == 8
    assert abs(sum(r["taken"] for r in both[0]) - 200_015) <= 2


def test_the_tree_splits_quotas_exactly_and_as_drawn_at_random(spark):
    slots = spark.createDataFrame([(f"s{k}", b, p) for k, passes in enumerate((1, 3, 2)) for b in range(128) for p in range(1, passes + 1)], "key string, block int, pass int")
    for shards in (1, 5, 8):
        out = mixing.dealt(slots, shards, "t").collect()
        assert sorted(tuple(r)[:3] for r in out) == sorted(map(tuple, slots.collect()))
        sizes = [sum(r["shard"] == i for r in out) for i in range(shards)]
        assert sum(sizes) == 768 and max(sizes) - min(sizes) <= 3
    left = [sum(r["key"] == "s0" and r["shard"] == 0 for r in mixing.dealt(slots, 2, f"seed {i}").collect()) for i in range(24)]
    # Hypergeometric: 128 of 768 slots, half of them drawn: mean 64, variance 26.7.
    assert 60 < np.mean(left) < 68 and 8 < np.var(left) < 80 and len(set(left)) > 5


def test_the_mix_is_taken_through_the_tree(spark):
    taken = mixing.mix(docs(spark, odd_rows())).select("taken")
    plan = taken._jdf.queryExecution().optimizedPlan().toString()
    assert "slots" in plan  # what is taken is summed over the slots that the tree has dealt


def test_voronoi_equals_brute_force(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(400, 5)).astype(np.float32)
    v[50:80] = v[50]  # ties
    v[100:220] = v[100] + rng.normal(size=(120, 5)).astype(np.float32) * 1e-3  # a hot cell
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)] + [(900, None), (None, [0.0] * 5), (901, [1.0, None, 0.0, 0.0, 0.0]), (902, [float("nan")] * 5), (903, [float("inf")] * 5), (50, [float(x) for x in v[50]])]
    data = knn.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    ints = [(i, np.floor(1024 * np.array(x, dtype=np.float64)).astype(int)) for i, x in rows if i is not None and x is not None and None not in x and np.isfinite(np.array(x)).all()]
    got = knn.voronoi_top_k(data, data.where("vec_id % 10 = 3 OR vec_id = 200"), most_pivots=7, block=16, chunk=8).collect()
    for q, x in ints:
        if q % 10 == 3 or q == 200:
            want = sorted((-int(x @ y), i) for i, y in ints if i != q)[:10]
            mine = sorted((r["rank"], -r["score"], r["vec_id"]) for r in got if r["query_id"] == q)
            assert [m[1:] for m in mine] == want and [m[0] for m in mine] == list(range(1, 11))
    few = data.where("vec_id < 4")
    repeated = data.where("vec_id = 50").unionByName(data.where("vec_id = 50"))
    again = knn.voronoi_top_k(data.unionByName(repeated), repeated, k=3).collect()
    assert len(again) == 3 and all(r["query_id"] == 50 != r["vec_id"] for r in again)
    assert knn.voronoi_top_k(few, few).count() == 12
    assert knn.voronoi_top_k(data.where("false"), data).count() == 0


def test_vectors_of_other_lengths_and_sizes(spark):
    rows = [(0, [1.0, 2.0]), (1, [1.0]), (2, []), (3, [0.5, 0.5, 9.0]), (4, [1e300, -1e300]), (5, [2.0, 1.0]), (6, [-1e18, 3.0]), (0, [1.0, 1.0])]
    ints = [(i, [math.floor(max(-(2.0**62), min(2.0**62, 1024 * x))) for x in v]) for i, v in rows]
    data = knn.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert sorted((r["vec_id"], r["v"]) for r in data.collect()) == sorted(ints)
    for block in (1, 100):
        got = {}
        for r in knn.voronoi_top_k(data, data, k=4, block=block, chunk=block).collect():
            got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
        for q in {i for i, _ in ints}:
            own = min(v for i, v in ints if i == q)
            clip = lambda s: max(-(2**63), min(2**63 - 1, s))
            want = sorted((-clip(sum(a * b for a, b in zip(own, v))), i) for i, v in ints if i != q)[:4]
            assert sorted(got[q]) == [(n + 1, i, -s) for n, (s, i) in enumerate(want)]


def test_packing_is_exact_and_tight(spark):
    P = pytest.importorskip("public_tokenizers")
    rows = odd_rows()
    path = P.path("byte_bpe_50k.json")
    encode = packing.encoder(path)
    out = packing.pack_documents(docs(spark, rows), path, capacity=64).collect()
    ids = {}
    for r in rows:
        ids.setdefault(r[0], []).append(np.array([*encode(r[1] or ""), 1], dtype="<u4"))
    assert sum(r["length"] for r in out) == sum(len(x) for v in ids.values() for x in v)
    sequences = {}
    for r in out:
        assert any(zlib.crc32(x[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"] and len(x) == r["doc_tokens"] for x in ids[r["doc_id"]])
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 64
    assert packing.pack_documents(docs(spark, []), path).count() == 0


@pytest.mark.parametrize("roll", [1 << 20, 500])
def test_archives_round_trip(spark, roll):
    rng = random.Random(3)
    shared = ["p" * 100, "short", "q" * 5000, ""]
    rows = [(i, f"http://x/{i}", shared[i % 4] if i % 2 else "".join(rng.choice("abc") for _ in range(300)), 0) for i in range(80)]
    rows += [(90, None, None, 0), (91, "u\r\nv", "é" * 60, 0), (None, "n", "p" * 100, 0), (3, "again", shared[3], 0), (1, "twice", shared[1], 0), (5, "http://x/5", "q" * 5000, 0), (6, "other", "q" * 5000, 0), (6, "other", "q" * 5000, 0)]
    folder = common.new_path(spark, "warc-test")
    manifest = warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string, digest int"), folder, roll_bytes=roll, per_range=20)
    got = warc.read_archives(spark, folder).collect()
    assert manifest.agg(F.sum("records")).first()[0] == len(rows) == len(got)
    least = {}
    for page, _, html, _ in rows:
        if page is not None and html and len(html.encode()) >= 100:
            least[html] = min(page, least.get(html, page))
    by = {}
    for r in got:
        by.setdefault((r["payload_digest"]), []).append(r)
    for page, url, html, _ in rows:
        data = (html or "").encode()
        mine = [r for r in by[hashlib.sha256(data).hexdigest()] if r["page_id"] == page]
        assert all(r["payload_bytes"] == len(data) for r in mine) and mine
        if page is None or len(data) < 100:
            assert all(r["record_type"] == "response" and r["refers_to"] is None for r in mine)
        elif least[html] == page:
            assert sorted(r["record_type"] for r in mine) == ["response"] + ["revisit"] * (len(mine) - 1)
        else:
            assert all(r["record_type"] == "revisit" and r["refers_to"] == least[html] for r in mine)
        assert all(bytes(r["payload"]) == data for r in mine if r["record_type"] == "response")
    empty = common.new_path(spark, "warc-test")
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), empty)
    assert warc.read_archives(spark, empty).count() == 0
    again = common.new_path(spark, "warc-test")
    second = warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string, digest int").repartition(5), again, roll_bytes=roll, per_range=20)
    assert sorted(r["sha256"] for r in second.collect()) == sorted(r["sha256"] for r in manifest.collect())


def test_links_and_their_pages_are_never_parted(spark):
    rows = [(i // 2 if i % 10 == 1 else i, f"http://x/{i}", "p" * 100) for i in range(2000)] + [(None, f"n{i}", "p" * 100) for i in range(500)]
    folder, key = common.new_path(spark, "warc-test"), "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "64")
        manifest = warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"), folder, per_range=10)
        got = warc.read_archives(spark, folder, with_payload=False).collect()
    finally:
        spark.conf.set(key, before)
    assert manifest.count() > 40 and len(got) == len(rows)
    assert manifest.where("first_id IS NULL AND last_id IS NULL").count() > 4
    assert all((r["record_type"], r["refers_to"]) == ("response", None) for r in got if r["page_id"] is None)
    full = [r["page_id"] for r in got if r["page_id"] is not None and r["record_type"] == "response"]
    assert full == [0] and all(r["refers_to"] == 0 for r in got if r["record_type"] == "revisit")


def test_archives_are_exact_and_equal_for_any_number_of_tasks(spark):
    rng = random.Random(12)
    ids = rng.sample(range(-10_000, 1 << 40), 20_000)
    text = lambda i: f"payload {i % 500} ".ljust(90 + i % 30, "x") if i % 3 == 0 else f"own {i}"
    rows = [(p, f"u{i}", text(i)) for i, p in enumerate(ids)] + [(None, f"n{i}", text(i)) for i in range(300)]
    key, manifests = "spark.sql.shuffle.partitions", []
    before = spark.conf.get(key)
    try:
        for parts, shuffle in ((9, "64"), (4, "5")):
            spark.conf.set(key, shuffle)
            folder = common.new_path(spark, "warc-test")
            d = spark.createDataFrame(rng.sample(rows, len(rows)), "page_id long, url string, html string").repartition(parts)
            manifests.append(sorted(tuple(r) for r in warc.write_archives(d, folder, per_range=300, roll_bytes=20_000).collect()))
            spark.range(1000).repartition(7).count()
    finally:
        spark.conf.set(key, before)
    assert manifests[0] == manifests[1] and len(manifests[0]) >= 67
    least = {}
    for p, _, t in rows:
        if p is not None and len(t) >= 100:
            least[t] = min(p, least.get(t, p))
    want = []
    for p, _, t in rows:
        first = least.get(t, p) if p is not None else None
        again = first is not None and first != p
        want.append((str(p), len(t), hashlib.sha256(t.encode()).hexdigest(), "revisit" if again else "response", first if again else None))
    got = warc.read_archives(spark, folder, with_payload=False).collect()
    assert sorted((str(r["page_id"]), *tuple(r)[2:6]) for r in got) == sorted(want)
    assert sum(w[3] == "revisit" for w in want) > 3000


def test_hot_keys_are_joined_without_their_shuffle(spark):
    d = spark.createDataFrame([(i % 7 if i % 2 else i, i) for i in range(400)], "k long, x long")
    keyed = d.groupBy(F.col("k").alias("of")).agg(F.count("*").alias("n"), F.max("x").alias("most")).where("of % 5 <> 0")
    for total in (400, 100_000, 10_000_000):
        for how in ("inner", "left"):
            want = d.join(keyed, F.col("k") == F.col("of"), how)
            got = common.hot_split_join(d, keyed, "k", "of", "n", total, how)
            assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_classifiers_learn_and_take_odd_texts(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(5))
    rows, labels = [], []
    for i in range(600):
        toxic, poor = i % 5 == 0, i % 3 == 0
        words = [word() for _ in range(rng.randint(12, 60))]
        if toxic:
            words[rng.randrange(len(words))] = "vile" + word()[:2]
        text = " ".join(w + ("%%%" if poor else "") for w in words)
        rows.append((i, text, "s", "en"))
        labels.append((i, int(toxic), int(not poor)))
    rows += [(900, None, "s", None), (901, "", "s", None), (902, "\n", None, None), (None, "no id", "s", None), (3, rows[3][1], "s", "en"), (903, "long " * 50_000, "s", "en")]
    d, marks = docs(spark, rows), spark.createDataFrame(labels + [(None, 1, 1), (5, None, None)], "doc_id long, toxic int, quality int")
    model = toxicity.train(d.where("doc_id % 2 = 0"), marks.select("doc_id", F.col("toxic").alias("label")))
    out = {(r["doc_id"]): r for r in toxicity.score(d, model).collect()}
    assert np.mean([out[i]["predicted"] == t for i, t, _ in labels if i % 2]) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in out.values()) and {900, 901, 902, None} <= set(out)
    stats = quality.with_statistics(d)
    fitted = quality.train(stats.where("doc_id % 2 = 0"), marks.select("doc_id", F.col("quality").alias("label")))
    out = {(r["doc_id"]): r for r in quality.score(stats, fitted).collect()}
    assert np.mean([out[i]["predicted"] == q for i, _, q in labels if i % 2]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in out.values()) and len(out) == len({r[0] for r in rows})
    none = marks.where("false")
    assert toxicity.score(d, toxicity.train(d, none.select("doc_id", F.col("toxic").alias("label")))).count() == len(rows)
    assert quality.score(stats, quality.train(stats, none.select("doc_id", F.col("quality").alias("label")))).count() == len(rows)
    assert toxicity.score(docs(spark, []), model).count() == 0 == quality.score(quality.with_statistics(docs(spark, [])), fitted).count()


def test_language_spans(spark):
    rng = random.Random(9)
    make = {"xx": "aeiou", "yy": "bcdfg", "zz": "абвгд"}
    text = lambda k, n: " ".join("".join(rng.choice(make[k]) for _ in range(4)) for _ in range(n))
    rows = [(i, text(k := sorted(make)[i % 3], 30), "s", k) for i in range(150)]
    rows += [(200, text("xx", 25) + " . " + text("zz", 60) + " 77 " + text("yy", 9), "s", None), (201, None, "s", None), (202, "12 34 %%", "s", None), (203, "", "s", "xx"), (204, "字" * 30, "s", None), (None, text("yy", 5), "s", None)]
    d = docs(spark, rows)
    model = language.train(d.where("doc_id < 90"))
    out = {r["doc_id"]: r for r in language.identify(d, model, chunk_words=400).collect()}
    assert all(out[i]["lang_pred"] == k for i, _, _, k in rows[:150])
    assert [s["lang"] for s in out[200]["spans"]] == ["xx", "zz", "yy"] and out[200]["lang_pred"] == "zz" and 0.5 < out[200]["score"] < 0.8
    assert [(s["start"], s["words"]) for s in out[200]["spans"]] == [(0, 25), (25, 60), (85, 9)]
    assert all(out[i]["lang_pred"] == "und" and out[i]["score"] == 0 for i in (201, 202, 203)) and out[204]["lang_pred"] in make
    tail = docs(spark, [(1, "aeiou" * 8 + "дбг" * 3400, "s", None), (2, "aeiou" * 8, "s", None), (3, "² ½ Ⅷ", "s", None), (2, "aeiou" * 8, "s", None)])
    assert sorted((r["doc_id"], r["lang_pred"]) for r in language.identify(tail, model).collect()) == [(1, "zz"), (2, "xx"), (2, "xx"), (3, "und")]
    assert language.train(d.where("false")) is None
    assert {r["lang_pred"] for r in language.identify(d, None).collect()} == {"und"}
    assert language.identify(docs(spark, []), model).count() == 0


def test_near_duplicates_are_dropped_by_row(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(1, a, "s", "en"), (5, a + " more", "s", "en"), (5, b, "s", "en"), (9, b + " end", None, None), (9, c, "s", "en"), (9, c, "s", "en"), (3, None, "s", "en"), (3, None, "s", "en"), (None, a, "s", "en"), (None, a, "s", "en"), (4, " ", "s", "en")]
    out = pipeline.near_duplicates(spark, docs(spark, rows), "")
    kept = [(1, a), (5, b), (9, c), (3, None), (3, None), (None, a), (None, a), (4, " ")]
    assert sorted(map(str, kept)) == sorted(str((r["doc_id"], r["text"])) for r in out.collect())
    # Five words and 80 percent: 56 shingles, of which two changes far from each other leave 46 of 66.
    w = a.split()
    two, one = [*w[:20], "x", *w[21:40], "y", *w[41:]], [*w[:20], "x", *w[21:]]
    out = pipeline.near_duplicates(spark, docs(spark, [(1, a, "s", "en"), (2, " ".join(two), "s", "en"), (3, " ".join(one), "s", "en")]), "")
    assert sorted(r["doc_id"] for r in out.collect()) == [1]  # 2 links with 3, and 3 with 1
    out = pipeline.near_duplicates(spark, docs(spark, [(1, a, "s", "en"), (2, " ".join(two), "s", "en")]), "")
    assert sorted(r["doc_id"] for r in out.collect()) == [1, 2]


def test_pipeline_stages_feed_each_other(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    rows = odd_rows() + [(700 + i, odd_rows(5)[i % 50][1], "s9", "en") for i in range(40)]
    d = docs(spark, rows)
    for name, stage in pipeline.STAGES[:-1]:
        before, d = d, common.written(stage(spark, d, ""), name)
        assert d.columns == before.columns and d.count()
        if name != "source_mixing":
            assert d.count() == d.select("doc_id", F.xxhash64("text")).distinct().count() or name == "line_frequency_rules"
    packed = pipeline.STAGES[-1][1](spark, d, "")
    assert packed.count() >= d.count()
    empty = docs(spark, [])
    for name, stage in pipeline.STAGES:
        empty = common.written(stage(spark, empty, ""), name)
        assert empty.count() == 0


def test_a_second_attempt_never_takes_a_named_file_away(tmp_path):
    from pyarrow import fs

    store, final = fs.LocalFileSystem(), tmp_path / "part-1.warc.gz"
    for attempt in "12":
        (tmp_path / f".part-1.warc.gz.{attempt}").write_bytes(b"records")
    warc.commit_file(store, str(tmp_path / ".part-1.warc.gz.1"), str(final))
    before = final.stat().st_ino

    class Killed:
        """A store whose attempt ends at its next change of a file."""

        get_file_info = store.get_file_info

        def move(self, *_):
            raise KeyboardInterrupt

        delete_file = move

    with pytest.raises(KeyboardInterrupt):
        warc.commit_file(Killed(), str(tmp_path / ".part-1.warc.gz.2"), str(final))
    assert final.read_bytes() == b"records" and final.stat().st_ino == before
    assert warc.remove_leftovers("file://" + str(tmp_path)) == 1 and [x.name for x in tmp_path.iterdir()] == [final.name]

    class Late:
        """Another attempt comes first between the look and the move."""

        seen, delete_file = 0, store.delete_file

        def get_file_info(self, path):
            self.seen += 1
            return store.get_file_info(path + "x" * (self.seen == 1))

        def move(self, *_):
            raise OSError("there is a file")

    (tmp_path / ".part-1.warc.gz.3").write_bytes(b"records")
    warc.commit_file(Late(), str(tmp_path / ".part-1.warc.gz.3"), str(final))
    assert [x.name for x in tmp_path.iterdir()] == [final.name]
