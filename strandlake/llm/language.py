"""Language identification of mixed text.

Words are runs of letters (Unicode category L) of one script: a run is cut where its
script changes, and every 40 letters, so that text without blanks is read whole, a
piece at a time. They are scored for each learned language by naive Bayes over
character n-grams. A word's script narrows the languages to those whose training words
use that script. A Viterbi pass over a text's words,
with a penalty for each switch of language, labels spans; the language with the most
letters is the text's. The pass advances all texts of a batch by one word at a time,
so its cost is vector work and not a Python step a word.
"""

from __future__ import annotations

import re
import sys
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

# First code points of script ranges, and their names.
SCRIPTS = [(0x0, "latin"), (0x370, "greek"), (0x400, "cyrillic"), (0x530, "armenian"), (0x590, "hebrew"), (0x600, "arabic"), (0x900, "devanagari"), (0x980, "other"),
           (0xE00, "thai"), (0xE80, "other"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"),
           (0x3040, "kana"), (0x3100, "other"), (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "other")]
_STARTS = [a for a, _ in SCRIPTS]


MOST_LETTERS = 40  # of a word; a longer run is several words


def script(word: str) -> str:
    """The script of a word's letters, which are all of one."""
    return SCRIPTS[bisect_right(_STARTS, ord(word[0])) - 1][1]


@cache
def _pattern() -> re.Pattern:
    """Runs of up to MOST_LETTERS letters of one script, an alternative a script."""
    letters: dict[str, list[str]] = {}
    start = None
    for i, (low, name) in enumerate(SCRIPTS):
        high = _STARTS[i + 1] if i + 1 < len(SCRIPTS) else sys.maxunicode + 1
        for c in range(low, high + 1):
            if c < high and chr(c).isalpha():  # the categories of L
                start = c if start is None else start
            elif start is not None:
                letters.setdefault(name, []).append(f"\\U{start:08x}-\\U{c - 1:08x}")
                start = None
    return re.compile("|".join(f"[{''.join(r)}]{{1,{MOST_LETTERS}}}" for r in letters.values()))


_PLAIN = re.compile(f"[a-z]{{1,{MOST_LETTERS}}}")  # the same for texts of ASCII alone, faster


def words_of(text: str | None) -> list[str]:
    """The words of a text, in lower case."""
    low = (text or "").lower()
    return (_PLAIN if low.isascii() else _pattern()).findall(low)


def grams(word: str) -> list[str]:
    """Character 1- to 4-grams with word ends, and the word itself."""
    w = f" {word} "
    return [w[i : i + n] for n in (1, 2, 3, 4) for i in range(len(w) - n + 1)] + [f"={word}"]


class Model:
    """Languages; a row of log-likelihoods for each n-gram and a last one for unseen
    ones; the languages that use each script; the penalty of a switch."""

    def __init__(self, langs: list[str], table: dict[str, np.ndarray], unseen: np.ndarray, allowed: dict[str, np.ndarray], penalty: float):
        self.langs, self.allowed, self.penalty = langs, allowed, penalty
        self.index = {g: i for i, g in enumerate(table)}
        self.matrix = np.array([*table.values(), unseen], dtype=np.float32).reshape(-1, len(langs))
        self.cache: dict[str, int] = {}
        self.scores = np.zeros((0, len(langs)), dtype=np.float32)

    def word_scores(self, words: list[str]) -> np.ndarray:
        """Log-likelihoods per language, relative to the best; languages that don't use
        a word's script are ruled out, unless none uses it."""
        get, unseen = self.index.get, len(self.index)
        ids: list[int] = []
        ends = []
        for w in words:
            ids += [get(g, unseen) for g in grams(w)]
            ends.append(len(ids))
        s = np.add.reduceat(self.matrix[ids], np.array([0, *ends[:-1]]))
        s = np.maximum(s - s.max(1, keepdims=True), -30.0) * 0.5
        kinds: dict[str, list[int]] = {}
        for i, w in enumerate(words):
            kinds.setdefault("latin" if w[0] < "\u0370" else script(w), []).append(i)
        for kind, at in kinds.items():
            may = self.allowed.get(kind)
            s[at] = 0 if may is None else np.where(may, s[at], -1e4)
        return s

    def label(self, texts: list[list[str]]) -> list[np.ndarray]:
        """For each list of words the index of each word's language."""
        if len(self.cache) > 1_000_000:
            self.cache, self.scores = {}, self.scores[:0]
        known = self.cache
        fresh = [w for w in dict.fromkeys(w for words in texts for w in words) if w not in known]
        if fresh:
            for w in fresh:
                known[w] = len(known)
            self.scores = np.concatenate([self.scores, self.word_scores(fresh)])
        scores = self.scores
        order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
        lengths = np.array([len(texts[i]) for i in order], dtype=np.int64)
        ids = np.fromiter((known[w] for i in order for w in texts[i]), dtype=np.int64, count=int(lengths.sum()))
        starts = np.concatenate([[0], np.cumsum(lengths)])[:-1]
        k = len(self.langs)
        own = np.arange(k)
        back = np.empty((len(ids), k), dtype=np.int16)
        v = np.zeros((len(order), k))
        ends = np.searchsorted(-lengths, -np.arange(1, (lengths[0] if len(lengths) else 0) + 1), side="right")
        for t, active in enumerate(ends):
            at = starts[:active] + t
            now = v[:active]
            if t:
                best = now.argmax(1)
                moved = now[np.arange(active), best] - self.penalty
                stay = now >= moved[:, None]
                back[at] = np.where(stay, own, best[:, None])
                now = np.where(stay, now, moved[:, None])
            v[:active] = now + scores[ids[at]]
        path = np.empty(len(ids), dtype=np.int64)
        state = v.argmax(1)
        for t in range(len(ends) - 1, -1, -1):
            at = starts[: ends[t]] + t
            path[at] = state[: ends[t]]
            if t:
                state[: ends[t]] = back[at, state[: ends[t]]]
        out: list[np.ndarray] = [np.zeros(0, dtype=np.int64)] * len(texts)
        for j, i in enumerate(order):
            out[i] = path[starts[j] : starts[j] + lengths[j]]
        return out


def train(docs: DataFrame, fit_docs: int = 2000, most_grams: int = 60_000, penalty: float = 6.0) -> Model | None:
    """Fit on docs (doc_id, text, lang): at most `fit_docs` texts of each language
    (those of smallest hash); of their n-grams the `most_grams` most frequent ones, which
    bounds the model. Null texts and languages don't count; repeated rows count each.
    None without a labelled text."""
    from pyspark.sql import Window

    rows = docs.where("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text", F.xxhash64("doc_id", "text").alias("h"))
    counted = rows.groupBy("lang").agg(F.count("*").alias("n")).collect()  # a row per language
    cut = F.create_map(*[x for r in counted for x in (F.lit(r["lang"]), F.lit(min(1.0, 2 * fit_docs / r["n"])))]) if counted else F.create_map(F.lit(""), F.lit(0.0))
    near = rows.where(F.pmod("h", F.lit(1 << 20)) < cut[F.col("lang")] * (1 << 20))  # twice the wanted rows, before they are ranked
    sample = near.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))).where(F.col("r") <= fit_docs).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, Counter] = defaultdict(Counter)
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1)):
                found[lang].update(words_of(text.as_py()))
        keys, langs, counts = [], [], []
        for lang, words in found.items():
            total: Counter = Counter()
            for w, n in words.items():
                for g in grams(w):
                    total[g] += n
                total["#" + script(w)] += n
            keys += total.keys()
            counts += total.values()
            langs += [lang] * len(total)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(langs, pa.string()), pa.array(counts, pa.int64())], names=["g", "lang", "n"])

    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sums = sample.repartition(tasks).mapInArrow(count, "g string, lang string, n long").groupBy("g", "lang").agg(F.sum("n").alias("n"))
    by_gram = sums.groupBy("g").agg(F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("n"), F.sum("n").alias("all"))
    kept = by_gram.orderBy(F.col("g").startswith("#").desc(), F.col("all").desc(), "g").limit(most_grams).collect()
    langs = sorted({lang for r in kept for lang in r["n"]})
    if not langs:
        return None
    at = {lang: i for i, lang in enumerate(langs)}
    table, allowed, totals = {}, {}, np.zeros(len(langs))
    for r in kept:
        n = np.zeros(len(langs))
        for lang, c in r["n"].items():
            n[at[lang]] = c
        if r["g"].startswith("#"):
            allowed[r["g"][1:]] = n
        else:
            table[r["g"]] = n
            totals += n
    used = sum(allowed.values())
    allowed = {s: n > 1e-3 * used for s, n in allowed.items()}
    allowed = {s: a for s, a in allowed.items() if a.any()}
    base = np.log(totals + len(table))
    return Model(langs, {g: (np.log(n + 1.0) - base).astype(np.float32) for g, n in table.items()}, (-base).astype(np.float32), allowed, penalty)


def identify(docs: DataFrame, model: Model | None, chunk_words: int = 1_000_000) -> DataFrame:
    """(doc_id, lang_pred, score, spans) for each row of docs (doc_id, text): spans are
    (start, words, lang) over words_of() the text. `und` and score 0 where a text is null,
    empty or without a letter (digits, other numbers and marks aren't letters), and for
    all rows if nothing was learned (model None). score is the share of letters in spans
    of the language; of languages with equally many letters the first in the model's
    order is taken. A very long text is scored whole, and repeated rows each; a null id
    stays null; columns other than these two are ignored; an empty table gives no rows."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("start", pa.int32()), ("words", pa.int32()), ("lang", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value

        def labelled(ids: list, texts: list[list[str]]) -> pa.RecordBatch:
            langs, scores, spans = [], [], []
            for words, path in zip(texts, m.label(texts) if m else [None] * len(texts)):
                if not words or m is None:
                    langs.append("und"), scores.append(0.0), spans.append([])
                    continue
                weight = np.bincount(path, np.fromiter(map(len, words), dtype=np.int64, count=len(words)), len(m.langs))
                best = int(weight.argmax())
                langs.append(m.langs[best]), scores.append(float(weight[best] / weight.sum()))
                edges = np.flatnonzero(np.diff(path)) + 1
                first, last = np.concatenate([[0], edges]), np.concatenate([edges, [len(path)]])
                spans.append([{"start": int(a), "words": int(z - a), "lang": m.langs[path[a]]} for a, z in zip(first, last)])
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(spans, kind)], names=["doc_id", "lang_pred", "score", "spans"])

        for b in batches:
            ids, texts, words = [], [], 0
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
                ids.append(doc_id), texts.append(words_of(text.as_py()))
                words += len(texts[-1])
                if words >= chunk_words:
                    yield labelled(ids, texts)
                    ids, texts, words = [], [], 0
            if ids:
                yield labelled(ids, texts)

    schema = "doc_id long, lang_pred string, score double, spans array<struct<start:int,words:int,lang:string>>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def op6_viterbi_language(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train(docs.where(common.remainder(F.col("doc_id"), 4) != 2))
    out = identify(docs, model)
    return out.select("doc_id", (F.coalesce(common.remainder(F.col("doc_id"), 4), F.lit(0)) == 2).alias("held_out"), "lang_pred", "score", F.size("spans").alias("n_spans"))
