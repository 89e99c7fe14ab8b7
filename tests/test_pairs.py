"""Queries on pairs run over whole texts that differ, and equal brute force there."""

import os
import re

import numpy as np
import pytest

from strandlake.functions.scores import named
from strandlake.operators import edit
from strandlake.plans import catalog
from strandlake.plans import views as V
from tests.test_operators import full_local

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


@pytest.fixture(scope="module")
def letters(spark):
    return {r["seq_id"]: r["sequence"] for r in V.benchmark_letters(spark, DATA).collect()}


def test_local_alignments_are_of_differing_texts(spark, letters):
    n, table = len(letters), named("blosum62")
    got = {(r["s_id"], r["q_id"]): r for r in catalog.queries()["local_alignments_report"](spark, DATA).collect()}
    assert len(set(letters.values())) == n and set(got) == {(a, b) for a in letters for b in letters if a < b}
    assert {c for r in got.values() for c in re.findall("[=XID]", r["cigar"] or "")} == set("=XID")
    for key in sorted(got)[:: len(got) // 4]:
        r, u, v = got[key], *(table.encode(letters[k]) for k in key)
        h = full_local(u, v, table, 11, 1)
        j = int(np.flatnonzero(h.max(0) == h.max())[0])
        assert r["score"] == h.max() and r["q_start"] + r["q_len"] == j and r["s_start"] + r["s_len"] == int(np.flatnonzero(h[:, j] == h.max())[0])
        i, j, score = r["s_start"], r["q_start"], 0
        for k, op in re.findall(r"(\d+)([=XID])", r["cigar"]):
            k = int(k)
            score += sum(int(table.table[u[i + x], v[j + x]]) for x in range(k)) if op in "=X" else -11 - k
            i, j = i + k * (op != "I"), j + k * (op != "D")
        assert score == r["score"] and (i - r["s_start"], j - r["q_start"]) == (r["s_len"], r["q_len"])
    plain = {(r["s_id"], r["q_id"]): r["score"] for r in catalog.queries()["local_alignments"](spark, DATA).collect()}
    assert plain == {k: r["score"] for k, r in got.items()}
    top = [r["score"] for r in catalog.queries()["local_alignments_top20"](spark, DATA).collect()]
    assert sorted(top) == sorted(plain.values())[-20:]


def brute_count(a, b):
    """(distance, number of best scripts) by a fold over both."""
    row = [(j, 1) for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        new = [(i, 1)]
        for j, y in enumerate(b, 1):
            options = [(row[j][0] + 1, row[j][1]), (new[-1][0] + 1, new[-1][1]), (row[j - 1][0] + (x != y), row[j - 1][1])]
            least = min(o[0] for o in options)
            new.append((least, sum(o[1] for o in options if o[0] == least)))
        row = new
    return row[-1]


def test_no_edit_script_is_cut():
    distance, found = edit.scripts("a" * 15, "b" * 10)
    assert (distance, len(set(found))) == brute_count("a" * 15, "b" * 10) and len(found) > 1000
    assert edit.scripts("", "") == (0, [""]) and edit.scripts("", "ab") == (2, ["2I"]) and edit.scripts("é😀", "é") == (1, ["1=1D"])
    assert edit.int_text(0) == "0" and edit.int_text(10**4000 + 7) == "1" + "0" * 3999 + "7"


def test_edit_script_graphs_of_whole_texts(spark, letters):
    got = {r["id"]: r for r in catalog.queries()["all_edit_scripts"](spark, DATA).collect()}
    assert set(got) == {(a << 31) + b for a in letters for b in letters if a < b}
    for key in sorted(got)[:: len(got) // 5]:
        r = got[key]
        a, b = letters[key >> 31], letters[key & (1 << 31) - 1]
        assert (r["distance"], int(r["n_scripts"])) == brute_count(a, b) and r["distance"] > 0 and len(r["i"]) == len(r["j"]) == len(r["steps"])
    assert max(int(r["n_scripts"]) for r in got.values()) > 1000
