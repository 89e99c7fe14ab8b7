"""Substitution scores."""

from __future__ import annotations

import numpy as np

# Lower triangle of the published matrix blosum62, rows and columns in
# the order below.
_ORDER = "ARNDCQEGHILKMFPSTWYVBZX*"
_BLOSUM62 = """
 4
-1  5
-2  0  6
-2 -2  1  6
 0 -3 -3 -3  9
-1  1  0  0 -3  5
-1  0  0  2 -4  2  5
 0 -2  0 -1 -3 -2 -2  6
-2  0  1 -1 -3  0  0 -2  8
-1 -3 -3 -3 -1 -3 -3 -4 -3  4
-1 -2 -3 -4 -1 -2 -3 -4 -3  2  4
-1  2  0 -1 -3  1  1 -2 -1 -3 -2  5
-1 -1 -2 -3 -1  0 -2 -3 -2  1  2 -1  5
-2 -3 -3 -3 -2 -3 -3 -3 -1  0  0 -3  0  6
-1 -2 -2 -1 -3 -1 -1 -2 -2 -3 -3 -1 -2 -4  7
 1 -1  1  0 -1  0  0  0 -1 -2 -2  0 -1 -2 -1  4
 0 -1  0 -1 -1 -1 -1 -2 -2 -1 -1 -1 -1 -2 -1  1  5
-3 -3 -4 -4 -2 -2 -3 -2 -2 -3 -2 -3 -1  1 -4 -3 -2 11
-2 -2 -2 -3 -2 -1 -2 -3  2 -1 -1 -2 -1  3 -3 -2 -2  2  7
 0 -3 -3 -3 -1 -2 -2 -3 -3  3  1 -2  1 -1 -2 -2  0 -3 -1  4
-2 -1  3  4 -3  0  1 -1  0 -3 -4  0 -3 -3 -2  0 -1 -4 -3 -3  4
-1  0  0  1 -3  3  4 -2  0 -3 -3  1 -1 -3 -1  0 -1 -3 -2 -2  1  4
 0 -1 -1 -1 -2 -1 -1 -1 -1 -1 -1 -1 -1 -1 -2  0  0 -2 -1 -1 -1 -1 -1
-4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4  1
"""


class Scores:
    """A square score table over characters; others are the last row and column."""

    def __init__(self, characters: str, table: np.ndarray, fold: bool = True):
        self.characters, self.table = characters, table.astype(np.int64)
        self.index = np.full(256, len(characters), dtype=np.int64)
        for i, c in enumerate(characters):
            self.index[ord(c)] = i
            if fold:
                self.index[ord(c.lower())] = i
        if characters == "ACGT" and fold:
            self.index[[ord("U"), ord("u")]] = 3

    def encode(self, sequence: str) -> np.ndarray:
        return self.index[np.frombuffer(sequence.encode("latin-1", "replace"), dtype=np.uint8)]


def unit(characters: str, match: int, mismatch: int, fold: bool = True) -> Scores:
    n = len(characters) + 1
    table = np.full((n, n), mismatch)
    np.fill_diagonal(table, match)
    table[n - 1, n - 1] = mismatch  # a wildcard matches nothing
    return Scores(characters, table, fold)


def named(name: str) -> Scores:
    if name == "blosum62":
        rows = [[int(x) for x in line.split()] for line in _BLOSUM62.strip("\n").split("\n")]
        table = np.full((len(_ORDER) + 1,) * 2, min(map(min, rows)))  # other characters: the least score
        for i, row in enumerate(rows):
            for j, x in enumerate(row):
                table[i, j] = table[j, i] = x
        return Scores(_ORDER, table, fold=False)
    if name == "unit_score_aa":
        return unit(_ORDER[:20], 1, -1, fold=False)
    if name == "unit_score_nuc":
        return unit("ACGT", 2, -1)
    if name == "unit_score_nuc_2_2":
        return unit("ACGT", 2, -2)
    if name == "unit_score_nuc_lower":
        return unit("acgt", 2, -1, fold=False)
    if name == "unit_score_nuc_upper":
        return unit("ACGT", 2, -1, fold=False)
    raise ValueError(f"no score matrix {name}")


def read_matrix(text: str) -> Scores:
    """A square text matrix: a line of characters, then a line for each character."""
    lines = [x.split() for x in text.splitlines() if x.strip() and not x.startswith("#")]
    chars = [c for c in lines[0] if len(c) == 1]
    table = np.array([[int(v) for v in row[1 : len(chars) + 1]] for row in lines[1 : len(chars) + 1]])
    full = np.full((len(chars) + 1,) * 2, table.min())
    full[:-1, :-1] = table
    return Scores("".join(chars), full, fold=False)
