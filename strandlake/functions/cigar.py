"""Edit scripts, identities and scores as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Gap costs (open, extension) with lambda and kappa of scores of
# gapped local alignments under the matrix blosum62.
GAPPED = {
    (11, 2): (0.297, 0.082), (10, 2): (0.291, 0.075), (9, 2): (0.279, 0.058), (8, 2): (0.264, 0.045), (7, 2): (0.239, 0.027), (6, 2): (0.201, 0.012),
    (13, 1): (0.292, 0.071), (12, 1): (0.283, 0.059), (11, 1): (0.267, 0.041), (10, 1): (0.243, 0.024), (9, 1): (0.206, 0.010),
}


def operations(cigar: Column) -> Column:
    """array<struct<n, op>> of a CIGAR string over = X I D M."""
    parts = F.regexp_extract_all(cigar, F.lit(r"(\d+[=XIDM])"), 1)
    return F.transform(parts, lambda p: F.struct(F.regexp_extract(p, r"^(\d+)", 1).cast("int").alias("n"), F.right(p, F.lit(1)).alias("op")))


def render(ops: Column) -> Column:
    return F.array_join(F.transform(ops, lambda o: F.concat(o["n"].cast("string"), o["op"])), "")


def total(cigar: Column, kinds: str) -> Column:
    return F.aggregate(operations(cigar), F.lit(0), lambda a, o: a + F.when(F.instr(F.lit(kinds), o["op"]) > 0, o["n"]).otherwise(0))


def edits(cigar: Column) -> Column:
    return total(cigar, "XID")


def aligned_length(cigar: Column) -> Column:
    """Residues of both sequences that the script covers."""
    return 2 * total(cigar, "=XM") + total(cigar, "ID")


def error_percentage(cost: Column, both_lengths: Column) -> Column:
    return F.lit(200.0) * cost / both_lengths


def identity(cigar: Column) -> Column:
    return F.lit(100.0) - error_percentage(edits(cigar), aligned_length(cigar))


def script_score(cigar: Column, match: int, mismatch: int, gap_open: int, gap_extend: int) -> Column:
    """Score of a script: matches and mismatches, and open + n * extend for each gap."""
    each = lambda o: F.when(o["op"] == "=", o["n"] * match).when(o["op"] == "X", o["n"] * mismatch).when(o["op"].isin("I", "D"), -(gap_open + o["n"] * gap_extend)).otherwise(0)
    return F.aggregate(operations(cigar), F.lit(0), lambda a, o: a + each(o))


def packed_operations(cigar: Column) -> Column:
    """Each operation as one number: count in the upper bits, kind (= 7, X 8, I 1,
    D 2, M 0) in the lower four."""
    kind = lambda o: F.when(o == "=", 7).when(o == "X", 8).when(o == "I", 1).when(o == "D", 2).otherwise(0)
    return F.transform(operations(cigar), lambda o: F.shiftleft(o["n"], 4).bitwiseOR(kind(o["op"])))


def bit_score(raw: Column, gap_open: int = 11, gap_extend: int = 1) -> Column:
    """Raw score to bits, for gap costs whose parameters are known; else an error."""
    if (gap_open, gap_extend) not in GAPPED:
        raise ValueError(f"no parameters for gap costs {gap_open}/{gap_extend}")
    lam, kappa = GAPPED[gap_open, gap_extend]
    return F.floor(raw * F.lit(lam / math.log(2)) - F.lit(math.log(kappa) / math.log(2)) + 0.5).cast("int")


def coverage(aligned: Column, length: Column) -> Column:
    return F.round(F.lit(100.0) * aligned / length, 2)
