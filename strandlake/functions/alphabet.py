"""Alphabets and single-sequence functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters by rank, and the characters that are valid.
DNA = "ACGT"
DNA_VALID = "ACGTUacgtu"
PROTEIN = "ACDEFGHIKLMNPQRSTVWY"
#: Order of a protein alphabet in which similar residues are neighbours.
PROTEIN_SIMILAR = "LVIFKREDAGSTNQYWPHMC"
#: Letters that no nucleotide code uses.
PROTEIN_ONLY = "LIFEQPXZ"


def valid(alphabet: str) -> str:
    """A character class of an alphabet's valid characters."""
    return f"[{DNA_VALID}]" if alphabet == DNA else f"[{alphabet}]"


def invalid(alphabet: str) -> str:
    return f"[^{DNA_VALID}]" if alphabet == DNA else f"[^{alphabet}]"


def char_rank(char: Column, alphabet: str = DNA) -> Column:
    """The rank of one character; the alphabet's size where it has none."""
    if alphabet == DNA:
        char = F.translate(F.upper(char), "U", "T")
    at = F.instr(F.lit(alphabet), char)
    return F.when((F.length(char) == 1) & (at > 0), at - 1).otherwise(F.lit(len(alphabet)))


def rank_char(rank: Column, alphabet: str = DNA) -> Column:
    return F.when((rank >= 0) & (rank < len(alphabet)), F.substring(F.lit(alphabet), (rank + 1).cast("int"), F.lit(1)))


def encode(sequence: Column, alphabet: str = DNA) -> Column:
    """Each character's rank: a digit string for DNA (4 for no rank), else an array."""
    if alphabet == DNA:
        return F.regexp_replace(F.translate(sequence, "ACGTUacgtu", "0123301233"), "[^0-3]", "4")
    return F.transform(F.filter(F.split(sequence, ""), lambda c: c != ""), lambda c: char_rank(c, alphabet))


def decode(ranks: Column) -> Column:
    return F.translate(ranks, "0123", DNA)


def reverse_complement(sequence: Column) -> Column:
    """Reverse; upper-case A, C, G, T become their complements, all else stays."""
    return F.reverse(F.translate(sequence, "ACGT", "TGCA"))


def reverse_complement_ranks(ranks: Column) -> Column:
    return F.reverse(F.translate(ranks, "0123", "3210"))


def bits_for(n: Column) -> Column:
    """How many bits hold the number; 0 for 0."""
    return F.when(n == 0, 0).otherwise(F.length(F.bin(n))).cast("int")


def short_header(header: Column) -> Column:
    """Up to the first white space."""
    return F.regexp_extract(header, r"^(\S*)", 1)


def bar_header(header: Column) -> Column:
    """Between the first two bars; to the end with one bar; short_header without."""
    rest = F.regexp_extract(header, r"\|([^|]*)", 1)
    return F.when(F.contains(header, F.lit("|")), rest).otherwise(short_header(header))


def looks_protein(sequence: Column, prefix: int = 1000) -> Column:
    """A letter that no nucleotide code uses is among the first residues."""
    return F.substring(sequence, 1, prefix).rlike(f"[{PROTEIN_ONLY}]")


def char_class(char: Column) -> Column:
    """(code >> 1) & 3: A 0, C 1, T 2, G 3, in either case."""
    return F.shiftright(F.ascii(char), 1).bitwiseAND(F.lit(3))


def wildcards_as_a(sequence: Column) -> Column:
    return F.regexp_replace(sequence, invalid(DNA), "A")


def same_residue(a: Column, b: Column, alphabet: str = DNA) -> Column:
    """Equal and valid: two wildcards don't match."""
    return (a == b) & a.rlike("^" + valid(alphabet) + "$")


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the longest common prefix: the first place of a difference."""
    n = F.least(F.length(a), F.length(b))
    places = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: (i <= n) & (F.substr(a, i, F.lit(1)) != F.substr(b, i, F.lit(1))))
    return F.coalesce(F.get(places, 0) - 1, n)


def common_suffix(a: Column, b: Column) -> Column:
    return common_prefix(F.reverse(a), F.reverse(b))


def hamming(a: Column, b: Column) -> Column:
    """Mismatches of two strings over the shorter length."""
    n = F.least(F.length(a), F.length(b))
    return F.when(n == 0, 0).otherwise(F.size(F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substr(a, i, F.lit(1)) != F.substr(b, i, F.lit(1)))))


def substring_view(sequence: Column, start: Column, length: Column, reverse: bool = False) -> Column:
    """`length` characters from 0-based `start`; of the reverse complement if asked."""
    whole = reverse_complement(sequence) if reverse else sequence
    return F.substr(whole, start + 1, length)


def all_digits(text: Column) -> Column:
    return text.rlike("^[0-9]+$")


def wrapped(sequence: Column, width: int) -> Column:
    """Lines of `width` characters; one line for width 0."""
    return sequence if width == 0 else F.regexp_replace(sequence, f"(.{{{width}}})(?=.)", "$1\n")


def packed_hex(sequence: Column) -> Column:
    """Two bits a base, four bases a byte, the last byte filled with A: hex digits."""
    full = F.rpad(encode(sequence), (F.ceil(F.length(sequence) / 4) * 4).cast("int"), F.lit("0"))
    pairs = F.transform(F.regexp_extract_all(full, F.lit("(..)"), 1), lambda p: F.conv(p, 4, 16))
    return F.when(F.length(sequence) == 0, "").otherwise(F.array_join(pairs, ""))


def unpacked(hex_digits: Column, length: Column) -> Column:
    each = F.transform(F.filter(F.split(hex_digits, ""), lambda c: c != ""), lambda c: F.lpad(F.conv(c, 16, 4), 2, "0"))
    return F.translate(F.substr(F.array_join(each, ""), F.lit(1), length), "0123", DNA)
