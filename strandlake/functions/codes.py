"""Codes and hashes of q-grams, as column expressions and for whole sequences in numpy.

Hashes are 64-bit patterns kept in BIGINT. The rolling hash of a q-gram is the XOR
of a rotated seed for each character; as XOR takes no carry, the rotated seeds are a
table of literals and nothing rolls."""

from __future__ import annotations

import functools

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from .alphabet import DNA, PROTEIN, encode, reverse_complement_ranks

# 64-bit seeds by rank, for nucleotides and for amino acids.
DNA_SEEDS = (0x3C8BFBB395C60474, 0x3193C18562A02B4C, 0x20323ED082572324, 0x295549F54BE24456)
PROTEIN_SEEDS = (
    0xE6CC5634828DE226, 0xC3916818AB69EAEF, 0x708B967AB82D90DA, 0x97EE132403084238, 0x54B5F4F96AA2B4C6,
    0xA16E4815AEB82F9C, 0xD45994107632BA9E, 0x52CA8A666024FEB4, 0x4B7BE4E0445E0FB4, 0x10936D371508CFBB,
    0x9845685EF8E90AC2, 0xBC57ED4598240F30, 0x4ADD75731C811286, 0xF4EADE76635CE527, 0x725F7D219B2873BC,
    0x2A90195B4166C058, 0xEABF48D47DA98AED, 0x7BE88554E92B4BF9, 0x211DFFCF403D167C, 0x8454A6A3B239AE9E,
)
FNV_OFFSET, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3
_ALL = (1 << 64) - 1


def signed(x: int) -> int:
    """The BIGINT of a 64-bit pattern."""
    return x - (1 << 64) if x >> 63 else x


def turned(x: int) -> int:
    """One step: rotate left by 1, then exchange bits 0 and 33 if they differ."""
    x = (x << 1 | x >> 63) & _ALL
    differ = (x ^ x >> 33) & 1
    return x ^ (differ | differ << 33)


def seed_table(q: int, alphabet: str = DNA) -> list[list[int]]:
    """[place][rank]: what a character at a place of a q-gram adds."""
    row, rows = list(DNA_SEEDS if alphabet == DNA else PROTEIN_SEEDS), []
    for _ in range(q):
        rows.append(row)
        row = [turned(x) for x in row]
    return rows[::-1]


def hash_qgram(qgram: Column, q: int, alphabet: str = DNA) -> Column:
    """Hash of a column of valid q-grams."""
    total = None
    for i, row in enumerate(seed_table(q, alphabet)):
        c = F.substring(qgram, i + 1, 1)
        if alphabet == DNA:
            c = F.translate(F.upper(c), "U", "T")
        value = F.when(c == alphabet[0], F.lit(signed(row[0])))
        for letter, x in zip(alphabet[1:], row[1:]):
            value = value.when(c == letter, F.lit(signed(x)))
        total = value if total is None else total.bitwiseXOR(value)
    return total


def reverse_hash_qgram(qgram: Column, q: int) -> Column:
    """Hash of the reverse complement of a column of valid q-grams."""
    return hash_qgram(F.translate(decode_ranks(reverse_complement_ranks(encode(qgram))), "", ""), q)


def decode_ranks(ranks: Column) -> Column:
    return F.translate(ranks, "0123", DNA)


def masked(hash_: Column, bits: int) -> Column:
    return hash_ if bits >= 64 else hash_.bitwiseAND(F.lit((1 << bits) - 1))


def canonical(forward: Column, reverse: Column, bits: int = 63) -> Column:
    """The smaller of the hashes of both strands, over their lowest bits."""
    return F.least(masked(forward, bits), masked(reverse, bits))


def unsigned(x: Column) -> Column:
    """The BIGINT's pattern as an unsigned DECIMAL."""
    return F.when(x < 0, x.cast("decimal(38,0)") + F.lit(str(1 << 64)).cast("decimal(38,0)")).otherwise(x.cast("decimal(38,0)"))


def wrapped_sum(x: Column) -> Column:
    """Sum of 64-bit patterns modulo 2**64, as a string of digits."""
    total = F.sum(unsigned(x))
    return (total % F.lit(str(1 << 64)).cast("decimal(38,0)")).cast("decimal(20,0)").cast("string")


def code(qgram: Column, alphabet: str = DNA) -> Column:
    """The q-gram's ranks as a number to the alphabet's size; q up to 31 for DNA and
    14 for proteins."""
    if alphabet == DNA:
        return F.conv(encode(qgram), 4, 10).cast("bigint")
    return F.aggregate(encode(qgram, alphabet), F.lit(0).cast("bigint"), lambda a, r: a * len(alphabet) + r)


def reverse_code(qgram: Column) -> Column:
    return F.conv(reverse_complement_ranks(encode(qgram)), 4, 10).cast("bigint")


def decode_code(number: Column, q: int, complement: bool = False) -> Column:
    digits = F.lpad(F.conv(number.cast("string"), 10, 4), q, "0")
    return F.translate(digits, "0123", "TGCA" if complement else DNA)


def decode_protein_code(number: Column, q: int) -> Column:
    """Whole-number division, so that codes of 14 residues come back exactly."""
    whole = lambda i: F.call_function("div", number, F.lit(len(PROTEIN) ** (q - 1 - i)).cast("long"))
    place = lambda i: F.substr(F.lit(PROTEIN), (whole(i) % len(PROTEIN) + 1).cast("int"), F.lit(1))
    return F.concat(*[place(i) for i in range(q)])


def seeded_fnv(value: Column, seed: int) -> Column:
    """FNV-1a of a seed and a BIGINT's eight bytes, lowest first, wrapping: products
    modulo 2**64 are built of 32-bit halves, so that none overflows."""
    def times(h: Column) -> Column:
        low, high = h.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(h, 32)
        p_low, p_high = FNV_PRIME & 0xFFFFFFFF, FNV_PRIME >> 32
        bottom = low * p_low  # below 2**41
        top = (high * p_low + low * p_high + F.shiftrightunsigned(bottom, 32)).bitwiseAND(F.lit(0xFFFFFFFF))
        return F.shiftleft(top, 32).bitwiseOR(bottom.bitwiseAND(F.lit(0xFFFFFFFF)))

    bytes_ = F.array(*[F.shiftrightunsigned(value, 8 * i).bitwiseAND(F.lit(0xFF)) for i in range(8)])
    first = F.lit(signed(((FNV_OFFSET ^ seed) * FNV_PRIME) & _ALL))
    return F.aggregate(bytes_, first, lambda h, b: times(h.bitwiseXOR(b)))


def seeded_fnv_int(value: int, seed: int) -> int:
    h = ((FNV_OFFSET ^ seed) * FNV_PRIME) & _ALL
    for i in range(8):
        h = ((h ^ (value >> 8 * i & 0xFF)) * FNV_PRIME) & _ALL
    return h


# Whole sequences in numpy.

_RANKS = {}


def ranks(sequence: str, alphabet: str = DNA) -> np.ndarray:
    """Ranks of a sequence; the alphabet's size where a character has none."""
    if alphabet not in _RANKS:
        table = np.full(256, len(alphabet), dtype=np.uint8)
        for i, c in enumerate(alphabet):
            table[ord(c)] = i
            if alphabet == DNA:
                table[ord(c.lower())] = i
        if alphabet == DNA:
            table[ord("U")] = table[ord("u")] = 3
        _RANKS[alphabet] = table
    return _RANKS[alphabet][np.frombuffer(sequence.encode("latin-1", "replace"), dtype=np.uint8)]


def runs(r: np.ndarray, size: int, least: int) -> list[tuple[int, int]]:
    """(start, end) of maximal runs of ranks below size, of `least` or more."""
    ok = np.concatenate([[0], (r < size).astype(np.int8), [0]])
    edge = np.diff(ok)
    return [(a, b) for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()) if b - a >= least]


def window_hashes(r: np.ndarray, q: int, alphabet: str = DNA, reverse: bool = False) -> np.ndarray:
    """Hashes (uint64) of all q-grams of a run of ranks; of reverse complements if asked.
    Characters are looked up some at a time, by the code of a short window."""
    n = max(0, len(r) - q + 1)
    total = np.zeros(n, dtype=np.uint64)
    codes: dict[int, np.ndarray] = {}
    for at, width, table in _hash_tables(q, alphabet, reverse):
        if width not in codes:
            codes[width] = window_codes(r, width, len(alphabet))
        total ^= table.take(codes[width][at : at + n])
    return total


@functools.lru_cache(maxsize=32)
def _hash_tables(q: int, alphabet: str, reverse: bool) -> list[tuple[int, int, np.ndarray]]:
    """(place, width, table) for each piece of a q-gram: what the piece with a code adds
    to the hash. Tables have at most 2**16 rows."""
    seeds = np.array(seed_table(q, alphabet), dtype=np.uint64)
    rows = [seeds[q - 1 - i][::-1] if reverse else seeds[i] for i in range(q)]
    widest = 1
    while len(alphabet) ** (widest + 1) <= 1 << 16:
        widest += 1
    out = []
    for at in range(0, q, widest):
        table = np.zeros(1, dtype=np.uint64)
        for row in rows[at : at + widest]:
            table = (table[:, None] ^ row[None, :]).ravel()
        out.append((at, min(widest, q - at), table))
    return out


def window_codes(r: np.ndarray, q: int, size: int = 4, reverse: bool = False) -> np.ndarray:
    """Integer codes of all q-grams of a run of ranks; of reverse complements if asked.
    Codes of w characters make those of 2 w, and the widths in q are joined."""
    n = max(0, len(r) - q + 1)
    step = (3 - r.astype(np.int64)) if reverse else r.astype(np.int64)
    total, done, width = np.zeros(n, dtype=np.int64), 0, 1
    while True:
        if q & width:
            part = step[done : done + n]
            total = part * size**done + total if reverse else total * size**width + part
            done += width
        if done == q:
            return total
        first, second = step[:-width], step[width:]
        step = second * size**width + first if reverse else first * size**width + second
        width *= 2
