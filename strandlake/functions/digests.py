"""64-bit digests of whole sequences, and their wrapping sums."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .codes import signed, wrapped_sum

# The default secrets of the published hash function wyhash, version 4.
_SECRETS = (0x2D358DCCAA6C78A5, 0x8BB84B93962EACC9, 0x4B33A62ED433D4A3, 0x4D5A2DA51DE1AA47)
_ALL = (1 << 64) - 1


def _folded(a: int, b: int) -> int:
    """Both halves of a product, as one."""
    product = a * b
    return (product ^ product >> 64) & _ALL


def wyhash(data: bytes, seed: int = 0) -> int:
    n = len(data)
    number = lambda at, size: int.from_bytes(data[at : at + size], "little")
    state = seed ^ _folded(seed ^ _SECRETS[0], _SECRETS[1])
    if n > 16:
        at = 0
        if n >= 48:
            lanes = [state] * 3
            for at in range(0, n - 47, 48):
                lanes = [_folded(number(at + 16 * k, 8) ^ _SECRETS[k + 1], number(at + 16 * k + 8, 8) ^ x) for k, x in enumerate(lanes)]
            at, state = at + 48, lanes[0] ^ lanes[1] ^ lanes[2]
        while n - at > 16:
            state = _folded(number(at, 8) ^ _SECRETS[1], number(at + 8, 8) ^ state)
            at += 16
        a, b = number(n - 16, 8), number(n - 8, 8)
    elif n >= 4:
        inner = n // 8 * 4
        a, b = number(0, 4) << 32 | number(inner, 4), number(n - 4, 4) << 32 | number(n - 4 - inner, 4)
    else:
        a, b = (data[0] << 16 | data[n // 2] << 8 | data[n - 1] if n else 0), 0
    product = (a ^ _SECRETS[1]) * (b ^ state)
    return _folded(product & _ALL ^ _SECRETS[0] ^ n, product >> 64 ^ _SECRETS[1])


def digests(sequences: DataFrame, kind: str = "wyhash") -> DataFrame:
    """(seq_id, digest): `wyhash` or `xxh64`, both of seed 0, as BIGINT patterns."""
    make = wyhash if kind == "wyhash" else xxhash.xxh64_intdigest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([signed(make((s or "").encode())) for s in b.column(1).to_pylist()], pa.int64())], names=["seq_id", "digest"])

    return sequences.select(F.col("seq_id").cast("long").alias("seq_id"), "sequence").mapInArrow(run, "seq_id long, digest long")


def digest_sum(sequences: DataFrame, kind: str = "wyhash") -> DataFrame:
    """One row: the sum of all digests modulo 2**64, as digits."""
    return digests(sequences, kind).agg(wrapped_sum(F.col("digest")).alias("digest_sum"))
