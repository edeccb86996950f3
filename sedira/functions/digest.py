"""Digests and checksums. What the JVM has is used there; the rest goes by Arrow.

Digests cannot be combined from parts, so a stream in chunks is folded in order within its group; CRC-32 and Adler-32 can
be combined by length, and CRC-32 is (see operators.relations).
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

KINDS = ("md5", "sha1", "sha224", "sha256", "sha512")
#: Generator polynomials.
CRC32, CRC32C, CRC32_FORWARD = 0xEDB88320, 0x82F63B78, 0x04C11DB7


def digest(data: Column, kind: str = "md5") -> Column:
    if kind == "md5":
        return F.md5(data)
    if kind == "sha1":
        return F.sha1(data)
    return F.sha2(data, int(kind[3:]))


def digest_by(kind: Column, data: Column) -> Column:
    """The kind is a column; only the chosen digest is computed."""
    out = F.when(kind == "md5", F.md5(data))
    for k in KINDS[1:]:
        out = out.when(kind == k, digest(data, k))
    return out


def crc32(data: Column) -> Column:
    return F.crc32(data)


def adler32(data: Column) -> Column:
    """JVM-side fold over bytes, for short values; use adler32_long for blobs."""
    codes = F.transform(F.split(F.regexp_replace(F.hex(data), "(..)", "$1,"), ","), lambda h: F.conv(h, 16, 10).cast("long"))
    codes = F.filter(codes, lambda c: c.isNotNull())
    start = F.struct(F.lit(1).cast("long").alias("a"), F.lit(0).cast("long").alias("b"))
    return F.when(F.octet_length(data) == 0, F.lit(1).cast("long")).otherwise(F.aggregate(codes, start, lambda s, c: F.struct(((s["a"] + c) % 65521).alias("a"), ((s["b"] + s["a"] + c) % 65521).alias("b")), lambda s: s["b"] * 65536 + s["a"]))


def adler32_long(data: Column) -> Column:
    @F.pandas_udf("long")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else zlib.adler32(v)).astype("Int64")

    return run(data)


def _table(poly: int, reverse: bool) -> np.ndarray:
    out = np.arange(256, dtype=np.uint64) if reverse else np.arange(256, dtype=np.uint64) << np.uint64(24)
    for _ in range(8):
        if reverse:
            out = np.where(out & np.uint64(1), out >> np.uint64(1) ^ np.uint64(poly), out >> np.uint64(1))
        else:
            out = np.where(out & np.uint64(1 << 31), out << np.uint64(1) ^ np.uint64(poly), out << np.uint64(1)) & np.uint64(0xFFFFFFFF)
    return out


def crc(values: list[bytes | None], poly: int, reverse: bool = True, initial: int = 0) -> list[int | None]:
    """CRC-32s of many values at once: the step for the i-th byte is taken for all values that have one. `initial` is a running CRC."""
    if poly == CRC32 and reverse:
        return [None if v is None else zlib.crc32(v, initial) for v in values]
    table, mask = _table(poly, reverse), np.uint64(0xFFFFFFFF)
    order = sorted((k for k, v in enumerate(values) if v is not None), key=lambda k: -len(values[k]))
    out: list[int | None] = [None if v is None else initial for v in values]
    if not order:
        return out
    n = np.array([len(values[k]) for k in order])
    at = np.concatenate([[0], np.cumsum(n)[:-1]])
    data = np.frombuffer(b"".join(values[k] for k in order), np.uint8)
    c = np.full(len(order), initial ^ 0xFFFFFFFF, np.uint64)
    alive = len(order)
    for i in range(int(n[0])):
        while n[alive - 1] <= i:
            alive -= 1
        b = data[at[:alive] + i].astype(np.uint64)
        x = c[:alive]
        c[:alive] = table[((x ^ b) & np.uint64(255)).astype(int)] ^ x >> np.uint64(8) if reverse else (table[((x >> np.uint64(24)) ^ b).astype(int)] ^ x << np.uint64(8)) & mask
    for k, v in zip(order, (c ^ mask).tolist()):
        out[k] = v
    return out


def crc_with(data: Column, poly: int = CRC32C, reverse: bool = True) -> Column:
    """CRC-32 with another polynomial or bit order; the common one is crc32()."""
    if poly == CRC32 and reverse:
        return F.crc32(data)

    @F.pandas_udf("long")
    def run(v: pd.Series) -> pd.Series:
        return pd.Series(crc(v.tolist(), poly, reverse), dtype="Int64")

    return run(data)
