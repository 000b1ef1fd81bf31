"""Content hashes and checksums; checksums are big-endian bytes (X-20..X-25, E-01)."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

CRC64_POLY = 0xC96C5795D7870F42  # reflected ECMA polynomial, fixed by the checksum


def sha256(data: Column) -> Column:
    return F.unhex(F.sha2(data, 256))


def sha512(data: Column) -> Column:
    return F.unhex(F.sha2(data, 512))


def crc32(data: Column) -> Column:
    return F.unhex(F.lpad(F.hex(F.crc32(data)), 8, "0"))


def _mapped(function):
    @F.pandas_udf("binary")
    def run(data: pd.Series) -> pd.Series:
        return data.map(lambda x: None if x is None else function(bytes(x)))

    return run


def sha512_256(data: Column) -> Column:
    """SHA-512/256, which has its own initial state and is no cut SHA-512; Arrow batches through hashlib."""
    return _mapped(lambda x: hashlib.new("sha512_256", x).digest())(data)


def adler32(data: Column) -> Column:
    return _mapped(lambda x: zlib.adler32(x).to_bytes(4, "big"))(data)


def crc64_table() -> list[int]:
    """The table by its rule."""
    out = []
    for x in range(256):
        for _ in range(8):
            x = (x >> 1) ^ (CRC64_POLY if x & 1 else 0)
        out.append(x)
    return out


def crc64_bytes(data: bytes, table: list[int] | None = None) -> int:
    table = table or crc64_table()
    c = 2**64 - 1
    for b in data:
        c = table[(c ^ b) & 255] ^ (c >> 8)
    return c ^ (2**64 - 1)


def crc64_many(values: list[bytes]) -> list[int]:
    """CRC-64 of each value, a byte of all of them at a time; the long rest of a few is read one by one."""
    table = np.array(crc64_table(), dtype=np.uint64)
    order = sorted(range(len(values)), key=lambda i: -len(values[i]))
    sizes = np.array([len(values[i]) for i in order], dtype=np.int64)
    raw = np.frombuffer(b"".join(values[i] for i in order), np.uint8)
    starts = np.cumsum(sizes) - sizes
    c = np.full(len(order), 2**64 - 1, dtype=np.uint64)
    at = 0
    many = len(order)
    while many > 8 and at < sizes[0]:
        many = int(np.searchsorted(-sizes, -at, "left"))  # values longer than `at`
        if many <= 8:
            break
        c[:many] = table[(c[:many] ^ raw[starts[:many] + at]) & np.uint64(255)] ^ (c[:many] >> np.uint64(8))
        at += 1
    plain = table.tolist()
    out = [0] * len(order)
    for k, i in enumerate(order):
        x = int(c[k])
        for b in values[i][at:] if len(values[i]) > at else b"":
            x = plain[(x ^ b) & 255] ^ (x >> 8)
        out[i] = x ^ (2**64 - 1)
    return out


def crc64(data: Column) -> Column:
    @F.pandas_udf("binary")
    def run(data: pd.Series) -> pd.Series:
        there = data.notna()
        found = iter(crc64_many([bytes(x) for x in data[there]]))
        return pd.Series([next(found).to_bytes(8, "big") if ok else None for ok in there], dtype=object)

    return run(data)


def adler32_closed(data: Column) -> Column:
    """Adler-32 in the JVM by its closed form, A = 1 + sum(b), B = n + sum((n - i) b), mod 65521; for small values, since it lists the bytes."""
    n = F.octet_length(data)
    at = F.sequence(F.lit(1), F.greatest(n, F.lit(1)))
    byte = lambda i: F.coalesce(F.conv(F.hex(F.substring(data, i, 1)), 16, 10).cast("long"), F.lit(0))
    start = F.struct(F.lit(1).cast("long").alias("a"), F.lit(0).cast("long").alias("b"))

    def step(acc, i):
        a = (acc["a"] + byte(i)) % 65521
        return F.struct(a.alias("a"), ((acc["b"] + a) % 65521).alias("b"))

    return F.when(data.isNull(), None).when(n == 0, F.lit(1).cast("long")).otherwise(F.aggregate(at, start, step, lambda acc: acc["b"] * 65536 + acc["a"]))


ALGORITHMS = {"sha256": sha256, "sha512": sha512, "sha512_256": sha512_256, "crc32": crc32, "crc64": crc64, "adler32": adler32}


def digest(algorithm: str, data: Column) -> Column:
    if algorithm not in ALGORITHMS:
        raise ValueError(f"unknown algorithm {algorithm!r}; known: {', '.join(sorted(ALGORITHMS))}")
    return ALGORITHMS[algorithm](data)
