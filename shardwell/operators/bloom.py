"""Bloom filters as tables of words: build, probe, counting, guard and persistence (B-01..B-09, A-18..A-20, J-20, X-62, E-10, E-11).

A filter is a table (word, bits), so it grows over many rows and no task holds it whole.  Positions come from two hashes of the digest,
the same in every process.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_BITS = 2**32


def parameters(items: int, rate: float) -> tuple[int, int]:
    """(bits, hashes) for a number of items and a rate of false positives (X-62)."""
    if not 0 < rate < 1:
        raise ValueError(f"rate {rate} must be between 0 and 1")
    if items == 0:
        return 1, 1
    bits = -items * math.log(rate) / math.log(2) ** 2
    if bits > MOST_BITS:
        raise ValueError(f"{items} items at rate {rate} need {bits:.0f} bits, more than {MOST_BITS}; split the keys")
    m = max(1, int(bits))
    return m, max(1, math.floor(m / items * math.log(2) + 0.5))


def index_hash(data: Column, i: Column) -> Column:
    """A long for the i-th position (B-01)."""
    return F.xxhash64(data, i)


def positions(data: Column, m: int, k: int, hashed: Callable[[Column, Column], Column] = index_hash) -> Column:
    """The k bit positions of a digest, some perhaps equal."""
    if hashed is index_hash:
        return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.pmod(hashed(data, i), F.lit(m)).cast("long"))
    return F.array(*[F.pmod(hashed(data, F.lit(i)), F.lit(m)).cast("long") for i in range(k)])  # Python functions don't run in a lambda


def build(digests: DataFrame, m: int, k: int, hashed: Callable[[Column, Column], Column] = index_hash) -> DataFrame:
    """(word, bits) of the filter; bits are joined map-side (A-18, B-02)."""
    p = digests.filter("digest is not null").select(F.explode(F.array_distinct(positions(F.col("digest"), m, k, hashed))).alias("p"))
    words = p.select(F.floor(F.col("p") / 64).cast("long").alias("word"), F.expr("shiftleft(1L, cast(pmod(p, 64) as int))").alias("one"))
    return words.groupBy("word").agg(F.bit_or("one").alias("bits"))


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    """Filter of both sets (B-07)."""
    return a.unionByName(b).groupBy("word").agg(F.bit_or("bits").alias("bits"))


def probe(digests: DataFrame, filter_: DataFrame, m: int, k: int, hashed: Callable[[Column, Column], Column] = index_hash) -> DataFrame:
    """``digests`` (column digest) with ``maybe``: False is certain, True may be wrong at the filter's rate (B-02)."""
    keyed = digests.select("digest").distinct().withColumn("p", F.explode(F.array_distinct(positions(F.col("digest"), m, k, hashed))))
    hit = keyed.withColumn("word", F.floor(F.col("p") / 64).cast("long")).join(filter_, "word", "left")
    is_set = F.expr("coalesce(bits & shiftleft(1L, cast(pmod(p, 64) as int)), 0L) <> 0L")
    told = hit.groupBy("digest").agg(F.min(is_set.cast("int")).alias("_all"))
    return digests.join(told, "digest", "left").withColumn("maybe", F.coalesce(F.col("_all") == 1, F.lit(False))).drop("_all")


def guarded_exists(wanted: DataFrame, objects: DataFrame, filter_: DataFrame, m: int, k: int) -> DataFrame:
    """Stored rows of ``wanted``: what the filter rules out never meets the store, the rest is checked (B-08, J-20)."""
    maybe = probe(wanted, filter_, m, k).filter("maybe").drop("maybe")
    return maybe.join(objects.select("digest"), "digest", "left_semi")


def false_positives(wanted: DataFrame, objects: DataFrame, filter_: DataFrame, m: int, k: int) -> DataFrame:
    """Digests that the filter lets pass although they are not stored."""
    return probe(wanted, filter_, m, k).filter("maybe").join(objects.select("digest"), "digest", "left_anti")


def counting(digests: DataFrame, m: int, k: int, counter_bits: int = 4) -> DataFrame:
    """(p, n): counters that stop at their largest value (A-19, B-03, B-04)."""
    if counter_bits not in (4, 8, 16):
        raise ValueError("counters have 4, 8 or 16 bits")
    if m * counter_bits // 8 > 2**31:
        raise ValueError("more than 2 GiB of counters; split the keys")
    p = digests.filter("digest is not null").select(F.explode(F.array_distinct(positions(F.col("digest"), m, k))).alias("p"))
    return p.groupBy("p").agg(F.least(F.count("*"), F.lit(2**counter_bits - 1)).alias("n"))


def remove(counters: DataFrame, digests: DataFrame, m: int, k: int) -> DataFrame:
    """Counters after removals, never below 0 (A-20)."""
    gone = digests.filter("digest is not null").select(F.explode(F.array_distinct(positions(F.col("digest"), m, k))).alias("p")).groupBy("p").agg(F.count("*").alias("g"))
    left = counters.join(gone, "p", "left").select("p", F.greatest(F.col("n") - F.coalesce("g", F.lit(0)), F.lit(0)).alias("n"))
    return left.filter("n > 0")


def counting_probe(digests: DataFrame, counters: DataFrame, m: int, k: int) -> DataFrame:
    """As ``probe``, over counters (B-03)."""
    keyed = digests.select("digest").distinct().withColumn("p", F.explode(F.array_distinct(positions(F.col("digest"), m, k))))
    told = keyed.join(counters, "p", "left").groupBy("digest").agg(F.min(F.coalesce("n", F.lit(0))).alias("_least"))
    return digests.join(told, "digest", "left").withColumn("maybe", F.coalesce(F.col("_least") > 0, F.lit(False))).drop("_least")


def save(filter_: DataFrame, path: str, m: int, k: int, key: str) -> None:
    """Write a filter with what it was made with (B-05, B-07)."""
    filter_.withColumns({"m": F.lit(m).cast("long"), "k": F.lit(k), "key": F.lit(key)}).write.mode("overwrite").parquet(path)


def load(spark, path: str, m: int, k: int, key: str) -> DataFrame | None:
    """The filter if it was made with the same size, hashes and key, else None: it has to be built again (B-05)."""
    try:
        rows = spark.read.parquet(path)
        head = rows.select("m", "k", "key").limit(1).collect()
    except Exception:
        return None
    if head and tuple(head[0]) != (m, k, key):
        return None
    return rows.select("word", "bits")


def keyed_hash(key: bytes) -> Callable[[Column, Column], Column]:
    """An index hash of its own for each key: CRC-64 over key, index and data, as a long (B-06)."""
    from shardwell.functions import hashing

    def hashed(data: Column, i: Column) -> Column:
        return F.conv(F.hex(hashing.crc64(F.concat(F.lit(key), i.cast("string").cast("binary"), F.lit(b":"), data.cast("binary")))), 16, -10).cast("long")

    return hashed


#: Factors of the polynomial hash (fixed values).
POLYNOMIALS = (131, 137)


def polynomial_hash(data: Column, i: Column) -> Column:
    """Double hashing by two polynomials over the bytes, modulo 2**64, as a decimal (B-09)."""

    @F.pandas_udf("decimal(20,0)")
    def run(data: pd.Series, i: pd.Series) -> pd.Series:
        out = []
        for x, k in zip(data, i):
            a = b = 0
            for byte in bytes(x):
                a, b = (a * POLYNOMIALS[0] + byte) % 2**64, (b * POLYNOMIALS[1] + byte + 1) % 2**64
            out.append(Decimal((a + int(k) * b) % 2**64))
        return pd.Series(out, dtype=object)

    return run(data, i)
