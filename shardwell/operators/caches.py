"""What caches decide, over access logs, and Spark's own cache for the rest (C-01..C-04, C-07, C-10, C-11, A-12, W-07, G-23)."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lru_hits(accesses: DataFrame, capacity: int, session: str = "session") -> DataFrame:
    """Each access (session, step, digest) with ``hit``: whether an LRU cache of ``capacity`` entries holds the digest then (C-04, C-11).

    The order of accesses is the operator's meaning, so a session's rows are read in turn, a batch at a time.
    """
    from collections import OrderedDict

    kinds = dict(accesses.dtypes)
    rows = accesses.select(session, "step", "digest").repartition(session).sortWithinPartitions(session, "step")

    def run(batches):
        now, held = None, OrderedDict()
        for b in batches:
            hits = []
            for s, d in zip(b[session], b["digest"]):
                if s != now:
                    now, held = s, OrderedDict()
                key = bytes(d) if isinstance(d, (bytes, bytearray)) else d
                hits.append(key in held)
                held[key] = None
                held.move_to_end(key)
                if len(held) > capacity:
                    held.popitem(last=False)
            yield b.assign(hit=hits)

    return rows.mapInPandas(run, f"{session} {kinds[session]}, step {kinds['step']}, digest {kinds['digest']}, hit boolean")


def cache_stats(hits: DataFrame) -> DataFrame:
    """hits, misses and rate (A-12)."""
    return hits.agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses")).withColumn("rate", F.when(F.col("hits") + F.col("misses") > 0, F.col("hits") / (F.col("hits") + F.col("misses"))).otherwise(F.lit(0.0)))


class Snapshot:
    """A cached table that is made anew when it is older than its time to live (C-07, O-13, C-01, C-10)."""

    def __init__(self, make: Callable[[], DataFrame], ttl_seconds: float = 0.5, clock: Callable[[], float] = time.monotonic) -> None:
        self._make, self._ttl, self._clock = make, ttl_seconds, clock
        self._df: DataFrame | None = None
        self._at = 0.0

    def get(self) -> DataFrame:
        if self._df is None or self._clock() - self._at > self._ttl:
            old, self._df = self._df, self._make().persist()
            self._at = self._clock()
            if old is not None:
                old.unpersist()
        return self._df

    def clear(self) -> bool:
        """Whether there was anything to clear."""
        had = self._df is not None
        if had:
            self._df.unpersist()
            self._df = None
        return had


def preload(objects: DataFrame, wanted: DataFrame, tolerate_missing: bool) -> DataFrame:
    """The wanted objects, cached; without tolerance a missing one raises before anything is read (C-02, C-03)."""
    if not tolerate_missing:
        gone = wanted.join(objects.select("digest"), "digest", "left_anti").select(F.hex("digest")).first()
        if gone:
            raise KeyError(f"not found: {gone[0].lower()}")
    return objects.join(wanted.select("digest").distinct(), "digest", "left_semi").persist()


def latest_verification(results: DataFrame) -> DataFrame:
    """The newest result of each session and digest (W-07, G-23)."""
    return results.groupBy("session", "digest").agg(F.max_by("state", "step").alias("state"), F.max("step").alias("step"))
