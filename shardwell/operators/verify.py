"""Integrity: recomputed digests, sidecar checksums and audits
(M-01..M-06, M-12, M-16, M-18, J-14, A-07, A-08, A-11, A-13, SC-35, SK-19..SK-22, F-16)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shardwell.functions import digest as dg
from shardwell.functions import hashing

RECORD_VERSION = 1


class WrongAlgorithm(RuntimeError):
    """A checksum record was made with another algorithm."""


def verify(objects: DataFrame, algorithm: str = "sha256", fan_out: int = 0, levels: int = 0) -> DataFrame:
    """(digest, state): verified, corrupt, not-verified (unreadable) or invalid_digest (another width, or too short for the layout).

    One scan, no shuffle (M-01..M-03, M-16).
    """
    d = F.col("digest")
    fine = dg.has_width(d, algorithm) & dg.is_addressable(d, fan_out, levels)
    state = (
        F.when(~fine, F.lit("invalid_digest"))
        .when(F.col("content").isNull(), F.lit("not-verified"))
        .when(hashing.digest(algorithm, F.col("content")) == d, F.lit("verified"))
        .otherwise(F.lit("corrupt"))
    )
    return objects.select("digest", state.alias("state"))


def tally(states: DataFrame) -> DataFrame:
    """checked, verified, corrupt, unchecked (A-07, A-13)."""
    s = F.col("state")
    return states.agg(F.count("*").alias("checked"), F.count_if(s == "verified").alias("verified"), F.count_if(s == "corrupt").alias("corrupt"), F.count_if(~s.isin("verified", "corrupt")).alias("unchecked"))


def bad(states: DataFrame) -> DataFrame:
    """Corrupt digests as text, in order (M-18)."""
    return states.filter("state = 'corrupt'").select(dg.to_text(F.col("digest")).alias("hash")).orderBy("hash")


def record(objects: DataFrame, algorithm: str, now: Column) -> DataFrame:
    """Checksum records of stored bytes (SK-19); type and codec come from the header, NULL without one."""
    from shardwell.functions import envelope

    rows = objects.filter("content is not null").withColumn("_h", envelope.peek(F.col("content")))
    return rows.select(
        "digest",
        F.lit(RECORD_VERSION).alias("version"),
        F.col("_h.type").alias("type"),
        F.col("_h.codec").alias("codec"),
        F.lit(algorithm).alias("algo"),
        hashing.digest(algorithm, F.col("content")).alias("checksum"),
        F.octet_length("content").cast("long").alias("size"),
        now.alias("created_at"),
    )


def add_records(records: DataFrame, fresh: DataFrame) -> DataFrame:
    """Records after a put: one of the same digest and algorithm is not refreshed, one of another algorithm is replaced (SK-19, SK-21)."""
    new = fresh.join(records.select("digest", "algo"), ["digest", "algo"], "left_anti")
    return records.join(new.select("digest"), "digest", "left_anti").unionByName(new.select(*records.columns))


def delete_with_records(objects: DataFrame, records: DataFrame, doomed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(objects, records) without ``doomed``: an object and its record go together (SK-22)."""
    gone = doomed.select("digest").filter("digest is not null").distinct()
    return objects.join(gone, "digest", "left_anti"), records.join(gone, "digest", "left_anti")


def encode_record(row: DataFrame, cap: int = 4096) -> DataFrame:
    """JSON of a record within ``cap`` bytes: the optional type and codec are dropped first, then it is too large (SK-20)."""

    def json(full: bool) -> Column:
        parts = [F.col("version"), dg.to_text(F.col("digest")).alias("digest")]
        parts += [F.nullif("type", F.lit("")).alias("type"), F.nullif("codec", F.lit("")).alias("codec")] if full else []
        parts += [F.col("algo").alias("checksum_algo"), dg.to_text(F.col("checksum")).alias("checksum"), "size", F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("created_at")]
        return F.to_json(F.struct(*parts))

    small = F.when(F.octet_length(json(True)) <= cap, json(True)).when(F.octet_length(json(False)) <= cap, json(False))
    return row.withColumn("json", small).withColumn("status", F.when(F.col("json").isNull(), F.lit("record_too_large")).otherwise(F.lit("ok")))


def record_status(records: DataFrame, named: Column | None = None) -> DataFrame:
    """``records`` with record_status ok or corrupt: every required field, the known version and, if given, the digest its file names (F-16, SC-35)."""
    ok = (
        (F.col("version") == RECORD_VERSION)
        & dg.is_present(F.col("digest"))
        & (F.coalesce("algo", F.lit("")) != "")
        & dg.is_present(F.col("checksum"))
        & (F.coalesce("size", F.lit(-1)) >= 0)
        & F.col("created_at").isNotNull()
    )
    if named is not None:
        ok = ok & (F.col("digest") == named)
    return records.withColumn("record_status", F.when(F.coalesce(ok, F.lit(False)), F.lit("ok")).otherwise(F.lit("corrupt")))


def verify_checksums(objects: DataFrame, records: DataFrame, algorithm: str, strict: bool = False) -> DataFrame:
    """(digest, state): verified, corrupt, unrecorded, unreadable, wrong_algorithm or bad_record (J-14, M-04, M-05, G-19).

    With ``strict`` a record of another algorithm aborts, found before any content is read.
    """
    told = record_status(records)
    if strict and not told.filter((F.col("record_status") == "ok") & (F.col("algo") != algorithm)).isEmpty():
        raise WrongAlgorithm(f"some records were not made with {algorithm}")
    state = (
        F.when(F.col("record_status").isNull(), F.lit("unrecorded"))
        .when(F.col("record_status") != "ok", F.lit("bad_record"))
        .when(F.col("algo") != algorithm, F.lit("wrong_algorithm"))
        .when(F.col("now").isNull(), F.lit("unreadable"))
        .when((F.col("length") != F.col("size")) | (F.col("now") != F.col("checksum")), F.lit("corrupt"))
        .otherwise(F.lit("verified"))
    )
    # contents are hashed where they are; only checksums are shuffled
    mine = objects.select("digest", hashing.digest(algorithm, F.col("content")).alias("now"), F.octet_length("content").cast("long").alias("length"))
    return mine.join(told.select("digest", "algo", "checksum", "size", "record_status"), "digest", "left").select("digest", state.alias("state"))


def counts(states: DataFrame) -> DataFrame:
    """Objects of each state (A-08, A-11)."""
    return states.groupBy("state").agg(F.count("*").alias("objects"))


def exit_status(states: DataFrame) -> int:
    """1 if anything is corrupt (M-06, M-18)."""
    return 0 if states.filter("state in ('corrupt', 'bad_record')").isEmpty() else 1


def audit(objects: DataFrame, reached: DataFrame, states: DataFrame | None) -> DataFrame:
    """(digest, state): corrupt before orphaned before verified; without verification orphaned or unverified (M-12, S-08)."""
    there = reached.select("digest").distinct().withColumn("_r", F.lit(True))
    rows = objects.select("digest").join(there, "digest", "left")
    if states is None:
        state = F.when(F.col("_r").isNull(), F.lit("orphaned")).otherwise(F.lit("unverified"))
    else:
        rows = rows.join(states.select("digest", F.col("state").alias("_s")), "digest", "left")
        state = F.when(F.col("_s") == "corrupt", F.lit("corrupt")).when(F.col("_r").isNull(), F.lit("orphaned")).otherwise(F.lit("verified"))
    return rows.select("digest", state.alias("state"))


def sampled(objects: DataFrame, fraction: float, seed: int = 1) -> DataFrame:
    """Extension: verification of a sample, for routine checks of large stores."""
    return verify(objects.sample(fraction, seed))
