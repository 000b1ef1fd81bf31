"""Writing and reading typed objects: frames, addresses, deduplication and the order of checks on the way back
(SK-01..SK-04, SK-12..SK-15, SC-18..SC-20, J-02, F-13..F-15, O-09)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shardwell.functions import digest as dg
from shardwell.functions import envelope, hashing


def address(df: DataFrame, content: str = "content", algorithm: str = "sha256") -> DataFrame:
    """Adds the digest of the bytes and their number; NULL bytes count as empty, which is a valid object (G-25)."""
    data = F.coalesce(F.col(content).cast("binary"), F.lit(b""))
    return df.withColumns({"digest": hashing.digest(algorithm, data), "size": F.octet_length(data).cast("long")})


def ingest(df: DataFrame, content: str = "content", algorithm: str = "sha256", by: str | None = None) -> DataFrame:
    """One row per distinct content: digest, size, copies and, with ``by``, the least value of that column as representative.

    Partial aggregation keeps a content with many copies from meeting in one task; only digests are shuffled, not contents.
    """
    rows = address(df, content, algorithm)
    aggs = [F.first("size").alias("size"), F.count("*").alias("copies")]
    return rows.groupBy("digest").agg(*aggs, *([F.min(by).alias(by)] if by else []))


def new_objects(batch: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows of ``batch`` whose digest is not stored, each digest once (SK-04, J-02)."""
    return batch.dropDuplicates(["digest"]).join(stored.select("digest"), "digest", "left_anti")


def put_dedup(batch: DataFrame, stored: DataFrame) -> DataFrame:
    """``batch`` with ``deduplicated``: whether the object was there already (SK-03)."""
    there = stored.select("digest").distinct().withColumn("_there", F.lit(True))
    return batch.join(there, "digest", "left").withColumn("deduplicated", F.coalesce("_there", F.lit(False))).drop("_there")


def put_typed(df: DataFrame, codec: Column, type_name: Column, payload: Column, valid: Column | None = None, algorithm: str = "sha256") -> DataFrame:
    """Frame and address typed payloads; status tells why a row can't be written (SK-01, SK-02, X-30).

    The digest covers the whole frame, so type and codec are part of the identity.
    """
    out = df.withColumn("content", envelope.encode(codec, type_name, payload))
    ok = F.lit(True) if valid is None else F.coalesce(valid, F.lit(False))
    status = F.when(~ok, F.lit("corrupt")).when(F.col("content").isNull(), F.lit("unknown_type")).otherwise(F.lit("ok"))
    out = out.withColumn("status", status).withColumn("content", F.when(F.col("status") == "ok", F.col("content")))
    out = out.withColumn("digest", hashing.digest(algorithm, F.col("content")))
    return out.withColumn("size", F.octet_length("content").cast("long"))


def get_typed(objects: DataFrame, wanted: DataFrame, type_name: str, codec: str, decode: Callable[[Column], Column], valid: Callable[[Column], Column] | None = None) -> DataFrame:
    """Read ``wanted`` digests as values of one type: digest, value, status, in the order not_found, corrupt frame, codec_mismatch, corrupt
    payload, unknown_type, corrupt invariant (SC-20)."""
    rows = wanted.select("digest").join(objects.select("digest", "content").withColumn("_there", F.lit(True)), "digest", "left")
    rows = rows.withColumn("_f", envelope.decode(F.col("content"))).withColumn("_v", decode(F.col("_f.payload")))
    invariant = F.lit(True) if valid is None else F.coalesce(valid(F.col("_v")), F.lit(False))
    status = (
        F.when(F.col("_there").isNull(), F.lit("not_found"))
        .when(F.coalesce(F.col("_f.status"), F.lit("corrupt")) != "ok", F.lit("corrupt"))
        .when(~envelope.codec_matches(F.col("_f.codec"), codec), F.lit("codec_mismatch"))
        .when(F.col("_v").isNull(), F.lit("corrupt"))
        .when(F.col("_f.type") != type_name, F.lit("unknown_type"))
        .when(~invariant, F.lit("corrupt"))
        .otherwise(F.lit("ok"))
    )
    rows = rows.withColumn("status", status)
    return rows.select("digest", F.when(F.col("status") == "ok", F.col("_v")).alias("value"), "status")


def get_raw(objects: DataFrame, wanted: DataFrame) -> DataFrame:
    """Stored bytes of ``wanted`` digests (SC-18, SC-19)."""
    return wanted.select("digest").join(objects.select("digest", "content"), "digest", "left")


def delete(objects: DataFrame, doomed: DataFrame, algorithm: str = "sha256") -> DataFrame:
    """What is left without ``doomed``; missing digests and digests of another width change nothing (SK-12..SK-15)."""
    return objects.join(doomed.filter(dg.has_width(F.col("digest"), algorithm)).select("digest"), "digest", "left_anti")


def within_cap(objects: DataFrame, batch: DataFrame, cap: int) -> bool:
    """Whether the store stays within ``cap`` bytes after ``batch``; a replaced object counts net (SK-07)."""
    kept = objects.join(batch.select("digest"), "digest", "left_anti").agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    return kept + batch.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0] <= cap


def merge(objects: DataFrame, batch: DataFrame) -> DataFrame:
    """Objects after a put that replaces equal keys, whatever their bytes (G-18)."""
    return objects.join(batch.select("digest"), "digest", "left_anti").unionByName(batch.select(*objects.columns))
