"""Joins and set operations on digests (SC-05, SC-11..SC-17, J-01, J-06, J-13..J-17, J-19, J-20, U-01..U-06)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shardwell.functions import digest as dg


def exists(objects: DataFrame, wanted: DataFrame) -> DataFrame:
    """The wanted rows that are stored (J-01); only digests are compared."""
    return wanted.join(objects.select("digest"), "digest", "left_semi")


def missing(objects: DataFrame, wanted: DataFrame) -> DataFrame:
    return wanted.join(objects.select("digest"), "digest", "left_anti")


def get_many(objects: DataFrame, wanted: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """A row per wanted row, repeats included, with ``status`` ok or not_found (SC-13, SC-14, J-15)."""
    found = objects.select("digest", *[c for c in (columns or objects.columns) if c != "digest"]).withColumn("_there", F.lit(True))
    return wanted.join(found, "digest", "left").withColumn("status", F.when(F.col("_there"), F.lit("ok")).otherwise(F.lit("not_found"))).drop("_there")


def plan_batch(wanted: DataFrame, index: DataFrame, valid_packs: DataFrame | None = None) -> DataFrame:
    """Wanted digests grouped by pack and sorted by offset, so that each pack is opened once; the rest is loose (SC-15, SC-17, O-07)."""
    where = index if valid_packs is None else valid_records(index, valid_packs)
    rows = wanted.join(where.select("digest", "pack", "off", "size"), "digest", "left").withColumn("tier", F.when(F.col("pack").isNull(), F.lit("loose")).otherwise(F.lit("packed")))
    return rows.repartition("pack").sortWithinPartitions("pack", "off")


def valid_records(index: DataFrame, packs: DataFrame) -> DataFrame:
    """Index records that lie within their pack file: pack, length (SC-09, SC-10)."""
    inside = (F.col("off") >= 0) & (F.col("size") >= 0) & F.col("digest").isNotNull() & (F.col("size") <= F.col("length") - F.col("off"))
    return index.join(packs.select("pack", "length"), "pack").filter(inside).select(*index.columns)


def union_tiers(loose: DataFrame, index: DataFrame) -> DataFrame:
    """Digests of either tier, once (SC-12, U-01)."""
    return loose.select("digest").union(index.select("digest")).distinct()


def prefer_packed(loose: DataFrame, packed: DataFrame) -> DataFrame:
    """Each digest from its pack if it is there, else loose (SC-11, J-16)."""
    a = packed.select("digest", F.col("size").alias("_p"))
    b = loose.select("digest", F.col("size").alias("_l"))
    rows = a.join(b, "digest", "full_outer")
    return rows.select("digest", F.coalesce("_p", "_l").alias("size"), F.when(F.col("_p").isNotNull(), F.lit("packed")).otherwise(F.lit("loose")).alias("tier"))


def reconcile(objects: DataFrame, records: DataFrame, foreign: DataFrame | None = None) -> DataFrame:
    """(digest, state): ``matched``, ``removed`` (a record without object) or ``unrecorded`` (an object without record) (J-06, U-03, M-11)."""
    a = objects.select("digest").distinct().withColumn("_o", F.lit(True))
    b = records.select("digest").distinct().withColumn("_r", F.lit(True))
    state = F.when(F.col("_o").isNull(), F.lit("removed")).when(F.col("_r").isNull(), F.lit("unrecorded")).otherwise(F.lit("matched"))
    rows = a.join(b, "digest", "full_outer").select(dg.to_text(F.col("digest")).alias("name"), state.alias("state"))
    if foreign is not None:
        rows = rows.unionByName(foreign.select("name", F.lit("foreign").alias("state")))
    return rows


def dangling(edges: DataFrame, objects: DataFrame) -> DataFrame:
    """Edges to digests that are not stored; absent references don't dangle (J-19)."""
    return edges.filter(F.col("dst").isNotNull()).join(objects.select(F.col("digest").alias("dst")), "dst", "left_anti")


def inbound(edges: DataFrame) -> DataFrame:
    """Number of references to each digest (A-10)."""
    return edges.filter(F.col("dst").isNotNull()).groupBy(F.col("dst").alias("digest")).agg(F.count("*").alias("inbound"))


def neighbours(edges: DataFrame) -> DataFrame:
    """Referring digests of each digest, sorted (J-09, R-14)."""
    return edges.filter(F.col("dst").isNotNull()).groupBy(F.col("dst").alias("digest")).agg(F.array_sort(F.collect_set("src")).alias("sources"))


def resolve_names(refs: DataFrame, asked: DataFrame) -> DataFrame:
    """Each asked name or prefix: an exact name wins, else a unique prefix; status ok, ambiguous or not_found, and the names that match (J-13).

    Names meet prefixes by equality: a name is listed under each of its prefixes that is as long as some asked text.
    """
    lengths = F.broadcast(asked.select(F.length("asked").alias("n")).distinct().agg(F.collect_set("n").alias("ns")))  # distinct lengths of names
    keyed = refs.crossJoin(lengths).withColumn("asked", F.explode(F.transform(F.filter("ns", lambda n: n <= F.length("name")), lambda n: F.substr("name", F.lit(1), n))))
    hit = asked.select("asked").distinct().join(keyed.select("asked", "name", "digest"), "asked", "left")
    per = hit.groupBy("asked").agg(
        F.max(F.when(F.col("name") == F.col("asked"), F.struct("name", "digest"))).alias("exact"),
        F.min(F.when(F.col("name").isNotNull(), F.struct("name", "digest"))).alias("one"),
        F.count("name").alias("n"),
        F.array_sort(F.collect_set("name")).alias("candidates"),
    )
    pick = F.when(F.col("exact").isNotNull(), F.col("exact")).when(F.col("n") == 1, F.col("one"))
    status = F.when(pick.isNotNull(), F.lit("ok")).when(F.col("n") > 1, F.lit("ambiguous")).otherwise(F.lit("not_found"))
    return per.select("asked", pick["name"].alias("name"), pick["digest"].alias("digest"), status.alias("status"), "candidates")


def latest_per(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """The newest row of each key, partially aggregated (W-07)."""
    others = [c for c in rows.columns if c not in key]
    newest = rows.groupBy(*key).agg(F.max_by(F.struct(*others), F.col(order)).alias("_x"))
    return newest.select(*key, *[F.col(f"_x.{c}").alias(c) for c in others])


def ordered(wanted: DataFrame, order: str = "ord") -> DataFrame:
    """Request order made explicit as a rank (SC-14)."""
    return wanted.withColumn("rank", F.row_number().over(Window.orderBy(order)))
