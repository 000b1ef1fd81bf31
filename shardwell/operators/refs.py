"""Named refs and their history (SC-30..SC-32, SK-16..SK-18, F-10, W-01, W-02, S-07, U-04, G-13, G-21).

The append-only reflog is the table of record; refs are its newest entries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shardwell.functions import digest as dg

#: Device names that a path segment may not have, whatever its extension (fixed values).
RESERVED = ("con", "prn", "aux", "nul", *(f"com{i}" for i in range(10)), *(f"lpt{i}" for i in range(10)))
RESERVED_CHARS = r'[<>:"|?*\\]'


def valid_name(name: Column) -> Column:
    """F-10: relative segments without control or reserved characters, none empty, dotted, ending in .lock, a space or a dot, or a device name."""
    ok = ~name.rlike(r"[\x00-\x1f\x7f]") & (name != "") & ~name.startswith("/")

    def segment(s: Column) -> Column:
        device = F.lower(F.element_at(F.split(s, r"\."), 1))
        return (s != "") & ~s.startswith(".") & ~s.endswith(".lock") & ~s.endswith(" ") & ~s.endswith(".") & ~s.rlike(RESERVED_CHARS) & ~device.isin(*RESERVED)

    return F.coalesce(ok & F.forall(F.split(name, "/", -1), segment), F.lit(False))


def parse_log(lines: DataFrame) -> DataFrame:
    """Entries of log lines (name, seq, line): ``ns<TAB>new<TAB>old``; lines that are torn or malformed are left out (SC-32)."""
    part = F.split("line", "\t", 3)
    rows = lines.withColumn("_p", part).filter(F.size("_p") == 3)
    ns = F.when(F.col("_p")[0].rlike(r"^[+-]?[0-9]+$"), F.col("_p")[0].try_cast("bigint"))
    fine = lambda t: (t == "") | dg.is_lower_hex(t)  # noqa: E731  an absent digest is empty
    rows = rows.withColumn("ts_ns", ns).filter(F.col("ts_ns").isNotNull() & fine(F.col("_p")[1]) & fine(F.col("_p")[2]))
    return rows.select("name", "seq", "ts_ns", dg.parse(F.col("_p")[1]).alias("new"), dg.parse(F.col("_p")[2]).alias("old"))


def set_refs(reflog: DataFrame, updates: DataFrame, ts_ns: Column) -> DataFrame:
    """Entries to append for ``updates`` (name, digest): logged even if nothing changes; an absent digest or a bad name raises (SK-16, SK-18)."""
    checked = updates.withColumn(
        "digest",
        F.when(~valid_name(F.col("name")), F.raise_error(F.concat(F.lit("bad ref name "), F.col("name"))).cast("binary"))
        .when(~dg.is_present(F.col("digest")), F.raise_error(F.lit("absent digest")).cast("binary"))
        .otherwise(F.col("digest")),
    )
    return _entries(reflog, checked.select("name", F.col("digest").alias("new")), ts_ns)


def delete_refs(reflog: DataFrame, names: DataFrame, ts_ns: Column) -> DataFrame:
    """Entries to append for deletions; names that are not set give none (SK-17)."""
    there = names.select("name").join(current(reflog).select("name"), "name", "left_semi")
    return _entries(reflog, there.withColumn("new", F.lit(None).cast("binary")), ts_ns)


def _entries(reflog: DataFrame, changes: DataFrame, ts_ns: Column) -> DataFrame:
    last = reflog.groupBy("name").agg(F.max_by("new", "seq").alias("old"), F.max("seq").alias("seq"))
    rows = changes.join(last, "name", "left")
    return rows.select("name", (F.coalesce("seq", F.lit(-1).cast("long")) + 1).alias("seq"), ts_ns.cast("long").alias("ts_ns"), "new", "old")


def current(reflog: DataFrame) -> DataFrame:
    """(name, digest) of the refs that are set: the newest entry of each name, by a partial aggregate (W-02)."""
    newest = reflog.groupBy("name").agg(F.max_by(F.struct("new"), "seq").alias("x"))
    return newest.select("name", F.col("x.new").alias("digest")).filter("digest is not null")


def previous(reflog: DataFrame) -> DataFrame:
    """(name, previous): the ``old`` of the newest entry, also after a deletion; names whose first set was the only one have none (W-01, G-21)."""
    newest = reflog.groupBy("name").agg(F.max_by(F.struct("old"), "seq").alias("x"))
    return newest.select("name", F.col("x.old").alias("previous")).filter("previous is not null")


def with_old(entries: DataFrame) -> DataFrame:
    """Fills ``old`` from the entry before."""
    return entries.withColumn("old", F.lag("new").over(Window.partitionBy("name").orderBy("seq")))


def log(reflog: DataFrame, name: str, limit: int = 0) -> DataFrame:
    """Newest first; a limit of 0 or less gives all (S-07)."""
    rows = reflog.filter(F.col("name") == name).orderBy(F.col("seq").desc())
    return rows.limit(limit) if limit > 0 else rows


def newest(reflog: DataFrame, n: int) -> DataFrame:
    """The ``n`` newest entries of every name, ranked; Spark keeps ``n`` rows a task before the shuffle."""
    order = Window.partitionBy("name").orderBy(F.col("seq").desc())
    return reflog.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def roots(reflog: DataFrame) -> DataFrame:
    """Digests of the refs that are set, repeats kept; history is no root (U-04, G-13)."""
    return current(reflog).select("digest")
