"""Retention: sweep plans, grace periods, pruning and temporary files (J-03..J-05, F-11, F-12, M-07..M-11, M-15, M-17, A-15, U-02, U-05).

A plan is a DataFrame of doomed digests; ``apply`` is a separate step.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def old_enough(written: Column, now: Column, min_age_seconds: float) -> Column:
    """Whether the grace period is over (F-12); with no grace period all are."""
    if min_age_seconds <= 0:
        return F.lit(True)
    return F.unix_micros(now) - F.unix_micros(written) >= int(min_age_seconds * 1_000_000)


def sweep(objects: DataFrame, reachable: DataFrame, now: Column | None = None, min_age_seconds: float = 0, unreadable: str = "error") -> DataFrame:
    """Digests that are not reachable and old enough, in no order.

    ``reachable`` must be closed already: roots are not expanded (G-12, U-05).  An object without a time raises (``unreadable="error"``) or
    is kept (``"keep"``) when there is a grace period (G-14).
    """
    doomed = objects.join(reachable.select("digest").filter("digest is not null").distinct(), "digest", "left_anti")
    if min_age_seconds <= 0:
        return doomed.select("digest", "size")
    if now is None:
        raise ValueError("a grace period needs the time that it is measured from")
    when = F.col("mtime")
    if unreadable == "error":
        when = F.coalesce(when, F.raise_error(F.concat(F.lit("no time for "), F.lower(F.hex("digest")))).cast("timestamp"))
    return doomed.filter(F.coalesce(old_enough(when, now, min_age_seconds), F.lit(False))).select("digest", "size")


def apply(objects: DataFrame, plan: DataFrame) -> DataFrame:
    """What is left after the plan."""
    return objects.join(plan.select("digest"), "digest", "left_anti")


def prune(objects: DataFrame, reachable: DataFrame, now: Column, min_age_seconds: float = 3600, dry_run: bool = True) -> tuple[DataFrame, DataFrame]:
    """(plan, objects after it); a dry run, the default, leaves the objects as they are (J-05, M-08)."""
    plan = sweep(objects, reachable, now, min_age_seconds, unreadable="keep")
    return plan, objects if dry_run else apply(objects, plan)


def report(objects: DataFrame, plan: DataFrame) -> DataFrame:
    """deleted, freed bytes, and objects before and after (A-15)."""
    before = objects.agg(F.count("*").alias("before"))
    gone = plan.agg(F.count("*").alias("deleted"), F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("freed"))
    return before.crossJoin(F.broadcast(gone)).withColumn("after", F.col("before") - F.col("deleted"))  # one row each


def is_temp_name(name: Column) -> Column:
    """``x.tmp`` or ``x.tmp.<number>``, judged from the first ``.tmp`` (F-11)."""
    return F.coalesce(name.rlike(r"^(?:(?!\.tmp)[\s\S])*\.tmp(\.[+-]?[0-9]+)?$"), F.lit(False))


def is_temp(name: str) -> bool:
    return re.search(r"^(?:(?!\.tmp)[\s\S])*\.tmp(\.[+-]?[0-9]+)?$", name) is not None


def orphan_temps(files: DataFrame, now: Column, min_age_seconds: float = 86_400) -> DataFrame:
    """Temporary files older than the age; ``files``: path, mtime; several roots are one table (M-10, M-17)."""
    name = F.element_at(F.split("path", "/"), -1)
    return files.filter(is_temp_name(name) & old_enough(F.col("mtime"), now, min_age_seconds))


def sweep_supported(has_time: bool, min_age_seconds: float) -> str:
    """``ok``, or ``unsupported`` for a grace period over a source without times (M-09)."""
    return "unsupported" if min_age_seconds > 0 and not has_time else "ok"


def replace_manifest(refs: DataFrame, updates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(refs after setting ``updates``, digests of old manifests that another replaced) (M-15)."""
    old = refs.select("name", F.col("digest").alias("old")).join(updates.select("name", "digest"), "name")
    doomed = old.filter(F.col("old") != F.col("digest")).select(F.col("old").alias("digest"))
    kept = refs.join(updates.select("name"), "name", "left_anti").unionByName(updates.select(*refs.columns))
    return kept, doomed.join(kept.select("digest"), "digest", "left_anti")


def artifact_gc(nodes: DataFrame, edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Mark from the refs, then plan; a manifest that can't be read aborts before anything is planned (R-12)."""
    from shardwell.operators import graph

    return sweep(nodes, graph.walk(nodes, edges, roots))
