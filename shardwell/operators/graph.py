"""Reference graphs: reachability, bounded walks, histories and classes (R-01..R-14, D6, W-05, J-18).

A walk is a frontier loop: the frontier meets the edges, what was seen is left out, and each round is written, so a plan never grows and a
lost executor costs one round.  Every node enters the frontier once; cycles and shared nodes cost nothing more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardwell.sources.scratch import cut, cut_by


class WalkAborted(RuntimeError):
    """A strict walk met an object that it can't go through."""


def edges_of(objects: DataFrame, references: str = "refs", source: str = "digest") -> DataFrame:
    """(src, dst, ord) of an array of references, absent ones kept out (D6, J-09)."""
    rows = objects.select(F.col(source).alias("src"), F.posexplode(references).alias("ord", "dst"))
    return rows.filter(F.col("dst").isNotNull()).select("src", "dst", F.col("ord").cast("int").alias("ord"))


def reachable(edges: DataFrame, roots: DataFrame, depth: int | None = None) -> DataFrame:
    """(digest, level) of all that the roots (column digest) reach, themselves included; absent roots and references are left out.

    ``depth`` bounds the number of hops (R-08, R-09: breadth first, so a node counts at its least distance).
    """
    # written once, in buckets of the source, so that rounds move the frontier and not the edges
    links = cut_by(edges.filter(F.col("dst").isNotNull() & F.col("src").isNotNull()).select("src", "dst").distinct(), "src", "walk-links")
    front = cut(roots.select("digest").filter(F.col("digest").isNotNull()).distinct().withColumn("level", F.lit(0)), "walk")
    seen, level = front, 0
    while (depth is None or level < depth) and not front.isEmpty():
        level += 1
        found = front.join(links, front["digest"] == links["src"]).select(F.col("dst").alias("digest")).distinct()
        front = cut(found.join(seen.select("digest"), "digest", "left_anti").withColumn("level", F.lit(level)), "walk")
        seen = seen.unionByName(front)
        if level % 8 == 0:
            seen = cut(seen, "walk-seen")
    return seen


def walk(nodes: DataFrame, edges: DataFrame, roots: DataFrame, unknown: str = "leaf") -> DataFrame:
    """Reachable digests, with rules for what can't be resolved; ``nodes``: digest, status.

    A missing or corrupt node aborts; an unknown type is a leaf (``unknown="leaf"``) or aborts (``"abort"``) (R-03..R-07, G-22).
    """
    usable = edges.join(nodes.filter("status = 'ok'").select(F.col("digest").alias("src")), "src", "left_semi")
    found = reachable(usable, roots)
    told = found.join(nodes.select("digest", "status"), "digest", "left").withColumn("status", F.coalesce("status", F.lit("not_found")))
    stops = ["not_found", "corrupt"] + (["unknown_type"] if unknown == "abort" else [])
    bad = told.filter(F.col("status").isin(stops)).select(F.hex("digest") if dict(told.dtypes)["digest"] == "binary" else "digest", "status").first()
    if bad:
        raise WalkAborted(f"{bad[1]}: {bad[0]}")
    return told


def lenient(nodes: DataFrame, edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Reachable digests where nodes that can't be read are leaves and dangling digests stay in the set (R-11)."""
    usable = edges.join(nodes.filter("status = 'ok'").select(F.col("digest").alias("src")), "src", "left_semi")
    return reachable(usable, roots).select("digest")


def walk_ordered(edges: DataFrame, roots: list, most: int = 1_000_000) -> list:
    """Visits in depth-first pre-order, references in their order, each node once (R-01).  The order is sequential by nature, so the
    reachable edges are brought to the driver; more than ``most`` raise."""
    spark = edges.sparkSession
    kind = dict(edges.dtypes)["src"]
    start = spark.createDataFrame([(r,) for r in roots if r is not None], f"digest {kind}")
    near = edges.join(reachable(edges, start).select(F.col("digest").alias("src")), "src", "left_semi").filter("dst is not null")
    rows = near.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} edges; use reachable() for the set")
    out: dict = {}
    for r in sorted(rows, key=lambda r: r["ord"]):
        out.setdefault(_key(r["src"]), []).append(_key(r["dst"]))
    seen, order, stack = set(), [], [_key(r) for r in reversed(roots) if r is not None]
    while stack:
        d = stack.pop()
        if d in seen:
            continue
        seen.add(d)
        order.append(d)
        stack.extend(reversed(out.get(d, [])))
    return order


def _key(x):
    return bytes(x) if isinstance(x, bytearray) else x


def preload(edges: DataFrame, roots: list, depth: int, most: int = 1_000_000) -> list:
    """Depth-first with one shared set of visited nodes: a node first met with no depth left is not expanded later (G-15).

    The order decides what is visited, so the edges within ``depth`` hops are brought to the driver; more than ``most`` raise.
    """
    spark = edges.sparkSession
    kind = dict(edges.dtypes)["src"]
    start = spark.createDataFrame([(r,) for r in roots], f"digest {kind}")
    near = edges.join(reachable(edges, start, depth).select(F.col("digest").alias("src")), "src", "left_semi").filter("dst is not null")
    rows = near.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} edges; use reachable() for the set")
    out: dict = {}
    for r in sorted(rows, key=lambda r: r["ord"]):
        out.setdefault(_key(r["src"]), []).append(_key(r["dst"]))
    seen: set = set()
    stack = [(_key(r), depth) for r in reversed(roots)]
    while stack:
        d, left = stack.pop()
        if d in seen:
            continue
        seen.add(d)
        if left > 0:
            stack.extend((x, left - 1) for x in reversed(out.get(d, [])))
    return sorted(seen)


def history(parents: DataFrame, heads: DataFrame) -> DataFrame:
    """(head, digest, depth) along single parents, newest first at depth 0 (R-10, W-05).

    Pointer doubling: round i knows 2**i ancestors of each node, so a history of n commits takes log2(n) rounds.  ``parents``: digest,
    parent (NULL at the first); a cycle is cut where it would repeat.
    """
    jump = cut(parents.filter("parent is not null").select("digest", F.col("parent").alias("to")).distinct(), "history-jump")
    paths = cut(heads.select(F.col("digest").alias("head"), "digest", F.lit(0).cast("long").alias("depth")).filter("digest is not null"), "history")
    size, step = paths.count(), 1
    while True:
        far = paths.join(jump, "digest").select("head", F.col("to").alias("digest"), (F.col("depth") + step).alias("depth"))
        both = paths.unionByName(far).groupBy("head", "digest").agg(F.min("depth").alias("depth"))
        paths = cut(both, "history")
        now = paths.count()
        if now == size:
            return paths
        a, b = jump.alias("a"), jump.alias("b")
        jump = cut(a.join(b, F.col("a.to") == F.col("b.digest")).select(F.col("a.digest").alias("digest"), F.col("b.to").alias("to")), "history-jump")
        size, step = now, step * 2


def classes(nodes: DataFrame, edges: DataFrame, reached: DataFrame) -> DataFrame:
    """digest, inbound, orphaned, detached, root (R-13)."""
    into = edges.filter("dst is not null").groupBy(F.col("dst").alias("digest")).agg(F.count("*").alias("inbound"))
    there = reached.select("digest").distinct().withColumn("_r", F.lit(True))
    rows = nodes.select("digest").join(into, "digest", "left").join(there, "digest", "left")
    rows = rows.select("digest", F.coalesce("inbound", F.lit(0).cast("long")).alias("inbound"), F.col("_r").isNull().alias("orphaned"))
    return rows.withColumns({"detached": F.col("orphaned") & (F.col("inbound") == 0), "root": ~F.col("orphaned") & (F.col("inbound") == 0)})


def resolve_path(edges: DataFrame, start: DataFrame, hops: int) -> DataFrame:
    """What a chain of references from ``start`` ends in, one equi-join a hop (J-17, J-18)."""
    at = start.select(F.col("digest").alias("origin"), "digest")
    for _ in range(hops):
        at = at.join(edges.select(F.col("src").alias("digest"), "dst"), "digest").select("origin", F.col("dst").alias("digest"))
    return at
