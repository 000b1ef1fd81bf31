"""One handle on a store: every command of an object store as a method over its tables.

Nothing is computed until a result is used.  Reference and reach providers are DataFrames that are handed in, and the clock is a column or
a text, so that a query gives the same rows again.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, replace
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shardwell.functions import digest as dg
from shardwell.functions import formats
from shardwell.operators import chunks, graph, listing, lookup, models, objects, refs, retention, verify
from shardwell.sources import files


class Busy(RuntimeError):
    """Another maintenance operation holds the store's lock."""


@contextmanager
def maintenance_lock(base: str, name: str = ".maintenance.lock") -> Iterator[None]:
    """Held by operations that delete, one at a time; for stores on a file system of the driver's host (SK-27)."""
    path = Path(safe_path(base, base)) / name
    try:
        handle = os.open(path, os.O_CREAT | os.O_EXCL | os.O_WRONLY)
    except FileExistsError as e:
        raise Busy(f"{path} is held") from e
    try:
        os.write(handle, str(os.getpid()).encode())
        yield
    finally:
        os.close(handle)
        path.unlink(missing_ok=True)


def safe_path(base: str, path: str) -> str:
    """``path`` if it lies in ``base`` and no part of it below ``base`` is a symbolic link, else an error (F-17)."""
    root = Path(base.removeprefix("file://")).resolve()
    given = Path(path.removeprefix("file://"))
    whole = Path(os.path.normpath(given if given.is_absolute() else root / given))
    if whole != root and root not in whole.parents:
        raise ValueError(f"{path} is outside {base}")
    part = whole
    while part != root:
        if part.is_symlink():
            raise ValueError(f"{part} is a symbolic link")
        part = part.parent
    return str(whole)


def _now(now: Column | str) -> Column:
    return F.lit(now).cast("timestamp") if isinstance(now, str) else now


@dataclass(frozen=True)
class Store:
    """objects: digest, content, size, mtime.  The other tables are needed by the methods that use them."""

    objects: DataFrame
    reflog: DataFrame | None = None
    records: DataFrame | None = None
    edges: DataFrame | None = None
    reachable: DataFrame | None = None
    algorithm: str = "sha256"

    @classmethod
    def open(cls, spark: SparkSession, base: str, kind: str = "", algorithm: str = "sha256", **tables: DataFrame) -> Store:
        return cls(files.open_store(spark, kind, base), algorithm=algorithm, **tables)

    # put, get, list, meta

    def ingest(self, batch: DataFrame, content: str = "content") -> tuple[DataFrame, Store]:
        """(digest and deduplicated of each row of ``batch``, the store with its new objects)."""
        rows = objects.address(batch, content, self.algorithm)
        told = objects.put_dedup(rows.select("digest", "size"), self.objects)
        fresh = objects.new_objects(rows.select("digest", F.coalesce(F.col(content).cast("binary"), F.lit(b"")).alias("content"), "size"), self.objects)
        fresh = fresh.withColumn("mtime", F.lit(None).cast("timestamp"))
        have = self.objects if "mtime" in self.objects.columns else self.objects.withColumn("mtime", F.lit(None).cast("timestamp"))
        return told, replace(self, objects=have.select("digest", "content", "size", "mtime").unionByName(fresh.select("digest", "content", "size", "mtime")))

    def get(self, wanted: DataFrame) -> DataFrame:
        return lookup.get_many(self.objects, wanted, ["content", "size"])

    def get_to_file(self, digest: str, path: str) -> int:
        """Write one object to a file on the driver; its size (SK-26)."""
        row = self.objects.filter(F.col("digest") == F.unhex(F.lit(digest))).select("content").first()
        if row is None or not dg_text_ok(digest):
            raise KeyError(f"not found: {digest}")
        return Path(path).write_bytes(bytes(row[0]))

    def metadata(self) -> DataFrame:
        return listing.metadata(self.objects)

    def list(self, type_name: str = "", codec: str = "", offset: int = 0, limit: int = 100) -> DataFrame:
        return listing.list_page(self.metadata(), type_name, codec, offset, limit)

    def meta(self, wanted: DataFrame) -> DataFrame:
        return lookup.get_many(self.metadata(), wanted)

    def stats(self) -> DataFrame:
        return listing.stats(self.objects)

    def census(self) -> DataFrame:
        return listing.census(self.metadata())

    # browsing

    def rows(self) -> DataFrame:
        """Rows of the browser: metadata with references, reach and integrity, as far as they were handed in."""
        return listing.enrich(self.metadata(), self.edges, self.reachable, self.verify())

    def browse(self, state: listing.Browse | None = None) -> DataFrame:
        return listing.browse(self.rows(), state or listing.Browse())

    def totals(self, state: listing.Browse | None = None) -> DataFrame:
        return listing.browse_totals(self.rows(), state or listing.Browse())

    def permalink(self, digest: str, state: listing.Browse | None = None) -> tuple[int, DataFrame]:
        """(offset of the page that holds the object, the object with its neighbours)."""
        state, rows, chosen = state or listing.Browse(), self.rows(), F.unhex(F.lit(digest))
        empty = self.objects.sparkSession.createDataFrame([], "src binary, dst binary, ord int")
        return listing.page_of(rows, state, chosen).first()[0], listing.inspect(rows, self.edges or empty, chosen)

    def hexdump(self, digest: str, most: int = 256) -> DataFrame:
        """Rows of the first bytes."""
        row = self.objects.filter(F.col("digest") == F.unhex(F.lit(digest)))
        return row.select(F.explode(formats.hexdump(F.substring("content", 1, most))).alias("r")).select("r.*")

    # integrity

    def verify(self, wanted: DataFrame | None = None) -> DataFrame:
        return verify.verify(self.objects if wanted is None else lookup.exists(wanted, self.objects), self.algorithm)

    def verify_checksums(self, algorithm: str, strict: bool = True) -> DataFrame:
        return verify.verify_checksums(self.objects, self.records, algorithm, strict)

    def reconcile(self) -> DataFrame:
        return lookup.reconcile(self.objects, self.records)

    def audit(self, check: bool = True) -> DataFrame:
        return verify.audit(self.objects, self.reachable, self.verify() if check else None)

    # retention

    def gc(self, now: Column | str, min_age_seconds: float = 3600) -> tuple[DataFrame, Store]:
        """(doomed, the store without them); the reachable set must be closed (G-12)."""
        plan = retention.sweep(self.objects, self.reachable, _now(now), min_age_seconds)
        return plan, replace(self, objects=retention.apply(self.objects, plan))

    def prune(self, now: Column | str, min_age_seconds: float = 3600, dry_run: bool = True) -> tuple[DataFrame, Store]:
        plan, left = retention.prune(self.objects, self.reachable, _now(now), min_age_seconds, dry_run)
        return plan, replace(self, objects=left)

    def delete(self, doomed: DataFrame) -> Store:
        return replace(self, objects=objects.delete(self.objects, doomed, self.algorithm))

    # refs and graphs

    def refs(self) -> DataFrame:
        return refs.current(self.reflog)

    def resolve(self, asked: DataFrame) -> DataFrame:
        return lookup.resolve_names(self.refs(), asked)

    def resolved(self, registry: models.Registry | None = None) -> DataFrame:
        """Typed objects with their status and references."""
        return (registry or models.Registry(models.MODELS)).resolve(self.objects)

    def with_graph(self, registry: models.Registry | None = None, unknown: str = "leaf") -> Store:
        """Edges of the typed objects, and what the refs reach."""
        nodes = self.resolved(registry)
        edges = graph.edges_of(nodes)
        reached = graph.walk(nodes.select("digest", "status"), edges, refs.roots(self.reflog), unknown)
        return replace(self, edges=edges, reachable=reached.select("digest"))

    def log(self, heads: DataFrame, registry: models.Registry | None = None) -> DataFrame:
        """Commits from the heads back, newest first."""
        nodes = self.resolved(registry).filter("type like 'commit@%' and status = 'ok'")
        parents = nodes.select("digest", dg.parse(F.col("commit.parent")).alias("parent"))
        line = models.describe(nodes)
        return graph.history(parents, heads).join(line, "digest").orderBy("head", "depth")

    def broken(self) -> DataFrame:
        """References to objects that are not there."""
        return lookup.dangling(self.edges, self.objects)

    # chunks

    def split(self, chunk: int) -> DataFrame:
        return chunks.split(self.objects, chunk)


def dg_text_ok(text: str) -> bool:
    """Strict lowercase hex, on the driver."""
    return len(text) > 0 and len(text) % 2 == 0 and all(c in "0123456789abcdef" for c in text)
