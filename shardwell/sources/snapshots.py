"""Portable dumps of a store as a Spark data source (SC-36, SC-37, SK-23, SK-24, D19, G-24).

Header: 8 magic bytes, version (2 bytes), number of objects (8 bytes) and, in the form with totals, all payload bytes (8 bytes).  Record:
digest length and payload length (8 bytes each), digest, payload.  Numbers are big-endian; records are in digest order.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator
from typing import BinaryIO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

VERSION, MOST_DIGEST = 1, 1 << 20
MAGIC = b"OBJDUMP\x01"


class Malformed(ValueError):
    """A dump that can't be read."""


def write(rows: Iterable[tuple[bytes, bytes]], out: BinaryIO, count: int, total: int | None = None, magic: bytes = MAGIC) -> None:
    """Records must come in digest order, ``count`` of them; with ``total`` the header holds it."""
    out.write(magic + struct.pack(">HQ", VERSION, count) + (b"" if total is None else struct.pack(">Q", total)))
    for digest, payload in rows:
        out.write(struct.pack(">QQ", len(digest), len(payload)) + digest + payload)


def read(data: BinaryIO, with_total: bool = False, magic: bytes = MAGIC, cap: int | None = None) -> Iterator[tuple[bytes, bytes]]:
    """Records in turn; a wrong header, a cut, an absent or repeated digest, data after the last record, a wrong total or more than ``cap``
    payload bytes raise."""

    def take(n: int, what: str) -> bytes:
        got = data.read(n)
        if len(got) != n:
            raise Malformed(f"cut off in {what}")
        return got

    if take(8, "magic") != magic:
        raise Malformed("not a dump")
    version, count = struct.unpack(">HQ", take(10, "header"))
    if version != VERSION:
        raise Malformed(f"unknown version {version}")
    total = struct.unpack(">Q", take(8, "header"))[0] if with_total else None
    seen: set[bytes] = set()
    size = 0
    for _ in range(count):
        a, b = struct.unpack(">QQ", take(16, "record header"))
        if not 0 < a <= MOST_DIGEST:
            raise Malformed("absent or oversized digest")
        digest = take(a, "digest")
        if digest in seen:
            raise Malformed("repeated digest")
        seen.add(digest)
        size += b
        if cap is not None and size > cap:
            raise Malformed("more bytes than the store takes")
        yield digest, take(b, "payload")
    if data.read(1):
        raise Malformed("data after the last record")
    if total is not None and total != size:
        raise Malformed("wrong total")


class SnapshotSource(DataSource):
    """``spark.read.format("object_dump").load(path)``: digest, content of one or several dumps, a task a file."""

    @classmethod
    def name(cls) -> str:
        return "object_dump"

    def schema(self) -> str:
        return "digest binary, content binary"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.paths = options["path"].split(",")
        self.with_total = str(options.get("total", "false")).lower() == "true"
        self.magic = bytes.fromhex(options["magic"]) if "magic" in options else MAGIC

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in self.paths]

    def read(self, partition: InputPartition) -> Iterator[tuple[bytes, bytes]]:
        with open(partition.value.removeprefix("file://"), "rb") as f:
            yield from read(f, self.with_total, self.magic)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SnapshotSource)


def restore(spark: SparkSession, path: str, with_total: bool = True, magic: bytes = MAGIC) -> DataFrame:
    """All or nothing: the dump is checked to its end before a row is used."""
    with open(path, "rb") as f:
        for _ in read(f, with_total, magic):
            pass
    register(spark)
    return spark.read.format("object_dump").options(path=path, total=str(with_total).lower(), magic=magic.hex()).load()


def export(objects: DataFrame, path: str, total: bool = False, magic: bytes = MAGIC) -> None:
    """One ordered file, streamed through the driver a partition at a time; for tables, write Parquet in digest order instead."""
    from pyspark.sql import functions as F

    n, size = objects.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("content")), F.lit(0))).first()
    rows = objects.select("digest", "content").orderBy("digest").toLocalIterator()
    with open(path, "wb") as out:
        write(((bytes(r[0]), bytes(r[1])) for r in rows), out, n, size if total else None, magic)


def export_table(objects: DataFrame, path: str) -> None:
    """The distributed form: Parquet, ranges of digests a file, sorted within."""
    objects.repartitionByRange("digest").sortWithinPartitions("digest").write.mode("overwrite").parquet(path)
