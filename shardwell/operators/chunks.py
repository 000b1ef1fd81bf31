"""Fixed-size chunks (X-60, X-61, A-16, A-17, P-09, G-17) and pack assignment (SK-09, SK-10, W-06)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def count(size: Column, chunk: int) -> Column:
    """Chunks of a payload: one for a chunk size of 0 or less, none for an empty payload (A-16, G-17)."""
    if chunk <= 0:
        return F.lit(1).cast("long")
    return F.when(size <= 0, F.lit(0)).otherwise(F.ceil(size / chunk)).cast("long")


def split(objects: DataFrame, chunk: int, key: str = "digest", content: str = "content") -> DataFrame:
    """(key, idx, data) in order (X-60, P-09)."""
    data = F.col(content).cast("binary")
    n = count(F.octet_length(data), chunk)
    rows = objects.filter(F.col(content).isNotNull()).withColumn("idx", F.explode(F.when(n > 0, F.sequence(F.lit(0), n.cast("int") - 1)).otherwise(F.array().cast("array<int>"))))
    part = data if chunk <= 0 else F.substr(data, F.col("idx") * chunk + 1, F.lit(chunk))
    return rows.select(key, "idx", part.alias("data"))


def join(chunks: DataFrame, key: str = "digest") -> DataFrame:
    """Chunks put together in order, one value a key (A-17); for values that fit in a row."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("idx", "data"))), lambda x: x["data"])
    return chunks.groupBy(key).agg(F.aggregate(ordered, F.lit(b""), lambda acc, x: F.concat(acc, x)).alias("content"))


def round_trip(objects: DataFrame, chunk: int) -> DataFrame:
    """Whether each payload is what its chunks make (X-61); an empty payload has no chunk and is made of none."""
    back = join(split(objects, chunk))
    rows = objects.select("digest", F.col("content").alias("_c")).join(back, "digest", "left")
    return rows.select("digest", (F.coalesce("content", F.lit(b"")) == F.col("_c")).alias("same"))


def assign_packs(objects: DataFrame, most_bytes: int = 64 * 2**20, most_entries: int = 10_000, shard: str | None = None, order: str = "seq") -> DataFrame:
    """pack and offset of each object within its shard (SK-09, W-06).

    A pack is closed when it has ``most_bytes`` or ``most_entries`` before an append, so the rule needs the state that came before; it runs
    over sorted rows of a shard, one batch at a time.  Without ``shard`` the store is one sequence.
    """
    kind = objects.schema[order].dataType.simpleString()

    rows = objects.select((F.col(shard).cast("string") if shard else F.lit("")).alias("shard"), F.col(order).alias("seq"), "digest", F.col("size").cast("long").alias("size"))
    schema = f"shard string, seq {kind}, digest {objects.schema['digest'].dataType.simpleString()}, size bigint, pack bigint, off bigint"
    parts = rows.repartition("shard").sortWithinPartitions("shard", "seq")

    def scan(batches):
        now, gen = None, None
        for b in batches:
            for name, g in b.groupby("shard", sort=False):
                if name != now:
                    now, gen = name, _Packer(most_bytes, most_entries)
                yield gen.place(g)

    return parts.mapInPandas(scan, schema)


class _Packer:
    """State of one shard's open pack."""

    def __init__(self, most_bytes: int, most_entries: int) -> None:
        self.most_bytes, self.most_entries, self.pack, self.used, self.entries = most_bytes, most_entries, 0, 0, 0

    def place(self, b: pd.DataFrame) -> pd.DataFrame:
        packs, offsets = [], []
        for size in b["size"]:
            if self.used >= self.most_bytes or self.entries >= self.most_entries:
                self.pack, self.used, self.entries = self.pack + 1, 0, 0
            packs.append(self.pack)
            offsets.append(self.used)
            self.used, self.entries = self.used + int(size), self.entries + 1
        return b.assign(pack=packs, off=offsets)


def approximate_packs(objects: DataFrame, most_bytes: int, shard: str, order: str = "seq") -> DataFrame:
    """Pack by running size alone, in the JVM; packs differ from the exact rule by what passed the limit."""
    before = Window.partitionBy(shard).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return objects.withColumn("pack", F.floor(F.coalesce(F.sum("size").over(before), F.lit(0)) / most_bytes).cast("long"))
