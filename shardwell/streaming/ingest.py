"""Extensions: stores fed by streams (ST-1..ST-4).  Every query runs to its end with ``availableNow`` and starts again from its checkpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardwell.functions import hashing


def addressed(stream: DataFrame, content: str = "content") -> DataFrame:
    return stream.withColumn("digest", hashing.sha256(F.coalesce(F.col(content).cast("binary"), F.lit(b""))))


def dedup_ingest(stream: DataFrame, table: str, checkpoint: str, time: str = "ts", grace: str = "1 day", content: str = "content"):
    """Append new objects: repeats within the grace go by stream state, older ones by an anti-join with what is stored, so a batch that is
    run again adds nothing (ST-1)."""
    spark = stream.sparkSession
    rows = addressed(stream, content).withWatermark(time, grace).dropDuplicatesWithinWatermark(["digest"])

    def store(batch: DataFrame, epoch: int) -> None:
        new = batch.dropDuplicates(["digest"])
        if _exists(spark, table):
            new = new.join(spark.read.schema(batch.schema).parquet(table).select("digest"), "digest", "left_anti")
        new.select(*batch.columns).write.mode("append").parquet(table)

    return rows.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _exists(spark, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def current_refs(stream: DataFrame, query: str, checkpoint: str):
    """Newest digest of each ref, kept in a memory table (ST-2); ``stream``: name, seq, new."""
    newest = stream.groupBy("name").agg(F.max_by("new", "seq").alias("digest"), F.max("seq").alias("seq"))
    return newest.writeStream.outputMode("complete").format("memory").queryName(query).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def retained(stream: DataFrame, query: str, checkpoint: str, time: str = "ts", grace: str = "1 hour"):
    """Last time that each digest was seen, given out when the grace after it has passed (ST-3)."""
    seen = stream.withWatermark(time, grace).groupBy(F.session_window(time, grace), "digest").agg(F.max(time).alias("last_seen"))
    return seen.select("digest", "last_seen").writeStream.outputMode("append").format("memory").queryName(query).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def rolling_census(stream: DataFrame, query: str, checkpoint: str, time: str = "ts", window: str = "1 day", late: str = "1 hour", by: str = "type"):
    """Objects by window and type; complete, so that windows still open are told too (ST-4)."""
    counts = stream.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), by).agg(F.count("*").alias("objects"))
    out = counts.select(F.col("w.start").alias("start"), by, "objects")
    return out.writeStream.outputMode("complete").format("memory").queryName(query).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
