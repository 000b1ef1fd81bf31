"""Stores on disk as tables: loose trees, packs, refs, reflogs, checksum records and manifests
(SC-01..SC-04, SC-07..SC-10, SC-26..SC-35, SC-38..SC-44, SK-05, SK-06, SK-08, SK-11, SK-25, SK-28)."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shardwell.functions import digest as dg
from shardwell.operators import retention

KINDS = ("fs", "packfs")
#: What each kind of source can do (SC-42, E-12).
CAPABILITIES = {"fs": {"stat", "clean", "verify", "sweep"}, "packfs": {"stat", "clean", "verify", "sweep", "batch"}, "table": {"verify", "sweep"}}

_FILES = "path string, modificationTime timestamp, length long, content binary"


def kind(name: str) -> str:
    """The empty kind is a plain tree (SC-40)."""
    if name in ("", *KINDS):
        return name or "fs"
    raise ValueError(f"unknown kind {name!r}; known: {', '.join(KINDS)}")


def check_layout(fan_out: int, levels: int) -> None:
    """SK-28."""
    if fan_out < 1 or levels < 0 or fan_out * levels > 64:
        raise ValueError("fan-out must be positive and fan-out times levels at most 64")


def files(spark: SparkSession, base: str, pattern: str | None = None) -> DataFrame:
    """path, mtime, size, content of all files below ``base``; content is only read if it is selected."""
    reader = spark.read.format("binaryFile").schema(_FILES).option("recursiveFileLookup", True)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    rows = reader.load(base)
    full = rows.select("path", F.col("modificationTime").alias("mtime"), F.col("length").alias("size"), "content")
    return full.unionByName(_empty_files(spark, rows))


def _empty_files(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """The reader leaves files without bytes out, but an empty object is an object (G-25): those of its listing that it gave no row for."""
    listed = spark.createDataFrame([(unquote(x),) for x in rows.inputFiles()], "path string")  # the driver holds the listing already
    names = F.regexp_replace("path", "^file:/+", "/")
    gone = listed.withColumn("_n", names).join(rows.select(names.alias("_n")), "_n", "left_anti").select("path").collect()
    out = []
    for (path,) in gone:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        status = p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p)
        if status.getLen() == 0:
            out.append((path, status.getModificationTime()))
    found = spark.createDataFrame(out, "path string, ms long")
    return found.select("path", F.timestamp_millis("ms").alias("mtime"), F.lit(0).cast("long").alias("size"), F.lit(b"").alias("content"))


def loose(spark: SparkSession, base: str) -> DataFrame:
    """Objects of a tree: files whose name is lowercase hex; others are left out (SC-02, SC-26)."""
    rows = files(spark, base).withColumn("digest", dg.from_path(F.col("path")))
    return rows.filter(F.col("digest").isNotNull()).select("digest", "content", "size", "mtime")


def temp_files(spark: SparkSession, *roots: str) -> DataFrame:
    """path and time of temporary files (M-10, M-17)."""
    out = None
    for r in roots:
        rows = files(spark, r).filter(retention.is_temp_name(F.element_at(F.split("path", "/"), -1))).select("path", "mtime")
        out = rows if out is None else out.unionByName(rows)
    return out


def pack_files(spark: SparkSession, base: str) -> DataFrame:
    """pack, length, mtime (SC-10, SC-28)."""
    return files(spark, base, "*.pack").select(F.element_at(F.split("path", "/"), -1).alias("pack"), F.col("size").alias("length"), "mtime")


def pack_index(spark: SparkSession, path: str) -> DataFrame:
    """digest, pack, off, size of a JSON manifest of packs; entries with a bad digest are left out (SC-08, SC-09)."""
    rows = spark.read.schema("entries map<string,struct<pack:string,offset:long,size:long>>").option("multiLine", True).json(path)
    rows = rows.select(F.explode("entries").alias("hash", "r"))
    return rows.select(dg.parse(F.col("hash")).alias("digest"), F.element_at(F.split("r.pack", "/"), -1).alias("pack"), F.col("r.offset").alias("off"), F.col("r.size").alias("size")).filter("digest is not null")


def packed(index: DataFrame, packs: DataFrame, blobs: DataFrame) -> DataFrame:
    """Objects of packs: valid records with their bytes, size and the pack's time (SC-11, SC-16, SC-27..SC-29, G-16).

    ``blobs``: pack, content.  A pack is read once, with all that is wanted of it; packs are bounded in size when they are written.
    """
    from shardwell.operators.lookup import valid_records

    rows = valid_records(index, packs).join(packs.select("pack", "mtime"), "pack").join(blobs.select("pack", F.col("content").alias("_b")), "pack")
    return rows.select("digest", F.substr("_b", (F.col("off") + 1).cast("int"), F.col("size").cast("int")).alias("content"), "size", "mtime", "pack", "off")


def pack_blobs(spark: SparkSession, base: str) -> DataFrame:
    return files(spark, base, "*.pack").select(F.element_at(F.split("path", "/"), -1).alias("pack"), "content")


def refs(spark: SparkSession, base: str) -> DataFrame:
    """name and digest of the files below ``base``, but for logs and temporary files; a malformed value aborts (SC-30)."""
    rows = files(spark, base).withColumn("name", _below(base))
    rows = rows.filter(~F.col("name").startswith(".log/") & ~retention.is_temp_name(F.element_at(F.split("name", "/"), -1)))
    text = F.trim(F.regexp_replace(F.col("content").cast("string"), r"\s+$", ""))
    bad = F.raise_error(F.concat(F.lit("malformed ref "), F.col("name"))).cast("binary")
    return rows.select("name", F.when(dg.is_lower_hex(text), F.unhex(text)).otherwise(bad).alias("digest"))


def _below(base: str):
    """Path relative to ``base``, whatever scheme the reader puts before it."""
    tail = base.split("://")[-1].rstrip("/")
    return F.substring_index("path", tail + "/", -1)


def reflog_lines(spark: SparkSession, base: str) -> DataFrame:
    """name, seq and line of the logs below ``base`` (SC-32)."""
    rows = files(spark, f"{base.rstrip('/')}/.log").withColumn("name", _below(f"{base.rstrip('/')}/.log"))
    rows = rows.select("name", F.posexplode(F.split(F.col("content").cast("string"), "\n")).alias("seq", "line"))
    return rows.filter("line <> ''").withColumn("seq", F.col("seq").cast("long"))


def checksum_records(spark: SparkSession, base: str, cap: int = 65_536) -> DataFrame:
    """Sidecar records with the digest that their file names; files larger than ``cap`` or not JSON have record_status corrupt (SC-33, SC-35)."""
    from shardwell.operators.verify import record_status

    rows = files(spark, base, "*.json").withColumn("name", F.element_at(F.split("path", "/"), -1))
    rows = rows.withColumn("named", dg.parse(F.regexp_extract("name", r"^(.*)\.json$", 1))).filter("named is not null")
    shape = "version int, digest string, type string, codec string, checksum_algo string, checksum string, size long, created_at string"
    rows = rows.withColumn("r", F.when(F.col("size") <= cap, F.from_json(F.col("content").cast("string"), shape, {"mode": "PERMISSIVE"})))
    rows = rows.select(
        "named", F.col("r.version").alias("version"), dg.parse(F.col("r.digest")).alias("digest"), F.col("r.type").alias("type"), F.col("r.codec").alias("codec"),
        F.col("r.checksum_algo").alias("algo"), dg.parse(F.col("r.checksum")).alias("checksum"), F.col("r.size").alias("size"), F.try_to_timestamp(F.col("r.created_at")).alias("created_at"),
    )
    return record_status(rows, F.col("named")).withColumn("digest", F.col("named")).drop("named")


def foreign_records(spark: SparkSession, base: str) -> DataFrame:
    """Names beside the records that are none (SC-33)."""
    name = F.element_at(F.split("path", "/"), -1)
    return files(spark, base).select(name.alias("name")).filter(~F.col("name").rlike(r"^([0-9a-f]{2})+\.json$"))


def recorded(records: DataFrame) -> DataFrame:
    """Recorded digests in order (SC-43)."""
    return records.select(dg.to_text(F.col("digest")).alias("hash")).orderBy("hash")


def write_objects(objects: DataFrame, path: str, prefix_chars: int = 0) -> None:
    """Append objects as a table, by the first characters of their digest if asked; the commit protocol stands for rename (SK-05, SK-06, O-08)."""
    if prefix_chars:
        objects.withColumn("prefix", dg.prefix(F.col("digest"), prefix_chars)).write.mode("append").partitionBy("prefix").parquet(path)
    else:
        objects.write.mode("append").parquet(path)


def write_tiers(objects: DataFrame, loose_path: str, packed_path: str, most_bytes: int = 64 * 2**20, most_entries: int = 10_000) -> None:
    """Every object loose and packed, and the index written once a batch (SK-08, SK-09, SK-11)."""
    from shardwell.operators.chunks import assign_packs

    write_objects(objects, loose_path)
    rows = objects.withColumn("_shard", dg.prefix(F.col("digest"), 2)).withColumn("_seq", F.col("digest"))
    assign_packs(rows, most_bytes, most_entries, "_shard", "_seq").select("digest", F.concat_ws("-", "shard", "pack").alias("pack"), "off", "size").write.mode("append").parquet(packed_path)


def load_manifest(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON document with an explicit schema (SC-38)."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def save_manifest(row: DataFrame, path: str) -> None:
    """SK-25."""
    row.coalesce(1).write.mode("overwrite").json(path)


def open_store(spark: SparkSession, kind_name: str, base: str) -> DataFrame:
    """Objects of a store by kind (SC-39); of packs and tree, the pack's bytes come first (SC-11, J-16)."""
    if kind(kind_name) == "fs":
        return loose(spark, base)
    plain = loose(spark, f"{base}/objects")
    packs = packed(pack_index(spark, f"{base}/packs/index.json"), pack_files(spark, f"{base}/packs"), pack_blobs(spark, f"{base}/packs")).select("digest", "content", "size", "mtime")
    return packs.unionByName(plain.join(packs.select("digest"), "digest", "left_anti").select(*packs.columns))


def preview(objects: DataFrame, n: int = 256) -> DataFrame:
    """First bytes and whether there are more (SC-41)."""
    return objects.select("digest", F.substring("content", 1, n).alias("head"), (F.octet_length("content") > n).alias("truncated"))
