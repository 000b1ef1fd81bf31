"""Tables that cut a plan's lineage, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []
_own: dict[str, str] = {}
_tables: dict[str, str] = {}  # name of a registered table by its path


def folder(spark: SparkSession) -> str:
    """From ``spark.checkpoint.dir``; a temporary folder only where driver and executors are one process (``local[...]``)."""
    sc = spark.sparkContext
    shared = sc.getConf().get("spark.checkpoint.dir")
    if shared:
        return shared.rstrip("/")
    if not (sc.master == "local" or sc.master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if sc.applicationId not in _own:
        _own[sc.applicationId] = f"file://{tempfile.mkdtemp(prefix='shardwell-')}"
    return _own[sc.applicationId]


def cut(df: DataFrame, name: str, narrow: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: computed once, and any executor can read it again after a loss.

    ``narrow`` rows (keys, pairs, links) are dealt to fewer and larger files, an eighth of the shuffle partitions and eight at least, after the
    work that makes them, which keeps all its tasks.
    """
    spark = df.sparkSession
    if narrow:
        df = df.repartition(max(8, int(spark.conf.get("spark.sql.shuffle.partitions")) // 8))
    path = f"{folder(spark)}/shardwell/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def cut_by(df: DataFrame, key: str, name: str, dealt: bool = True) -> DataFrame:
    """As ``cut``, in buckets of ``key``, so that later joins on it leave this side where it is.

    ``dealt``: dealt out by the key first, so that a bucket is one file; without, each task writes to the buckets of its rows, for tables of
    few large rows.
    """
    spark = df.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    called = f"{name}_{uuid.uuid4().hex}".replace("-", "_")
    path = f"{folder(spark)}/shardwell/{called}"
    (df.repartition(buckets, key) if dealt else df).write.bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(called)
    _written.append((spark, path))
    _tables[path] = called
    return spark.table(called)


def written() -> list[tuple[SparkSession, str]]:
    """Tables written so far and not yet released."""
    return list(_written)


def release(tables: list[tuple[SparkSession, str]] | None = None) -> None:
    """Delete these tables, or all; results that still read one must be consumed before."""
    for spark, path in written() if tables is None else tables:
        if (spark, path) in _written:
            _written.remove((spark, path))
        try:
            if path in _tables:
                spark.sql(f"DROP TABLE IF EXISTS {_tables.pop(path)}")
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session may have ended already
            return


atexit.register(release)
