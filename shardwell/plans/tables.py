"""The driver's tables seen as relations of a store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, digest (hex), type, codec, size of every document; the language is the type, the source the codec."""
    text = F.coalesce("text", F.lit(""))
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.sha2(text, 256).alias("digest"),
        F.concat("lang", F.lit("@1")).alias("type"),
        F.col("source").alias("codec"),
        F.octet_length(text.cast("binary")).cast("long").alias("size"),
    )


def objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct contents, with the type and codec of the document with the least id."""
    rows = documents(spark, sf_dir)
    return rows.groupBy("digest").agg(F.min_by("type", "doc_id").alias("type"), F.min_by("codec", "doc_id").alias("codec"), F.first("size").alias("size"), F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


DOCUMENTS = """docs AS (
  SELECT doc_id, sha256(coalesce(text, '')) AS digest, lang || '@1' AS type, source AS codec, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS size
  FROM documents
)"""
OBJECTS = (
    DOCUMENTS
    + """, objs AS (
  SELECT digest, arg_min(type, doc_id) AS type, arg_min(codec, doc_id) AS codec, min(size) AS size, min(doc_id) AS doc_id, count(*) AS copies
  FROM docs GROUP BY digest
)"""
)


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders refer to customer, parts and suppliers, customers and suppliers to nations, nations to regions; nodes are named by table and key."""

    def node(prefix: str, key: str):
        return F.concat(F.lit(prefix), F.col(key).cast("string"))

    def pairs(name: str, a, b) -> DataFrame:
        return table(spark, sf_dir, name).select(a.alias("src"), b.alias("dst"))

    lines = table(spark, sf_dir, "lineitem")
    out = pairs("orders", node("o", "o_orderkey"), node("c", "o_custkey"))
    out = out.unionByName(lines.select(node("o", "l_orderkey").alias("src"), node("p", "l_partkey").alias("dst")))
    out = out.unionByName(lines.select(node("o", "l_orderkey").alias("src"), node("s", "l_suppkey").alias("dst")))
    out = out.unionByName(pairs("customer", node("c", "c_custkey"), node("n", "c_nationkey")))
    out = out.unionByName(pairs("supplier", node("s", "s_suppkey"), node("n", "s_nationkey")))
    out = out.unionByName(pairs("nation", node("n", "n_nationkey"), node("r", "n_regionkey")))
    return out.distinct()


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for name, prefix, key in (("orders", "o", "o_orderkey"), ("customer", "c", "c_custkey"), ("part", "p", "p_partkey"), ("supplier", "s", "s_suppkey"), ("nation", "n", "n_nationkey"), ("region", "r", "r_regionkey")):
        rows = table(spark, sf_dir, name).select(F.concat(F.lit(prefix), F.col(key).cast("string")).alias("digest"))
        out = rows if out is None else out.unionByName(rows)
    return out


GRAPH = """edges AS (
  SELECT 'o' || o_orderkey AS src, 'c' || o_custkey AS dst FROM orders
  UNION SELECT 'o' || l_orderkey, 'p' || l_partkey FROM lineitem
  UNION SELECT 'o' || l_orderkey, 's' || l_suppkey FROM lineitem
  UNION SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer
  UNION SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier
  UNION SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation
), nodes AS (
  SELECT 'o' || o_orderkey AS digest FROM orders UNION ALL SELECT 'c' || c_custkey FROM customer UNION ALL SELECT 'p' || p_partkey FROM part
  UNION ALL SELECT 's' || s_suppkey FROM supplier UNION ALL SELECT 'n' || n_nationkey FROM nation UNION ALL SELECT 'r' || r_regionkey FROM region
), roots AS (SELECT 'o' || o_orderkey AS digest FROM orders WHERE o_orderstatus = 'F' AND o_custkey <= 60),
reached(digest) AS (SELECT digest FROM roots UNION SELECT e.dst FROM reached r JOIN edges e ON e.src = r.digest)"""


def roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finished orders of the first customers."""
    return table(spark, sf_dir, "orders").filter("o_orderstatus = 'F' AND o_custkey <= 60").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("digest"))


def reflog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ref a user; each event sets it to the digest of its id, and every seventh event deletes it."""
    from pyspark.sql import Window

    rows = table(spark, sf_dir, "events")
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = rows.withColumn("seq", F.row_number().over(order).cast("long") - 1)
    new = F.when(F.col("event_id") % 7 != 0, F.unhex(F.sha2(F.col("event_id").cast("string"), 256)))
    rows = rows.select(F.concat(F.lit("user/"), F.col("user_id").cast("string")).alias("name"), "seq", (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("ts_ns"), new.alias("new"))
    return rows.withColumn("old", F.lag("new").over(Window.partitionBy("name").orderBy("seq")))


REFLOG = """entries AS (
  SELECT 'user/' || user_id AS name, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq,
    CASE WHEN event_id % 7 <> 0 THEN sha256(CAST(event_id AS VARCHAR)) END AS new
  FROM events
), reflog AS (SELECT name, seq, new, lag(new) OVER (PARTITION BY name ORDER BY seq) AS old FROM entries)"""
