"""Registered queries over the driver's tables, each beside the DuckDB SQL with the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shardwell.functions import codecs, envelope, formats, hashing
from shardwell.functions import digest as dg
from shardwell.operators import bloom, caches, chunks, graph, listing, lookup, refs, retention, verify
from shardwell.plans import tables as t
from shardwell.sources.scratch import folder

_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_oracle: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        _queries[f.__name__] = f
        if sql is not None:
            _oracle[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_oracle)


# --- metadata ------------------------------------------------------------------------------------------------------------------------


@query(f"WITH {t.OBJECTS} SELECT type, count(*) AS objects, CAST(sum(size) AS BIGINT) AS bytes FROM objs GROUP BY type")
def census_by_type(spark, d):
    """Digest, deduplicate, group (X-20, SK-04, A-05)."""
    return t.objects(spark, d).groupBy("type").agg(F.count("*").alias("objects"), F.sum("size").alias("bytes"))


@query(f"WITH {t.OBJECTS} SELECT coalesce(nullif(codec, ''), 'unspecified') AS codec, count(*) AS objects, CAST(sum(size) AS BIGINT) AS bytes FROM objs GROUP BY 1")
def census_by_codec(spark, d):
    return t.objects(spark, d).groupBy(envelope.codec_label(F.col("codec")).alias("codec")).agg(F.count("*").alias("objects"), F.sum("size").alias("bytes"))


@query(f"WITH {t.DOCUMENTS} SELECT type, codec, count(*) AS objects, CAST(sum(size) AS BIGINT) AS bytes FROM docs GROUP BY GROUPING SETS ((type), (codec))")
def census_grouping_sets(spark, d):
    return t.documents(spark, d).groupingSets([["type"], ["codec"]], "type", "codec").agg(F.count("*").alias("objects"), F.sum("size").alias("bytes"))


_FRAMED = """framed AS (
  SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'framed' WHEN 1 THEN 'v1' WHEN 2 THEN 'headerless' ELSE 'untagged' END AS kind, lang || '@1' AS type, source AS codec FROM documents
)"""


def _framed(spark, d) -> DataFrame:
    """Documents stored in turn as a tagged frame, a version 1 frame, plain bytes and a frame without codec."""
    kind = F.col("doc_id") % 4
    payload = F.coalesce("text", F.lit("")).cast("binary")
    name = F.concat("lang", F.lit("@1"))
    v1 = F.concat(F.lit(b"\x01"), envelope.uvarint(F.octet_length(name.cast("binary"))), name.cast("binary"), envelope.uvarint(F.octet_length(payload)), payload)
    content = F.when(kind == 0, envelope.encode(F.col("source"), name, payload)).when(kind == 1, v1).when(kind == 2, F.concat(F.lit(b"plain "), payload)).otherwise(envelope.encode(F.lit(""), name, payload))
    rows = t.table(spark, d, "documents").select("doc_id", content.alias("content"), name.alias("name"), "source", payload.alias("payload"))
    return rows.withColumn("digest", hashing.sha256(F.col("content"))).withColumn("size", F.octet_length("content").cast("long"))


@query(
    f"""WITH {_FRAMED}, h AS (
  SELECT CASE WHEN kind = 'headerless' THEN NULL ELSE type END AS type, CASE kind WHEN 'framed' THEN 2 WHEN 'untagged' THEN 2 WHEN 'v1' THEN 1 END AS version,
    CASE kind WHEN 'framed' THEN codec ELSE 'unspecified' END AS codec, kind FROM framed)
SELECT 'type' AS axis, type AS value, count(*) AS objects FROM h WHERE kind <> 'headerless' GROUP BY type
UNION ALL SELECT 'version', CAST(version AS VARCHAR), count(*) FROM h WHERE kind <> 'headerless' GROUP BY version
UNION ALL SELECT 'codec', codec, count(*) FROM h WHERE kind <> 'headerless' GROUP BY codec
UNION ALL SELECT 'kind', 'headerless', count(*) FROM h WHERE kind = 'headerless'"""
)
def header_census(spark, d):
    """Frames are made and their headers read again (A-04, A-05, SC-25)."""
    return listing.census(listing.metadata(_framed(spark, d)))


@query(
    f"""WITH {_FRAMED} SELECT doc_id, CASE kind WHEN 'headerless' THEN 0 WHEN 'v1' THEN 1 ELSE 2 END AS version, CASE kind WHEN 'headerless' THEN '' ELSE type END AS type,
  CASE kind WHEN 'framed' THEN codec ELSE 'unspecified' END AS codec, CASE kind WHEN 'headerless' THEN 'headerless' ELSE 'framed' END AS header_status FROM framed"""
)
def envelope_header_states(spark, d):
    return _framed(spark, d).withColumn("h", envelope.labels(F.col("content"))).select("doc_id", F.col("h.version").cast("int").alias("version"), "h.type", "h.codec", "h.header_status")


@query("SELECT doc_id, CASE doc_id % 4 WHEN 2 THEN 'corrupt' ELSE 'ok' END AS status, doc_id % 4 <> 2 AS same FROM documents")
def envelope_roundtrip(spark, d):
    """Payloads come back whole (X-30, X-33)."""
    rows = _framed(spark, d).withColumn("f", envelope.decode(F.col("content")))
    return rows.select("doc_id", F.col("f.status").alias("status"), F.coalesce(F.col("f.payload") == F.col("payload"), F.lit(False)).alias("same"))


@query(f"WITH {t.OBJECTS} SELECT count(*) AS objects, CAST(sum(size) AS BIGINT) AS bytes FROM objs")
def stats_count_bytes(spark, d):
    return listing.stats(t.objects(spark, d))


@query(f"WITH {t.DOCUMENTS} SELECT count(*) AS total, count(DISTINCT digest) AS objects, count(*) - count(DISTINCT digest) AS deduplicated FROM docs")
def dedup_ratio(spark, d):
    """Counted after a partial aggregate by digest, not as a distinct aggregate over rows."""
    return t.objects(spark, d).agg(F.sum("copies").alias("total"), F.count("*").alias("objects"), (F.sum("copies") - F.count("*")).alias("deduplicated"))


@query(f"WITH {t.OBJECTS} SELECT digest, size, type FROM objs ORDER BY digest LIMIT 20 OFFSET 5")
def digest_list_page(spark, d):
    return listing.paginate(t.objects(spark, d).select("digest", "size", "type"), [F.col("digest")], 5, 20)


@query(f"WITH {t.OBJECTS} SELECT digest, size FROM objs WHERE type = 'en@1'")
def list_filter_type(spark, d):
    return t.objects(spark, d).filter(F.col("type") == formats.versioned_type("en")).select("digest", "size")


@query(f"WITH {t.OBJECTS} SELECT digest, size FROM objs WHERE coalesce(nullif(codec, ''), 'unspecified') = 'src3'")
def list_filter_codec(spark, d):
    return t.objects(spark, d).filter(envelope.codec_label(F.col("codec")) == "src3").select("digest", "size")


@query(f"WITH {t.OBJECTS} SELECT CASE WHEN size < 1024 THEN 'small' WHEN size <= 1048576 THEN 'medium' ELSE 'large' END AS band, count(*) AS objects FROM objs GROUP BY 1")
def size_bands(spark, d):
    return t.objects(spark, d).groupBy(formats.size_band(F.col("size")).alias("band")).agg(F.count("*").alias("objects"))


@query(f"WITH {t.DOCUMENTS} SELECT doc_id, substr(digest, 1, 8) || '…' AS short, 'sha256:' || digest AS tagged, substr(digest, 1, 12) AS prefix FROM docs")
def short_digest(spark, d):
    rows = t.documents(spark, d).withColumn("b", dg.parse(F.col("digest")))
    return rows.select("doc_id", dg.short(F.col("b")).alias("short"), dg.tagged("sha256", F.col("b")).alias("tagged"), dg.prefix(F.col("b"), 12).alias("prefix"))


_TEXTS = "CASE doc_id % 5 WHEN 0 THEN digest WHEN 1 THEN upper(digest) WHEN 2 THEN substr(digest, 1, 7) WHEN 3 THEN 'sha256:' || digest ELSE '' END"


@query(
    f"""WITH {t.DOCUMENTS}, x AS (SELECT doc_id, {_TEXTS} AS s FROM docs)
SELECT doc_id, CASE WHEN regexp_full_match(s, '([0-9a-f][0-9a-f])+') THEN 'ok' ELSE 'invalid_digest' END AS status,
  coalesce(regexp_full_match(s, '(sha256:)?[0-9a-f]{{64}}'), false) AS own FROM x"""
)
def digest_parse_classify(spark, d):
    """Strict parsing, and parsing with an algorithm's prefix (X-04, X-07)."""
    rows = t.documents(spark, d).withColumn("s", F.expr(_TEXTS))
    return rows.select("doc_id", dg.parse_status(F.col("s")).alias("status"), dg.parse_tagged("sha256", F.col("s")).isNotNull().alias("own"))


@query(f"WITH {t.OBJECTS} SELECT 'type' AS axis, type AS value FROM objs GROUP BY type UNION ALL SELECT 'codec', codec FROM objs GROUP BY codec")
def filter_options_distinct(spark, d):
    rows = t.objects(spark, d)
    return rows.select(F.lit("type").alias("axis"), F.col("type").alias("value")).distinct().unionByName(rows.select(F.lit("codec").alias("axis"), F.col("codec").alias("value")).distinct())


# --- browsing ------------------------------------------------------------------------------------------------------------------------


def _rows(spark, d) -> DataFrame:
    rows = t.objects(spark, d).select(dg.parse(F.col("digest")).alias("digest"), "type", "codec", "size").withColumns(
        {"version": F.lit(2).cast("smallint"), "written": F.lit(None).cast("timestamp"), "unreadable": F.lit(False), "header_status": F.lit("framed")}
    )
    return listing.enrich(rows)


@query(f"WITH {t.OBJECTS} SELECT digest AS hash, size FROM objs ORDER BY size DESC, digest DESC LIMIT 25")
def browse_sort_size_desc(spark, d):
    return listing.browse(_rows(spark, d), listing.Browse(sort="size", descending=True, limit=25)).select("hash", "size")


@query(f"WITH {t.OBJECTS} SELECT digest AS hash, type FROM objs ORDER BY type, digest LIMIT 25 OFFSET 25")
def browse_sort_type(spark, d):
    return listing.browse(_rows(spark, d), listing.Browse(sort="type", offset=25, limit=25)).select("hash", "type")


@query(f"WITH {t.OBJECTS} SELECT digest AS hash, type FROM objs WHERE (digest LIKE '%ab1%' OR lower(type) LIKE '%ab1%') AND size >= 1024 AND size <= 1048576 ORDER BY digest LIMIT 50")
def browse_search(spark, d):
    return listing.browse(_rows(spark, d), listing.Browse(query=" AB1 ", size="medium")).select("hash", "type")


@query(f"WITH {t.OBJECTS}, r AS (SELECT doc_id, row_number() OVER (ORDER BY size, digest) AS n FROM objs) SELECT CAST((n - 1) // 50 * 50 AS BIGINT) AS \"offset\" FROM r WHERE doc_id = 7")
def browse_page_of_selected(spark, d):
    selected = t.objects(spark, d).filter("doc_id = 7").select("digest").first()
    return listing.page_of(_rows(spark, d), listing.Browse(sort="size"), F.unhex(F.lit(selected[0] if selected else "")))


@query(f"WITH {t.OBJECTS} SELECT count(*) FILTER (type = 'fr@1') AS matched, CAST(coalesce(sum(size) FILTER (type = 'fr@1'), 0) AS BIGINT) AS matched_bytes, count(*) AS total FROM objs")
def matched_vs_total(spark, d):
    return listing.browse_totals(_rows(spark, d), listing.Browse(type="fr@1"))


# --- joins and sets --------------------------------------------------------------------------------------------------------------------

_SETS = f"""{t.OBJECTS}, loose AS (SELECT digest, size FROM objs WHERE doc_id % 3 <> 0), packed AS (SELECT digest, size FROM objs WHERE doc_id % 2 = 0),
wanted AS (SELECT row_number() OVER (ORDER BY doc_id) AS ord, CASE WHEN doc_id % 10 = 3 THEN sha256('missing ' || doc_id) ELSE digest END AS digest FROM docs)"""


def _tiers(spark, d) -> tuple[DataFrame, DataFrame]:
    rows = t.objects(spark, d)
    return rows.filter("doc_id % 3 <> 0").select("digest", "size"), rows.filter("doc_id % 2 = 0").select("digest", "size")


def _wanted(spark, d) -> DataFrame:
    digest = F.when(F.col("doc_id") % 10 == 3, F.sha2(F.concat(F.lit("missing "), F.col("doc_id").cast("string")), 256)).otherwise(F.col("digest"))
    return t.documents(spark, d).select("doc_id", digest.alias("digest"))


@query(f"WITH {_SETS} SELECT w.digest, o.size, CASE WHEN o.digest IS NULL THEN 'not_found' ELSE 'ok' END AS status FROM wanted w LEFT JOIN objs o USING (digest)")
def get_many_left(spark, d):
    """A row per request, repeats included (SC-13, SC-14)."""
    return lookup.get_many(t.objects(spark, d).select("digest", "size"), _wanted(spark, d).select("digest"))


@query(f"WITH {_SETS} SELECT DISTINCT digest FROM wanted WHERE digest IN (SELECT digest FROM loose)")
def exists_semi(spark, d):
    return lookup.exists(_tiers(spark, d)[0], _wanted(spark, d).select("digest").distinct())


@query(f"WITH {_SETS} SELECT DISTINCT digest FROM wanted WHERE digest NOT IN (SELECT digest FROM loose)")
def dedup_anti(spark, d):
    return lookup.missing(_tiers(spark, d)[0], _wanted(spark, d).select("digest").distinct())


@query(f"WITH {_SETS} SELECT digest FROM loose UNION SELECT digest FROM packed")
def loose_union_packed(spark, d):
    return lookup.union_tiers(*_tiers(spark, d))


@query(f"WITH {_SETS} SELECT digest, coalesce(p.size, l.size) AS size, CASE WHEN p.digest IS NULL THEN 'loose' ELSE 'packed' END AS tier FROM packed p FULL JOIN loose l USING (digest)")
def pack_over_loose_coalesce(spark, d):
    return lookup.prefer_packed(*_tiers(spark, d))


@query(
    f"""WITH {_SETS} SELECT digest AS name, CASE WHEN l.size IS NULL THEN 'removed' WHEN p.size IS NULL THEN 'unrecorded' ELSE 'matched' END AS state
FROM loose l FULL JOIN packed p USING (digest)"""
)
def reconcile_full_outer(spark, d):
    loose, packed = (x.withColumn("digest", F.unhex("digest")) for x in _tiers(spark, d))
    return lookup.reconcile(loose, packed)


@query(f"WITH {t.GRAPH.split('), nodes')[0]}), nodes AS (SELECT 'c' || c_custkey AS digest FROM customer WHERE c_nationkey < 20 UNION ALL SELECT 'p' || p_partkey FROM part) SELECT src, dst FROM edges WHERE dst[1] IN ('c', 'p') AND dst NOT IN (SELECT digest FROM nodes)")
def dangling_refs_anti(spark, d):
    kept = t.nodes(spark, d).filter("digest like 'p%'").unionByName(t.table(spark, d, "customer").filter("c_nationkey < 20").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("digest")))
    return lookup.dangling(t.edges(spark, d).filter("substr(dst, 1, 1) in ('c', 'p')"), kept).select("src", "dst")


@query(
    f"""WITH {t.REFLOG}, refs AS (SELECT name, arg_max(struct_pack(v := new), seq).v AS digest FROM reflog GROUP BY name),
live AS (SELECT * FROM refs WHERE digest IS NOT NULL), asked AS (SELECT DISTINCT substr('user/' || user_id, 1, 6 + user_id % 2) AS asked FROM events UNION SELECT 'nobody')
SELECT asked, CASE WHEN exact THEN asked WHEN n = 1 THEN one END AS name, CASE WHEN exact OR n = 1 THEN 'ok' WHEN n > 1 THEN 'ambiguous' ELSE 'not_found' END AS status, n AS candidates
FROM (SELECT asked, coalesce(bool_or(name = asked), false) AS exact, min(name) AS one, count(name) AS n FROM asked LEFT JOIN live ON starts_with(name, asked) GROUP BY asked)"""
)
def ref_resolve_prefix(spark, d):
    """Exact name, else a unique prefix (J-13); prefixes meet names by equality, not by comparing all pairs."""
    name = F.concat(F.lit("user/"), F.col("user_id").cast("string"))
    asked = t.table(spark, d, "events").select(F.substr(name, F.lit(1), (6 + F.col("user_id") % 2).cast("int")).alias("asked")).distinct().unionByName(spark.createDataFrame([("nobody",)], "asked string"))
    return lookup.resolve_names(refs.current(t.reflog(spark, d)), asked).select("asked", "name", "status", F.size("candidates").cast("long").alias("candidates"))


@query(f"WITH RECURSIVE {t.GRAPH} SELECT dst AS digest, count(*) AS inbound FROM edges GROUP BY dst")
def inbound_counts(spark, d):
    return lookup.inbound(t.edges(spark, d))


@query(f"WITH RECURSIVE {t.GRAPH} SELECT src AS digest, string_agg(dst, ',' ORDER BY dst) AS outbound FROM edges GROUP BY src")
def outbound_lists(spark, d):
    return t.edges(spark, d).groupBy(F.col("src").alias("digest")).agg(F.array_join(F.array_sort(F.collect_list("dst")), ",").alias("outbound"))


# --- graph -------------------------------------------------------------------------------------------------------------------------------


@query(f"WITH RECURSIVE {t.GRAPH} SELECT digest FROM reached")
def reachable_from_roots(spark, d):
    return graph.reachable(t.edges(spark, d), t.roots(spark, d)).select("digest")


@query(
    f"""WITH RECURSIVE {t.GRAPH}, i AS (SELECT dst AS digest, count(*) AS n FROM edges GROUP BY dst)
SELECT digest, coalesce(n, 0) AS inbound, r.digest IS NULL AS orphaned, r.digest IS NULL AND n IS NULL AS detached, r.digest IS NOT NULL AND n IS NULL AS root
FROM nodes LEFT JOIN i USING (digest) LEFT JOIN reached r USING (digest)"""
)
def object_classes(spark, d):
    e = t.edges(spark, d)
    return graph.classes(t.nodes(spark, d), e, graph.reachable(e, t.roots(spark, d)))


@query(f"WITH RECURSIVE {t.GRAPH} SELECT substr(digest, 1, 1) AS kind, count(*) AS orphans FROM nodes WHERE digest NOT IN (SELECT digest FROM reached) GROUP BY 1")
def orphans(spark, d):
    reached = graph.reachable(t.edges(spark, d), t.roots(spark, d))
    return lookup.missing(reached, t.nodes(spark, d)).groupBy(F.substring("digest", 1, 1).alias("kind")).agg(F.count("*").alias("orphans"))


@query("""WITH RECURSIVE turns AS (SELECT DISTINCT conv_id, turn FROM conversations), heads AS (SELECT conv_id, max(turn) AS turn FROM turns GROUP BY conv_id),
chain(conv_id, turn, depth) AS (SELECT conv_id, turn, CAST(0 AS BIGINT) FROM heads UNION SELECT c.conv_id, c.turn - 1, c.depth + 1 FROM chain c JOIN turns t ON t.conv_id = c.conv_id AND t.turn = c.turn - 1)
SELECT conv_id || ':' || turn AS digest, depth FROM chain""")
def walk_history_chain(spark, d):
    """From each conversation's last turn to its first, by pointer doubling (R-10)."""
    rows = t.table(spark, d, "conversations").select("conv_id", "turn").distinct()
    name = lambda turn: F.concat_ws(":", F.col("conv_id").cast("string"), turn.cast("string"))
    before = rows.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("turn").alias("p"))
    parents = rows.join(before, ["conv_id", "turn"], "left").select(name(F.col("turn")).alias("digest"), F.when(F.col("p").isNotNull(), name(F.col("p"))).alias("parent"))
    heads = rows.groupBy("conv_id").agg(F.max("turn").alias("turn")).select(name(F.col("turn")).alias("digest"))
    return graph.history(parents, heads).select("digest", "depth")


@query(f"WITH RECURSIVE {t.GRAPH}, hop1 AS (SELECT e.dst AS digest FROM roots r JOIN edges e ON e.src = r.digest), hop2 AS (SELECT e.dst AS digest FROM hop1 h JOIN edges e ON e.src = h.digest) SELECT digest FROM roots UNION SELECT digest FROM hop1 UNION SELECT digest FROM hop2")
def khop_preload(spark, d):
    return graph.reachable(t.edges(spark, d), t.roots(spark, d), depth=2).select("digest")


@query(f"WITH RECURSIVE {t.GRAPH.split('), nodes')[0]} UNION SELECT 'r' || r_regionkey, 'n' || (r_regionkey * 3) FROM region), roots AS (SELECT 'n0' AS digest), reached(digest) AS (SELECT digest FROM roots UNION SELECT e.dst FROM reached r JOIN edges e ON e.src = r.digest) SELECT digest FROM reached")
def graph_cycle_safe(spark, d):
    """Regions refer back to nations; the walk ends all the same."""
    back = t.table(spark, d, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("src"), F.concat(F.lit("n"), (F.col("r_regionkey") * 3).cast("string")).alias("dst"))
    return graph.reachable(t.edges(spark, d).unionByName(back), spark.createDataFrame([("n0",)], "digest string")).select("digest")


@query("SELECT n_name AS name, 'r' || n_regionkey AS digest FROM nation JOIN (SELECT DISTINCT c_nationkey FROM customer) ON c_nationkey = n_nationkey")
def resolve_two_hops(spark, d):
    """Name to customer's nation to region, an equi-join a hop (J-17, J-18)."""
    names = t.table(spark, d, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("digest"), F.col("n_name").alias("name"))
    used = t.edges(spark, d).filter("src like 'c%'").select(F.col("dst").alias("digest")).distinct()
    found = graph.resolve_path(t.edges(spark, d), used, 1)
    return found.join(names.withColumnRenamed("digest", "origin"), "origin").select("name", "digest")


# --- retention and integrity ---------------------------------------------------------------------------------------------------------------

_NOW = "2024-03-01 00:00:00"
_STORE = f"""{t.DOCUMENTS}, objs AS (SELECT digest, min(size) AS size, min(doc_id) AS doc_id FROM docs GROUP BY digest),
stored AS (SELECT digest, size, doc_id, TIMESTAMP '{_NOW}' - to_minutes(doc_id % 180) AS mtime FROM objs),
kept AS (SELECT DISTINCT digest FROM docs JOIN labels USING (doc_id) WHERE quality = 1)"""


def _stored(spark, d) -> DataFrame:
    rows = t.objects(spark, d).select(F.unhex("digest").alias("digest"), "size", "doc_id")
    return rows.withColumn("mtime", F.timestamp_micros(F.unix_micros(F.lit(_NOW).cast("timestamp")) - F.col("doc_id") % 180 * 60_000_000))


def _kept(spark, d) -> DataFrame:
    good = t.table(spark, d, "labels").filter("quality = 1").select("doc_id")
    return t.documents(spark, d).join(good, "doc_id", "left_semi").select(F.unhex("digest").alias("digest")).distinct()


@query(f"WITH {_STORE} SELECT digest AS hash, size FROM stored WHERE digest NOT IN (SELECT digest FROM kept)")
def sweep_plan(spark, d):
    return retention.sweep(_stored(spark, d), _kept(spark, d)).select(dg.to_text(F.col("digest")).alias("hash"), "size")


@query(f"WITH {_STORE} SELECT digest AS hash, size FROM stored WHERE digest NOT IN (SELECT digest FROM kept) AND TIMESTAMP '{_NOW}' - mtime >= INTERVAL 1 HOUR")
def prune_min_age(spark, d):
    plan, _ = retention.prune(_stored(spark, d), _kept(spark, d), F.lit(_NOW).cast("timestamp"), 3600)
    return plan.select(dg.to_text(F.col("digest")).alias("hash"), "size")


@query(f"WITH {_STORE}, x AS (SELECT digest, size FROM stored WHERE digest NOT IN (SELECT digest FROM kept)) SELECT (SELECT count(*) FROM stored) AS before, count(*) AS deleted, CAST(coalesce(sum(size), 0) AS BIGINT) AS freed, (SELECT count(*) FROM stored) - count(*) AS after FROM x")
def gc_report(spark, d):
    rows = _stored(spark, d)
    return retention.report(rows, retention.sweep(rows, _kept(spark, d)))


def _damaged(spark, d) -> DataFrame:
    """Stored bytes, some of them changed after they were addressed and some unreadable."""
    text = F.coalesce("text", F.lit(""))
    rows = t.table(spark, d, "documents").select("doc_id", F.sha2(text, 256).alias("h"), text.alias("text"))
    rows = rows.groupBy("h").agg(F.min("doc_id").alias("doc_id"), F.first("text").alias("text"))
    content = F.when(F.col("doc_id") % 11 == 5, F.concat("text", F.lit("!"))).when(F.col("doc_id") % 13 != 7, F.col("text")).cast("binary")
    return rows.select("doc_id", F.unhex("h").alias("digest"), content.alias("content"), F.octet_length(content).cast("long").alias("size"))


_DAMAGED = f"{t.OBJECTS}, states AS (SELECT digest, doc_id, CASE WHEN doc_id % 11 = 5 THEN 'corrupt' WHEN doc_id % 13 = 7 THEN 'not-verified' ELSE 'verified' END AS state FROM objs)"


@query(f"WITH {_DAMAGED} SELECT digest AS hash, state FROM states")
def verify_all(spark, d):
    return verify.verify(_damaged(spark, d)).select(dg.to_text(F.col("digest")).alias("hash"), "state")


@query(f"WITH {_DAMAGED} SELECT count(*) AS checked, count(*) FILTER (state = 'verified') AS verified, count(*) FILTER (state = 'corrupt') AS corrupt, count(*) FILTER (state = 'not-verified') AS unchecked FROM states")
def verify_tally(spark, d):
    return verify.tally(verify.verify(_damaged(spark, d)))


@query(
    f"""WITH {_DAMAGED}, kept AS (SELECT DISTINCT digest FROM docs JOIN labels USING (doc_id) WHERE quality = 1)
SELECT digest AS hash, CASE WHEN state = 'corrupt' THEN 'corrupt' WHEN digest NOT IN (SELECT digest FROM kept) THEN 'orphaned' ELSE 'verified' END AS state FROM states"""
)
def audit_states(spark, d):
    rows = _damaged(spark, d)
    return verify.audit(rows, _kept(spark, d), verify.verify(rows)).select(dg.to_text(F.col("digest")).alias("hash"), "state")


@query(
    f"""WITH {_DAMAGED} SELECT digest AS hash, CASE WHEN doc_id % 4 = 0 THEN 'unrecorded' WHEN doc_id % 4 = 1 AND doc_id % 3 = 0 THEN 'wrong_algorithm'
  WHEN state = 'not-verified' THEN 'unreadable' WHEN state = 'corrupt' THEN 'corrupt' ELSE 'verified' END AS state FROM states"""
)
def checksum_verify_states(spark, d):
    """Records of the bytes as they were, against the bytes as they are (J-14)."""
    rows = _damaged(spark, d)
    whole = t.table(spark, d, "documents").select(F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("digest"), F.coalesce("text", F.lit("")).cast("binary").alias("content")).dropDuplicates(["digest"])
    records = verify.record(whole, "crc32", F.lit(_NOW).cast("timestamp")).join(rows.select("digest", "doc_id"), "digest").filter("doc_id % 4 <> 0")
    records = records.withColumn("algo", F.when((F.col("doc_id") % 4 == 1) & (F.col("doc_id") % 3 == 0), F.lit("adler32")).otherwise(F.col("algo"))).drop("doc_id")
    return verify.verify_checksums(rows, records, "crc32").select(dg.to_text(F.col("digest")).alias("hash"), "state")


_NAMES = "CASE event_id % 6 WHEN 0 THEN 'a.tmp' WHEN 1 THEN 'a.tmp.' || event_id WHEN 2 THEN 'a.tmp.x' WHEN 3 THEN 'a.tmp.tmp' WHEN 4 THEN 'object' ELSE 'a.tmp.-3' END"


@query(f"SELECT event_id, {_NAMES} AS name FROM events WHERE event_id % 6 IN (0, 1, 5) AND event_id % 50 >= 24")
def orphan_temp_names(spark, d):
    """Temporary files older than a day, the name cut at its first mark (F-11, M-10)."""
    rows = t.table(spark, d, "events").select("event_id", F.concat(F.lit("/store/"), F.expr(_NAMES)).alias("path"))
    now = F.lit(_NOW).cast("timestamp")
    rows = rows.withColumn("mtime", F.timestamp_micros(F.unix_micros(now) - F.col("event_id") % 50 * 3_600_000_000))
    return retention.orphan_temps(rows, now).select("event_id", F.substring_index("path", "/", -1).alias("name"))


# --- refs ----------------------------------------------------------------------------------------------------------------------------------


def _text(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.lower(F.hex(c)) for c in columns})


@query(f"WITH {t.REFLOG}, x AS (SELECT name, arg_max(struct_pack(v := old), seq).v AS previous FROM reflog GROUP BY name) SELECT name, previous FROM x WHERE previous IS NOT NULL")
def reflog_previous(spark, d):
    return _text(refs.previous(t.reflog(spark, d)), "previous")


@query(f"WITH {t.REFLOG}, x AS (SELECT name, arg_max(struct_pack(v := new), seq).v AS digest FROM reflog GROUP BY name) SELECT name, digest FROM x WHERE digest IS NOT NULL")
def refs_current(spark, d):
    return _text(refs.current(t.reflog(spark, d)), "digest")


@query(f"WITH {t.REFLOG} SELECT name, seq, new, old, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY name ORDER BY seq DESC) AS INTEGER) AS rank FROM reflog) WHERE rank <= 3")
def reflog_newest_n(spark, d):
    return _text(refs.newest(t.reflog(spark, d), 3).select("name", "seq", "new", "old", "rank"), "new", "old")


@query(f"WITH {t.REFLOG}, x AS (SELECT name, arg_max(struct_pack(v := new), seq).v AS digest FROM reflog GROUP BY name) SELECT digest FROM x WHERE digest IS NOT NULL")
def roots_from_refs(spark, d):
    return _text(refs.roots(t.reflog(spark, d)), "digest")


@query(
    f"""WITH {t.REFLOG}, x AS (SELECT name, arg_max(struct_pack(v := new), seq).v AS digest, max(seq) AS seq FROM reflog GROUP BY name)
SELECT name, seq + 1 AS seq, digest AS old FROM x WHERE digest IS NOT NULL AND length(name) = 6"""
)
def refs_after_delete(spark, d):
    """Entries that deletions append; names that are not set give none (SK-17)."""
    log = t.reflog(spark, d)
    names = log.select("name").distinct().filter(F.length("name") == 6)
    return _text(refs.delete_refs(log, names, F.lit(0)).select("name", "seq", "old"), "old")


_LINES = "CASE event_id % 5 WHEN 0 THEN event_id || chr(9) || sha || chr(9) WHEN 1 THEN event_id || chr(9) || sha WHEN 2 THEN 'x' || chr(9) || sha || chr(9) WHEN 3 THEN event_id || chr(9) || upper(sha) || chr(9) ELSE event_id || chr(9) || chr(9) || sha END"


@query("SELECT event_id AS ts_ns, CASE event_id % 5 WHEN 0 THEN sha256(CAST(event_id AS VARCHAR)) END AS new, CASE event_id % 5 WHEN 4 THEN sha256(CAST(event_id AS VARCHAR)) END AS old FROM events WHERE event_id % 5 IN (0, 4)")
def reflog_parse(spark, d):
    """Torn and malformed lines are left out (SC-32)."""
    lines = t.table(spark, d, "events").withColumn("sha", F.sha2(F.col("event_id").cast("string"), 256)).select(F.lit("main").alias("name"), F.col("event_id").alias("seq"), F.expr(_LINES).alias("line"))
    return _text(refs.parse_log(lines).select("ts_ns", "new", "old"), "new", "old")


_REFNAMES = "CASE c_custkey % 8 WHEN 0 THEN 'release/v' || c_custkey WHEN 1 THEN '/abs' || c_custkey WHEN 2 THEN 'a/../b' WHEN 3 THEN 'x.lock' WHEN 4 THEN 'con.txt' WHEN 5 THEN 'a//b' WHEN 6 THEN 'feature-x' || c_custkey ELSE 'end.' END"


@query(f"SELECT c_custkey, c_custkey % 8 IN (0, 6) AS valid FROM customer")
def ref_name_valid(spark, d):
    return t.table(spark, d, "customer").select("c_custkey", refs.valid_name(F.expr(_REFNAMES)).alias("valid"))


# --- hashes, codecs, chunks -------------------------------------------------------------------------------------------------------------------


@query("""WITH b AS (SELECT n_nationkey, unnest(range(1, length(n_name) + 1)) AS i, n_name FROM nation), s AS (
  SELECT n_nationkey, 1 + sum(ascii(n_name[i])) AS a, length(n_name) + sum((length(n_name) - i + 1) * ascii(n_name[i])) AS b FROM b GROUP BY n_nationkey, n_name)
SELECT n_nationkey, CAST((b % 65521) * 65536 + a % 65521 AS BIGINT) AS adler FROM s""")
def adler32_closed_form(spark, d):
    return t.table(spark, d, "nation").select("n_nationkey", hashing.adler32_closed(F.col("n_name").cast("binary")).alias("adler"))


def _hashed(spark, d, algorithm: str) -> DataFrame:
    return t.table(spark, d, "documents").select("doc_id", dg.to_text(hashing.digest(algorithm, F.coalesce("text", F.lit("")).cast("binary"))).alias("hash"))


def _crc_sql(kind: str, polynomial: int, ones: int, digits: int) -> str:
    """A reflected CRC of each document, by a table of a byte's remainders."""
    return f"""WITH RECURSIVE k(n, c, s) AS (
  SELECT CAST(i AS {kind}), CAST(i AS {kind}), 0 FROM range(256) r(i)
  UNION ALL SELECT n, CASE WHEN c & 1 = 1 THEN xor(c >> 1, {polynomial}::{kind}) ELSE c >> 1 END, s + 1 FROM k WHERE s < 8),
tab AS (SELECT list(c ORDER BY n) AS t FROM k WHERE s = 8),
d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
b AS (SELECT doc_id, list_transform(range(0, length(x) // 2), lambda i: CAST('0x' || substr(x, 2 * i + 1, 2) AS {kind})) AS v FROM d)
SELECT doc_id, lpad(lower(to_hex(xor(list_reduce(list_prepend({ones}::{kind}, v), lambda a, y: xor(a >> 8, t[CAST(xor(a, y) & 255 AS BIGINT) + 1])), {ones}::{kind}))), {digits}, '0') AS hash FROM b, tab"""


@query(_crc_sql("UINTEGER", 0xEDB88320, 2**32 - 1, 8))
def crc32_hex(spark, d):
    return _hashed(spark, d, "crc32")


@query(_crc_sql("UBIGINT", hashing.CRC64_POLY, 2**64 - 1, 16))
def crc64_hex(spark, d):
    return _hashed(spark, d, "crc64")


@query("""WITH d AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS n, hex(encode(coalesce(text, ''))) AS x FROM documents),
b AS (SELECT doc_id, n, unnest(range(1, n + 1)) AS i, x FROM d),
v AS (SELECT doc_id, n, i, CAST('0x' || substr(x, 2 * i - 1, 2) AS BIGINT) AS c FROM b),
s AS (SELECT doc_id, 1 + sum(c) AS a, any_value(n) + sum((n - i + 1) * c) AS b FROM v GROUP BY doc_id)
SELECT d.doc_id, printf('%08x', CAST((coalesce(b, 0) % 65521) * 65536 + coalesce(a, 1) % 65521 AS BIGINT)) AS hash FROM d LEFT JOIN s USING (doc_id)""")
def adler32_hex(spark, d):
    return _hashed(spark, d, "adler32")


@query()
def sha512_hex(spark, d):
    return _hashed(spark, d, "sha512")


@query()
def sha512_256_hex(spark, d):
    return _hashed(spark, d, "sha512_256")


@query("SELECT doc_id, sha256(coalesce(text, '')) AS hash FROM documents")
def sha256_hex(spark, d):
    return _hashed(spark, d, "sha256")


@query("SELECT doc_id, h AS gzip, h AS zlib, h AS flate, true AS stopped FROM (SELECT doc_id, sha256(coalesce(text, '') || '0123456789') AS h FROM documents)")
def deflate_roundtrip(spark, d):
    """The deflate family comes back whole, and output over a bound is refused (X-41..X-44)."""
    x = F.concat(F.coalesce("text", F.lit("")), F.lit("0123456789")).cast("binary")
    rows = t.table(spark, d, "documents").select("doc_id", x.alias("x"))
    rows = rows.withColumns({"g": codecs.gzip_encode(F.col("x")), "z": codecs.zlib_encode(F.col("x")), "f": codecs.flate_encode(F.col("x"))})
    return rows.select("doc_id", F.sha2(codecs.gzip_decode(F.col("g")), 256).alias("gzip"), F.sha2(codecs.zlib_decode(F.col("z")), 256).alias("zlib"), F.sha2(codecs.flate_decode(F.col("f")), 256).alias("flate"), codecs.flate_decode(F.col("f"), 5).isNull().alias("stopped"))


@query("SELECT event_id, event_type AS a, event_id AS b, value AS c0, -1.5::DOUBLE AS c1, user_id AS d FROM events")
def cbor_roundtrip(spark, d):
    """JSON to CBOR and back (X-48, X-49)."""
    value = F.to_json(F.struct(F.col("event_type").alias("a"), F.col("event_id").alias("b"), F.array(F.col("value"), F.lit(-1.5)).alias("c"), F.col("user_id").alias("d")))
    rows = t.table(spark, d, "events").select("event_id", value.alias("j"))
    back = codecs.cbor_to_json(codecs.cbor_from_json(F.col("j")))
    v = F.from_json(back, "a string, b long, c array<double>, d long")
    return rows.select("event_id", v.alias("v")).select("event_id", "v.a", "v.b", F.col("v.c")[0].alias("c0"), F.col("v.c")[1].alias("c1"), "v.d")


@query("SELECT min(doc_id) AS doc_id, sha256(coalesce(text, '')) AS back, CAST(count(*) AS BIGINT) AS copies FROM documents GROUP BY sha256(coalesce(text, ''))")
def chunk_split_join(spark, d):
    rows = t.table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("content"))
    rows = rows.groupBy(F.sha2("content", 256).alias("digest")).agg(F.min("doc_id").alias("doc_id"), F.first("content").alias("content"), F.count("*").alias("copies"))
    back = chunks.join(chunks.split(rows.select("digest", "content"), 512)).select("digest", F.col("content").alias("_c"))
    back = rows.select("digest", "doc_id", "copies").join(back, "digest", "left")
    return back.select("doc_id", F.sha2(F.coalesce("_c", F.lit(b"")), 256).alias("back"), "copies")


@query(f"WITH {t.DOCUMENTS} SELECT doc_id, CAST((size + 999) // 1000 AS BIGINT) AS chunks, CAST(1 AS BIGINT) AS whole FROM docs")
def chunk_counts(spark, d):
    return t.documents(spark, d).select("doc_id", chunks.count(F.col("size"), 1000).alias("chunks"), chunks.count(F.col("size"), 0).alias("whole"))


@query(
    f"""WITH {t.DOCUMENTS}, u AS (SELECT doc_id, size, CASE WHEN size < 1048576 THEN size / 1024.0 WHEN size < 1073741824 THEN size / 1048576.0 ELSE size / 1073741824.0 END AS v,
  CASE WHEN size < 1048576 THEN 'KiB' WHEN size < 1073741824 THEN 'MiB' ELSE 'GiB' END AS unit FROM docs)
SELECT doc_id, CASE WHEN size < 1024 THEN size || ' B' WHEN v >= 10 OR v = floor(v) THEN printf('%.0f', CAST(v AS DOUBLE)) || ' ' || unit ELSE printf('%.1f', CAST(v AS DOUBLE)) || ' ' || unit END AS shown FROM u"""
)
def format_sizes(spark, d):
    return t.documents(spark, d).select("doc_id", formats.format_bytes(F.col("size")).alias("shown"))


@query("""SELECT event_id, CASE WHEN m < 60 THEN m || 'm ago' WHEN m < 1440 THEN (m // 60) || 'h ago' ELSE (m // 1440) || 'd ago' END AS age
FROM (SELECT event_id, greatest(0, (epoch_us(TIMESTAMP '2024-03-01 00:00:00') - epoch_us(ts)) // 60000000) AS m FROM events)""")
def age_labels(spark, d):
    return t.table(spark, d, "events").select("event_id", formats.age_label(F.col("ts").cast("timestamp"), F.lit(_NOW).cast("timestamp")).alias("age"))


@query("SELECT n_nationkey, lower(hex(encode(n_name))) AS hex, length(n_name) AS bytes FROM nation")
def hexdump_names(spark, d):
    rows = t.table(spark, d, "nation").select("n_nationkey", "n_name", formats.hexdump(F.col("n_name").cast("binary")).alias("r"))
    return rows.select("n_nationkey", F.replace(F.array_join(F.transform("r", lambda x: x["hex"]), ""), F.lit(" "), F.lit("")).alias("hex"), F.octet_length("n_name").cast("long").alias("bytes"))


# --- Bloom filters, packs, caches ------------------------------------------------------------------------------------------------------------


def _filter(spark, d):
    """A filter over documents, sized from their number."""
    rows = t.objects(spark, d).select("digest")
    m, k = bloom.parameters(max(1, rows.count()), 0.01)
    return rows, bloom.build(rows, m, k), m, k


@query(f"WITH {t.OBJECTS} SELECT count(*) AS probed, CAST(0 AS BIGINT) AS missed FROM objs")
def bloom_no_false_negative(spark, d):
    rows, filter_, m, k = _filter(spark, d)
    return bloom.probe(rows, filter_, m, k).agg(F.count("*").alias("probed"), F.count_if(~F.col("maybe")).alias("missed"))


@query(f"WITH {_SETS} SELECT DISTINCT digest FROM wanted WHERE digest IN (SELECT digest FROM objs)")
def bloom_guarded_semi(spark, d):
    rows, filter_, m, k = _filter(spark, d)
    return bloom.guarded_exists(_wanted(spark, d).select("digest").distinct(), rows, filter_, m, k)


@query("SELECT true AS within_bound")
def bloom_false_positive_rate(spark, d):
    """At most three times the rate that the filter was made for."""
    rows, filter_, m, k = _filter(spark, d)
    other = spark.range(5000).select(F.sha2(F.concat(F.lit("other "), F.col("id").cast("string")), 256).alias("digest"))
    return bloom.probe(other, filter_, m, k).agg((F.count_if("maybe") <= 150).alias("within_bound"))


@query(f"WITH {t.OBJECTS} SELECT digest FROM objs WHERE doc_id % 2 = 0")
def counting_bloom_remove(spark, d):
    """What stays is still found after the others are removed (A-19, A-20)."""
    rows = t.objects(spark, d).select("digest", "doc_id")
    m, k = bloom.parameters(max(1, rows.count()), 0.001)
    counters = bloom.remove(bloom.counting(rows.select("digest"), m, k, 16), rows.filter("doc_id % 2 = 1").select("digest"), m, k)
    return bloom.counting_probe(rows.filter("doc_id % 2 = 0").select("digest"), counters, m, k).filter("maybe").select("digest")


@query(f"WITH {t.DOCUMENTS} SELECT codec AS shard, doc_id AS seq, CAST(coalesce(sum(size) OVER (PARTITION BY codec ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // 65536 AS BIGINT) AS pack FROM docs")
def pack_assignment_running(spark, d):
    """Packs by running size within a shard (W-06)."""
    rows = t.documents(spark, d).select(F.col("codec").alias("shard"), F.col("doc_id").alias("seq"), "size")
    return chunks.approximate_packs(rows, 65536, "shard").select("shard", "seq", "pack")


@query(
    f"""WITH RECURSIVE {t.DOCUMENTS}, s AS (SELECT codec, doc_id, size, row_number() OVER (PARTITION BY codec ORDER BY doc_id) AS n FROM docs),
p(codec, doc_id, size, n, pack, used) AS (
  SELECT codec, doc_id, size, n, CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM s WHERE n = 1
  UNION ALL SELECT s.codec, s.doc_id, s.size, s.n, CASE WHEN p.used + p.size >= 65536 THEN p.pack + 1 ELSE p.pack END, CASE WHEN p.used + p.size >= 65536 THEN 0 ELSE p.used + p.size END
  FROM p JOIN s ON s.codec = p.codec AND s.n = p.n + 1)
SELECT codec AS shard, doc_id AS seq, pack, used AS off FROM p"""
)
def pack_assignment(spark, d):
    """The exact rule: a pack is closed when it is full before an append (SK-09)."""
    rows = t.documents(spark, d).select(F.col("codec").alias("shard"), F.col("doc_id").alias("seq"), "digest", "size")
    return chunks.assign_packs(rows, 65536, 10_000, "shard").select("shard", "seq", "pack", "off")


@query("""WITH e AS (SELECT user_id AS u, event_id AS i, event_type AS x, lag(event_id) OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS p FROM events),
h AS (SELECT e.u, e.i, any_value(e.p) AS p, count(DISTINCT o.x) AS between_them FROM e LEFT JOIN e o ON o.u = e.u AND o.i > e.p AND o.i < e.i GROUP BY e.u, e.i),
c AS (SELECT count(*) FILTER (p IS NOT NULL AND between_them < 2) AS hits, count(*) AS n FROM h)
SELECT hits, n - hits AS misses, hits / n AS rate FROM c""")
def lru_cache_hits(spark, d):
    """An access hits a cache of two if fewer than two other values came since the last of its own."""
    rows = t.table(spark, d, "events").select(F.col("user_id").alias("session"), F.col("event_id").alias("step"), F.col("event_type").alias("digest"))
    return caches.cache_stats(caches.lru_hits(rows, 2))


# --- streams (extensions) --------------------------------------------------------------------------------------------------------------------


def _events_stream(spark, d) -> DataFrame:
    from pyspark.sql.types import StringType

    rows = t.table(spark, d, "events")
    # a stream reads a folder; the one file is picked by its name
    stream = spark.readStream.schema(rows.schema).option("pathGlobFilter", "events.parquet").parquet(d)
    return stream.withColumn("ts", F.col("ts").cast("timestamp")) if not isinstance(rows.schema["ts"].dataType, StringType) else stream


def _finish(q, spark, name: str) -> DataFrame:
    q.awaitTermination()
    return spark.table(name)


def _checkpoint(spark) -> tuple[str, str]:
    name = f"q{uuid.uuid4().hex}"
    return name, f"{folder(spark)}/streams/{name}"


@query("SELECT date_trunc('day', ts) AS start, event_type AS type, count(*) AS objects FROM events GROUP BY 1, 2")
def daily_event_census(spark, d):
    from shardwell.streaming import ingest

    name, path = _checkpoint(spark)
    q = ingest.rolling_census(_events_stream(spark, d).withColumnRenamed("event_type", "type"), name, path)
    return _finish(q, spark, name).select(F.col("start").cast("timestamp_ntz").alias("start"), "type", "objects")


@query("SELECT 'user/' || user_id AS name, arg_max(sha256(CAST(event_id AS VARCHAR)), event_id) AS digest FROM events GROUP BY user_id")
def stream_refs_current(spark, d):
    from shardwell.streaming import ingest

    name, path = _checkpoint(spark)
    rows = _events_stream(spark, d).select(F.concat(F.lit("user/"), F.col("user_id").cast("string")).alias("name"), F.col("event_id").alias("seq"), F.sha2(F.col("event_id").cast("string"), 256).alias("new"))
    return _finish(ingest.current_refs(rows, name, path), spark, name).select("name", "digest")


@query("SELECT DISTINCT sha256(event_type || ':' || user_id) AS hash FROM events")
def stream_dedup_ingest(spark, d):
    from shardwell.streaming import ingest

    name, path = _checkpoint(spark)
    rows = _events_stream(spark, d).select("ts", F.concat_ws(":", "event_type", F.col("user_id").cast("string")).alias("content"))
    out = f"{folder(spark)}/streams/{name}-table"
    ingest.dedup_ingest(rows, out, path, grace="60 days").awaitTermination()
    return spark.read.parquet(out).select(dg.to_text(F.col("digest")).alias("hash"))


from shardwell.plans import store_queries  # noqa: E402,F401  registers its queries
