"""Registered queries over typed objects, listings, refs, records and histories, each beside the DuckDB SQL with the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardwell.functions import codecs, envelope, formats, hashing
from shardwell.functions import digest as dg
from shardwell.operators import bloom, caches, chunks, graph, listing, lookup, models, objects, refs, retention, verify
from shardwell.plans import tables as t
from shardwell.plans.catalogue import _NOW, _finish, query
from shardwell.sources import files
from shardwell.sources.scratch import cut, folder
from shardwell.store import Store


def _hex(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.lower(F.hex(c)) for c in columns})


def _bytes(spark, d) -> DataFrame:
    """doc_id, digest, content, size of every document."""
    text = F.coalesce("text", F.lit("")).cast("binary")
    return t.table(spark, d, "documents").select("doc_id", hashing.sha256(text).alias("digest"), text.alias("content"), F.octet_length(text).cast("long").alias("size"), "lang", "source")


_VARINT = "(CASE WHEN {0} < 128 THEN 1 WHEN {0} < 16384 THEN 2 WHEN {0} < 2097152 THEN 3 ELSE 4 END)"

# --- typed objects -------------------------------------------------------------------------------------------------------------------


@query(
    f"""WITH {t.DOCUMENTS}, x AS (SELECT doc_id, size AS n, octet_length(encode(codec)) AS c, CASE doc_id % 3 WHEN 0 THEN type WHEN 1 THEN replace(type, '@1', '') ELSE '' END AS ty FROM docs)
SELECT doc_id, CASE WHEN doc_id % 7 = 3 THEN 'corrupt' WHEN contains(ty, '@') THEN 'ok' ELSE 'unknown_type' END AS status,
  CASE WHEN doc_id % 7 <> 3 AND contains(ty, '@') THEN CAST(1 + 1 + c + 1 + length(ty) + {_VARINT.format("n")} + n AS BIGINT) END AS size FROM x"""
)
def put_typed_states(spark, d):
    """Typed put: invariant, then type name, then the frame (SK-01, SK-02, F-14, X-31)."""
    kind = F.when(F.col("doc_id") % 3 == 0, F.concat("lang", F.lit("@1"))).when(F.col("doc_id") % 3 == 1, F.col("lang")).otherwise(F.lit(""))
    rows = _bytes(spark, d).select("doc_id", "source", kind.alias("kind"), F.col("content").alias("payload"))
    return objects.put_typed(rows, F.col("source"), F.col("kind"), F.col("payload"), F.col("doc_id") % 7 != 3).select("doc_id", "status", "size")


_TITLE = "CASE WHEN doc_id % 12 = 0 THEN '' ELSE lang || doc_id END"


@query(
    f"""SELECT doc_id, CASE doc_id % 6 WHEN 5 THEN 'not_found' WHEN 1 THEN 'corrupt' WHEN 2 THEN 'codec_mismatch' WHEN 3 THEN 'corrupt' WHEN 4 THEN 'unknown_type'
  ELSE CASE WHEN doc_id % 12 = 0 THEN 'corrupt' ELSE 'ok' END END AS status, CASE WHEN doc_id % 6 = 0 AND doc_id % 12 <> 0 THEN {_TITLE} END AS title FROM documents"""
)
def get_typed_states(spark, d):
    """Typed get with its order of errors: missing, cut frame, other codec, undecodable payload, other type, broken invariant (SC-20, F-13, G-07)."""
    rows = t.table(spark, d, "documents").select("doc_id", F.sha2(F.col("doc_id").cast("string"), 256).alias("h"), F.expr(_TITLE).alias("title"))
    rows = rows.withColumn("digest", F.unhex("h")).withColumn("json", F.to_json(F.struct("title")).cast("binary"))
    k = F.col("doc_id") % 6
    payload = F.when(k == 3, F.lit("no json").cast("binary")).otherwise(F.col("json"))
    whole = envelope.encode(F.when(k == 2, F.lit("cbor")).otherwise(F.lit("json")), F.when(k == 4, F.lit("other@1")).otherwise(F.lit("note@1")), payload)
    rows = rows.withColumn("content", F.when(k == 1, F.substr(whole, F.lit(1), F.octet_length(whole) - 1)).otherwise(whole))
    model = models.Model("note@1", "title string")
    got = objects.get_typed(rows.filter(k != 5), rows, "note@1", "json", model.decode, lambda v: v["title"] != "")
    return got.join(rows.select("digest", "doc_id"), "digest").select("doc_id", "status", F.col("value.title").alias("title"))


@query(f"WITH {t.DOCUMENTS} SELECT doc_id, digest IN (SELECT digest FROM docs WHERE doc_id % 2 = 0) AS deduplicated FROM docs")
def put_dedup_flags(spark, d):
    """SK-03, J-02."""
    rows = objects.address(t.table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("content")))
    return objects.put_dedup(rows.select("doc_id", "digest"), rows.filter("doc_id % 2 = 0")).select("doc_id", "deduplicated")


@query(f"WITH {t.DOCUMENTS} SELECT DISTINCT digest AS hash, size FROM docs WHERE digest NOT IN (SELECT digest FROM docs WHERE doc_id % 2 = 0)")
def put_new_objects(spark, d):
    """What a put of all adds to a store of the even ones (SK-04, J-02, SK-05)."""
    rows = _bytes(spark, d).select("doc_id", "digest", "size")
    return objects.new_objects(rows, rows.filter("doc_id % 2 = 0")).select(dg.to_text(F.col("digest")).alias("hash"), "size")


@query(f"WITH {t.DOCUMENTS}, g AS (SELECT digest, min(size) AS size, min(doc_id) AS doc_id FROM docs GROUP BY digest) SELECT digest AS hash, size FROM g WHERE doc_id % 4 <> 1")
def delete_guarded(spark, d):
    """Digests of another width and unknown ones change nothing (SK-12..SK-15)."""
    rows = _bytes(spark, d).groupBy("digest").agg(F.min("size").alias("size"), F.min("doc_id").alias("doc_id"))
    doomed = rows.filter("doc_id % 4 = 1").select("digest").unionByName(rows.select(F.substr("digest", F.lit(1), F.lit(16)).alias("digest")))
    return Store(rows).delete(doomed).objects.select(dg.to_text(F.col("digest")).alias("hash"), "size")


@query(f"WITH {t.DOCUMENTS} SELECT doc_id, CAST(CASE WHEN doc_id % 3 = 0 THEN 7 ELSE size END AS BIGINT) AS size FROM docs")
def put_replaces(spark, d):
    """A put under an existing key replaces its bytes (G-18)."""
    rows = t.documents(spark, d).select(F.col("doc_id").alias("digest"), "size")
    return objects.merge(rows, rows.filter("digest % 3 = 0").withColumn("size", F.lit(7).cast("long"))).select(F.col("digest").alias("doc_id"), "size")


@query(f"WITH {t.DOCUMENTS}, s AS (SELECT sum(size) AS n FROM docs) SELECT share, CAST(floor(n * share / 4) AS BIGINT) >= n AS fits FROM s, (VALUES (1), (3), (4), (5)) v(share)")
def put_within_cap(spark, d):
    """A replaced object counts net against the cap (SK-07, SC-44)."""
    rows = t.documents(spark, d).select(F.col("doc_id").alias("digest"), "size")
    batch = rows.filter("digest % 5 = 0")
    total = rows.agg(F.sum("size")).first()[0]
    return spark.createDataFrame([(s, objects.within_cap(rows, batch, total * s // 4)) for s in (1, 3, 4, 5)], "share int, fits boolean")


@query(f"WITH {t.DOCUMENTS} SELECT digest AS hash, CASE WHEN digest IN (SELECT digest FROM docs WHERE doc_id % 2 = 0) THEN size END AS bytes FROM docs")
def get_raw_bytes(spark, d):
    """SC-18, SC-19: a row per request, NULL where nothing is stored."""
    rows = _bytes(spark, d)
    stored = rows.filter("doc_id % 2 = 0").dropDuplicates(["digest"])
    got = objects.get_raw(stored, rows)
    return got.select(dg.to_text(F.col("digest")).alias("hash"), F.octet_length("content").cast("long").alias("bytes"))


@query(f"WITH {t.OBJECTS} SELECT digest AS hash, sha256(substr(text, 1, 0)) = digest AS is_empty, size > 256 AS truncated FROM objs JOIN documents USING (doc_id)")
def preview_heads(spark, d):
    """Bounded previews (SC-41); an empty text is an object too (G-25)."""
    rows = files.preview(_bytes(spark, d).dropDuplicates(["digest"]))
    return rows.select(dg.to_text(F.col("digest")).alias("hash"), (hashing.sha256(F.substr("head", F.lit(1), F.lit(0))) == F.col("digest")).alias("is_empty"), "truncated")


# --- listings --------------------------------------------------------------------------------------------------------------------------

_STORED = f"""{t.OBJECTS}, st AS (SELECT digest, doc_id, CASE WHEN doc_id % 4 = 2 THEN '' ELSE type END AS type, CASE WHEN doc_id % 4 = 2 THEN 0 ELSE 2 END AS version,
  CASE WHEN doc_id % 4 = 2 THEN 'unspecified' ELSE codec END AS codec, doc_id % 9 = 4 AS unreadable, doc_id % 4 = 2 AS headerless,
  CASE WHEN doc_id % 4 = 2 THEN 5 ELSE 1 + 1 + octet_length(encode(codec)) + 1 + length(type) + {_VARINT.format("size")} + size END AS size FROM objs)"""


def _store(spark, d) -> Store:
    """One frame a distinct text, some without a header and some unreadable."""
    rows = _bytes(spark, d).groupBy("digest").agg(F.min_by(F.struct("doc_id", "lang", "source", "content"), "doc_id").alias("x")).select("digest", "x.*")
    frame = envelope.encode(F.col("source"), F.concat("lang", F.lit("@1")), F.col("content"))
    content = F.when(F.col("doc_id") % 4 == 2, F.lit(b"plain")).otherwise(frame)
    rows = rows.select("digest", F.when(F.col("doc_id") % 9 != 4, content).alias("content"), F.octet_length(content).cast("long").alias("size"), F.lit(None).cast("timestamp").alias("mtime"))
    return Store(rows)


@query(f"WITH {_STORED} SELECT digest AS hash, size, type, CAST(version AS SMALLINT) AS version, codec FROM st WHERE NOT unreadable AND type = 'de@1' ORDER BY digest LIMIT 40 OFFSET 3")
def list_page_by_type(spark, d):
    """S-02, F-05, F-06, P-01, SC-01, SC-23: through the store's handle; an old type name means its first version."""
    return _store(spark, d).list("de", offset=3, limit=40)


@query(f"WITH {_STORED} SELECT digest AS hash, size, type, CAST(version AS SMALLINT) AS version, codec FROM st WHERE NOT unreadable AND codec = 'unspecified' ORDER BY digest LIMIT 1000")
def list_page_unspecified(spark, d):
    """``unspecified`` includes objects without a header (G-08, X-10)."""
    return _store(spark, d).list(codec="unspecified", limit=1000)


@query(f"WITH {_STORED} SELECT count(*) FILTER (NOT unreadable AND type = 'en@1') AS matches, count(*) FILTER (unreadable) AS skipped FROM st")
def list_counts(spark, d):
    """Unreadable rows are counted as skipped (F-06, G-05)."""
    return listing.filter_counts(_store(spark, d).metadata(), "en")


@query(f"""WITH {_STORED}, r AS (SELECT * FROM st WHERE NOT unreadable AND NOT headerless)
SELECT count(*) AS total, CAST(sum(size) AS BIGINT) AS bytes, (SELECT string_agg(type, ',' ORDER BY type) FROM (SELECT DISTINCT type FROM r)) AS types,
  (SELECT string_agg(codec, ',' ORDER BY codec) FROM (SELECT DISTINCT codec FROM r)) AS codecs FROM st""")
def snapshot_totals(spark, d):
    """Totals count unreadable objects; the distinct lists are of objects with a header (A-04, U-07, G-03)."""
    return listing.snapshot(_store(spark, d).metadata()).select("total", "bytes", F.array_join("types", ",").alias("types"), F.array_join("codecs", ",").alias("codecs"))


@query(f"""WITH {_STORED}, k AS (SELECT 'type' AS axis, type AS value FROM st WHERE NOT unreadable AND NOT headerless UNION ALL SELECT 'version', '2' FROM st WHERE NOT unreadable AND NOT headerless
  UNION ALL SELECT 'codec', codec FROM st WHERE NOT unreadable AND NOT headerless UNION ALL SELECT 'kind', CASE WHEN unreadable THEN 'unreadable' ELSE 'headerless' END FROM st WHERE unreadable OR headerless),
c AS (SELECT axis, value, count(*) AS n FROM k GROUP BY 1, 2) SELECT axis, string_agg(value || '=' || n, ', ' ORDER BY value) AS line FROM c GROUP BY axis""")
def census_lines(spark, d):
    """A-05, A-06, G-04."""
    return listing.census_text(_store(spark, d).census())


@query(f"WITH {_STORED} SELECT digest AS hash, type, codec, CASE WHEN unreadable THEN 'unreadable' WHEN headerless THEN 'headerless' ELSE 'framed' END AS header_status FROM (SELECT digest, unreadable, headerless, CASE WHEN unreadable THEN '' ELSE type END AS type, CASE WHEN unreadable THEN 'unspecified' ELSE codec END AS codec FROM st)")
def meta_of_all(spark, d):
    """One header read for all three fields (P-02, P-06, SC-21..SC-25)."""
    store = _store(spark, d)
    return store.meta(store.objects.select("digest")).select(dg.to_text(F.col("digest")).alias("hash"), "type", "codec", "header_status")


@query("SELECT user_id AS session, event_id AS step, lag(event_type) OVER w AS prev, lead(event_type) OVER w AS next FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)")
def trail_prev_next(spark, d):
    """W-04."""
    rows = t.table(spark, d, "events").select(F.col("user_id").alias("session"), F.col("event_id").alias("step"), F.col("event_type").alias("digest"))
    return listing.trail_neighbours(rows).select("session", "step", "prev", "next")


@query(f"""WITH {t.DOCUMENTS}, m AS (SELECT type, count(*) AS n FROM docs GROUP BY type), p AS (SELECT type, n, o FROM m, (VALUES (0), (25), (50)) v(o))
SELECT type, o AS "offset", CASE WHEN o > 0 THEN greatest(0, o - 25) END AS previous, CASE WHEN o + 25 < n THEN o + 25 END AS next, CAST((n - 1) // 25 * 25 AS BIGINT) AS last FROM p""")
def page_arithmetic(spark, d):
    """S-10, S-11; a row a type."""
    rows = []
    for r in t.documents(spark, d).groupBy("type").count().collect():
        for o in (0, 25, 50):
            link = listing.page_links(r[1], o, 25)
            rows.append((r[0], o, link["previous"], link["next"], link["last"]))
    return spark.createDataFrame(rows, "type string, offset int, previous int, next int, last long")


@query(f"WITH {_STORED} SELECT name FROM (VALUES ('type', 'en@1'), ('codec', 'no such codec')) v(name, x) WHERE x NOT IN (SELECT type FROM st WHERE NOT unreadable UNION SELECT codec FROM st WHERE NOT unreadable)")
def filters_without_objects(spark, d):
    """F-09: filters whose value no object has."""
    unknown = listing.unknown_filters(_store(spark, d).metadata(), listing.Browse(type="en@1", codec="no such codec"))
    return spark.createDataFrame([(n,) for n in unknown], "name string")


@query(f"""WITH RECURSIVE {t.GRAPH} SELECT 'n3' AS digest, (SELECT string_agg(lower(hex(encode(dst))), ',' ORDER BY dst) FROM edges WHERE src = 'n3') AS outbound,
  (SELECT string_agg(h, ',' ORDER BY h) FROM (SELECT lower(hex(encode(src))) AS h FROM edges WHERE dst = 'n3')) AS inbound_from""")
def inspect_one(spark, d):
    """The selected row with its references both ways (P-05, J-08, R-14)."""
    e = t.edges(spark, d).withColumn("ord", F.lit(0))
    found = listing.inspect(t.nodes(spark, d), e, F.lit("n3"))
    return found.select("digest", F.array_join("outbound", ",").alias("outbound"), F.array_join("inbound_from", ",").alias("inbound_from"))


@query(f"WITH RECURSIVE {t.GRAPH} SELECT dst AS digest, string_agg(DISTINCT src, ',' ORDER BY src) AS sources FROM edges GROUP BY dst")
def inbound_lists(spark, d):
    """J-09, R-14."""
    return lookup.neighbours(t.edges(spark, d)).select("digest", F.array_join("sources", ",").alias("sources"))


# --- paths, bytes and text forms -----------------------------------------------------------------------------------------------------------


@query(f"WITH {t.DOCUMENTS} SELECT doc_id, '/s/' || substr(digest, 1, 2) || '/' || substr(digest, 3, 2) || '/' || digest AS path, digest AS back, CAST(NULL AS VARCHAR) AS other FROM docs")
def digest_paths(spark, d):
    """SC-03, SC-04, SK-28; other file names are no digests (SC-02)."""
    files.check_layout(2, 2)
    rows = _bytes(spark, d).withColumn("path", dg.to_path("/s", F.col("digest"), 2, 2))
    other = dg.from_path(F.concat("path", F.lit(".tmp")))
    return rows.select("doc_id", "path", dg.to_text(dg.from_path(F.col("path"))).alias("back"), F.lower(F.hex(other)).alias("other"))


@query("SELECT event_id, coalesce(a = b, false) AS same FROM (SELECT event_id, CASE WHEN event_id % 5 > 0 THEN sha256(event_type) END AS a, CASE WHEN event_id % 3 > 0 THEN sha256(CASE WHEN event_id % 2 = 0 THEN event_type ELSE 'x' END) END AS b FROM events)")
def digest_same(spark, d):
    """An absent digest equals nothing (X-05, F-01)."""
    a = F.when(F.col("event_id") % 5 > 0, F.unhex(F.sha2("event_type", 256)))
    b = F.when(F.col("event_id") % 3 > 0, F.unhex(F.sha2(F.when(F.col("event_id") % 2 == 0, F.col("event_type")).otherwise(F.lit("x")), 256)))
    return t.table(spark, d, "events").select("event_id", F.coalesce(dg.same(a, b), F.lit(False)).alias("same"))


@query("SELECT doc_id, CAST(CASE WHEN text = '' THEN NULL ELSE CAST('0x' || substr(hex(encode(text)), 1, 2) AS INTEGER) END AS SMALLINT) AS version FROM documents")
def first_byte_version(spark, d):
    """The first byte verbatim, even of an unknown version (SC-24, X-37)."""
    return t.table(spark, d, "documents").select("doc_id", envelope.peek_version(F.col("text").cast("binary")).alias("version"))


@query("SELECT doc_id, source = '' OR source = 'src3' AS fits, true AS any_fits FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '' ELSE source END AS source FROM documents)")
def codec_compatibility(spark, d):
    """A mismatch needs two tags that differ; frames of version 1 have none (F-13, G-06)."""
    tag = F.when(F.col("doc_id") % 3 == 0, F.lit("")).otherwise(F.col("source"))
    return t.table(spark, d, "documents").select("doc_id", envelope.codec_matches(tag, "src3").alias("fits"), envelope.codec_matches(tag, "").alias("any_fits"))


@query("""SELECT event_id, regexp_replace(strftime(ts, '%Y-%m-%dT%H:%M:%S.%f'), '\\.?0+$', '') || 'Z' AS written, strftime(ts, '%Y-%m-%d %H:%M:%S') || ' UTC (' || CASE WHEN m < 60 THEN m || 'm ago' WHEN m < 1440 THEN (m // 60) || 'h ago' ELSE (m // 1440) || 'd ago' END || ')' AS checked
FROM (SELECT event_id, ts, greatest(0, (epoch_us(TIMESTAMP '2024-03-01 00:00:00') - epoch_us(ts)) // 60000000) AS m FROM events)""")
def time_labels(spark, d):
    """X-64, X-65."""
    ts = F.col("ts").cast("timestamp")
    return t.table(spark, d, "events").select("event_id", formats.timestamp_text(ts).alias("written"), formats.checked_label(ts, F.lit(_NOW).cast("timestamp")).alias("checked"))


@query("SELECT event_id, event_type || '?' || user_id || '?' AS safe, event_type AS bare, event_id || ' objects, ' || user_id || ' bytes' AS stats FROM events")
def text_forms(spark, d):
    """X-09, X-12, X-17."""
    rows = t.table(spark, d, "events")
    raw = F.concat("event_type", F.lit("\t"), F.col("user_id").cast("string"), F.lit("\x9f"))
    return rows.select("event_id", formats.safe_field(raw).alias("safe"), formats.bare_type(F.concat("event_type", F.lit("@2@x"))).alias("bare"), formats.stats_text(F.col("event_id"), F.col("user_id")).alias("stats"))


# --- codecs and checksums ------------------------------------------------------------------------------------------------------------------


@query("SELECT event_id, event_type AS type, user_id AS \"user\", CAST(NULL AS VARCHAR) AS damaged FROM events")
def json_decode(spark, d):
    """JSON against an explicit schema; what doesn't parse is NULL (X-40, E-02, E-03)."""
    from pyspark.sql.types import StructType

    shape = StructType.fromDDL("type string, user long")
    payload = F.to_json(F.struct(F.col("event_type").alias("type"), F.col("user_id").alias("user"))).cast("binary")
    value = codecs.from_json(payload, shape)
    return t.table(spark, d, "events").select("event_id", value["type"].alias("type"), value["user"].alias("user"), codecs.from_json(F.lit("{no").cast("binary"), shape)["type"].alias("damaged"))


@query("SELECT c_custkey, lower(hex(encode(reverse(c_name)))) AS coded, c_name AS back, 'swap+json' AS tag, '' AS untagged FROM customer")
def binary_transform(spark, d):
    """A codec from a pair of byte functions, and the tags of stacked codecs (X-45, X-47, E-14)."""
    encode, decode = codecs.binary_codec(lambda x: x[::-1], lambda x: x[::-1])
    rows = cut(t.table(spark, d, "customer").select("c_custkey", encode(F.col("c_name").cast("binary")).alias("x")), "coded")
    return rows.select("c_custkey", F.lower(F.hex("x")).alias("coded"), decode(F.col("x")).cast("string").alias("back"), F.lit(codecs.compose_tag("swap", "json")).alias("tag"), F.lit(codecs.compose_tag("swap", "")).alias("untagged"))


def _crc(poly: str, ones: str) -> str:
    step = "CASE WHEN v % 2 = 1 THEN xor(v >> 1, " + poly + "::UBIGINT) ELSE v >> 1 END"
    return f"""WITH RECURSIVE r(i, k, v) AS (SELECT i::UBIGINT, 0, i::UBIGINT FROM range(256) x(i) UNION ALL SELECT i, k + 1, {step} FROM r WHERE k < 8), tbl AS (SELECT i, v FROM r WHERE k = 8),
s(c_custkey, i, c) AS (SELECT c_custkey, 0, {ones}::UBIGINT FROM customer
  UNION ALL SELECT s.c_custkey, s.i + 1, xor(s.c >> 8, tbl.v) FROM s JOIN customer USING (c_custkey) JOIN tbl ON tbl.i = xor(s.c & 255::UBIGINT, ascii(c_name[s.i + 1])::UBIGINT) WHERE s.i < length(c_name))
SELECT c_custkey, lpad(lower(hex(xor(c, {ones}::UBIGINT))), {8 if ones == "4294967295" else 16}, '0') AS hash FROM s JOIN customer USING (c_custkey) WHERE s.i = length(c_name)"""


@query(_crc("3988292384", "4294967295"))
def crc32_customers(spark, d):
    """X-23, by the table's rule and a step a byte."""
    return t.table(spark, d, "customer").select("c_custkey", dg.to_text(hashing.digest("crc32", F.col("c_name").cast("binary"))).alias("hash"))


@query(_crc("14514072000185962306", "18446744073709551615"))
def crc64_customers(spark, d):
    """X-24."""
    return t.table(spark, d, "customer").select("c_custkey", dg.to_text(hashing.digest("crc64", F.col("c_name").cast("binary"))).alias("hash"))


@query("""WITH x AS (SELECT doc_id, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: CAST('0x' || h AS BIGINT)) AS b FROM documents),
s AS (SELECT doc_id, 1 + coalesce(list_sum(b), 0) AS a, len(b) + coalesce(list_sum(list_transform(b, lambda v, i: (len(b) - i + 1) * v)), 0) AS c FROM x)
SELECT doc_id, lower(lpad(hex(CAST((c % 65521) * 65536 + a % 65521 AS BIGINT)), 8, '0')) AS hash FROM s""")
def adler32_documents(spark, d):
    """X-25 over whole texts, by the closed form."""
    return t.table(spark, d, "documents").select("doc_id", dg.to_text(hashing.digest("adler32", F.coalesce("text", F.lit("")).cast("binary"))).alias("hash"))


@query("""WITH x AS (SELECT min(doc_id) AS doc_id, hex(encode(coalesce(any_value(text), ''))) AS h FROM documents GROUP BY sha256(coalesce(text, ''))),
c AS (SELECT doc_id, h, unnest(range(0, (length(h) + 1023) // 1024)) AS i FROM x)
SELECT doc_id, CAST(i AS INTEGER) AS idx, sha256(unhex(substr(h, 1 + 1024 * i, 1024))) AS hash FROM c""")
def chunk_rows(spark, d):
    """Chunks with their index and bytes (P-09, X-60, G-17)."""
    rows = _bytes(spark, d).groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.first("content").alias("content"))
    return Store(rows.select(F.col("doc_id").alias("digest"), "content")).split(512).select(F.col("digest").alias("doc_id"), "idx", F.sha2("data", 256).alias("hash"))


@query("SELECT doc_id, sha256(text) AS hash FROM documents WHERE text <> ''")
def chunks_joined(spark, d):
    """Chunks put together again, as digests of what they make (X-61, A-17)."""
    rows = _bytes(spark, d).select(F.col("doc_id").alias("digest"), "content")
    return chunks.join(chunks.split(rows, 700)).select(F.col("digest").alias("doc_id"), F.sha2("content", 256).alias("hash"))


@query("SELECT doc_id, '1f8b' AS gzip_head, sha256(text || '0123456789') AS gzip, sha256(text || '0123456789') AS zlib, sha256(text || '0123456789') AS flate FROM documents")
def deflate_contents(spark, d):
    """Digests of what the deflate family gives back (X-41..X-44)."""
    x = F.concat(F.coalesce("text", F.lit("")), F.lit("0123456789")).cast("binary")
    rows = t.table(spark, d, "documents").select("doc_id", x.alias("x"))
    rows = rows.withColumns({"g": codecs.gzip_encode(F.col("x")), "z": codecs.zlib_encode(F.col("x")), "f": codecs.flate_encode(F.col("x"))})
    return rows.select(
        "doc_id", F.lower(F.hex(F.substr("g", F.lit(1), F.lit(2)))).alias("gzip_head"), F.sha2(codecs.gzip_decode(F.col("g")), 256).alias("gzip"),
        F.sha2(codecs.zlib_decode(F.col("z")), 256).alias("zlib"), F.sha2(codecs.flate_decode(F.col("f")), 256).alias("flate"),
    )


@query("SELECT event_id, 'a3' AS head, event_type AS a, event_id AS b, user_id AS d FROM events")
def cbor_fields(spark, d):
    """Fields that come back from CBOR, which begins with a map of three (X-48, X-49)."""
    value = F.to_json(F.struct(F.col("event_type").alias("a"), F.col("event_id").alias("b"), F.col("user_id").alias("d")))
    rows = t.table(spark, d, "events").select("event_id", codecs.cbor_from_json(value).alias("x"))
    back = F.from_json(codecs.cbor_to_json(F.col("x")), "a string, b long, d long")
    return rows.select("event_id", F.lower(F.hex(F.substr("x", F.lit(1), F.lit(1)))).alias("head"), back["a"].alias("a"), back["b"].alias("b"), back["d"].alias("d"))


# --- packs and tiers ------------------------------------------------------------------------------------------------------------------------

_INDEX = f"""{t.DOCUMENTS}, idx AS (SELECT digest, 'p' || min(doc_id) % 7 AS pack, CASE WHEN min(doc_id) % 11 = 3 THEN -1 ELSE min(doc_id) * 10 END AS off, min(size) AS size FROM docs GROUP BY digest),
packs AS (SELECT 'p' || n_nationkey AS pack, 3000 + 100 * n_nationkey AS length FROM nation), valid AS (SELECT idx.* FROM idx JOIN packs USING (pack) WHERE off >= 0 AND size <= length - off)"""


def _index(spark, d) -> tuple[DataFrame, DataFrame]:
    rows = _bytes(spark, d).groupBy("digest").agg(F.min("doc_id").alias("i"), F.min("size").alias("size"))
    index = rows.select("digest", F.concat(F.lit("p"), (F.col("i") % 7).cast("string")).alias("pack"), F.when(F.col("i") % 11 == 3, F.lit(-1)).otherwise(F.col("i") * 10).cast("long").alias("off"), "size")
    packs = t.table(spark, d, "nation").select(F.concat(F.lit("p"), F.col("n_nationkey").cast("string")).alias("pack"), (3000 + 100 * F.col("n_nationkey")).cast("long").alias("length"))
    return index, packs


@query(f"WITH {_INDEX} SELECT digest AS hash, pack, CAST(off AS BIGINT) AS off, size FROM valid")
def pack_records_valid(spark, d):
    """Records that lie within their pack (SC-09, SC-10)."""
    return lookup.valid_records(*_index(spark, d)).select(dg.to_text(F.col("digest")).alias("hash"), "pack", "off", "size")


@query(f"WITH {_INDEX} SELECT doc_id, v.pack, CASE WHEN v.pack IS NULL THEN 'loose' ELSE 'packed' END AS tier FROM docs LEFT JOIN valid v USING (digest)")
def batch_plan(spark, d):
    """Requests by pack, the rest loose (SC-15..SC-17)."""
    index, packs = _index(spark, d)
    return lookup.plan_batch(_bytes(spark, d).select("doc_id", "digest"), index, packs).select("doc_id", "pack", "tier")


@query(f"WITH {_INDEX}, l AS (SELECT digest, min(size) AS size FROM docs WHERE doc_id % 3 = 0 GROUP BY digest), a AS (SELECT size FROM l UNION ALL SELECT size FROM idx WHERE size > 0 AND digest NOT IN (SELECT digest FROM l)) SELECT count(*) AS objects, CAST(sum(size) AS BIGINT) AS bytes FROM a")
def packed_store_stats(spark, d):
    """Zero-length entries that are only in the index are listed but not counted (A-03, G-16)."""
    loose = _bytes(spark, d).filter("doc_id % 3 = 0").groupBy("digest").agg(F.min("size").alias("size"))
    return listing.packed_stats(loose, _index(spark, d)[0])


@query(f"WITH {t.OBJECTS} SELECT digest AS hash, size, substr(digest, 1, 2) AS prefix FROM objs")
def objects_written_and_read(spark, d):
    """A table partitioned by prefix, appended to by a job that commits as a whole (SK-05, SK-06, SK-23, SC-36)."""
    path = f"{folder(spark)}/shardwell/objects-{uuid.uuid4().hex}"
    files.write_objects(_bytes(spark, d).groupBy("digest").agg(F.min("size").alias("size")), path, 2)
    return spark.read.schema("digest binary, size long, prefix string").parquet(path).select(dg.to_text(F.col("digest")).alias("hash"), "size", "prefix")


@query(f"WITH {t.OBJECTS} SELECT 'loose' AS tier, count(*) AS objects, CAST(sum(size) AS BIGINT) AS bytes FROM objs UNION ALL SELECT 'packed', count(*), CAST(sum(size) AS BIGINT) FROM objs")
def tiers_written(spark, d):
    """A put goes to both tiers, and the index is written once a batch (SK-08, SK-11)."""
    at = f"{folder(spark)}/shardwell/tiers-{uuid.uuid4().hex}"
    rows = _bytes(spark, d).groupBy("digest").agg(F.min("size").alias("size"))
    files.write_tiers(rows, f"{at}-loose", f"{at}-packed")
    read = lambda x: spark.read.parquet(f"{at}-{x}").agg(F.lit(x).alias("tier"), F.count("*").alias("objects"), F.sum("size").alias("bytes")).select("tier", "objects", "bytes")
    return read("loose").unionByName(read("packed"))


# --- records, refs and retention -------------------------------------------------------------------------------------------------------------


def _records(spark, d) -> DataFrame:
    rows = _bytes(spark, d).groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.first("content").alias("content"))
    return verify.record(rows, "sha256", F.lit(_NOW).cast("timestamp"))


@query(f"""WITH {t.OBJECTS}, j AS (SELECT digest, '{{"version":1,"digest":"' || digest || '","checksum_algo":"sha256","checksum":"' || digest || '","size":' || size || ',"created_at":"2024-03-01T00:00:00.000000Z"}}' AS json FROM objs)
SELECT digest AS hash, CASE WHEN length(json) <= 243 THEN json END AS json, CASE WHEN length(json) <= 243 THEN 'ok' ELSE 'record_too_large' END AS status FROM j""")
def record_json(spark, d):
    """Records of plain texts within a cap of bytes (SK-20, SC-35)."""
    rows = verify.encode_record(_records(spark, d).withColumns({"type": F.lit(None).cast("string"), "codec": F.lit(None).cast("string")}), 243)
    return rows.select(dg.to_text(F.col("digest")).alias("hash"), "json", "status")


@query(f"WITH {t.OBJECTS} SELECT digest AS hash, CASE WHEN doc_id % 5 = 0 THEN 'sha256' WHEN doc_id % 2 = 0 THEN 'crc32' ELSE 'sha256' END AS algo FROM objs WHERE doc_id % 3 = 0 OR doc_id % 2 = 0 OR doc_id % 5 = 0")
def records_after_put(spark, d):
    """A record of the same algorithm stays, one of another is replaced (SK-19, SK-21)."""
    ids = _bytes(spark, d).groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
    have = ids.filter("doc_id % 3 = 0 or doc_id % 5 = 0").select("digest", F.lit("sha256").alias("algo"), "doc_id")
    fresh = ids.filter("doc_id % 2 = 0 and doc_id % 5 <> 0").select("digest", F.lit("crc32").alias("algo"), "doc_id")
    even = ids.filter("doc_id % 2 = 0 and doc_id % 5 = 0").select("digest", F.lit("sha256").alias("algo"), "doc_id")
    return verify.add_records(have, fresh.unionByName(even)).select(dg.to_text(F.col("digest")).alias("hash"), "algo")


@query(f"WITH {t.OBJECTS} SELECT digest AS hash, 'object' AS kind FROM objs WHERE doc_id % 4 <> 2 UNION ALL SELECT digest, 'record' FROM objs WHERE doc_id % 4 <> 2 AND doc_id % 3 = 0")
def delete_with_records(spark, d):
    """An object and its record go together (SK-22)."""
    ids = _bytes(spark, d).groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
    kept, records = verify.delete_with_records(ids, ids.filter("doc_id % 3 = 0"), ids.filter("doc_id % 4 = 2"))
    out = kept.withColumn("kind", F.lit("object")).unionByName(records.withColumn("kind", F.lit("record")))
    return out.select(dg.to_text(F.col("digest")).alias("hash"), "kind")


@query(f"WITH {t.OBJECTS} SELECT digest AS hash, CASE doc_id % 5 WHEN 0 THEN 'corrupt' WHEN 1 THEN 'corrupt' ELSE 'ok' END AS record_status FROM objs")
def record_validity(spark, d):
    """Required fields, the known version and the digest that the file names (F-16, SC-33..SC-35)."""
    rows = _records(spark, d).join(_bytes(spark, d).groupBy("digest").agg(F.min("doc_id").alias("doc_id")), "digest")
    rows = rows.withColumn("version", F.when(F.col("doc_id") % 5 == 0, F.lit(9)).otherwise(F.col("version"))).withColumn("named", F.when(F.col("doc_id") % 5 != 1, F.col("digest")).otherwise(F.lit(b"x")))
    return verify.record_status(rows, F.col("named")).select(dg.to_text(F.col("digest")).alias("hash"), "record_status")


@query(f"WITH {t.OBJECTS}, s AS (SELECT CASE WHEN doc_id % 6 = 1 THEN 'corrupt' ELSE 'verified' END AS state FROM objs) SELECT state, count(*) AS objects, (SELECT CAST(bool_or(state = 'corrupt') AS INTEGER) FROM s) AS exit FROM s GROUP BY state")
def audit_counts(spark, d):
    """Counts by state and the exit status (A-08, A-11, M-06)."""
    rows = _bytes(spark, d).groupBy("digest").agg(F.min("doc_id").alias("i"), F.first("content").alias("content"))
    rows = rows.withColumn("content", F.when(F.col("i") % 6 == 1, F.concat("content", F.lit(b"?"))).otherwise(F.col("content")))
    states = verify.verify(rows)
    return verify.counts(states).withColumn("exit", F.lit(verify.exit_status(states)))


@query(f"WITH {t.OBJECTS} SELECT digest AS hash FROM objs WHERE doc_id % 6 = 1")
def corrupt_lines(spark, d):
    """M-18."""
    rows = _bytes(spark, d).groupBy("digest").agg(F.min("doc_id").alias("i"), F.first("content").alias("content"))
    return verify.bad(verify.verify(rows.withColumn("content", F.when(F.col("i") % 6 == 1, F.concat("content", F.lit(b"?"))).otherwise(F.col("content")))))


@query(f"WITH {t.REFLOG}, l AS (SELECT name, arg_max(struct_pack(v := new), seq).v AS old, max(seq) AS seq FROM reflog GROUP BY name), u AS (SELECT 'user/' || c_custkey AS name, sha256(c_name) AS new FROM customer) SELECT name, coalesce(l.seq, -1) + 1 AS seq, u.new, l.old FROM u LEFT JOIN l USING (name)")
def refs_set(spark, d):
    """Entries that a set appends, logged with the value before (SK-16, SK-18, G-21)."""
    updates = t.table(spark, d, "customer").select(F.concat(F.lit("user/"), F.col("c_custkey").cast("string")).alias("name"), F.unhex(F.sha2("c_name", 256)).alias("digest"))
    return _hex(refs.set_refs(t.reflog(spark, d), updates, F.lit(0)).select("name", "seq", "new", "old"), "new", "old")


@query(f"WITH {t.REFLOG} SELECT seq, new, old FROM reflog WHERE name = 'user/7' ORDER BY seq DESC LIMIT 5")
def reflog_newest_first(spark, d):
    """S-07."""
    return _hex(refs.log(t.reflog(spark, d), "user/7", 5).select("seq", "new", "old"), "new", "old")


@query("SELECT user_id AS session, event_type AS digest, arg_max(CAST(floor(value) AS BIGINT), event_id) AS state, max(event_id) AS step FROM events GROUP BY 1, 2")
def verification_latest(spark, d):
    """The newest result of a session and digest (W-07, G-23)."""
    rows = t.table(spark, d, "events").select(F.col("user_id").alias("session"), F.col("event_type").alias("digest"), F.floor("value").alias("state"), F.col("event_id").alias("step"))
    return caches.latest_verification(rows)


@query("""WITH r AS (SELECT user_id, event_id, event_type, sum(CASE WHEN p = event_type THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id) AS run, coalesce(p = event_type, false) AS again
  FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events)),
f AS (SELECT user_id, event_type = lag(event_type, 2) OVER (PARTITION BY user_id ORDER BY run) AS back FROM r WHERE NOT again)
SELECT h AS hits, n - h AS misses FROM (SELECT (SELECT count(*) FROM r WHERE again) + (SELECT count(*) FROM f WHERE back) AS h, (SELECT count(*) FROM r) AS n)""")
def lru_of_two(spark, d):
    """A cache of two holds the last two distinct digests (C-04, C-11, A-12)."""
    rows = t.table(spark, d, "events").select(F.col("user_id").alias("session"), F.col("event_id").alias("step"), F.col("event_type").alias("digest"))
    return caches.cache_stats(caches.lru_hits(rows, 2)).select("hits", "misses")


@query(f"WITH {t.OBJECTS} SELECT digest AS hash, size FROM objs WHERE doc_id % 3 = 0")
def preload_objects(spark, d):
    """Bulk load that fails on what is missing, and a snapshot that is made once (C-01..C-03, C-07, C-10)."""
    rows = _bytes(spark, d).groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.min("size").alias("size"))
    kept = caches.Snapshot(lambda: caches.preload(rows, rows.filter("doc_id % 3 = 0"), False), 3600)
    return kept.get().select(dg.to_text(F.col("digest")).alias("hash"), "size")


@query("SELECT c_name AS name, CAST(CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 0 END AS BIGINT) AS replaced, CASE WHEN c_custkey % 3 = 0 THEN sha256('new' || c_name) ELSE sha256(c_name) END AS digest FROM customer")
def manifests_replaced(spark, d):
    """A set of new manifests, and the old ones that nothing names any more (M-15)."""
    rows = t.table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.unhex(F.sha2("c_name", 256)).alias("digest"))
    new = rows.filter("k % 3 = 0").select("name", F.unhex(F.sha2(F.concat(F.lit("new"), "name"), 256)).alias("digest"))
    kept, doomed = retention.replace_manifest(rows.select("name", "digest"), new)
    gone = doomed.withColumn("replaced", F.lit(1).cast("long")).join(rows.select("digest", "name"), "digest").select("name", "replaced")
    return _hex(kept.join(gone, "name", "left").select("name", F.coalesce("replaced", F.lit(0).cast("long")).alias("replaced"), "digest"), "digest")


# --- histories: a blob a customer, a tree and a commit a nation, a tag a region ---------------------------------------------------------------

_HISTORY = """objs AS (
  SELECT sha256('blob' || c_custkey) AS digest, 'blob@1' AS type, CAST([] AS VARCHAR[]) AS refs, 'blob (' || length(c_name) || ' bytes)' AS line FROM customer
  UNION ALL SELECT sha256('tree' || n_nationkey), 'tree@1', coalesce(r, CAST([] AS VARCHAR[])), 'tree (' || len(coalesce(r, CAST([] AS VARCHAR[]))) || ' entries)'
    FROM nation LEFT JOIN (SELECT c_nationkey AS n_nationkey, list(sha256('blob' || c_custkey) ORDER BY c_custkey) AS r FROM customer GROUP BY 1) USING (n_nationkey)
  UNION ALL SELECT sha256('commit' || n_nationkey), 'commit@1', CASE WHEN n_nationkey > 0 THEN [sha256('tree' || n_nationkey), sha256('commit' || (n_nationkey - 1))] ELSE [sha256('tree' || n_nationkey)] END,
    'commit by ' || n_name || ': m' || n_nationkey FROM nation
  UNION ALL SELECT sha256('tag' || r_regionkey), 'tag@1', [sha256('commit' || (r_regionkey * 2))], 'tag "' || r_name || '" -> ' || substr(sha256('commit' || (r_regionkey * 2)), 1, 8) FROM region
), links AS (SELECT digest AS src, unnest(refs) AS dst, generate_subscripts(refs, 1) AS ord FROM objs),
reached(digest) AS (SELECT digest FROM objs WHERE type = 'tag@1' UNION SELECT l.dst FROM reached r JOIN links l ON l.src = r.digest)"""


def _history(spark, d) -> DataFrame:
    """digest and frame of each object of the history."""

    def name(kind: str, key) -> F.Column:
        return F.sha2(F.concat(F.lit(kind), key.cast("string")), 256)

    def rows(df: DataFrame, kind: str, key: str, value) -> DataFrame:
        frame = envelope.encode(F.lit("json"), F.lit(f"{kind}@1"), F.to_json(value).cast("binary"))
        return df.select(F.unhex(name(kind, F.col(key))).alias("digest"), frame.alias("content"))

    customers, nations = t.table(spark, d, "customer"), t.table(spark, d, "nation")
    blobs = rows(customers, "blob", "c_custkey", F.struct(F.base64(F.col("c_name").cast("binary")).alias("data")))
    entry = F.struct("c_custkey", F.struct(F.col("c_name").alias("name"), name("blob", F.col("c_custkey")).alias("hash"), F.lit("100644").alias("mode")).alias("e"))
    entries = customers.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["e"]).alias("entries"))
    trees = rows(nations.join(entries, "n_nationkey", "left"), "tree", "n_nationkey", F.struct(F.coalesce("entries", F.array().cast("array<struct<name:string,hash:string,mode:string>>")).alias("entries")))
    parent = F.when(F.col("n_nationkey") > 0, name("commit", F.col("n_nationkey") - 1))
    message = F.concat(F.lit("m"), F.col("n_nationkey").cast("string"))
    commits = rows(nations, "commit", "n_nationkey", F.struct(name("tree", F.col("n_nationkey")).alias("tree"), parent.alias("parent"), F.col("n_name").alias("author"), message.alias("message")))
    tags = rows(t.table(spark, d, "region"), "tag", "r_regionkey", F.struct(F.col("r_name").alias("name"), name("commit", F.col("r_regionkey") * 2).alias("target")))
    return blobs.unionByName(trees).unionByName(commits).unionByName(tags)


def _resolved(spark, d) -> DataFrame:
    return cut(Store(_history(spark, d)).resolved().select("digest", "type", "status", "refs"), "history-objects")


def _tags(nodes: DataFrame) -> DataFrame:
    return nodes.filter("type = 'tag@1'").select("digest")


@query(f"WITH RECURSIVE {_HISTORY} SELECT digest AS hash, type, 'ok' AS status, array_to_string(refs, ',') AS refs FROM objs")
def history_resolved(spark, d):
    """Types dispatched by the header, with references in their order (J-10..J-12, P-07, P-08, P-10, X-66, D9, E-04, E-05, E-08, E-09)."""
    rows = Store(_history(spark, d)).resolved()
    return rows.select(dg.to_text(F.col("digest")).alias("hash"), "type", "status", F.array_join(F.transform("refs", lambda x: F.lower(F.hex(x))), ",").alias("refs"))


@query(f"WITH RECURSIVE {_HISTORY} SELECT digest AS hash, line FROM objs")
def history_described(spark, d):
    """X-13."""
    return models.describe(Store(_history(spark, d)).resolved()).select(dg.to_text(F.col("digest")).alias("hash"), "line")


@query(f"WITH RECURSIVE {_HISTORY} SELECT src, dst, CAST(ord - 1 AS INTEGER) AS ord FROM links")
def history_edges(spark, d):
    """J-09, D6."""
    return _hex(graph.edges_of(_resolved(spark, d)), "src", "dst")


@query(f"WITH RECURSIVE {_HISTORY} SELECT digest AS hash, 'ok' AS status FROM reached")
def history_walk(spark, d):
    """A walk across types that would abort at what is missing or corrupt (R-02..R-07, E-06, G-22)."""
    nodes = _resolved(spark, d)
    return graph.walk(nodes, graph.edges_of(nodes), _tags(nodes), "abort").select(dg.to_text(F.col("digest")).alias("hash"), "status")


@query(f"""WITH RECURSIVE {_HISTORY}, lost AS (SELECT digest FROM objs WHERE type = 'tree@1'), usable AS (SELECT * FROM links WHERE src NOT IN (SELECT digest FROM lost)),
found(digest) AS (SELECT digest FROM objs WHERE type = 'tag@1' UNION SELECT l.dst FROM found r JOIN usable l ON l.src = r.digest) SELECT digest AS hash FROM found""")
def history_walk_lenient(spark, d):
    """Objects that can't be read are leaves, and dangling digests stay in the set (R-11)."""
    nodes = _resolved(spark, d)
    broken = nodes.withColumn("status", F.when(F.col("type") == "tree@1", F.lit("corrupt")).otherwise(F.col("status")))
    return graph.lenient(broken, graph.edges_of(nodes), _tags(nodes)).select(dg.to_text(F.col("digest")).alias("hash"))


@query(f"""WITH RECURSIVE {_HISTORY}, p(digest, path) AS (SELECT sha256('commit' || max(n_nationkey)), CAST([] AS BIGINT[]) FROM nation
  UNION ALL SELECT l.dst, list_append(p.path, l.ord) FROM p JOIN links l ON l.src = p.digest) SELECT digest AS hash, row_number() OVER (ORDER BY path) - 1 AS ord FROM p""")
def history_walk_ordered(spark, d):
    """Depth-first pre-order from the newest commit (R-01, E-07)."""
    nodes = _resolved(spark, d)
    last = t.table(spark, d, "nation").agg(F.max("n_nationkey")).first()[0]
    head = bytes(spark.range(1).select(F.unhex(F.sha2(F.lit(f"commit{last}"), 256))).first()[0])
    order = graph.walk_ordered(graph.edges_of(nodes), [head])
    return spark.createDataFrame([(x.hex(), i) for i, x in enumerate(order)], "hash string, ord long")


@query(f"""WITH RECURSIVE {_HISTORY}, p(digest, depth) AS (SELECT sha256('commit' || max(n_nationkey)), 0 FROM nation
  UNION SELECT l.dst, p.depth + 1 FROM p JOIN links l ON l.src = p.digest WHERE p.depth < 3) SELECT DISTINCT digest AS hash FROM p""")
def history_preload(spark, d):
    """Bounded depth-first loading with one set of visited objects (G-15, R-08, R-09)."""
    nodes = _resolved(spark, d)
    last = t.table(spark, d, "nation").agg(F.max("n_nationkey")).first()[0]
    head = bytes(spark.range(1).select(F.unhex(F.sha2(F.lit(f"commit{last}"), 256))).first()[0])
    return spark.createDataFrame([(x.hex(),) for x in graph.preload(graph.edges_of(nodes), [head], 3)], "hash string")


@query(f"WITH RECURSIVE {_HISTORY} SELECT digest AS hash FROM objs WHERE digest NOT IN (SELECT digest FROM reached)")
def history_doomed(spark, d):
    """Marked from the refs through what can be read, then planned (R-12, U-05)."""
    nodes = _resolved(spark, d).withColumn("size", F.lit(1).cast("long"))
    return retention.artifact_gc(nodes, graph.edges_of(nodes), _tags(nodes)).select(dg.to_text(F.col("digest")).alias("hash"))


_PARTS = "list_filter([sha256('t' || event_id), CASE WHEN event_id % 3 > 0 THEN sha256('a' || user_id) END, sha256('r' || event_type)], lambda x: x IS NOT NULL)"


@query(f"SELECT event_id, array_to_string({_PARTS}, ',') AS refs, CASE WHEN event_id % 3 > 0 THEN sha256('a' || user_id) ELSE '' END AS manifest FROM events")
def note_references(spark, d):
    """Tags, attachments and related notes in this order, and a manifest's artifacts (P-11, P-12)."""
    one = lambda c: F.array(F.sha2(c, 256))
    text = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    some = F.when(F.col("event_id") % 3 > 0, one(text("a", "user_id")))
    rows = t.table(spark, d, "events").select("event_id", F.struct(one(text("t", "event_id")).alias("tags"), some.alias("attachments"), one(text("r", "event_type")).alias("related")).alias("v"), F.struct(some.alias("artifacts")).alias("m"))
    plain = lambda refs_: F.array_join(F.transform(refs_, lambda x: F.lower(F.hex(x))), ",")
    return rows.select("event_id", plain(models.note_references(F.col("v"))).alias("refs"), plain(models.manifest_references(F.col("m"))).alias("manifest"))


# --- Bloom hashes and streams ------------------------------------------------------------------------------------------------------------------


@query("""SELECT c_custkey, CAST((list_reduce(list_prepend(0::HUGEINT, list_transform(range(1, length(c_name) + 1), lambda i: ascii(c_name[i])::HUGEINT)), lambda a, x: (a * 131 + x) % 18446744073709551616::HUGEINT)
  + 3 * list_reduce(list_prepend(0::HUGEINT, list_transform(range(1, length(c_name) + 1), lambda i: ascii(c_name[i])::HUGEINT)), lambda a, x: (a * 137 + x + 1) % 18446744073709551616::HUGEINT)) % 18446744073709551616::HUGEINT AS VARCHAR) AS hash FROM customer""")
def bloom_polynomial_hash(spark, d):
    """B-09."""
    return t.table(spark, d, "customer").select("c_custkey", bloom.polynomial_hash(F.col("c_name").cast("binary"), F.lit(3)).cast("string").alias("hash"))


@query("SELECT c_custkey, true AS maybe FROM customer WHERE c_custkey % 2 = 0")
def bloom_keyed(spark, d):
    """A filter with a key of its own, saved and loaded; another key makes it unusable (B-05..B-07, E-10)."""
    rows = t.table(spark, d, "customer").select("c_custkey", F.unhex(F.sha2("c_name", 256)).alias("digest")).filter("c_custkey % 2 = 0")
    hashed, (m, k) = bloom.keyed_hash(b"key"), bloom.parameters(max(1, rows.count()), 0.01)
    path = f"{folder(spark)}/shardwell/bloom-{uuid.uuid4().hex}"
    bloom.save(bloom.build(rows, m, k, hashed), path, m, k, "key")
    if bloom.load(spark, path, m, k, "other") is not None:
        raise AssertionError("a filter of another key was loaded")
    return bloom.probe(rows, bloom.load(spark, path, m, k, "key"), m, k, hashed).select("c_custkey", "maybe")
