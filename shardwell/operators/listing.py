"""Metadata of objects: listing, filters, browsing, pages and census
(SC-02, SC-06, F-05..F-09, P-01..P-06, A-01..A-06, A-09, S-01..S-12, U-07, W-03, G-02..G-11)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shardwell.functions import digest as dg
from shardwell.functions import envelope, formats

SORTS = ("hash", "type", "version", "codec", "size", "inbound", "status", "reach", "written")
PAGE_SIZES = (25, 50, 100, 250)


def metadata(objects: DataFrame) -> DataFrame:
    """A row per object from its size, time and header: digest, type, version, codec, size, written, unreadable, header_status (A-04, P-06)."""
    rows = objects.withColumn("_h", envelope.labels(F.col("content")))
    return rows.select(
        "digest",
        F.col("_h.type").alias("type"),
        F.col("_h.version").alias("version"),
        F.col("_h.codec").alias("codec"),
        F.coalesce(F.col("size"), F.octet_length("content").cast("long")).alias("size"),
        F.col("mtime").alias("written") if "mtime" in objects.columns else F.lit(None).cast("timestamp").alias("written"),
        F.col("content").isNull().alias("unreadable"),
        F.col("_h.header_status").alias("header_status"),
    )


def stats(rows: DataFrame, size: str = "size") -> DataFrame:
    """Objects and bytes (A-01, A-02)."""
    return rows.agg(F.count("*").alias("objects"), F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("bytes"))


def packed_stats(loose: DataFrame, index: DataFrame) -> DataFrame:
    """Loose objects and index-only entries that have bytes; zero-length index-only entries are listed but not counted (A-03, G-16)."""
    only = index.join(loose.select("digest"), "digest", "left_anti").filter("size > 0")
    return stats(loose.select("size").unionByName(only.select("size")))


def census(meta: DataFrame) -> DataFrame:
    """(axis, value, objects): counts by type, version and codec of framed objects, and of headerless and unreadable ones.

    One pass: grouping sets share a partial aggregate.  Unreadable is told first, then headerless, so each axis sums to the total (A-05, G-04).
    """
    kind = F.when(F.col("unreadable"), F.lit("unreadable")).when(F.col("header_status") == "headerless", F.lit("headerless")).otherwise(F.lit("framed"))
    rows = meta.select("type", F.col("version").cast("string").alias("version"), "codec", kind.alias("kind"))
    sets = rows.groupingSets([["kind", "type"], ["kind", "version"], ["kind", "codec"], ["kind"]], "kind", "type", "version", "codec")
    told = sets.agg(F.count("*").alias("objects"), F.grouping_id().alias("g"))  # bits: type 4, version 2, codec 1, set where left out
    axis = F.when(F.col("g") == 3, F.lit("type")).when(F.col("g") == 5, F.lit("version")).when(F.col("g") == 6, F.lit("codec")).otherwise(F.lit("kind"))
    value = F.when(F.col("g") == 3, F.col("type")).when(F.col("g") == 5, F.col("version")).when(F.col("g") == 6, F.col("codec")).otherwise(F.col("kind"))
    return told.filter((F.col("g") == 7) != (F.col("kind") == "framed")).select(axis.alias("axis"), value.alias("value"), "objects")


def census_text(counts: DataFrame) -> DataFrame:
    """A line an axis: sorted ``value=count`` pairs, control characters as ``?`` (A-06)."""
    pair = F.struct(F.col("value").alias("k"), F.concat(formats.safe_field(F.col("value")), F.lit("="), F.col("objects").cast("string")).alias("t"))
    return counts.groupBy("axis").agg(F.array_join(F.transform(F.array_sort(F.collect_list(pair)), lambda x: x["t"]), ", ").alias("line"))


def snapshot(meta: DataFrame) -> DataFrame:
    """total, bytes and the sorted distinct types, versions and codecs of objects with a header (A-04, U-07, G-03)."""
    framed = F.col("header_status") == "framed"

    def distinct(c: str) -> Column:
        return F.array_sort(F.collect_set(F.when(framed, F.col(c))))

    return meta.agg(F.count("*").alias("total"), F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("bytes"), distinct("type").alias("types"), distinct("version").alias("versions"), distinct("codec").alias("codecs"))


def paginate(rows: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    """A page of a total order; a negative offset is 0, a limit of 0 or less gives nothing (S-01, W-03).  Spark keeps the first rows only."""
    if limit <= 0:
        return rows.filter("false")
    return rows.orderBy(*order).offset(max(0, offset)).limit(limit)


def list_page(meta: DataFrame, type_name: str = "", codec: str = "", offset: int = 0, limit: int = 100) -> DataFrame:
    """Filtered listing in digest order: digest text, size, type, version, codec (S-02, F-06, P-01, G-05, G-08)."""
    if not 1 <= limit <= 1000 or offset < 0:
        raise ValueError("limit must be 1 to 1000 and offset 0 or more")
    return paginate(filtered(meta, type_name, codec), [F.col("digest")], offset, limit).select(
        dg.to_text(F.col("digest")).alias("hash"), "size", "type", "version", envelope.codec_label(F.col("codec")).alias("codec")
    )


def filtered(meta: DataFrame, type_name: str = "", codec: str = "") -> DataFrame:
    """Readable rows of a type (no major version means the first) and codec; headerless rows match ``unspecified`` (F-05, F-06)."""
    rows = meta.filter(~F.col("unreadable"))
    if type_name:
        rows = rows.filter(F.col("type") == formats.versioned_type(type_name))
    if codec:
        rows = rows.filter(envelope.codec_label(F.col("codec")) == codec)
    return rows


def filter_counts(meta: DataFrame, type_name: str = "", codec: str = "") -> DataFrame:
    """matches and skipped (unreadable) of a filtered listing (G-05)."""
    hit = F.lit(True)
    if type_name:
        hit = hit & (F.col("type") == formats.versioned_type(type_name))
    if codec:
        hit = hit & (envelope.codec_label(F.col("codec")) == codec)
    return meta.agg(F.count_if(~F.col("unreadable") & hit).alias("matches"), F.count_if("unreadable").alias("skipped"))


@dataclass(frozen=True)
class Browse:
    """What a browser shows: filters, order and page (F-07, F-18, S-03, S-10)."""

    query: str = ""
    type: str = ""
    version: str = ""
    codec: str = ""
    status: str = ""
    reach: str = ""
    size: str = ""
    sort: str = "hash"
    descending: bool = False
    offset: int = 0
    limit: int = 50

    def __post_init__(self) -> None:
        for name, value, known in (("sort", self.sort, SORTS), ("size", self.size, ("", "small", "medium", "large")), ("reach", self.reach, ("", "reachable", "orphaned", "detached", "root")), ("status", self.status, ("", "verified", "corrupt", "not-verified"))):
            if value not in known:
                raise ValueError(f"{name} is {value!r}, not one of {', '.join(filter(None, known))}")
        object.__setattr__(self, "query", self.query.strip().lower())
        object.__setattr__(self, "limit", min(250, max(1, self.limit)))
        object.__setattr__(self, "offset", max(0, self.offset))


def enrich(meta: DataFrame, edges: DataFrame | None = None, reachable: DataFrame | None = None, verified: DataFrame | None = None) -> DataFrame:
    """Rows as a browser shows them: inbound references, integrity and reach classes (J-07, A-10, R-13, P-03)."""
    rows = meta
    if edges is not None:
        rows = rows.join(edges.filter("dst is not null").groupBy(F.col("dst").alias("digest")).agg(F.count("*").alias("inbound")), "digest", "left")
        rows = rows.withColumn("inbound", F.coalesce("inbound", F.lit(0).cast("long")))
    else:
        rows = rows.withColumn("inbound", F.lit(0).cast("long"))
    if verified is not None:
        rows = rows.join(verified.select("digest", F.col("state").alias("integrity")), "digest", "left")
    else:
        rows = rows.withColumn("integrity", F.lit(None).cast("string"))
    rows = rows.withColumn("integrity", F.coalesce("integrity", F.lit("not-verified")))
    if reachable is not None:
        there = reachable.select("digest").distinct().withColumn("_reached", F.lit(True))
        rows = rows.join(there, "digest", "left").withColumn("orphaned", F.col("_reached").isNull()).drop("_reached")
        rows = rows.withColumn("detached", F.col("orphaned") & (F.col("inbound") == 0)).withColumn("root", ~F.col("orphaned") & (F.col("inbound") == 0))
    return rows


def matches(state: Browse, columns: list[str]) -> Column:
    """Conjunction of a browser's filters (F-07, F-08, G-09, G-11)."""
    if state.reach and "orphaned" not in columns:
        raise ValueError("a reach filter needs a reachable set")
    ok = F.lit(True)
    if state.query:
        ok = ok & (F.contains(dg.to_text(F.col("digest")), F.lit(state.query)) | F.contains(F.lower("type"), F.lit(state.query)))
    if state.type:
        ok = ok & (F.col("type") == state.type)
    if state.version:
        ok = ok & (F.col("version").cast("string") == state.version)
    if state.codec:  # a dash for bytes without a header, which "unspecified" doesn't match
        ok = ok & (envelope.codec_cell(F.col("version"), F.col("codec")) == state.codec)
    if state.status:
        ok = ok & (F.col("integrity") == state.status)
    if state.reach:
        ok = ok & (~F.col("orphaned") if state.reach == "reachable" else F.col(state.reach))
    if state.size:
        ok = ok & (formats.size_band(F.col("size")) == state.size)
    return ok


def order_of(state: Browse) -> list[Column]:
    """Sort key and digest, both in the same direction (S-03..S-05, G-10)."""
    rank = F.when(F.col("integrity") == "verified", 0).when(F.col("integrity") == "corrupt", 2).otherwise(1)
    key = {"hash": F.col("digest"), "status": rank, "reach": F.col("orphaned") if state.sort == "reach" else None}.get(state.sort, F.col(state.sort))
    keys = [key] if state.sort == "hash" else [key, F.col("digest")]
    return [k.desc() if state.descending else k.asc() for k in keys]


def browse(rows: DataFrame, state: Browse) -> DataFrame:
    """The page, with labels made for its rows only (P-04, S-03)."""
    page = paginate(rows.filter(matches(state, rows.columns)), order_of(state), state.offset, state.limit)
    return page.withColumns({"hash": dg.to_text(F.col("digest")), "short": dg.short(F.col("digest")), "type_label": F.when(F.col("unreadable"), F.lit("unreadable")).otherwise(F.col("type")), "integrity_label": formats.integrity_label(F.col("integrity"))})


def browse_totals(rows: DataFrame, state: Browse) -> DataFrame:
    """matched and total, rows and bytes (A-09)."""
    hit = matches(state, rows.columns)
    return rows.agg(F.count_if(hit).alias("matched"), F.coalesce(F.sum(F.when(hit, F.col("size"))), F.lit(0)).cast("long").alias("matched_bytes"), F.count("*").alias("total"))


def page_of(rows: DataFrame, state: Browse, selected: Column) -> DataFrame:
    """Offset of the page that holds a digest: the rows before it are counted, nothing is ranked as a whole (S-06)."""
    hit = rows.filter(matches(state, rows.columns))
    key = _sort_key(state)
    one = hit.filter(F.col("digest") == selected).select(key.alias("_k"), F.col("digest").alias("_d")).limit(1)
    mine = F.struct(key.alias("k"), F.col("digest").alias("d"))
    other = F.struct(F.col("_k").alias("k"), F.col("_d").alias("d"))
    before = hit.join(F.broadcast(one), (mine > other) if state.descending else (mine < other), "inner")  # one row
    return before.agg(F.count("*").alias("before")).select((F.floor(F.col("before") / state.limit) * state.limit).cast("long").alias("offset"))


def _sort_key(state: Browse) -> Column:
    if state.sort == "status":
        return F.when(F.col("integrity") == "verified", 0).when(F.col("integrity") == "corrupt", 2).otherwise(1)
    return F.col({"hash": "digest", "reach": "orphaned"}.get(state.sort, state.sort))


def page_links(matched: int, offset: int, limit: int) -> dict[str, int | None]:
    """Offsets of the first, previous, next and last page (S-11)."""
    last = max(0, (matched - 1) // limit * limit)
    return {"first": 0, "previous": max(0, offset - limit) if offset > 0 else None, "next": offset + limit if offset + limit < matched else None, "last": last}


def sort_columns(state: Browse, reach: bool) -> list[dict]:
    """Columns that can be sorted by, with the direction a click gives; reach only where a graph is known (S-12)."""
    return [{"key": k, "active": k == state.sort, "descending": k == state.sort and not state.descending} for k in SORTS if reach or k != "reach"]


def unknown_filters(meta: DataFrame, state: Browse) -> list[str]:
    """Filters whose value no object has (F-09)."""
    found = snapshot(meta).first()
    have = {"type": found["types"], "version": [str(v) for v in found["versions"]], "codec": [*found["codecs"], "—"]}
    return [k for k, values in have.items() if getattr(state, k) and getattr(state, k) not in values]


def inspect(rows: DataFrame, edges: DataFrame, selected: Column) -> DataFrame:
    """The selected row with its inbound and outbound digests, in order (P-05, J-08, R-14)."""
    row = rows.filter(F.col("digest") == selected)
    out = edges.filter((F.col("src") == selected) & F.col("dst").isNotNull()).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "dst"))), lambda x: dg.to_text(x["dst"])).alias("outbound"))
    into = edges.filter(F.col("dst") == selected).agg(F.array_sort(F.collect_list(dg.to_text(F.col("src")))).alias("inbound_from"))
    return row.crossJoin(F.broadcast(out)).crossJoin(F.broadcast(into))  # one row each


def trail_neighbours(trail: DataFrame) -> DataFrame:
    """Previous and next digest of each step of a session (W-04)."""
    steps = Window.partitionBy("session").orderBy("step")
    return trail.withColumns({"prev": F.lag("digest").over(steps), "next": F.lead("digest").over(steps)})
