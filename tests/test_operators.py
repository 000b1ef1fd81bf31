"""Laws and fixtures of the store operators."""

import hashlib
import io

import pytest
from pyspark.sql import functions as F

from shardwell.functions import digest as dg
from shardwell.operators import bloom, caches, chunks, graph, listing, lookup, models, objects, refs, retention, verify
from shardwell.sources import files, snapshots


def digests(df, column="digest"):
    return sorted(bytes(r[0]) for r in df.select(column).collect())


@pytest.fixture(scope="module")
def preview(spark):
    rows = models.preview_graph(16, scale=1000)
    df = spark.createDataFrame([(r["digest"], bytes(r["content"]), r["size"], r["refs"], r["ordinal"]) for r in rows], "digest binary, content binary, size long, refs array<binary>, ordinal int").cache()
    return rows, df


def test_preview_sizes_are_the_fixture_s():
    rows = models.preview_graph(8)
    assert sum(len(r["refs"]) for r in rows) == 12 and sum(r["size"] for r in rows) == 1675780
    assert rows[0]["digest"].hex() == "909796aa4788031b3197d97197b56be65961f290356c4f3bc9db3406f30444b9"


def test_preview_counts(spark, preview):
    rows, df = preview
    edges = graph.edges_of(df)
    roots = spark.createDataFrame([(r["digest"],) for r in rows if r["is_root"]], "digest binary")
    c = graph.classes(df, edges, graph.reachable(edges, roots)).agg(F.count_if("orphaned").alias("o"), F.count_if("detached").alias("d"), F.count_if("root").alias("r")).first()
    assert (c.o, c.d, c.r) == (8, 2, 2)
    t = verify.tally(verify.verify(df)).first()
    assert (t.checked, t.corrupt) == (16, 2)


def test_census_sums_to_the_total(spark, preview):
    _, df = preview
    plain = spark.createDataFrame([(hashlib.sha256(b"not an envelope").digest(), b"not an envelope", 15)], "digest binary, content binary, size long")
    meta = listing.metadata(df.select("digest", "content", "size").unionByName(plain))
    rows = {(r.axis, r.value): r.objects for r in listing.census(meta).collect()}
    assert rows[("kind", "headerless")] == 1
    for axis in ("type", "version", "codec"):
        assert sum(n for (a, _), n in rows.items() if a == axis) + 1 == 17
    assert listing.filter_counts(meta, codec="unspecified").first().matches == 1
    assert listing.filtered(meta, "blob").count() == listing.filtered(meta, "blob@1").count() == 4
    s = listing.snapshot(meta).first()
    assert s.total == 17 and s.versions == [2] and s.codecs == ["json"]
    assert "codec" in {r.axis for r in listing.census_text(listing.census(meta)).collect()}


@pytest.mark.parametrize(("offset", "limit", "want"), [(0, 100, [0, 1, 2, 3, 4, 5]), (0, 2, [0, 1]), (2, 2, [2, 3]), (10, 2, []), (-1, 2, [0, 1]), (4, 100, [4, 5]), (0, 0, []), (0, -1, [])])
def test_paginate(spark, offset, limit, want):
    assert [r.id for r in listing.paginate(spark.range(6), [F.col("id")], offset, limit).collect()] == want


def test_browse_state():
    with pytest.raises(ValueError, match="sort"):
        listing.Browse(sort="colour")
    assert listing.Browse(limit=1000, offset=-3, query=" AB ") == listing.Browse(limit=250, offset=0, query="ab")
    assert listing.page_links(101, 50, 50) == {"first": 0, "previous": 0, "next": 100, "last": 100}
    assert [c["key"] for c in listing.sort_columns(listing.Browse(), False)].count("reach") == 0


def test_reach_filter_needs_a_graph(spark):
    with pytest.raises(ValueError, match="reach"):
        listing.matches(listing.Browse(reach="root"), ["digest"])


def test_browse_flags_and_codec_cells(spark, preview):
    rows, df = preview
    edges = graph.edges_of(df)
    roots = spark.createDataFrame([(r["digest"],) for r in rows if r["is_root"]], "digest binary")
    full = listing.enrich(listing.metadata(df), edges, graph.reachable(edges, roots), verify.verify(df)).cache()
    assert full.filter(listing.matches(listing.Browse(reach="detached"), full.columns)).count() == 2
    assert full.filter(listing.matches(listing.Browse(status="corrupt"), full.columns)).count() == 2
    assert full.filter(listing.matches(listing.Browse(codec="unspecified"), full.columns)).count() == 0
    got = listing.browse(full, listing.Browse(sort="status", descending=True, limit=3)).collect()
    assert [r.integrity_label for r in got] == ["Corrupt", "Corrupt", "Verified"]
    assert listing.unknown_filters(listing.metadata(df), listing.Browse(type="nope@1")) == ["type"]
    one = listing.inspect(full, edges, F.lit(rows[3]["digest"])).first()
    assert len(one.outbound) == 3 and one.inbound_from == []


EDGES = [("a", "b", 0), ("b", "c", 0), ("b", "d", 1), ("c", "d", 0), ("d", None, 0), ("x", "y", 0), ("y", "x", 0)]


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(EDGES, "src string, dst string, ord int")


def roots(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "digest string")


def test_walks(spark, edges):
    assert sorted(r.digest for r in graph.reachable(edges, roots(spark, "a", None)).collect()) == ["a", "b", "c", "d"]
    assert sorted(r.digest for r in graph.reachable(edges, roots(spark, "x")).collect()) == ["x", "y"]
    assert sorted(r.digest for r in graph.reachable(edges, roots(spark, "a"), 1).collect()) == ["a", "b"]
    assert graph.reachable(edges, roots(spark)).count() == 0
    assert graph.walk_ordered(edges, ["a", "x"]) == ["a", "b", "c", "d", "x", "y"]


def test_twelve_diamonds_are_thirteen_visits(spark):
    e = spark.createDataFrame([(f"t{i}", f"t{i - 1}", k) for i in range(1, 13) for k in (0, 1)], "src string, dst string, ord int")
    assert graph.reachable(e, roots(spark, "t12")).count() == 13


def test_bounded_walk_shares_what_it_has_seen(spark):
    # c is met first with no depth left, so d is not reached by the shorter path
    e = spark.createDataFrame([("r", "a", 0), ("r", "c", 1), ("a", "c", 0), ("c", "d", 0)], "src string, dst string, ord int")
    assert graph.preload(e, ["r"], 2) == ["a", "c", "r"]
    assert sorted(x.digest for x in graph.reachable(e, roots(spark, "r"), 2).collect()) == ["a", "c", "d", "r"]


def test_strict_and_lenient_walks(spark, edges):
    nodes = lambda **s: spark.createDataFrame([(n, s.get(n, "ok")) for n in "abcd" if s.get(n) != "gone"], "digest string, status string")
    assert graph.walk(nodes(), edges, roots(spark, "a")).count() == 4
    assert sorted(r.digest for r in graph.walk(nodes(b="unknown_type"), edges, roots(spark, "a")).collect()) == ["a", "b"]
    with pytest.raises(graph.WalkAborted, match="unknown_type: b"):
        graph.walk(nodes(b="unknown_type"), edges, roots(spark, "a"), unknown="abort")
    with pytest.raises(graph.WalkAborted, match="not_found: d"):
        graph.walk(nodes(d="gone"), edges, roots(spark, "a"))
    assert sorted(r.digest for r in graph.lenient(nodes(d="gone"), edges, roots(spark, "a")).collect()) == ["a", "b", "c", "d"]


def test_history_by_doubling(spark):
    parents = spark.createDataFrame([(f"c{i}", f"c{i - 1}" if i else None) for i in range(37)], "digest string, parent string")
    got = {r.digest: r.depth for r in graph.history(parents, roots(spark, "c36")).collect()}
    assert got == {f"c{36 - i}": i for i in range(37)}


def test_sweep_keeps_the_young(spark):
    now = F.lit("2024-01-01 12:00:00").cast("timestamp")
    df = spark.createDataFrame([(b"old", 1, "2024-01-01 10:00:00"), (b"new", 1, "2024-01-01 12:00:00"), (b"dark", 1, None)], "digest binary, size long, t string").withColumn("mtime", F.col("t").cast("timestamp"))
    none = spark.createDataFrame([], "digest binary")
    assert digests(retention.sweep(df, none, now, 3600, "keep")) == [b"old"]
    assert len(digests(retention.sweep(df, none))) == 3
    with pytest.raises(Exception, match="no time"):
        retention.sweep(df, none, now, 3600).collect()
    plan, left = retention.prune(df, none, now)
    assert left.count() == 3 and plan.count() == 1
    assert retention.sweep_supported(False, 5) == "unsupported"


@pytest.mark.parametrize(("name", "temp"), [("a.tmp", True), ("a.tmp.3", True), ("a.tmp.-3", True), ("a.tmp.x", False), ("a.tmp.tmp", False), ("a", False), (".tmp", True), ("a.tmp.", False)])
def test_temp_names(spark, name, temp):
    assert retention.is_temp(name) == temp
    assert spark.range(1).select(retention.is_temp_name(F.lit(name))).first()[0] == temp


GOOD = ["main", "release/v1", "a/b/c", "feature-x"]
BAD = ["", "/abs", "..", "a/../b", "a//b", ".hidden", "foo.lock", "end ", "end.", "nul\x00", "con", "CON.txt", "a:b", "a\\b", "a/"]


def test_ref_names(spark):
    df = spark.createDataFrame([(n,) for n in GOOD + BAD], "n string").coalesce(1)
    assert [r[0] for r in df.select(refs.valid_name(F.col("n"))).collect()] == [True] * len(GOOD) + [False] * len(BAD)


def test_refs_are_folded_from_their_log(spark):
    a, b = b"\x0a", b"\x0b"
    log = spark.createDataFrame([("m", 0, 1, a, None), ("m", 1, 2, b, a), ("gone", 0, 1, a, None), ("gone", 1, 2, None, a)], "name string, seq long, ts_ns long, new binary, old binary")
    assert {r.name: bytes(r.digest) for r in refs.current(log).collect()} == {"m": b}
    assert {r.name: bytes(r.previous) for r in refs.previous(log).collect()} == {"m": a, "gone": a}
    assert [r.seq for r in refs.log(log, "m", 1).collect()] == [1]
    more = refs.set_refs(log, spark.createDataFrame([("m", b), ("n", a)], "name string, digest binary"), F.lit(9)).collect()
    assert {(r.name, r.seq, bytes(r.old) if r.old else None) for r in more} == {("m", 2, b), ("n", 0, None)}
    assert [r.name for r in refs.delete_refs(log, spark.createDataFrame([("m",), ("gone",), ("no",)], "name string"), F.lit(9)).collect()] == ["m"]
    with pytest.raises(Exception, match="bad ref name"):
        refs.set_refs(log, spark.createDataFrame([("a//b", b)], "name string, digest binary"), F.lit(9)).collect()
    with pytest.raises(Exception, match="absent"):
        refs.set_refs(log, spark.createDataFrame([("a", None)], "name string, digest binary"), F.lit(9)).collect()


def test_resolve_names(spark):
    table = spark.createDataFrame([("release/v1", b"1"), ("release/v2", b"2"), ("main", b"3"), ("main-2", b"4")], "name string, digest binary")
    got = {r.asked: (r.name, r.status, r.candidates) for r in lookup.resolve_names(table, spark.createDataFrame([("main",), ("release",), ("release/v1",), ("main-",), ("x",)], "asked string")).collect()}
    assert got["main"][:2] == ("main", "ok") and got["main-"][:2] == ("main-2", "ok") and got["x"][1] == "not_found"
    assert got["release"][1:] == ("ambiguous", ["release/v1", "release/v2"])


def test_put_and_get_in_order_of_checks(spark):
    m = models.MODELS[2]  # commits
    good = models.commit_payload("ab" * 32, "A", "m", "2026-09-09T12:00:00Z")
    rows = spark.createDataFrame([("c", good), ("bad", b"{}"), ("junk", b"[")], "k string, payload binary")
    made = objects.put_typed(rows, F.lit("json"), F.lit("commit@1"), F.col("payload")).select("digest", "content", "k").collect()
    other = models.frame("gzip", "commit@1", good), models.frame("json", "tree@1", good), b"plain"
    stored = [(bytes(r.digest), bytes(r.content)) for r in made] + [(hashlib.sha256(x).digest(), x) for x in other]
    df = spark.createDataFrame(stored, "digest binary, content binary")
    wanted = spark.createDataFrame([(d,) for d, _ in stored] + [(b"none",)], "digest binary")
    got = {bytes(r.digest): r.status for r in objects.get_typed(df, wanted, "commit@1", "json", m.decode, m.valid).collect()}
    assert [got[d] for d, _ in stored] == ["ok", "corrupt", "corrupt", "codec_mismatch", "unknown_type", "corrupt"] and got[b"none"] == "not_found"


def test_golden_commits_and_tags():
    time = "2026-09-09T12:00:00Z"
    tree = models.tree_payload([("a", "ab" * 32, "100644"), ("b", None, "100644")])
    assert b'"hash"' in tree and tree.count(b"hash") == 1
    root = models.commit_payload("ab" * 32, "a", "m", time)
    assert b"parent" not in root and models.tag_payload("v2", None, "t", "m").count(b'"target":""') == 1
    assert models.blob_payload(b"hello") == b'{"data":"aGVsbG8="}' and models._json([("a", "<&>")]) == b'{"a":"\\u003c\\u0026\\u003e"}'


def test_registry(spark):
    r = models.Registry(models.MODELS)
    with pytest.raises(ValueError, match="already"):
        r.register(models.MODELS[0])
    with pytest.raises(KeyError):
        r.lookup("nope@1")
    rows = [models.frame("json", "blob@1", models.blob_payload(b"hello")), models.frame("json", "commit@1", models.commit_payload("ab" * 32, "A", "msg", "t", "cd" * 32)), models.frame("json", "tag@1", models.tag_payload("v", None, "", "")), models.frame("json", "odd@1", b"{}"), b"x", models.frame("json", "tag@1", models.tag_payload("", None, "", ""))]
    df = spark.createDataFrame([(bytes([i]), x) for i, x in enumerate(rows)], "digest binary, content binary")
    got = r.resolve(df).orderBy("digest").cache()
    assert [x.status for x in got.collect()] == ["ok", "ok", "ok", "unknown_type", "corrupt", "corrupt"]
    assert [len(x.refs) for x in got.collect()] == [0, 2, 0, 0, 0, 0]
    assert [x.line for x in models.describe(got).orderBy("digest").collect()][:4] == ["blob (5 bytes)", "commit by A: msg", 'tag "v" -> <absent>', 'unknown type "odd"']


def test_ingest_put_merge(spark):
    df = spark.createDataFrame([("a",), ("a",), ("",), (None,)], "content string")
    got = objects.ingest(df)
    assert sorted((r["size"], r.copies) for r in got.collect()) == [(0, 2), (1, 2)]
    a = objects.address(df).select("digest", "size").dropDuplicates(["digest"])
    assert objects.new_objects(objects.address(df), a).count() == 0
    assert objects.put_dedup(objects.address(df), a.filter("size = 1")).filter("deduplicated").count() == 2
    assert objects.delete(a, spark.createDataFrame([(b"short",)], "digest binary")).count() == 2
    assert objects.within_cap(a, a, 1) and not objects.within_cap(a, a, 0)
    assert objects.merge(a, a).count() == 2


def test_tiers(spark):
    loose = spark.createDataFrame([(b"a", 1), (b"b", 2)], "digest binary, size long")
    index = spark.createDataFrame([(b"b", "p", 0, 2), (b"c", "p", 2, 0), (b"d", "p", 9, 9), (b"e", "p", -1, 1)], "digest binary, pack string, off long, size long")
    packs = spark.createDataFrame([("p", 10)], "pack string, length long")
    assert digests(lookup.valid_records(index, packs)) == [b"b", b"c"]
    good = lookup.valid_records(index, packs)
    assert digests(lookup.union_tiers(loose, good)) == [b"a", b"b", b"c"]
    s = listing.packed_stats(loose, good).first()
    assert (s.objects, s.bytes) == (2, 3)  # an empty object that only the index has is listed, not counted
    assert {bytes(r.digest): r.tier for r in lookup.prefer_packed(loose, good).collect()}[b"b"] == "packed"
    assert lookup.plan_batch(spark.createDataFrame([(b"a",), (b"b",)], "digest binary"), index, packs).filter("tier = 'packed'").count() == 1


def test_checksums(spark):
    now = F.lit("2024-01-01").cast("timestamp")
    df = spark.createDataFrame([(b"1", b"one"), (b"2", b"two"), (b"3", b"three"), (b"4", None)], "digest binary, content binary")
    made = verify.record(spark.createDataFrame([(b"1", b"one"), (b"2", b"was two"), (b"4", b"x")], "digest binary, content binary"), "crc32", now)
    assert {bytes(r.digest): r.state for r in verify.verify_checksums(df, made, "crc32").collect()} == {b"1": "verified", b"2": "corrupt", b"3": "unrecorded", b"4": "unreadable"}
    assert verify.verify_checksums(df, made, "adler32").filter("state = 'wrong_algorithm'").count() == 3
    with pytest.raises(verify.WrongAlgorithm):
        verify.verify_checksums(df, made, "adler32", strict=True)
    assert verify.add_records(made, verify.record(df, "crc32", now)).count() == 4
    small = verify.encode_record(made, 10).select("status").distinct().collect()
    assert [r.status for r in small] == ["record_too_large"]
    assert verify.exit_status(verify.verify_checksums(df, made, "crc32")) == 1
    assert {r.name: r.state for r in lookup.reconcile(df, made.filter("digest <> '1'"), spark.createDataFrame([("odd.txt",)], "name string")).collect()}["odd.txt"] == "foreign"


@pytest.mark.parametrize(("items", "rate", "want"), [(1000, 0.01, (9585, 7)), (10_000, 0.01, (95_850, 7)), (10_000, 0.001, (143_775, 10)), (0, 0.01, (1, 1))])
def test_bloom_parameters(items, rate, want):
    assert bloom.parameters(items, rate) == want


def test_bloom_refuses():
    for items, rate in ((10, 0), (10, 1), (10**12, 0.01)):
        with pytest.raises(ValueError):
            bloom.parameters(items, rate)


def test_bloom_saved_under_another_key_is_not_loaded(spark, tmp_path):
    rows = spark.range(100).select(F.sha2(F.col("id").cast("string"), 256).alias("digest"))
    m, k = bloom.parameters(100, 0.01)
    path = f"file://{tmp_path}/bloom"
    bloom.save(bloom.build(rows, m, k), path, m, k, "one")
    assert bloom.load(spark, path, m, k, "two") is None and bloom.load(spark, f"{path}-none", m, k, "one") is None
    assert bloom.probe(rows, bloom.load(spark, path, m, k, "one"), m, k).filter("not maybe").count() == 0


def test_chunks(spark):
    df = spark.createDataFrame([(b"1", b"abc123" * 19), (b"2", b""), (b"3", b"abc")], "digest binary, content binary")
    assert chunks.round_trip(df, 7).filter("same").count() == 3
    assert chunks.split(df, 7).groupBy("digest").count().count() == 2 and chunks.split(df, 0).count() == 3
    r = spark.range(1).select(chunks.count(F.lit(0), 16).alias("a"), chunks.count(F.lit(10), 0).alias("b"), chunks.count(F.lit(15), 4).alias("c")).first()
    assert tuple(r) == (0, 1, 4)


def test_packs_close_when_full_before_an_append(spark):
    df = spark.createDataFrame([(i, bytes([i]), s) for i, s in enumerate([5, 6, 1, 20, 1])], "seq int, digest binary, size long")
    got = chunks.assign_packs(df, 10, 10).orderBy("seq").collect()
    assert [(r.pack, r.off) for r in got] == [(0, 0), (0, 5), (1, 0), (1, 1), (2, 0)]


def test_lru(spark):
    df = spark.createDataFrame([("s", i, d) for i, d in enumerate("abacbaa")], "session string, step int, digest string")
    assert [r.hit for r in caches.lru_hits(df, 2).orderBy("step").collect()] == [False, False, True, False, False, False, True]
    s = caches.cache_stats(caches.lru_hits(df, 2)).first()
    assert (s.hits, s.misses) == (2, 5)


def test_snapshot_is_made_anew_when_it_is_old(spark):
    clock, made = [0.0], []
    s = caches.Snapshot(lambda: made.append(1) or spark.range(3), 0.5, lambda: clock[0])
    s.get(), s.get()
    clock[0] = 1.0
    s.get()
    assert len(made) == 2 and s.clear() and not s.clear()


def test_files(spark, tmp_path):
    base = tmp_path / "store"
    for data in (b"", b"payload", b"0123456789abcdef" * 4096):
        h = hashlib.sha256(data).hexdigest()
        (base / h[:2]).mkdir(parents=True, exist_ok=True)
        (base / h[:2] / h).write_bytes(data)
        (base / h[:2] / (h + ".tmp.1")).write_bytes(b"half")
    (base / "README").write_bytes(b"x")
    rows = files.loose(spark, f"file://{base}")
    assert rows.count() == 3 and verify.tally(verify.verify(rows)).first().verified == 3
    assert files.temp_files(spark, f"file://{base}").count() == 3
    r = base.parent / "refs"
    (r / "release").mkdir(parents=True)
    (r / ".log").mkdir()
    (r / "release" / "v1").write_text("ab\n")
    (r / ".log" / "main").write_text("1\tab\t\n2\tcd\tab\nbroken")
    assert [(x.name, bytes(x.digest)) for x in files.refs(spark, f"file://{r}").collect()] == [("release/v1", b"\xab")]
    assert refs.parse_log(files.reflog_lines(spark, f"file://{r}")).count() == 2
    assert files.kind("") == "fs"
    with pytest.raises(ValueError):
        files.kind("tape")
    with pytest.raises(ValueError):
        files.check_layout(40, 2)
    assert files.preview(rows, 3).filter("truncated").count() == 2


def test_packed_store(spark, tmp_path):
    (tmp_path / "objects").mkdir()
    (tmp_path / "packs").mkdir()
    a, b = hashlib.sha256(b"aa").hexdigest(), hashlib.sha256(b"bbb").hexdigest()
    (tmp_path / "packs" / "0.pack").write_bytes(b"aabbb")
    (tmp_path / "packs" / "index.json").write_text('{"entries":{"%s":{"pack":"packs/0.pack","offset":0,"size":2},"%s":{"pack":"0.pack","offset":2,"size":3},"zz":{"pack":"0.pack","offset":0,"size":1},"%s":{"pack":"0.pack","offset":4,"size":9}}}' % (a, b, "cc" * 32))
    (tmp_path / "objects" / a).write_bytes(b"aa")
    got = files.open_store(spark, "packfs", f"file://{tmp_path}")
    assert sorted(bytes(r.content) for r in got.collect()) == [b"aa", b"bbb"] and verify.tally(verify.verify(got)).first().verified == 2


def test_checksum_files(spark, tmp_path):
    h = "ab" * 32
    (tmp_path / f"{h}.json").write_text('{"version":1,"digest":"%s","checksum_algo":"crc32","checksum":"00000000","size":0,"created_at":"2024-01-01T00:00:00Z"}' % h)
    (tmp_path / f"{'cd' * 32}.json").write_text("{")
    (tmp_path / "note.txt").write_text("x")
    got = {dg_: s for dg_, s in files.checksum_records(spark, f"file://{tmp_path}").select(dg.to_text(F.col("digest")), "record_status").collect()}
    assert got == {h: "ok", "cd" * 32: "corrupt"}
    assert [r.name for r in files.foreign_records(spark, f"file://{tmp_path}").collect()] == ["note.txt"]


def test_dump_round_trip_and_damage(spark, tmp_path):
    rows = [(hashlib.sha256(x).digest(), x) for x in (b"", b"a", b"bb")]
    df = spark.createDataFrame(rows, "digest binary, content binary")
    path = str(tmp_path / "dump")
    snapshots.export(df, path, total=True)
    assert sorted((bytes(r.digest), bytes(r.content)) for r in snapshots.restore(spark, path).collect()) == sorted(rows)
    raw = open(path, "rb").read()
    for bad in (raw[:-1], raw + b"x", b"y" + raw[1:], raw[:8] + b"\0\7" + raw[10:]):
        with pytest.raises(snapshots.Malformed):
            list(snapshots.read(io.BytesIO(bad), True))
    twice = io.BytesIO()
    snapshots.write([rows[1], rows[1]], twice, 2)
    twice.seek(0)
    with pytest.raises(snapshots.Malformed, match="repeated"):
        list(snapshots.read(twice))
    absent = io.BytesIO()
    snapshots.write([(b"", b"x")], absent, 1)
    absent.seek(0)
    with pytest.raises(snapshots.Malformed, match="absent"):
        list(snapshots.read(absent))


def test_trail(spark):
    t = spark.createDataFrame([("s", 1, "a"), ("s", 2, "b"), ("s", 3, "c")], "session string, step int, digest string")
    assert [(r.prev, r.next) for r in listing.trail_neighbours(t).orderBy("step").collect()] == [(None, "b"), ("a", "c"), ("b", None)]
