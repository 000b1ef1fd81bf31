"""The store's handle from end to end."""

import hashlib

import pytest

from shardwell.operators import listing, models
from shardwell.store import Busy, Store, maintenance_lock, safe_path


def put(payload: bytes, kind: str) -> tuple[bytes, bytes]:
    data = models.frame("json", kind, payload)
    return hashlib.sha256(data).digest(), data


@pytest.fixture(scope="module")
def store(spark):
    blob = put(models.blob_payload(b"hello"), "blob@1")
    tree = put(models.tree_payload([("a", blob[0].hex(), "100644"), ("gone", None, "100644")]), "tree@1")
    c1 = put(models.commit_payload(tree[0].hex(), "A", "first", "2026-01-01T00:00:00Z"), "commit@1")
    c2 = put(models.commit_payload(tree[0].hex(), "A", "second", "2026-01-02T00:00:00Z", c1[0].hex()), "commit@1")
    lost = put(models.blob_payload(b"orphan"), "blob@1")
    rows = [(d, x, len(x), "2026-01-01 00:00:00") for d, x in (blob, tree, c1, c2, lost)]
    df = spark.createDataFrame(rows, "digest binary, content binary, size long, t string").selectExpr("digest", "content", "size", "cast(t as timestamp) as mtime")
    log = spark.createDataFrame([("main", 0, 1, c1[0], None), ("main", 1, 2, c2[0], c1[0])], "name string, seq long, ts_ns long, new binary, old binary")
    return Store(df, reflog=log).with_graph(), {"blob": blob, "tree": tree, "c1": c1, "c2": c2, "lost": lost}


def test_walk_audit_and_gc(store):
    s, o = store
    assert {bytes(r[0]) for r in s.reachable.collect()} == {o[k][0] for k in ("blob", "tree", "c1", "c2")}
    assert {r.state for r in s.audit().collect()} == {"verified", "orphaned"} and s.audit(False).filter("state = 'unverified'").count() == 4
    plan, left = s.gc("2026-01-01 02:00:00")
    assert [bytes(r.digest) for r in plan.collect()] == [o["lost"][0]] and left.stats().first().objects == 4
    assert s.gc("2026-01-01 00:10:00")[0].count() == 0
    assert s.prune("2026-01-01 02:00:00")[1].stats().first().objects == 5
    assert s.broken().count() == 0


def test_log_and_refs(spark, store):
    s, o = store
    heads = s.refs().select("digest")
    assert [r.line for r in s.log(heads).collect()] == ["commit by A: second", "commit by A: first"]
    assert s.resolve(spark.createDataFrame([("ma",)], "asked string")).first().status == "ok"


def test_put_get_and_meta(spark, store, tmp_path):
    s, o = store
    told, more = s.ingest(spark.createDataFrame([(o["blob"][1],), (b"new",), (b"new",)], "content binary"))
    assert sorted(r.deduplicated for r in told.collect()) == [False, False, True] and more.stats().first().objects == 6
    wanted = spark.createDataFrame([(o["blob"][0],), (b"none",)], "digest binary")
    assert sorted(r.status for r in s.get(wanted).collect()) == ["not_found", "ok"]
    assert s.meta(wanted).filter("type = 'blob@1'").count() == 1
    assert s.get_to_file(o["blob"][0].hex(), str(tmp_path / "x")) == 33
    with pytest.raises(KeyError):
        s.get_to_file("00", str(tmp_path / "y"))
    assert s.delete(wanted).stats().first().objects == 4


def test_lists_and_browsing(store):
    s, o = store
    assert s.list("blob").count() == 2 and s.list(limit=2, offset=4).count() == 1
    assert {r.value: r.objects for r in s.census().collect()}["commit@1"] == 2
    page = s.browse(listing.Browse(sort="inbound", descending=True, limit=2)).collect()
    assert page[0].inbound == 2 and s.totals(listing.Browse(reach="orphaned")).first().matched == 1
    offset, row = s.permalink(o["tree"][0].hex(), listing.Browse(limit=1))
    assert offset == sorted(x[0] for x in o.values()).index(o["tree"][0]) and len(row.first().outbound) == 1 and len(row.first().inbound_from) == 2
    assert s.hexdump(o["blob"][0].hex()).count() == 3
    assert s.split(10).count() > 10 and s.verify().filter("state = 'verified'").count() == 5


def test_lock_and_paths(tmp_path):
    with maintenance_lock(str(tmp_path)), pytest.raises(Busy), maintenance_lock(str(tmp_path)):
        pass
    with maintenance_lock(str(tmp_path)):
        pass
    (tmp_path / "a").mkdir()
    (tmp_path / "link").symlink_to(tmp_path / "a")
    assert safe_path(str(tmp_path), "a/b") == str(tmp_path / "a" / "b")
    for bad in ("../x", "/etc/passwd", "link/x"):
        with pytest.raises(ValueError):
            safe_path(str(tmp_path), bad)
