"""Digests, hashes, frames, codecs and formats against golden values."""

import hashlib
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shardwell.functions import codecs, envelope, formats, hashing
from shardwell.functions import digest as dg
from shardwell.operators import models


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first()


def test_checksum_check_values(spark):
    x = F.lit(b"123456789")
    r = one(spark, a=dg.to_text(hashing.crc32(x)), b=dg.to_text(hashing.adler32(x)), c=dg.to_text(hashing.crc64(x)), d=hashing.adler32_closed(x))
    assert (r.a, r.b, r.c, r.d) == ("cbf43926", "091e01de", "995dc9bbdf1939fa", 0x091E01DE)


def test_hashes_of_the_empty_object_and_null(spark):
    r = one(spark, a=dg.to_text(hashing.sha256(F.lit(b""))), b=dg.to_text(hashing.sha512_256(F.lit(b"abc"))), c=hashing.sha512_256(F.lit(None).cast("binary")))
    assert r.a == "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
    assert r.b == hashlib.new("sha512_256", b"abc").hexdigest() and r.c is None


def test_unknown_algorithm():
    with pytest.raises(ValueError, match="unknown algorithm"):
        hashing.digest("md4", F.lit(b""))


@pytest.mark.parametrize(("text", "ok"), [("ab01", True), ("AB01", False), ("ab0", False), ("", False), ("sha256:ab", False), ("zz", False), (None, False)])
def test_strict_parse(spark, text, ok):
    r = one(spark, d=dg.parse(F.lit(text).cast("string")), s=dg.parse_status(F.lit(text).cast("string")))
    assert (r.d is not None) == ok and r.s == ("ok" if ok else "invalid_digest")


def test_absent_digest(spark):
    none = F.lit(None).cast("binary")
    r = one(spark, text=dg.to_text(none), same=dg.same(none, none), there=dg.is_present(none), p=dg.prefix(F.lit(b"\xab\xcd"), 3), q=dg.prefix(F.lit(b"\xab"), -1), s=dg.short(F.lit(b"\x01" * 8)))
    assert (r.text, r.same, r.there, r.p, r.q, r.s) == ("", False, False, "abc", "", "01010101…")


def test_tagged_digest(spark):
    h = "ab" * 32
    parse = lambda t: dg.parse_tagged("sha256", F.lit(t))
    r = one(spark, a=parse(h), b=parse(f"sha256:{h}"), c=parse(f"sha512:{h}"), d=parse("abcd"))
    assert r.a == r.b == bytearray.fromhex(h) and r.c is None and r.d is None


def test_path_round_trip(spark):
    r = one(spark, p=dg.to_path("/s", F.lit(bytes.fromhex("ab" * 32)), 2, 2))
    assert r.p == "/s/ab/ab/" + "ab" * 32
    assert one(spark, d=dg.from_path(F.lit(r.p))).d == bytearray.fromhex("ab" * 32)


TREE = models.tree_payload


GOLDEN = [
    (models.frame("json", "blob@1", models.blob_payload(b"hello")), 33, "2bb54b7ae27c60a134a684f75a1ed1846964723761b92a0af7c2d7855138c6d8"),
    (models.frame("", "commit@1", models.commit_payload("ab" * 32, "", "", "")), None, None),
]


def test_golden_blob(spark):
    data, size, digest = GOLDEN[0]
    assert len(data) == size and hashlib.sha256(data).hexdigest() == digest
    made = one(spark, x=envelope.encode(F.lit("json"), F.lit("blob@1"), F.lit(models.blob_payload(b"hello")))).x
    assert bytes(made) == data


def test_version_one_fixture(spark):
    data = b"\x01\x06note@1\x3d" + b'{"title":"v1 fixture","body":"written before codec identity"}'
    assert hashlib.sha256(data).hexdigest() == "946c2524c82cc712ba3c2a3075ee8f51b9e20d20e9459915dca1a3a73c551871"
    r = one(spark, d=envelope.decode(F.lit(data)), v=envelope.peek_version(F.lit(data))).asDict(True)
    assert r["v"] == 1 and r["d"]["type"] == "note@1" and r["d"]["codec"] == "" and r["d"]["status"] == "ok" and len(r["d"]["payload"]) == 61


@settings(max_examples=40, deadline=None)
@given(st.text(max_size=40), st.text(min_size=1, max_size=300), st.binary(max_size=300), st.binary(max_size=5))
def test_frame_parses_back(codec, name, payload, tail):
    name += "@2"
    data = models.frame(codec, name, payload) + tail  # bytes after the payload are ignored
    version, c, t, at = envelope.parse(data)
    size, start = envelope.read_uvarint(data, at)
    assert (version, c, t) == (2, codec, name) and data[start : start + size] == payload


def test_every_cut_of_a_header_is_corrupt():
    data = models.frame("json", "blob@1", b"x" * 200)
    head = envelope.parse(data)[3]
    assert all(envelope.parse(data[:i]) is None for i in range(head))


def test_header_states(spark):
    long = "t" * 5000 + "@1"
    rows = [(models.frame("", "a@1", b""),), (b"not a frame",), (b"",), (None,), (b"\x02\x00\x03abc\x00",), (models.frame("json", long, b"x"),)]
    df = spark.createDataFrame(rows, "x binary").coalesce(1).withColumn("l", envelope.labels(F.col("x"))).withColumn("d", envelope.decode(F.col("x")))
    got = [(r.l.version, r.l.codec, r.l.type, r.l.header_status, r.d.status) for r in df.collect()]
    assert got == [
        (2, "unspecified", "a@1", "framed", "ok"),
        (0, "unspecified", "", "headerless", "corrupt"),
        (0, "unspecified", "", "headerless", "corrupt"),
        (0, "unspecified", "", "unreadable", "corrupt"),
        (2, "unspecified", "abc@1", "framed", "ok"),
        (0, "unspecified", "", "headerless", "ok"),  # a long name reads whole but not in a listing
    ]


def test_unversioned_type_is_not_written(spark):
    assert one(spark, x=envelope.encode(F.lit("json"), F.lit("blob"), F.lit(b""))).x is None


def test_uvarint(spark):
    for n in (0, 1, 127, 128, 300, 2**14, 2**21 - 1, 2**28, 2**31 - 1):
        raw = bytes(one(spark, x=envelope.uvarint(F.lit(n))).x)
        assert envelope.read_uvarint(raw, 0) == (n, len(raw))


JSON = st.recursive(st.none() | st.booleans() | st.integers(-(2**63), 2**63 - 1) | st.floats(allow_nan=False, allow_infinity=False) | st.text(max_size=8) | st.binary(max_size=8), lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text(max_size=4), x, max_size=4), max_leaves=12)


@settings(max_examples=100, deadline=None)
@given(JSON)
def test_cbor_round_trip(value):
    assert codecs.cbor_decode(codecs.cbor_encode(value)) == value


@pytest.mark.parametrize("data", [b"", b"\x18", b"\x5f", b"\xc0\x00", b"\xa1\x01\x01", b"\x00\x00", b"\x81" * 200 + b"\x00", b"\xf9\x7e\x00"])
def test_damaged_cbor(data):
    with pytest.raises(codecs.Damaged):
        codecs.cbor_decode(data)


def test_cbor_floats_and_last_key():
    assert codecs.cbor_decode(b"\xf9\x3c\x00") == 1.0 and codecs.cbor_decode(b"\xa2\x61a\x01\x61a\x02") == {"a": 2}


def test_bounded_inflate():
    data = zlib.compress(b"a" * 1000)
    assert codecs.inflate(data, 15) == b"a" * 1000 and codecs.inflate(data, 15, 999) is None and codecs.inflate(data[:-3], 15) is None and codecs.inflate(b"junk", 15) is None


def test_stacked_tags():
    assert codecs.compose_tag("gzip", "json") == "gzip+json" and codecs.compose_tag("gzip", "") == "" and codecs.decoder("gzip+gob") == ["gzip", "codec_unsupported"]


@pytest.mark.parametrize(("size", "text"), [(0, "0 B"), (1023, "1023 B"), (1024, "1 KiB"), (1536, "1.5 KiB"), (10 * 1024 + 1, "10 KiB"), (1 << 20, "1 MiB"), (5 << 30, "5 GiB"), (1 << 50, "1024 TiB")])
def test_format_bytes(spark, size, text):
    assert one(spark, x=formats.format_bytes(F.lit(size).cast("long"))).x == text


def test_text_forms(spark):
    now = F.lit("2024-01-02 00:00:00").cast("timestamp")
    ago = lambda t: formats.age_label(F.lit(t).cast("timestamp"), now)
    r = one(spark, a=ago("2024-01-01 23:30:00"), b=ago("2024-01-01 12:00:00"), c=ago("2023-12-01 00:00:00"), d=ago("2025-01-01 00:00:00"), e=formats.safe_field(F.lit("a\tb\x7f")), f=formats.bare_type(F.lit("x@2")), g=formats.timestamp_text(F.lit("2024-01-01 10:00:00.120").cast("timestamp")))
    assert tuple(r) == ("30m ago", "12h ago", "32d ago", "0m ago", "a?b?", "x", "2024-01-01T10:00:00.12Z")


def test_hexdump(spark):
    rows = one(spark, x=formats.hexdump(F.lit(b"0123456789abcdef\x00z"))).x
    assert [(r.offset, r.ascii) for r in rows] == [(0, "0123456789abcdef"), (16, ".z")] and rows[1].hex == "00 7a"
    assert one(spark, x=formats.hexdump(F.lit(b""))).x == []
