"""Object frames: version, codec, type and payload, each length-prefixed (X-30..X-37, SC-20..SC-25, D3).

``[version][uvarint codec length][codec][uvarint type length][type][uvarint payload length][payload]``; version 1 has no codec field.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

VERSION = 2
#: Longest codec or type name that a header-only read accepts, and the bytes it reads (G-01).
PEEK_NAME, PEEK_BYTES = 4096, 8192


def uvarint(n: Column) -> Column:
    """Little-endian groups of seven bits, the high bit on all but the last."""
    n = n.cast("long")
    groups = []
    for i in range(5):  # a value has fewer than 2**31 bytes
        low = F.shiftright(n, 7 * i).bitwiseAND(F.lit(127).cast("long"))
        group = F.lpad(F.hex(low + F.when(n >= 2 ** (7 * (i + 1)), 128).otherwise(0)), 2, "0")
        groups.append(group if i == 0 else F.when(n >= 2 ** (7 * i), group).otherwise(F.lit("")))
    return F.unhex(F.concat(*groups))


def encode(codec: Column, type_name: Column, payload: Column) -> Column:
    """A frame of the current version; NULL if the type name is empty or has no ``@`` (X-30, X-31)."""
    c, t = F.coalesce(codec, F.lit("")).cast("binary"), type_name.cast("binary")
    frame = F.concat(F.lit(bytes([VERSION])), uvarint(F.octet_length(c)), c, uvarint(F.octet_length(t)), t, uvarint(F.octet_length(payload)), payload)
    return F.when(F.contains(type_name, F.lit("@")), frame)


def read_uvarint(data: bytes, at: int) -> tuple[int, int] | None:
    """(value, position after it), None if it is cut off or over 64 bits."""
    value = shift = 0
    for i in range(10):
        if at + i >= len(data):
            return None
        b = data[at + i]
        if i == 9 and b > 1:
            return None
        value |= (b & 127) << shift
        if b < 128:
            return value, at + i + 1
        shift += 7
    return None


def _name(data: bytes, at: int, empty: bool, cap: int | None) -> tuple[bytes, int] | None:
    got = read_uvarint(data, at)
    if got is None or (got[0] == 0 and not empty) or (cap is not None and got[0] > cap) or got[1] + got[0] > len(data):
        return None
    return data[got[1] : got[1] + got[0]], got[1] + got[0]


def parse(data: bytes, cap: int | None = None) -> tuple[int, str, str, int] | None:
    """(version, codec, type, position after the header); a type without ``@`` reads as ``@1``.  None for a damaged header."""
    if not data or data[0] not in (1, VERSION):
        return None
    codec, at = b"", 1
    if data[0] == VERSION:
        got = _name(data, at, True, cap)
        if got is None:
            return None
        codec, at = got
    got = _name(data, at, False, cap)
    if got is None:
        return None
    name = got[0].decode("utf-8", "replace")
    return data[0], codec.decode("utf-8", "replace"), name if "@" in name else name + "@1", got[1]


HEADER = "version smallint, codec string, type string, from int, size int, status string"


def _parser(cap: int | None, payload: bool):
    """Arrow batches in, a struct of the header out; with ``payload`` also where the payload lies, which stays in the JVM."""

    @F.pandas_udf(HEADER)
    def run(data: pd.Series) -> pd.DataFrame:
        rows = []
        for x in data:
            x = b"" if x is None else bytes(x)
            h = parse(x, cap)
            size = read_uvarint(x, h[3]) if h and payload else None
            if h is None or (payload and (size is None or size[0] + size[1] > len(x))):
                rows.append((None, None, None, None, None, "corrupt"))
            else:
                rows.append((h[0], h[1], h[2], size[1] if size else h[3], size[0] if size else None, "ok"))
        out = pd.DataFrame(rows, columns=["version", "codec", "type", "from", "size", "status"])
        return out.astype({"version": "Int16", "from": "Int32", "size": "Int32"})

    return run


def header(data: Column, cap: int | None = None) -> Column:
    """struct(version, codec, type, from, size, status): status ``ok`` or ``corrupt``.

    ``cap`` bounds the names as a header-only read does; a full read has none.
    """
    return _parser(cap, False)(data)


def peek(data: Column) -> Column:
    """Header from the first bytes alone, names capped (X-35, SC-21); only those bytes reach Python."""
    return header(F.substring(data, 1, PEEK_BYTES + 32), PEEK_NAME)


def peek_version(data: Column) -> Column:
    """The first byte, whatever it is; NULL for empty data (X-37, SC-24)."""
    return F.conv(F.nullif(F.hex(F.substring(data, 1, 1)), F.lit("")), 16, 10).cast("smallint")


def labels(data: Column) -> Column:
    """struct(version, codec, type, header_status) as listings show them: bytes without a header are ``headerless``, with version 0, no type
    and the codec ``unspecified``; NULL data is ``unreadable`` (SC-25, G-02)."""
    h = peek(data)
    ok = h["status"] == "ok"
    return F.struct(
        F.when(ok, h["version"]).otherwise(F.lit(0).cast("smallint")).alias("version"),
        F.when(ok, codec_label(h["codec"])).otherwise(F.lit("unspecified")).alias("codec"),
        F.when(ok, h["type"]).otherwise(F.lit("")).alias("type"),
        F.when(data.isNull(), F.lit("unreadable")).when(ok, F.lit("framed")).otherwise(F.lit("headerless")).alias("header_status"),
    )


def decode(data: Column) -> Column:
    """struct(version, codec, type, payload, status); bytes after the payload are ignored, a payload that is cut off is ``corrupt`` (X-33, X-34)."""
    h = _parser(None, True)(data)
    payload = F.when(h["status"] == "ok", F.substr(data, h["from"] + 1, h["size"]))
    return F.struct(h["version"].alias("version"), h["codec"].alias("codec"), h["type"].alias("type"), payload.alias("payload"), h["status"].alias("status"))


def codec_label(codec: Column) -> Column:
    """X-10."""
    return F.coalesce(F.nullif(codec, F.lit("")), F.lit("unspecified"))


def codec_cell(version: Column, codec: Column) -> Column:
    """A dash where no header was read (X-11)."""
    return F.when(version == 0, F.lit("—")).otherwise(codec_label(codec))


def codec_matches(stored: Column, expected: str) -> Column:
    """A mismatch needs two non-empty tags that differ (F-13, G-06)."""
    return (F.coalesce(stored, F.lit("")) == "") | F.lit(expected == "") | (stored == expected)
