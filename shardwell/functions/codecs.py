"""Payload codecs: JSON by schema, the deflate family and CBOR through Arrow batches (X-40..X-49, E-02, E-03, E-14)."""

from __future__ import annotations

import gzip
import json
import math
import struct
import zlib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Largest decoded payload (X-44), and deepest nesting of CBOR.
MOST_DECODED, MOST_DEPTH = 2**30, 128


def compose_tag(name: str, inner: str) -> str:
    """Tag of a codec around another: empty if the inner one has none (X-45)."""
    return f"{name}+{inner}" if inner else ""


def from_json(payload: Column, schema: StructType) -> Column:
    """Decode with an explicit schema; what doesn't parse is NULL."""
    return F.from_json(payload.cast("string"), schema, {"mode": "PERMISSIVE"})


def inflate(data: bytes, window: int, most: int = MOST_DECODED) -> bytes | None:
    """Bounded decompression; None if damaged, cut off or larger than ``most``."""
    d = zlib.decompressobj(window)
    try:
        out = d.decompress(data, most + 1)
    except zlib.error:
        return None
    return out if d.eof and len(out) <= most else None


def _binary(function: Callable[[bytes], bytes | None]):
    @F.pandas_udf("binary")
    def run(data: pd.Series) -> pd.Series:
        return data.map(lambda x: None if x is None else function(bytes(x)))

    return run


def gzip_encode(data: Column) -> Column:
    return _binary(lambda x: gzip.compress(x, mtime=0))(data)


def gzip_decode(data: Column, most: int = MOST_DECODED) -> Column:
    return _binary(lambda x: inflate(x, 31, most))(data)


def zlib_encode(data: Column) -> Column:
    return _binary(zlib.compress)(data)


def zlib_decode(data: Column, most: int = MOST_DECODED) -> Column:
    return _binary(lambda x: inflate(x, 15, most))(data)


def flate_encode(data: Column) -> Column:
    def run(x: bytes) -> bytes:
        c = zlib.compressobj(wbits=-15)
        return c.compress(x) + c.flush()

    return _binary(run)(data)


def flate_decode(data: Column, most: int = MOST_DECODED) -> Column:
    return _binary(lambda x: inflate(x, -15, most))(data)


def binary_codec(transform: Callable[[bytes], bytes], restore: Callable[[bytes], bytes | None]):
    """A pair of column functions from a pair of byte functions (X-47, E-14)."""
    return _binary(transform), _binary(restore)


class Damaged(ValueError):
    """CBOR that can't be decoded."""


def _head(major: int, n: int) -> bytes:
    if n < 24:
        return bytes([major << 5 | n])
    for extra, size in ((24, 1), (25, 2), (26, 4), (27, 8)):
        if n < 1 << (8 * size):
            return bytes([major << 5 | extra]) + n.to_bytes(size, "big")
    raise ValueError("integer out of range")


def cbor_encode(value) -> bytes:
    """nil, booleans, 64-bit integers, finite floats (64 bits), text, bytes, lists and maps with text keys in sorted order; shortest lengths."""
    if value is None:
        return b"\xf6"
    if value is True or value is False:
        return b"\xf5" if value else b"\xf4"
    if isinstance(value, int):
        if not -(2**63) <= value < 2**63:
            raise ValueError("integer out of range")
        return _head(0, value) if value >= 0 else _head(1, -1 - value)
    if isinstance(value, float):
        if not math.isfinite(value):
            raise ValueError("not a finite number")
        return b"\xfb" + struct.pack(">d", value)
    if isinstance(value, str):
        raw = value.encode()
        return _head(3, len(raw)) + raw
    if isinstance(value, (bytes, bytearray)):
        return _head(2, len(value)) + bytes(value)
    if isinstance(value, (list, tuple)):
        return _head(4, len(value)) + b"".join(map(cbor_encode, value))
    if isinstance(value, dict):
        return _head(5, len(value)) + b"".join(cbor_encode(k) + cbor_encode(value[k]) for k in sorted(value))
    raise ValueError(f"no CBOR for {type(value).__name__}")


def cbor_decode(data: bytes):
    """One value and nothing after it; half, single and double floats; the last of equal keys wins."""
    value, at = _one(data, 0, 0)
    if at != len(data):
        raise Damaged("data after the value")
    return value


def _one(data: bytes, at: int, depth: int):
    if depth > MOST_DEPTH:
        raise Damaged("nested too deeply")
    if at >= len(data):
        raise Damaged("cut off")
    major, info = data[at] >> 5, data[at] & 31
    at += 1
    if major == 7:
        if info in (20, 21, 22):
            return {20: False, 21: True, 22: None}[info], at
        kind = {25: ">e", 26: ">f", 27: ">d"}.get(info)
        if kind is None:
            raise Damaged("unknown simple value")
        size = struct.calcsize(kind)
        if at + size > len(data):
            raise Damaged("cut off")
        value = struct.unpack(kind, data[at : at + size])[0]
        if not math.isfinite(value):
            raise Damaged("not a finite number")
        return value, at + size
    if info < 24:
        n = info
    elif info < 28:
        size = 1 << (info - 24)
        if at + size > len(data):
            raise Damaged("cut off")
        n, at = int.from_bytes(data[at : at + size], "big"), at + size
    else:
        raise Damaged("indefinite lengths are not taken")
    if major in (0, 1):
        if n >= 2**63:
            raise Damaged("integer out of range")
        return (n if major == 0 else -1 - n), at
    if major in (2, 3):
        if at + n > len(data):
            raise Damaged("cut off")
        raw = data[at : at + n]
        try:
            return (raw if major == 2 else raw.decode()), at + n
        except UnicodeDecodeError as e:
            raise Damaged("text is not UTF-8") from e
    if major == 4:
        out = []
        for _ in range(n):
            value, at = _one(data, at, depth + 1)
            out.append(value)
        return out, at
    if major == 5:
        found: dict = {}
        for _ in range(n):
            k, at = _one(data, at, depth + 1)
            if not isinstance(k, str):
                raise Damaged("a key is not text")
            found[k], at = _one(data, at, depth + 1)
        return found, at
    raise Damaged("tags are not taken")


def cbor_from_json(text: Column) -> Column:
    """CBOR of the value that a JSON text holds; NULL if it has none."""

    @F.pandas_udf("binary")
    def run(data: pd.Series) -> pd.Series:
        def one(x):
            try:
                return None if x is None else cbor_encode(json.loads(x))
            except ValueError:
                return None

        return data.map(one)

    return run(text)


def cbor_to_json(data: Column) -> Column:
    """Canonical JSON (sorted keys, no spaces) of a CBOR value; NULL if it is damaged or holds bytes."""

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        def one(x):
            try:
                return None if x is None else json.dumps(cbor_decode(bytes(x)), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
            except (ValueError, TypeError):
                return None

        return values.map(one)

    return run(data)


def decoder(tag: str) -> list[str]:
    """Layers of a stacked tag, outermost first; ``codec_unsupported`` names the ones that can't be read here."""
    return [x if x in ("json", "cbor", "gzip", "zlib", "flate", "binary") else "codec_unsupported" for x in tag.split("+")] if tag else []
