"""Digests as columns: BINARY inside, lowercase hex at the edges, absent as NULL (X-01..X-08, F-01..F-04, SC-03, SC-04)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HEX = "^([0-9a-f]{2})+$"
#: Bytes of each algorithm's digest.
WIDTHS = {"sha256": 32, "sha512": 64, "sha512_256": 32, "crc32": 4, "crc64": 8, "adler32": 4}


def to_text(d: Column) -> Column:
    """Lowercase hex; the absent digest is the empty text (X-01)."""
    return F.coalesce(F.lower(F.hex(d)), F.lit(""))


def prefix(d: Column, n: int) -> Column:
    """First ``n`` hex characters, total for any ``n`` (X-02)."""
    return F.lit("") if n <= 0 else F.substring(to_text(d), 1, n)


def short(d: Column) -> Column:
    """Eight characters and an ellipsis where something was left out (X-03)."""
    text = to_text(d)
    return F.when(F.length(text) <= 8, text).otherwise(F.concat(F.substring(text, 1, 8), F.lit("…")))


def is_present(d: Column) -> Column:
    """F-01."""
    return F.coalesce(F.octet_length(d) > 0, F.lit(False))


def has_width(d: Column, algorithm: str) -> Column:
    """F-02."""
    return F.coalesce(F.octet_length(d) == WIDTHS[algorithm], F.lit(False))


def is_lower_hex(text: Column) -> Column:
    """F-03."""
    return F.coalesce(text.rlike(HEX), F.lit(False))


def is_addressable(d: Column, fan_out: int, levels: int) -> Column:
    """Long enough for the directory layout (F-04)."""
    return F.coalesce(F.octet_length(d) * 2 >= fan_out * levels, F.lit(False))


def parse(text: Column) -> Column:
    """Strict lowercase hex to a digest, anything else NULL (X-04)."""
    return F.when(is_lower_hex(text), F.unhex(text))


def parse_status(text: Column) -> Column:
    """``ok`` or ``invalid_digest``."""
    return F.when(is_lower_hex(text), F.lit("ok")).otherwise(F.lit("invalid_digest"))


def same(a: Column, b: Column) -> Column:
    """Equal and present: the absent digest equals nothing, itself included (X-05)."""
    return F.coalesce(a == b, F.lit(False))


def tagged(algorithm: str, d: Column) -> Column:
    """``sha256:<hex>`` (X-06)."""
    return F.concat(F.lit(f"{algorithm}:"), to_text(d))


def parse_tagged(algorithm: str, text: Column) -> Column:
    """Bare hex or hex after the algorithm's own prefix, of the right width, else NULL (X-07)."""
    own = f"{algorithm}:"
    bare = F.when(text.startswith(own), F.substring(text, len(own) + 1, 2**30)).otherwise(text)
    d = parse(bare)
    return F.when(has_width(d, algorithm), d)


def to_path(base: str, d: Column, fan_out: int = 2, levels: int = 1) -> Column:
    """Path of a loose object: fan-out directories, then the whole hex (SC-03)."""
    text = to_text(d)
    return F.concat_ws("/", F.lit(base), *[F.substring(text, 1 + i * fan_out, fan_out) for i in range(levels)], text)


def from_path(path: Column) -> Column:
    """Digest named by the last segment, NULL for other files (SC-04)."""
    return parse(F.element_at(F.split(path, "/"), -1))
