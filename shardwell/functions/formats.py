"""Text forms of sizes, ages, times and bytes (X-09, X-12..X-17, X-63..X-65)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

KIB, MIB = 1024, 1024 * 1024


def safe_field(text: Column) -> Column:
    """Control characters as ``?`` (X-09)."""
    return F.regexp_replace(text, r"[\x00-\x1f\x7f-\x9f]", "?")


def bare_type(name: Column) -> Column:
    """Before the first ``@`` (X-12)."""
    return F.element_at(F.split(name, "@"), 1)


def versioned_type(name: str) -> str:
    """A filter without a major version means the first (F-05)."""
    return name if not name or "@" in name else f"{name}@1"


def size_band(size: Column) -> Column:
    """F-08."""
    return F.when(size < KIB, F.lit("small")).when(size <= MIB, F.lit("medium")).otherwise(F.lit("large"))


def format_bytes(size: Column) -> Column:
    """One decimal below ten, none from ten on or for whole values (X-15)."""
    out = F.concat(size.cast("string"), F.lit(" B"))
    for i, unit in enumerate(("KiB", "MiB", "GiB", "TiB"), 1):
        value = size / F.lit(float(1024**i))
        whole = (value >= 10) | (value == F.floor(value))
        text = F.when(whole, F.format_string("%.0f", F.bround(value, 0))).otherwise(F.format_string("%.1f", F.bround(value, 1)))
        out = F.when(size >= 1024**i, F.concat(text, F.lit(f" {unit}"))).otherwise(out)
    return out


def age_label(written: Column, now: Column) -> Column:
    """Minutes, hours or days ago, never below 0 (X-63)."""
    minutes = F.floor(F.greatest(F.lit(0), F.unix_micros(now) - F.unix_micros(written)) / 60_000_000)
    return (
        F.when(written.isNull(), F.lit(""))
        .when(minutes < 60, F.concat(minutes.cast("string"), F.lit("m ago")))
        .when(minutes < 1440, F.concat(F.floor(minutes / 60).cast("string"), F.lit("h ago")))
        .otherwise(F.concat(F.floor(minutes / 1440).cast("string"), F.lit("d ago")))
    )


def timestamp_text(t: Column) -> Column:
    """RFC 3339 in UTC, without trailing zeros of the fraction (X-64)."""
    text = F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return F.when(t.isNull(), F.lit("")).otherwise(F.concat(F.regexp_replace(text, r"\.?0+$", ""), F.lit("Z")))


def checked_label(t: Column, now: Column) -> Column:
    """X-65."""
    return F.when(t.isNull(), F.lit("")).otherwise(F.concat(F.date_format(t, "yyyy-MM-dd HH:mm:ss"), F.lit(" UTC ("), age_label(t, now), F.lit(")")))


def integrity_label(state: Column) -> Column:
    """X-14."""
    return F.when(state == "verified", F.lit("Verified")).when(state == "corrupt", F.lit("Corrupt")).otherwise(F.lit("Not verified"))


def stats_text(count: Column, size: Column) -> Column:
    """X-17."""
    return F.concat(count.cast("string"), F.lit(" objects, "), size.cast("string"), F.lit(" bytes"))


def hexdump(data: Column, width: int = 16) -> Column:
    """array<struct<offset, hex, ascii>> of rows of ``width`` bytes (X-16)."""
    n = F.octet_length(data)

    def row(i: Column) -> Column:
        part = F.substr(data, (i * width + 1).cast("int"), F.lit(width))
        pairs = F.trim(F.regexp_replace(F.lower(F.hex(part)), "(..)", "$1 "))
        # latin-1 keeps one character a byte; what doesn't print is a dot
        shown = F.regexp_replace(F.decode(part, "ISO-8859-1"), r"[^\x20-\x7e]", ".")
        return F.struct((i * width).cast("long").alias("offset"), pairs.alias("hex"), shown.alias("ascii"))

    rows = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(n / width).cast("int") - 1)), row)
    return F.when(n > 0, rows).otherwise(F.array().cast("array<struct<offset:bigint,hex:string,ascii:string>>"))
