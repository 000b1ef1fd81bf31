"""Object models that refer to one another: a version history (blob, tree, commit, tag), notes and artifacts
(D4, D5, D8, D9, F-14, F-15, J-10..J-12, P-07, P-08, P-10..P-12, X-13, X-66, E-04..E-09)."""

from __future__ import annotations

import base64
import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from shardwell import schema
from shardwell.functions import codecs, envelope, formats
from shardwell.functions import digest as dg


def _present(texts: Column) -> Column:
    """Digests of hex texts in their order, absent ones dropped."""
    return F.filter(F.transform(texts, dg.parse), lambda x: x.isNotNull())


def commit_references(v: Column) -> Column:
    return _present(F.array(v["tree"], v["parent"]))


def tree_references(v: Column) -> Column:
    return _present(F.transform(F.coalesce(v["entries"], F.array().cast("array<struct<name:string,hash:string,mode:string>>")), lambda e: e["hash"]))


def tag_references(v: Column) -> Column:
    return _present(F.array(v["target"]))


def no_references(v: Column) -> Column:
    return F.array().cast("array<binary>")


def _texts(x: Column) -> Column:
    return F.coalesce(x, F.array().cast("array<string>"))


def note_references(v: Column) -> Column:
    """Tags, then attachments, then related notes (P-11)."""
    return _present(F.concat(_texts(v["tags"]), _texts(v["attachments"]), _texts(v["related"])))


def manifest_references(v: Column) -> Column:
    return _present(_texts(v["artifacts"]))


@dataclass(frozen=True)
class Model:
    """A type name with the schema of its JSON payload, its references and its invariant."""

    name: str
    ddl: str
    references: Callable[[Column], Column] = no_references
    valid: Callable[[Column], Column] | None = None

    def decode(self, payload: Column) -> Column:
        return codecs.from_json(payload, StructType.fromDDL(self.ddl))


MODELS = (
    Model("blob@1", "data string"),
    Model("tree@1", schema.TREE, tree_references, lambda v: F.forall(F.coalesce(v["entries"], F.array().cast("array<struct<name:string,hash:string,mode:string>>")), lambda e: F.coalesce(e["name"], F.lit("")) != "")),
    Model("commit@1", schema.COMMIT, commit_references, lambda v: dg.parse(v["tree"]).isNotNull()),
    Model("tag@1", schema.TAG, tag_references, lambda v: F.coalesce(v["name"], F.lit("")) != ""),
)
NOTES = (Model("note@1", "title string, body string, tags array<string>, attachments array<string>, related array<string>", note_references),)
ARTIFACTS = (Model("artifact@1", "name string, data string"), Model("manifest@1", "name string, artifacts array<string>", manifest_references))


class Registry:
    """Types that can be resolved; a name is registered once (E-08, E-09, J-10, J-12)."""

    def __init__(self, models: tuple[Model, ...] = ()) -> None:
        self.models: dict[str, Model] = {}
        for m in models:
            self.register(m)

    def register(self, model: Model) -> None:
        if not model.name:
            raise ValueError("a type needs a name")
        if model.name in self.models:
            raise ValueError(f"{model.name} is registered already")
        self.models[model.name] = model

    def lookup(self, name: str) -> Model:
        if name not in self.models:
            raise KeyError(f"unknown type {name!r}")
        return self.models[name]

    def resolve(self, objects: DataFrame) -> DataFrame:
        """digest, type, status, refs and one struct column per type, of which one is set at most (D9, J-10, J-11, P-07, P-08).

        One pass; every type's decoder runs only where the header names it.
        """
        rows = objects.select("digest", "content").withColumn("_f", envelope.decode(F.col("content")))
        kind, framed = F.col("_f.type"), F.coalesce(F.col("_f.status"), F.lit("corrupt")) == "ok"
        known = kind.isin(*self.models) if self.models else F.lit(False)
        arms, bad = {}, F.lit(False)
        for name, m in self.models.items():
            column = f"_{name.split('@')[0]}_{name.split('@')[1]}"
            value = F.when(framed & (kind == name), m.decode(F.col("_f.payload")))
            ok = value.isNotNull() & (F.lit(True) if m.valid is None else F.coalesce(m.valid(value), F.lit(False)))
            arms[column] = (m, F.when(ok, value))
            bad = bad | (framed & (kind == name) & ~ok)
        rows = rows.withColumns({c: v for c, (_, v) in arms.items()})
        status = F.when(F.col("content").isNull(), F.lit("unsupported")).when(~framed | bad, F.lit("corrupt")).when(~known, F.lit("unknown_type")).otherwise(F.lit("ok"))
        refs = F.coalesce(*[F.when(F.col(c).isNotNull(), m.references(F.col(c))) for c, (m, _) in arms.items()], F.array().cast("array<binary>"))
        return rows.select("digest", kind.alias("type"), status.alias("status"), refs.alias("refs"), *[F.col(c).alias(c.strip("_").rpartition("_")[0]) for c in arms])


def describe(resolved: DataFrame) -> DataFrame:
    """One line for each resolved object of a history (X-13)."""
    kind = formats.bare_type(F.col("type"))
    target = dg.parse(F.col("tag.target"))
    line = (
        F.when(kind == "blob", F.concat(F.lit("blob ("), F.coalesce(F.octet_length(F.unbase64(F.col("blob.data"))), F.lit(0)).cast("string"), F.lit(" bytes)")))
        .when(kind == "tree", F.concat(F.lit("tree ("), F.greatest(F.size("tree.entries"), F.lit(0)).cast("string"), F.lit(" entries)")))
        .when(kind == "commit", F.concat(F.lit("commit by "), F.coalesce("commit.author", F.lit("")), F.lit(": "), F.coalesce("commit.message", F.lit(""))))
        .when(kind == "tag", F.concat(F.lit('tag "'), F.col("tag.name"), F.lit('" -> '), F.when(target.isNull(), F.lit("<absent>")).otherwise(dg.prefix(target, 8))))
        .otherwise(F.concat(F.lit('unknown type "'), kind, F.lit('"')))
    )
    return resolved.select("digest", line.alias("line"))


# Canonical JSON: fields in their order, no spaces, digests as hex and left out when optional and absent (G-20).


def _json(fields: list[tuple[str, object]]) -> bytes:
    text = json.dumps(dict(fields), separators=(",", ":"), ensure_ascii=False)
    for c in "<>&\u2028\u2029":
        text = text.replace(c, f"\\u{ord(c):04x}")
    return text.encode()


def blob_payload(data: bytes) -> bytes:
    return _json([("data", base64.b64encode(data).decode())])


def tree_payload(entries: list[tuple[str, str | None, str]]) -> bytes:
    return _json([("entries", [dict([("name", n), *([("hash", h)] if h else []), ("mode", m)]) for n, h, m in entries])])


def commit_payload(tree: str, author: str, message: str, time: str, parent: str | None = None) -> bytes:
    return _json([("tree", tree), *([("parent", parent)] if parent else []), ("author", author), ("message", message), ("time", time)])


def tag_payload(name: str, target: str | None, tagger: str, message: str) -> bytes:
    """The target is kept as an empty text when absent."""
    return _json([("name", name), ("target", target or ""), ("tagger", tagger), ("message", message)])


def frame(codec: str, type_name: str, payload: bytes) -> bytes:
    """A frame as bytes, for fixtures; columns use ``envelope.encode``."""
    if "@" not in type_name:
        raise ValueError(f"type {type_name!r} has no major version")

    def field(x: bytes) -> bytes:
        n, out = len(x), b""
        while n >= 128:
            out, n = out + bytes([n % 128 + 128]), n // 128
        return out + bytes([n]) + x

    return bytes([envelope.VERSION]) + field(codec.encode()) + field(type_name.encode()) + field(payload)


#: Types, payload sizes and block of the deterministic fixture graph (fixed values).
PREVIEW_TYPES = ("blob@1", "text@1", "json@1", "note@1", "manifest@1")
PREVIEW_SIZES = (128, 986, 2200, 48 * 1024, 384 * 1024, 1200 * 1024)
PREVIEW_BLOCK, PREVIEW_CORRUPT, PREVIEW_ROOT, PREVIEW_DETACHED = 8, 1, 3, 7


def preview_graph(n: int, scale: int = 1) -> list[dict]:
    """``n`` objects in blocks of eight: each refers to the up to three before it, newest first; one root, one detached and one damaged a
    block (M-13, M-14, A-14).  A digest depends on those before it, so the graph is made in order, on the driver (at most 10 000 objects).
    ``scale`` divides the payload sizes."""
    import hashlib

    if n > 10_000:
        raise ValueError("at most 10 000 objects")
    out: list[dict] = []
    for i in range(n):
        k = min(i, i % 4)
        refs = [out[i - 1 - j]["digest"] for j in range(k)]
        kind = PREVIEW_TYPES[i % len(PREVIEW_TYPES)]
        size = max(64, PREVIEW_SIZES[i % len(PREVIEW_SIZES)] // scale)
        fields: list[tuple[str, object]] = [("ordinal", i), ("type", kind)] + ([("refs", [r.hex() for r in refs])] if refs else [])
        pad = max(0, size - len(_json([*fields, ("padding", "")])))
        data = frame("json", kind, _json([*fields, ("padding", "x" * pad)]))
        stored = data[:-1] + bytes([data[-1] ^ 0xFF]) if i % PREVIEW_BLOCK == PREVIEW_CORRUPT else data
        out.append({"ordinal": i, "digest": hashlib.sha256(data).digest(), "refs": refs, "content": stored, "size": len(stored), "is_root": i % PREVIEW_BLOCK == PREVIEW_ROOT})
    return out
