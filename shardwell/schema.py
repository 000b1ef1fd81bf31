"""Relations of a store and the states a row can be in."""

from __future__ import annotations

#: Outcomes of reading an object, in the order in which they are checked.
STATUSES = ("ok", "not_found", "digest_mismatch", "invalid_digest", "unknown_type", "corrupt", "codec_mismatch", "unsupported")

OBJECTS = "digest binary, content binary, size bigint, mtime timestamp"
META = "digest binary, type string, version smallint, codec string, size bigint, written timestamp, unreadable boolean"
EDGES = "src binary, dst binary, ord int"
REFS = "name string, digest binary"
REFLOG = "name string, seq bigint, ts_ns bigint, new binary, old binary"
CHECKSUMS = "digest binary, version int, type string, codec string, algo string, checksum binary, size bigint, created_at timestamp"
PACK_INDEX = "digest binary, pack string, off bigint, size bigint"
CHUNKS = "digest binary, idx int, data binary"

BLOB = "data binary"
TREE = "entries array<struct<name:string,hash:string,mode:string>>"
COMMIT = "tree string, parent string, author string, message string, time string"
TAG = "name string, target string, tagger string, message string"
