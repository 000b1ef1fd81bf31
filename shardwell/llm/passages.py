"""Repeated passages by a sparse suffix array.

A passage is made of windows of ``MIN_WORDS`` words, and a window belongs to one position that its words select: the minimiser of its first
``WINDOW`` word 8-grams, early enough to leave ``REACH`` words of the window after it.  Equal windows have their positions at the same word,
so the suffixes at these positions are all that has to be sorted.  Suffixes whose first ``REACH`` words occur once only are dropped; the
others are sorted by their words and each is compared with its neighbours in that order: the longer of the two common prefixes is as far as
any other suffix agrees with it to the right.  To the left a match goes on over the windows that end within that reach.  A neighbour by the
words to the right need not be the suffix that agrees to the left, so these windows are settled by a 64-bit hash of all their words: counts
and first documents are aggregated by hash, whatever the number of documents that share a suffix.  A window with a count above one is
repeated, and all documents but the first lose it; passages are the unions of such windows.

What a text repeats of itself is settled within the text, by the same hashes; positions without a window that is new in the text are left
out.  Copies collapse first: a text equal to an earlier document's is one passage.  The first and last suffix of a partition have no
neighbour on one side and keep all their windows, so nothing depends on how suffixes are dealt out.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shardwell.llm._common import cut, map_texts, mix, word_hashes

GRAM, WINDOW, MIN_WORDS = 8, 24, 50
REACH = MIN_WORDS - WINDOW + 1
#: Words that a window may have after the first REACH of its suffix; two bytes of each one's hash are compared, so that a common prefix is
#: never found too short.
BEYOND = MIN_WORDS - REACH

_word = re.compile("[^\x20\x09-\x0d]+")
_POW = np.random.default_rng(11).integers(1, 2**63, size=GRAM, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

_BASE = int(_POW[0]) & ~7 | 5
_INVERSE = pow(_BASE, -1, 2**64)


def positions(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(positions, hashes of the REACH words from each, which of them each window of MIN_WORDS belongs to); none if a text is shorter."""
    n = len(words)
    if n < MIN_WORDS:
        return np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    w = words.astype(np.uint64) + np.uint64(1)
    h = np.zeros(n - GRAM + 1, dtype=np.uint64)
    for i in range(GRAM):
        h += w[i : i + len(h)] * _POW[i]
    h = mix(h)
    view = np.lib.stride_tricks.sliding_window_view(h, WINDOW)[: n - MIN_WORDS + 1]
    at, of = np.unique(view.argmin(axis=1) + np.arange(len(view)), return_inverse=True)
    f = np.zeros(len(at), dtype=np.uint64)
    for step in sorted({*range(0, REACH - GRAM + 1, GRAM), REACH - GRAM}):
        f = mix(f * np.uint64(0xFF51AFD7ED558CCD) + h[at + step])
    return at.astype(np.int32), f.astype(np.int64), of


def window_hashes(words: np.ndarray) -> np.ndarray:
    """A hash of the MIN_WORDS words from each place that has so many after it: differences of a running polynomial."""
    n = len(words)
    if n < MIN_WORDS:
        return np.zeros(0, dtype=np.int64)
    upto = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(mix(words.astype(np.uint64) + np.uint64(1)) * np.cumprod(np.full(n, _BASE, dtype=np.uint64)), out=upto[1:])
    h = (upto[MIN_WORDS:] - upto[:-MIN_WORDS]) * np.cumprod(np.full(n - MIN_WORDS + 1, _INVERSE, dtype=np.uint64))
    return mix(h).astype(np.int64)


def repeats_within(words: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]], list[tuple[int, int]]]:
    """(positions that hold a window for the first time, spans of windows that an earlier place holds, spans of what they repeat).

    ``of``: the position of each window.  Only the first place of a window has to be looked for in other texts: later ones go anyway.
    """
    _, first, back, count = np.unique(window_hashes(words), return_index=True, return_inverse=True, return_counts=True)
    later = first[back] != np.arange(len(of))
    spans = lambda s: _union([(a, a + MIN_WORDS) for a in s.tolist()])
    return np.unique(of[~later]), spans(np.flatnonzero(later)), spans(first[count > 1])


def _anchors(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """_id, u (of the text), n, at, f of each row."""

    def setup():
        cache: dict[bytes, int] = {}

        def make(rows):
            out: list[list] = [[], [], [], [], []]
            for t in rows:
                w = word_hashes(t, cache, wide=True)
                at, f, of = positions(w)
                own, later, earlier = repeats_within(w, of)
                spans = lambda x: [{"start": a, "end": b} for a, b in x]
                for column, v in zip(out, (len(w), at[own], f[own], spans(later), spans(_union(later + earlier)))):
                    column.append(v)
            return list(range(len(rows))), out

        return make

    text = F.coalesce(F.col(text_col), F.lit(""))
    spans = "array<struct<start:int,end:int>>"
    fields = f"n int, at array<int>, f array<long>, later {spans}, own {spans}"
    return map_texts(docs, [F.col(id_col).alias("_id"), F.unhex(F.md5(text)).alias("u")], text.alias("_text"), setup, fields)


def _suffixes(hits: DataFrame) -> DataFrame:
    """u, id, at, f, beyond (the words after the first REACH), s (start of the first window) and w (hashes of the windows) of each suffix;
    ``hits``: u, id, at (a list), text."""

    def run(batches):
        import pyarrow as pa

        cache: dict[bytes, int] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                words = word_hashes(batch.column(3)[i].as_py(), cache, wide=True)
                at, f, of = positions(words)
                k = np.flatnonzero(np.isin(at, batch.column(2)[i].values.to_numpy()))
                lo, hi = np.searchsorted(of, k, "left"), np.searchsorted(of, k, "right")  # a later window's position is no earlier one
                short = np.append(words.astype("<u2"), np.zeros(BEYOND, dtype="<u2"))
                beyond = np.lib.stride_tricks.sliding_window_view(short, BEYOND)[at[k] + REACH]
                bounds = np.concatenate([[0], np.cumsum(hi - lo)])
                w = window_hashes(words)[np.repeat(lo - bounds[:-1], hi - lo) + np.arange(bounds[-1])]
                same = [pa.array([batch.column(c)[i].as_py()] * len(k), batch.schema.types[c]) for c in (0, 1)]
                columns = [pa.array(at[k], pa.int32()), pa.array(f[k]), pa.array([x.tobytes() for x in beyond], pa.binary()), pa.array(lo, pa.int32())]
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(w, pa.int64()))
                yield pa.RecordBatch.from_arrays([*same, *columns, lists], names=["u", "id", "at", "f", "beyond", "s", "w"])

    kind = hits.schema["id"].dataType.simpleString()
    return hits.select("u", "id", "at", "text").mapInArrow(run, f"u binary, id {kind}, at int, f long, beyond binary, s int, w array<long>")


def _matched(suffixes: DataFrame) -> DataFrame:
    """u, id, s and w of the sorted suffixes' windows that end within what a neighbour has in common with the suffix."""

    def common(f: np.ndarray, beyond: np.ndarray) -> np.ndarray:
        """Words that each suffix shares with the next, MIN_WORDS at most; 0 stands for fewer than REACH."""
        differ = np.column_stack([beyond[1:] != beyond[:-1], np.ones(len(f) - 1, dtype=bool)])
        return np.where(f[1:] == f[:-1], REACH + differ.argmax(axis=1), 0)

    def run(batches):
        import pyarrow as pa

        def trimmed(rows, reach: np.ndarray):
            at, s = (rows.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in (2, 5))
            size = np.diff(rows.column(6).offsets.to_numpy().astype(np.int64))
            keep = np.clip(at + reach - MIN_WORDS - s + 1, 0, size)
            first = np.cumsum(size) - size
            w = rows.column(6).flatten().to_numpy(zero_copy_only=False)[(np.arange(size.sum()) - np.repeat(first, size)) < np.repeat(keep, size)]
            some = pa.array(keep > 0)
            bounds = np.concatenate([[0], np.cumsum(keep[keep > 0])])
            lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(w, pa.int64()))
            return pa.RecordBatch.from_arrays([*(rows.column(c).filter(some) for c in (0, 1, 5)), lists], names=["u", "id", "s", "w"])

        last, before = None, MIN_WORDS  # the row whose next isn't known yet, and what it shares with the one before it
        for batch in batches:
            if not batch.num_rows:
                continue
            if last is not None:
                batch = pa.Table.from_batches([last, batch]).combine_chunks().to_batches()[0]
            f = batch.column(3).to_numpy(zero_copy_only=False)
            beyond = np.frombuffer(b"".join(batch.column(4).to_pylist()), dtype="<u2").reshape(-1, BEYOND)
            n = batch.num_rows
            after = common(f, beyond)
            both = np.maximum(np.concatenate([[before], after[:-1]]), after) if n > 1 else after
            if n > 1:
                yield trimmed(batch.slice(0, n - 1), both)
                before = after[-1]
            last = batch.slice(n - 1, 1)
        if last is not None:
            yield trimmed(last, np.array([MIN_WORDS]))

    kind = suffixes.schema["id"].dataType.simpleString()
    return suffixes.sort("f", "beyond", "u", "at").mapInArrow(run, f"u binary, id {kind}, s int, w array<long>")


def _spans(found: DataFrame) -> DataFrame:
    """u, repeated and removed from u and x, the list of a text's repeated windows: (s, gone, first)."""

    def run(batches):
        import pyarrow as pa

        def union(s, same) -> list[tuple[int, int]]:
            """(first, last) index of the windows that touch one another and have the same first document."""
            cuts = np.flatnonzero((np.diff(s) > MIN_WORDS) | (np.diff(same) != 0)) + 1
            return list(zip([0, *cuts.tolist()], [*(cuts - 1).tolist(), len(s) - 1])) if len(s) else []

        for batch in batches:
            out: list[list] = [[], []]
            for i in range(batch.num_rows):
                x = batch.column(1)[i].values
                order = np.argsort(x.field("s").to_numpy(), kind="stable")
                s, gone = x.field("s").to_numpy()[order], x.field("gone").to_numpy(zero_copy_only=False)[order]
                out[0].append([{"start": int(s[a]), "end": int(s[b]) + MIN_WORDS} for a, b in union(s, np.zeros(len(s), dtype=np.int8))])
                first = x.field("first").take(pa.array(order[gone])).dictionary_encode("encode")
                s = s[gone]
                code = first.indices.to_numpy(zero_copy_only=False)
                out[1].append([{"start": int(s[a]), "end": int(s[b]) + MIN_WORDS, "first": first[a].as_py()} for a, b in union(s, code)])
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(out, to))], names=["u", "repeated", "removed"])

    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import StructType

    kind = found.schema["x"].dataType.elementType["first"].dataType.simpleString()
    schema = StructType.fromDDL(f"u binary, repeated array<struct<start:int,end:int>>, removed array<struct<start:int,end:int,first:{kind}>>")
    to = [to_arrow_type(f.dataType) for f in schema.fields[1:]]
    return found.select("u", "x").mapInArrow(run, schema)


def passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per distinct text that repeats anything: u (md5 of the text), first_id, copies, n, repeated and removed.

    ``repeated``: (start, end) in words of the passages that another place of the corpus holds too; ``removed``: those that an earlier
    document (by id, then text) holds, with that document's id.  A text's further copies are not rows: all their words are repeated.
    """
    rows = cut(_anchors(docs, id_col, text_col), "passage-rows")
    texts = rows.groupBy("u").agg(*_first("_id"), F.first("n").alias("n"), F.first("at").alias("at"), F.first("f").alias("f"), F.first("later").alias("later"), F.first("own").alias("own")).withColumnRenamed("_first_id", "id")
    texts = cut(texts, "passage-texts")
    each = texts.select("u", "id", F.explode(F.arrays_zip("at", "f")).alias("x")).select("u", "id", F.col("x.at").alias("at"), F.col("x.f").alias("f"))
    often = each.groupBy("f").agg(F.count("*").alias("k")).filter("k > 1").select("f")
    hits = each.join(often, "f").groupBy("u", "id").agg(F.collect_list("at").alias("at"))  # bounded by the text
    hits = cut(hits, "passage-hits")
    source = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("u", F.unhex(F.md5("text")))
    found = source.join(hits, (source["u"] == hits["u"]) & source["id"].eqNullSafe(hits["id"])).select(source["u"], source["id"], "at", "text")
    # rows equal in id and text are in one partition already
    suffixes = cut(_suffixes(found.dropDuplicates(["u", "id"])), "passage-suffixes")
    windows = cut(_matched(suffixes), "passage-windows")
    windows = windows.select("u", "id", "s", F.posexplode("w").alias("i", "w")).select("u", "id", (F.col("s") + F.col("i")).alias("s"), "w")
    lead = windows.groupBy("w").agg(F.count("*").alias("k"), F.min(F.struct(F.col("id").isNotNull().alias("k"), "id", "u")).alias("lead")).filter("k > 1")
    shared = windows.join(lead, "w").select("u", F.struct("s", (F.col("u") != F.col("lead.u")).alias("gone"), F.col("lead.id").alias("first")).alias("x"))
    gathered = _spans(shared.groupBy("u").agg(F.collect_list("x").alias("x")))  # bounded by the text
    # with what the text repeats of itself
    kind = texts.schema["id"].dataType.simpleString()
    none = F.array().cast("array<struct<start:int,end:int>>")
    kept = F.array().cast(f"array<struct<start:int,end:int,first:{kind}>>")
    own = F.transform("later", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.col("id").alias("first")))
    rows = texts.select("u", "id", "copies", "n", "later", "own").join(gathered, "u", "left")
    rows = rows.withColumn("repeated", F.concat(F.coalesce("repeated", none), "own")).withColumn("removed", F.concat(F.coalesce("removed", kept), own))
    return rows.filter(F.size("repeated") > 0).select("u", "id", "copies", "n", "repeated", "removed")


def _first(id_col: str) -> list:
    """Aggregates of a text's rows: its least id (null before all others) and how many rows there are."""
    least = F.min(F.struct(F.col(id_col).isNotNull().alias("k"), F.col(id_col).alias("i")))["i"]
    return [least.alias("_first_id"), F.count("*").alias("copies")]


def _union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [(a, b) for a, b in out]


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the words of ``spans`` and the white space after them; trailing white space that is left over goes too."""
    if not spans:
        return text
    starts = [m.start() for m in _word.finditer(text)]
    out, at = [], 0
    for lo, hi in _union(spans):
        out.append(text[at : starts[lo]])
        at = starts[hi] if hi < len(starts) else len(text)
    out.append(text[at:])
    return "".join(out).rstrip() if at == len(text) else "".join(out)


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """A row per row of ``docs``: id, n_words, n_repeated, n_removed, repeated and removed spans (in words), seen_in (ids of the documents
    that keep what is removed) and with ``with_text`` the text without the removed words.

    A passage is ``MIN_WORDS`` words or more.  Of its places the first document, by id and then text, keeps it.  Null or empty text, or a
    text shorter than a passage: no spans.  Null ids come first in the order.  Repeated rows and copies: all but the row with the least id
    lose the whole text if it is as long as a passage; of rows with equal id and text one is first.  A passage twice in one text: the
    earlier place keeps it.  Empty table: no rows.  Whole texts are read.  Other columns are ignored, whatever their names.
    """
    found = cut(passages(docs, id_col, text_col), "passages")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("_id"), F.unhex(F.md5(text)).alias("u"), F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).alias("n"), *[text.alias("_text")] * with_text)
    # copies: a row counts as first if its id is the text's least; of rows equal in id and text, any one
    firsts = docs.select(F.col(id_col).alias("_id"), F.unhex(F.md5(text)).alias("u")).groupBy("u").agg(*_first("_id"))
    rows = rows.withColumn("_nth", F.row_number().over(Window.partitionBy("u", "_id").orderBy("n"))).join(firsts, "u")
    rows = rows.join(found.select("u", "repeated", "removed"), "u", "left")
    copy = ((F.col("_nth") > 1) | ~F.col("_id").eqNullSafe(F.col("_first_id"))) & (F.col("n") >= MIN_WORDS)
    whole = F.array(F.struct(F.lit(0).alias("start"), F.col("n").cast("int").alias("end")))
    nothing = F.array().cast("array<struct<start:int,end:int>>")
    rows = rows.withColumn("repeated", F.when((F.col("copies") > 1) & (F.col("n") >= MIN_WORDS), whole).otherwise(F.coalesce("repeated", nothing)))
    rows = rows.withColumn("_cut", F.when(copy, whole).otherwise(F.coalesce(F.transform("removed", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))), nothing)))
    seen = F.when(copy, F.array("_first_id")).otherwise(F.coalesce(F.array_sort(F.array_distinct(F.transform("removed", lambda x: x["first"]))), F.array().cast("array<bigint>")))
    rows = rows.withColumn("seen_in", seen)

    def setup():
        def make(texts):
            out: list[list] = [[], [], [], []] + [[]] * 0
            lines = []
            for t in texts:
                rep, gone = (_union([(x["start"], x["end"]) for x in t[k]]) for k in ("repeated", "_cut"))
                out[0].append(sum(b - a for a, b in rep))
                out[1].append(sum(b - a for a, b in gone))
                out[2].append([{"start": a, "end": b} for a, b in rep])
                out[3].append([{"start": a, "end": b} for a, b in gone])
                if with_text:
                    lines.append(without(t["_text"], gone))
            return list(range(len(texts))), [*out, lines] if with_text else out

        return make

    packed = F.struct("repeated", "_cut", *["_text"] * with_text)
    spans = "array<struct<start:int,end:int>>"
    fields = f"n_repeated long, n_removed long, repeated {spans}, removed {spans}" + ", text string" * with_text
    keep = [F.col("_id"), F.col("n").cast("long").alias("n_words"), F.col("seen_in")]
    out = map_texts(rows, keep, packed.alias("_t"), setup, fields)
    return out.select(F.col("_id").alias(id_col), "n_words", "n_repeated", "n_removed", "repeated", "removed", "seen_in", *[F.col("text").alias("clean_text")] * with_text)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """``docs`` with the text of each row cut to what no earlier document holds; rows of which nothing is left go.

    The columns stay as they are, and ``chars_col``, if there is one, follows the new text.  Texts without words stay.
    """
    names = docs.columns
    found = cut(passages(docs, id_col, text_col), "passages")
    at = {c: f"c{i}" for i, c in enumerate(names)}
    text = F.coalesce(F.col(at[text_col]), F.lit(""))
    rows = docs.select(*[F.col(c).alias(at[c]) for c in names]).withColumn("_u", F.unhex(F.md5(text)))
    firsts = rows.groupBy("_u").agg(*_first(at[id_col]))
    rows = rows.join(firsts.filter("copies > 1"), "_u", "left")
    rows = rows.join(found.filter(F.size("removed") > 0).select(F.col("u").alias("_u"), F.transform("removed", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))).alias("_gone")), "_u", "left")
    n = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+"))
    alone = rows.filter(F.col("copies").isNull() | (n < MIN_WORDS))
    copies = rows.filter(F.col("copies").isNotNull() & (n >= MIN_WORDS) & F.col(at[id_col]).eqNullSafe(F.col("_first_id"))).dropDuplicates(["_u"])
    rows = alone.unionByName(copies)
    same = rows.filter(F.col("_gone").isNull())
    changed = rows.filter(F.col("_gone").isNotNull())

    def setup():
        def make(texts):
            out, kept = [], []
            for i, t in enumerate(texts):
                new = without(t["t"], [(x["start"], x["end"]) for x in t["g"]])
                if new.split():
                    kept.append(i)
                    out.append(new)
            return kept, [out]

        return make

    others = [c for c in names if c != text_col]
    packed = F.struct(F.col(at[text_col]).alias("t"), F.col("_gone").alias("g"))
    changed = map_texts(changed, [F.col(at[c]) for c in others], packed.alias("_t"), setup, f"{at[text_col]} string")
    if chars_col in names:
        changed = changed.withColumn(at[chars_col], F.length(at[text_col]).cast(docs.schema[chars_col].dataType))
    return same.select(*at.values()).unionByName(changed.select(*at.values())).toDF(*names)
