"""Best-fit packing of documents into token sequences by exact-complement hashing.

Documents become pieces of at most ``capacity`` tokens.  What fits together depends only on lengths, and there are at most ``capacity``
different ones, so the plan is made on the driver from a count for each length, however many documents there are: for the longest length
left, an index of single lengths, pair sums and triple sums gives a combination that fills the gap exactly, used as often as the counts
allow; what finds no exact complement is packed best fit.  The plan is a list of ranges of ranks within a length; executors give each
piece its rank and look its place up.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shardwell.llm._common import cut, trim

#: Pieces of one length that are ranked in one window group.
GROUP = 1000
#: Distinct parts of words whose ids a worker keeps in a task at most, and from one task to the next.
PARTS, KEPT = 600_000, 100_000
#: Bytes of texts that are encoded together (or one longer text).
TOGETHER = 8_000_000


#: ASCII signs and digits, which the tokenizer cuts from letters.
SIGNS = "".join(c for c in map(chr, range(33, 127)) if not c.isalpha())
#: Of a worker: tokenizer and encoded parts by the path of the vocabulary.
_kept: dict[str, tuple] = {}


def word_bpe() -> str:
    """The vocabulary that the query uses; any ``tokenizers`` file whose ids don't reach across ASCII white space will do."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def forget(known: dict, most: int) -> None:
    """Keep the ``most`` entries that came first."""
    for k in list(known)[most:]:
        del known[k]


def encoder(path: str):
    """Function from an Arrow array of texts to (ids of all, where each text's ids start and the last ones end).

    The tokenizer lowers case, drops white space and never joins what it separates, and it cuts between letters and ASCII signs.  So a
    text's ids are those of its words in turn, and a word's are those of its letters and of the signs and digits after them.  Arrow splits
    the texts and numbers the distinct words; each distinct part is encoded once while it stays in the cache, many in one call with a token
    that stands for itself between (a digit, where all are letters, else the end token); the words' ids are then put in the order of the texts.
    """
    import pyarrow as pa
    import pyarrow.compute as pc
    import tokenizers

    # a worker that is used again keeps its tokenizer and the parts that it met first, which frequent ones are among
    if path not in _kept:
        _kept.clear()
        _kept[path] = (tokenizers.Tokenizer.from_file(path), {})
    tok, parts = _kept[path]
    forget(parts, KEPT)
    mark, mark_id = "<|endoftext|>", tok.token_to_id("<|endoftext|>")

    zero = tok.token_to_id("0")
    letters_end = zero is not None and tok.encode("a0b", add_special_tokens=False).ids == [tok.token_to_id(c) for c in "a0b"]

    def learn(new: list[str]) -> None:
        # a digit is a token of its own between letters, and quicker to find than the end token
        letters = [p for p in new if p.isalpha()] if letters_end else []
        plain = [p for p in new if "<|" not in p and not (letters_end and p.isalpha())]
        for all_, between, between_id in ((letters, "0", zero), (plain, mark, mark_id)):
            batch = [all_[i : i + 200] for i in range(0, len(all_), 200)]
            for some, e in zip(batch, tok.encode_batch_fast([between.join(b) for b in batch], add_special_tokens=False)):
                ids = np.array(e.ids, dtype="<u4")
                cuts = np.flatnonzero(ids == between_id) * 4
                assert len(cuts) == len(some) - 1
                raw = ids.tobytes()
                for p, lo, hi in zip(some, [0, *(cuts + 4).tolist()], [*cuts.tolist(), len(raw)]):
                    parts[p] = raw[lo:hi]
        for p in new:
            if "<|" in p:
                parts[p] = np.array(tok.encode(p, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def known(some) -> list[bytes]:
        """Ids of each of these distinct parts, an Arrow array."""
        if len(parts) > PARTS:
            forget(parts, PARTS // 2)
        some = some.to_pylist()
        out = list(map(parts.get, some))
        new = [p for p, x in zip(some, out) if x is None]
        if new:
            learn(new)
            out = list(map(parts.__getitem__, some))
        return out

    def ids_of(words):
        """Ids of each word as bytes, an Arrow array: those of its letters and of the signs at its end, if it has no more than these."""
        heads = pc.ascii_rtrim(words, SIGNS)
        # the small letter of U+0130 ends in a mark, which belongs to a sign after it
        cuts = pc.and_(pc.utf8_is_alpha(heads), pc.invert(pc.match_substring_regex(words, "<\\||\u0130")))
        heads = pc.if_else(cuts, heads, words)
        length = (pc.binary_length(words).to_numpy() - pc.binary_length(heads).to_numpy()).astype(np.int64)
        coded = heads.dictionary_encode()
        out = pa.array(known(coded.dictionary), pa.large_binary()).take(coded.indices)
        ends, of = [b""], np.zeros(len(words), dtype=np.int64)
        for k in np.unique(length[length > 0]).tolist():
            at = np.flatnonzero(length == k)
            coded = pc.utf8_slice_codeunits(words.take(pa.array(at)), -k).dictionary_encode()
            of[at] = len(ends) + coded.indices.to_numpy(zero_copy_only=False)
            ends += known(coded.dictionary)
        return pc.binary_join_element_wise(out, pa.array(ends, pa.large_binary()).take(pa.array(of)), pa.scalar(b"", pa.large_binary()))

    def encode(texts) -> tuple[np.ndarray, np.ndarray]:
        # taken, not sliced: Arrow's lower case reads a slice's offsets wrongly
        texts = pc.fill_null(texts.cast(pa.large_string()), "").take(pa.array(np.arange(len(texts))))
        # a special token is one only as it is written: such texts keep their case, which the tokenizer lowers elsewhere
        texts = pc.if_else(pc.match_substring(texts, "<|"), texts, pc.ascii_lower(texts))
        for c in "\t\n\x0b\x0c\r":
            texts = pc.replace_substring(texts, c, " ")
        split = pc.split_pattern(texts, " ")
        coded = split.flatten().dictionary_encode()
        flat = ids_of(coded.dictionary).take(coded.indices)  # Arrow puts the words' ids in a row
        upto = np.frombuffer(flat.buffers()[1], np.int64, len(flat) + 1) // 4
        bounds = np.concatenate([[0], np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False))])
        return np.frombuffer(flat.buffers()[2] or b"", "<u4")[: upto[-1]], upto[bounds]

    return encode


def pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, id_col: str, text_col: str, keep_ids: bool = False) -> DataFrame:
    """A row per piece: _id, piece, start, length, ids_crc32 (and ids)."""
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids

    def run(batches):
        import os

        import pyarrow as pa
        import pyarrow.compute as pc

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        encode, end = encoder(tokenizer), np.uint32(end_id).astype("<u4").tobytes()
        for batch in batches:
            size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            lo = 0
            while lo < batch.num_rows:
                hi = max(lo + 1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + TOGETHER, "right")))
                part, lo = batch.slice(lo, hi - lo), hi
                ids, bounds = encode(part.column(1))
                at: list[int] = []
                out: list[list] = [[] for _ in names[1:]]
                for i, (first, last) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
                    total = last - first + 1  # with the end
                    for n, start in enumerate(range(0, total, capacity)):
                        some, ends = ids[first + start : min(first + start + capacity, last)], start + capacity >= total
                        at.append(i)
                        crc = zlib.crc32(some)
                        for column, v in zip(out, (n, start, len(some) + ends, zlib.crc32(end, crc) if ends else crc)):
                            column.append(v)
                        if keep_ids:
                            out[4].append(np.append(some, np.uint32(end_id)) if ends else some)
                types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, t) for c, t in zip(out, types))], names=names)
        batch = part = ids = bounds = some = None
        forget(_kept[tokenizer][1], KEPT)
        trim()

    fields = f"_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids
    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(run, fields)


class _Plan:
    """Patterns of lengths with how often each is used, kept as ranges of ranks per length."""

    def __init__(self) -> None:
        self.next = 0
        self.used: dict[int, int] = {}
        self.ranges: list[tuple[int, int, int, int, int, int]] = []

    def use(self, lengths: list[tuple[int, int]], times: int) -> None:
        """``lengths``: (length, how many in the sequence)."""
        at = 0
        for length, k in lengths:
            first = self.used.get(length, 0)
            self.ranges.append((length, first, times * k, k, self.next, at))
            self.used[length] = first + times * k
            at += length * k
        self.next += times


def plan_sequences(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """(ranges, sequences).  A range: length, first rank, ranks, pieces a sequence, first sequence, offset.

    Exact complements first, from the longest length down: a single length equal to the gap, then a pair, then a triple; each is used as
    often as the counts allow, until no available lengths make up the gap.  Then best fit: each length left, from the longest, goes to the open sequences with the smallest gap that
    takes it.
    """
    c = np.zeros(capacity + 1, dtype=np.int64)
    for k, v in counts.items():
        c[k] += v
    plan, out = _Plan(), []

    def take(*lengths: int) -> bool:
        need: dict[int, int] = {}
        for x in lengths:
            need[x] = need.get(x, 0) + 1
        times = min(int(c[x]) // k for x, k in need.items())
        if times <= 0:
            return False
        for x, k in need.items():
            c[x] -= times * k
        plan.use(sorted(need.items(), reverse=True), times)
        return True

    def pair(gap: int, most: int) -> tuple[int, int] | None:
        """Two available lengths that make up the gap, the longer as long as can be."""
        b = np.arange(min(gap - 1, most), (gap - 1) // 2, -1)
        if not len(b):
            return None
        ok = np.flatnonzero((c[b] > 0) & (c[gap - b] > np.where(2 * b == gap, 1, 0)))
        return (int(b[ok[0]]), int(gap - b[ok[0]])) if len(ok) else None

    def triple(gap: int, most: int) -> tuple[int, int, int] | None:
        """Three available lengths that make up the gap, the longest as long as can be: every available one is tried.

        Bit x of an integer says whether x is available, so one shift and one AND tell whether any two make up what is left.
        """
        there = c > 0
        bits = int.from_bytes(np.packbits(there, bitorder="little").tobytes(), "little")
        mirrored = int.from_bytes(np.packbits(there[::-1], bitorder="little").tobytes(), "little")  # bit x: capacity - x
        for a in (np.flatnonzero(there[: max(0, min(gap - 2, most) + 1)])[::-1]).tolist():
            if 3 * a < gap:
                break
            if bits & (mirrored >> (capacity - gap + a)):
                c[a] -= 1
                found = pair(gap - a, a)
                c[a] += 1
                if found:
                    return (a, *found)
        return None

    if c[capacity]:
        take(capacity)
    for length in range(capacity - 1, 0, -1):
        while c[length] > 0:  # single and pair complements
            gap = capacity - length
            if gap <= length and c[gap] > (gap == length) and take(length, gap):
                continue
            c[length] -= 1  # the piece itself is not available for its own gap
            found = pair(gap, length)
            c[length] += 1
            if found and take(length, *found):
                continue
            break
        gap, most = capacity - length, length
        while c[length] > 0:  # triples: the longest of the three first
            c[length] -= 1
            found = triple(gap, most)
            c[length] += 1
            if not found:
                break
            take(length, *found)
            most = found[0]  # longer ones found nothing, and less is available now
    # best fit of the rest: open sequences by gap; each entry is (pieces so far, how many such sequences)
    open_: dict[int, list[tuple[tuple[tuple[int, int], ...], int]]] = {}
    gaps = np.zeros(capacity + 1, dtype=bool)

    def put(gap: int, entry) -> None:
        open_.setdefault(gap, []).append(entry)
        gaps[gap] = True

    for length in range(capacity, 0, -1):
        n = int(c[length])
        while n > 0:
            fits = np.flatnonzero(gaps[length:])
            if len(fits):
                gap = length + int(fits[0])
                have, times = open_[gap].pop()
                if not open_[gap]:
                    gaps[gap] = False
                k = min(gap // length, n)
                use = min(times, n // k)
                if use < times:
                    put(gap, (have, times - use))
                put(gap - k * length, ((*have, (length, k)), use))
                n -= use * k
            else:
                k = min(capacity // length, n)
                use = n // k
                put(capacity - k * length, (((length, k),), use))
                n -= use * k
    for entries in open_.values():
        for have, times in entries:
            plan.use(list(have), times)
    out = plan.ranges
    return out, plan.next


def place(parts: DataFrame, capacity: int) -> DataFrame:
    """``parts`` (with _id, piece, ids_crc32, length) plus sequence_id and offset."""
    spark = parts.sparkSession
    counts = {int(r[0]): int(r[1]) for r in parts.groupBy("length").count().collect()}  # at most `capacity` rows
    ranges, _ = plan_sequences(counts, capacity)
    groups = spark.createDataFrame([(k, -(-v // GROUP)) for k, v in counts.items()] or [(0, 1)], "length long, _groups long")
    rows = parts.join(F.broadcast(groups), "length")  # at most `capacity` rows
    rows = rows.withColumn("_b", F.pmod(F.xxhash64("_id", "piece", "ids_crc32"), F.col("_groups")))
    sizes = rows.filter("_groups > 1").groupBy("length", "_b").agg(F.count("*").alias("_in"))
    below = Window.partitionBy("length").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_from", F.coalesce(F.sum("_in").over(below), F.lit(0))).drop("_in")
    rank = F.row_number().over(Window.partitionBy("length", "_b").orderBy("_id", "piece", "ids_crc32"))
    rows = rows.withColumn("_rank", rank).join(sizes, ["length", "_b"], "left")
    rows = rows.withColumn("_rank", F.col("_rank") - 1 + F.coalesce(F.col("_from"), F.lit(0))).drop("_b", "_groups", "_from")
    by = np.array(sorted(ranges) or [(0, 0, 0, 1, 0, 0)], dtype=np.int64)
    starts = np.searchsorted(by[:, 0], np.arange(capacity + 2))
    lookup = spark.sparkContext.broadcast((by, starts))  # some ranges a length: bounded by the capacity, not by the documents

    from pyspark.sql.functions import pandas_udf

    @pandas_udf("struct<sequence_id:long,offset:long>")
    def found(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        by, starts = lookup.value
        length, rank = length.to_numpy(), rank.to_numpy()
        row = np.empty(len(length), dtype=np.int64)
        for x in np.unique(length):
            mine = length == x
            lo, hi = starts[x], starts[x + 1]
            row[mine] = lo + np.searchsorted(by[lo:hi, 1], rank[mine], side="right") - 1
        r = by[row]
        nth = rank - r[:, 1]
        return pd.DataFrame({"sequence_id": r[:, 4] + nth // r[:, 3], "offset": r[:, 5] + nth % r[:, 3] * r[:, 0]})

    return rows.withColumn("_at", found("length", "_rank")).withColumn("sequence_id", F.col("_at.sequence_id")).withColumn("offset", F.col("_at.offset")).drop("_at", "_rank")


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Place every document in sequences of at most ``capacity`` tokens.

    A row per piece: id, piece, start, length, ids_crc32, sequence_id, offset, and with ``keep_ids`` the ids.  Only documents longer than
    ``capacity`` are cut; all but their last piece are full.

    Null or empty text: one piece that holds the end id alone.  Null ids and repeated rows: each row is packed.  Ties: pieces of one length
    are ranked by id, piece and checksum; equal ones are alike.  Empty table: no rows.  Other columns are ignored, whatever their names.
    """
    parts = cut(pieces(docs, tokenizer or word_bpe(), capacity, end_id, id_col, text_col, keep_ids), "pack-pieces")
    out = place(parts, capacity)
    return out.select(F.col("_id").alias(id_col), "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *["ids"] * keep_ids)
