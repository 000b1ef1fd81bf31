"""Language model scores by Katz backoff over n-grams.

Counts are discounted by Good-Turing up to ``KEEP``, with counts of counts smoothed by a log-linear fit, so that every factor lies between 0
and 1; the mass that a history frees goes to the next lower order's model of the words that never followed it, through a weight that makes
the history's probabilities sum to one exactly.  The unigram model in turn leaves its Good-Turing mass to one class of unknown words, so
that it sums to one over the training words and that class.  Probabilities are evaluated recursively, from the unigrams up, for each
n-gram of a text.

Texts become blocks of tokens.  A block's distinct n-grams travel to the shard of their key, packed and with their counts (so a very
frequent n-gram costs a row a block), the shard adds them up, and each block gets the corpus counts of its own n-grams back in the same
order: no keys on the way back, and the tables, partitioned by order and shard, are read once.  One block owns each n-gram and adds it to
its history's sums, which go the same way.  A block's n-grams are sent once however many shards there are, so what moves grows with the
text; a shard merges its pieces one after the other and holds its distinct n-grams only.
"""

from __future__ import annotations

import json
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardwell.llm._common import cut_by, fold, mix

#: Tokens of a block, tokens of a shard (about), greatest discounted count, and order of the model.
BLOCK, SHARD, KEEP, ORDER = 600_000, 2_000_000, 5, 2
#: Keys of the end token, which is also the history of a text's first word, and of the longer history that every text starts with.
END, START = 0, 1


def tokens(text: str | None) -> list[bytes]:
    """Words with A-Z in lower case."""
    return (text or "").encode("utf-8", "replace").lower().split()


def longer(history: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Keys of histories that go on with a word."""
    return np.maximum(mix(mix(history) * np.uint64(0xD6E8FEB86659FD93) + word), np.uint64(START + 1))


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays of one length, by planes of bytes, compressed."""
    planes = [np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T).tobytes() for a in arrays]
    return zlib.compress(b"".join(planes), 1)


def _unpack(data: bytes, *kinds: str) -> list[np.ndarray]:
    raw = np.frombuffer(zlib.decompress(data), np.uint8)
    sizes = [np.dtype(k).itemsize for k in kinds]
    n, at, out = len(raw) // sum(sizes), 0, []
    for k, size in zip(kinds, sizes):
        out.append(np.ascontiguousarray(raw[at : at + n * size].reshape(size, n).T).view(k).reshape(n))
        at += n * size
    return out


def _gaps(keys: np.ndarray) -> np.ndarray:
    return np.diff(keys, prepend=keys.dtype.type(0))


def _shard(keys: np.ndarray, shards: int) -> np.ndarray:
    """Rising with the key, so that sorted keys of a shard are neighbours."""
    return ((keys >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def _sliced(keys: np.ndarray, shards: int) -> list[tuple[int, slice]]:
    of = _shard(keys, shards)
    cuts = np.flatnonzero(np.diff(of)) + 1
    edges = [0, *cuts.tolist(), len(keys)]
    return [(int(of[a]), slice(a, b)) for a, b in zip(edges, edges[1:]) if b > a]


@dataclass
class _Grams:
    """Distinct n-grams of a block by key: ``back``, the n-gram that ends at each token; ``history``, the place of each one's history and
    ``shorter``, of the n-gram without the first word, among those of the order below; ``at``, a token that each ends at (none: -1)."""

    keys: np.ndarray
    back: np.ndarray
    history: np.ndarray | None
    shorter: np.ndarray | None
    at: np.ndarray


class _Block:
    """Tokens of some texts: ids in the block's vocabulary (sorted by key; an end after each text) and the texts' lengths."""

    def __init__(self, vocabulary: np.ndarray, ids: np.ndarray, lengths: np.ndarray, train: np.ndarray) -> None:
        self.vocabulary, self.ids, self.lengths, self.train = vocabulary, ids, lengths, train
        self.starts = np.cumsum(lengths) - lengths
        self.end = int(np.searchsorted(vocabulary, np.uint64(END)))
        self.in_train = np.repeat(train, lengths)

    def grams(self, most: int) -> list[_Grams]:
        """Distinct n-grams of the orders 1 to ``most``; below the greatest, those of two words or more hold what every text starts with."""
        out = [_Grams(self.vocabulary, self.ids, None, None, np.full(len(self.vocabulary), -1))]
        out[0].at[self.ids] = np.arange(len(self.ids))
        start = self.end
        for n in range(2, most + 1):
            last = out[-1]
            before = np.empty(len(self.ids), dtype=np.int64)
            before[1:] = last.back[:-1]
            before[self.starts] = start
            values, back = np.unique(before * len(self.vocabulary) + self.ids, return_inverse=True)
            history, word = values // len(self.vocabulary), values % len(self.vocabulary)
            keys = longer(last.keys[history], self.vocabulary[word])
            if n < most:
                keys = np.append(keys, np.uint64(START))
            order = np.argsort(keys, kind="stable")
            place = np.empty_like(order)
            place[order] = np.arange(len(order))
            back = place[back]
            at = np.full(len(keys), -1)
            at[back] = np.arange(len(back))
            shorter = np.where(at >= 0, last.back[at], start)
            gram = _Grams(keys[order], back, before[at], shorter, at)
            out.append(gram)
            if n < most:
                start = int(np.searchsorted(gram.keys, np.uint64(START)))
        return out

    def counts(self, gram: _Grams) -> np.ndarray:
        """Training counts; what every text starts with is counted once a text."""
        out = np.bincount(gram.back[self.in_train], minlength=len(gram.keys)).astype(np.uint32)
        out[gram.at < 0] = int(self.train.sum())
        return out

    def dump(self) -> bytes:
        """Vocabulary, ids by planes of bytes, lengths and the training marks, each compressed."""
        small = np.dtype("<u2") if len(self.vocabulary) < 2**16 else np.dtype("<u4")
        parts = [_pack(_gaps(self.vocabulary)), _pack(self.ids.astype(small)), _pack(self.lengths.astype("<i8")), _pack(self.train.astype("u1"))]
        return json.dumps([small.str, *map(len, parts)]).encode() + b"\n" + b"".join(parts)

    @classmethod
    def load(cls, data: bytes) -> _Block:
        head, _, rest = data.partition(b"\n")
        small, *sizes = json.loads(head)
        at = np.cumsum([0, *sizes])
        v, ids, lengths, train = (_unpack(rest[a:b], k)[0] for a, b, k in zip(at, at[1:], ("<u8", small, "<i8", "u1")))
        return cls(np.cumsum(v, dtype=np.uint64), ids.astype(np.int64), lengths, train.astype(bool))


def _blocks(docs: DataFrame, id_col: str, text_col: str, mod: int, held: int) -> DataFrame:
    """block, data and ids of each block of texts."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        import pyarrow as pa
        import xxhash
        from collections import defaultdict
        from pyspark import TaskContext

        part, made = TaskContext.get().partitionId(), 0

        def fresh():
            words: defaultdict = defaultdict()
            words.default_factory = words.__len__
            return words, [], [], [], []

        def row(words, ids, lengths, train, names, kind):
            nonlocal made
            number = (part << 24) + made
            made += 1
            keys = np.fromiter((END if w is None else max(START + 1, xxhash.xxh64_intdigest(w)) for w in words), np.uint64, len(words))
            order = np.argsort(keys, kind="stable")
            place = np.empty(len(order), dtype=np.int64)
            place[order] = np.arange(len(order))
            block = _Block(keys[order], place[np.concatenate(ids)], np.array(lengths, dtype=np.int64), np.array(train, dtype=bool))
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([block.dump()], pa.binary()), pa.array([names], pa.list_(kind))], names=["block", "data", "ids"])

        words, ids, lengths, train, names = fresh()
        total, kind_ = 0, None
        for batch in batches:
            kind_ = batch.schema.field(0).type
            for i in range(batch.num_rows):
                t = tokens(batch.column(2)[i].as_py())
                ids.append(np.fromiter(map(words.__getitem__, [*t, None]), np.int32, len(t) + 1))
                lengths.append(len(t) + 1)
                train.append(not batch.column(1)[i].as_py())
                names.append(batch.column(0)[i].as_py())
                total += len(t) + 1
                if total >= BLOCK:
                    yield row(words, ids, lengths, train, names, kind_)
                    words, ids, lengths, train, names = fresh()
                    total = 0
        if lengths:
            yield row(words, ids, lengths, train, names, kind_)

    src = docs.select(F.col(id_col).alias("id"), (fold(id_col, mod) == held).alias("held"), F.col(text_col).alias("text"))
    return src.mapInArrow(run, f"block long, data binary, ids array<{kind}>")


def _counts(blocks: DataFrame, shards: int, most: int) -> DataFrame:
    """Packed training counts of each block's n-grams, by order and shard of the key."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for i in range(batch.num_rows):
                number, block = batch.column(0)[i].as_py(), _Block.load(batch.column(1)[i].as_py())
                for n, gram in enumerate(block.grams(most), 1):
                    count = block.counts(gram)
                    c = list(zip(*[(n, number, s, _pack(_gaps(gram.keys[at]), count[at])) for s, at in _sliced(gram.keys, shards)]))
                    yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int32()), pa.array(c[1], pa.int64()), pa.array(c[2], pa.int32()), pa.array(c[3], pa.binary())], names=["order", "block", "shard", "data"])

    return blocks.select("block", "data").mapInArrow(run, "order int, block long, shard int, data binary")


def _merged(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct keys, their counts) of all pieces, taken in one after the other."""
    keys, counts = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    new: list[tuple[np.ndarray, np.ndarray]] = []
    waiting = 0
    for i, data in enumerate(pieces):
        gaps, c = _unpack(data, "<u8", "<u4")
        seen = c > 0
        new.append((np.cumsum(gaps, dtype=np.uint64)[seen], c[seen].astype(np.int64)))
        waiting += len(new[-1][0])
        if waiting > max(500_000, len(keys)) or i == len(pieces) - 1:
            k, c = np.concatenate([keys, *(x[0] for x in new)]), np.concatenate([counts, *(x[1] for x in new)])
            by = np.argsort(k, kind="stable")
            k, c = k[by], c[by]
            first = np.flatnonzero(np.append(True, k[1:] != k[:-1])) if len(k) else np.zeros(0, dtype=np.int64)
            keys, counts = k[first], np.add.reduceat(c, first) if len(first) else c
            new, waiting = [], 0
    return keys, counts


def _add_counts(packed: DataFrame, most: int) -> DataFrame:
    """For each (order, block, shard): corpus counts of its n-grams, which of them it owns, and below the greatest order their numbers in the
    shard; and a row with block -1 of the shard's totals."""

    def run(key, rows):
        import pandas as pd

        rows = rows.sort_values("block")
        keys, total = _merged(list(rows["data"]))
        owned = np.zeros(len(keys), dtype=bool)
        out = []
        for block, data in zip(rows["block"], rows["data"]):
            gaps, c = _unpack(data, "<u8", "<u4")
            own_keys = np.cumsum(gaps, dtype=np.uint64)
            at = np.searchsorted(keys, own_keys)
            near = np.minimum(at, max(0, len(keys) - 1))
            seen = keys[near] == own_keys if len(keys) else np.zeros(len(at), dtype=bool)
            own = seen & (c > 0)
            own[own] = ~owned[near[own]]
            owned[near[own]] = True
            # n-grams get their number in the shard, by which the sums of what they are a history of are asked for later
            number = [_gaps(near.astype("<u4"))] if key[0] < most else []
            count = np.where(seen, total[near], 0) if len(keys) else np.zeros(len(at))
            out.append((key[0], block, key[1], _pack(count.astype("<u8"), own.astype("u1"), *number)))
        real = total[keys != START] if key[0] > 1 else total
        low = np.bincount(np.minimum(real, KEEP + 2), minlength=KEEP + 3)
        out.append((key[0], -1, key[1], json.dumps([int(real.sum()), len(real), *(int(x) for x in low[1 : KEEP + 2])]).encode()))
        return pd.DataFrame(out, columns=["order", "block", "shard", "data"])

    return packed.groupBy("order", "shard").applyInPandas(run, "order int, block long, shard int, data binary")


def discounts(n: list[int], keep: int = KEEP) -> list[float]:
    """Factor for counts 0..keep (0 unused) from n[r - 1] = number of n-grams seen r times, r up to keep + 1.

    Katz's form of Good-Turing: counts above ``keep`` are trusted.  The counts of counts are smoothed as ``a * r ** b``, fitted to their
    logarithms with their sizes as weights; any b below -1 gives factors between 0 and 1, so b is kept at -1.05 at most, and it is -2 (Zipf)
    where there are too few to fit.
    """
    r = np.array([k for k, x in enumerate(n[: keep + 1], 1) if x > 0], dtype=np.float64)
    b = -2.0
    if len(r) > 1:
        w = np.array([x for x in n[: keep + 1] if x > 0], dtype=np.float64)
        x, y = np.log(r), np.log(w)
        x, y = x - np.average(x, weights=w), y - np.average(y, weights=w)
        b = min(-1.05, float((w * x * y).sum() / (w * x * x).sum()))
    top = (keep + 1) ** (b + 1)
    return [1.0, *[(((k + 1) / k) ** (b + 1) - top) / (1 - top) for k in range(1, keep + 1)]]


def kept_counts(count: np.ndarray, d: list[float]) -> np.ndarray:
    """Discounted counts."""
    return count * np.where(count <= KEEP, np.array(d)[np.minimum(count, KEEP)], 1.0)


def _unigram(count: np.ndarray, totals: dict) -> np.ndarray:
    """Probabilities by corpus count; unknown words have what the known ones leave."""
    if not totals["n"]:
        return np.ones(len(count))
    return np.where(count > 0, kept_counts(count, totals["d"][1]) / totals["of"], totals["unknown"])


def denominators(count: np.ndarray, kept: np.ndarray) -> np.ndarray:
    """What a history's discounted counts are divided by: its count, or one more if no count was discounted, so that some mass is free."""
    return np.maximum(count, 1) + ((count > 0) & (kept > count - 1e-6))


def _gathered(rows: DataFrame) -> DataFrame:
    """What belongs to each block, bounded by its own n-grams."""
    return rows.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("order", "shard", "data"))).alias("p"))


def _pieces(parts: list, order: int, *kinds: str) -> list[tuple[int, list[np.ndarray]]]:
    """(shard, arrays) of one order, shards in turn."""
    return [(p["shard"], _unpack(p["data"], *kinds)) for p in parts if p["order"] == order]


def _joined(pieces: list[tuple[int, list[np.ndarray]]]) -> list[np.ndarray]:
    """Aligned with the block's sorted keys."""
    return [np.concatenate(x) for x in zip(*(arrays for _, arrays in pieces))]


#: Sums of a history: followers seen 1..KEEP times, followers whose n-gram without the first word is seen 1..KEEP times, and counts of the
#: other such n-grams.
SUMS = ("<u4",) * (2 * KEEP) + ("<u8",)


def _sums(full: DataFrame, most: int) -> DataFrame:
    """Per order, block and shard: numbers of the block's n-grams, and as histories their sums over the longer ones that the block owns.

    All are whole numbers, so they add up to the same in any order.
    """

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for i in range(batch.num_rows):
                r = {n: batch.column(n)[i].as_py() for n in ("block", "tokens", "p0")}
                grams = _Block.load(r["tokens"]).grams(most)
                below = _pieces(r["p0"], 1, *_KINDS)
                shorter = _joined(below)[0].astype(np.int64)
                for n in range(2, most + 1):
                    gram, pieces = grams[n - 1], _pieces(r["p0"], n, *(_KINDS if n < most else _KINDS[:2]))
                    count, own = _joined(pieces)[:2]
                    mine = np.flatnonzero(own.astype(bool) & (gram.at >= 0))
                    h, c, u = gram.history[mine], count[mine].astype(np.int64), shorter[gram.shorter[mine]]
                    v = len(grams[n - 2].keys)
                    sums = [np.bincount(h[c == k], minlength=v).astype("<u4") for k in range(1, KEEP + 1)]
                    sums += [np.bincount(h[u == k], minlength=v).astype("<u4") for k in range(1, KEEP + 1)]
                    sums.append(np.bincount(h[u > KEEP], u[u > KEEP], v).astype("<u8"))
                    out, lo = [], 0
                    for shard, (_, _, number) in below:
                        x = slice(lo, lo + len(number))
                        out.append((n - 1, r["block"], shard, _pack(number, *[a[x] for a in sums])))
                        lo += len(number)
                    c = list(zip(*out))
                    yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int32()), pa.array(c[1], pa.int64()), pa.array(c[2], pa.int32()), pa.array(c[3], pa.binary())], names=["order", "block", "shard", "data"])
                    below, shorter = pieces, count.astype(np.int64)

    return full.mapInArrow(run, "order int, block long, shard int, data binary")


#: Counts, ownership and numbers, as they come back to a block.
_KINDS = ("<u8", "u1", "<u4")


def _add_sums(packed: DataFrame, d: list[list[float]]) -> DataFrame:
    """For each order, block and shard, in the order of its keys: what discounting takes from the n-gram as a history, and the discounted
    counts of what follows it in the order below."""

    def run(key, rows):
        import pandas as pd

        got = [_unpack(data, "<u4", *SUMS) for data in rows["data"]]
        numbers = [np.cumsum(g[0], dtype=np.int64) for g in got]
        n = max(int(x[-1]) for x in numbers) + 1
        lost, lower = np.zeros(n), np.zeros(n)
        for k in range(1, len(SUMS) + 1):
            t = np.zeros(n, dtype=np.int64)
            for x, g in zip(numbers, got):
                some = g[k] > 0  # n-grams that were never seen share a number, and have no sums
                t[x[some]] += g[k][some].astype(np.int64)
            if k <= KEEP:
                lost += k * (1 - d[key[0] + 1][k]) * t
            else:
                lower += t * (k - KEEP) * d[key[0]][k - KEEP] if k <= 2 * KEEP else t
        out = [(key[0], block, key[1], _pack(lost[x], lower[x])) for block, x in zip(rows["block"], numbers)]
        return pd.DataFrame(out, columns=["order", "block", "shard", "data"])

    return packed.groupBy("order", "shard").applyInPandas(run, "order int, block long, shard int, data binary")


def _scores(full: DataFrame, totals: dict, id_type: str, most: int) -> DataFrame:
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            where = batch.schema.get_field_index("ids")
            for i in range(batch.num_rows):
                r = {n: batch.column(n)[i].as_py() for n in ("tokens", "p0", "p1")}
                block = _Block.load(r["tokens"])
                grams = block.grams(most)
                uni = count = _joined(_pieces(r["p0"], 1, *_KINDS))[0].astype(np.int64)
                p = _unigram(uni, totals)
                by = np.full(len(uni), max(totals["of"], 1))  # what an n-gram's counts are divided by, by its history's last words
                for n in range(2, most + 1):
                    gram = grams[n - 1]
                    lost, lower = _joined(_pieces(r["p1"], n - 1, "<f8", "<f8"))
                    kept = np.where(count > 0, count - lost, 0.0)
                    times = denominators(count, kept)
                    left = np.maximum(1 - kept / times, 0.0)
                    rest = 1 - lower / (by if n == 2 else by[grams[n - 2].shorter])
                    weight = np.where(count > 0, left / np.maximum(rest, 1e-300), 1.0)
                    weight = np.where((count > 0) & (rest <= 1e-12), 1.0, weight)  # a history that every word followed backs off to nothing
                    above = _joined(_pieces(r["p0"], n, *(_KINDS if n < most else _KINDS[:2])))[0].astype(np.int64)
                    p = np.where(above > 0, kept_counts(above, totals["d"][n]) / times[gram.history], weight[gram.history] * p[gram.shorter])
                    count, by = above, times
                log = np.log10(np.maximum(p, 1e-300))[grams[-1].back]
                base = np.log10((uni + 0.5) / (totals["n"] + 0.5 * (totals["v"] + 1)))[block.ids]
                known = (uni > 0)[block.ids].astype(np.int64)
                n = len(block.lengths)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(where)[i].values.cast(batch.schema.field(where).type.value_type),
                        pa.array(~block.train),
                        pa.array(block.lengths, pa.int64()),
                        pa.array(np.add.reduceat(known, block.starts), pa.int64()),
                        pa.array(np.full(n, totals["n"]), pa.int64()),
                        pa.array(np.add.reduceat(base, block.starts), pa.float64()),
                        pa.array(np.add.reduceat(log, block.starts), pa.float64()),
                    ],
                    names=["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    return full.mapInArrow(run, f"id {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def totals_of(sums: dict[int, list[int]], most: int) -> dict:
    """Tokens, distinct tokens, discounts by order, and the probability of an unknown word, from each order's sum, number and counts of counts."""
    sums = {n: sums.get(n) or [0] * (KEEP + 3) for n in range(1, most + 1)}
    n, v, low = sums[1][0], sums[1][1], sums[1][2:]
    d = [[], *(discounts(sums[k][2:]) for k in range(1, most + 1))]
    freed = sum((1 - d[1][r]) * r * low[r - 1] for r in range(1, KEEP + 1))
    of = n
    if n and freed <= 0:  # no word is rare: half a count is added for the unknown one
        freed, of = 0.5, n + 0.5
    return {"n": n, "v": v, "of": of, "d": d, "unknown": freed / of if n else 1.0}


def score(docs: DataFrame, mod: int = 5, held: int = 1, order: int = ORDER, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Train on the rows whose ``crc32(id as text) mod`` is not ``held`` and score all: id, held_out, n_tokens (words and one end),
    n_known (seen in training), train_tokens, base_score (add-half unigrams) and score (log10 probability under the backoff model of ``order``).

    Null or empty text: the end alone.  Null ids: their text is that of the empty id for the split.  Repeated rows: each counts and is
    scored.  Nothing to train on: every word has probability 1 in the model.  Empty table: no rows.  Whole texts are read; a text longer
    than a block is a block of its own.  Other columns are ignored, whatever their names.
    """
    size = docs.agg(F.sum(F.length(text_col).cast("long"))).first()[0] or 0
    shards = max(1, -(-size // (6 * SHARD)))
    id_type = docs.schema[id_col].dataType.simpleString()
    blocks = cut_by(_blocks(docs, id_col, text_col, mod, held), "block", "katz-blocks", dealt=False)
    counted = cut_by(_gathered(_add_counts(_counts(blocks, shards, order), order)), "block", "katz-counts", dealt=False)
    told = counted.filter("block < 0").select(F.explode("p").alias("p")).select("p.order", F.from_json(F.col("p.data").cast("string"), "array<long>").alias("x"))
    told = told.groupBy("order").agg(*[F.sum(F.col("x")[i]) for i in range(KEEP + 3)]).collect()  # a row an order
    totals = totals_of({r[0]: list(r[1:]) for r in told}, order)
    full = blocks.select("block", F.col("data").alias("tokens"), "ids").join(counted.select("block", F.col("p").alias("p0")).hint("merge"), "block")
    sums = _gathered(_add_sums(_sums(full, order), totals["d"]))
    out = _scores(full.join(sums.select("block", F.col("p").alias("p1")).hint("merge"), "block"), totals, id_type, order)
    return out.withColumnRenamed("id", id_col)
