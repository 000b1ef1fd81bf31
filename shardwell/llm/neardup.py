"""Near-duplicates by order MinHash with banded alignment.

Copies collapse first: equal word sequences are one text.  A text's k-mers are runs of five words, labelled with their occurrence.  Each of
``SAMPLES`` hash functions picks the ``TOP`` least labelled k-mers and keeps their text order; every two of them, in that order, are a key,
so texts with a common key have the same k-mers in the same order.  Taking all twos of the picked k-mers, not all of them as one key, finds
texts whose similarity is near the limit: at an edit similarity of 0.8 only a fifth of the k-mers are common.  Texts of few k-mers
are also keyed by each.  Candidates are texts with a common key whose sketches (16 minima of their words, four bits each) allow
the similarity; they are verified by banded alignment: the edit distance in words, computed within the band that the similarity allows.

A key's texts are not paired with one another.  Each is aligned with the key's least text, so with as many texts as it has keys; where that
fails for some, small groups are paired fully.  Texts of larger ones are looked at again without what is common to so many.  First those go that
can't be near any text of another class so far: of n words, n - 2 - 2 * (a fifth of n) pairs of neighbouring words at least are in such texts
otherwise.  The rest meet by prefixes: in one order of the words, rare ones first, texts of that similarity share one of their first words, a
fifth of each text's and one more.  These words are keys, however many texts hold them, so no similar pair among these texts is without a
common key; two texts meet at the first of them, not at each.  Texts already known to be connected are not aligned again.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardwell.llm._common import cut, cut_by, map_texts, mix, trim, word_hashes
from shardwell.llm._graph import components

#: Words of a k-mer, hash functions, k-mers that each picks, and k-mers of a text that is keyed by each of them too.
K, SAMPLES, TOP, SHORT = 5, 4, 5, 30
#: Minima in a sketch, and how many of them may differ: texts of similarity 0.8 share two thirds of their labelled words, so more differ for
#: one pair in 20 000 at the limit.
SKETCH, DIFFER = 16, 12
#: The first pass takes one key in so many, and only aligns with the least text of each; the second takes all keys of what is left apart.
FIRST = 4
#: Texts of a key that are paired fully where the star failed; texts of larger ones are keyed again by their prefixes.
SMALL = 40
#: Classes that words are counted in for their order, and texts of a prefix word that one task pairs; more are paired block by block.
COUNTED, BLOCK = 1 << 16, 1000
#: Words of a block of texts whose items are dealt to shards together.
WORDS = 200_000
#: Words before a prefix word by which a pair is known to have met already.
EARLY = 32
#: Print counts of each round, for tuning.
PROGRESS = False

_ODD = np.random.default_rng(20).integers(1, 2**63, size=(SAMPLES + SKETCH, 2), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POW = np.random.default_rng(5).integers(1, 2**63, size=K, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_I, _J = np.triu_indices(TOP, 1)


def labelled(h: np.ndarray) -> np.ndarray:
    """Hashes that tell the first occurrence of a value from the second and so on."""
    values, back, count = np.unique(h, return_inverse=True, return_counts=True)
    if len(values) == len(h):
        return h
    order = np.argsort(back, kind="stable")
    nth = np.arange(len(h)) - np.repeat(np.cumsum(count) - count, count)
    label = np.empty(len(h), dtype=np.uint64)
    label[order] = nth.astype(np.uint64)
    return np.where(label > 0, mix(h + label * np.uint64(0xD6E8FEB86659FD93)), h)


def kmers(words: np.ndarray) -> np.ndarray:
    """Hashes of the occurrence-labelled k-mers in text order; a text shorter than k has one."""
    if not len(words):
        return np.zeros(0, dtype=np.uint64)
    w = words.astype(np.uint64)
    if len(w) < K:
        w = np.append(w, np.full(K - len(w), 2**32 + len(w), dtype=np.uint64))
    h = np.zeros(len(w) - K + 1, dtype=np.uint64)
    for i in range(K):
        h += (w[i : i + len(h)] + np.uint64(1)) * _POW[i]
    return labelled(mix(h))


def keys_of(words: np.ndarray) -> list[int]:
    """Signed 64-bit keys of a text, sorted and distinct."""
    h = kmers(words)
    if not len(h):
        return []
    if len(h) > TOP:
        x = mix(h[None, :] * _ODD[:SAMPLES, :1] + _ODD[:SAMPLES, 1:])
        picked = h[np.sort(np.argpartition(x, TOP - 1, axis=1)[:, :TOP], axis=1)]
        keys = mix(mix(picked[:, _I] * np.uint64(0xFF51AFD7ED558CCD)) + picked[:, _J]).ravel()
    else:
        i, j = np.triu_indices(len(h), 1)
        keys = mix(mix(h[i] * np.uint64(0xFF51AFD7ED558CCD)) + h[j])
    if len(h) <= SHORT:
        keys = np.concatenate([keys, mix(h + np.uint64(0x51AFD7ED558CCDFF))])
    return np.unique(keys.astype(np.int64)).tolist()


def word_items(words: np.ndarray) -> np.ndarray:
    """Hashes of the occurrence-labelled words."""
    return labelled(mix(words.astype(np.uint64) + np.uint64(1)))


def prefix(words: np.ndarray, held: np.ndarray, least: float) -> list[int]:
    """The labelled words that come first in the order of (texts that hold the word's class, hash), signed.

    A text of n words shares all but ``most`` (the edits allowed) with a text of edit similarity ``least`` that is no longer, and
    with a longer one more than that.  So the first common word of two such texts is among the first ``most + 1`` of each.
    """
    h = word_items(words)
    if not len(h):
        return []
    most = int((1 - least) * len(h) + 1e-9)
    return h[np.lexsort((h, held[h % np.uint64(COUNTED)]))[: most + 1]].astype(np.int64).tolist()


def sketch(words: np.ndarray) -> int:
    """Four bits of the least hash of the labelled words by each of ``SKETCH`` functions, in one signed 64-bit number."""
    if not len(words):
        return 0
    w = word_items(words)
    out = np.full(SKETCH, 2**64 - 1, dtype=np.uint64)
    for lo in range(0, len(w), 10_000):
        out = np.minimum(out, mix(w[None, lo : lo + 10_000] * _ODD[SAMPLES:, :1] + _ODD[SAMPLES:, 1:]).min(axis=1))
    bits = (mix(out) >> np.uint64(60)) << (np.arange(SKETCH, dtype=np.uint64) * np.uint64(4))
    return int(np.bitwise_or.reduce(bits).astype(np.int64))


def _near_sketches(a: str, b: str):
    """Whether at most ``DIFFER`` of the minima in two sketches differ."""
    x = F.col(a).bitwiseXOR(F.col(b))
    any_ = x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseOR(F.shiftrightunsigned(x, 2)).bitwiseOR(F.shiftrightunsigned(x, 3))
    return F.bit_count(any_.bitwiseAND(F.lit(0x1111111111111111))) <= DIFFER


def distance_within(a: list, b: list, most: int) -> int | None:
    """Edit distance of two sequences if at most ``most``, else None: by diagonals while edits are few, then in a bit-parallel band."""
    if len(a) < len(b):
        a, b = b, a
    n, m = len(a), len(b)
    if n - m > most:
        return None
    lo = 0
    while lo < m and a[lo] == b[lo]:
        lo += 1
    while m > lo and a[n - 1] == b[m - 1]:
        n, m = n - 1, m - 1
    a, b = a[lo:n], b[lo:m]
    if not b:
        return len(a) if len(a) <= most else None
    few = min(most, FEW)
    found = _by_diagonals(a, b, few)
    return found if found is not None or few == most else _in_band(a, b, min(most, len(a)))


#: Edits up to which diagonals are followed one by one.
FEW = 48


def _by_diagonals(a: list, b: list, most: int) -> int | None:
    """The furthest point on each diagonal for 0, 1, 2 ... edits; work grows with the square of the edits."""
    n, m = len(a), len(b)
    if n - m > most:
        return None
    goal, off = m - n, most + 1
    far = [-1] * (2 * off + 1)  # far[d + off]: items of a used on diagonal d (b index - a index)
    i = 0
    while i < n and i < m and a[i] == b[i]:
        i += 1
    far[off] = i
    if goal == 0 and i == n:
        return 0
    for e in range(1, most + 1):
        new = [-1] * (2 * off + 1)
        # only diagonals from which the goal can still be reached
        for d in range(max(-e, goal - (most - e), -n), min(e, goal + (most - e), m) + 1):
            k = d + off
            if far[k] < 0 and far[k + 1] < 0 and far[k - 1] < 0:
                continue
            # replace, leave out an item of a, or take one of b
            i = min(max(far[k] + 1, far[k + 1] + 1, far[k - 1]), n, m - d)
            if i < 0 or i + d < 0:
                continue
            while i < n and i + d < m and a[i] == b[i + d]:
                i += 1
            new[k] = i
            if d == goal and i == n:
                return e
        far = new
    return None


def _in_band(a: list, b: list, most: int) -> int | None:
    """Differences of a column of the edit distance table as bits of two integers, a column for each item of ``b``.

    Only rows from ``most`` above the diagonal to ``most`` below are kept: bit ``x`` of column ``j`` is row ``j - most + x`` (from 1), and
    the band moves down a row a column.  What lies beyond a band's end only ever raises a distance, and paths that leave the band cost more
    than ``most``.
    """
    n, m = len(a), len(b)
    width = 2 * most + 1
    full = (1 << width) - 1
    places: dict = {}
    for i, x in enumerate(a, 1):
        places.setdefault(x, []).append(i)
    masks: dict = {}  # item: (first row of the band when last used, bits, places taken in)

    def matches(x, first: int) -> int:
        at = places.get(x)
        if at is None:
            return 0
        base, bits, taken = masks.get(x, (first, 0, 0))
        bits >>= first - base
        end = first + width
        while taken < len(at) and at[taken] < end:
            if at[taken] >= first:
                bits |= 1 << (at[taken] - first)
            taken += 1
        masks[x] = (first, bits, taken)
        return bits

    # column 0: rows from 0 down rise by one; rows above the table count as level
    up, down = (full >> (most + 1)) << (most + 1), 0  # rows 1.. of the table, as the band of column 0 begins at row -most
    distance = 0  # at the row on the diagonal of the band's middle: row j of column j
    for j in range(1, m + 1):
        # the band moves down: bit x now stands for one row further
        up, down = (up >> 1) | (1 << (width - 1)), down >> 1
        same = matches(b[j - 1], j - most)
        diagonal = ((((same & up) + up) ^ up) | same | down) & full
        right, left = (down | ~(diagonal | up)) & full, up & diagonal
        # rows above the table: the top row rises by one a column
        top = most - j
        if top >= 0:
            right |= (1 << (top + 1)) - 1
            left &= ~((1 << (top + 1)) - 1)
        distance += not (diagonal >> most) & 1
        shifted, shifted_left = (right << 1) | 1, left << 1
        up, down = (shifted_left | ~(diagonal | shifted)) & full, (shifted & diagonal) & full
        if top >= 0:
            up &= ~((1 << (top + 1)) - 1)
            down &= ~((1 << (top + 1)) - 1)
    # from row m on the diagonal down to row n of the last column
    for row in range(m + 1, n + 1):
        x = row - m + most
        distance += ((up >> x) & 1) - ((down >> x) & 1)
    return distance if distance <= most else None


def similar(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    """Whether 1 - distance / longer length is at least ``least``."""
    longer = max(len(a), len(b))
    most = int((1 - least) * longer + 1e-9)
    x, y = np.sort(a), np.sort(b)
    values, counts = np.unique(x, return_counts=True)
    lo, hi = np.searchsorted(y, values, "left"), np.searchsorted(y, values, "right")
    if longer - int(np.minimum(counts, hi - lo).sum()) > most:  # words without a partner cost an edit each
        return False
    return distance_within(a.tolist(), b.tolist(), most) is not None


def texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """_id, _h (hash of the text), node (hash of the word sequence), n, words (their hashes, compressed), keys and sketch of each row."""

    def setup():
        import hashlib

        cache: dict[bytes, int] = {}

        def make(rows):
            out: list[list] = [[], [], [], [], []]
            for t in rows:
                w = word_hashes(t, cache)
                joined = b" ".join((t or "").encode("utf-8", "replace").split())
                for column, v in zip(out, (hashlib.blake2b(joined, digest_size=16).digest(), len(w), zlib.compress(w.tobytes(), 1), keys_of(w), sketch(w))):
                    column.append(v)
            return list(range(len(rows))), out

        return make

    same = F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit("")))).alias("_h")
    return map_texts(docs, [F.col(id_col).alias("_id"), same], F.col(text_col), setup, "node binary, n int, words binary, keys array<long>, sketch long")


def _aligned(pairs: DataFrame, words: DataFrame, least: float) -> DataFrame:
    """``pairs`` (a, b) that are similar; ``words`` lies in buckets, so only pairs move, with the words of one side."""
    w = words.select("node", "words")
    both = pairs.join(w.select(F.col("node").alias("b"), F.col("words").alias("wb")).hint("merge"), "b")
    both = both.join(w.select(F.col("node").alias("a"), F.col("words").alias("wa")).hint("merge"), "a")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            ok = []
            for i in range(batch.num_rows):
                x, y = (np.frombuffer(zlib.decompress(batch.column(k)[i].as_py()), "<u4") for k in (2, 3))
                ok.append(similar(x, y, least))
            mask = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["a", "b"])
        batch = x = y = None
        trim()

    return both.select("a", "b", "wa", "wb").mapInArrow(run, "a binary, b binary")


def _held(rows: DataFrame) -> np.ndarray:
    """How often ``rows`` (words) hold a labelled word of each class: ``COUNTED`` numbers, however many rows there are."""

    def run(batches):
        import pyarrow as pa

        out = np.zeros(COUNTED, dtype=np.int64)
        for batch in batches:
            for x in batch.column(0):
                h = word_items(np.frombuffer(zlib.decompress(x.as_py()), "<u4"))
                out += np.bincount((h % np.uint64(COUNTED)).astype(np.int64), minlength=COUNTED)
        at = np.flatnonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(out[at])], names=["c", "k"])

    held = np.zeros(COUNTED, dtype=np.int64)
    for r in rows.select("words").mapInArrow(run, "c long, k long").groupBy("c").agg(F.sum("k").alias("k")).collect():  # at most COUNTED
        held[r.c] = r.k
    return held


def _dealt(rows: DataFrame, items_of, name: str) -> DataFrame:
    """Hashes that ``items_of`` finds in the third column of ``rows`` (node, root, ...), dealt to shards: a row a block of texts and shard.

    ``items`` are the shard's, ``at`` their texts' numbers in the block, ``nodes``, ``roots`` and ``sizes`` (items in all) the block's texts.
    """
    shards = max(8, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 8)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            lo = 0
            while lo < batch.num_rows:
                found, hi, total = [], lo, 0
                while hi < batch.num_rows and total < WORDS:
                    found.append(items_of(batch.column(2)[hi]))
                    hi, total = hi + 1, total + len(found[-1])
                items, sizes = np.concatenate(found), np.array([len(x) for x in found], dtype="<u4")
                at = np.repeat(np.arange(hi - lo, dtype="<u4"), sizes)
                shard = (mix(items) >> np.uint64(32)) % np.uint64(shards)
                nodes, roots = (b"".join(batch.column(c).slice(lo, hi - lo).to_pylist()) for c in (0, 1))
                own = [(k, items[here].tobytes(), at[here].tobytes()) for k in range(shards) for here in [np.flatnonzero(shard == k)]]
                k, x, y = zip(*own)
                yield pa.RecordBatch.from_pydict(
                    {"shard": pa.array(k, pa.int32()), "items": x, "at": y, "block": [nodes[:16]] * shards, "nodes": [nodes] * shards, "roots": [roots] * shards, "sizes": [sizes.tobytes()] * shards}
                )
                lo = hi
        batch = found = items = at = shard = own = x = y = None
        trim()

    packed = rows.mapInArrow(run, "shard int, items binary, at binary, block binary, nodes binary, roots binary, sizes binary")
    return cut(packed, name)


def _elsewhere(part) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Items of a shard, their texts' numbers in the shard, where each block's texts begin, and which items texts of several roots hold."""
    counts = np.array([len(x.as_py()) // 16 for x in part["nodes"]], dtype=np.int64)
    first = np.cumsum(counts) - counts
    items = np.concatenate([np.frombuffer(x.as_py(), "<u8") for x in part["items"]])
    at = np.concatenate([np.frombuffer(x.as_py(), "<u4") + lo for x, lo in zip(part["at"], first)])
    halves = np.frombuffer(b"".join(part["roots"].to_pylist()), "<u8").reshape(-1, 2)
    root = mix(mix(halves[:, 0]) + halves[:, 1])[at]
    several = np.zeros(len(items), dtype=bool)
    if not len(items):
        return items, at, first, several
    order = np.lexsort((root, items))
    starts = np.flatnonzero(np.diff(items[order], prepend=~items[order[:1]]))
    ends = np.append(starts[1:], len(items)) - 1
    several[order] = np.repeat(root[order[starts]] != root[order[ends]], ends - starts + 1)
    return items, at, first, several


def word_pairs(words: np.ndarray) -> np.ndarray:
    """Hashes of the occurrence-labelled pairs of neighbouring words."""
    w = words.astype(np.uint64) + np.uint64(1)
    return labelled(mix(w[:-1] * _POW[0] + w[1:] * _POW[1]))


def kept_pairs(pairs: np.ndarray, least: float) -> np.ndarray:
    """Of so many word pairs, how many at least a text shares with any text of edit similarity ``least``.

    A word replaced or left out ends two pairs, one put in ends one, so texts of n and m >= n words lose 2 * most(m) - (m - n) at most, which is
    2 * most(n) + 1 at most if half the words or more agree.
    """
    if least < 0.5:
        return np.zeros_like(pairs)
    return np.maximum(pairs - 2 * ((1 - least) * (pairs + 1) + 1e-9).astype(np.int64) - 1, 0)


def _may_meet(rows: DataFrame, least: float) -> DataFrame:
    """``node`` of the ``rows`` (node, root, words) that share word pairs enough with texts of other roots, taken together."""

    def count(part):
        import pyarrow as pa

        _, at, first, several = _elsewhere(part)
        held = np.bincount(at[several], minlength=sum(len(x.as_py()) // 16 for x in part["nodes"])).astype("<u4")
        return pa.table({"block": part["block"], "nodes": part["nodes"], "sizes": part["sizes"], "held": [x.tobytes() for x in np.split(held, first[1:])]})

    def keep(part):
        import pyarrow as pa

        held = sum(np.frombuffer(x.as_py(), "<u4").astype(np.int64) for x in part["held"])
        pairs = np.frombuffer(part["sizes"][0].as_py(), "<u4").astype(np.int64)
        nodes = part["nodes"][0].as_py()
        return pa.table({"node": pa.array([nodes[16 * i : 16 * i + 16] for i in np.flatnonzero(held >= kept_pairs(pairs, least))], pa.binary())})

    pairs = lambda x: word_pairs(np.frombuffer(zlib.decompress(x.as_py()), "<u4"))
    counted = _dealt(rows.select("node", "root", "words"), pairs, "near-word-pairs").groupBy("shard").applyInArrow(count, "block binary, nodes binary, sizes binary, held binary")
    return counted.groupBy("block").applyInArrow(keep, "node binary")


def _with_prefix(rows: DataFrame, least: float) -> DataFrame:
    """``rows`` (node, n, sketch, root, words) with a row for each word of their prefixes that texts of several roots have there, as ``key``.

    ``early`` are the ``EARLY`` words before it in the prefix: two texts that have one in common meet there already.
    """
    held = rows.sparkSession.sparkContext.broadcast(_held(rows))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            found = [prefix(np.frombuffer(zlib.decompress(x.as_py()), "<u4"), held.value, least) for x in batch.column(4)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), pa.array(found, pa.list_(pa.int64()))], names=["node", "n", "sketch", "root", "keys"])

    def meet(part):
        import pyarrow as pa

        items, at, _, several = _elsewhere(part)
        nodes = b"".join(part["nodes"].to_pylist())
        return pa.table({"key": pa.array(items[several].astype(np.int64)), "node": pa.array([nodes[16 * i : 16 * i + 16] for i in at[several].tolist()], pa.binary())})

    some = rows.select("node", "n", "sketch", "root", "words")
    whole = cut(some.mapInArrow(run, "node binary, n int, sketch long, root binary, keys array<long>"), "near-prefix")
    dealt = _dealt(whole.select("node", "root", "keys"), lambda x: x.values.to_numpy().astype(np.uint64), "near-prefix-words")
    found = dealt.groupBy("shard").applyInArrow(meet, "key long, node binary").join(whole, "node")
    at = F.array_position("keys", F.col("key")).cast("int")
    early = F.slice("keys", F.greatest(at - EARLY, F.lit(1)), F.least(at - 1, F.lit(EARLY)))
    return found.select("node", "n", "sketch", "root", "key", early.alias("early"))


def links(rows: DataFrame, nodes: DataFrame, least: float = 0.8) -> DataFrame:
    """Verified links (a, b) between different texts, enough of them to connect each class; ``rows``: _id, node, words; ``nodes``: node, n,
    sketch, keys, id (the least), one row a text."""
    spark = nodes.sparkSession
    none = spark.createDataFrame([], "a binary, b binary")
    tested, good = none, none
    keyed = nodes.select("node", "n", "sketch", "id", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("k")).filter("k > 1").select("key")
    members = cut(keyed.join(shared, "key"), "near-members")
    # the words of texts that share a key: of one row each, found by text and id, so that copies don't meet
    some = members.select(F.col("node").alias("_n"), F.col("id").alias("_i")).distinct()
    found = rows.select("node", "_id", "words").join(some.hint("merge"), (F.col("node") == F.col("_n")) & F.col("_id").eqNullSafe(F.col("_i")), "left_semi")
    words = cut_by(found.select("node", "words").dropDuplicates(["node"]), "node", "near-words")

    def test(pairs: DataFrame) -> None:
        """Align the pairs not yet aligned whose lengths and sketches allow it."""
        nonlocal tested, good
        new = pairs.filter(ok).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().join(tested, ["a", "b"], "left_anti")
        new = cut(new, "near-pairs")
        tested = tested.unionByName(new)
        if not new.isEmpty():
            good = good.unionByName(cut(_aligned(new, words, least), "near-good"))

    def pairs_of(rows: DataFrame) -> DataFrame:
        """All pairs of each key's rows that aren't connected yet, but for those that meet at a word of both rows' ``early``."""
        rows = rows if "early" in rows.columns else rows.withColumn("early", F.lit(None).cast("array<long>"))
        one = rows.select("key", F.col("node").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"), "root", "early")
        other = rows.select("key", *pair, F.col("root").alias("rb"), F.col("early").alias("eb"))
        return one.join(other, "key").filter("a < b and root <> rb").filter(once)

    def pairs_in_blocks(rows: DataFrame) -> DataFrame:
        """As ``pairs_of``, for groups of more than ``BLOCK`` rows: they are dealt to blocks, and each two blocks meet in a task of their own."""
        blocks = F.ceil(F.col("k") / F.lit(BLOCK)).cast("int")
        rows = rows.withColumn("_x", F.pmod(F.xxhash64("node"), blocks).cast("int")).withColumn("_y", F.explode(F.sequence(F.lit(0), blocks - 1)))
        one = rows.filter("_x <= _y").select("key", "_x", "_y", F.col("node").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"), "root", "early")
        other = rows.filter("_y <= _x").select("key", F.col("_y").alias("_x"), F.col("_x").alias("_y"), *pair, F.col("root").alias("rb"), F.col("early").alias("eb"))
        return one.join(other, ["key", "_x", "_y"]).filter("root <> rb and (_x < _y or a < b)").filter(once).drop("_x", "_y")

    pair = (F.col("node").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
    ok = (F.least("na", "nb") >= F.greatest("na", "nb") * F.lit(least) - F.lit(1e-9)) & _near_sketches("sa", "sb")
    once = F.when((F.col("root") != F.col("rb")) & ok, ~F.coalesce(F.arrays_overlap("early", "eb"), F.lit(False))).otherwise(F.lit(False))
    roots: DataFrame | None = None
    for first in (True, False):
        rows = (members.filter(F.pmod("key", F.lit(FIRST)) == 0) if first else members).select("key", "node", "n", "sketch")
        if roots is None:
            rows = rows.withColumn("root", F.col("node"))
        else:
            rows = rows.join(roots.select("node", "root"), "node", "left").withColumn("root", F.coalesce("root", "node"))
        heads = rows.groupBy("key").agg(F.min(F.struct("node", "n", "sketch", "root")).alias("h"), F.count("*").alias("k"), F.min("root").alias("r0"), F.max("root").alias("r1"))
        heads = heads.filter("r0 <> r1").select("key", "k", F.col("h.node").alias("a"), F.col("h.n").alias("na"), F.col("h.sketch").alias("sa"), F.col("h.root").alias("ra"))
        rows = cut(rows.join(heads, "key"), "near-rows")
        if rows.isEmpty():
            break
        if PROGRESS:
            print("near-duplicates: keys", heads.count(), "rows", rows.count(), flush=True)
        test(rows.filter("root <> ra").select("a", "na", "sa", *pair))
        if first:
            if not good.isEmpty():
                roots = cut(components(good), "near-roots")
            continue
        hit = (F.least("a", "node") == F.col("a_")) & (F.greatest("a", "node") == F.col("b_"))
        apart = rows.filter("root <> ra").join(good.select(F.col("a").alias("a_"), F.col("b").alias("b_")), hit, "left_anti").select("key").distinct()
        rows = cut(rows.join(apart, "key", "left_semi"), "near-apart")
        test(pairs_of(rows.filter(F.col("k") <= SMALL)))
        large = cut(rows.filter(F.col("k") > SMALL).select("key", "node", "n", "sketch", "root"), "near-large")
        if not large.isEmpty():
            # what the second pass has connected by now is left out
            now = cut(components(good), "near-roots") if not good.isEmpty() else none.toDF("node", "root")
            large = large.drop("root").join(now, "node", "left").withColumn("root", F.coalesce("root", "node"))
            apart = large.groupBy("key").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).filter("r0 <> r1").select("key")
            large = large.join(apart, "key", "left_semi").select("node", "n", "sketch", "root").distinct()
            large = cut(words.select("node", "words").join(large.hint("merge"), "node"), "near-large")
            large = cut(large.join(cut(_may_meet(large, least), "near-meet", True), "node", "left_semi"), "near-large")
            each = cut(_with_prefix(large, least), "near-prefix")
            shared = each.groupBy("key").agg(F.count("*").alias("k")).select("key", "k")
            rows = cut(each.join(shared, "key"), "near-rest")
            if PROGRESS:
                print("near-duplicates: texts in large groups", large.count(), "rows", rows.count(), "most", shared.agg(F.max("k"), F.sum(F.col("k") * F.col("k"))).first(), flush=True)
            found, most = pairs_of(rows.filter(F.col("k") <= BLOCK)), rows.agg(F.max("k")).first()[0] or 0
            test(found if most <= BLOCK else found.unionByName(pairs_in_blocks(rows.filter(F.col("k") > BLOCK))))
    if PROGRESS:
        print("near-duplicates: aligned", tested.count(), "links", good.count(), flush=True)
    return good


def _classes(docs: DataFrame, least: float, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(rows: _id, _h, node; texts: node, root of its class, text_id, copies, n_links)."""
    rows = cut(texts(docs, id_col, text_col), "near-texts")
    same = rows.groupBy("node").agg(F.min("_id").alias("text_id"), F.count("*").alias("copies"))
    nodes = cut(rows.groupBy("node").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.first("keys").alias("keys"), F.min("_id").alias("id")), "near-nodes")
    good = cut(links(rows, nodes, least).distinct(), "near-links")
    if good.isEmpty():
        found = same.withColumn("root", F.col("node")).withColumn("n_links", F.lit(0).cast("long"))
    else:
        degree = good.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("n_links"))
        found = same.join(components(good), "node", "left").join(degree, "node", "left")
        found = found.withColumn("root", F.coalesce("root", "node")).withColumn("n_links", F.coalesce("n_links", F.lit(0).cast("long")))
    return rows.select("_id", "_h", "node"), found


def near_duplicates(docs: DataFrame, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per row of ``docs``: id, class_id (least id of its class), class_size (rows), text_id (least id with the same words), n_links
    (links of its text to different texts that were aligned and hold; texts that others connect already are not aligned).

    Two documents are near-duplicates if their words' edit similarity, 1 - distance / words of the longer, is at least ``least``; classes
    are connected components.  As with any MinHash a link can be missed; the tests plant edits of 5 to 19 %.  Null and empty texts: equal to one another, near no other.  Null ids: rows keep them; a class of only null
    ids has a null class_id.  Repeated rows count as copies.  Ties: the least id.  Texts under five words have one k-mer, the whole text.
    Empty table: no rows.  Whole texts are compared.  Other columns are ignored, whatever their names.
    """
    rows, found = _classes(docs, least, id_col, text_col)
    classes = found.groupBy("root").agg(F.min("text_id").alias("class_id"), F.sum("copies").alias("class_size"))
    found = found.join(classes, "root").select("node", "text_id", "n_links", "class_id", "class_size")
    return rows.select("_id", "node").join(found, "node").select(F.col("_id").alias(id_col), "class_id", "class_size", "text_id", "n_links")


def keep_one(docs: DataFrame, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` of each class of near-duplicates; the columns stay as they are.

    The row with the least id stays, of equal ids the one with the least hash of its text, of equal rows any; a row without an id only if its
    class has no other.
    """
    names = docs.columns
    rows, found = _classes(docs, least, id_col, text_col)
    best = rows.join(found.select("node", "root"), "node").groupBy("root").agg(F.min(F.struct(F.col("_id").isNull().alias("z"), "_id", "_h")).alias("x"))
    best = best.select(F.col("x._id").alias("s_id"), F.col("x._h").alias("s_h"))
    at = [f"c{i}" for i in range(len(names))]
    keyed = docs.toDF(*at)
    own, text = at[names.index(id_col)], at[names.index(text_col)]
    keyed = keyed.withColumn("h", F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")))))
    kept = keyed.join(best, F.col(own).eqNullSafe(F.col("s_id")) & (F.col("h") == F.col("s_h")), "left_semi")
    return kept.dropDuplicates([own, "h"]).select(*at).toDF(*names)
