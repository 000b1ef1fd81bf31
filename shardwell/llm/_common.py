"""Reading tables, cutting lineage and naming columns, shared by the operators of this subpackage."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shardwell.sources.scratch import cut, cut_by, release, written

__all__ = ["WORD", "cut", "cut_by", "fold", "map_texts", "mix", "n_words", "release", "table", "trim", "word_hashes", "written"]

#: Words of a text: runs of anything but the six ASCII white space characters.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def n_words(text: str):
    """Number of words of a string column (null: 0)."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def fold(id_col: str, mod: int):
    """``crc32(id as text) mod n``, the split that keeps held-out documents apart; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(mod))


def word_hashes(text: str | None, cache: dict[bytes, int], most: int = 200_000, wide: bool = False) -> np.ndarray:
    """crc32 of each word, or 64 bits if ``wide``; ``cache`` keeps those of at most ``most`` distinct words (and of one text more)."""
    words = (text or "").encode("utf-8", "replace").split()
    if len(cache) > most:  # frequent words came early: they stay
        for w in list(cache)[most // 2 :]:
            del cache[w]
    of = xxhash.xxh64_intdigest if wide else zlib.crc32
    out = []
    for w in words:
        h = cache.get(w)
        if h is None:
            h = cache[w] = of(w)
        out.append(h)
    return np.array(out, dtype="<u8" if wide else "<u4")


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of unsigned 64-bit numbers."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def trim() -> None:
    """Hand a worker's freed memory back: it waits for later tasks and would hold it beside the JVM's."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # no glibc
        pass


def map_texts(df: DataFrame, keep: list, text, setup: Callable[[], Callable[[list], tuple[list[int], list[list]]]], fields: str, rows: int = 64) -> DataFrame:
    """Run Python over whole texts.

    ``setup()`` runs once a task and returns a function from a list of at most ``rows`` texts to (index of each output row's input row,
    values of each output column).  The columns in ``keep`` travel as Arrow arrays, so integers stay exact beside nulls.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructField, StructType

    names = df.select(*keep).columns
    src = df.select(*[(F.col(k) if isinstance(k, str) else k).alias(f"c{i}") for i, k in enumerate(keep)], text.alias("t"))  # whatever the names
    extra = StructType.fromDDL(fields) if fields else StructType([])
    schema = StructType([*src.schema.fields[: len(keep)], *(StructField(f"e{i}", f.dataType) for i, f in enumerate(extra.fields))])

    def run(batches):
        import pyarrow as pa

        make, batch, part, columns, kept = setup(), None, None, None, None
        to = to_arrow_schema(schema)
        for batch in batches:
            for lo in range(0, batch.num_rows, rows):
                part = batch.slice(lo, rows)
                at, columns = make(part.column(part.num_columns - 1).to_pylist())
                if at:
                    kept = [part.column(i).take(pa.array(at, pa.int64())) for i in range(part.num_columns - 1)]
                    yield pa.RecordBatch.from_arrays(
                        [*(k.cast(f.type) for k, f in zip(kept, to)), *(pa.array(c, f.type) for c, f in zip(columns, list(to)[len(kept) :]))], schema=to
                    )
        del make, batch, part, columns, kept
        trim()

    return src.mapInArrow(run, schema).toDF(*names, *extra.names)
