"""The corpus pipeline: toxicity, near-duplicates, repeated passages, mixing and packing, each stage written and read again.

Every stage takes ``(spark, docs, sf_dir)`` and works on all that its predecessor kept; all but the last return the columns of ``documents``.
Columns beyond those of ``documents`` are kept, whatever their names and types, and an empty table gives an empty one.  When a stage is called,
the tables in between which the stage before it made are dropped, unless what it is given still reads them.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from shardwell.llm import mixing, neardup, packing, passages, toxicity
from shardwell.llm._common import cut, release, table, written

_before: list = []


def _stage(f: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """Drops the tables of the stage before that ``docs`` doesn't read, and remembers this one's."""

    @wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        read = docs.inputFiles()
        release([x for x in _before if x[0] is spark and not any(x[1].split("://")[-1] in f for f in read)])
        had = set(written())
        out = f(spark, docs, sf_dir)
        _before[:] = [x for x in written() if x not in had]
        return out

    return run_stage


@_stage
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model calls toxic go; the rest stay as they are.

    Null and empty texts have no sentence and stay; null ids, ties and repeated rows are judged like any row; whole texts are read.
    """
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.filter_documents(docs, model)


@_stage
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays, the one with the least id (a null id only if its class has no other).

    Null and empty texts are one class; repeated rows are copies; of rows equal in id and text any stays; whole texts are compared.
    """
    return neardup.keep_one(docs)


@_stage
def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document (by id, null first, then text) holds are cut out; documents of which nothing is left go.

    Null and empty texts stay as they are; of repeated rows as long as a passage one stays; whole texts are read.
    """
    return passages.remove_repeats(docs)


@_stage
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, so perhaps not at all.

    Null and empty texts are taken once; a null source is a source of its own; repeated rows count one by one; ties go by a hash of id and text.
    """
    return mixing.repeat_documents(docs)


@_stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents and their places in sequences.

    Null and empty texts are one piece with the end token alone; long texts are cut into pieces; each repeated row is packed.
    """
    return packing.pack(docs)


STAGES = [("toxicity", drop_toxic), ("near-duplicates", drop_near_copies), ("repeated passages", cut_repeats), ("mixing", mix), ("packing", pack)]

#: Model training, alignment and packing are beyond SQL; the tests hold ``run`` against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
