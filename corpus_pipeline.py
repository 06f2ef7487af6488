"""From raw documents to packed sequences: toxic documents, near copies, repeated passages and benchmark leaks go."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from barwise.llm import common, decontaminate, near_dedup, packing, suffix_dedup, toxicity

_scratch: list[str] = []


def _stage(f):
    """A stage begins when the result of the one before is a table; the tables that one worked with are dropped then.

    The first stage drops nothing: the sequences of an earlier run may still be read from its last stage's tables.
    """

    @wraps(f)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if f.__name__ == STAGES[0][1].__name__:
            _scratch.clear()
        common.release(spark, _scratch)
        with common.recording(_scratch):
            return f(spark, docs, sf_dir)

    return run


@_stage
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, common.table(spark, sf_dir, "labels"))


@_stage
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five words a shingle, similarity 0.8 or more."""
    return near_dedup.near_dedup(docs)


@_stage
def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffix_dedup.without_repeats(docs)


@_stage
def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, common.table(spark, sf_dir, "benchmark"))


@_stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [("toxicity", drop_toxic), ("near dedup", drop_near_copies), ("suffix dedup", cut_repeats), ("decontamination", drop_leaks), ("packing", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sequences of documents. A stage's result goes once the next one's is written; what the last stage reads stays for the caller."""
    docs = common.table(spark, sf_dir, "documents")
    before: list[str] = []
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            after: list[str] = []
            with common.recording(after):
                docs = common.written(docs, f"stage-{name.replace(' ', '-')}")
            common.release(spark, before)
            before = after
    return docs
