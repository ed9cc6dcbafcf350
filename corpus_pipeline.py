"""Corpus pipeline: quality, near duplicates, repeated passages, benchmark leaks, packing.

Each stage takes what the one before kept, written as Parquet and read again. An empty table gives
no sequences; what each stage does with nulls, empty and repeated rows is said in its operator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tickloom.llm.leaks import decontaminated
from tickloom.llm.ngramjoin import one_per_group
from tickloom.llm.packing import pack_documents
from tickloom.llm.quality import quality_filter
from tickloom.llm.repeats import cut_texts
from tickloom.session import SCRATCH, materialize, remove_scratch


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and the certified cutoffs."""
    return quality_filter(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares four fifths of its five-word shingles."""
    return one_per_group(docs, k=5, percent=80)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the 50-byte strings that an earlier one has too."""
    return cut_texts(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents, packed into windows of 1024 tokens."""
    return pack_documents(docs)


#: scratch folders of the last call of each stage
_scratch: dict[int, list[str]] = {}


def _numbered(number: int, stage):
    """``stage``, which first removes what the stage before it needed: its result has been written."""

    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        remove_scratch(spark, _scratch.pop(number - 1, []), keep=docs)
        before = len(SCRATCH)
        out = stage(spark, docs, sf_dir)
        _scratch[number] = SCRATCH[before:]
        return out

    return run_stage


STAGES = [(stage.__name__, _numbered(number, stage)) for number, stage in enumerate(
    [quality_rules, near_duplicates, repeated_passages, benchmark_leaks, packing])]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
