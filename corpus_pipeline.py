"""A training corpus from raw documents: the stages in order, each over all that the one before kept.

Every stage is a function (spark, docs, sf_dir) -> DataFrame; all but the last return the columns of documents. Nulls in any
column, wordless and very long texts, ties, repeated rows, empty tables and further columns are handled as the operators'
docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexigrid.llm.curriculum import mix_sources
from lexigrid.llm.curvepack import pack
from lexigrid.llm.linechunks import line_dedup
from lexigrid.llm.neardup import near_dedup
from lexigrid.llm.quality import quality_filter
from lexigrid.llm.scratch import discard, stage


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble, fitted on a bounded sample of labels, doesn't reject."""
    return quality_filter(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the runs of lines that occur earlier in the corpus. Those that are copies of another as a whole are left
    to the next stage: without what they share with it, they couldn't be told for its copies."""
    return line_dedup(docs, copies=False)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return near_dedup(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in training order, as often as their source's weights over time demand."""
    return mix_sources(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of equal length along the Hilbert curve."""
    return pack(docs)


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("mix", mix), ("packing", packing)]

#: SQL can express neither the fitted rules nor the signatures; tests hold the operators against plain
#: versions, and run the stages on edge cases.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed corpus of documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES:
        before, docs = docs, stage(step(spark, docs, sf_dir), f"pipeline-{name}")
        if name != STAGES[0][0]:
            discard(before)
    return docs
