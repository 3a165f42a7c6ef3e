"""A corpus from raw documents to packed training sequences: five stages, each by one operator.

Every stage takes (spark, docs, sf_dir) and returns the documents that it keeps, with the columns of
``documents``; the last returns the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from karst.llm.common import table, written
from karst.llm.decontaminate import decontaminate
from karst.llm.jaccard_join import keep_one
from karst.llm.packing import EQUAL, pack
from karst.llm.pii import redact
from karst.llm.quality import keep_good

#: Near duplicates here are those of five-word shingles with a similarity of 0.8 or more.
SHINGLE, PERCENT = 5, 80


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays."""
    return keep_one(docs, size=SHINGLE, percent=PERCENT)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of a benchmark text go; hits of items shorter than a window are cut out."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"), remove="documents")


def personal_data_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind."""
    return redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences, with their token ids; every source has the same share of each window until it runs dry."""
    return pack(docs, mixture=EQUAL)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", benchmark_free),
    ("personal_data", personal_data_free),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``, each result written and reread as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: The exact union of near duplicates and the tokenizer have no SQL; tests hold every stage against brute force.
ORACLE_SQL = None
