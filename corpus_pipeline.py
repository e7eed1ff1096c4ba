"""From raw documents to packed training sequences: five stages, each an operator of siftline.llm.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read as the next one's
docs. All but the last return the columns of documents. A stage's docs are what its predecessor returned, so that has been
written by then: a stage first deletes the intermediate tables of its predecessor.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siftline.llm.common import materialize, release, scope
from siftline.llm.jaccard import one_of_each
from siftline.llm.mixing import mixed_documents
from siftline.llm.packing import pack
from siftline.llm.quality import keep_good
from siftline.llm.substrings import without_repeats


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules, without the boilerplate lines of their hosts."""
    with scope("quality rules"):
        return keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of linked shingle sets, the one of the least id."""
    release("quality rules")
    with scope("near duplicates"):
        return one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier text has."""
    release("near duplicates")
    with scope("repeated passages"):
        return without_repeats(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources at their target weights, repeats included, in training order."""
    release("repeated passages")
    with scope("source mix"):
        return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of the permitted lengths: a row for each piece of a document."""
    release("source mix")
    return pack(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", repeated_passages),
    ("mixing sources to target weights", source_mix),
    ("best-fit packing", packing),
]

#: SQL can't say fuzzy passages or best fit; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES[:-1]):
        found = stage(spark, docs, sf_dir)
        with scope(f"docs {i}"):
            docs = materialize(found)
        release(f"docs {i - 1}")  # those of the stage before have been read for the last time
    return STAGES[-1][1](spark, docs, sf_dir)
