"""Registered queries that need the Python standard library; checked by tests instead of SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fuzzy
from ..operators import code
from .registry import query, spread, table


def _logs(spark, sf_dir):
    stack = F.concat(F.lit('  File "a/'), F.pmod(F.col("doc_id"), F.lit(9)).cast("string"), F.lit('.py", line 3, in run\n    x = f('), F.col("lang"), F.lit(")\nValueError: "), F.col("lang"), F.lit("\n"))
    return table(spark, sf_dir, "documents").select("doc_id", stack.alias("log"))


def _files(spark, sf_dir):
    body = F.concat(
        F.lit("import os\nfrom a.b import c as d\nLIMIT = 3\n\n\nclass TestPart"), F.col("p_partkey").cast("string"), F.lit('(Base):\n    """Doc."""\n    size = '), F.col("p_size").cast("string"),
        F.lit("\n\n    def test_size(self):\n        assert self.size == LIMIT  # checked\n        self.assertTrue(c())\n\n\ndef helper(x):\n    return os.path.join(x)\n"),
    )
    # The table is small beside its files and their parse: its rows are spread before.
    return spread(table(spark, sf_dir, "part").select("p_partkey", "p_size")).select(F.concat(F.lit("part_"), F.col("p_partkey").cast("string"), F.lit(".py")).alias("path"), body.alias("content"))


@query()
def traceback_parse(spark, sf_dir):
    return _logs(spark, sf_dir).select("doc_id", F.explode(fuzzy.output_traces("log")).alias("t")).select("doc_id", "t.*")


@query()
def traceback_match(spark, sf_dir):
    logs = _logs(spark, sf_dir)
    return logs.select("doc_id", fuzzy.similar("log", F.lit('  File "a/1.py", line 3, in run\n    x = f(en)\nValueError: en\n')).alias("matched"))


@query()
def extract_definitions(spark, sf_dir):
    return code.definition_table(_files(spark, sf_dir)).drop("code", "signature")


@query()
def class_signature(spark, sf_dir):
    return code.definition_table(_files(spark, sf_dir)).where("kind = 'class'").select("path", "name", "signature")


@query()
def list_tests(spark, sf_dir):
    return code.test_table(_files(spark, sf_dir)).select("path", "parent", "name", "content")


@query()
def imports(spark, sf_dir):
    return code.import_table(_files(spark, sf_dir))


@query()
def call_edges(spark, sf_dir):
    return code.call_table(_files(spark, sf_dir))


@query()
def assertion_count(spark, sf_dir):
    return _files(spark, sf_dir).select("path", fuzzy.assertions("content").alias("n_assertions"), fuzzy.test_length("content").alias("length"))


@query()
def syntax_clusters(spark, sf_dir):
    return _files(spark, sf_dir).groupBy(F.md5(fuzzy.test_key("content")).alias("rep")).agg(F.count("*").alias("n"))
