"""Sources and sinks: tables, id lists, source files, diffs, keyed stores, and adapters to the outside."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import is_searched
from .documents import checkpoints


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """One id a line."""
    return spark.read.text(path).select(F.trim("value").alias("instance_id")).where("instance_id <> ''")


def read_sources(spark: SparkSession, root: str, tests: bool = False, project: str | None = None) -> DataFrame:
    """(path, content) of the Python files below root that are searched (see text.is_searched); with tests, of all."""
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.py").text(root, wholetext=True)
    path = F.regexp_replace(F.col("_metadata.file_path"), r"^file:/*", "/")
    rows = rows.select(F.substring(path, len(root.rstrip("/")) + 2, 1 << 20).alias("path"), F.col("value").alias("content"))
    return rows if tests else rows.where(is_searched(F.col("path"), None if project is None else F.lit(project)))


def read_tests(spark: SparkSession, root: str) -> DataFrame:
    """(path, content) of files named test*.py or unittest*.py."""
    base = F.element_at(F.split("path", "/"), -1)
    return read_sources(spark, root, True).where(base.startswith("test") | base.startswith("unittest"))


def diff_rows(diffs: DataFrame) -> DataFrame:
    """(pos, path, part) of diffs(text): a row for each file of a unified diff."""
    parts = F.filter(F.split("text", r"(?m)^(?=diff --git )"), lambda p: p.startswith("diff --git "))
    rows = diffs.select("*", F.posexplode(parts).alias("pos", "part")).drop("text")
    return rows.withColumn("path", F.regexp_extract("part", r"^diff --git a/\S+ b/(\S+)", 1))


def test_diff(diffs: DataFrame, keys: list[str]) -> DataFrame:
    """The diff again, with only the files that have `test` in their path, in order."""
    rows = diff_rows(diffs).where(F.col("path").contains("test"))
    parts = F.sort_array(F.collect_list(F.struct("pos", "part")))
    return rows.groupBy(*keys).agg(F.array_join(F.transform(parts, lambda p: p["part"]), "").alias("text"))


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows by key, new ones before old."""
    both = old.withColumn("_v", F.lit(0)).unionByName(new.withColumn("_v", F.lit(1)))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("_v")))
    return both.withColumn("_r", rank).where("_r = 1").drop("_v", "_r")


def ask(prompts: DataFrame, provider: Callable[[str], str | None], text: str = "prompt", answer: str = "answer") -> DataFrame:
    """Adds the provider's answer to each prompt, null where it fails. The provider runs on executors, a batch at a time."""
    names = prompts.columns

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def one(p):
            try:
                return provider(p)
            except Exception:  # a failed call is a null answer, never a lost batch
                return None

        for f in frames:
            yield f[names].assign(**{answer: f[text].map(one)})

    return prompts.mapInPandas(run, ", ".join(f"{n} {t}" for n, t in prompts.dtypes) + f", {answer} string")


def refine(rounds: int, start: DataFrame, step: Callable[[DataFrame, int], DataFrame]) -> DataFrame:
    """Rounds of a step on its own result, each checkpointed."""
    df = start
    with checkpoints(start.sparkSession):
        for i in range(1, rounds + 1):
            df = step(df, i).checkpoint()
    return df


def converse(asked: DataFrame, provider: Callable, tools: Callable[[str, str], str], turns: int = 20, errors: int = 10) -> DataFrame:
    """(conv, transcript, outcome) of asked(conv, prompt): the provider gets the transcript and answers (text, [(tool, arguments)]);
    tools answer each call, until an answer has no calls (`done`), the errors-th answer of a tool begins with Error
    (`errors`) or the turns are over (`turns`). A batch of conversations is held on an executor."""

    def one(prompt: str) -> tuple[list[str], str]:
        said, wrong = [f"user: {prompt}"], 0
        for _ in range(turns):
            text, calls = provider(list(said))
            said.append(f"assistant: {text}")
            if not calls:
                return said, "done"
            for name, arguments in calls:
                answer = tools(name, arguments)
                said.append(f"tool: {answer}")
                wrong += answer.startswith("Error")
                if wrong >= errors:
                    return said, "errors"
        return said, "turns"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = [one(p) for p in f["prompt"]]
            yield pd.DataFrame({"conv": f["conv"], "transcript": [x for x, _ in out], "outcome": [x for _, x in out]})

    return asked.select("conv", "prompt").mapInPandas(run, f"conv {dict(asked.dtypes)['conv']}, transcript array<string>, outcome string")
