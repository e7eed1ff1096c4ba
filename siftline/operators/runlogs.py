"""Logs of test runs as tables of lines: outcomes, failed tests, and the sections that tell about them.

Lines are lines(run_id, line_no, line, dialect); lines of a run are numbered from 0. A run may have any number of lines: what
is asked of all of them is summed up by marks, and sections are numbered over blocks of lines first.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


@dataclass(frozen=True)
class Dialect:
    """Patterns of one runner: counts of failed tests and of errors, with the number as the first group; ids of failed tests;
    the headings of sections, with what they are about; where the report begins and where it ends (exclusive)."""

    failed: str
    errors: str
    ids: str
    heading: str
    begins: str
    ends: str
    first_end: bool


#: What three runners print.
DIALECTS = {
    "pytest": Dialect(r"(\d+) failed", r"(\d+) error in", r"(?:FAILED|ERROR )(.*::.*)", r"^_+ (\S+) _+$", r"= (?:FAILURES|ERRORS) =", r"= (?:short test summary info|warnings summary) =", True),
    "unittest": Dialect(r"failures=(\d+)", r"errors=(\d+)", r"(?:FAIL|ERROR): (.*)", r"^(?:FAIL|ERROR): (.*)$", r"(?:FAIL|ERROR):", r"Ran.*test", False),
    "finished": Dialect(r"tests finished.* (\d+) failed", r"tests finished.* (\d+) exceptions", r"^_+ (\S*test\S*)$", r"^_+ (\S+)$", r"FAIL", r"tests finished", False),
}
BLOCK = 4096


def _by_dialect(value) -> Column:
    """value(dialect) of a line's own dialect; null for others."""
    out = F.lit(None)
    for name, d in DIALECTS.items():
        out = F.when(F.col("dialect") == name, value(d)).otherwise(out)
    return out


def _count(pattern: str) -> Column:
    return F.aggregate(F.regexp_extract_all("line", F.lit(pattern), F.lit(1)), F.lit(0).cast("long"), lambda a, x: a + x.cast("long"))


def outcomes(lines: DataFrame) -> DataFrame:
    """(run_id, n_failed, n_errors, status, first, last) of each run: status is -1 with errors, 1 with failed tests, else 0; the
    report is the lines from first to before last, both null if it has none. It begins at the last beginning (before the
    first end, in dialects that end at that) and ends at an end behind it, or with the run."""
    marked = lines.select(
        "run_id", "line_no", _by_dialect(lambda d: _count(d.failed)).alias("failed"), _by_dialect(lambda d: _count(d.errors)).alias("errors"),
        _by_dialect(lambda d: F.lit(d.first_end)).alias("first_end"), _by_dialect(lambda d: F.rlike("line", F.lit(d.begins))).alias("begins"), _by_dialect(lambda d: F.rlike("line", F.lit(d.ends))).alias("ends"),
    )
    when = lambda c: F.when(F.col(c), F.col("line_no"))
    runs = marked.groupBy("run_id").agg(
        F.coalesce(F.sum("failed"), F.lit(0)).alias("n_failed"), F.coalesce(F.sum("errors"), F.lit(0)).alias("n_errors"), F.first("first_end").alias("first_end"),
        F.min(when("ends")).alias("e0"), F.max(when("ends")).alias("e1"), F.max(when("begins")).alias("b1"), (F.max("line_no") + 1).alias("n"),
    )
    early = marked.where("begins and first_end").join(runs.where("e0 is not null and first_end").select("run_id", "e0"), "run_id").where("line_no < e0")
    runs = runs.join(early.groupBy("run_id").agg(F.max("line_no").alias("b0")), "run_id", "left")
    first = F.when(F.col("first_end") & F.col("e0").isNotNull(), F.col("b0")).otherwise(F.col("b1"))
    end = F.when(F.col("first_end"), F.col("e0")).otherwise(F.col("e1"))
    last = F.when(end > first, end).otherwise(F.col("n"))
    told = (F.col("n_failed") + F.col("n_errors") > 0) & first.isNotNull()
    status = F.when(F.col("n_errors") > 0, -1).when(F.col("n_failed") > 0, 1).otherwise(0)
    return runs.select("run_id", "n_failed", "n_errors", status.alias("status"), F.when(told, first).alias("first"), F.when(told, last).alias("last"))


def failed_tests(lines: DataFrame) -> DataFrame:
    """(run_id, test_id): the tests that a run names as failed, each once."""
    found = lines.select("run_id", F.explode(_by_dialect(lambda d: F.regexp_extract_all("line", F.lit(d.ids), F.lit(1)))).alias("test_id"))
    return found.select("run_id", F.trim("test_id").alias("test_id")).where("test_id <> ''").distinct()


def sections(lines: DataFrame) -> DataFrame:
    """lines with section, about and offset: lines behind a heading belong to it up to the next one; those before the first
    have section 0 and about nothing. The offset counts from the heading."""
    heading = _by_dialect(lambda d: F.regexp_extract("line", d.heading, 1))
    x = lines.withColumn("_about", F.when(heading != "", heading)).withColumn("_block", F.floor(F.col("line_no") / BLOCK))
    x = x.withColumn("_mark", F.when(F.col("_about").isNotNull(), F.struct("line_no", "_about")))
    ahead = Window.partitionBy("run_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = x.groupBy("run_id", "_block").agg(F.count("_mark").alias("n"), F.max("_mark").alias("m"))
    blocks = blocks.select("run_id", "_block", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("_before"), F.max("m").over(ahead).alias("_last"))
    inside = Window.partitionBy("run_id", "_block").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    x = x.join(blocks, ["run_id", "_block"])
    mark = F.coalesce(F.max("_mark").over(inside), F.col("_last"))
    x = x.withColumns({"section": F.col("_before") + F.count("_mark").over(inside), "_mark": mark})
    return x.select(*lines.columns, "section", F.col("_mark._about").alias("about"), (F.col("line_no") - F.col("_mark.line_no")).alias("offset"))


def reports(lines: DataFrame) -> DataFrame:
    """The lines of each run's report, with their sections."""
    held = outcomes(lines).where("first is not null").select("run_id", "first", "last")
    return sections(lines).join(held, "run_id").where("line_no >= first and line_no < last").drop("first", "last")
