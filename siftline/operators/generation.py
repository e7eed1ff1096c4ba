"""Keys, configuration and sampling plans of test generation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def samples(bugs: DataFrame, n: int, done: DataFrame | None = None) -> DataFrame:
    """n output keys `id_n{i}` for each bug(instance_id), without those that exist in done(sample)."""
    rows = bugs.withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(n))))
    rows = rows.withColumn("sample", F.concat(F.col("instance_id"), F.lit("_n"), F.col("i").cast("string")))
    return rows if done is None else rows.join(done.select("sample"), "sample", "left_anti")


def first_hit(tries: DataFrame, key: str, order: str, ok: Column) -> DataFrame:
    """Of each key's tries the first that answered."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return tries.where(ok).withColumn("_r", rank).where("_r = 1").drop("_r")


def group_max(rows: DataFrame, key: str, columns: list[str], at_least: float | None = None) -> DataFrame:
    """Largest value of each column by key; only keys that reach at_least in the first."""
    out = rows.groupBy(key).agg(*[F.max(c).alias(c) for c in columns])
    return out if at_least is None else out.where(F.col(columns[0]) >= at_least)


def most_common(rows: DataFrame, key: str, item: str) -> DataFrame:
    """(key, item, n): the most frequent item, ties by item."""
    counts = rows.groupBy(key, item).agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), item))
    return counts.withColumn("_r", rank).where("_r = 1").drop("_r")


def head(rows: DataFrame, key: str, order: str, n: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return rows.withColumn("_r", rank).where(F.col("_r") <= n).drop("_r")


def environment_name(repo: Column, version: Column) -> Column:
    return F.concat(F.lit("setup_"), F.replace(repo, F.lit("/"), F.lit("__")), F.lit("__"), version)


def test_command(specs: DataFrame, matrix: DataFrame, coverage: bool = False) -> DataFrame:
    """Adds command: the framework's call from matrix(repo, version, test_cmd) and the directives."""
    j = specs.join(matrix, ["repo", "version"], "left")
    call = F.concat(F.lit("coverage run -m "), "test_cmd") if coverage else F.col("test_cmd")
    return j.withColumn("command", F.concat_ws(" ", call, F.array_join("directives", " ")))


def module_name(path: Column) -> Column:
    return F.replace(F.regexp_replace(path, r"\.py$", ""), F.lit("/"), F.lit("."))


def hunk_header(old_start: Column, new_start: Column, lines: Column) -> Column:
    """Header of a hunk whose lines are an array: counts made again from their first characters."""
    n = lambda *heads: F.size(F.filter(lines, lambda x: F.substring(x, 1, 1).isin(*heads))).cast("string")
    return F.concat(F.lit("@@ -"), old_start.cast("string"), F.lit(","), n(" ", "-"), F.lit(" +"), new_start.cast("string"), F.lit(","), n(" ", "+"), F.lit(" @@"))


def running_delta(hunks: DataFrame) -> DataFrame:
    """Adds delta: lines that earlier hunks(patch, pos, added, removed) of the patch add or take away."""
    before = Window.partitionBy("patch").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return hunks.withColumn("delta", F.coalesce(F.sum(F.col("added") - F.col("removed")).over(before), F.lit(0)).cast("long"))


def minimal_hunks(lines: DataFrame, context: int = 1) -> DataFrame:
    """(patch, file, hunk, pre_start, pre_len, post_start, post_len, body) of lines(patch, file, old_hunk, pre_start, line_no,
    line): the changes (+ and -) with so many lines around them, and no others.

    The lines kept around one change are an interval; intervals that overlap or touch are one hunk, also across old hunks that
    follow each other without a gap, and a hunk whose changes are far apart becomes several. Starts are counted anew: on the
    old side from the lines before, on the new side by what the hunks before add and take away. Lines of an old hunk are
    numbered in line_no, its first old line is pre_start; old hunks don't overlap.
    """
    of_hunk, of_file = Window.partitionBy("patch", "file", "old_hunk").orderBy("line_no"), Window.partitionBy("patch", "file").orderBy("old_hunk", "line_no")
    sign = F.substring("line", 1, 1)
    changed = F.when(sign.isin("+", "-"), F.col("line_no"))
    x = lines.withColumns({
        "last": F.max(changed).over(of_hunk.rowsBetween(Window.unboundedPreceding, Window.currentRow)),
        "next": F.min(changed).over(of_hunk.rowsBetween(Window.currentRow, Window.unboundedFollowing)),
        "old": (sign != "+").cast("long"), "new": (sign != "-").cast("long"),
    })
    x = x.withColumn("at", F.col("pre_start") + F.coalesce(F.sum("old").over(of_hunk.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    x = x.where((F.col("line_no") - F.col("last") <= context) | (F.col("next") - F.col("line_no") <= context))
    begins = F.coalesce(F.lag(F.col("at") + F.col("old")).over(of_file) != F.col("at"), F.lit(True))
    x = x.withColumn("begins", begins.cast("long"))
    x = x.withColumn("hunk", F.sum("begins").over(of_file.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    body = F.transform(F.sort_array(F.collect_list(F.struct("old_hunk", "line_no", "line"))), lambda y: y["line"])
    h = x.groupBy("patch", "file", "hunk").agg(F.min("at").alias("pre_start"), F.sum("old").alias("pre_len"), F.sum("new").alias("post_len"), F.array_join(body, "\n").alias("body"))
    before = Window.partitionBy("patch", "file").orderBy("hunk").rowsBetween(Window.unboundedPreceding, -1)
    moved = F.coalesce(F.sum(F.col("post_len") - F.col("pre_len")).over(before), F.lit(0))
    return h.select("patch", "file", "hunk", "pre_start", "pre_len", (F.col("pre_start") + moved).alias("post_start"), "post_len", "body")
