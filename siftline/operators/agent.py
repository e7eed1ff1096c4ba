"""What an agent asks of a repository, as lookups over tables of its files and callables; many questions at a time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lookup import read_functions


def entries(files: DataFrame) -> DataFrame:
    """(folder, entry) of files(path): what each folder holds, folders with a slash behind."""
    parts = F.split("path", "/")
    at = F.explode(F.sequence(F.lit(1), F.size(parts))).alias("depth")
    rows = files.select(parts.alias("parts"), at)
    to = lambda n: F.array_join(F.slice("parts", F.lit(1), n), "/")
    slash = F.when(F.col("depth") < F.size("parts"), "/").otherwise("")
    return rows.select(to(F.col("depth") - 1).alias("folder"), F.concat(to(F.col("depth")), slash).alias("entry")).distinct()


def _listed(asked: DataFrame, key: str, rows: DataFrame, value: str, none: Column) -> DataFrame:
    lists = rows.groupBy(F.col(key).alias("l_key")).agg(F.array_join(F.sort_array(F.collect_set(value)), "\n").alias("l_text"))
    out = asked.join(lists, asked[key] == lists["l_key"], "left")
    return out.withColumn("answer", F.when(F.length("l_text") > 0, F.col("l_text")).otherwise(none)).drop("l_key", "l_text")


def list_folders(asked: DataFrame, files: DataFrame) -> DataFrame:
    """asked(folder) with answer: its Python files and folders, a line each."""
    e = entries(files).where("entry like '%.py' or entry like '%/'")
    a = asked.withColumn("folder", F.regexp_replace("folder", "/$", ""))
    return _listed(a, "folder", e, "entry", F.concat(F.lit("Error: Path "), F.col("folder"), F.lit(" does not exist")))


def list_roots(asked: DataFrame, files: DataFrame) -> DataFrame:
    """asked(test_dir) with answer: what the folder holds or, for a pattern with stars, the folders that it matches."""
    e = entries(files).select("folder", F.regexp_replace("entry", "/$", "").alias("entry"))
    plain = asked.select("test_dir").distinct().where(~F.col("test_dir").contains("*"))
    plain = plain.join(e, F.regexp_replace("test_dir", "/$", "") == F.col("folder")).select("test_dir", "entry")
    stars = asked.select("test_dir").distinct().where(F.col("test_dir").contains("*")).withColumn("last", F.element_at(F.split(F.regexp_replace("test_dir", "/$", ""), "/"), -1))
    shape = F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace("test_dir", "/$", ""), r"\*\*/", "(?:.*/)?"), F.lit("$"))
    named = e.withColumn("e_last", F.element_at(F.split("entry", "/"), -1))
    stars = stars.join(named, F.col("last") == F.col("e_last")).where(F.rlike(F.col("entry"), shape)).select("test_dir", "entry")
    return _listed(asked, "test_dir", plain.unionByName(stars), "entry", F.lit(""))


def list_definitions(asked: DataFrame, callables: DataFrame, files: DataFrame) -> DataFrame:
    """asked(file) with answer: the tests of the file, `Class.name` or `name`, a line each."""
    name = F.when(F.col("parent") == "", F.col("name")).otherwise(F.concat_ws(".", "parent", "name"))
    rows = callables.where("is_test").select(F.col("path").alias("file"), name.alias("shown"))
    known = files.select(F.col("path").alias("k_path")).distinct()
    a = asked.join(known, asked["file"] == known["k_path"], "left")
    none = F.when(F.col("k_path").isNull(), F.concat(F.lit("Error: File "), F.col("file"), F.lit(" does not exist")))
    none = none.otherwise(F.concat(F.lit("Error: No **Test** classes or functions found in "), F.col("file")))
    return _listed(a, "file", rows, "shown", none).drop("k_path")


def read_function(asked: DataFrame, callables: DataFrame, files: DataFrame) -> DataFrame:
    """asked(file, function) with answer: its text."""
    known = files.select(F.col("path").alias("k_path")).distinct()
    r = read_functions(asked, callables).join(known, F.col("file") == F.col("k_path"), "left")
    missing = F.when(F.col("k_path").isNull(), F.concat(F.lit("Error: File "), F.col("file"), F.lit(" does not exist")))
    missing = missing.otherwise(F.concat(F.lit("Error: Function "), F.col("function"), F.lit(" not found in "), F.col("file")))
    return r.withColumn("answer", F.coalesce("content", missing)).drop("content", "k_path")
