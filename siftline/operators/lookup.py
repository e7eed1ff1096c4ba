"""Filters, joins and keyword lookups over hierarchies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def not_done(rows: DataFrame, done: DataFrame, key: str, at_least: int = 1) -> DataFrame:
    """Rows whose key has fewer than at_least rows in the sink."""
    have = done.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") >= at_least)
    return rows.join(have, key, "left_anti")


def between_ids(rows: DataFrame, key: str, first, end) -> DataFrame:
    """From first (inclusive) to end (exclusive) in the order of the key."""
    return rows.where((F.col(key) >= first) & (F.col(key) < end))


def keep_first(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_r", rank).where("_r = 1").drop("_r")


def range_join(points: DataFrame, ranges: DataFrame, point: str, lo: str, hi: str, bucket: int, equal: list[str] | None = None) -> DataFrame:
    """Points within [lo, hi] of ranges, matched through buckets of the axis, so that it is an equi-join."""
    equal = equal or []
    p = points.withColumn("_b", F.floor(F.col(point) / bucket))
    r = ranges.withColumn("_b", F.explode(F.sequence(F.floor(F.col(lo) / bucket), F.floor(F.col(hi) / bucket))))
    return p.join(r, [*equal, "_b"]).where(F.col(point).between(F.col(lo), F.col(hi))).drop("_b")


def visible_matches(keywords: DataFrame, nodes: DataFrame) -> DataFrame:
    """(keyword, node_id): nodes(node_id, name, ancestors) of a keyword's name, but for those below another match."""
    hit = keywords.join(nodes, keywords["keyword"] == nodes["name"]).select("keyword", "node_id", "ancestors")
    above = hit.select("keyword", F.col("node_id").alias("up"))
    under = hit.select("keyword", "node_id", F.explode("ancestors").alias("up")).join(above, ["keyword", "up"], "left_semi")
    return hit.select("keyword", "node_id").join(under.select("keyword", "node_id"), ["keyword", "node_id"], "left_anti")


def path_matches(keywords: DataFrame, nodes: DataFrame) -> DataFrame:
    """(keyword, node_id): the keyword's dotted parts equal the node's last names; nodes have path, an array of names."""
    k = keywords.withColumn("parts", F.split("keyword", r"\.")).withColumn("last", F.element_at("parts", -1))
    n = nodes.withColumn("last", F.element_at("path", -1))
    tail = F.slice("path", F.greatest(F.lit(1), F.size("path") - F.size("parts") + 1), F.size("parts"))
    return k.join(n, "last").where(tail == F.col("parts")).select("keyword", "node_id")


def with_fallback(first: DataFrame, second: DataFrame, key: str = "keyword") -> DataFrame:
    """Rows of first, and those of second whose key has none there."""
    return first.unionByName(second.join(first.select(key).distinct(), key, "left_anti"))


def ambiguity_scores(hits: DataFrame) -> DataFrame:
    """hits(keyword, node_id, path) with node_score and file_score: each keyword gives 1 / its hits to node and path."""
    share = 1.0 / F.count("*").over(Window.partitionBy("keyword"))
    rows = hits.withColumn("_s", share)
    node, path = Window.partitionBy("node_id"), Window.partitionBy("path")
    return rows.withColumns({"node_score": F.sum("_s").over(node), "file_score": F.sum("_s").over(path)}).drop("_s")


def best_nodes(scored: DataFrame, parents: DataFrame) -> DataFrame:
    """(keyword, node_id, total): per keyword the node of the highest node + file + parent score, ties by node_id."""
    up = parents.select(F.col("node_id").alias("_p"), F.col("node_score").alias("_ps")).distinct()
    j = scored.join(up, scored["parent_id"] == up["_p"], "left")
    j = j.withColumn("total", F.round(F.col("node_score") + F.col("file_score") + F.coalesce("_ps", F.lit(0.0)), 6))
    rank = F.row_number().over(Window.partitionBy("keyword").orderBy(F.desc("total"), "node_id"))
    return j.withColumn("_r", rank).where("_r = 1").select("keyword", "node_id", "total")


def missing_rows(needed: DataFrame, existing: DataFrame, columns: list[str]) -> DataFrame:
    """Needed rows without an equal one among the existing, null equal to null."""
    n, e = needed.alias("n"), existing.alias("e")
    on = F.lit(True)
    for c in columns:
        on = on & F.col(f"n.{c}").eqNullSafe(F.col(f"e.{c}"))
    return n.join(e, on, "left_anti")


def nodes_in_files(wanted: DataFrame, nodes: DataFrame) -> DataFrame:
    """(name, file, node_id): nodes(node_id, name, path) of a wanted(name, file) whose path contains the file."""
    n = nodes.select("node_id", F.col("name").alias("n_name"), "path")
    return wanted.join(n, (F.col("name") == F.col("n_name")) & F.col("path").contains(F.col("file"))).select("name", "file", "node_id")


def membership_flags(tests: DataFrame, related: DataFrame) -> DataFrame:
    """tests(name, file) with same_name and same_file: whether any related(name, file) has them."""
    out = tests
    for c in ("name", "file"):
        have = related.where(F.col(c).isNotNull()).select(F.col(c).alias("r_key")).distinct().withColumn("r_has", F.lit(True))
        out = out.join(have, out[c] == have["r_key"], "left").withColumn(f"same_{c}", F.coalesce("r_has", F.lit(False))).drop("r_key", "r_has")
    return out


def first_definitions(names: DataFrame, definitions: DataFrame) -> DataFrame:
    """(name, path): for each names(name) the first path, in order, of definitions(name, path); null if there is none."""
    first = definitions.groupBy("name").agg(F.min("path").alias("path"))
    return names.select("name").distinct().join(first, "name", "left")


def split_callable(name: Column) -> tuple[Column, Column]:
    """(class or empty, function) of `Class.f`, `Class::f` or `f`."""
    parts = F.split(name, r"\.|::")
    return F.when(F.size(parts) > 1, F.element_at(parts, 1)).otherwise(""), F.element_at(parts, -1)


def read_functions(asked: DataFrame, callables: DataFrame) -> DataFrame:
    """asked(file, function) with content, of the first of callables(path, parent, name, start_line, content); else null."""
    parent, name = split_callable(F.col("function"))
    c = callables.groupBy(F.col("path").alias("c_path"), F.col("parent").alias("c_parent"), F.col("name").alias("c_name")).agg(F.min_by("content", "start_line").alias("content"))
    a = asked.withColumns({"a_parent": parent, "a_name": name})
    on = (F.col("file") == F.col("c_path")) & (F.col("a_parent") == F.col("c_parent")) & (F.col("a_name") == F.col("c_name"))
    return a.join(c, on, "left").drop("a_parent", "a_name", "c_path", "c_parent", "c_name")


def related_tests(wanted: DataFrame, related: DataFrame, callables: DataFrame) -> DataFrame:
    """(instance_id, file, function, content): of wanted(instance_id) the tests of related(instance_id, tests), an array of
    (file, function), with their text; instances without any have none."""
    rows = wanted.select("instance_id").distinct().join(related, "instance_id").select("instance_id", F.explode("tests").alias("t"))
    return read_functions(rows.select("instance_id", F.col("t.file").alias("file"), F.col("t.function").alias("function")), callables)
