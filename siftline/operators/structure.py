"""Structure trees of any depth as tables of intervals: qualified names, ancestors, descendants, dotted lookups.

A tree is nodes(node_id, parent_id, name). Its Euler tour enters each node, visits its children by name and id, and leaves
it; enter and leave are the positions of these two steps, so a node stands below another one exactly if its enter lies between
the other's. All searches along the tree are then joins of points with ranges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.documents import staged
from .lookup import range_join

#: Positions of a block: joins and running maxima meet blocks of the tour, never all of it in one task.
BLOCK = 4096


def rooted(nodes: DataFrame) -> DataFrame:
    """nodes with path, the steps (name, node_id) from the root to the node.

    Each round joins a node's path with that of the node above it, so paths double: a tree of depth d takes log2(d) + 1
    rounds. A parent that is null or no node makes a root; nodes on or below a cycle have none and are left out. A null name
    is empty; ids are unique.
    """
    n = nodes.select("node_id", F.col("parent_id").alias("up"), "parent_id", F.coalesce("name", F.lit("")).alias("name"))
    state = staged(n.select("node_id", "parent_id", "name", "up", F.array(F.struct("name", "node_id")).alias("path")))
    while not state.where("up is not null").isEmpty():
        above = state.select(F.col("node_id").alias("a_id"), F.col("up").alias("a_up"), F.col("path").alias("a_path"))
        grown = state.where("up is not null").join(above, F.col("up") == F.col("a_id"), "left")
        path = F.when(F.col("a_id").isNull(), F.col("path")).otherwise(F.concat("a_path", "path"))
        grown = grown.select("node_id", "parent_id", "name", F.col("a_up").alias("up"), path.alias("path"))
        cyclic = F.exists("path", lambda s: s["node_id"] == F.col("up"))
        state = staged(state.where("up is null").unionByName(grown.where(F.col("up").isNull() | ~cyclic)))
    return state.drop("up")


def numbered(rows: DataFrame, by: str, out: str) -> DataFrame:
    """rows with their positions from 0 in the order of a column of distinct values: sorted in ranges, each range counted,
    and the counts summed up; only the counts, one a range, meet in one task."""
    ranged = rows.repartitionByRange(by).sortWithinPartitions(by)
    ranged = staged(ranged.withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33)))
    counts = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("_part", before.alias("_start"))
    inside = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return ranged.join(F.broadcast(starts), "_part").withColumn(out, F.col("_start") + inside).drop("_at", "_part", "_start")


def labelled(nodes: DataFrame) -> DataFrame:
    """nodes(node_id, parent_id, name) -> node_id, parent_id, name, path (names from the root), depth (0 at a root), enter and
    leave."""
    tree = staged(rooted(nodes))
    step = lambda last, name, node_id: F.struct(F.lit(last).alias("last"), name.alias("name"), node_id.cast("string").alias("id"))
    down = F.transform("path", lambda s: step(0, s["name"], s["node_id"]))
    back = F.concat(down, F.array(step(1, F.lit(""), F.lit(""))))  # behind all that stands below the node
    moves = tree.select("node_id", F.explode(F.array(down, back)).alias("key"))
    tour = numbered(moves, "key", "at").groupBy("node_id").agg(F.min("at").alias("enter"), F.max("at").alias("leave"))
    named = tree.select("node_id", "parent_id", "name", F.col("path.name").alias("path"), (F.size("path") - 1).alias("depth"))
    return staged(named.join(tour, "node_id"))


def full_name(tree: DataFrame) -> DataFrame:
    """tree with full_name: the names from the root joined by dots, the first one as a path of a file (without .py, its
    slashes as dots)."""
    module = F.replace(F.replace(F.element_at("path", 1), F.lit(".py"), F.lit("")), F.lit("/"), F.lit("."))
    return tree.withColumn("full_name", F.concat_ws(".", module, F.slice("path", 2, F.greatest(F.size("path") - 1, F.lit(0)))))


def below(tree: DataFrame, tops: DataFrame) -> DataFrame:
    """(top_id, node_id, distance): all nodes of tree below each of tops, rows of the same tree."""
    t = tops.select(F.col("node_id").alias("top_id"), F.col("depth").alias("t_depth"), (F.col("enter") + 1).alias("lo"), (F.col("leave") - 1).alias("hi")).where("lo <= hi")
    pairs = range_join(tree.select("node_id", "depth", "enter"), t, "enter", "lo", "hi", BLOCK)
    return pairs.select("top_id", "node_id", (F.col("depth") - F.col("t_depth")).alias("distance"))


def above(tree: DataFrame, of: DataFrame) -> DataFrame:
    """(node_id, top_id, distance): all nodes of tree above each of `of`, rows of the same tree."""
    return below(of, tree).select("node_id", "top_id", "distance")


def topmost(tree: DataFrame) -> DataFrame:
    """The nodes without a node of the same name above them: a search by name that stops at what it finds sees these.

    Along the tour, a node is below an earlier one of its name if the largest leave so far lies behind it. The running
    maximum is taken over blocks first, then inside of each.
    """
    t = tree.withColumn("_block", F.floor(F.col("enter") / BLOCK))
    ahead = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    blocks = t.groupBy("name", "_block").agg(F.max("leave").alias("_most"))
    blocks = blocks.select("name", "_block", F.max("_most").over(ahead(Window.partitionBy("name").orderBy("_block"))).alias("_before"))
    t = t.join(blocks, ["name", "_block"])
    so_far = F.greatest("_before", F.max("leave").over(ahead(Window.partitionBy("name", "_block").orderBy("enter"))))
    return t.withColumn("_far", so_far).where("_far is null or _far < enter").select(*tree.columns)


def dotted_matches(keywords: DataFrame, tree: DataFrame) -> DataFrame:
    """(keyword, node_id): for each of keywords(keyword, project) its nodes.

    The last part names the topmost nodes. If it is the only one, it is the match, whatever the other parts are; of
    several, those match whose path ends with all parts (without the first one, if that is the project). Paths are indexed by
    hashes of their last names, a row for each number of parts that a keyword has, so that a keyword meets only the nodes
    that match it, however frequent its last name is.
    """
    parts = F.split("keyword", r"\.")
    own = (F.size(parts) > 1) & F.coalesce(F.element_at(parts, 1) == F.col("project"), F.lit(False))
    k = keywords.select("keyword", F.when(own, F.slice(parts, 2, F.size(parts))).otherwise(parts).alias("parts"))
    k = k.distinct().withColumns({"last": F.element_at("parts", -1), "n_parts": F.size("parts")})
    seen = staged(topmost(tree).select("node_id", "name", "path"))
    names = seen.groupBy("name").agg(F.count("*").alias("n"), F.min("node_id").alias("only"))
    k = staged(k.join(names, F.col("last") == F.col("name")))
    unique = k.where("n = 1").select("keyword", F.col("only").alias("node_id"))
    lengths = k.where("n > 1").agg(F.collect_set("n_parts").alias("lengths"))  # one row of as many numbers as a path has parts
    tails = seen.join(F.broadcast(lengths)).select("node_id", "path", F.explode(F.filter("lengths", lambda x: x <= F.size("path"))).alias("l"))
    tails = tails.select("node_id", "l", F.slice("path", F.size("path") - F.col("l") + 1, F.col("l")).alias("tail")).withColumn("h", F.xxhash64("tail"))
    many = k.where("n > 1").select("keyword", "parts", "n_parts", F.xxhash64("parts").alias("k_h"))
    hits = tails.join(many, (F.col("h") == F.col("k_h")) & (F.col("l") == F.col("n_parts"))).where(F.col("tail") == F.col("parts"))
    return unique.unionByName(hits.select("keyword", "node_id"))
