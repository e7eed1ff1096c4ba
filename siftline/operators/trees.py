"""Call trees: unfolding, weights, edit distance."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache, reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.documents import checkpoints, staged

#: Depth at which unfolding stops, least and keyword weights.
DEPTH, LEAST, KEYWORD, SPAN = 5, 0.1, 1.0, 0.9


def unfold(roots: DataFrame, edges: DataFrame, depth: int = DEPTH, stop_at_cycles: bool = True) -> DataFrame:
    """(root, path, depth, name, truncated, recursive) of roots(root) along edges(src, dst).

    A node at `depth` is a truncated leaf; else one that stands above itself is a recursive leaf. A join a level; the
    edges are shuffled once by each, so trees of any number grow together.
    """
    level = roots.select("root", F.array(F.col("root").cast("string")).alias("path"), F.lit(0).alias("depth"), F.col("root").cast("string").alias("name"))
    level = level.withColumns({"truncated": F.lit(depth == 0), "recursive": F.lit(False)})
    out = level
    e = edges.select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"))
    for d in range(1, depth + 1):
        grown = level.where(~F.col("truncated") & ~F.col("recursive")).join(e, F.col("name") == F.col("src"))
        cut = F.lit(d == depth)
        again = F.array_contains("path", F.col("dst")) & ~cut if stop_at_cycles else F.lit(False)
        level = grown.select("root", F.concat("path", F.array("dst")).alias("path"), F.lit(d).alias("depth"), F.col("dst").alias("name"), cut.alias("truncated"), again.alias("recursive"))
        level = staged(level)  # no level computes those above it again
        out = out.unionByName(level)
    return out


def tree_df(trees: DataFrame) -> DataFrame:
    """(name, df): trees that hold a name below their root."""
    return trees.where("depth > 0").select("root", "name").distinct().groupBy("name").agg(F.count("*").alias("df"))


def node_weight(df: Column, total: Column, is_keyword: Column, least: float = LEAST) -> Column:
    """1 for keywords; least where df is 0 or all; else between least and 0.9 by rarity."""
    scale = F.when(total > 1, F.log10(total)).otherwise(F.lit(1.0))
    rare = least + (SPAN - least) * F.log10(total / (df + 1)) / scale
    return F.when(is_keyword, KEYWORD).when((df == 0) | (df >= total), least).otherwise(F.greatest(F.lit(least), rare))


def keyword_matches(keyword: Column, name: Column) -> Column:
    """A dotted keyword matches the name as a pattern (the name holds the wildcards); another one its last part."""
    quoted = F.regexp_replace(name, r"([\\.^$|()\[\]{}+])", r"\\$1")
    pattern = F.concat(F.lit("^"), F.replace(F.replace(quoted, F.lit("*"), F.lit(".*")), F.lit("?"), F.lit(".")), F.lit("$"))
    return F.when(keyword.contains("."), F.rlike(keyword, pattern)).otherwise(F.element_at(F.split(name, r"\."), -1) == keyword)


def edit_distance(a: list[tuple[int, str, float]], b: list[tuple[int, str, float]]) -> float:
    """Weighted ordered edit distance of trees as preorder lists of (depth, name, weight).

    Renaming costs both weights, inserting or deleting a node its own. Dynamic programming over postorder, a table for
    each pair of key roots.
    """

    def post(t):
        nodes, first, stack = [], [], []
        for depth, name, weight in t:
            while stack and stack[-1][0] >= depth:
                d, n, w, start = stack.pop()
                nodes.append((n, w))
                first.append(start)
            stack.append((depth, name, weight, None))
            start_at = len(nodes)
            stack = [(d, n, w, start_at if s is None else s) for d, n, w, s in stack]
        while stack:
            d, n, w, start = stack.pop()
            nodes.append((n, w))
            first.append(start)
        roots = {f: i for i, f in enumerate(first)}
        return nodes, first, sorted(roots.values())

    (na, fa, ka), (nb, fb, kb) = post(a), post(b)
    dist = [[0.0] * len(nb) for _ in na]
    for i in ka:
        for j in kb:
            x, y = fa[i], fb[j]
            m, n = i - x + 2, j - y + 2
            t = [[0.0] * n for _ in range(m)]
            for p in range(1, m):
                t[p][0] = t[p - 1][0] + na[x + p - 1][1]
            for q in range(1, n):
                t[0][q] = t[0][q - 1] + nb[y + q - 1][1]
            for p in range(1, m):
                u, wu = na[x + p - 1]
                for q in range(1, n):
                    v, wv = nb[y + q - 1]
                    best = min(t[p - 1][q] + wu, t[p][q - 1] + wv)
                    if fa[x + p - 1] == x and fb[y + q - 1] == y:
                        best = min(best, t[p - 1][q - 1] + (0.0 if u == v else wu + wv))
                        dist[x + p - 1][y + q - 1] = best
                    else:
                        best = min(best, t[fa[x + p - 1] - x][fb[y + q - 1] - y] + dist[x + p - 1][y + q - 1])
                    t[p][q] = best
    return dist[-1][-1] if na and nb else sum(w for _, _, w in [*a, *b])


@lru_cache(1 << 14)
def _shape_distance(a: tuple, b: tuple) -> float:
    return edit_distance(a, b)


def shape_distance(a: list[tuple[int, str, float]], b: list[tuple[int, str, float]]) -> float:
    """edit_distance, which asks only which names are equal: trees that differ in nothing else are compared once a process, as
    long as the last ones are held."""
    numbers: dict[str, int] = {}
    shape = lambda t: tuple((depth, numbers.setdefault(name, len(numbers)), weight) for depth, name, weight in t)
    return _shape_distance(shape(a), shape(b))


TREE = "array<struct<depth: int, name: string, weight: double>>"


def gathered(trees: DataFrame) -> DataFrame:
    """(root, tree): nodes in preorder, siblings by name, of weighted trees(root, path, depth, name, weight)."""
    node = F.struct("path", "depth", "name", "weight")
    nodes = F.sort_array(F.collect_list(node))
    return trees.groupBy("root").agg(F.transform(nodes, lambda n: F.struct(n["depth"].alias("depth"), n["name"].alias("name"), n["weight"].alias("weight"))).alias("tree"))


def similarities(pairs: DataFrame) -> DataFrame:
    """pairs(root_a, root_b, tree_a, tree_b) -> root_a, root_b, sim: 1 - distance / total weight, 0 without a tree."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        as_list = lambda t: [] if t is None else [(n["depth"], n["name"], n["weight"]) for n in t]
        for f in frames:
            sims = []
            for x, y in zip(map(as_list, f["tree_a"]), map(as_list, f["tree_b"]), strict=True):
                total = sum(w for _, _, w in [*x, *y])
                sims.append(0.0 if not x or not y or not total else round(1 - shape_distance(x, y) / total, 6))
            yield pd.DataFrame({"root_a": f["root_a"], "root_b": f["root_b"], "sim": sims})

    return pairs.mapInPandas(run, f"root_a {dict(pairs.dtypes)['root_a']}, root_b {dict(pairs.dtypes)['root_b']}, sim double")


def likeness_bound(a: Column, b: Column) -> Column:
    """No less than the similarity of two trees: a node that is kept has the same name in both, so of each name as much weight
    is kept at most as the side with less of it has."""
    names = lambda t: F.array_distinct(F.transform(t, lambda n: n["name"]))
    held = lambda t, name: F.aggregate(F.filter(t, lambda n: n["name"] == name), F.lit(0.0), lambda s, n: s + n["weight"])
    kept = F.aggregate(F.array_intersect(names(a), names(b)), F.lit(0.0), lambda s, name: s + 2 * F.least(held(a, name), held(b, name)))
    total = F.aggregate(F.concat(a, b), F.lit(0.0), lambda s, n: s + n["weight"])
    return F.when(total > 0, kept / total).otherwise(0.0)


#: Similarities are rounded to six places: bounds give way by more than that.
ROUNDED = 1e-5


def most_similar(pairs: DataFrame, k: int, treed=None) -> DataFrame:
    """(root_a, root_b, sim, r): for each root_a of pairs(root_a, root_b, tree_a, tree_b) its k most similar ones, ties by
    root_b.

    The quadratic program runs for the k pairs of the largest bound first; the least of what they reach then leaves out all
    pairs whose bound is lower. (root_a, root_b) is unique. Only bounds are written on the way. treed: gives the trees of some
    of the pairs, which come without.
    """
    treed = treed or (lambda some: pairs if some is pairs else pairs.join(some, ["root_a", "root_b"], "left_semi"))
    bounded = staged(treed(pairs).select("root_a", "root_b", likeness_bound(F.col("tree_a"), F.col("tree_b")).alias("bound")))
    ranked = bounded.withColumn("r", F.row_number().over(Window.partitionBy("root_a").orderBy(F.desc("bound"), "root_b")))
    tried = staged(similarities(treed(ranked.where(F.col("r") <= k).select("root_a", "root_b"))))
    floor = tried.groupBy("root_a").agg(F.min("sim").alias("floor"))
    more = ranked.where(F.col("r") > k).join(floor, "root_a").where(F.col("bound") >= F.col("floor") - ROUNDED).select("root_a", "root_b")
    every = tried.unionByName(similarities(treed(more)))
    nth = F.row_number().over(Window.partitionBy("root_a").orderBy(F.desc("sim"), "root_b"))
    return every.withColumn("r", nth).where(F.col("r") <= k)


#: Pairs whose trees are moved at once.
AT_ONCE = 1 << 22


def most_similar_of(pairs: DataFrame, trees: DataFrame, k: int) -> DataFrame:
    """most_similar of pairs(root_a, root_b) of trees(root, tree): a slice of the roots_a after the other, as their pairs are
    apart, so that the trees beside each other on disk are those of a slice, whatever the number of pairs."""
    pairs = staged(pairs.select("root_a", "root_b"))
    left, right = (trees.select(F.col("root").alias(f"root_{x}"), F.col("tree").alias(f"tree_{x}")) for x in "ab")
    treed = lambda some: some.join(left, "root_a").join(right, "root_b").select("root_a", "root_b", "tree_a", "tree_b")
    slices = max(1, -(-pairs.count() // AT_ONCE))
    found = []
    for i in range(slices):
        some = pairs.where(F.pmod(F.xxhash64("root_a"), F.lit(slices)) == i)
        found.append(staged(most_similar(some, k, treed)))
    return reduce(DataFrame.unionByName, found)


def _closure_by_steps(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """closure by a join a step, until no step adds any. Each front is checkpointed, so that no step computes those before it
    again; fronts are joined where they lie, as a broadcast a step would go through the driver. All that is reached so far is
    moved by each step."""
    seen = front = roots.select("root", F.col("root").alias("node")).distinct()
    with checkpoints(roots.sparkSession):
        while not front.isEmpty():
            front = front.hint("merge").join(edges, front["node"] == edges["src"]).select("root", F.col("dst").alias("node")).distinct()
            front = front.hint("merge").join(seen, ["root", "node"], "left_anti").checkpoint()
            seen = seen.unionByName(front)
    return seen


#: Sets of nodes are cut, by a hash, into arrays of so many nodes at most.
SET = 1 << 22


def closure(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, node): all nodes that roots(root) reach along edges(src, dst), the root included.

    Where most nodes that are reached are roots, each node's set is made up once, from the finished sets of those that it leads
    to: as many rounds as the longest way has edges, and a set moves once an edge. Nodes on cycles or before them wait in the
    end; among these alone, and where roots are few, sets grow by steps. Nothing is broadcast.
    """
    schema = roots.select("root", "root").union(edges.select("src", "dst").select("dst", "dst")).schema
    kind = schema[1].dataType
    e = staged(edges.where("src is not null and not src <=> dst").select(F.col("src").cast(kind).alias("src"), F.col("dst").cast(kind).alias("dst")).distinct())
    links, merge = e.where("dst is not null"), lambda df: df.hint("merge")
    known = front = staged(roots.where("root is not null").select(F.col("root").cast(kind).alias("node")).distinct())
    asked = n = known.count()
    while n and known.count() <= 2 * asked:
        front = staged(merge(front).join(links, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct().join(merge(known), "node", "left_anti"))
        n = front.count()
        known = known.unionByName(front)
    if n:
        return _closure_by_steps(edges, roots)

    parts = -(-known.count() // SET)
    part = F.pmod(F.xxhash64("member"), F.lit(parts)).cast("int").alias("part")
    single = lambda df: df.select("node", part, F.array("member").alias("members"))
    nulls = e.where("dst is null").select(F.col("src").alias("node"), F.col("dst").alias("member"))
    base = single(known.select("node", F.col("node").alias("member"))).unionByName(single(nulls))
    whole = lambda df: df.groupBy("node", "part").agg(F.array_distinct(F.flatten(F.collect_list("members"))).alias("members"))

    def behind(sources: DataFrame, done: DataFrame) -> DataFrame:
        """The nodes of sources(node) and the sets of what they lead to."""
        inner = merge(links.withColumnRenamed("src", "node")).join(merge(sources), "node", "left_semi")
        sets = merge(inner).join(done.select(F.col("node").alias("dst"), "part", "members"), "dst").select("node", "part", "members")
        return whole(sets.unionByName(merge(base).join(merge(sources), "node", "left_semi")))

    waiting = staged(merge(links).join(known.select(F.col("node").alias("src")), "src", "left_semi"))
    ready = staged(merge(known).join(waiting.select(F.col("src").alias("node")), "node", "left_anti"))
    done = staged(whole(merge(base).join(merge(ready), "node", "left_semi")))
    while not ready.isEmpty():
        left = staged(merge(waiting).join(ready.select(F.col("node").alias("dst")), "dst", "left_anti").select("src", "dst"))
        sources = waiting.select(F.col("src").alias("node")).distinct()
        ready = staged(merge(sources).join(left.select(F.col("src").alias("node")), "node", "left_anti"))
        waiting = left
        if not ready.isEmpty():
            done = done.unionByName(staged(behind(ready, done)))
    if not waiting.isEmpty():
        tied = staged(waiting.select(F.col("src").alias("node")).distinct())
        own = behind(tied, done).select(F.col("node").alias("inner"), "part", "members")
        among = _closure_by_steps(waiting, tied.select(F.col("node").alias("root"))).select(F.col("root").alias("node"), F.col("node").alias("inner"))
        done = done.unionByName(staged(whole(merge(among).join(own, "inner").select("node", "part", "members"))))
    if known.count() > asked:
        done = merge(done).join(roots.select(F.col("root").cast(kind).alias("node")).distinct(), "node", "left_semi")
    out = done.select(F.col("node").cast(schema[0].dataType).alias("root"), F.explode("members").alias("node"))
    return out.unionByName(roots.where("root is null").select("root", F.col("root").cast(kind).alias("node")).distinct())


def tree_rows(trees: DataFrame) -> DataFrame:
    """(root, path, depth, name) of trees(root, tree), a JSON text of name and children, in the form of unfold."""

    def rows(root, node, path):
        path = [*path, node["name"]]
        yield root, path, len(path) - 1, node["name"]
        for child in node.get("children") or []:
            yield from rows(root, child, path)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = [r for root, tree in zip(f["root"], f["tree"], strict=True) if tree for r in rows(root, json.loads(tree), [])]
            yield pd.DataFrame(out, columns=["root", "path", "depth", "name"])

    return trees.select("root", "tree").mapInPandas(run, f"root {dict(trees.dtypes)['root']}, path array<string>, depth int, name string")
