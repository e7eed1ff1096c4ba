"""Nearest neighbours by inner product: a vantage-point tree per shard."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize


@dataclass(frozen=True)
class Search:
    """k nearest; leaves of at most `leaf` vectors. Vectors are dealt to the nearest of at most `pivots` of them, picked by
    a hash, one for about shard_rows vectors; larger cells are cut into shards of about shard_rows. relax: a cell or a
    subtree is left out if its least distance exceeds the kth best distance / relax; one gives exact results, more
    prunes more."""

    k: int = 20
    shard_rows: int = 4096
    pivots: int = 1024
    leaf: int = 128
    relax: float = 1.0


def usable(v: Column) -> Column:
    """Vectors that take part: not null, no null or non-finite component, not zero."""
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(v.isNotNull() & fine & F.exists(v, lambda x: x != 0), F.lit(False))


class VantageTree:
    """Vectors are lifted to one norm (an added coordinate sqrt(top - |x|^2)), so that the largest inner product is the
    least Euclidean distance and the triangle inequality holds. Equal vectors are held once."""

    def __init__(self, x: np.ndarray, top: float, leaf: int):
        self.x = x
        norms = np.einsum("ij,ij->i", x, x)
        self.lifted = np.concatenate((x, np.sqrt(np.maximum(0.0, top - norms))[:, None]), 1)
        self.top = top
        self.nodes: list[tuple] = []  # (vantage vector, [(low, high, child)]) or (None, rows)
        self.root = self._build(np.arange(len(x)), leaf)

    def _distance(self, rows: np.ndarray, v: np.ndarray) -> np.ndarray:
        d = self.lifted[rows] - v
        return np.sqrt(np.einsum("ij,ij->i", d, d))

    def _build(self, rows: np.ndarray, leaf: int) -> int:
        at = len(self.nodes)
        self.nodes.append((None, rows))
        if len(rows) > leaf:
            v = self.lifted[rows[int(self._distance(rows, self.lifted[rows[0]]).argmax())]]
            d = self._distance(rows, v)
            order = np.argsort(d, kind="stable")
            half = len(rows) // 2
            parts = [(order[:half]), (order[half:])]
            self.nodes[at] = (v, [(d[p[0]], d[p[-1]], self._build(rows[p], leaf)) for p in parts])
        return at

    def search(self, q: np.ndarray, k: int, relax: float, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(query, row) candidates that hold the k best of each query and all that tie with them; known: scores that k rows
        elsewhere reach."""
        norms = np.einsum("ij,ij->i", q, q)
        lifted = np.concatenate((q, np.zeros((len(q), 1))), 1)
        slack = 1e-9 * (1 + np.sqrt(norms * self.top))
        best = np.full((len(q), k), -np.inf)
        known = np.full(len(q), -np.inf) if known is None else known
        floor = known
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        every = np.arange(len(q))

        def worst(ids):
            return np.maximum(best[ids].min(1), floor[ids]) - slack[ids]

        def away(v, ids):
            return np.sqrt(((lifted[ids] - v) ** 2).sum(1))

        def scan(rows, ids):
            s = q[ids] @ self.x[rows].T
            i, j = np.nonzero(s >= worst(ids)[:, None])
            found.append((ids[i], rows[j], s[i, j]))
            both = np.concatenate((best[ids], s), 1)
            best[ids] = np.partition(both, both.shape[1] - k, 1)[:, -k:]

        def descend(node, ids):  # each query to one leaf near it
            v, children = self.nodes[node]
            if v is None:
                return scan(children, ids)
            inside = away(v, ids) <= (children[0][1] + children[1][0]) / 2
            for (_, _, child), pick in zip(children, (inside, ~inside), strict=True):
                if pick.any():
                    descend(child, ids[pick])

        def visit(node, ids):
            v, children = self.nodes[node]
            if v is None:
                return scan(children, ids)
            d = away(v, ids)
            for low, high, child in children:
                far = np.sqrt(np.maximum(0.0, norms[ids] + self.top - 2 * worst(ids))) / relax
                pick = np.maximum(low - d, d - high) <= far + 1e-9
                if pick.any():
                    visit(child, ids[pick])

        descend(self.root, every)
        # The first leaf gives a bound; the search proper starts anew, so that no row counts twice among the k best.
        floor = np.maximum(best.min(1), known)
        best[:] = -np.inf
        found.clear()
        visit(self.root, every)
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        a, b, s = (np.concatenate(c) for c in zip(*found, strict=True))
        keep = s >= worst(a)
        return a[keep], b[keep]


def scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products, each summed from the first component to the last, so that equal vectors get equal scores."""
    return np.add.reduce(np.ascontiguousarray((q * x).T), axis=0)


def matrix(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    return batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


class Cells:
    """Pivots by dimension, and of each cell (dimension, pivot) the largest distance of its vectors from the pivot and how
    many there are; a dimension without pivots has one cell of any radius. Distances are those of VantageTree."""

    def __init__(self, pivots: list[np.ndarray], top: float):
        self.top, self.pivots = top, {}
        for p in pivots:
            self.pivots.setdefault(len(p), []).append(p)
        self.pivots = {d: np.unique(np.array(p), axis=0) for d, p in self.pivots.items()}
        self.sizes: dict[tuple[int, int], tuple[float, int]] = {}

    def distances(self, x: np.ndarray, queries: bool) -> np.ndarray:
        """(vectors, cells) distances of the vectors from pivots; as queries they are lifted by nothing."""
        p = self.pivots.get(x.shape[1])
        if p is None:
            return np.zeros((len(x), 1))
        norms, own = np.einsum("ij,ij->i", x, x), np.einsum("ij,ij->i", p, p)
        dots = x @ p.T
        if queries:
            return np.sqrt(np.maximum(0.0, norms[:, None] + self.top - 2 * dots))
        up, down = np.sqrt(np.maximum(0.0, self.top - norms)), np.sqrt(np.maximum(0.0, self.top - own))
        return np.sqrt(np.maximum(0.0, 2 * self.top - 2 * (dots + up[:, None] * down)))

    def _about(self, dim: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        got = [self.sizes.get((dim, c), (0.0, 0)) for c in range(n)]
        radius = np.array([r if dim in self.pivots else np.inf for r, _ in got])
        return radius, np.array([m for _, m in got])

    def first(self, x: np.ndarray, enough: int) -> np.ndarray:
        """(vectors, cells): whether the cell is among the nearest ones that have `enough` vectors together."""
        d = self.distances(x, True)
        _, n = self._about(x.shape[1], d.shape[1])
        order = np.argsort(d, 1, kind="stable")
        before = np.cumsum(n[order], 1) - n[order]
        out = np.zeros(d.shape, bool)
        np.put_along_axis(out, order, (before < enough) & (n[order] > 0), 1)
        return out

    def admitted(self, x: np.ndarray, floor: np.ndarray, relax: float) -> np.ndarray:
        """(vectors, cells): whether the cell may hold a vector whose score reaches the floor."""
        d = self.distances(x, True)
        radius, n = self._about(x.shape[1], d.shape[1])
        norms = np.einsum("ij,ij->i", x, x)
        slack = 1e-6 * np.sqrt(1 + norms + self.top)  # of roots of rounded differences
        far = np.sqrt(np.maximum(0.0, norms + self.top - 2 * floor)) / relax
        return (d - radius <= (far + slack)[:, None]) & (n > 0)


def _by_dim(batch: pa.RecordBatch):
    dims = batch.column("dim").to_numpy()
    for dim in np.unique(dims):
        part = batch.filter(pa.array(dims == dim))
        yield int(dim), part, matrix(part, int(dim))


_FOUND = "query_id long, vec_id long, score double"


def _searched(base: DataFrame, asked: DataFrame, search: Search, top: float, shards: int) -> DataFrame:
    """(query_id, vec_id, score): of each shard's base(dim, cell, sub, vec_id, v) what may be among the k nearest of the
    queries asked(dim, cell, sub, vec_id, v, floor) there."""
    b = base.select("dim", "cell", "sub", F.lit(0).alias("kind"), "vec_id", "v", F.lit(None).cast("double").alias("floor"))
    a = asked.select("dim", "cell", "sub", F.lit(1).alias("kind"), "vec_id", "v", "floor")
    keys = ["dim", "cell", "sub"]
    mixed = b.union(a).repartition(shards, *keys).sortWithinPartitions(*keys, "kind", "vec_id")
    k, leaf, relax = search.k, search.leaf, search.relax

    def run(batches):
        key, tree, held, held_ids, unique_ids = None, None, [], [], []

        def plant():
            x, ids = np.concatenate(held), np.concatenate(held_ids)
            distinct, back = np.unique(x, axis=0, return_inverse=True)
            order = np.lexsort((ids, back.ravel()))
            groups = np.split(ids[order], np.flatnonzero(np.diff(back.ravel()[order])) + 1)
            return VantageTree(distinct, top, leaf), [np.unique(g)[: k + 1] for g in groups]

        for whole in batches:
            if not whole.num_rows:
                continue
            d, c, s, t = (whole.column(x).to_numpy() for x in ("dim", "cell", "sub", "kind"))
            edges = [0, *(np.flatnonzero((d[1:] != d[:-1]) | (c[1:] != c[:-1]) | (s[1:] != s[:-1]) | (t[1:] != t[:-1])) + 1).tolist(), whole.num_rows]
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                batch, dim = whole.slice(lo, hi - lo), int(d[lo])
                if key != (d[lo], c[lo], s[lo]):
                    key, tree, held, held_ids = (d[lo], c[lo], s[lo]), None, [], []
                if t[lo] == 0:
                    held.append(matrix(batch, dim))
                    held_ids.append(batch.column("vec_id").to_numpy())
                    continue
                if not held:
                    continue
                if tree is None:
                    tree, unique_ids = plant()
                for at in range(0, hi - lo, 1024):
                    part = batch.slice(at, 1024)
                    q, qid, floor = matrix(part, dim), part.column("vec_id").to_numpy(), part.column("floor").to_numpy()
                    i, j = tree.search(q, k + 1, relax, floor)
                    if not len(i):
                        continue
                    sizes = np.array([len(unique_ids[x]) for x in j], np.int64)
                    ids = np.concatenate([unique_ids[x] for x in j])
                    sc = np.repeat(scores(q[i], tree.x[j]), sizes)
                    i = np.repeat(i, sizes)
                    other = ids != qid[i]
                    i, ids, sc = i[other], ids[other], sc[other]
                    order = np.lexsort((ids, -sc, i))
                    i, ids, sc = i[order], ids[order], sc[order]
                    top_k = np.arange(len(i)) - np.searchsorted(i, i) < k
                    yield pa.RecordBatch.from_arrays([pa.array(qid[i[top_k]]), pa.array(ids[top_k]), pa.array(sc[top_k])], ["query_id", "vec_id", "score"])

    return mixed.mapInArrow(run, _FOUND)


def nearest(vectors: DataFrame, is_query: Column, search: Search = Search()) -> DataFrame:
    """query_id, rank, vec_id, score: for each query row of vectors(vec_id, embedding) its k nearest others by inner product.

    Vectors are dealt to the cells of their nearest pivots; a shard, a cell or a piece of one, has a vantage-point tree.
    Each query first searches the nearest cells that hold enough vectors; its kth score there bounds the distance of
    better ones, so of all other cells it visits only those that reach within it. Of equal vectors the k + 1 of the least
    ids are kept, as no others can be among a query's k nearest. Vectors are compared with those of their own length.
    Ties go to the smaller id; a row with the query's id is not its neighbour; of repeated query ids the least vector
    counts; unusable vectors and null ids take no part; an empty table gives no rows; other columns are ignored.
    """
    k = search.k
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("v"), is_query.alias("q")).where(usable(F.col("v")) & F.col("vec_id").isNotNull())
    rows = rows.withColumn("dim", F.size("v"))
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    about = rows.agg(F.count("*").alias("n"), F.max(norm).alias("top")).first()
    wanted, top = max(1, min(search.pivots, math.ceil(about["n"] / search.shard_rows))), float(about["top"] or 0.0) * (1 + 1e-12)
    picked = rows.orderBy(F.xxhash64("vec_id", F.lit("pivot")), "vec_id").limit(wanted).select("v").collect()  # `pivots` vectors at most
    cells = Cells([np.array(r["v"]) for r in picked], top)
    base = rows.distinct().withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).where(F.col("r") <= k + 1)

    def deal(batches):
        for batch in batches:
            for _, part, x in _by_dim(batch):
                d = cells.distances(x, False)
                cell = d.argmin(1)
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), part.column("v"), part.column("dim"), pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(x)), cell])], ["vec_id", "v", "dim", "cell", "away"])

    base = materialize(base.select("vec_id", "v", "dim").mapInArrow(deal, "vec_id long, v array<double>, dim int, cell int, away double"))
    for r in base.groupBy("dim", "cell").agg(F.max("away").alias("radius"), F.count("*").alias("n")).collect():  # a row a cell
        cells.sizes[r["dim"], r["cell"]] = r["radius"], r["n"]
    pieces = {key: math.ceil(n / search.shard_rows) for key, (_, n) in cells.sizes.items()}
    shards = max(1, sum(pieces.values()))

    def number(frame):  # which piece of its cell a vector is in
        sizes = F.create_map(*[F.lit(x) for (d, c), n in pieces.items() for x in (f"{d} {c}", n)]) if pieces else F.create_map(F.lit(""), F.lit(1))
        return frame.withColumn("sub", F.pmod(F.xxhash64("vec_id", F.lit("shard")), F.get(F.array(sizes[F.concat_ws(" ", F.col("dim").cast("string"), F.col("cell").cast("string"))]), F.lit(0))).cast("int"))

    base = number(base)

    def route(first: bool):
        def run(batches):
            for batch in batches:
                for dim, part, x in _by_dim(batch):
                    to = cells.first(x, k + 1)
                    if not first:
                        to = cells.admitted(x, part.column("floor").to_numpy(), search.relax) & ~to
                    i, c = np.nonzero(to)
                    n = np.array([pieces[dim, j] for j in c.tolist()], np.int64)
                    i, c, sub = np.repeat(i, n), np.repeat(c, n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    taken = part.take(pa.array(i))
                    cols = [taken.column("dim"), pa.array(c.astype(np.int32)), pa.array(sub.astype(np.int32)), taken.column("vec_id"), taken.column("v"), taken.column("floor")]
                    yield pa.RecordBatch.from_arrays(cols, ["dim", "cell", "sub", "vec_id", "v", "floor"])

        return run

    schema = "dim int, cell int, sub int, vec_id long, v array<double>, floor double"
    asked = rows.where("q").groupBy("vec_id", "dim").agg(F.min("v").alias("v"))
    asked = asked.withColumn("floor", F.lit(float("-inf")))
    near = materialize(_searched(base, asked.mapInArrow(route(True), schema), search, top, shards))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    near = near.distinct().withColumn("rank", rank).where(F.col("rank") <= k)
    floors = near.where(F.col("rank") == k).select("query_id", F.col("score").alias("reached"))
    again = asked.join(floors, asked["vec_id"] == floors["query_id"], "left").select("vec_id", "dim", "v", F.coalesce("reached", "floor").alias("floor"))
    far = _searched(base, again.mapInArrow(route(False), schema), search, top, shards)
    found = near.drop("rank").union(far)
    return found.distinct().withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
