"""Joins of sets by similarity through prefixes of rare tokens; frequent tokens only count in what is left.

If two sets have enough in common, they share a token among the first few of each in any common order of tokens. The order
here puts frequent tokens last, so few sets meet. Sets are held as 64-bit hashes of their tokens.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.documents import staged
from .bm25 import exploded

#: So many of the most frequent tokens are told apart by their frequency; all others stand before them, by hash. The number
#: bounds what is broadcast, and is a matter of speed only.
FREQUENT = 50_000
#: Tokens of the sets that meet as one block.
BLOCK = 3 << 20


def ordered(sets: DataFrame, keep: list[str], tokens: str = "tokens", frequent: DataFrame | None = None) -> DataFrame:
    """The columns of keep, with n and toks: hashes of the distinct tokens, rare ones first; frequent ones by their rank, as
    small numbers take little room. keep tells the sets apart; empty and null sets have no row."""
    rows = exploded(sets, keep, F.array_distinct(tokens), "t").select(*keep, F.xxhash64("t").alias("t"))
    return ordered_rows(rows, keep, frequent)


def ordered_rows(rows: DataFrame, keep: list[str], frequent: DataFrame | None = None) -> DataFrame:
    """ordered of rows with a distinct hash t each."""
    order = frequent_tokens(rows.select("t")) if frequent is None else frequent
    rows = rows.join(F.broadcast(order), "t", "left").select(*keep, F.struct(F.coalesce("df", F.lit(0)).alias("df"), F.coalesce("rank", "t").alias("t")).alias("x"))
    grouped = rows.groupBy(*keep).agg(F.sort_array(F.collect_list("x")).alias("x"))
    return grouped.select(*keep, F.size("x").alias("n"), F.col("x.t").alias("toks"))


def frequent_tokens(tokens: DataFrame) -> DataFrame:
    """(t, df, rank) of the FREQUENT most frequent of tokens(t)."""
    most = tokens.groupBy("t").agg(F.count("*").alias("df")).orderBy(F.desc("df"), "t").limit(FREQUENT)
    return staged(most.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("df"), "t")).cast("long")))  # FREQUENT rows


def _units(sets: DataFrame, limit: float, key: str) -> DataFrame:
    """(u, itself, of_a, doc_id, n, toks): sets(doc_id, key, n, toks) dealt to units of two blocks of one key, or of one with
    itself, such that any two sets of the key that fit in size meet in one unit. Blocks hold sets of one class of sizes and
    about BLOCK tokens, so a set goes to as many units as there are blocks of sets that fit; a key of one block is not moved
    twice."""
    step = math.log(1 / limit) / 2  # the sizes of partners lie in this class and two more
    tokens = sets.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("k"), F.floor(F.log("n") / step + 1e-9).alias("c")).agg(F.sum("n").alias("tokens"))
    all_ = F.sum("tokens").over(Window.partitionBy("k"))
    sizes = staged(tokens.withColumn("small", all_ <= BLOCK))
    merged = F.when(F.col("small"), 0).otherwise(F.col("c"))
    classes = sizes.groupBy("k", "small", merged.alias("m")).agg(F.ceil(F.sum("tokens") / BLOCK).cast("int").alias("blocks"))
    each = classes.select("k", "m", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("i"))
    x, y = (each.select(*[F.col(c).alias(f"{s}{c}") for c in ("k", "m", "i")]) for s in "xy")
    itself = (F.col("xm") == F.col("ym")) & (F.col("xi") == F.col("yi"))
    units = x.join(y, F.col("xk") == F.col("yk")).where("ym between xm - 2 and xm and (xm > ym or xi >= yi)")
    units = staged(units.select("*", itself.alias("itself"), F.xxhash64("xk", "xm", "xi", "ym", "yi").alias("u")))
    of = sizes.select("k", "c", merged.alias("m")).join(classes.select("k", "m", "blocks"), ["k", "m"])
    at = sets.join(of, (F.col(key) == F.col("k")) & (F.floor(F.log("n") / step + 1e-9) == F.col("c")))
    at = at.select("k", "m", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int").alias("i"), "doc_id", "n", "toks")
    side = lambda s, of_a, some: at.join(some, (F.col("k") == F.col(f"{s}k")) & (F.col("m") == F.col(f"{s}m")) & (F.col("i") == F.col(f"{s}i"))).select("u", "itself", F.lit(of_a).alias("of_a"), "doc_id", "n", "toks")
    return side("x", True, units).unionByName(side("y", False, units.where("not itself")))


class _Sets:
    """Sets of a unit: their tokens one after another, rare ones first in each."""

    def __init__(self, parts: list[pa.RecordBatch]):
        self.ids = [i for b in parts for i in b.column("doc_id").to_pylist()]
        self.n = np.concatenate([b.column("n").to_numpy() for b in parts]).astype(np.int64)
        self.toks = np.concatenate([b.column("toks").flatten().to_numpy() for b in parts])
        self.first = np.concatenate(([0], np.cumsum(self.n)))

    def of(self, i: int) -> np.ndarray:
        return self.toks[self.first[i] : self.first[i + 1]]

    def prefix(self, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(token, set, position) of the prefixes of sets that share `least` tokens or more with what they are to meet."""
        owner = np.repeat(np.arange(len(self.n)), self.n)
        pos = np.arange(len(self.toks)) - self.first[owner]
        keep = pos < (self.n - least + _wanted(least))[owner]
        return self.toks[keep], owner[keep], pos[keep]


def _common(limit: float, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """How many tokens two sets of these sizes share at least."""
    return np.ceil(limit / (1 + limit) * (na + nb) - 1e-9).astype(np.int64)


def _wanted(common: np.ndarray) -> np.ndarray:
    """So many of the common tokens are looked for, in prefixes that are longer by as many."""
    return np.ceil(0.1 * common - 1e-9).astype(np.int64)


def meeting(a: _Sets, b: _Sets, limit: float, itself: bool) -> Iterator[tuple[int, int, int]]:
    """(place in a, place in b, common tokens) of the pairs that may share limit of their union. If two sets share o tokens,
    at least l of these are among the first n - o + l of either, n being its size."""
    fit = lambda n, other: _common(limit, n, np.maximum(np.ceil(limit * n - 1e-9), other.n.min()))
    toks, owner, pos = b.prefix(fit(b.n, a))
    order = np.argsort(toks, kind="stable")
    toks, owner, pos = toks[order], owner[order], pos[order]
    asked, asker, place = a.prefix(fit(a.n, b))
    lo, hi = np.searchsorted(toks, asked, "left"), np.searchsorted(toks, asked, "right")
    some = hi > lo
    lo, hi, asker, place = lo[some], hi[some], asker[some], place[some]
    edges = np.searchsorted(asker, np.arange(len(a.n) + 1))
    ranked = {}  # tokens of sets in order of their codes
    for i in range(len(a.n)):
        x, z = edges[i], edges[i + 1]
        if x == z:
            continue
        size = hi[x:z] - lo[x:z]
        rows = np.repeat(lo[x:z] - np.cumsum(size) + size, size) + np.arange(size.sum())
        o = _common(limit, a.n[i], b.n)
        more = _wanted(o) - o
        own = owner[rows]
        ok = (pos[rows] < (b.n + more)[own]) & (np.repeat(place[x:z], size) < a.n[i] + more[own])
        c = np.bincount(own[ok], minlength=len(b.n))
        fits = (c >= _wanted(o)) & (np.minimum(a.n[i], b.n) >= limit * np.maximum(a.n[i], b.n) - 1e-9)
        if itself:
            fits[: i + 1] = False
        found = np.flatnonzero(fits)
        if len(found):
            mine = np.sort(a.of(i))
            for j in found.tolist():
                t = ranked[j] if j in ranked else ranked.setdefault(j, np.sort(b.of(j)))
                at = np.minimum(np.searchsorted(mine, t), len(mine) - 1)
                yield i, j, int((mine[at] == t).sum())


def jaccard_candidates(sets: DataFrame, limit: float, key: str) -> DataFrame:
    """(doc_a, doc_b, na, nb, i), doc_a < doc_b: pairs of sets(doc_id, key, n, toks) of one key that may share limit of their
    union, and the tokens that they share. Sets meet in units of two blocks, and only what is found leaves the task: pairs
    that share a token are many times the sets."""
    rows = _units(sets, limit, key).repartition("u").sortWithinPartitions("u", "of_a")
    kind = dict(sets.dtypes)["doc_id"]

    def run(batches):
        unit, itself, parts = None, False, {True: [], False: []}

        def found():
            if not parts[True] or not (itself or parts[False]):
                return
            a = _Sets(parts[True])
            b = a if itself else _Sets(parts[False])
            pairs = [(a.ids[x], b.ids[y], int(a.n[x]), int(b.n[y]), i) for x, y, i in meeting(a, b, limit, itself)]
            if pairs:
                names = ["doc_a", "doc_b", "na", "nb", "i"]
                yield pa.RecordBatch.from_arrays([pa.array(c, id_type if k < 2 else pa.int64()) for k, c in enumerate(zip(*pairs, strict=True))], names)

        for batch in batches:
            id_type = batch.schema.field("doc_id").type
            u, of_a = batch.column("u").to_numpy(), batch.column("of_a").to_numpy(zero_copy_only=False)
            edges = [0, *(np.flatnonzero((np.diff(u) != 0) | (of_a[1:] != of_a[:-1])) + 1).tolist(), len(u)]
            for x, z in zip(edges[:-1], edges[1:], strict=True):
                if x == z:
                    continue
                if u[x] != unit:
                    yield from found()
                    unit, itself, parts = u[x], batch.column("itself")[x].as_py(), {True: [], False: []}
                parts[bool(of_a[x])].append(batch.slice(x, z - x))
        yield from found()

    pairs = rows.mapInArrow(run, f"doc_a {kind}, doc_b {kind}, na long, nb long, i long")
    turned = F.col("doc_a") > F.col("doc_b")
    two = lambda x, y: (F.when(turned, F.col(y)).otherwise(F.col(x)).alias(x), F.when(turned, F.col(x)).otherwise(F.col(y)).alias(y))
    return pairs.select(*two("doc_a", "doc_b"), *two("na", "nb"), "i")


def jaccard(sets: DataFrame, limit: float, key: str) -> DataFrame:
    """(doc_a, doc_b, j) within the key, j > limit, of sets(doc_id, key, tokens)."""
    both = jaccard_candidates(staged(ordered(sets, ["doc_id", key])), limit, key)
    return both.select("doc_a", "doc_b", F.round(F.col("i") / (F.col("na") + F.col("nb") - F.col("i")), 6).alias("j")).where(F.col("j") > limit)


def best_containers(queries: DataFrame, docs: DataFrame, first: int = 4) -> DataFrame:
    """(item_id, doc_id, score): for each of queries(item_id, tokens) the documents of docs(doc_id, tokens) that hold the
    largest share of its distinct tokens, with all ties; none if no document holds any.

    The document that holds most of a query's `first` rarest tokens gives a bound b. Any that holds b or more tokens has one
    of the |q| - b + 1 rarest, so only the lists of these are followed; what is found there is compared with the whole set.
    """
    rows = exploded(docs, ["doc_id"], F.array_distinct("tokens"), "t").select("doc_id", F.xxhash64("t").alias("t"))
    held = staged(rows)
    asked = queries.select(F.explode(F.array_distinct("tokens")).alias("t")).select(F.xxhash64("t").alias("t")).distinct()
    df = staged(held.join(asked, "t", "left_semi").groupBy("t").agg(F.count("*").alias("df")))
    q = queries.select("item_id", F.explode(F.array_distinct("tokens")).alias("t")).select("item_id", F.xxhash64("t").alias("t")).distinct()
    n = q.groupBy("item_id").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy("df", "t"))
    q = staged(q.join(df, "t").withColumn("r", rank).join(n, "item_id"))  # tokens of no document can't be held by any
    seen = staged(held.join(q.where(F.col("r") <= first), "t").groupBy("item_id", "doc_id").agg(F.count("*").alias("i")))
    top = seen.withColumn("o", F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("i"), "doc_id"))).where("o = 1").select("item_id", "doc_id")
    bound = _held(top, q, held).select("item_id", F.col("i").alias("b"))
    # Tokens of no document are gone from q, so what may be missing counts from those that are left.
    have = q.groupBy("item_id").agg(F.count("*").alias("m"))
    lists = q.join(bound.join(have, "item_id"), "item_id").where(F.col("r") <= F.col("m") - F.col("b") + 1)
    found = held.join(lists.select("item_id", "t", "b", (F.col("m") - F.col("b") + 1).alias("long"), "m"), "t")
    found = found.groupBy("item_id", "doc_id").agg(F.count("*").alias("i"), F.first("b").alias("b"), F.first(F.col("m") - F.col("long")).alias("rest"))
    pairs = staged(found.where(F.col("i") + F.col("rest") >= F.col("b")).select("item_id", "doc_id"))
    scored = _held(pairs, q, held).join(n, "item_id").select("item_id", "doc_id", F.round(F.col("i") / F.col("n"), 6).alias("score"))
    best = F.rank().over(Window.partitionBy("item_id").orderBy(F.desc("score")))
    return scored.withColumn("r", best).where("r = 1").drop("r")


def _held(pairs: DataFrame, q: DataFrame, held: DataFrame) -> DataFrame:
    """(item_id, doc_id, i): how many tokens of the query the document of each pair holds."""
    wanted = pairs.join(q.select("item_id", "t"), "item_id")
    return wanted.join(held, ["doc_id", "t"]).groupBy("item_id", "doc_id").agg(F.count("*").alias("i"))
