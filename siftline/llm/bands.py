"""Numeric band join: sale lines near an item's price, by segment trees over the distinct unit prices of range shards."""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, only_columns


@dataclass(frozen=True)
class Band:
    """top: pairs shown of each item; near: gap in cents that always pairs; share: gap that pairs in thousandths of the
    price times 1/2 (2 * p >= 1000 * gap by default). A shard holds 2^narrow distinct unit prices at most, more beyond
    2^(narrow + 7) cents, so that a band meets few shards, and never more than 2^wide. chunk: lines that a task adds up at
    once."""

    top: int = 5
    near: int = 10
    share: int = 2
    narrow: int = 10
    wide: int = 16
    chunk: int = 400_000


#: Amounts and prices beyond this many units, and quantities of 0, have no exact cents, so they never pair.
_MOST = 1e13


def cents(x: Column) -> Column:
    """floor(100 * x + 0.5) in doubles; null if x is null, not finite or too large."""
    d = x.cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) < _MOST), F.floor(100 * d + 0.5).cast("long"))


def floor_div(a: Column, b: Column) -> Column:
    """Floor of the quotient of longs; null where b is 0."""
    a, b = F.when(b < 0, -a).otherwise(a), F.nullif(F.abs(b), F.lit(0))
    r = F.pmod(a, b)
    return F.call_function("div", a - r, b)


def unit_price(amount: Column, quantity: Column) -> Column:
    q = quantity.cast("long")
    return floor_div(2 * cents(amount) + q, 2 * q)


def shard_of(u: Column, b: Band) -> Column:
    """The first unit price of the shard of u: blocks of 2^narrow, wider with u by powers of two up to 2^wide."""
    octave = F.floor(F.log2(F.greatest(u, F.lit(1)).cast("double") + 0.5)).cast("int")
    bits = F.greatest(F.lit(b.narrow), F.least(F.lit(b.wide), octave - 7))
    return F.call_function("shiftleft", F.call_function("shiftright", u, bits), bits)


def shards_between(lo: Column, hi: Column, b: Band) -> Column:
    """The shards that [lo, hi] meets: the narrower blocks of its ends, each as the shard that holds it."""
    octave = F.floor(F.log2(F.greatest(lo, F.lit(1)).cast("double") + 0.5)).cast("int")
    bits = F.greatest(F.lit(b.narrow), F.least(F.lit(b.wide), octave - 7))
    blocks = F.sequence(F.call_function("shiftright", lo, bits), F.call_function("shiftright", hi, bits))
    return F.array_distinct(F.transform(blocks, lambda x: shard_of(F.greatest(F.call_function("shiftleft", x, bits), lo), b)))


def usable_lines(lines: DataFrame) -> DataFrame:
    """(u, sale_id, line_no, item_id, crc) of the lines that pair at all."""
    x = only_columns(lines, "sale_id", "line_no", "item_id", "quantity", "amount")
    name = F.concat_ws(",", F.col("sale_id").cast("string"), F.coalesce(F.col("line_no").cast("string"), F.lit("")), F.col("item_id").cast("string"))
    x = x.where("sale_id is not null and item_id is not null and quantity is not null and amount is not null")
    return x.select(
        unit_price(F.col("amount"), F.col("quantity")).alias("u"),
        F.col("sale_id").cast("long").alias("sale_id"),
        F.col("line_no").cast("long").alias("line_no"),
        F.col("item_id").cast("long").alias("item_id"),
        F.crc32(name.cast("binary")).alias("crc"),
    ).where("u is not null")


_NULL_LINE = (1 << 63) - 1  # a line_no that is null stands last
_LEAF = "u long, n long, crc long, sale_id long, line_no long, item_id long"


def _first_ranks(*keys: np.ndarray) -> np.ndarray:
    """Rank from 0 of each row within its run of equal keys; rows are sorted by them."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0) if len(new) else False
    at = np.arange(len(new))
    return at - np.maximum.accumulate(np.where(new, at, 0))


def diversified(u: np.ndarray, sale: np.ndarray, line: np.ndarray, item: np.ndarray, top: int) -> np.ndarray:
    """Indexes of the lines, sorted by (u, sale, line, item), that may be among the first `top` of a unit price once one
    item is left out: at most top of an item and 2 * top of a unit price."""
    by_item = np.lexsort((line, sale, item, u))
    kept = by_item[_first_ranks(u[by_item], item[by_item]) < top]
    kept = kept[np.lexsort((item[kept], line[kept], sale[kept], u[kept]))]
    return kept[_first_ranks(u[kept]) < 2 * top]


def _partial(lines: DataFrame, b: Band) -> DataFrame:
    """Of each unit price and chunk of lines the diversified ones; the first carries the sums (n, crc) of all of them."""

    def reduced(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(batches)
        u, sale, item, crc = (table.column(c).to_numpy() for c in ("u", "sale_id", "item_id", "crc"))
        line = table.column("line_no").fill_null(_NULL_LINE).to_numpy()
        kept = diversified(u, sale, line, item, b.top)
        values, where, n = np.unique(u, return_inverse=True, return_counts=True)
        sums = np.zeros(len(values), np.int64)
        np.add.at(sums, where, crc)
        first = _first_ranks(u[kept]) == 0  # kept is sorted by u, so first ones stand in the order of values
        counts, crcs = np.zeros(len(kept), np.int64), np.zeros(len(kept), np.int64)
        counts[first], crcs[first] = n, sums
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (u[kept], counts, crcs, sale[kept], line[kept], item[kept])], ["u", "n", "crc", "sale_id", "line_no", "item_id"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= b.chunk:
                yield reduced(held)
                held, size = [], 0
        if size:
            yield reduced(held)

    return lines.mapInArrow(run, _LEAF)


def leaves(lines: DataFrame, b: Band) -> DataFrame:
    """(u, n, crc, lines): of each distinct unit price the number of its lines, the sum of their checksums and the
    diversified first ones, sorted by sale, line and item."""
    e = _partial(lines, b).repartition("u")
    of_u, of_item = Window.partitionBy("u"), Window.partitionBy("u", "item_id")
    e = e.withColumns({"n": F.sum("n").over(of_u), "crc": F.sum("crc").over(of_u), "r": F.row_number().over(of_item.orderBy("sale_id", "line_no"))})
    e = e.where(F.col("r") <= b.top).withColumn("r", F.row_number().over(of_u.orderBy("sale_id", "line_no", "item_id"))).where(F.col("r") <= 2 * b.top)
    one = F.struct("sale_id", "line_no", "item_id")
    return e.groupBy("u").agg(F.first("n").alias("n"), F.first("crc").alias("crc"), F.sort_array(F.collect_list(one)).alias("lines"))


class SegmentTree:
    """Over the sorted distinct unit prices of a shard. A node holds the number of its lines, the sum of their unit prices
    and of their checksums, and two lists of its first lines (u, sale, line, item), by ascending u and by descending u, each
    diversified: at most `top` lines of an item, 2 * top in all, so that `top` remain whichever item is left out. As the
    halves of a node don't share a unit price, its lists are those of its halves one after the other."""

    def __init__(self, us: list[int], counts: list[int], crcs: list[int], lines: list[list[tuple[int, int, int]]], top: int):
        self.us, self.top, self.size = us, top, 1 << max(0, (len(us) - 1).bit_length())
        pad = self.size - len(us)
        firsts = [[(u, *x) for x in rows] for u, rows in zip(us, lines, strict=True)]
        leaf = [(n, n * u, c) for u, n, c in zip(us, counts, crcs, strict=True)]
        self.sums = [(0, 0, 0)] * self.size + leaf + [(0, 0, 0)] * pad
        self.up = [[]] * self.size + firsts + [[]] * pad
        self.down = list(self.up)
        for i in range(self.size - 1, 0, -1):
            x, y = self.sums[2 * i], self.sums[2 * i + 1]
            self.sums[i] = (x[0] + y[0], x[1] + y[1], x[2] + y[2])
            self.up[i] = self._joined(self.up[2 * i], self.up[2 * i + 1])
            self.down[i] = self._joined(self.down[2 * i + 1], self.down[2 * i])

    def _joined(self, first: list[tuple], then: list[tuple]) -> list[tuple]:
        if len(first) >= 2 * self.top or not then:
            return first
        out, of = list(first), Counter(x[3] for x in first)
        for x in then:
            if of[x[3]] < self.top:
                of[x[3]] += 1
                out.append(x)
                if len(out) == 2 * self.top:
                    break
        return out

    def query(self, lo: int, hi: int, up: bool) -> tuple[int, int, int, list[tuple]]:
        """(lines, sum of unit prices, sum of checksums, first lines by rising or falling u) of lo <= u < hi, merged from
        the canonical nodes of the interval."""
        a, z = bisect_left(self.us, lo) + self.size, bisect_left(self.us, hi) + self.size
        left, right = [], []
        while a < z:
            if a & 1:
                left.append(a)
                a += 1
            if z & 1:
                z -= 1
                right.append(z)
            a, z = a >> 1, z >> 1
        nodes, lists = left + right[::-1], self.up if up else self.down
        first: list[tuple] = []
        for i in nodes if up else reversed(nodes):
            first = self._joined(first, lists[i])
            if len(first) == 2 * self.top:
                break
        n, s, c = (sum(self.sums[i][k] for i in nodes) for k in range(3))
        return n, s, c, first


_PART = "p long, n_pairs long, gap_sum long, lines_crc long, pairs array<struct<gap: long, u: long, sale_id: long, line_no: long, line_item_id: long>>"


def _answers(leaf: DataFrame, prices: DataFrame, b: Band) -> DataFrame:
    """(p, n_pairs, gap_sum, lines_crc, pairs) of each price p: of all lines in its band, with enough of the first ones
    that `top` remain whichever item is left out. A shard's task holds its distinct unit prices and the distinct prices whose
    bands meet it, whatever the number of lines and items is."""

    def run(key: tuple, trees: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(trees) and len(asked):
            trees = trees.sort_values("u")
            rows = [[(x["sale_id"], x["line_no"], x["item_id"]) for x in r] for r in trees["lines"]]
            tree = SegmentTree(trees["u"].tolist(), trees["n"].tolist(), trees["crc"].tolist(), rows, b.top)
            for p, lo, hi in zip(asked["p"].tolist(), asked["lo"].tolist(), asked["hi"].tolist(), strict=True):
                n, s, c, below = tree.query(lo, min(p, hi) + 1, False)
                m, t, d, above = tree.query(max(p + 1, lo), hi + 1, True)
                first = sorted([(p - x[0], *x) for x in below] + [(x[0] - p, *x) for x in above])
                if n + m:
                    out.append((p, n + m, n * p - s + t - m * p, c + d, [dict(zip(("gap", "u", "sale_id", "line_no", "line_item_id"), x, strict=True)) for x in first]))
        return pd.DataFrame(out, columns=["p", "n_pairs", "gap_sum", "lines_crc", "pairs"])

    shards = leaf.withColumn("shard", shard_of(F.col("u"), b))
    asked = prices.withColumn("shard", F.explode(shards_between(F.col("lo"), F.col("hi"), b)))
    parts = shards.groupBy("shard").cogroup(asked.groupBy("shard")).applyInPandas(run, _PART)
    sums = [F.sum(c).alias(c) for c in ("n_pairs", "gap_sum", "lines_crc")]
    return parts.groupBy("p").agg(*sums, F.sort_array(F.flatten(F.collect_list("pairs"))).alias("pairs"))


def _own(lines: DataFrame, items: DataFrame, b: Band) -> DataFrame:
    """(item_id, p, own_n, own_gap, own_crc): of each item and price the lines of the same item in its band. Lines of an
    item and unit price are one row first; those of one item are dealt out by their shards."""
    own = lines.groupBy("item_id", "u").agg(F.count("*").alias("n"), F.sum("crc").alias("crc")).withColumn("shard", shard_of(F.col("u"), b))
    asked = items.where("p is not null and item_id is not null").select("item_id", "p", "lo", "hi").distinct()
    asked = asked.withColumn("shard", F.explode(shards_between(F.col("lo"), F.col("hi"), b)))
    both = own.join(asked, ["item_id", "shard"]).where("u between lo and hi")
    gap = F.abs(F.col("u") - F.col("p")) * F.col("n")
    return both.groupBy(F.col("item_id").alias("own_id"), F.col("p").alias("own_p")).agg(F.sum("n").alias("own_n"), F.sum(gap).alias("own_gap"), F.sum("crc").alias("own_crc"))


def near_prices(lines: DataFrame, items: DataFrame, b: Band = Band()) -> DataFrame:
    """For each row of items(item_id, price) its first `top` pairs with lines(sale_id, line_no, item_id, quantity, amount)
    of other items whose unit price is near: item_id, rank, gap, u, sale_id, line_no, line_item_id, and over all its pairs
    n_pairs, gap_sum, lines_crc.

    Items without pairs, of a null price or without an id have one row of rank 0. Lines null in sale_id, item_id, quantity
    or amount never pair, nor do quantities of 0 and amounts or prices that are not finite or beyond 1e13. A null line_no
    stands last and is an empty text in the checksum. Repeated lines each count and take a rank each; repeated items each have
    their rows; ties go by u, sale, line and item. Empty tables: no items, no rows; no lines, rows of rank 0. Other columns are
    ignored, whatever their names.
    """
    x = usable_lines(lines)
    p = only_columns(items, "item_id", "price").select(F.col("item_id").cast("long").alias("item_id"), cents(F.col("price")).alias("p"))
    reach = F.greatest(F.lit(b.near), floor_div(b.share * F.col("p"), F.lit(1000)))
    p = p.withColumns({"lo": F.col("p") - reach, "hi": F.col("p") + reach})
    prices = p.where("p is not null and item_id is not null").select("p", "lo", "hi").distinct()
    answers = materialize(_answers(leaves(x, b), prices, b).withColumnRenamed("p", "a_p"))
    own = materialize(_own(x, p, b))
    rows = p.join(answers, (F.col("p") == F.col("a_p")) & F.col("item_id").isNotNull(), "left")
    rows = rows.join(own, (F.col("item_id") == F.col("own_id")) & (F.col("p") == F.col("own_p")), "left")
    zero = F.lit(0).cast("long")
    less = lambda all_, mine: (F.coalesce(all_, zero) - F.coalesce(mine, zero)).alias(all_._jc.toString())
    first = F.slice(F.filter("pairs", lambda y: y["line_item_id"] != F.col("item_id")), 1, b.top)
    rows = rows.select("item_id", first.alias("first"), *[less(F.col(c), F.col(m)) for c, m in (("n_pairs", "own_n"), ("gap_sum", "own_gap"), ("lines_crc", "own_crc"))])
    rows = rows.select("item_id", "n_pairs", "gap_sum", "lines_crc", F.posexplode_outer("first").alias("at", "y"))
    line_no = F.nullif(F.col("y.line_no"), F.lit(_NULL_LINE))
    return rows.select("item_id", F.coalesce(F.col("at") + 1, F.lit(0)).alias("rank"), "y.gap", "y.u", "y.sale_id", line_no.alias("line_no"), "y.line_item_id", "n_pairs", "gap_sum", "lines_crc")
