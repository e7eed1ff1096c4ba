"""K-d tree partitioning of documents into shards of near equal bytes. DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bounded, hash_bucket, materialize, only_columns, prefix_sums

#: Metadata dimensions as numbers; a null lies below all values.
DIMENSIONS = ("x_size", "x_id", "x_source", "x_lang")
BINS, TIE_BITS = 4096, 12


def _prefix_number(c: str) -> Column:
    """A string's first six bytes as a number, in the order of the strings."""
    return F.coalesce(F.conv(F.rpad(F.hex(F.substring(F.encode(F.col(c), "utf-8"), 1, 6)), 12, "0"), 16, 10).cast("double"), F.lit(-1.0))


def _crossing(sums: DataFrame, part: str, name: str) -> DataFrame:
    """(node, name, name_before): of sums(node, part, weight, aim) for each node the first part at which the running weight
    reaches the aim, and the weight before it. A node has a few thousand parts at most."""
    run = sums.withColumn("upto", F.sum("weight").over(Window.partitionBy("node").orderBy(part)))
    hit = run.where(F.col("upto") >= F.col("aim") - 0.5)
    best = hit.groupBy("node").agg(F.min_by(F.struct(F.col(part).alias("part"), (F.col("upto") - F.col("weight")).alias("before")), part).alias("b"))
    return best.select("node", F.col("b.part").alias(name), F.col("b.before").alias(f"{name}_before"))


def _weights(rows: DataFrame, part: Column, aim: str) -> DataFrame:
    return rows.groupBy("node", part.alias("part")).agg(F.sum("size").cast("double").alias("weight"), F.first(aim).alias("aim"))


def kd_shards(docs: DataFrame, shards: int | None = None, target_bytes: int = 256 << 20) -> DataFrame:
    """doc_id, size (UTF-8 bytes of the text plus 8), text_crc32 (null for a null text), shard and slot of documents.

    Nodes of a level are split together, each along its widest dimension (spread relative to the whole table's) at the
    weighted median, or at the share of leaves that its left side gets, until there are `shards` leaves (default: as
    target_bytes asks). Medians come from distributed histograms of 4096 bins; rows of the bin at the median are split
    by two further histograms over 12 bits each of a hash of the row, so ties are split too. What is known of nodes is a
    table with a row each, joined to the rows; the driver sees one row of the whole. Slots count from 0 in each shard, in
    the order of the hash. Null texts have size 8; null metadata lies below all values; rows equal in doc_id, text,
    source and lang stay together; an empty table gives no rows; other columns are ignored, whatever their names.
    """
    docs = only_columns(docs, "doc_id", "text", "source", "lang")
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 8
    slim = docs.select(
        "doc_id", size.alias("size"), F.crc32(F.encode(F.col("text").cast("string"), "utf-8")).alias("text_crc32"), F.xxhash64("doc_id", F.xxhash64("text"), "source", "lang").alias("u"),
        F.log2(size.cast("double")).alias("x_size"), F.coalesce(F.col("doc_id").cast("double"), F.lit(-1.0)).alias("x_id"), _prefix_number("source").alias("x_source"), _prefix_number("lang").alias("x_lang"),
    )
    slim = materialize(slim)
    whole = slim.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("weight"), *[(F.max(x) - F.min(x)).alias(x) for x in DIMENSIONS]).first()
    leaves = shards or max(1, math.ceil(whole["weight"] / target_bytes))
    # A node is named by its first leaf, and has so many leaves.
    rows = slim.withColumns({"node": F.lit(0).cast("long"), "leaves": F.lit(leaves).cast("long")})
    for _ in range(math.ceil(math.log2(leaves)) if leaves > 1 else 0):
        ranges = [f(F.col(x)).alias(f"{n}_{x}") for x in DIMENSIONS for n, f in (("lo", F.min), ("hi", F.max))]
        stats = rows.where("leaves > 1").groupBy("node").agg(F.sum("size").alias("all"), F.first("leaves").alias("n"), *ranges)
        wide = lambda x: F.col(f"hi_{x}") - F.col(f"lo_{x}")
        each = [F.struct((wide(x) / float(whole[x] or 1.0)).alias("spread"), F.lit(-i).alias("i"), F.col(f"lo_{x}").alias("lo"), wide(x).alias("width")) for i, x in enumerate(DIMENSIONS)]
        stats = stats.select("node", (F.col("all") * F.floor(F.col("n") / 2) / F.col("n")).alias("aim"), F.array_max(F.array(*each)).alias("w"))
        nodes = bounded(stats.select(F.col("node").alias("k"), "aim", (-F.col("w.i")).alias("dim"), F.col("w.lo").alias("lo"), F.greatest(F.lit(1e-12), F.col("w.width")).alias("width")))
        split = rows.join(nodes, rows["node"] == nodes["k"], "left").drop("k")
        value = F.get(F.array(*[F.col(x) for x in DIMENSIONS]), F.col("dim"))
        split = split.withColumn("bin", F.least(F.lit(BINS - 1), F.floor((value - F.col("lo")) / F.col("width") * BINS)).cast("int")).drop("dim", "lo", "width")
        open_rows = split.where("leaves > 1")
        at = bounded(_crossing(_weights(open_rows, F.col("bin"), "aim"), "part", "at").withColumnRenamed("node", "k0"))
        split = split.join(at, split["node"] == at["k0"], "left").drop("k0").withColumn("aim", F.col("aim") - F.col("at_before"))
        tie1 = hash_bucket(F.col("u"), 1 << TIE_BITS).cast("int")
        tied = split.where("leaves > 1 and bin = at")
        cut1 = bounded(_crossing(_weights(tied, tie1, "aim"), "part", "cut1").withColumnRenamed("node", "k1"))
        split = split.join(cut1, split["node"] == cut1["k1"], "left").drop("k1").withColumn("aim", F.col("aim") - F.col("cut1_before"))
        tie2 = F.shiftright(F.shiftleft(F.col("u"), TIE_BITS), 64 - TIE_BITS).cast("int")
        tied = split.where((F.col("leaves") > 1) & (F.col("bin") == F.col("at")) & (tie1 == F.col("cut1")))
        cut2 = bounded(_crossing(_weights(tied, tie2, "aim"), "part", "cut2").withColumnRenamed("node", "k2"))
        split = split.join(cut2, split["node"] == cut2["k2"], "left")
        left = (F.col("bin") < F.col("at")) | ((F.col("bin") == F.col("at")) & ((tie1 < F.col("cut1")) | ((tie1 == F.col("cut1")) & (tie2 <= F.col("cut2")))))
        half = F.floor(F.col("leaves") / 2)
        right = (F.col("leaves") > 1) & ~left
        moved = {"node": F.when(right, F.col("node") + half).otherwise(F.col("node")), "leaves": F.when(F.col("leaves") == 1, 1).when(right, F.col("leaves") - half).otherwise(half)}
        # A written level keeps the next one's plan small and survives lost executors.
        rows = materialize(split.withColumns(moved).select(*slim.columns, "node", "leaves"))
    out = rows.select("doc_id", "size", "text_crc32", F.col("node").cast("int").alias("shard"), "u", hash_bucket(F.col("u")).alias("b"), F.lit(1).cast("long").alias("one"))
    out = prefix_sums(out, ["shard"], ["u", "doc_id", "size", "text_crc32"], "b", {"slot": "one"})
    return out.select("doc_id", "size", "text_crc32", "shard", "slot")
