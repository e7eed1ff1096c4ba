"""Connected components of a distributed edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def components(edges: DataFrame) -> DataFrame:
    """(v, component): for each vertex of edges(a, b) the least vertex that it reaches. Ids should be hashes: each
    round hooks every root to its least neighbour, twice, and contracts the edges, so random ids need few rounds."""
    e = materialize(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels = e.select(F.col("a").alias("v")).union(e.select("b")).distinct().select("v", F.col("v").alias("component"))
    while not e.isEmpty():
        both = e.select("a", "b").union(e.select(F.col("b"), F.col("a")))
        up = both.groupBy(F.col("a").alias("r")).agg(F.min("b").alias("m")).select("r", F.least("r", "m").alias("p"))
        up = materialize(up)
        far = up.alias("x").join(up.alias("y"), F.col("x.p") == F.col("y.r")).select(F.col("x.r").alias("r"), F.col("y.p").alias("p"))
        far = materialize(far)
        labels = labels.join(far, labels["component"] == far["r"], "left").select("v", F.coalesce("p", "component").alias("component"))
        labels = materialize(labels)
        one = e.join(far, e["a"] == far["r"]).select(F.col("p").alias("a"), "b")
        two = one.join(far, one["b"] == far["r"]).select("a", F.col("p").alias("b"))
        e = materialize(two.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    return labels
