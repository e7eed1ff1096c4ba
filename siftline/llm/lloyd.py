"""Centroid clustering: plain Lloyd rounds on integer components, exact whatever the partitioning is."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, only_columns


@dataclass(frozen=True)
class Lloyd:
    """k centroids of vectors of `dims` components, each scaled by `scale` and floored; so many rounds; seed picks the
    vectors that the centroids start from."""

    k: int = 8
    dims: int = 64
    rounds: int = 10
    scale: int = 1024
    seed: int = 3


#: Components up to this size give 64-bit distances in 64 dimensions; rows with larger ones are taken as Python's integers.
_PLAIN = 1 << 27
#: Components are held to this size, so that sums of them fit into decimal(38, 0); distances, to the largest long.
_MOST, _LONG = 1 << 80, (1 << 63) - 1


def usable(v: Column, dims: int) -> Column:
    """Vectors of exactly dims components, none null or non-finite."""
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce((F.size(v) == dims) & fine, F.lit(False))


def scaled(vectors: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of rows of doubles, exactly: as int64, or as objects if any component needs it."""
    with np.errstate(over="ignore"):
        x = np.floor(vectors.astype(np.float64) * scale)
    if np.abs(x).max(initial=0) <= _PLAIN:
        return x.astype(np.int64)
    return np.array([[max(-_MOST, min(_MOST, int(c))) if np.isfinite(c) else (_MOST if c > 0 else -_MOST) for c in row] for row in x.tolist()], object)


def nearest(x: np.ndarray, centroids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """(number, squared distance) of each row's nearest centroid; of equal distances the smaller number."""
    plain = x.dtype != object and all(abs(c) <= _PLAIN for row in centroids for c in row) and x.shape[1] <= 64
    kind = np.int64 if plain else object
    x = x.astype(kind)
    distances = np.empty((len(centroids), len(x)), kind)
    for i, c in enumerate(centroids):
        d = x - np.array(c, kind)
        d *= d
        distances[i] = d.sum(1)
    number = distances.argmin(0)  # the first of equal ones
    return number, distances[number, np.arange(len(x))]


def _rows(frame: pd.DataFrame, p: Lloyd) -> np.ndarray:
    v = frame["embedding"]
    return scaled(np.stack(v.to_numpy()) if len(v) else np.zeros((0, p.dims)), p.scale)


def prepared(vectors: DataFrame, p: Lloyd) -> DataFrame:
    """(vec_id, embedding) of the vectors that take part."""
    v = only_columns(vectors, "vec_id", "embedding").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    return v.where(usable(F.col("embedding"), p.dims))


def starts(kept: DataFrame, p: Lloyd) -> list[list[int]]:
    """The k vectors of the least sha256 of `seed:vec_id`, in that order; fewer if fewer are kept. Without an id a vector
    stands last; equal ids are told apart by their components."""
    name = F.sha2(F.concat(F.lit(f"{p.seed}:"), F.col("vec_id").cast("string")), 256)
    rows = kept.select(name.alias("name"), "embedding").orderBy(F.asc_nulls_last("name"), "embedding").limit(p.k).collect()
    return [[int(c) for c in row] for row in scaled(np.array([r["embedding"] for r in rows], np.float64).reshape(-1, p.dims), p.scale)]


def _sums(kept: DataFrame, centroids: Broadcast, p: Lloyd) -> DataFrame:
    """(cluster, dim, total): sums of the vectors by their nearest centroid; dim -1 holds the number of vectors. Each task
    adds up what it reads, so k * (dims + 1) rows a task are shuffled at most."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = centroids.value
        sums = np.zeros((len(c), p.dims + 1), object)
        for frame in frames:
            x = _rows(frame, p)
            number, _ = nearest(x, c)
            for i in np.unique(number):
                mine = x[number == i]
                sums[i, 0] += len(mine)
                sums[i, 1:] += mine.sum(0).astype(object)
        have = np.flatnonzero(sums[:, 0])
        yield pd.DataFrame({
            "cluster": np.repeat(have, p.dims + 1).astype(np.int32),
            "dim": np.tile(np.arange(-1, p.dims), len(have)).astype(np.int32),
            "total": [Decimal(int(t)) for t in sums[have].ravel()],
        })

    rows = kept.select("embedding").mapInPandas(run, "cluster int, dim int, total decimal(38, 0)")
    return rows.groupBy("cluster", "dim").agg(F.sum("total").alias("total"))


def fit(vectors: DataFrame, p: Lloyd = Lloyd()) -> list[list[int]]:
    """Centroids after the rounds: each assigns every vector to the nearest centroid and moves each centroid that has any
    to the exact floor of their mean; k * dims numbers a round come to the driver. Empty tables give none."""
    kept = prepared(vectors, p)
    centroids = starts(kept, p)
    for _ in range(p.rounds if centroids else 0):
        sent = kept.sparkSession.sparkContext.broadcast(centroids)
        moved: dict[int, dict[int, int]] = {}
        for r in _sums(kept, sent, p).collect():
            moved.setdefault(r["cluster"], {})[r["dim"]] = int(r["total"])
        sent.unpersist()
        new = [[moved[i][d] // moved[i][-1] for d in range(p.dims)] if i in moved else c for i, c in enumerate(centroids)]
        if new == centroids:
            break  # later rounds would change nothing
        centroids = new
    return centroids


def assign(vectors: DataFrame, centroids: list[list[int]], p: Lloyd = Lloyd()) -> DataFrame:
    """(vec_id, cluster, distance) of each vector that takes part; none without centroids."""
    kept, shape = prepared(vectors, p), "vec_id long, cluster int, distance long"
    if not centroids:
        return kept.sparkSession.createDataFrame([], shape)
    sent = kept.sparkSession.sparkContext.broadcast(centroids)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            number, distance = nearest(_rows(frame, p), sent.value)
            distance = np.minimum(distance, _LONG).astype(np.int64)
            yield pd.DataFrame({"vec_id": frame["vec_id"].astype("Int64"), "cluster": number.astype(np.int32), "distance": distance})

    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInPandas(run, shape)


def clusters(vectors: DataFrame, p: Lloyd = Lloyd()) -> DataFrame:
    """vectors(vec_id, embedding) -> vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Vectors null, of another length or holding null or non-finite components take no part. Repeated rows each count; ties
    go to the smaller number; a null id stays null. Empty tables give no rows; other columns are ignored, whatever their
    names. All arithmetic is in integers, so the result doesn't depend on partitions or their order. Components beyond
    2^80 / scale count as that, distances beyond a long as the largest one.
    """
    centroids = fit(vectors, p)
    found = materialize(assign(vectors, centroids, p))
    sums = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38, 0)")).alias("d")).collect()  # at most k rows
    most = lambda x: min(int(x), _LONG)
    about = [(r["cluster"], most(r["d"]), most(sum(s["d"] for s in sums)), hashlib.sha256(",".join(map(str, centroids[r["cluster"]])).encode()).hexdigest()) for r in sums]
    names = found.sparkSession.createDataFrame(about, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(names), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
