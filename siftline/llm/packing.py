"""Variable-capacity best-fit packing of documents into training sequences of several permitted lengths."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import only_columns, word_count


@dataclass(frozen=True)
class Lengths:
    """Permitted sequence lengths; a sequence of length n costs n * (1 + n / balance), as attention grows with its
    square. Documents are dealt at random into shards of about shard_rows, each packed by itself."""

    capacities: tuple[int, ...] = (512, 1024, 2048, 4096, 8192)
    balance: float = 16384.0
    shard_rows: int = 16384


def cost(n: int, balance: float) -> float:
    return n * (1 + n / balance)


def _fill(sizes: np.ndarray, opening: dict[int, int], caps: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """best_fit with given lengths to open: opening has one for each length that is the smallest to hold a piece."""
    order = np.lexsort((np.arange(len(sizes)), -sizes))
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    by_room: list[list[int]] = [[] for _ in range(caps[-1] + 1)]
    rooms = 0  # bit r: some open bin has room r
    used: list[int] = []
    for i in order.tolist():
        n = int(sizes[i])
        fits = rooms >> n
        if fits:
            r = n + (fits & -fits).bit_length() - 1
            b = by_room[r].pop()
            if not by_room[r]:
                rooms &= ~(1 << r)
        else:
            r = opening[next(c for c in caps if c >= n)]
            b = len(used)
            used.append(0)
        bins[i], offsets[i] = b, used[b]
        used[b] += n
        if r > n:
            by_room[r - n].append(b)
            rooms |= 1 << (r - n)
    return bins, offsets, np.array([next(c for c in caps if c >= u) for u in used], np.int64)


def best_fit(sizes: np.ndarray, lengths: Lengths) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset of each piece, capacity of each bin) for pieces of at most the largest capacity.

    Largest piece first, into the open bin that it leaves least room in. If none has room, a new one is opened; at last
    each bin gets the smallest length that holds its contents. Which length is opened for pieces of which smallest length
    is tried out: each length for all, then from the cheapest of these other ones for each, as long as the cost falls.
    """
    caps = sorted(lengths.capacities)
    price = {c: cost(c, lengths.balance) for c in caps}

    def tried(opening):
        found = _fill(sizes, opening, caps)
        return sum(price[c] * int((found[2] == c).sum()) for c in caps), opening, found

    best = min((tried({own: max(own, c) for own in caps}) for c in caps), key=lambda t: t[0])
    for own in reversed(caps):
        if ((sizes <= own) & (sizes > max([c for c in caps if c < own], default=0))).any():
            others = [tried(best[1] | {own: c}) for c in caps if c >= own and c != best[1][own]]
            best = min([best, *others], key=lambda t: t[0])
    return best[2]


def pack(docs: DataFrame, lengths: Lengths = Lengths()) -> DataFrame:
    """A row for each piece of documents(doc_id, text): bin_id, capacity, used, doc_id, piece, start (first token in the
    document), n_tokens, at (offset in the sequence).

    A document has a token for each word and an end token; one longer than the largest capacity is cut into pieces of
    that length and a rest. Every token is in exactly one bin, no bin holds more than its capacity, capacities are the
    smallest that hold the contents. Null and empty texts are an end token; null ids stay null; repeated rows are packed
    each; an empty table gives no rows; other columns are ignored.
    """
    d = only_columns(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), (word_count(F.col("text")) + 1).alias("n"))
    shards = max(1, math.ceil(docs.count() / lengths.shard_rows))
    top = max(lengths.capacities)

    def run(batches):
        ids, ns = [], []
        for batch in batches:  # about shard_rows rows of two numbers
            ids.append(batch.column("doc_id"))
            ns.append(batch.column("n").to_numpy())
        if not ns:
            return
        doc, n = pa.chunked_array(ids, pa.int64()), np.concatenate(ns)
        if not len(n):
            return
        # Rows arrive in any order: sort, so that a repeated task packs alike.
        key = doc.to_numpy(zero_copy_only=False)
        order = np.lexsort((n, np.nan_to_num(key.astype(np.float64), nan=-1.0)))
        pieces = -(-n[order] // top)
        source = np.repeat(order, pieces)
        piece = np.arange(len(source)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        sizes = np.minimum(top, n[source] - piece * top)
        bins, at, caps = best_fit(sizes, lengths)
        used = np.bincount(bins, sizes, len(caps)).astype(np.int64)
        base = TaskContext.get().partitionId() << 32
        cols = {
            "bin_id": pa.array(bins + base), "capacity": pa.array(caps[bins]), "used": pa.array(used[bins]), "doc_id": doc.combine_chunks().take(pa.array(source)),
            "piece": pa.array(piece), "start": pa.array(piece * top), "n_tokens": pa.array(sizes), "at": pa.array(at),
        }
        yield pa.RecordBatch.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in cols.values()], list(cols))

    return d.repartition(shards).mapInArrow(run, "bin_id long, capacity long, used long, doc_id long, piece long, start long, n_tokens long, at long")
