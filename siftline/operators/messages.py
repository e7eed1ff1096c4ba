"""Messages of one set that resemble one of another: the ratio of matching blocks, tried only on pairs that can reach it.

The ratio of two texts is 2 * m / (a + b), a and b their lengths and m the characters in matching blocks. Both texts have these m
characters. Blocks are split by characters that don't match, of which there are u = a + b - 2 * m, so at most u + 1 blocks
lose a pair of neighbours each: the texts share m - u - 1 of these pairs at least, which says something above a limit of 2 / 3.
Both are bounds on counts, and counts of hashed characters and pairs are no less. Texts of one key meet in blocks, so that
each is moved once, and what is made of it stays in the task.
"""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Texts of a key and side that meet others at once; of keys with more, each block of one side meets each of the other.
BLOCK = 256
#: Characters and pairs of them are counted by so many hashes.
CHARACTERS, PAIRS = 64, 512


def _counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lengths, counts of hashed characters, counts of hashed pairs) of texts."""
    n = np.array([len(t) for t in texts])
    c = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    owner = np.repeat(np.arange(len(texts)), n)
    pair = ((c[:-1] * 40503 + c[1:]) * 2654435761 >> 12) % PAIRS
    inner = owner[1:] == owner[:-1]
    count = lambda at, own, size: np.bincount(own * size + at, minlength=len(texts) * size).reshape(-1, size).astype(np.int32)
    return n, count(c % CHARACTERS, owner, CHARACTERS), count(pair[inner], owner[1:][inner], PAIRS)


def candidates(left: list[str], right: list[str], limit: float) -> Iterator[tuple[int, np.ndarray]]:
    """(j, places in left) for each text of right: those whose ratio with it may be above the limit."""
    (la, ca, pa_), (lb, cb, pb) = _counts(left), _counts(right)
    for j in range(len(right)):
        total = la + lb[j]
        at = np.flatnonzero(2 * np.minimum(la, lb[j]) > limit * total - 1e-9)
        at = at[2 * np.minimum(ca[at], cb[j]).sum(1) > limit * total[at] - 1e-9]
        yield j, at[np.minimum(pa_[at], pb[j]).sum(1) >= (1.5 * limit - 1) * total[at] - 1 - 1e-9]


def resembling(left: list[str], right: list[str], limit: float) -> list[tuple[str, str]]:
    """The pairs of texts whose ratio is above the limit."""
    out, m = [], difflib.SequenceMatcher()
    for j, at in candidates(left, right, limit):
        b = right[j]
        if len(at):
            m.set_seq2(b)  # what difflib keeps of it serves all partners
        for i in at.tolist():
            m.set_seq1(left[i])
            if left[i] == b or (m.quick_ratio() > limit and m.ratio() > limit):
                out.append((left[i], b))
    return out


def similar_pairs(left: DataFrame, right: DataFrame, limit: float = 0.8) -> DataFrame:
    """(key, a, b): texts of left(key, text) and of right(key, text) with one key whose ratio is above the limit.
    Nulls and empty texts resemble nothing; repeated texts count once."""
    sides = {"a": left, "b": right}
    rows = [df.select(F.lit(s).alias("side"), "key", "text").where("key is not null and text <> ''").distinct() for s, df in sides.items()]
    both = rows[0].unionByName(rows[1])
    # Of each key the number of blocks of either side; a key that one side lacks has no pairs.
    blocks = lambda s: F.ceil(F.count_if(F.col("side") == s) / BLOCK).cast("int")
    many = both.groupBy(F.col("key").alias("of_key")).agg(blocks("a").alias("na"), blocks("b").alias("nb")).where("na > 0 and nb > 0")
    both = both.join(many, F.col("key") == F.col("of_key"))
    of_a, h = F.col("side") == "a", F.xxhash64("text")
    own, others = F.pmod(h, F.when(of_a, F.col("na")).otherwise(F.col("nb"))).cast("int"), F.when(of_a, F.col("nb")).otherwise(F.col("na"))
    both = both.select("key", "side", "text", of_a.alias("of_a"), own.alias("own"), F.explode(F.sequence(F.lit(0), others - 1)).alias("other"))
    ca, cb = (F.when(of_a == (s == "a"), F.col("own")).otherwise(F.col("other")) for s in sides)
    both = both.select("key", ca.alias("ca"), cb.alias("cb"), "of_a", "text").repartition("key", "ca", "cb").sortWithinPartitions("key", "ca", "cb")
    schema = f"key {dict(both.dtypes)['key']}, a string, b string"

    def run(batches):
        unit, texts = None, {True: [], False: []}

        def found():
            if unit is None or not (texts[True] and texts[False]):
                return
            pairs = resembling(texts[True], texts[False], limit)
            if pairs:
                yield pa.RecordBatch.from_arrays([pa.array([unit[0]] * len(pairs), kind), *[pa.array(x, pa.string()) for x in zip(*pairs, strict=True)]], ["key", "a", "b"])

        for batch in batches:
            kind = batch.schema.field("key").type
            for key, x, y, of_a, text in zip(*[batch.column(c).to_pylist() for c in ("key", "ca", "cb", "of_a", "text")], strict=True):
                if (key, x, y) != unit:
                    yield from found()
                    unit, texts = (key, x, y), {True: [], False: []}
                texts[of_a].append(text)
        yield from found()

    return both.mapInArrow(run, schema)


def similar_keys(left: DataFrame, right: DataFrame, limit: float = 0.8) -> DataFrame:
    """(key): the keys of which some text of left resembles one of right."""
    return similar_pairs(left, right, limit).select("key").distinct()
