"""Quality classifier by compression: a text that the dictionary of good texts shortens more than that of bad ones is good."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, only_columns
from .tokens import text_pieces


@dataclass(frozen=True)
class Compression:
    """A dictionary of `dictionary` bytes is built for each label from `pieces` stretches of `piece` bytes, picked by a hash
    from all over each of `texts` labelled texts; as many others calibrate the score. These are the bounds of the sample
    that is fitted: 2 * texts of each label, picked by a hash of the text. Texts are compressed in pieces of `piece` bytes
    at this level, all of them."""

    texts: int = 600
    pieces: int = 4
    piece: int = 1024
    dictionary: int = 112_640
    level: int = 3


@dataclass(frozen=True)
class Model:
    """Dictionaries and the calibration: log odds of label 1 = slope * difference + own * log of the compressed share + base.
    The second term tells text that merely repeats itself, which either dictionary leaves short.
    share: of label 1, for empty texts and where there is nothing to tell apart."""

    good: bytes
    bad: bytes
    slope: float
    own: float
    base: float
    share: float


def _compressor(content: bytes, p: Compression) -> zstandard.ZstdCompressor:
    known = zstandard.ZstdCompressionDict(content)
    known.precompute_compress(level=p.level)
    return zstandard.ZstdCompressor(dict_data=known, write_checksum=False, write_content_size=False, write_dict_id=False)


def difference(text: bytes | memoryview, good: zstandard.ZstdCompressor, bad: zstandard.ZstdCompressor, p: Compression) -> tuple[float, float]:
    """(bad - good) / (bad + good) of the compressed sizes of all pieces, above 0 if the good dictionary fits better, and
    the log of their mean share of the text; zeros for an empty text."""
    view, x, y = memoryview(text), 0, 0
    for at in range(0, len(view), p.piece):
        part = view[at : at + p.piece]
        x += len(good.compress(part))
        y += len(bad.compress(part))
    return ((y - x) / (x + y), math.log((x + y) / 2 / len(view))) if x + y else (0.0, 0.0)


def _texts(batch: pa.RecordBatch) -> Iterator[memoryview]:
    for _, raw, offsets in text_pieces(batch.column("text")):
        data = memoryview(np.ascontiguousarray(raw))
        for a, z in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            yield data[a:z]


def _picked(docs: DataFrame, found: DataFrame, p: Compression) -> DataFrame:
    """(p_h, text, label, fits): of found(h, label), hashes of labelled texts, up to 2 * texts distinct ones of each label by
    a hash, with their texts; every second one is for the calibration. Only these are ever shuffled with their texts."""
    h = found.distinct().withColumn("o", F.xxhash64("h"))
    of = lambda label: h.where(F.col("label") == label).orderBy("o", "h").limit(2 * p.texts)
    rows = of(0).union(of(1)).select(F.col("h").alias("p_h"), "label", (F.pmod(F.xxhash64("o"), F.lit(2)) == 0).alias("fits"))
    texts = docs.join(F.broadcast(rows), F.xxhash64("text") == F.col("p_h"))  # 4 * texts rows at most
    return materialize(texts.select("p_h", "text", "label", "fits").dropDuplicates(["p_h", "label"]))


def _samples(picked: DataFrame, p: Compression) -> tuple[list[bytes], list[bytes]]:
    """Stretches of the texts of label 0 and of label 1 that dictionaries are built from."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels, parts = [], []
            for label, h, text in zip(batch.column("label").to_pylist(), batch.column("p_h").to_pylist(), _texts(batch), strict=True):
                n = -(-len(text) // p.piece)
                for k in np.sort(np.random.default_rng(h & (2**63 - 1)).permutation(n)[: p.pieces]).tolist():
                    labels.append(label)
                    parts.append(bytes(text[k * p.piece : (k + 1) * p.piece]))
            yield pa.RecordBatch.from_arrays([pa.array(labels, pa.int32()), pa.array(parts, pa.binary())], ["label", "part"])

    rows = picked.where("fits").select("p_h", "text", "label").mapInArrow(run, "label int, part binary").collect()
    both = sorted((r["label"], bytes(r["part"])) for r in rows)
    return [x for label, x in both if label == 0], [x for label, x in both if label == 1]


def _dictionary(samples: list[bytes], p: Compression) -> bytes:
    """Trained from the samples; few or uniform ones are the dictionary themselves."""
    try:
        return zstandard.train_dictionary(p.dictionary, samples, k=256, d=8, level=p.level).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-p.dictionary :]


def _line(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> list[float]:
    """Slopes of the columns of x, and the base, of a weighted logistic regression by Newton's method; a slight ridge keeps
    separable classes finite."""
    scale = np.where(x.std(0) > 0, x.std(0), 1.0)
    design, w = np.concatenate((x / scale, np.ones((len(x), 1))), 1), np.zeros(x.shape[1] + 1)
    ridge = np.diag([1e-3] * x.shape[1] + [1e-6])
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(design @ w, -35, 35)))
        step = np.linalg.solve((design * (weight * q * (1 - q))[:, None]).T @ design + ridge, design.T @ (weight * (y - q)) - ridge @ w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return [float(v) for v in (*(w[:-1] / scale), w[-1])]


def _with_difference(df: DataFrame, good: bytes, bad: bytes, p: Compression) -> DataFrame:
    """Columns of df but for the text, the difference d and the log share s."""
    sent = df.sparkSession.sparkContext.broadcast((good, bad))
    rest = [c for c in df.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, y = (_compressor(c, p) for c in sent.value)
        for batch in batches:
            found = np.array([difference(t, x, y, p) for t in _texts(batch)], np.float64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in rest], *map(pa.array, found.T.copy())], [*rest, "d", "s"])

    kinds = dict(df.dtypes)
    return df.mapInArrow(run, ", ".join([*[f"{c} {kinds[c]}" for c in rest], "d double", "s double"]))


def train(docs: DataFrame, labels: DataFrame, p: Compression = Compression()) -> Model:
    """A model of the texts of docs(doc_id, text) that labels(doc_id, label) calls 0 or 1; other labels, null included, and
    ids without the other half don't count, and a null text is empty. Repeated texts are sampled once, but count in the shares
    of the labels, which the calibration keeps. Without one of the labels, all scores are the share of label 1; without any,
    0.5. Labels meet hashes of texts, not texts."""
    docs = only_columns(docs, "doc_id", "text").select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    labels = only_columns(labels, "doc_id", "label").select("doc_id", F.col("label").cast("int").alias("label")).where("label in (0, 1)")
    rows = materialize(docs.select("doc_id", F.xxhash64("text").alias("h")).join(labels, "doc_id").select("h", "label"))
    counts = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    zero, one = counts.get(0, 0), counts.get(1, 0)
    share = one / (zero + one) if zero + one else 0.5
    flat = Model(b"", b"", 0.0, 0.0, 0.0, share)
    if not zero or not one:
        return flat
    picked = _picked(docs, rows, p)
    bad, good = _samples(picked, p)
    if not bad or not good:
        return flat
    model = [_dictionary(good, p), _dictionary(bad, p)]
    found = _with_difference(picked.where("not fits").select("text", "label"), *model, p).collect()  # 4 * texts rows of numbers
    x, y = np.array([(r["d"], r["s"]) for r in found]).reshape(-1, 2), np.array([r["label"] for r in found], float)
    if not 0 < y.sum() < len(y):
        return flat
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    return Model(*model, *_line(x, y, weight), share)


def _flat(model: Model) -> bool:
    return not model.good or not model.bad


def score(docs: DataFrame, model: Model, p: Compression = Compression()) -> DataFrame:
    """(doc_id, score, difference) of each row of docs(doc_id, text): the probability of label 1. A null text counts as
    empty, and an empty one has the share of label 1 as its score; texts of any length are compressed whole. Repeated rows each have a row, a
    null doc_id stays null; other columns are ignored, whatever their names; empty tables give none."""
    d = only_columns(docs, "doc_id", "text").select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    d = d.withColumn("empty", F.col("text") == "")
    d = d.select("doc_id", F.lit(True).alias("empty"), F.lit(0.0).alias("d"), F.lit(0.0).alias("s")) if _flat(model) else _with_difference(d, model.good, model.bad, p)
    odds = F.lit(model.slope) * F.col("d") + F.lit(model.own) * F.col("s") + model.base
    return d.select("doc_id", F.when(F.col("empty"), model.share).otherwise(1 / (1 + F.exp(-odds))).alias("score"), F.col("d").alias("difference"))


def learns(doc_id: Column, parts: int, left_out: int) -> Column:
    """Whether labels of this document may be learnt: crc32 of the id as text isn't left_out modulo parts."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(parts)) != left_out, F.lit(True))
