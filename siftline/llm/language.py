"""Language ID: a bidirectional gated recurrent network over bytes, trained in numpy by backpropagation through time."""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .tokens import text_pieces


@dataclass(frozen=True)
class Training:
    """The network is fitted on a bounded sample: of each of the max_labels most frequent labels docs_per_label documents,
    fewer where that would be more than `sample` in all; from each at most `windows` windows of `steps` bytes at random
    places of the whole text. Texts are labelled in stretches of `steps` bytes, each read from `margin` bytes before to
    `margin` behind it, so that both states have the bytes around."""

    docs_per_label: int = 300
    max_labels: int = 1024
    sample: int = 19_200
    margin: int = 8
    windows: int = 8
    steps: int = 48
    hidden: int = 8
    batch: int = 128
    rounds: int = 240
    rate: float = 0.02
    seed: int = 7


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


@dataclass
class ByteTagger:
    """Two recurrent cells, one a direction: gates from a row of `e` for the byte and `u` times the state; each position is
    labelled from both states."""

    labels: list[str]
    steps: int
    margin: int
    w: dict[str, np.ndarray] = field(default_factory=dict)

    @classmethod
    def fresh(cls, labels: list[str], t: Training) -> ByteTagger:
        r = np.random.default_rng(t.seed)
        h, w = t.hidden, {}
        for d in "fb":
            w[f"e{d}"] = (r.standard_normal((256, 3 * h)) * 0.3).astype(np.float32)
            w[f"u{d}"] = (r.standard_normal((h, 3 * h)) / np.sqrt(h)).astype(np.float32)
            w[f"o{d}"] = (r.standard_normal((h, len(labels))) / np.sqrt(h)).astype(np.float32)
        w["c"] = np.zeros(len(labels), np.float32)
        return cls(labels, t.steps, t.margin, w)

    def _states(self, x: np.ndarray, d: str, keep: bool, inside: np.ndarray) -> tuple[np.ndarray, list]:
        """States (steps, windows, hidden) of one direction over bytes x (steps, windows), zero where they aren't inside a
        text; keep: what training needs."""
        e, u = self.w[f"e{d}"], self.w[f"u{d}"]
        n = u.shape[0]
        out, kept = np.empty((*x.shape, n), np.float32), []
        h = np.zeros((x.shape[1], n), np.float32)
        for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
            a, g = e[x[t]], h @ u
            gates = _sigmoid(a[:, : 2 * n] + g[:, : 2 * n])
            z, r = gates[:, :n], gates[:, n:]
            c = np.tanh(a[:, 2 * n :] + r * g[:, 2 * n :])
            new = (c + z * (h - c)) * inside[t][:, None]
            if keep:
                kept.append((t, h, z, r, c, g[:, 2 * n :]))
            out[t] = h = new
        return out, kept

    def probabilities(self, x: np.ndarray, inside: np.ndarray, keep: bool = False, used: slice = slice(None)):
        """(steps, windows, labels) of bytes (steps, windows), at the steps that are used."""
        f, kf = self._states(x, "f", keep, inside)
        b, kb = self._states(x, "b", keep, inside)
        f, b = f[used], b[used]
        s = f @ self.w["of"] + b @ self.w["ob"] + self.w["c"]
        s -= s.max(2, keepdims=True)
        p = np.exp(s, out=s)
        p /= p.sum(2, keepdims=True)
        return (p, f, b, kf, kb) if keep else p

    def gradients(self, x: np.ndarray, y: np.ndarray, mask: np.ndarray) -> tuple[dict[str, np.ndarray], float]:
        """Of the mean cross entropy over positions under the mask; backpropagation through time in both directions."""
        inside = mask.astype(np.float32)
        p, f, b, kf, kb = self.probabilities(x, inside, True)
        total = max(1, int(mask.sum()))
        loss = -float((np.log(np.take_along_axis(p, y[..., None], 2)[..., 0] + 1e-9) * mask).sum()) / total
        ds = p
        np.put_along_axis(ds, y[..., None], np.take_along_axis(ds, y[..., None], 2) - 1, 2)
        ds *= (mask / total)[..., None].astype(np.float32)
        g = {"c": ds.sum((0, 1))}
        for d, states, kept in (("f", f, kf), ("b", b, kb)):
            u = self.w[f"u{d}"]
            n = u.shape[0]
            g[f"o{d}"] = np.tensordot(states, ds, ((0, 1), (0, 1)))
            ge, gu = np.zeros_like(self.w[f"e{d}"]), np.zeros_like(u)
            back = ds @ self.w[f"o{d}"].T
            dh = np.zeros((x.shape[1], n), np.float32)
            for t, h, z, r, c, gc in reversed(kept):
                dn = (back[t] + dh) * inside[t][:, None]
                dc = dn * (1 - z) * (1 - c * c)
                dz = dn * (h - c) * z * (1 - z)
                dr = dc * gc * r * (1 - r)
                da = np.concatenate((dz, dr, dc), 1)
                dg = np.concatenate((dz, dr, dc * r), 1)
                np.add.at(ge, x[t], da)
                gu += h.T @ dg
                dh = dn * z + dg @ u.T
            g[f"e{d}"], g[f"u{d}"] = ge, gu
        return g, loss

    def fit(self, windows: list[bytes], ys: list[int], t: Training) -> ByteTagger:
        """windows: at most `steps` bytes each."""
        if not windows:
            return self
        r = np.random.default_rng(t.seed)
        x = np.stack([np.frombuffer(w.ljust(t.steps, b"\0"), np.uint8) for w in windows])
        y, mask = np.array(ys), np.arange(t.steps) < np.array([len(w) for w in windows])[:, None]
        m1 = {k: np.zeros_like(v) for k, v in self.w.items()}
        m2 = {k: np.zeros_like(v) for k, v in self.w.items()}
        for step in range(1, t.rounds + 1):
            i = r.integers(0, len(x), t.batch)
            g, _ = self.gradients(x[i].T, np.broadcast_to(y[i], (t.steps, len(i))), mask[i].T)
            rate = t.rate * (1 - 0.9 * step / t.rounds)
            for k, v in g.items():
                m1[k] = 0.9 * m1[k] + 0.1 * v
                m2[k] = 0.99 * m2[k] + 0.01 * v * v
                self.w[k] = (self.w[k] - rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return self

    def pooled(self, raw: np.ndarray, offsets: np.ndarray, block: int = 8192) -> np.ndarray:
        """(texts, labels): mean of the probabilities at every byte of each text; zeros for empty ones."""
        sizes, reach = np.diff(offsets), self.margin
        n_windows = -(-sizes // self.steps)
        owner = np.repeat(np.arange(len(sizes)), n_windows)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(n_windows) - n_windows, n_windows)
        begin = offsets[:-1][owner] + nth * self.steps
        padded = np.concatenate((np.zeros(reach, np.uint8), raw, np.zeros(self.steps + reach, np.uint8)))
        sums, steps = np.zeros((len(sizes), len(self.labels))), np.arange(-reach, self.steps + reach)[:, None]
        used = slice(reach, reach + self.steps)
        for a in range(0, len(owner), block):
            at, own = begin[a : a + block], owner[a : a + block]
            place = at[None, :] + steps
            inside = ((place >= offsets[own][None, :]) & (place < offsets[own + 1][None, :])).astype(np.float32)
            p = self.probabilities(padded[place + reach], inside, used=used)
            p *= inside[used][..., None]
            np.add.at(sums, own, p.sum(0))
        return sums / np.maximum(1, sizes)[:, None]


def train(docs: DataFrame, t: Training = Training()) -> ByteTagger | None:
    """Fits the network to documents(text, lang); None if no document has both. Equal texts of a language count once. Only the
    sample's windows reach the driver."""
    have = docs.where("text is not null and lang is not null and text <> ''")
    have = have.select("text", "lang", F.xxhash64("text").alias("h"))
    counts = have.groupBy("lang").agg(F.count_distinct("h").alias("count")).orderBy(F.desc("count"), "lang").limit(t.max_labels).collect()
    if not counts:
        return None
    labels = sorted(r["lang"] for r in counts)
    u = F.pmod(F.xxhash64("text", F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)
    # About three times what is needed of each label, then exactly that much by rank.
    each = max(1, min(t.docs_per_label, t.sample // len(labels)))
    rate = {r["lang"]: min(1.0, (3 * each + 30) / r["count"]) for r in counts}
    cut = F.element_at(F.create_map(*[F.lit(x) for kv in rate.items() for x in kv]), F.col("lang"))
    picked = have.select("text", "lang", "h", u.alias("u")).where(F.col("lang").isin(labels)).where(F.col("u") < cut).dropDuplicates(["lang", "h"])
    first = F.row_number().over(Window.partitionBy("lang").orderBy("u", "text"))

    def windows(batches):
        for batch in batches:
            langs, out = batch.column("lang").to_pylist(), []
            for i, text in enumerate(batch.column("text").cast(pa.binary()).to_pylist()):
                r = np.random.default_rng(zlib.crc32(text))
                for at in r.integers(0, max(1, len(text) - t.steps + 1), min(t.windows, 1 + len(text) // t.steps)):
                    out.append((langs[i], text[at : at + t.steps]))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.string()), pa.array([x for _, x in out], pa.binary())], ["lang", "x"])

    rows = picked.withColumn("n", first).where(F.col("n") <= each).select("text", "lang").mapInArrow(windows, "lang string, x binary").collect()
    rows = sorted((r["lang"], bytes(r["x"])) for r in rows)
    return ByteTagger.fresh(labels, t).fit([x for _, x in rows], [labels.index(x) for x, _ in rows], t)


def identify(docs: DataFrame, model: ByteTagger | None) -> DataFrame:
    """doc_id, lang_pred, score of documents(doc_id, text): every byte of the whole text is labelled, the probabilities
    are averaged. Texts that are null or hold no letter are `und` with score 0, as is every text without a model.
    Repeated rows each return a row; other columns are ignored; an empty table gives no rows."""
    d = docs.select(F.col("doc_id"), F.when(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)), F.col("text")).alias("text"))
    kind = dict(docs.dtypes)["doc_id"]
    if model is None:
        return d.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few thousand numbers

    def run(batches):
        m = shared.value
        for batch in batches:
            names, best = [], []
            for first, raw, offsets in text_pieces(batch.column("text")):
                p = m.pooled(raw, offsets)
                empty = np.diff(offsets) == 0
                top = p.argmax(1)
                names += [None if e else m.labels[i] for e, i in zip(empty, top, strict=True)]
                best.append(np.where(empty, 0.0, np.clip(p.max(1), 0, 1)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([x or "und" for x in names], pa.string()), pa.array(np.concatenate(best) if best else np.zeros(0))], ["doc_id", "lang_pred", "score"])

    return d.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")
