"""LM scoring by logistic context mixing: hashed-context bit predictors, gated weights, an adaptive last stage.

A text is a stream of symbols: its words in order, then an end. A word outside the dictionary is an escape followed by its
bytes. Each symbol is a path of bits through a binary tree, and each bit is predicted from the words before it.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, only_columns, writing
from .tokens import U, lower, mix, text_pieces, word_hashes

LOG10 = float(np.log(10.0))
#: Bytes of texts at once: their pairs and words take 50 times as many, beside the tables of counts.
STRETCH = 1 << 18


@dataclass(frozen=True)
class MixModel:
    """classes: kinds of text, told apart by their bytes: means over all training documents, by class_rounds rounds of k-means
    that start from about class_sample of those that have 200 characters or more. dictionary: words seen twice or more in training have a symbol, at most so many, the most
    frequent ones; all others are spelt. Each context has four slots of counts a training token, a power of two between
    2^least_bits and 2^slot_bits: beyond that (with 22, a million tokens) contexts of one slot share its counts, and the
    weights learn how far to trust them. Rows are dealt by a hash to tasks of about task_tokens
    tokens, whatever cluster runs them, and each task goes through its own in the order of the hash. A batch is a hundredth of
    the training tokens, between 256 and `batch`: weights take a step after each, and counts are seen by the next one."""

    classes: int = 8
    class_sample: int = 2000
    class_rounds: int = 3
    dictionary: int = 1 << 20
    least_bits: int = 12
    slot_bits: int = 22
    task_tokens: int = 10_000_000
    batch: int = 16_384
    rate: float = 0.05
    seed_weight: float = 0.35


PROFILE = 512


def byte_profile(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(texts, PROFILE): square roots of the shares of hashed pairs of successive bytes."""
    n = len(offsets) - 1
    pair = raw.astype(np.int64)
    pair[1:] = (pair[1:] * 31 + pair[:-1] * 257) % PROFILE
    begin = offsets[:-1][np.diff(offsets) > 0]
    pair[begin] = raw[begin]  # nothing stands before a text, whatever text that is in these bytes
    owner = np.repeat(np.arange(n), np.diff(offsets))
    h = np.bincount(owner * PROFILE + pair, minlength=n * PROFILE).reshape(n, PROFILE).astype(np.float32)
    return np.sqrt(h / np.maximum(1, h.sum(1, keepdims=True)))


def fit_classes(x: np.ndarray, k: int, tries: int = 5) -> np.ndarray:
    """Centres of k classes by k-means, the best of several seeded starts."""
    if not len(x):
        return np.zeros((1, PROFILE), np.float32)
    best, least = x[:1], np.inf
    for seed in range(tries):
        r = np.random.default_rng(seed)
        c = x[r.integers(0, len(x), 1)]
        while len(c) < min(k, len(x)):
            d = ((x**2).sum(1)[:, None] - 2 * x @ c.T + (c**2).sum(1)).min(1).clip(0) + 1e-12
            c = np.concatenate((c, x[r.choice(len(x), 1, p=d / d.sum())]))
        for _ in range(20):
            own = nearest_class(x, c)
            c = np.array([x[own == i].mean(0) if (own == i).any() else c[i] for i in range(len(c))])
        cost = float(((x - c[nearest_class(x, c)]) ** 2).sum())
        if cost < least:
            best, least = c, cost
    return best


def nearest_class(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(1) - 2 * x @ centres.T).argmin(1)


class SymbolTree:
    """A binary tree over symbols 0 to n - 1 in their order: each inner node parts its range of symbols where the weights
    are halved, so that a symbol's path is about as long as the logarithm of its share. An inner node is named by the
    first symbol of its right part; children are 0 for a leaf."""

    def __init__(self, weights: np.ndarray):
        n = len(weights)
        cum = np.concatenate(([0], np.cumsum(weights)))
        self.child, self.depth, self.root = np.zeros(2 * n, np.int32), np.zeros(n, np.uint8), 0
        lo, hi, slot = np.zeros(1, np.int64), np.full(1, n, np.int64), np.full(1, -1, np.int64)
        while len(lo) and n > 1:
            half = (cum[lo] + cum[hi]) / 2
            s = np.searchsorted(cum, half)
            s -= (s > lo + 1) & (half - cum[np.maximum(s - 1, 0)] < cum[np.minimum(s, n)] - half)
            s = np.clip(s, lo + 1, hi - 1)
            if slot[0] < 0:
                self.root = int(s[0])
            else:
                self.child[slot] = s
            delta = np.bincount(lo, minlength=n + 1) - np.bincount(hi, minlength=n + 1)
            self.depth += np.cumsum(delta)[:n].astype(np.uint8)
            lo, hi, slot = np.concatenate((lo, s)), np.concatenate((s, hi)), np.concatenate((2 * s, 2 * s + 1))
            wide = hi - lo > 1
            lo, hi, slot = lo[wide], hi[wide], slot[wide]


@dataclass
class Stream:
    """Symbols, the 32-bit hashes of their contexts, the class of their text, the symbol that a match guesses (-1: none)
    and how many guesses in a row were right before."""

    symbol: np.ndarray
    contexts: list[np.ndarray]
    kind: np.ndarray
    guess: np.ndarray
    run: np.ndarray

    def chunks(self, size: int) -> Iterator[tuple[slice, Stream]]:
        for a in range(0, len(self.symbol), size):
            at = slice(a, a + size)
            yield at, Stream(self.symbol[at], [c[at] for c in self.contexts], self.kind[at], self.guess[at], self.run[at])


CONFIDENCE = 8
GATES = CONFIDENCE * CONFIDENCE * 2
BUCKETS = 49
RUNS = 8
PRIOR = 0.4
#: Slots by the count of all bits seen: 0, 1, 2, 3-4, 5-8, 9-32, 33-256, more.
_CONFIDENCE = np.searchsorted([1, 2, 3, 5, 9, 33, 257], np.arange(258), "right").astype(np.uint8)
_SALTS = [np.uint32(x) for x in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F)]
_NODE = np.uint32(0x2C1B3C6D)


def _odds(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    return np.log((n1 + np.float32(PRIOR)) / (n0 + np.float32(PRIOR)))


def quantised(counts: np.ndarray) -> np.ndarray:
    """(slots) states of (slots, 2) counts: confidence and log odds, in 3 and 9 bits."""
    conf = _CONFIDENCE[np.minimum(counts.sum(1), 257)].astype(np.uint16)
    x = np.clip(_odds(*counts.T.astype(np.float32)), -8, 8)
    return conf << 9 | np.rint((x + 8) * (511 / 16)).astype(np.uint16)


_STRETCH = np.concatenate((np.zeros(512), np.tile(np.arange(512) * (16 / 511) - 8, CONFIDENCE - 1))).astype(np.float32)


class Mixer:
    """counts: for each context (slots, 2) while learning; states: the same quantised, for scoring; weights (inputs,
    gates), one input a context and one for the match; refine (classes, buckets, 2) and hits (runs, 2): ones and all."""

    def __init__(self, tree: SymbolTree, bits: list[int], classes: int, seed_weight: float):
        self.tree, self.bits = tree, bits
        self.counts: list[np.ndarray] = []
        self.states: list[np.ndarray] = []
        self.weights = np.full((len(bits) + 1, GATES), seed_weight)
        self.squares = np.zeros_like(self.weights)
        self.mass = np.zeros(GATES)
        self.refine = np.zeros((classes * BUCKETS, 2))
        self.hits = np.tile([1.0, 2.0], (RUNS, 1))

    def begin(self) -> Mixer:
        """Nothing counted and nothing learnt: a worker's process may have used this mixer for another task before."""
        self.counts = [np.zeros(2 << b, np.int32) for b in self.bits]
        names = ("weights", "mass", "squares", "refine", "hits")
        for n, v in self.__dict__.setdefault("_unused", {n: getattr(self, n).copy() for n in names}).items():
            setattr(self, n, v.copy())
        return self

    def _walk(self, e: Stream):
        """By depth: (how many symbols go on, their bits, the bits their match guesses, whether it still does, slots by
        context). Symbols stand by falling length of their paths, so that those that go on are the first ones."""
        t = self.tree
        depth = t.depth[e.symbol]
        steps = np.cumsum(np.bincount(depth)[::-1])[::-1][1:] if len(depth) else []
        node = np.full(len(depth), t.root, np.int32)
        alive = e.guess >= 0
        for m in steps:
            node, alive = node[:m], alive[:m]
            bit, guess = e.symbol[:m] >= node, e.guess[:m] >= node
            at = node.astype(np.uint32) * _NODE
            slots = [((c[:m] + at) * salt >> np.uint32(32 - b)).astype(np.int32) for c, salt, b in zip(e.contexts, _SALTS, self.bits, strict=True)]
            yield m, bit, guess, alive, slots
            alive = alive & (guess == bit)
            node = t.child[2 * node + bit]

    def _ordered(self, e: Stream) -> tuple[np.ndarray, Stream]:
        order = np.argsort(255 - self.tree.depth[e.symbol], kind="stable")
        return order, Stream(e.symbol[order], [c[order] for c in e.contexts], e.kind[order], e.guess[order], e.run[order])

    def _mixed(self, x: list[np.ndarray], conf: list[np.ndarray], alive: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        gate = (conf[0].astype(np.int32) * CONFIDENCE + conf[1]) * 2 + alive
        s = weights[0].take(gate) * x[0]
        for w, v in zip(weights[1:], x[1:], strict=True):
            s += w.take(gate) * v
        return gate, np.clip(s, -12, 12)

    def _match(self, m: int, e: Stream, guess: np.ndarray, alive: np.ndarray) -> np.ndarray:
        strength = _odds(self.hits[:, 1] - self.hits[:, 0], self.hits[:, 0]).astype(np.float32)
        return np.where(alive, np.where(guess, strength[e.run[:m]], -strength[e.run[:m]]), np.float32(0))

    @staticmethod
    def _bucket(s: np.ndarray) -> np.ndarray:
        return np.rint(s * ((BUCKETS - 1) / 24) + BUCKETS // 2).astype(np.int32)

    def learn(self, e: Stream, step: float) -> None:
        """Each bit is predicted from what was counted before this batch; with a step, weights move along the mean gradient
        of their gate's bits, less the more they have moved, and the last stage and the match count how bits turn out.
        Then the bits are counted."""
        _, e = self._ordered(e)
        for m, bit, guess, alive, slots in self._walk(e):
            if step:
                x, conf = [], []
                for k, (c, i) in enumerate(zip(self.counts, slots, strict=True)):
                    n0, n1 = c.take(2 * i), c.take(2 * i + 1)
                    x.append(_odds(n0.astype(np.float32), n1.astype(np.float32)))
                    if k >= len(slots) - 2:
                        conf.append(_CONFIDENCE[np.minimum(n0 + n1, 257)])
                x.append(self._match(m, e, guess, alive))
                gate, s = self._mixed(x, conf, alive, self.weights.astype(np.float32))
                err = bit - 1 / (1 + np.exp(-s))
                mass = np.bincount(gate, minlength=GATES)
                g = np.stack([np.bincount(gate, err * v, GATES) for v in x]) / np.maximum(1, mass)
                self.squares += g * g
                self.weights += step * g / (np.sqrt(self.squares) + 1e-6)
                self.mass += mass
                b = e.kind[:m] * BUCKETS + self._bucket(s)
                self.refine[:, 0] += np.bincount(b, bit, len(self.refine))
                self.refine[:, 1] += np.bincount(b, minlength=len(self.refine))
                run = e.run[:m][alive]
                self.hits[:, 0] += np.bincount(run, (guess == bit)[alive], RUNS)
                self.hits[:, 1] += np.bincount(run, minlength=RUNS)
            for c, i in zip(self.counts, slots, strict=True):
                np.add.at(c, (2 * i + bit).astype(np.int64), np.int32(1))  # the types that numpy adds fast

    def cost(self, e: Stream) -> np.ndarray:
        """Natural logarithm of the probability of each symbol."""
        order, e = self._ordered(e)
        total, weights, kind, least = np.zeros(len(order)), self.weights.astype(np.float32), e.kind.astype(np.int32) * BUCKETS, np.float32(1e-7)
        ones, all_ = self.refine.T  # p becomes the mean of p and (ones + 4 p) / (all + 4)
        own, share = (0.5 * ones / (all_ + 4)).astype(np.float32), (0.5 + 2 / (all_ + 4)).astype(np.float32)
        for m, bit, guess, alive, slots in self._walk(e):
            q = [s.take(i) for s, i in zip(self.states, slots, strict=True)]
            _, s = self._mixed([*[_STRETCH.take(v) for v in q], self._match(m, e, guess, alive)], [v >> 9 for v in q[-2:]], alive, weights)
            b = kind[:m] + self._bucket(s)
            p = own.take(b) + share.take(b) / (1 + np.exp(-s))
            total[:m] += np.log(np.clip(np.abs(p - ~bit), least, 1))
        out = np.empty(len(order))
        out[order] = total
        return out


class WordIndex:
    """Places of 64-bit keys: open tables by other bits of the key each, the next one for what the one before has no room for."""

    def __init__(self, keys: np.ndarray):
        self.keys, self.tables = keys, []
        left = np.arange(len(keys))
        while len(left):
            bits = max(4, int(2 * len(left) - 1).bit_length())
            t = np.full(1 << bits, -1, np.int32)
            slot = self._slot(keys[left], len(self.tables), bits)
            t[slot] = left
            self.tables.append((bits, t))
            left = left[t[slot] != left]

    @staticmethod
    def _slot(keys: np.ndarray, level: int, bits: int) -> np.ndarray:
        return ((keys * U(0x9E3779B97F4A7C15 + 2 * level)) >> U(64 - bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, or -1."""
        out, left = np.full(len(keys), -1, np.int32), np.arange(len(keys))
        for level, (bits, t) in enumerate(self.tables):
            own = keys[left]
            at = t[self._slot(own, level, bits)]
            hit = (at >= 0) & (self.keys[at] == own)
            out[left[hit]] = at[hit]
            left = left[~hit]
        return out


END, ESCAPE, FIRST_WORD = 0, 1, 2
END_HASH = U(0x5851F42D4C957F2D)
BLANK = 32


@dataclass
class Words:
    """The words of some texts, and the Stream of their symbols."""

    hashes: np.ndarray  # of tokens: words and ends
    place: np.ndarray  # in the dictionary, or -1
    doc: np.ndarray
    again: np.ndarray  # whether a match guesses just this word
    stream: Stream
    rare: np.ndarray  # tokens to spell
    spans: tuple[np.ndarray, np.ndarray]  # of theirs in the bytes

    @classmethod
    def of(cls, low: np.ndarray, offsets: np.ndarray, kind: np.ndarray, index: WordIndex) -> Words:
        h, starts, ends, rows = word_hashes(low, offsets, fold=False)
        n, sizes = len(rows) - 1, np.diff(rows) + 1
        doc = np.repeat(np.arange(n), sizes)
        begin = rows[:-1] + np.arange(n)
        at = np.arange(len(h)) + np.repeat(np.arange(n), sizes - 1)
        hashes, place, symbol = np.full(len(doc), END_HASH), np.full(len(doc), -1, np.int32), np.full(len(doc), END, np.int32)
        hashes[at] = h
        place[at] = found = index.find(h)
        symbol[at] = np.where(found >= 0, found + FIRST_WORD, ESCAPE)
        word = (hashes >> U(32)).astype(np.uint32)
        one, two = np.empty_like(word), np.empty_like(word)
        one[1:], two[2:] = word[:-1], word[:-2]
        one[begin] = two[begin] = 1
        two[(begin + 1)[sizes > 1]] = 2
        # The last place in this text that follows the same two words.
        key = (one.astype(U) << U(32) | two.astype(U)) + mix(doc.astype(U), 21)
        order = np.argsort(key, kind="stable")
        same = key[order[1:]] == key[order[:-1]]
        last = np.full(len(doc), -1, np.int64)
        last[order[1:][same]] = order[:-1][same]
        again = (last >= 0) & (hashes[last] == hashes)
        index_ = np.arange(len(doc))
        miss = np.maximum.accumulate(np.where(again, -1, index_)) if len(doc) else index_
        run = np.zeros(len(doc), np.int64)
        run[1:] = np.minimum(RUNS - 1, index_[:-1] - miss[:-1])
        guess = np.where(last >= 0, symbol[last], np.int32(-1))
        kinds = kind[doc]
        contexts = [np.zeros(len(doc), np.uint32), (kinds + 1).astype(np.uint32) * np.uint32(0x61C88647), one, one * np.uint32(0x3C6EF35F) + two]
        rare = np.flatnonzero(symbol == ESCAPE)
        w = rare - doc[rare]
        return cls(hashes, place, doc, again, Stream(symbol, contexts, kinds, guess, run), rare, (starts[w], ends[w]))


def spelling(low: np.ndarray, starts: np.ndarray, ends: np.ndarray, kind: np.ndarray) -> tuple[Stream, np.ndarray]:
    """(stream, owner): the bytes of words and a blank behind each, after one to four bytes of the word."""
    sizes = ends - starts + 1
    owner = np.repeat(np.arange(len(sizes)), sizes)
    begin = np.cumsum(sizes) - sizes
    at = np.arange(len(owner)) - begin[owner]
    data = low[np.minimum(starts[owner] + at, len(low) - 1)].astype(np.uint32) if len(owner) else np.zeros(0, np.uint32)
    data[begin + sizes - 1] = BLANK
    before = []
    for k in (1, 2, 3, 4):
        b = np.zeros(len(data), np.uint32)
        b[k:] = data[:-k] + 1
        before.append(np.where(at >= k, b, 0).astype(np.uint32))
    kinds = kind[owner]
    tag = (kinds + 1).astype(np.uint32) * np.uint32(0x61C88647)
    hashes = [before[0] + tag]
    for b in before[1:]:
        hashes.append(hashes[-1] * np.uint32(0x01000193) + b)
    hashes = [x * np.uint32(0x45D9F3B) for x in hashes]
    return Stream(data.astype(np.int32), hashes, kinds, np.full(len(data), -1, np.int32), np.zeros(len(data), np.int64)), owner


@dataclass
class LanguageModel:
    """Mixers of words and of the bytes of words outside the dictionary; base: log10 of the unigram probabilities by place in
    the dictionary; repeats (runs, 2): of the rare words that a match guessed, those that it guessed right, and all."""

    centres: np.ndarray
    index: WordIndex
    words: Mixer
    bytes: Mixer
    base: np.ndarray
    batch: int
    repeats: np.ndarray = field(default_factory=lambda: np.tile([1.0, 2.0], (RUNS, 1)))

    def texts(self, column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, Words]]:
        for first, raw, offsets in text_pieces(column, STRETCH):
            low = lower(raw)
            kind = nearest_class(byte_profile(low, offsets), self.centres)
            yield first, low, offsets, kind, Words.of(low, offsets, kind, self.index)

    def learn(self, low: np.ndarray, w: Words, step: float) -> None:
        for _, e in w.stream.chunks(self.batch):
            self.words.learn(e, step)
        guessed = w.rare[w.stream.guess[w.rare] == ESCAPE]
        self.repeats[:, 0] += np.bincount(w.stream.run[guessed], w.again[guessed], RUNS)
        self.repeats[:, 1] += np.bincount(w.stream.run[guessed], minlength=RUNS)
        for _, e in spelling(low, *w.spans, w.stream.kind[w.rare])[0].chunks(self.batch):
            self.bytes.learn(e, step)

    def cost(self, low: np.ndarray, w: Words) -> np.ndarray:
        """log10 probability of each token."""
        out = np.zeros(len(w.doc))
        for at, e in w.stream.chunks(self.batch):
            out[at] = self.words.cost(e)
        if len(w.rare):  # equal words of one class are spelt once
            kind = w.stream.kind[w.rare]
            _, one, which = np.unique(w.hashes[w.rare] + mix(kind.astype(U), 22), return_index=True, return_inverse=True)
            e, owner = spelling(low, w.spans[0][one], w.spans[1][one], kind[one])
            spelt = np.concatenate([self.bytes.cost(c) for _, c in e.chunks(self.batch)])
            p = np.exp(np.bincount(owner, spelt, len(one))[which].clip(-700))
            share = np.where(w.stream.guess[w.rare] == ESCAPE, (self.repeats[:, 0] / self.repeats[:, 1])[w.stream.run[w.rare]], 0.0)
            out[w.rare] += np.log(np.where(w.again[w.rare], share, 0.0) + (1 - share) * p)
        return out / LOG10


def _first_classes(docs: DataFrame, m: MixModel) -> np.ndarray:
    cut = min(1.0, m.class_sample / max(1, docs.count()))
    picked = docs.where(F.pmod(F.xxhash64("doc_id", F.lit("class")), F.lit(1 << 20)) < int(cut * (1 << 20)) + 1).select("text").where("length(text) >= 200")

    def run(batches):
        for batch in batches:
            for _, raw, offsets in text_pieces(batch.column("text"), STRETCH):
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in byte_profile(lower(raw), offsets)], pa.binary())], ["x"])

    with writing(docs.sparkSession):
        rows = picked.mapInArrow(run, "x binary").orderBy("x").limit(2 * m.class_sample).collect()
    return fit_classes(np.frombuffer(b"".join(r["x"] for r in rows), np.float32).reshape(-1, PROFILE), m.classes)


def classes_of(docs: DataFrame, m: MixModel) -> np.ndarray:
    """Centres of the classes of docs(doc_id, text): k-means starts from some texts, then each round assigns every text that
    is not empty and takes the means of all. A task adds up what it reads, as integers, so the order of rows does not count."""
    centres = _first_classes(docs, m)
    for _ in range(m.class_rounds):

        def run(batches, centres=centres):
            sums, count = np.zeros((len(centres), PROFILE), np.int64), np.zeros(len(centres), np.int64)
            for batch in batches:
                for _, raw, offsets in text_pieces(batch.column("text"), STRETCH):
                    x = byte_profile(lower(raw), offsets)[np.diff(offsets) > 0]
                    own = nearest_class(x, centres)
                    for k in np.unique(own):
                        sums[k] += np.rint(x[own == k].astype(np.float64) * (1 << 30)).astype(np.int64).sum(0)
                    count += np.bincount(own, minlength=len(count))
            rows = np.column_stack((count, sums))  # the number of texts stands before the sums
            kind, at = np.nonzero(rows)
            yield pa.RecordBatch.from_arrays([pa.array(kind.astype(np.int32)), pa.array(at.astype(np.int32)), pa.array(rows[kind, at])], ["class", "at", "n"])

        total = np.zeros((len(centres), PROFILE + 1))
        with writing(docs.sparkSession):
            rows = docs.select("text").mapInArrow(run, "class int, at int, n long").groupBy("class", "at").agg(F.sum("n").alias("n")).collect()  # classes * 513 rows
        for r in rows:
            total[r["class"], r["at"]] = r["n"]
        some = total[:, :1] > 0
        centres = np.where(some, total[:, 1:] / np.maximum(1, total[:, :1]) / (1 << 30), centres).astype(np.float32)
    return centres


def _count_words(docs: DataFrame, centres: np.ndarray, flush: int = 16 << 20) -> DataFrame:
    """(h, class, n): tokens of all documents by hash and class of text; class -1: bytes, h being the byte."""

    def run(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size, ends, letters = 0, np.zeros(len(centres), np.int64), np.zeros(256, np.int64)

        def row(h, kind, n):
            return pa.RecordBatch.from_arrays([pa.array(np.asarray(h).astype(np.int64)), pa.array(np.asarray(kind).astype(np.int32)), pa.array(n)], ["h", "class", "n"])

        def out():
            h, kind = (np.concatenate([x[i] for x in held]) for i in (0, 1))
            _, first, n = np.unique(mix(h + kind.astype(U), 11), return_index=True, return_counts=True)
            return row(h[first], kind[first], n)

        for batch in batches:
            for _, raw, offsets in text_pieces(batch.column("text"), STRETCH):
                low = lower(raw)
                kind = nearest_class(byte_profile(low, offsets), centres)
                h, _, _, rows = word_hashes(low, offsets, fold=False)
                held.append((h, np.repeat(kind, np.diff(rows)).astype(np.int32)))
                ends += np.bincount(kind, minlength=len(ends))
                letters += np.bincount(low, minlength=256)
                size += len(raw)
                if size >= flush:
                    yield out()
                    held.clear()
                    size = 0
        if held:
            yield out()
        yield row(np.full(len(ends), END_HASH), np.arange(len(ends)), ends)
        yield row(np.arange(256), np.full(256, -1), letters)

    rows = docs.select("text").mapInArrow(run, "h long, class int, n long")
    return rows.groupBy("h", "class").agg(F.sum("n").alias("n")).where("n > 0")


def _least_count(by_word: DataFrame, limit: int) -> int:
    """The least count, 2 at least, that at most `limit` words reach."""
    rows = by_word.where("n > 1").groupBy(F.least("n", F.lit(1 << 16)).alias("n")).agg(F.count("*").alias("words")).collect()  # 65,535 rows at most
    words, least = 0, 1 << 62
    for n, more in sorted(((r["n"], r["words"]) for r in rows), reverse=True):
        words += more
        if words > limit:
            break
        least = n
    return least


def _iterated(df: DataFrame) -> Iterator:
    with writing(df.sparkSession, clean=False):  # partitions are read one by one
        yield from df.toLocalIterator()


_BLOCK = 1 << 16  # slots that are summed together
_NUMBERS = -1


def _fit(docs: DataFrame, fresh: LanguageModel, m: MixModel, tokens: int) -> LanguageModel:
    """The model learnt online from docs: each task goes through its texts in order, predicts, learns and counts; tasks' counts are
    summed as integers, their weights averaged by the bits that they saw at each gate, in the order of tasks. What a task
    is, is said by `part`: partitions may hold none or several."""
    spark = docs.sparkSession
    tasks = max(1, math.ceil(tokens / m.task_tokens))
    shared, untouched = spark.sparkContext.broadcast(fresh), fresh.repeats.copy()

    def numbers(lm: LanguageModel) -> np.ndarray:
        parts = [lm.repeats]
        for x in (lm.words, lm.bytes):
            parts += [x.weights * x.mass, x.mass, x.refine, x.hits]
        return np.concatenate([p.ravel() for p in parts])

    def row(block, part, data):
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([part], pa.int32()), pa.array([zlib.compress(data.tobytes(), 1)], pa.binary())], ["block", "part", "data"])

    def begun(lm: LanguageModel) -> np.ndarray:
        lm.words.begin()
        lm.bytes.begin()
        lm.repeats = untouched.copy()
        return numbers(lm)

    def learnt(lm: LanguageModel, part: int, before: np.ndarray):
        for k, counts in enumerate(lm.words.counts + lm.bytes.counts):
            for i in range(0, len(counts), 2 * _BLOCK):
                some = counts[i : i + 2 * _BLOCK]
                if some.any():
                    yield row(k << 24 | i // (2 * _BLOCK), part, some)
        yield row(_NUMBERS, part, numbers(lm) - before)

    def count(batches):
        lm, part, before = shared.value, None, None
        for batch in batches:
            parts = batch.column("part").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(parts)) + 1).tolist(), len(parts)]
            for a, z in zip(edges[:-1], edges[1:], strict=True):
                if a == z:
                    continue
                if parts[a] != part:
                    if part is not None:
                        yield from learnt(lm, part, before)
                    part, before = int(parts[a]), begun(lm)
                for _, low, _, _, w in lm.texts(batch.column("text").slice(a, z - a)):
                    lm.learn(low, w, m.rate)
        if part is not None:
            yield from learnt(lm, part, before)

    def add(batches):
        block, total = None, None
        for batch in batches:  # a block's rows follow each other, in the order of tasks
            for i, data in zip(batch.column("block").to_pylist(), batch.column("data").to_pylist(), strict=True):
                x = np.frombuffer(zlib.decompress(data), np.float64 if i == _NUMBERS else np.int32)
                if i != block:
                    if block is not None:
                        yield row(block, 0, total if block == _NUMBERS else quantised(total.reshape(-1, 2)))
                    block, total = i, np.zeros(len(x), x.dtype if i == _NUMBERS else np.int64)
                total += x
        if block is not None:
            yield row(block, 0, total if block == _NUMBERS else quantised(total.reshape(-1, 2)))

    schema = "block int, part int, data binary"
    h = F.xxhash64("doc_id", "text")  # copies of one text go to several tasks
    dealt = docs.select("text", h.alias("h")).withColumn("part", F.pmod("h", F.lit(tasks)).cast("int"))
    dealt = dealt.repartitionByRange(tasks, "part").sortWithinPartitions("part", "h").select("part", "text")
    counted = dealt.mapInArrow(count, schema)
    summed = counted.repartition("block").sortWithinPartitions("block", "part").mapInArrow(add, schema)
    mixers = fresh.words, fresh.bytes
    for x in mixers:
        x.states = [np.zeros(1 << b, np.uint16) for b in x.bits]
    states = fresh.words.states + fresh.bytes.states
    for r in _iterated(summed):  # a model of bounded size
        data = zlib.decompress(r["data"])
        if r["block"] != _NUMBERS:
            k, i = r["block"] >> 24, r["block"] & 0xFFFFFF
            states[k][i * _BLOCK : (i + 1) * _BLOCK] = np.frombuffer(data, np.uint16)
            continue
        rest = np.frombuffer(data)

        def take(like):
            nonlocal rest
            x, rest = rest[: like.size].reshape(like.shape), rest[like.size :]
            return x

        fresh.repeats = fresh.repeats + take(fresh.repeats)
        for x in mixers:
            weights, mass = take(x.weights), take(x.mass)
            x.weights = np.where(mass > 0, weights / np.maximum(1, mass), x.weights)
            x.mass, x.refine, x.hits = mass, take(x.refine), x.hits + take(x.hits)
    shared.unpersist()
    return fresh


def score(docs: DataFrame, training: Column, m: MixModel = MixModel()) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte of documents(doc_id, text).

    Words are split at blanks, A-Z lower-cased; a text is its words in order and an end. The model learns from the
    documents under `training`, a condition on doc_id or text (null: not). score is the log10 probability of the text: of
    its class, then of each bit of each symbol. A bit's predictors are hashed contexts (the node in the tree of symbols
    alone, with the class of the text, with the word before, with the two words before) and the symbol that followed the
    same two words in this text; gates by the confidence of the longest contexts choose the weights; the last stage
    corrects by class and prediction. Words outside the dictionary are spelt by a mixer of bytes. base_score is that of a
    unigram model with add-one smoothing; words outside the dictionary are joined with their counts for it. Words are
    told apart by 64-bit hashes.

    Null texts are empty; a null doc_id is as any other; repeated rows each return a row; an empty table gives none;
    without training documents all words are unknown and spelt; other columns are ignored.
    """
    spark = docs.sparkSession
    kind_of_id = dict(docs.dtypes)["doc_id"]
    d = only_columns(docs, "doc_id", "text").withColumn("text", F.col("text").cast("string"))
    train = d.where(F.coalesce(training, F.lit(False)))
    centres = classes_of(train, m)
    counts = materialize(_count_words(train, centres))
    by_word = materialize(counts.where("class >= 0").groupBy("h").agg(F.sum("n").alias("n"), F.max_by("class", F.struct("n", "class")).alias("kind")))
    end = F.when(F.col("h") == F.lit(int(END_HASH.astype(np.int64))), F.col("n")).otherwise(0)
    about = by_word.agg(F.sum("n").alias("n"), F.count("*").alias("v"), F.sum(end).alias("ends")).first()
    n_train, v, ends = int(about["n"] or 0), int(about["v"]), int(about["ends"] or 0)
    log_all = float(np.log10(n_train + v + 1))
    letters = np.ones(256, np.int64)
    for r in counts.where("class < 0").collect():  # 256 rows at most
        letters[r["h"]] += r["n"]
    listed = by_word.where((F.col("n") >= _least_count(by_word, m.dictionary)) & (end == 0)).select("kind", "n", "h").toArrow()  # columns, as a million rows of objects take hundreds of MB
    kind, n, h = (listed.column(x).to_numpy() for x in ("kind", "n", "h"))
    order = np.lexsort((h, -n, kind))
    keys, n = h[order].astype(U), n[order]
    del listed, kind, h, order
    tree = SymbolTree(np.concatenate(([max(1, ends), max(1, n_train - ends - int(n.sum()))], n)))
    bits = lambda most: min(m.slot_bits, max(m.least_bits, int(most).bit_length()))
    long, symbols = bits(4 * n_train), 2 * len(tree.depth)
    words = Mixer(tree, [min(long, bits(symbols)), min(long, bits(symbols * len(centres))), long, long], len(centres), m.seed_weight)
    spell = Mixer(SymbolTree(letters), [min(long, b) for b in (16, 18, 20, 20)], len(centres), m.seed_weight)
    fresh = LanguageModel(centres, WordIndex(keys), words, spell, np.log10(n + 1.0) - log_all, m.batch)
    batch = max(256, min(m.batch, n_train // 100))
    fresh.batch = batch
    model = spark.sparkContext.broadcast(_fit(train, fresh, m, n_train))
    prior, end_base = -float(np.log10(len(centres))), float(np.log10(ends + 1)) - log_all

    def scored(batches):
        lm = model.value
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for first, low, offsets, _, w in lm.texts(batch.column("text")):
                k = len(offsets) - 1
                known = w.place >= 0
                total = np.bincount(w.doc, lm.cost(low, w), k) + prior
                base = np.bincount(w.doc[known], lm.base[w.place[known]], k) + end_base
                sizes = np.bincount(w.doc[w.rare], minlength=k)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), pa.array(w.hashes[w.rare].astype(np.int64)))
                cols = {
                    "row": pa.array(np.arange(row, row + k)), "doc_id": batch.column("doc_id").slice(first, k), "n_tokens": pa.array(np.bincount(w.doc, minlength=k)),
                    "n_known": pa.array(np.bincount(w.doc[known], minlength=k) + (ends > 0)), "base": pa.array(base), "score": pa.array(total), "bytes": pa.array(np.diff(offsets)), "rare": lists,
                }
                row += k
                yield pa.RecordBatch.from_arrays(list(cols.values()), list(cols))

    schema = f"row long, doc_id {kind_of_id}, n_tokens long, n_known long, base double, score double, bytes long, rare array<long>"
    out = materialize(d.select("doc_id", "text").mapInArrow(scored, schema))
    rare = out.where("size(rare) > 0").select("row", F.explode("rare").alias("h"))
    rare = rare.join(by_word.select(F.col("h").alias("w"), "n"), F.col("h") == F.col("w"), "left").select("row", F.coalesce("n", F.lit(0)).alias("n"))
    rare = rare.select("row", (F.col("n") > 0).cast("long").alias("n_known"), (F.log10(F.col("n") + 1.0) - log_all).alias("base"))
    every = out.drop("rare").union(rare.select("row", F.lit(None).cast(kind_of_id), F.lit(0).cast("long"), "n_known", "base", F.lit(0.0), F.lit(0).cast("long")))
    out = every.groupBy("row").agg(F.max("doc_id").alias("doc_id"), *[F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base", "score", "bytes")])
    return out.select(
        "doc_id", "n_tokens", "n_known", F.lit(n_train).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), "score",
        (-F.col("score") * float(np.log2(10.0)) / F.greatest(F.lit(1), F.col("bytes"))).alias("bits_per_byte"),
    )
