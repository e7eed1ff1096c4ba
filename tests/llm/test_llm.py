import functools
import hashlib
import math
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import oracle
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

pytest.importorskip("siftline.llm")
import corpus_pipeline
from siftline.llm import alignment, jaccard, language, mixing_model, neighbours, packing, queries, substrings
from siftline.llm.chat import WindowBudget, digests, format_windows, read_back
from siftline.llm.components import components
from siftline.llm.jaccard import linked_components, one_of_each
from siftline.llm.mixing import mixed_documents, plan_mix
from siftline.llm.quality import keep_good, quality_rules
from siftline.llm.sharding import kd_shards

WORD = re.compile(r"[^\x20\x09-\x0D]+")
RND = random.Random(5)
VOCABULARY = ["".join(RND.choice("abcdefghijklmnop") for _ in range(RND.randint(2, 8))) for _ in range(2000)]


def words(n, r=RND):
    return [r.choice(VOCABULARY) for _ in range(n)]


@functools.cache
def awkward():
    """Rows that every operator has to take: nulls, blanks, repeats, ties, a very long text."""
    base = " ".join(words(120))
    texts = [None, "", "  \t\n ", "one", "a b c d", base, base, base + " more", "the " * 300, " ".join(words(30000)), "\n".join(["x y z"] * 40), "word\x85word é ü"]
    rows = [(i, t, ["en", None, "de"][i % 3], ["s1", None, "s2"][i % 3], 0) for i, t in enumerate(texts)]
    return rows + [(None, base, None, None, None), (5, texts[5], "de", "s2", 0), (5, texts[5], "de", "s2", 0)]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = ["k", "h", "c", "n", "t", "th", "size", "gone", "v", "bucket", "shard", "_u", "row"]


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(awkward(), SCHEMA)
    return df.select("*", *[F.lit("clash").alias(c) for c in CLASHING])


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def corpus(spark):
    r, rows = random.Random(9), []
    passage, other = words(70, r), words(110, r)
    for i in range(60):
        w = words(r.randint(60, 200), r)
        if i % 6 == 0:
            w[20:20] = passage
        if i % 10 == 1:
            q = list(other)
            for _ in range(5):
                q[r.randrange(len(q))] = r.choice(VOCABULARY)
            w[40:40] = q
        rows.append((i, " ".join(w), "en", f"s{i % 4}", 0))
    near = words(200, r)
    for i in range(60, 75):
        w = list(near)
        for _ in range(r.randint(0, 3)):
            w[r.randrange(200)] = r.choice(VOCABULARY)
        rows.append((i, " ".join(w), "en", "s9", 0))
    rows += [(80 + i, rows[3][1], "en", "s1", 0) for i in range(5)]
    return rows, " ".join(passage), " ".join(other)


@pytest.mark.parametrize("name", ["op1_quality_rules", "op4_budgeted_windows", "op5_signature_tree_join", "op8_vantage_trees"])
def test_matches_sql(spark, sf_dir, name):
    oracle.check(spark, sf_dir, queries.QUERIES[name], queries.ORACLES[name])


# 1. quality rules


def base(text):
    w = WORD.findall(text or "")
    win = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    often = {x for x, n in Counter(win).items() if n > 1}
    covered = {i + o for i, x in enumerate(win) if x in often for o in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_quality_base_rules_of_awkward_rows(odd):
    got = quality_rules(odd).collect()
    text = {r[0]: r[1] for r in awkward()}
    assert len(got) == len(awkward())
    for r in got:
        m = base(text[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == m
        assert r.base_failed == (m[0] < 50 or 2 * m[4] > m[0]) and (not r.kept or not r.base_failed)


def test_boilerplate_goes_and_depleted_documents_are_rejected(spark, none):
    foot = "all rights are reserved by the owners of this page"
    rows = [(i, "\n".join([" ".join(words(60)), "  " + foot.upper(), " ".join(words(9))]), "en", "h", 0) for i in range(40)]
    rows += [(50, "\n".join([foot] * 12 + [" ".join(words(5))]), "en", "h", 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.doc_id: r for r in quality_rules(df).collect()}
    assert all(got[i].kept and got[i].n_lines_removed == 1 and got[i].words_left == 69 for i in range(40)) and not got[50].kept
    kept = keep_good(df).collect()
    assert len(kept) == 40 and all(foot.upper() not in r.text and r.text.count("\n") == 1 and r.n_chars == len(r.text) for r in kept)
    assert keep_good(df).columns == df.columns
    assert quality_rules(none).count() == 0 and keep_good(none).count() == 0


# 2. LM scoring


def test_language_model_scores(spark, odd):
    r = random.Random(4)
    rows = [(i, " ".join(r.choice(VOCABULARY[:80]) for _ in range(60)), None, None, 0) for i in range(120)] + awkward()
    df = spark.createDataFrame(rows, SCHEMA)
    m = mixing_model.MixModel(classes=2, slot_bits=14, dictionary=40)
    train = F.coalesce(F.pmod(F.col("doc_id"), F.lit(3)) != 0, F.lit(False))
    got = mixing_model.score(df, train, m).collect()
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tokens = lambda t: WORD.findall((t or "").translate(fold)) + [""]
    counts = Counter(x for d in rows if d[0] is not None and d[0] % 3 for x in tokens(d[1]))
    n, v = sum(counts.values()), len(counts)
    want = sorted((d[0] if d[0] is not None else -1, len(tokens(d[1])), sum(counts[x] > 0 for x in tokens(d[1])), round(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in tokens(d[1])), 6)) for d in rows)
    assert sorted((x.doc_id if x.doc_id is not None else -1, x.n_tokens, x.n_known, round(x.base_score, 6)) for x in got) == want
    assert all(x.train_tokens == n and x.score < 0 for x in got)


def stream(r, n, symbols):
    """A stream with order, some matches and contexts of the two symbols before."""
    x = np.zeros(n, np.int32)
    for i in range(1, n):
        x[i] = (x[i - 1] * 7 + 1) % symbols if r.random() < 0.6 else r.integers(0, symbols)
    one, two = np.concatenate(([0], x[:-1])).astype(np.uint32), np.concatenate(([0, 0], x[:-2])).astype(np.uint32)
    kind = r.integers(0, 2, n)
    guess = np.where(r.random(n) < 0.5, np.where(r.random(n) < 0.7, x, r.integers(0, symbols, n)), -1).astype(np.int32)
    return mixing_model.Stream(x, [np.zeros(n, np.uint32), kind.astype(np.uint32) * np.uint32(77), one * np.uint32(99991), one * np.uint32(31337) + two], kind, guess, r.integers(0, 8, n))


class PlainMixer:
    """The same model bit by bit, in plain Python."""

    def __init__(self, mixer):
        self.t, self.bits, self.w = mixer.tree, mixer.bits, mixer.weights.copy()
        self.counts = [Counter() for _ in self.bits]
        self.squares, self.refine, self.hits = np.zeros_like(self.w), np.zeros_like(mixer.refine), mixer.hits.copy()

    def paths(self, e):
        for i, x in enumerate(e.symbol.tolist()):
            path, node, alive = [], self.t.root, e.guess[i] >= 0
            while node:
                bit, guess = int(x >= node), int(e.guess[i] >= node)
                slots = [((int(c[i]) + node * 0x2C1B3C6D) * int(salt) & 0xFFFFFFFF) >> (32 - b) for c, salt, b in zip(e.contexts, mixing_model._SALTS, self.bits, strict=True)]
                path.append((bit, guess, bool(alive), slots))
                alive = alive and guess == bit
                node = int(self.t.child[2 * node + bit])
            yield path

    def inputs(self, i, e, step, quantise):
        bit, guess, alive, slots = step
        x, conf = [], []
        for c, s in zip(self.counts, slots, strict=True):
            n0, n1 = c[s, 0], c[s, 1]
            v = math.log((n1 + 0.4) / (n0 + 0.4))
            if quantise:
                v = np.rint((min(8, max(-8, v)) + 8) * 511 / 16) * 16 / 511 - 8 if n0 + n1 else 0.0
            x.append(v)
            conf.append(sum(n0 + n1 >= k for k in (1, 2, 3, 5, 9, 33, 257)))
        h1, h = self.hits[e.run[i]]
        x.append((math.log((h1 + 0.4) / (h - h1 + 0.4)) * (1 if guess else -1)) if alive else 0.0)
        gate = (conf[2] * 8 + conf[3]) * 2 + alive
        s = min(12.0, max(-12.0, sum(w * v for w, v in zip(self.w[:, gate], x, strict=True))))
        return x, gate, s, e.kind[i] * mixing_model.BUCKETS + int(np.rint(s * 2)) + mixing_model.BUCKETS // 2

    def learn(self, e, rate):
        paths = list(self.paths(e))
        for depth in range(max(map(len, paths))):
            live = [(i, p[depth]) for i, p in enumerate(paths) if len(p) > depth]
            sums, mass, later = Counter(), Counter(), []
            for i, step in live:
                x, gate, s, b = self.inputs(i, e, step, False)
                mass[gate] += 1
                for k, v in enumerate(x):
                    sums[k, gate] += (step[0] - 1 / (1 + math.exp(-s))) * v
                later.append((b, step, e.run[i]))
            for (k, gate), v in sums.items():
                g = v / mass[gate]
                self.squares[k, gate] += g * g
                self.w[k, gate] += rate * g / (math.sqrt(self.squares[k, gate]) + 1e-6)
            for b, (bit, guess, alive, slots), run in later:
                self.refine[b] += bit, 1
                if alive:
                    self.hits[run] += guess == bit, 1
                for c, s in zip(self.counts, slots, strict=True):
                    c[s, bit] += 1

    def cost(self, e):
        for i, path in enumerate(self.paths(e)):
            total = 0.0
            for step in path:
                _, _, s, b = self.inputs(i, e, step, True)
                p, (ones, all_) = 1 / (1 + math.exp(-s)), self.refine[b]
                p = 0.5 * p + 0.5 * (ones + 4 * p) / (all_ + 4)
                total += math.log(p if step[0] else 1 - p)
            yield total


def learnt(symbols=40):
    r = np.random.default_rng(2)
    mixer = mixing_model.Mixer(mixing_model.SymbolTree(r.integers(1, 200, symbols)), [10, 10, 12, 12], 2, 0.35).begin()
    plain, e = PlainMixer(mixer), stream(r, 700, symbols)
    for _, chunk in e.chunks(100):
        mixer.learn(chunk, 0.05)
        plain.learn(chunk, 0.05)
    mixer.states = [mixing_model.quantised(c.reshape(-1, 2)) for c in mixer.counts]
    return r, mixer, plain, e


def test_mixer_equals_a_plain_version():
    r, mixer, plain, e = learnt()
    assert [int(c.sum()) for c in mixer.counts] == [sum(c.values()) for c in plain.counts]
    assert np.abs(mixer.weights - plain.w).max() < 1e-4 and np.abs(mixer.hits - plain.hits).max() == 0
    new = stream(r, 300, 40)
    got, want = mixer.cost(new), np.array(list(plain.cost(new)))
    close = np.abs(got - want) < 1e-3  # a prediction on the edge of a bucket may fall to either side
    assert close.mean() > 0.97 and abs(got.sum() - want.sum()) < 0.5
    assert got.sum() < 0 and got.mean() > math.log(1 / 40)


def test_mixer_gives_probabilities():
    """Over all symbols the probabilities sum to one in any context, whatever the model has learnt."""
    r, mixer, _, e = learnt()
    for at in range(0, 700, 50):
        every = mixing_model.Stream(np.arange(40, dtype=np.int32), *[np.repeat(x[at], 40) if isinstance(x, np.ndarray) else [np.repeat(c[at], 40) for c in x] for x in (e.contexts, e.kind, e.guess, e.run)])
        assert np.exp(mixer.cost(every)).sum() == pytest.approx(1, abs=1e-5)


def test_symbol_tree_has_short_paths_for_frequent_symbols():
    r = np.random.default_rng(0)
    for w in (np.array([1]), np.array([3, 1]), np.ones(1000, np.int64), r.zipf(1.5, 3000).clip(max=10**6)):
        t = mixing_model.SymbolTree(w)
        for x in r.integers(0, len(w), 50).tolist():
            node, depth = t.root, 0
            while node:
                node, depth = int(t.child[2 * node + (x >= node)]), depth + 1
            assert depth == t.depth[x]
        share = w / w.sum()
        assert (share * t.depth).sum() <= -(share * np.log2(share)).sum() + 1



def test_mixing_takes_texts_in_small_stretches():
    """A worker's arrays stay small beside its counts: before, each megabyte of text took tens of MB."""
    text = pa.array([" ".join(f"word{(i * 7 + j) % 5000}" for j in range(300)) for i in range(2000)])
    keys = np.sort(np.random.default_rng(0).integers(0, 1 << 63, 100).astype(np.uint64))
    lm = mixing_model.LanguageModel(np.zeros((2, mixing_model.PROFILE), np.float32), mixing_model.WordIndex(keys), None, None, np.zeros(100), 4096)
    tracemalloc.start()
    try:
        rows = sum(len(offsets) - 1 for _, _, offsets, _, _ in lm.texts(text))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert rows == 2000 and peak < 48 << 20


def test_word_index_finds_all_and_only_its_keys():
    keys = np.random.default_rng(1).integers(0, 2**63, 5000, np.int64).astype(np.uint64)
    index = mixing_model.WordIndex(keys[:4000])
    assert index.find(keys).tolist() == [*range(4000), *[-1] * 1000]
    assert mixing_model.WordIndex(keys[:0]).find(keys[:3]).tolist() == [-1, -1, -1]


def test_order_of_words_counts(spark):
    r = random.Random(6)
    chain = {w: r.sample(VOCABULARY[:200], 3) for w in VOCABULARY[:200]}

    def walk(n):
        out = [VOCABULARY[0]]
        while len(out) < n:
            out.append(r.choice(chain[out[-1]]))
        return out

    rows = [(i, " ".join(walk(100))) for i in range(200)] + [(1000 + i, " ".join(walk(100))) for i in range(5)]
    rows += [(i + 1000, " ".join(r.sample(t.split(" "), 100))) for i, t in rows[200:]]
    df = spark.createDataFrame(rows, "doc_id long, text string").select("*", *[F.lit("x").alias(c) for c in CLASHING + ["score", "rare", "base", "n_known", "class"]])
    got = {x.doc_id: x for x in mixing_model.score(df, F.col("doc_id") < 1000, mixing_model.MixModel(classes=2)).collect()}
    assert all(got[1000 + i].score > 0.7 * got[2000 + i].score and abs(got[1000 + i].base_score - got[2000 + i].base_score) < 1e-9 for i in range(5))


def test_scores_do_not_depend_on_partitions(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 2
    m = mixing_model.MixModel(task_tokens=4_000, batch=4096)  # more tasks than cores: processes are used again
    got = [{r.doc_id: r.score for r in mixing_model.score(df, ~held, m).collect()} for df in (docs.coalesce(1), docs.repartition(7, "doc_id"))]
    assert got[0].keys() == got[1].keys() and all(abs(got[0][i] - got[1][i]) < 1e-6 for i in got[0])


def test_held_out_scores_beat_the_unigram_base(spark, sf_dir):
    got = queries.op2_context_mixing(spark, sf_dir).where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert got["s"] > got["b"]


# 3. substring dedup


def test_passages_are_found_and_cut(spark, corpus, odd, none):
    rows, passage, other = corpus
    df = spark.createDataFrame(rows, SCHEMA)
    got = substrings.passages(df).collect()
    flagged = {x for r in got for x in (r.doc_id, r.match_doc_id)}
    assert {i for i in range(60) if i % 6 == 0 or i % 10 == 1} <= flagged
    unique = {r[0] for r in rows if r[0] < 60 and r[0] % 6 and r[0] % 10 != 1 and r[0] != 3}
    assert not unique & flagged
    text = {r[0]: r[1].split() for r in rows}
    for r in got:
        assert r.end - r.start >= 50 and r.same >= 0.8 * (r.end - r.start)
        if r.whole:
            assert text[r.doc_id] == text[r.match_doc_id]
        elif r.end - r.start == r.match_end - r.match_start == r.same:
            assert text[r.doc_id][r.start : r.end] == text[r.match_doc_id][r.match_start : r.match_end]
    left = substrings.without_repeats(df)
    assert left.columns == df.columns
    left = left.collect()
    assert sum(passage in r.text for r in left) == 1
    assert all(r.text == " ".join(text[r.doc_id]) for r in left if r.doc_id in unique)
    assert substrings.passages(none).count() == 0 and substrings.without_repeats(none).count() == 0
    assert {(r.doc_id, r.match_doc_id) for r in substrings.passages(odd).where("whole").collect()} == {(6, 5), (None, 5)}


def test_rows_of_one_id_are_cut_by_their_own_passages(spark):
    r = random.Random(21)
    shared, copied, clean, other = words(80, r), words(90, r), words(200, r), words(150, r)
    held = [words(60, r) + shared + words(60, r) for _ in range(2)]
    rows = [(None, held[0]), (None, held[1]), (None, clean), (None, copied), (1, copied), (7, other), (7, copied)]
    df = spark.createDataFrame([(i, " ".join(w), "en", "s", 0) for i, w in rows], SCHEMA)
    got = Counter((x.doc_id, x.text) for x in substrings.without_repeats(df).collect())
    assert got[(None, " ".join(clean))] == got[(7, " ".join(other))] == got[(1, " ".join(copied))] == 1
    assert sum(got.values()) == 5 and sum(" ".join(shared) in t for _, t in got) == 1


def test_fenwick_chains_equal_quadratic_ones():
    p = substrings.Passages()
    r = random.Random(2)
    for _ in range(60):
        pts = sorted({(r.randrange(120), r.randrange(120)) for _ in range(r.randint(1, 25))})
        pb, pa = np.array([x for x, _ in pts]), np.array([x for _, x in pts])
        best = [float(p.k)] * len(pts)
        for i in range(len(pts)):
            prior = [(best[j] + p.gap_cost * (pa[j] + pb[j]), j) for j in range(i) if pb[j] < pb[i] and pa[j] < pa[i]]
            if prior:
                value, j = max(prior)
                gain = value - p.gap_cost * (pa[i] + pb[i])
                if gain > 0 and max(pa[i] - pa[j], pb[i] - pb[j]) <= p.max_gap + p.k:
                    best[i] = gain + min(p.k, pa[i] - pa[j], pb[i] - pb[j])
        found = substrings.chains(pb, pa, p)
        assert sorted(x for c in found for x in c) == list(range(len(pts)))
        assert found[0][-1] == min(range(len(pts)), key=lambda q: (-best[q], q))


def test_second_passage_of_a_pair_is_chained_over_its_insertion():
    p = substrings.Passages()
    for seed in range(20):
        r = np.random.default_rng(seed)
        x, y = (r.integers(0, 2**63, n).astype(np.uint64) for n in (600, 601))
        y[20:320] = x[20:320]  # its chain's end outweighs all near matches for hundreds of words
        y[420:460], y[461:501] = x[420:460], x[460:500]
        at = {int(h): i for i, h in enumerate(substrings.window_hashes(x, p.k))}
        pts = sorted((i, at[int(h)]) for i, h in enumerate(substrings.window_hashes(y, p.k)) if int(h) in at and i % 5 == 0)
        pb, pa = (np.array(c) for c in zip(*pts, strict=True))
        found = [(a0, a1, b0, b1) for a0, a1, b0, b1, _ in substrings.align(x, y, pa, pb, p)]
        assert found == [(20, 320, 20, 320), (420, 500, 420, 501)]


def test_near_chains_equal_quadratic_ones():
    p = substrings.Passages()
    r = random.Random(3)
    for _ in range(60):
        pts = sorted({(r.randrange(120), r.randrange(120)) for _ in range(r.randint(1, 25))})
        pb, pa = np.array([x for x, _ in pts]), np.array([x for _, x in pts])
        best = [float(p.k)] * len(pts)
        for i in range(len(pts)):
            near = [j for j in range(i) if 0 < pb[i] - pb[j] <= p.max_gap + p.k and 0 < pa[i] - pa[j] <= p.max_gap + p.k]
            if near:
                value, j = max((best[j] + p.gap_cost * (pa[j] + pb[j]), j) for j in near)
                gain = value - p.gap_cost * (pa[i] + pb[i])
                if gain > 0:
                    best[i] = gain + min(p.k, pa[i] - pa[j], pb[i] - pb[j])
        found = substrings.chains(pb, pa, p, near=True)
        assert sorted(x for c in found for x in c) == list(range(len(pts)))
        assert found[0][-1] == min(range(len(pts)), key=lambda q: (-best[q], q))


def seed_rows(x, y, p):
    """Passages of one pair of texts as arrays of hashes, through seeds, chains and alignment."""
    (kx, px), (ky, py) = substrings.seed_keys(x, p), substrings.seed_keys(y, p)
    at = dict(zip(kx.tolist(), (px & 0xFFFFFFFF).tolist(), strict=True))
    m = sorted((b, at[k]) for k, b in zip(ky.tolist(), (py & 0xFFFFFFFF).tolist(), strict=True) if k in at)
    if len({b for b, _ in m}) < p.min_seeds:
        return []
    pb, pa = (np.array(c) for c in zip(*m, strict=True))
    return substrings.align(x, y, pa, pb, p) if substrings.spans_enough(pb, pa, p) else []


def edited(passage, share, kinds, r):
    """The passage with a share of its words substituted (s), deleted (d) or with a word inserted before them (i)."""
    at, out = set(r.choice(len(passage), round(len(passage) * share), False).tolist()), []
    for i, w in enumerate(passage.tolist()):
        kind = kinds[r.integers(len(kinds))] if i in at else ""
        out += [int(r.integers(1, 2**62))] * (kind in ("s", "i")) + [w] * (kind not in ("s", "d"))
    return np.array(out, np.uint64)


@pytest.mark.parametrize("kinds", ["s", "sid"])
def test_fuzzy_passages_are_found(kinds):
    p, r = substrings.Passages(), np.random.default_rng(4)
    some = lambda n: r.integers(1, 2**62, n).astype(np.uint64)
    for share in (0.0, 0.05, 0.1, 0.15, 0.2):
        for n in (52, 60, 80):
            hits = tries = 0
            while tries < 60:
                said = some(n)
                copy = edited(said, share, kinds, r)
                path = alignment.between(said, copy)
                inner = slice(int(path[0].argmax()), len(path[0]) - int(path[0][::-1].argmax()))
                if min(path[1][inner].sum(), path[2][inner].sum()) < p.min_words or path[0].sum() < p.min_identity * len(path[0][inner]):
                    continue  # by the quadratic alignment, what stands between its first and last common word is no passage
                tries += 1
                got = seed_rows(np.concatenate((some(60), said, some(60))), np.concatenate((some(45), copy, some(70))), p)
                hits += any(min(x1, 60 + n) - max(x0, 60) >= 0.6 * n for x0, x1, *_ in got)
                assert all(same >= 0.8 * max(x1 - x0, y1 - y0) for x0, x1, y0, y1, same in got)
            assert hits >= 54, (share, n, hits)


@pytest.mark.parametrize("share", [0.0, 0.1])
@pytest.mark.parametrize("gap", [10, 20, 32, 40, 70])
def test_passages_of_one_chain_are_told_apart(share, gap):
    """Two passages with other words between them: both are found, and no word between them is in either."""
    p, r = substrings.Passages(), np.random.default_rng(gap)
    some = lambda n: r.integers(1, 2**62, n).astype(np.uint64)
    for _ in range(20):
        one, two = some(r.integers(55, 80)), some(r.integers(55, 80))
        x = np.concatenate((some(50), one, some(gap), two, some(50)))
        y = np.concatenate((some(40), edited(one, share, "s", r), some(gap + r.integers(-3, 4)), edited(two, share, "s", r), some(60)))
        covered = np.zeros(len(x), bool)
        for x0, x1, *_ in seed_rows(x, y, p):
            covered[x0:x1] = True
        a, b = 50 + len(one), 50 + len(one) + gap
        assert covered[50:a].mean() > 0.8 and covered[b : b + len(two)].mean() > 0.8
        assert covered.sum() == covered[50:a].sum() + covered[b : b + len(two)].sum()


def test_short_parts_around_an_insertion_are_one_passage():
    p, r = substrings.Passages(), np.random.default_rng(3)
    some = lambda n: r.integers(1, 2**62, n).astype(np.uint64)
    one, two = some(40), some(40)
    x = np.concatenate((some(50), one, two, some(50)))
    y = np.concatenate((some(50), one, some(12), two, some(50)))
    assert seed_rows(x, y, p) == [(50, 130, 50, 142, 80)]


def test_alignment_equals_a_plain_table():
    r = np.random.default_rng(8)
    for _ in range(60):
        x, y = (r.integers(0, 4, r.integers(0, 9)) for _ in range(2))
        t = [[-(i + j) if not i or not j else 0 for j in range(len(y) + 1)] for i in range(len(x) + 1)]
        for i in range(1, len(x) + 1):
            for j in range(1, len(y) + 1):
                t[i][j] = max(t[i - 1][j - 1] + (1 if x[i - 1] == y[j - 1] else -1), t[i - 1][j] - 1, t[i][j - 1] - 1)
        got = alignment.table(x, y, 1)
        assert got.tolist() == t
        ok, da, db = alignment.traced(got, x, y, len(x), len(y), 1)
        assert da.sum() == len(x) and db.sum() == len(y) and 2 * ok.sum() - len(ok) == t[-1][-1]


def test_longest_stretches_equal_brute_force():
    r = np.random.default_rng(9)
    for _ in range(200):
        ok = r.random(r.integers(1, 40)) < 0.75
        best = max((z - a for a in range(len(ok)) for z in range(a + 1, len(ok) + 1) if ok[a:z].sum() >= 0.8 * (z - a) - 1e-9), default=0)
        a, z = alignment.longest(ok, 0.8)
        assert z - a == best and (z == a or ok[a:z].sum() >= 0.8 * (z - a) - 1e-9)


def test_cuts_keep_the_words_between_passages(spark):
    r, rows, between = random.Random(41), [], []
    for _ in range(20):
        one, two = words(55, r), words(55, r)
        for _ in range(2):
            between.append(words(32, r))
            rows.append((len(rows), " ".join(words(20, r) + one + between[-1] + two + words(20, r)), None, None, None))
    df = spark.createDataFrame(rows, SCHEMA)
    assert substrings.passages(df).count() == 40
    left = {x.doc_id: x.text for x in substrings.without_repeats(df).collect()}
    assert sum(len(t.split()) for t in left.values()) == 40 * 182 - 20 * 110
    assert all(" ".join(w) in left[i] for i, w in enumerate(between))


def test_texts_meet_on_a_passage_of_frequent_lines(spark):
    r, rows, pairs = random.Random(8), [], []
    for lines, length in [(2, 30)] * 8 + [(3, 20)] * 8 + [(3, 25)] * 8:
        said = [words(length, r) for _ in range(lines)]
        for _ in range(2):
            rows.append((len(rows), " ".join(words(30, r) + sum(said, []) + words(30, r))))
        pairs.append((len(rows) - 2, len(rows) - 1))
        for line in said:
            rows += [(len(rows) + j, " ".join(words(30, r) + line + words(30, r))) for j in range(50)]
    got = {tuple(sorted((x.doc_id, x.match_doc_id))) for x in substrings.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == set(pairs)


def test_texts_meet_on_a_passage_of_which_each_phrase_is_frequent(spark):
    """60 words with one in seven changed; each phrase of eight of them stands in 25 other texts, alone."""
    r, rows, pairs = random.Random(61), [], []
    for _ in range(8):
        said = words(60, r)
        other = [f"x{i}" if i % 7 == 6 else w for i, w in enumerate(said)]
        for w in (said, other):
            rows.append((len(rows), " ".join(words(30, r) + w + words(30, r))))
        pairs.append((len(rows) - 2, len(rows) - 1))
        for at in range(0, 56, 4):
            rows += [(len(rows) + j, " ".join(words(40, r) + said[at : at + 8] + words(40, r))) for j in range(25)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {tuple(sorted((x.doc_id, x.match_doc_id))) for x in substrings.passages(df).collect()} == set(pairs)
    blocks = substrings.Passages(all_pairs=2)
    assert {tuple(sorted((x.doc_id, x.match_doc_id))) for x in substrings.passages(df, blocks).collect()} == set(pairs)


def test_overlapping_sets_equal_brute_force():
    r = np.random.default_rng(5)
    for both in (False, True):
        sets = [np.unique(r.integers(0, 60, r.integers(0, 40))).astype(np.uint16) for _ in range(70)]
        label, block = r.integers(0, 12, 70) // 3, r.integers(0, 2, 70)
        want = {(i, j) for i in range(70) for j in range(i) if label[i] != label[j] and not (both and block[i] == block[j]) and len(np.intersect1d(sets[i], sets[j])) >= 12}
        got = [(max(i, j), min(i, j)) for a, b in substrings.overlapping(sets, label, block, both, 12, step=900) for i, j in zip(a.tolist(), b.tolist(), strict=True)]
        assert len(got) == len(set(got)) and set(got) == want and want



def surrounded(r, left, middle, right):
    """Surroundings with a seed in the middle of left and right words; the seed is the first four of middle."""
    words = np.concatenate((r.integers(1 << 60, 1 << 63, left), middle, r.integers(1 << 60, 1 << 63, right))).astype(np.uint64)
    return substrings.surroundings_of(words, left, substrings.Passages())


def test_no_passage_is_ruled_out_by_its_surroundings():
    r, p, a, b = np.random.default_rng(5), substrings.Passages(), [], []
    for _ in range(400):
        n = int(r.integers(50, 100))
        x = r.integers(1 << 60, 1 << 63, n)
        y, wrong = list(x), 0
        while wrong < (n - 1) // 5:  # columns that disagree
            at, kind = int(r.integers(4, len(y))), r.integers(3)
            if kind == 0 and len(x) + wrong < n + wrong:
                y[at] = r.integers(1 << 60, 1 << 63)
            elif kind == 1 and len(y) > 50:
                del y[at]
            else:
                y[at] = r.integers(1 << 60, 1 << 63)
            wrong += 1
        a.append(surrounded(r, int(r.integers(0, 120)), x, int(r.integers(0, 120))))
        b.append(surrounded(r, int(r.integers(0, 120)), np.array(y), int(r.integers(0, 120))))
    a, b = np.array(a), np.array(b)
    assert substrings.may_agree(a, b, p)[0].all() and substrings.may_agree(b, a, p)[0].all()
    may, sure = substrings.may_agree(a, np.roll(b, 1, 0), p)
    assert not may.any() and not sure.any()


def test_repeated_word_and_family_meet_once():
    """A word 30 times in each of many texts is no passage; of a family of copies each member meets its first one. Before, all
    pairs of either met."""
    r, p, n = np.random.default_rng(6), substrings.Passages(), 60
    every = np.triu_indices(n, 1)
    pairs = lambda near: set(substrings.represented(iter([every]), near, p, step=100))
    assert not pairs(np.array([surrounded(r, 100, np.full(30, 1 << 62), 100) for _ in range(n)]))
    x = r.integers(1 << 60, 1 << 63, 60)
    family = np.array([surrounded(r, 100, x, 100) for _ in range(n)])
    assert pairs(family) == {(0, j) for j in range(1, n)}
    family[7] = surrounded(r, 100, np.concatenate((x[:30], r.integers(1 << 60, 1 << 63, 3), x[30:])), 100)
    assert pairs(family) == {(0, j) for j in range(1, n)}
    family[7] = surrounded(r, 100, np.concatenate((x[:20], x[22:40], x[43:])), 100)  # two gaps: meets all
    assert pairs(family) == {(0, j) for j in range(1, n)} | {(min(7, j), max(7, j)) for j in range(n) if j != 7}


def test_runs_of_one_word_meet_by_whole_passages_only():
    """A word 45 times is no passage of 50 words between other words, which no alignment crosses; before, all pairs met."""
    p, text = substrings.Passages(), lambda i, n: np.array([(900 + i) << 48] * 100 + [7 << 48] * n + [(500 + i) << 48] * 100, np.uint64)
    near = np.array([substrings.surroundings_of(text(i, n), 100, p) for i, n in enumerate([45] * 30 + [52, 60])])
    assert set(substrings.represented(iter([np.triu_indices(32, 1)]), near, p)) == {(30, 31)}


def test_occurrences_that_share_any_label_are_represented():
    r, p, n = np.random.default_rng(8), substrings.Passages(), 90
    x = r.integers(1 << 60, 1 << 63, 60)
    near = np.array([surrounded(r, 100, np.concatenate((x[:20], x[22:40], x[43:])) if i % 2 else x, 100) for i in range(n)])
    own = 1000 + np.arange(n)
    others = [[i % 3, 7 + i % 2] if i < n - 3 else [] for i in range(n)]
    labels = substrings.Labels(own, others)
    assert all(labels.share(i, j) == bool({*others[i], own[i]} & {*others[j], own[j]}) for i in range(n) for j in range(i))
    got = set(substrings.represented(iter([np.triu_indices(n, 1)]), near, p, labels))
    assert all(not {*others[i]} & {*others[j]} for i, j in got)
    texts = [{*others[i], own[i]} | {own[a] for a, b in got if b == i} for i in range(n)]
    assert all(texts[i] & texts[j] for i in range(n) for j in range(i)) and len(got) < n * n / 5


def test_family_of_copies_meets_by_what_it_shares(spark, monkeypatch):
    """copies of one text with words left out, put in and changed: 3,871 rows of the meeting step before, 741 now."""
    r, p, n, met = random.Random(20), substrings.Passages(all_pairs=2), 60, []
    new = lambda k: [f"w{r.randrange(10**9)}" for _ in range(k)]
    said, rows = new(150), []
    for i in range(n):
        copy = []
        for w in said:
            c = r.random()
            copy += [] if c < 0.03 else [w, *new(1)] if c < 0.06 else new(1) if c < 0.1 else [w]
        rows.append((i, " ".join(copy)))
    kept = substrings._meetings
    monkeypatch.setattr(substrings, "_meetings", lambda *a: met.append(kept(*a)) or met[0])
    got = substrings.passages(spark.createDataFrame(rows, "doc_id long, text string"), p).collect()
    near = {i: {i} for i in range(n)}
    for x in got:
        near[x.doc_id].add(x.match_doc_id)
    assert all(near[i] & near[j] for i in range(n) for j in range(i))
    assert met[0].count() < 1500


def test_pairs_of_one_text_are_aligned_in_many_tasks(spark):
    """of pairs that are met or aligned again, those of one text were one task."""
    said = words(60, random.Random(21))
    texts = spark.createDataFrame([(i, " ".join(words(20, random.Random(i)) + said)) for i in range(40)], "th long, text string").coalesce(1)
    pairs = spark.range(39).coalesce(1).selectExpr("id as a", "39L as b", "array(20, 70) as pa", "array(20, 70) as pb").withColumns({c: F.col(c).cast("array<int>") for c in ("pa", "pb")})
    found = [substrings._aligned(pairs, texts, substrings.Passages(), None, deal) for deal in (False, True)]
    assert sorted(map(tuple, found[0].collect())) == sorted(map(tuple, found[1].collect())) and found[1].count() == 39
    most = [max(map(len, x.rdd.glom().collect())) for x in found]
    assert most[0] == 39 > most[1] and found[1].rdd.getNumPartitions() == 4


def test_decoys_of_30_words_hide_no_passage_of_100(spark):
    r = random.Random(11)
    said, rows = words(100, r), []
    for i in range(2):
        rows.append((i, " ".join(words(30, r) + said + words(30, r))))
    for at in range(0, 80, 10):
        rows += [(len(rows) + j, " ".join(words(30, r) + said[at : at + 30] + words(30, r))) for j in range(20)]
    got = substrings.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {tuple(sorted((x.doc_id, x.match_doc_id))) for x in got} == {(0, 1)}
    assert all(x.end - x.start == 100 and x.same == 100 for x in got)


def test_every_text_of_a_passage_has_a_row(spark):
    """Against brute force over all pairs: each text but one of those that share 50 words or more is reported, at all those words."""
    r, rows = random.Random(12), []
    for size, n in ((50, 5), (51, 2), (64, 9), (120, 3), (400, 4)):
        said = words(size, r)
        for _ in range(n):
            rows.append((len(rows), words(r.randrange(5, 60), r) + said + words(r.randrange(5, 60), r)))
    rows.append((len(rows), rows[0][1][:70] + rows[-1][1][20:300]))
    shared = {}
    for i, x in rows:
        for j, y in rows:
            if i != j:
                at = {tuple(y[b : b + 50]) for b in range(len(y) - 49)}
                for a in range(len(x) - 49):
                    if tuple(x[a : a + 50]) in at:
                        shared.setdefault(tuple(x[a : a + 50]), set()).update({(i, a), (j, None)})
    got = substrings.passages(spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")).collect()
    inside = lambda i, a: any(x.doc_id == i and x.start <= a and a + 50 <= x.end for x in got)
    for window, places in shared.items():
        texts = {i for i, _ in places}
        missed = [i for i in texts if not any(inside(i, a) for k, a in places if k == i and a is not None)]
        assert len(missed) <= 1, (window[:3], texts, missed)
    assert all(x.same >= 0.8 * (x.end - x.start) for x in got)


def test_alignments_go_beyond_their_reach(spark):
    r = random.Random(13)
    said = words(600, r)
    rows = [(i, " ".join(words(20, r) + said + words(20, r))) for i in range(2)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sparse = {"share": 0.0, "window": 150, "long": (), "max_gap": 400}
    got = [sorted((x.doc_id, x.start, x.end, x.match_start, x.match_end, x.same) for x in substrings.passages(df, substrings.Passages(reach=n, **sparse)).collect()) for n in (3, 10**6)]
    assert got[0] == got[1] and got[0][0][-1] >= 600


def test_minimisers_leave_no_window_empty():
    r = np.random.default_rng(1)
    for n in (1, 5, 16, 17, 200):
        h = r.integers(0, 2**63, n).astype(np.uint64)
        at = substrings.minimisers(h, 16)
        assert all(((at >= i) & (at < i + 16)).any() for i in range(max(1, n - 15)))


# 4. chat formatting


def test_windows_round_trip(spark):
    r = random.Random(3)
    rows = []
    for c in range(12):
        for t in range(r.randint(1, 40)):
            role = "system" if t == 0 and c % 2 else ["user", "assistant"][t % 2]
            rows.append((c, t, role, r.choice([None, "", r"\### x: </turn> \\", " ".join(words(r.randint(1, 90))), "<<##\n"])))
    rows += [(None, 1, "user", "a"), (None, None, None, None), (3, 1, "user", "same turn"), (3, 1, "user", "same turn")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("window", F.lit(1))
    budget = WindowBudget(tokens=200, history=40)
    w = format_windows(df, budget)
    key = lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or 0, x[2] or "", x[3] or "")
    want = [(c, role or "", text or "") for c, _, role, text in sorted(rows, key=key)]
    back = sorted(((x.conv_id, x.seq, x.role, x.text) for x in read_back(w).collect()), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    assert [(c, role, text) for c, _, role, text in back] == want
    for x in w.collect():
        fresh = [t for t in x.turns if not t.repeated]
        assert x.n_tokens <= budget.tokens or len(fresh) == 1
        assert all(not t.loss for t in x.turns if t.repeated)
        assert re.sub(r"\\.", "", x.formatted, flags=re.S).count("</turn>") == len(x.turns)
    said = {c: "".join(t for k, role, t in want if k == c and role == "assistant") for c in range(12)}
    for x in digests(w).collect():
        if x.conv_id in said:
            assert x.loss_sha256 == hashlib.sha256(said[x.conv_id].encode()).hexdigest() and x.loss_chars == len(said[x.conv_id])
    assert format_windows(df.limit(0)).count() == 0


# 5. n-gram Jaccard join


def shingle_set(text):
    w = WORD.findall((text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_components(rows):
    sets = [(i, shingle_set(t)) for i, t in rows]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x in range(len(sets)):
        for y in range(x):
            a, b = sets[x][1], sets[y][1]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                parent[find(x)] = find(y)
    low = {}
    for x, (i, _) in enumerate(sets):
        low[find(x)] = min([k for k in (low.get(find(x)), i) if k is not None], default=None)
    key = lambda r: (r[0] is not None, r[0] or 0, r[1])
    return sorted(((i, len(s), low[find(x)]) for x, (i, s) in enumerate(sets)), key=key)


@pytest.mark.parametrize("join", [jaccard.JaccardJoin(), jaccard.JaccardJoin(order_sample=1.0, leaf=2, fanout=2, block_rows=4, first_blocks=1), jaccard.JaccardJoin(order_sample=0.0, block_shingles=300)])
def test_links_equal_brute_force(spark, corpus, odd, none, join):
    rows = [(r[0], r[1]) for r in corpus[0]] + [(500 + r[0] if r[0] is not None else None, r[1]) for r in awkward()]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, c string")
    got = sorted(((x.doc_id, x.n_shingles, x.component_id) for x in linked_components(df, join).collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert got == brute_components(rows)
    if join.first_blocks == 3 and join.block_shingles > 300:
        assert linked_components(none, join).count() == 0
        kept = one_of_each(odd)
        assert kept.columns == odd.columns
        assert sorted(x.doc_id for x in kept.collect()) == [0, 1, 2, 3, 4, 5, 8, 9, 10, 11]


def test_signature_tree_loses_no_pair():
    r = np.random.default_rng(0)
    n = 200
    tokens = [r.choice(4000, r.integers(20, 60), False) for _ in range(n // 2)]
    tokens += [np.concatenate((t[2:], r.choice(4000, 2))) for t in tokens]
    bits = np.zeros((n, 4), np.uint64)
    for i, t in enumerate(tokens):
        for x in t:
            bits[i, (x % 256) >> 6] |= np.uint64(1) << np.uint64(x % 64)
    size = np.array([len(set(t.tolist())) for t in tokens])
    order = np.argsort(size, kind="stable")
    tree = jaccard.SignatureTree(size[order], bits[order], order, 4, 3)
    found = {tuple(sorted((order[a], order[b]))) for a, b in zip(*tree.pairs(80), strict=True)}
    for a in range(n):
        for b in range(a):
            x, y = set(tokens[a].tolist()), set(tokens[b].tolist())
            if 100 * len(x & y) >= 80 * len(x | y):
                assert (b, a) in found


def test_block_search_links_what_brute_force_links():
    r = np.random.default_rng(3)
    base = [r.integers(0, 2**63, int(n), np.int64) for n in (30, 200, 205, 250, 900, 4000)]
    sets = [np.unique(np.concatenate((b[int(len(b) * cut) :], r.integers(0, 2**63, int(len(b) * new), np.int64)))) for b in base for cut in (0, 0.03, 0.08, 0.2) for new in (0, 0.05, 0.2)]
    n, comp, block = np.array([len(s) for s in sets]), np.arange(len(sets)), np.zeros(len(sets), np.int64)
    order = np.argsort(n, kind="stable")
    sets, n = [sets[i] for i in order], n[order]
    links = {(a, b) for b in range(len(sets)) for a in range(b) if 100 * len(np.intersect1d(sets[a], sets[b])) >= 80 * len(np.union1d(sets[a], sets[b]))}
    for join in (jaccard.JaccardJoin(), jaccard.JaccardJoin(leaf=3, fanout=2)):
        x, y, likely = jaccard.candidates(block, n, [jaccard._bitmap(s.astype(np.uint64)) for s in sets], comp, join)
        assert links <= set(zip(x.tolist(), y.tolist(), strict=True))
        found = jaccard.forest(x, y, likely, comp, sets, 80)
        assert set(found) <= links and len(found) < len(sets)
        reach = lambda edges: functools.reduce(lambda g, e: [g[e[0]] if h == g[e[1]] else h for h in g], edges, list(range(len(sets))))
        groups = lambda g: sorted(tuple(i for i, h in enumerate(g) if h == k) for k in set(g))
        assert groups(reach(found)) == groups(reach(sorted(links)))


def test_large_group_of_copies_gives_few_links(spark):
    r = random.Random(8)
    base = words(120, r)
    rows = []
    for i in range(300):  # each copy links with the first row, many not with each other
        w = list(base)
        for _ in range(2 if i else 0):
            w[r.randrange(120)] = f"new{i}"
        rows.append((i, " ".join(w)))
    join = jaccard.JaccardJoin(block_rows=16)
    got = sorted((x.doc_id, x.n_shingles, x.component_id) for x in linked_components(spark.createDataFrame(rows, "doc_id long, text string"), join).collect())
    assert got == brute_components(rows)


AWKWARD_NAMES = sorted(set("""k h c n t th size gone kept _h w0 w1 _at _total _src target position taken full extra _size _text _epoch spans copy c_id
    c_th g_id g_th _th stays times row new stage _u _b _full _extra source_size doc base_failed words_left cleaned once comp least low v component""".split()))  # fmt: skip


def test_one_of_each_with_null_and_repeated_ids(spark):
    a, b, near = words(80), words(80), None
    near = a[:-1] + ["other"]
    rows = [(None, " ".join(a)), (None, " ".join(near)), (None, " ".join(b)), (7, " ".join(b)), (7, " ".join(words(60))), (8, None), (8, None), (9, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").select("*", *[F.lit(f"has {c}").alias(c) for c in AWKWARD_NAMES])
    got = one_of_each(df)
    assert got.columns == df.columns
    left = got.collect()
    assert all(x[c] == f"has {c}" for x in left for c in AWKWARD_NAMES)
    assert sorted((x.doc_id is None, x.doc_id or 0, (x.text or "")[-5:] == "other") for x in left)[:5] == [(False, 7, False), (False, 7, False), (False, 8, False), (False, 8, False), (False, 9, False)]
    assert sum(x.doc_id is None for x in left) == 1 and {x.text for x in left if x.doc_id == 7} == {rows[3][1], rows[4][1]}


def test_components_of_a_long_chain(spark):
    r = random.Random(1)
    ids = [r.randrange(2**60) for _ in range(300)]
    edges = [(ids[i], ids[i + 1]) for i in range(299) if i != 150]
    got = {x.v: x.component for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in ids[:151]} == {min(ids[:151])} and {got[i] for i in ids[151:]} == {min(ids[151:])}


# 6. mixing


def test_mix_reaches_its_targets(spark, corpus, odd, none):
    for df in (spark.createDataFrame(corpus[0], SCHEMA), odd):
        p = plan_mix(df).collect()
        assert len(p) == df.count()
        by = {}
        for x in p:
            by.setdefault((x.source_size, x.target), []).append(x)
            assert 0 <= x.taken <= 2 * x.size and (x.position is None or 0 <= x.position <= 1)
        total, share = sum(x.size for x in p), 0.0
        for (size, target), rows in by.items():
            assert target <= 2 * size + 1e-6 and abs(sum(x.taken for x in rows) - target) < 1 + 1e-6
            share += target
        assert share == pytest.approx(1.5 * total)
        mixed = mixed_documents(df)
        assert mixed.columns == df.columns
        got = sum(len(WORD.findall(x.text or "")) for x in mixed.collect())
        assert got == sum(x.taken for x in p)
    assert plan_mix(none).count() == 0


def test_positions_invert_the_integrated_schedule(spark):
    """Against the integral of the rate by small steps, inverted by bisection."""
    from siftline.llm.mixing import when_consumed

    cases = [(w0, w1, share) for w0, w1 in ((1.5, 0.5), (1.0, 1.0), (0.5, 1.5), (0.0, 2.0), (2.0, 0.0)) for share in (0.0, 0.1, 0.5, 0.9, 1.0)]
    df = spark.createDataFrame(cases, "w0 double, w1 double, share double")
    got = [r[0] for r in df.select(when_consumed(F.col("share"), F.col("w0"), F.col("w1"))).collect()]
    steps = (np.arange(20000) + 0.5) / 20000
    for (w0, w1, share), t in zip(cases, got, strict=True):
        given = np.concatenate(([0], np.cumsum(w0 + (w1 - w0) * steps)))
        lo, hi = 0.0, 1.0
        for _ in range(40):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if np.interp(mid, np.linspace(0, 1, 20001), given / given[-1]) < share else (lo, mid)
        assert t == pytest.approx(lo, abs=2e-3), (w0, w1, share)


def test_water_filling_equals_repeated_resharing(spark):
    from siftline.llm.mixing import MixPlan, source_targets

    sizes = {f"s{i:02}": s for i, s in enumerate([1000, 3, 50, 700, 20, 5000, 1, 90])}
    df = spark.createDataFrame([(k, float(v)) for k, v in sizes.items()], "source string, source_size double")
    got = {r.source: r.target for r in source_targets(df, MixPlan()).collect()}
    weight = {k: (5, 2, 1)[i % 3] for i, k in enumerate(sizes)}
    target, left, live = dict.fromkeys(sizes, 0.0), 1.5 * sum(sizes.values()), set(sizes)
    while True:
        level = left / sum(weight[k] for k in live)
        over = {k for k in live if level * weight[k] > 2 * sizes[k]}
        if not over:
            target.update({k: level * weight[k] for k in live})
            break
        for k in over:
            target[k] = 2.0 * sizes[k]
            left -= target[k]
        live -= over
    assert got == pytest.approx(target)


# 7. packing


def test_packing_holds_every_token_once(spark, odd, none):
    got = packing.pack(odd).collect()
    by, bins = {}, {}
    for x in got:
        by.setdefault((x.doc_id), []).append(x)
        bins.setdefault(x.bin_id, []).append(x)
    want = Counter()
    for r in awkward():
        want[r[0]] += len(WORD.findall(r[1] or "")) + 1
    assert {k: sum(x.n_tokens for x in v) for k, v in by.items()} == want
    for v in bins.values():
        v.sort(key=lambda x: x.at)
        assert all(a.at + a.n_tokens == b.at for a, b in zip(v, v[1:])) and v[0].at == 0
        used = sum(x.n_tokens for x in v)
        assert used == v[0].used <= v[0].capacity == min(c for c in packing.Lengths().capacities if c >= used)
    assert packing.pack(none).count() == 0


def test_best_fit_takes_the_tightest_open_bin():
    bins, at, caps = packing.best_fit(np.array([90, 60, 40, 10, 50]), packing.Lengths((100, 200)))
    assert len(caps) == len(set(bins.tolist())) and sorted(caps.tolist()) == sorted(caps.tolist())
    for b in set(bins.tolist()):
        assert np.array([90, 60, 40, 10, 50])[bins == b].sum() <= caps[b]


# 8. neighbours


def test_lengths_cost_no_more_than_any_one_policy():
    lengths, r = packing.Lengths(), np.random.default_rng(6)
    caps = lengths.capacities

    def total(used):
        return sum(packing.cost(c, lengths.balance) for c in used)

    def first_opened(sizes, opened):  # best fit by hand: bins opened at `opened`, or at the smallest length of the piece
        bins = []
        for n in sorted(sizes.tolist(), reverse=True):
            fitting = [b for b in bins if b[0] >= n]
            b = min(fitting, key=lambda b: b[0], default=None)
            if b is None:
                bins.append(b := [next(c for c in caps if c >= max(n, opened)), 0])
            b[0], b[1] = b[0] - n, b[1] + n
        return total(next(c for c in caps if c >= b[1]) for b in bins)

    same = np.full(900, 300)
    assert total(packing.best_fit(same, lengths)[2]) < 0.7 * first_opened(same, caps[0])
    for sizes in (same, r.integers(1, 700, 400), np.minimum(8192, r.lognormal(6, 1.2, 400).astype(int) + 1), np.concatenate((same, r.integers(4000, 5000, 60)))):
        bins, _, got = packing.best_fit(sizes, lengths)
        assert (np.bincount(bins, sizes) <= got).all()
        assert all(total(got) <= first_opened(sizes, c) + 1e-6 for c in caps)


def test_neighbours_equal_brute_force(spark, none):
    r = np.random.default_rng(3)
    x = r.standard_normal((700, 8)).astype(np.float32)
    x[100:160] = x[100]
    rows = [(i, [float(v) for v in x[i]], 0) for i in range(700)] + [(1000, None, 0), (1020, [0.0] * 8, 0), (1040, [float("nan")] * 8, 0), (1060, [None] * 8, 0), (None, [1.0] * 8, 0), (40, [float(v) for v in x[40]], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    df = df.select("*", *[F.lit("x").alias(c) for c in ("dim", "cell", "sub", "kind", "q", "v", "rank", "floor")])
    search = neighbours.Search(k=20, shard_rows=50, leaf=16)
    got = {}
    for a in neighbours.nearest(df, F.pmod("vec_id", F.lit(20)) == 0, search).collect():
        got.setdefault(a.query_id, []).append((a.rank, a.vec_id))
    y = x.astype(np.float64)
    assert sorted(got) == list(range(0, 700, 20))
    for q, found in got.items():
        s = neighbours.scores(np.broadcast_to(y[q], y.shape), y)
        order = [i for i in np.lexsort((np.arange(700), -s)) if i != q][:20]
        assert [i for _, i in sorted(found)] == order
    small = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert neighbours.nearest(small, F.col("vec_id") == 0).count() == 0


def test_cells_leave_out_only_what_is_too_far(spark):
    r = np.random.default_rng(5)
    centres = 8 * r.standard_normal((12, 6))
    x = np.concatenate([c + 0.3 * r.standard_normal((100, 6)) for c in centres])
    df = spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in range(len(x))], "vec_id long, embedding array<double>")
    exact, want = neighbours.nearest(df, F.pmod("vec_id", F.lit(20)) == 0, neighbours.Search(shard_rows=100, leaf=16)).collect(), set()
    for q in range(0, len(x), 20):
        s = neighbours.scores(np.broadcast_to(x[q], x.shape), x)
        want |= {(q, int(i)) for i in [i for i in np.lexsort((np.arange(len(x)), -s)) if i != q][:20]}
    assert {(a.query_id, a.vec_id) for a in exact} == want
    loose = neighbours.nearest(df, F.pmod("vec_id", F.lit(20)) == 0, neighbours.Search(shard_rows=100, leaf=16, relax=1.02)).collect()
    assert len({(a.query_id, a.vec_id) for a in loose} & want) >= 0.9 * len(want)
    cells = neighbours.Cells(list(centres), float((x**2).sum(1).max()))
    d = cells.distances(x, False)
    for c in range(12):
        own = d.argmin(1) == c
        cells.sizes[6, c] = (float(d[own, c].max()), int(own.sum()))
    s = x[::20] @ x.T
    floor = np.partition(s, -21, 1)[:, -21]
    admitted = cells.admitted(x[::20], floor, 1.0)
    assert all(admitted[i, d[j].argmin()] for i in range(len(s)) for j in np.flatnonzero(s[i] >= floor[i])) and admitted.mean() < 0.9


def test_relaxed_search_keeps_most_neighbours():
    r = np.random.default_rng(4)
    x, q = r.standard_normal((2000, 6)), r.standard_normal((30, 6))
    tree = neighbours.VantageTree(x, float((x**2).sum(1).max()), 32)
    a, b = tree.search(q, 10, 1.0)
    c, d = tree.search(q, 10, 1.1)
    exact, loose = {(i, j) for i, j in zip(a, b)}, {(i, j) for i, j in zip(c, d)}
    assert len(exact & loose) >= 0.9 * len(exact)


# 9. sharding


def test_shards_are_near_equal(spark, odd, none):
    r = random.Random(8)
    rows = [(i, " ".join(words(r.randint(20, 200))), "en", f"s{0 if i % 3 else i % 7}", 0) for i in range(900)]
    got = kd_shards(spark.createDataFrame(rows, SCHEMA), 24).collect()
    assert len(got) == 900 and {x.shard for x in got} == set(range(24))
    size = Counter()
    for x in got:
        size[x.shard] += x.size
        assert x.size == len(rows[x.doc_id][1].encode()) + 8 and x.text_crc32 == zlib.crc32(rows[x.doc_id][1].encode())
    assert max(size.values()) < 1.15 * min(size.values())
    for s in range(24):
        assert sorted(x.slot for x in got if x.shard == s) == list(range(sum(x.shard == s for x in got)))
    assert kd_shards(odd, 3).count() == len(awkward()) and kd_shards(none, 4).count() == 0


# 10. language ID


def test_gradients_equal_differences():
    t = language.Training(hidden=3)
    m = language.ByteTagger.fresh(["a", "b"], t)
    m.w = {k: v.astype(np.float64) for k, v in m.w.items()}
    r = np.random.default_rng(0)
    x, y, mask = r.integers(0, 256, (6, 4)), r.integers(0, 2, (6, 4)), np.arange(6)[:, None] < [6, 6, 4, 3]
    g, _ = m.gradients(x, y, mask)
    for k in m.w:
        i = tuple(r.integers(0, s) for s in m.w[k].shape) if not k.startswith("e") else (x[2, 1], 1)
        keep = m.w[k][i]
        m.w[k][i] = keep + 1e-3
        up = m.gradients(x, y, mask)[1]
        m.w[k][i] = keep - 1e-3
        down = m.gradients(x, y, mask)[1]
        m.w[k][i] = keep
        assert g[k][i] == pytest.approx((up - down) / 2e-3, abs=2e-3)


def test_stretches_have_the_bytes_around_them():
    """With a margin as long as the text, the stretches are labelled as by one pass over the whole text, in plain loops."""
    t = language.Training(hidden=4, steps=10, margin=40)
    m = language.ByteTagger.fresh(["a", "b", "c"], t)
    raw = np.random.default_rng(1).integers(0, 256, 37 + 5).astype(np.uint8)
    got = m.pooled(raw, np.array([0, 37, 37, 42]))
    sig, n = lambda v: 1 / (1 + np.exp(-v)), 4
    for row, text in ((0, raw[:37]), (2, raw[37:])):
        states = {}
        for d, order in (("f", range(len(text))), ("b", reversed(range(len(text))))):
            h = np.zeros(n)
            for i in order:
                a, g = m.w[f"e{d}"][text[i]], h @ m.w[f"u{d}"]
                z, r = sig(a[:n] + g[:n]), sig(a[n : 2 * n] + g[n : 2 * n])
                c = np.tanh(a[2 * n :] + r * g[2 * n :])
                states[d, i] = h = c + z * (h - c)
        s = np.array([states["f", i] @ m.w["of"] + states["b", i] @ m.w["ob"] + m.w["c"] for i in range(len(text))])
        p = np.exp(s) / np.exp(s).sum(1, keepdims=True)
        assert got[row] == pytest.approx(p.mean(0), abs=1e-4)
    assert got[1].sum() == 0


def test_language_is_told_on_held_out_documents(spark, odd, none):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0
    model = language.train(df.where(~held).select("text", "lang"), language.Training(rounds=150, docs_per_label=80))
    got = language.identify(df.where(held).select("doc_id", "text"), model).join(df.select("doc_id", "lang"), "doc_id").collect()
    assert sum(x.lang == x.lang_pred for x in got) >= 0.95 * len(got) and all(0 <= x.score <= 1 for x in got)
    odd_rows = language.identify(odd, model).collect()
    assert len(odd_rows) == len(awkward()) and {x.doc_id for x in odd_rows if x.lang_pred == "und"} == {0, 1, 2}
    assert language.identify(none, model).count() == 0 and language.train(none) is None


# pipeline


def test_stages_leave_columns_of_any_name_alone(spark, corpus):
    rows = [r[:5] for r in corpus[0]][:150] + awkward() + [(None, "\n".join(" ".join(words(30)) for _ in range(3)), "en", None, 7)]
    plain = spark.createDataFrame(rows, SCHEMA)
    odd = plain.select("*", *[F.concat(F.lit(f"{c} "), F.coalesce("source", F.lit("none"))).alias(c) for c in AWKWARD_NAMES])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got, want = stage(spark, odd, ""), stage(spark, plain, "")
        assert got.columns == odd.columns and got.dtypes[:5] == plain.dtypes, name
        got = got.collect()
        assert all(x[c] == f"{c} {x.source or 'none'}" for x in got for c in AWKWARD_NAMES), name
        assert Counter(tuple(x)[:5] for x in got) == Counter(map(tuple, want.collect())), name
    assert corpus_pipeline.STAGES[-1][1](spark, odd, "").count() == corpus_pipeline.STAGES[-1][1](spark, plain, "").count()


def test_pipeline_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, before = docs.columns, {r.doc_id for r in docs.collect()}
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(corpus_pipeline.STAGES) - 1:
            docs = corpus_pipeline.materialize(docs)
            assert docs.columns == columns
            ids = {r.doc_id for r in docs.collect()}
            assert ids <= before and len(ids) >= 0.75 * len(before)
            before = ids
    assert docs.count() > 0
    comp = brute_components([(r.doc_id, r.text) for r in corpus_pipeline.quality_rules(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), sf_dir).collect()])
    assert len({c for _, n, c in comp if n}) == one_of_each(corpus_pipeline.quality_rules(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), sf_dir)).where("text is not null").count()


def test_model_counts_nothing_without_training(spark):
    df = spark.createDataFrame([(1, "a b", None, None, 0)], SCHEMA)
    m = mixing_model.MixModel(classes=2, slot_bits=12, dictionary=10)
    r = mixing_model.score(df, F.lit(False), m).first()
    assert (r.n_tokens, r.n_known, r.train_tokens) == (3, 0, 0)


def test_empty_tables_score_and_pack_to_nothing(spark, none, odd):
    held = F.pmod(F.col("doc_id"), F.lit(3)) == 0
    assert mixing_model.score(none, held).count() == 0
    small = mixing_model.MixModel(classes=2)
    assert mixing_model.score(odd, held, small).count() == len(awkward())
    assert one_of_each(none).count() == 0 and mixed_documents(none).count() == 0 and packing.pack(none).count() == 0
