import math
import random

from siftline.operators import bm25, setjoin


def sets(r, n, words=60):
    rows = []
    for i in range(n):
        base = rows[r.randrange(len(rows))][2] if rows and r.random() < 0.4 else None
        tokens = [w for w in base if r.random() < 0.9] if base else []
        tokens += [f"w{int(r.paretovariate(0.7)) % words}" for _ in range(r.randint(0, 12))]
        rows.append((i, "st"[i % 2], tokens))
    return rows


def test_jaccard_pairs_equal_all_pairs_and_few_are_tried(spark):
    rows = sets(random.Random(2), 300)
    df = spark.createDataFrame(rows, "doc_id long, source string, tokens array<string>")
    for limit in (0.3, 0.5, 0.8):
        want = {}
        for a, s, x in rows:
            for b, t, y in rows:
                if a < b and s == t and (x or y):
                    j = round(len({*x} & {*y}) / len({*x} | {*y}), 6)
                    if j > limit:
                        want[a, b] = j
        assert {(r.doc_a, r.doc_b): r.j for r in setjoin.jaccard(df, limit, "source").collect()} == want
    tried = setjoin.jaccard_candidates(setjoin.ordered(df, ["doc_id", "source"]), 0.5, "source").count()
    assert tried < 10 * sum(1 for _ in setjoin.jaccard(df, 0.5, "source").collect())


def test_best_containers_equal_all_pairs(spark):
    r = random.Random(4)
    docs = [(i, tokens) for i, _, tokens in sets(r, 200)]
    asked = [(i, r.sample(docs[r.randrange(200)][1] or ["none"], 1) * 2 + [f"w{r.randrange(60)}" for _ in range(r.randint(0, 9))]) for i in range(40)] + [(90, []), (91, ["unknown"])]
    want = {}
    for i, q in asked:
        q = {*q}
        found = {d: len(q & {*x}) for d, x in docs if q & {*x}}
        if found:
            most = max(found.values())
            want |= {(i, d): round(most / len(q), 6) for d, n in found.items() if n == most}
    got = setjoin.best_containers(spark.createDataFrame(asked, "item_id long, tokens array<string>"), spark.createDataFrame(docs, "doc_id long, tokens array<string>"))
    assert {(x.item_id, x.doc_id): x.score for x in got.collect()} == want


def test_top_scores_equal_all_scores(spark):
    r = random.Random(6)
    docs = [(i, [f"w{int(r.paretovariate(0.5))}" for _ in range(r.randint(0, 80))]) for i in range(400)]
    asked = [(i, r.sample(docs[r.randrange(400)][1] + ["unknown"], 1) + [f"w{int(r.paretovariate(0.5))}" for _ in range(r.randint(0, 15))]) for i in range(30)]
    q, d = spark.createDataFrame(asked, "item_id long, tokens array<string>"), spark.createDataFrame(docs, "doc_id long, tokens array<string>")
    every = {}
    for x in bm25.scores(q, d).collect():
        every.setdefault(x.item_id, []).append((-x.score, x.doc_id))
    for k, seeds, few in ((1, 5, 0), (3, 50, 0), (20, 2000, 0), (3, 50, 10**6)):
        got = {}
        for x in bm25.top_scores(q, d, k, seeds, few).collect():
            got.setdefault(x.item_id, []).append((-x.score, x.doc_id))
        for i, found in every.items():
            last = sorted(found)[: k][-1][0]
            assert sorted(got[i]) == [(s, n) for s, n in sorted(found) if s <= last + 1e-12]
        assert set(got) == set(every)


def test_term_bounds_hold(spark):
    r = random.Random(7)
    docs = [(i, [f"w{int(r.paretovariate(0.8))}" for _ in range(r.randint(1, 40))]) for i in range(100)]
    held = bm25.index(spark.createDataFrame(docs, "doc_id long, tokens array<string>"))
    rows = held.postings.join(held.terms, "token").collect()
    for x in rows:
        part = x.idf * x.tf * (bm25.K1 + 1) / (x.tf + bm25.K1 * (1 - bm25.B + bm25.B * x.dl / x.avgdl))
        assert part <= x.bound + 1e-12 and not math.isnan(x.bound)
