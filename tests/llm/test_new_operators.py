import hashlib
import math
import random
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import oracle
import pytest
from pyspark.sql import functions as F

pytest.importorskip("siftline.llm")
from siftline.llm import bands, compression, lloyd, queries

NEW = ["op11_plain_lloyd", "op12_band_join"]


@pytest.mark.parametrize("name", NEW)
def test_matches_sql(spark, sf_dir, name):
    oracle.check(spark, sf_dir, queries.QUERIES[name], queries.ORACLES[name])


# 11. centroid clustering


def brute_lloyd(rows, p):
    kept = [(i, [math.floor(Fraction(x) * p.scale) for x in v]) for i, v in rows if v is not None and len(v) == p.dims and all(x is not None and math.isfinite(x) for x in v)]
    name = lambda i: "~" if i is None else hashlib.sha256(f"{p.seed}:{i}".encode()).hexdigest()
    centroids = [v for _, v in sorted(kept, key=lambda r: (name(r[0]), r[1]))[: p.k]]
    away = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    own = lambda v: min(range(len(centroids)), key=lambda i: (away(v, centroids[i]), i))
    for _ in range(p.rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(own(v), []).append(v)
        centroids = [[sum(c) // len(c) for c in zip(*groups[i], strict=True)] if i in groups else c for i, c in enumerate(centroids)]
    found = [(i, own(v), away(v, centroids[own(v)])) for i, v in kept]
    inertia = Counter()
    for _, c, d in found:
        inertia[c] += d
    return Counter((i, c, d, inertia[c], sum(inertia.values()), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for i, c, d in found)


def vectors(spark, rows, kind="double"):
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")
    return df.select("*", *[F.lit("x").alias(c) for c in ("cluster", "distance", "d", "dim")])


def test_lloyd_equals_brute_force_on_awkward_vectors(spark):
    r, p = random.Random(1), lloyd.Lloyd(k=5, dims=3, rounds=6)
    rows = [(i, [r.uniform(-2, 2) for _ in range(3)]) for i in range(120)]
    rows += [(200, None), (201, [1.0, 2.0]), (202, [1.0, None, 2.0]), (203, [1.0, float("nan"), 2.0]), (204, [1.0, float("inf"), 2.0]), (205, []), (206, [0.0, 0.0, 0.0])]
    rows += [rows[3], rows[3], (None, [0.5, 0.5, 0.5]), (None, [0.1, 0.2, 0.3])]
    for parts in (1, 7):
        got = lloyd.clusters(vectors(spark, rows).repartition(parts), p)
        assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
        assert Counter(tuple(x) for x in got.collect()) == brute_lloyd(rows, p)


def test_lloyd_on_large_components_fewer_vectors_than_centroids_and_ties(spark):
    p = lloyd.Lloyd(k=4, dims=2, rounds=3)
    big = [(i, [1e6 * i, -3e6 + i]) for i in range(1, 9)]
    assert Counter(tuple(x) for x in lloyd.clusters(vectors(spark, big), p).collect()) == brute_lloyd(big, p)
    few = [(1, [1.0, 2.0]), (2, [1.0, 2.0])]
    got = lloyd.clusters(vectors(spark, few), p).collect()
    assert {(x.vec_id, x.cluster, x.distance) for x in got} == {(1, 0, 0), (2, 0, 0)}
    assert lloyd.clusters(vectors(spark, []), p).count() == 0
    huge = lloyd.clusters(vectors(spark, [(1, [1e300, 0.0]), (2, [-1e300, 0.0]), (3, [0.0, 0.0])]), lloyd.Lloyd(k=1, dims=2, rounds=2)).collect()
    assert len(huge) == 3 and max(x.distance for x in huge) == 2**63 - 1


# 12. numeric band join


def brute_bands(lines, items, top=5):
    cents = lambda x: None if x is None or not abs(x) < 1e13 else math.floor(100 * x + 0.5)
    usable = []
    for sale, no, item, q, amount in lines:
        if None not in (sale, item, q) and q and cents(amount) is not None:
            usable.append(((2 * cents(amount) + q) // (2 * q), sale, no, item))
    out = Counter()
    for item, price in items:
        p, found = cents(price), []
        for u, sale, no, of in usable:
            if p is not None and item is not None and of != item and (abs(u - p) <= 10 or 1000 * abs(u - p) <= 2 * p):
                found.append((abs(u - p), u, sale, no, of))
        found.sort(key=lambda x: (*x[:3], x[3] is None, x[3] or 0, x[4]))
        sums = len(found), sum(x[0] for x in found), sum(zlib.crc32(f"{s},{'' if n is None else n},{i}".encode()) for _, _, s, n, i in found)
        for rank, x in enumerate(found[:top], 1):
            out[(item, rank, *x, *sums)] += 1
        if not found:
            out[(item, 0, None, None, None, None, None, 0, 0, 0)] += 1
    return out


LINES, ITEMS = "sale_id long, line_no int, item_id long, quantity int, amount double", "item_id long, price double"


def band_rows(spark, lines, items, b=bands.Band()):
    clash = [F.lit("x").alias(c) for c in ("u", "p", "lo", "rank", "shard", "n")]
    got = bands.near_prices(spark.createDataFrame(lines, LINES).repartition(3).select("*", *clash), spark.createDataFrame(items, ITEMS).select("*", *clash), b)
    assert got.columns == ["item_id", "rank", "gap", "u", "sale_id", "line_no", "line_item_id", "n_pairs", "gap_sum", "lines_crc"]
    return Counter(tuple(x) for x in got.collect())


def test_bands_equal_brute_force_on_awkward_rows(spark):
    r = random.Random(3)
    price = lambda: round(r.choice([r.uniform(0, 2), r.uniform(9, 11), r.uniform(900, 1100), r.uniform(12_000, 14_000)]), 2)
    items = [(i, price()) for i in range(60)] + [(7, 10.0), (None, 10.0), (61, None), (62, float("nan")), (63, -0.05), (64, 1e300), (65, 10.0), (65, 10.0)]
    lines = []
    for k in range(1500):
        q = r.choice([1, 1, 2, 3, 7, -2, 0])
        lines.append((r.randrange(80), r.choice([1, 2, 3, None]), r.randrange(60) if r.random() < 0.7 else 7, q, round(q * price() + r.choice([0, 0.01, 0.004]), 3)))
    lines += lines[:40] + [(None, 1, 1, 1, 10.0), (1, 1, None, 1, 10.0), (1, 1, 1, None, 10.0), (1, 1, 1, 1, None), (1, 1, 1, 1, float("inf")), (1, 1, 1, 1, 1e300)]
    want = brute_bands(lines, items)
    assert band_rows(spark, lines, items) == want
    assert band_rows(spark, lines, items, bands.Band(narrow=2, wide=3, chunk=50)) == want  # bands over many shards


def test_hot_item_and_hot_price_leave_five_others(spark):
    lines = [(i, 1, 7, 1, 10.0) for i in range(400)] + [(900 + i, 1, 8, 1, 10.0) for i in range(7)] + [(800, 2, 9, 2, 20.2)]
    items = [(7, 10.0), (8, 10.0), (9, 10.0), (10, 10.05)]
    assert band_rows(spark, lines, items) == brute_bands(lines, items)
    assert band_rows(spark, [], items) == brute_bands([], items) and not band_rows(spark, lines, [])


def test_segment_tree_queries_equal_sums(spark):
    r = random.Random(5)
    for n in (1, 2, 3, 8, 33):
        us = sorted(r.sample(range(-50, 100), n))
        lines = [sorted((r.randrange(9), 1, r.randrange(3)) for _ in range(r.randint(1, 6))) for _ in us]
        capped = []
        for rows in lines:
            of, keep = Counter(), []
            for x in rows:
                if of[x[2]] < 2:
                    of[x[2]] += 1
                    keep.append(x)
            capped.append(keep[:4])
        tree = bands.SegmentTree(us, [len(x) for x in lines], [sum(s for s, _, _ in x) for x in lines], capped, 2)
        for _ in range(40):
            lo, hi = sorted(r.randrange(-60, 110) for _ in range(2))
            inside = [(u, *x) for u, rows in zip(us, lines, strict=True) for x in rows if lo <= u < hi]
            for up in (True, False):
                count, s, c, first = tree.query(lo, hi, up)
                assert (count, s, c) == (len(inside), sum(x[0] for x in inside), sum(x[1] for x in inside))
                for out in range(3):
                    order = sorted((x for x in inside if x[3] != out), key=lambda x: (x[0] if up else -x[0], *x[1:]))
                    assert [x for x in first if x[3] != out][:2] == order[:2]


def test_shards_of_a_band_hold_all_its_prices(spark):
    b = bands.Band(narrow=3, wide=6)
    r = random.Random(6)
    rows = [(lo, lo + r.randrange(60)) for lo in [r.randrange(-40, 200) for _ in range(100)] + [2**k - 20 for k in range(5, 16)]]
    df = spark.createDataFrame(rows, "lo long, hi long").withColumn("s", bands.shards_between(F.col("lo"), F.col("hi"), b))
    got = df.withColumn("u", F.explode(F.sequence("lo", "hi"))).groupBy("lo", "hi", "s").agg(F.collect_set(bands.shard_of(F.col("u"), b)).alias("want"))
    assert all(sorted(x.s) == sorted(x.want) for x in got.collect())


# 13. quality classifier


@pytest.fixture(scope="module")
def labelled(spark):
    r = random.Random(7)
    said = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(400)]
    good = lambda: " ".join(r.choice(said) for _ in range(r.randint(20, 200)))
    bad = lambda: " ".join(r.choice(said).upper() + "!!" for _ in range(r.randint(20, 200)))
    rows = [(i, good() if i % 4 else bad(), int(i % 4 > 0)) for i in range(600)]
    return spark.createDataFrame([x[:2] for x in rows], "doc_id long, text string"), spark.createDataFrame([(x[0], x[2]) for x in rows], "doc_id long, label int")


def test_compressed_sizes_tell_good_from_bad_on_texts_not_seen(spark, labelled):
    docs, labels = labelled
    model = compression.train(docs.where("doc_id < 400"), labels)
    assert 0.7 < model.share < 0.8
    got = compression.score(docs.where("doc_id >= 400"), model).join(labels, "doc_id").collect()
    assert len(got) == 200 and sum((x.score >= 0.7) == (x.label == 1) for x in got) >= 196
    assert all(0 <= x.score <= 1 for x in got)
    again = compression.train(docs.where("doc_id < 400").repartition(5), labels.repartition(3))
    assert again == model


def test_classifier_takes_any_row(spark, labelled):
    docs, labels = labelled
    model = compression.train(docs, labels.withColumns({"text": F.lit("x"), "h": F.lit("x")}))
    rows = [(1, None), (2, ""), (3, "a"), (None, "b c"), (3, "a"), (4, "word " * 50_000)]
    odd = spark.createDataFrame(rows, "doc_id long, text string").select("*", *[F.lit("x").alias(c) for c in ("d", "s", "h", "empty", "score")])
    got = compression.score(odd, model).collect()
    assert Counter(x.doc_id for x in got) == Counter([1, 2, 3, None, 3, 4]) and all(x.score == model.share for x in got if x.doc_id in (1, 2))
    assert compression.score(docs.limit(0), model).count() == 0


def test_classifier_without_labels(spark, labelled):
    docs, labels = labelled
    for some, share in ((labels.limit(0), 0.5), (labels.where("label = 1"), 1.0), (labels.select("doc_id", F.lit(None).cast("int").alias("label")), 0.5), (labels.select("doc_id", F.lit(7).alias("label")), 0.5)):
        model = compression.train(docs, some)
        assert {x.score for x in compression.score(docs.limit(20), model).collect()} == {share}


def test_difference_follows_the_dictionary():
    p = compression.Compression()
    good, bad = (compression._compressor(w * 200, p) for w in (b"plain words here ", b"LOUD!! WORDS!! "))
    assert compression.difference(b"plain words here plain", good, bad, p)[0] > 0 > compression.difference(b"LOUD!! WORDS!! LOUD!!", good, bad, p)[0]
    assert compression.difference(b"", good, bad, p) == (0.0, 0.0)


def test_classifier_on_held_out_documents(spark, sf_dir):
    out = queries.op13_compression_classifier(spark, "/root/testdata/sf0.01").where("held_out")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = out.join(labels, "doc_id").select("score", "quality").collect()
    one, zero = ([x.score for x in got if x.quality == q] for q in (1, 0))
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in one for b in zero])
    assert auc > 0.95 and sum((x.score >= 0.7) == (x.quality == 1) for x in got) > 0.92 * len(got)
