import difflib
import random
import re

from pyspark.sql import functions as F

from siftline.operators import bm25, includes, messages, outcomes, setjoin, trees
from siftline.plans import python_queries, registry


def test_any_order_says_that_a_customer_is_done(spark, tmp_path):
    write = lambda rows, schema, name: spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    write([(1,), (2,), (3,)], "c_custkey long", "customer")
    write([(1, 500000.0), (2, 10.0)], "o_custkey long, o_totalprice double", "orders")
    assert [r.c_custkey for r in registry.resume_anti(spark, str(tmp_path)).collect()] == [3]


def brute_expanded(texts, name, trail=()):
    def one(m):
        return m[0] if m[1] not in texts or m[1] in (*trail, name) else brute_expanded(texts, m[1], (*trail, name))

    return re.sub(includes.TEMPLATE, one, texts[name])


def test_texts_with_many_includes_are_made_up_once(spark):
    """Each text includes the one before it ten times: 10^9 pieces in the end, of no letters."""
    texts = {"n0": ""} | {f"n{i}": 10 * ("%{n" + str(i - 1) + "}") for i in range(1, 10)}
    got = includes.expanded(spark.createDataFrame(list(texts.items()), "name string, text string"))
    assert {x.name: x.text for x in got.collect()} == dict.fromkeys(texts, "")


def test_includes_between_and_within_cycles_equal_recursion(spark):
    r = random.Random(8)
    texts = {}
    for i in range(40):  # cycles of one to three texts that include each other and smaller ones
        marks = [f"n{j}" for j in ([i - i % 4 + (i + 1) % 4] if i % 4 < 3 else [i]) + [r.randrange(max(1, i - i % 4)) for _ in range(i % 3)]]
        texts[f"n{i}"] = f"{i}<" + ",".join("%{" + m + "}" for m in marks) + ">%{gone}"
    got = {x.name: x.text for x in includes.expanded(spark.createDataFrame(list(texts.items()), "name string, text string")).collect()}
    assert got == {k: brute_expanded(texts, k) for k in texts}


def test_scaling_moves_no_scores(spark):
    rows = [(1, 1, 2.0), (1, 2, 4.0), (None, 1, -1.0), (2, 1, 3.0), (2, 2, 3.0), (2, 3, 3.0)]
    scored = spark.createDataFrame(rows, "item_id int, doc_id int, score double")
    out = bm25.min_max_of(scored, spark.range(3), "score", "sim")
    assert "Window" not in out._jdf.queryExecution().executedPlan().toString()
    assert sorted((str(r.item_id), r.doc_id, r.sim) for r in out.collect()) == [("1", 1, 0.5), ("1", 2, 1.0), ("2", 1, 0.0), ("2", 2, 0.0), ("2", 3, 0.0), ("None", 1, 0.0)]


def test_what_a_document_holds_stays_together(spark):
    docs = spark.range(200).selectExpr("id as doc_id", "transform(sequence(1, 30), x -> concat('w', x + id % 7)) as tokens")
    for rows in bm25.index(docs).postings.select("doc_id").rdd.glom().collect():
        ids = [r.doc_id for r in rows]
        assert len(ids) == 30 * len(set(ids)) and sum(a != b for a, b in zip(ids, ids[1:], strict=False)) == max(0, len(set(ids)) - 1)


def test_files_of_a_table_of_one_split_go_to_all_cores(spark, sf_dir):
    assert python_queries._files(spark, sf_dir).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_shuffled_baselines_move_each_test_once(spark):
    r = random.Random(9)
    rows = [(r.choice([None, 1, 2, 3, 4]), i, r.choice([True, False, False, None])) for i in range(200)] + [(5, 900, False)]
    t = spark.createDataFrame(rows, "bug int, test long, success boolean")
    want = sorted(map(str, outcomes._long_first_success(t, 9, "test").collect()))
    for few in (10_000, 40, 0):  # all bugs by arrays, some, none
        assert sorted(map(str, outcomes.shuffled_first_success(t, 9, "test", few).collect())) == want
    short = outcomes.shuffled_first_success(t, 9, "test")._jdf.queryExecution().optimizedPlan().toString().split("Union")[1]
    assert "Generate" in short and "collect_list" in short.split("Generate")[1].split("Join LeftSemi")[0]


def test_trees_of_one_shape_are_compared_once():
    r = random.Random(4)
    trees._shape_distance.cache_clear()
    for i in range(300):
        x, y = ([(0, f"{i}", 0.5), *[(1, f"{i}-{n}", 0.25) for n in names]] for names in ((1, 2, 2), (2, 1, r.randint(2, 4))))
        assert trees.shape_distance(x, y) == trees.edit_distance(x, y)
    assert trees._shape_distance.cache_info().misses <= 3


def test_closure_sends_no_front_to_the_driver(spark, monkeypatch):
    plans, kept = [], type(spark.range(0)).checkpoint

    def checkpoint(df, *a):
        out = kept(df, *a)
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return out

    monkeypatch.setattr(type(spark.range(0)), "checkpoint", checkpoint)
    edges = spark.range(1, 50).selectExpr("id as src", "id div 2 as dst")
    got = {(r.root, r.node) for r in trees.closure(edges, spark.createDataFrame([(37,)], "root long")).collect()}
    assert got == {(37, n) for n in (37, 18, 9, 4, 2, 1, 0)} and plans and not any("Broadcast" in p for p in plans)


def test_similar_texts_are_moved_as_texts_and_meet_in_blocks(spark, monkeypatch):
    r = random.Random(6)
    said = ["".join(r.choice("abcdefgh é𝄞") for _ in range(r.choice([1, 2, 5, 30, 90]))) for _ in range(60)]
    near = ["".join(c for c in t if r.random() < 0.95) for t in said]
    left, right = spark.createDataFrame([(1, t) for t in said], "key int, text string"), spark.createDataFrame([(1, t) for t in near], "key int, text string")
    want = {(1, a, b) for a in said for b in near if b and difflib.SequenceMatcher(None, a, b).ratio() > 0.8}
    monkeypatch.setattr(messages, "BLOCK", 7)
    got = messages.similar_pairs(left, right)
    assert {tuple(x) for x in got.collect()} == want and len(want) > 30
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "substr" not in plan and "toks" not in plan and "array_intersect" not in plan  # a row a text, not one a pair of characters
    tried = sum(len(at) for _, at in messages.candidates(said, near, 0.8))
    assert len(want) <= tried < 60 * 60 / 5


def test_pairs_of_sets_are_not_moved(spark, monkeypatch):
    """Sets meet in units of two blocks; a pair that shares a token is no row of a shuffle, only what is found is."""
    r = random.Random(10)
    rows = []
    for i in range(400):
        base = r.choice(rows)[2] if rows and r.random() < 0.5 else []
        rows.append((i, r.choice(["s", "t", None]), [w for w in base if r.random() < 0.9] + [f"w{int(r.paretovariate(0.7)) % 80}" for _ in range(r.choice([0, 2, 8, 40]))]))
    df = spark.createDataFrame(rows, "doc_id long, source string, tokens array<string>")
    j = lambda x, y: round(len({*x} & {*y}) / max(1, len({*x} | {*y})), 6)
    want = {(a, b): j(x, y) for a, s, x in rows for b, t, y in rows if a < b and s and s == t and j(x, y) > 0.5}
    monkeypatch.setattr(setjoin, "BLOCK", 300)  # many classes, many blocks
    found = setjoin.jaccard(df, 0.5, "source")
    assert {(x.doc_a, x.doc_b): x.j for x in found.collect()} == want and len(want) > 100
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "Join" not in plan.split("MapInArrow")[0] and "Aggregate" not in plan.split("MapInArrow")[0]


def test_texts_are_tokenised_once(spark):
    """The expression that makes the tokens stands in the plan of an index once, not in the questions of explode() too."""
    d = spark.createDataFrame([(1, "HTTPServer tests_of-Ünïcode x1Y2"), (2, None), (3, "")], "doc_id long, text string").repartition(3)
    tokens = d.select("doc_id", registry.tx.identifier_tokens(F.col("text")).alias("tokens"))
    assert [r.tokens for r in tokens.orderBy("doc_id").collect()] == [["http", "server", "of", "n", "code", "x1", "y2"], [], []]
    rows = bm25.exploded(tokens.repartition("doc_id"), ["doc_id", F.size("tokens").alias("n")], "tokens", "token")
    assert sorted(tuple(r) for r in rows.collect()) == sorted((1, 7, t) for t in ("http", "server", "of", "n", "code", "x1", "y2"))
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace(regexp_replace") == 1


def test_classes_are_means_of_all_texts(spark):
    """Centres come from every training text, also of under 200 characters, however few start the search."""
    import numpy as np
    import pyarrow as pa

    from siftline.llm import mixing_model as mm

    r = random.Random(11)
    texts = ["".join(r.choice(("abcdef ", "uvwxyz ", "0123456789")[i % 3]) for _ in range(r.choice([20, 90, 400]))) for i in range(300)] + ["", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [mm.classes_of(d, mm.MixModel(classes=3, class_sample=30)) for d in (df.coalesce(1), df.repartition(5))]
    assert (got[0] == got[1]).all()
    [(_, raw, offsets)] = mm.text_pieces(pa.array(texts[:300]))
    x = mm.byte_profile(raw, offsets)
    own = mm.nearest_class(x, got[0])
    assert [len({*own[i::3].tolist()}) for i in range(3)] == [1, 1, 1] and len({*own.tolist()}) == 3
    assert all(np.allclose(x[own == k].mean(0), got[0][k], atol=1e-5) for k in range(3))


def test_closure_moves_each_set_once_an_edge(spark, monkeypatch):
    """no step moves all that is reached so far; cycles, loops, nulls and nodes that are no roots count as they did."""
    r, steps = random.Random(3), []
    kept = trees._closure_by_steps
    monkeypatch.setattr(trees, "_closure_by_steps", lambda e, roots: steps.append(roots.count()) or kept(e, roots))
    acyclic = [(i, i // d) for i in range(1, 200) for d in (2, 3)] + [(0, 0), (7, None), (None, 3)]
    cyclic = [(i, r.randrange(max(0, i - 20), i + 1)) for i in range(60)] + [(4, 9), (9, 6), (30, 41), (41, 30), (55, 300)]
    for edges, asked, tied in ((acyclic, [*range(1, 200), None], []), (cyclic, range(1, 60), [None]), (cyclic, [44], [1])):
        ahead, want = {}, set()
        for a, b in edges:
            ahead.setdefault(a, set()).add(b)
        for root in asked:
            seen, front = {root}, [root]
            while front:
                more = {b for a in front if a is not None for b in ahead.get(a, ())} - seen
                seen, front = seen | more, list(more)
            want |= {(root, n) for n in seen}
        steps.clear()
        out = trees.closure(spark.createDataFrame(edges, "src long, dst long"), spark.createDataFrame([(x,) for x in asked], "root long"))
        got = [(x.root, x.node) for x in out.collect()]
        assert set(got) == want and len(got) == len(want) and out.columns == ["root", "node"]
        assert steps == tied or tied == [None] and len(steps) == 1 and steps[0] < 60


def test_pairs_of_trees_are_written_without_trees(spark, monkeypatch):
    """trees meet a slice of the roots at a time, and no table of pairs holds them."""
    r, rows, written = random.Random(5), [], []
    kept = trees.staged
    monkeypatch.setattr(trees, "staged", lambda df: written.append(df.columns) or kept(df))
    for root in range(40):
        rows.append((root, [(0, "r", 1.0), *[(1, r.choice("abcde"), 0.25) for _ in range(r.randint(0, 6))]]))
    g = spark.createDataFrame(rows, f"root int, tree {trees.TREE}")
    a, b = g.selectExpr("root as root_a", "tree as tree_a"), g.selectExpr("root as root_b", "tree as tree_b")
    pairs = a.join(b, F.col("root_a") < F.col("root_b"))
    want = sorted(map(tuple, trees.most_similar(pairs, 3).collect()))
    monkeypatch.setattr(trees, "AT_ONCE", 200)
    got = sorted(map(tuple, trees.most_similar_of(pairs.select("root_a", "root_b"), g, 3).collect()))
    assert got == want and len(got) == 3 * 37 + 3
    assert len(written) > 10 and not any("tree_a" in c for c in written)
