import random

import pytest
from pyspark.sql import functions as F

from siftline.operators import generation, lemmas, structure, trees

SHAPE = "node_id string, parent_id string, name string"


def brute(rows):
    """node -> (path of names, ids above from the root, enter, leave), cycles left out."""
    ids = {i for i, _, _ in rows}
    children = {}
    for i, up, name in rows:
        children.setdefault(up if up in ids else None, []).append((name or "", i))
    out, at = {}, 0
    stack = [("in", i, name, (), ()) for name, i in sorted(children.get(None, []), reverse=True)]
    while stack:
        move, i, name, path, ups = stack.pop()
        if move == "out":
            out[i] = (*out[i][:3], at)
        else:
            out[i] = ([*path, name], list(ups), at, None)
            stack.append(("out", i, name, path, ups))
            stack += [("in", c, n, (*path, name), (*ups, i)) for n, c in sorted(children.get(i, []), reverse=True)]
        at += 1
    return out


@pytest.fixture(scope="module")
def nodes():
    r, rows = random.Random(3), [("x0", None, "a"), ("x1", "gone", "b"), ("x2", None, None)]
    for i in range(3, 300):
        rows.append((f"x{i}", f"x{r.randrange(max(0, i - 40), i)}", r.choice("abcd")))
    rows += [(f"d{i}", f"d{i - 1}" if i else None, r.choice("ab")) for i in range(200)]  # a chain of 200
    rows += [(f"c{i}", f"c{(i + 1) % 5}", "a") for i in range(5)] + [("c9", "c0", "a")]  # a cycle, and a node below it
    return rows


def test_intervals_equal_a_walk_of_the_tree(spark, nodes):
    tree = structure.labelled(spark.createDataFrame(nodes, SHAPE))
    got = {r.node_id: (r.path, r.enter, r.leave, r.depth) for r in tree.collect()}
    want = {i: (path, a, z, len(path) - 1) for i, (path, _, a, z) in brute(nodes).items()}
    assert got == want


def test_searches_along_the_tree_equal_brute_force(spark, nodes):
    want = brute(nodes)
    tree = structure.labelled(spark.createDataFrame(nodes, SHAPE))
    pairs = {(top, i, len(ups) - k) for i, (_, ups, _, _) in want.items() for k, top in enumerate(ups)}
    assert {tuple(r) for r in structure.below(tree, tree).collect()} == pairs
    some = tree.where("name = 'b'")
    assert {(r.top_id, r.node_id, r.distance) for r in structure.above(tree, some).collect()} == {p for p in pairs if want[p[1]][0][-1] == "b"}
    assert {r.node_id for r in structure.topmost(tree).collect()} == {i for i, (path, _, _, _) in want.items() if path[-1] not in path[:-1]}


def test_full_names(spark):
    rows = [("f", None, "pkg/mod/a.py"), ("c", "f", "Test"), ("m", "c", "run")]
    got = {r.node_id: r.full_name for r in structure.full_name(structure.labelled(spark.createDataFrame(rows, SHAPE))).collect()}
    assert got == {"f": "pkg.mod.a", "c": "pkg.mod.a.Test", "m": "pkg.mod.a.Test.run"}


def test_dotted_names_match_once_or_by_their_chain(spark, nodes):
    want = brute(nodes)
    seen = {i: path for i, (path, _, _, _) in want.items() if path[-1] not in path[:-1]}
    r = random.Random(5)
    keywords = [(k, p) for k in {".".join(path[-r.randint(1, 4) :]) for path in seen.values()} | {"zz.a", "only", "zz.only", "proj.c", "nothing"} for p in (None, "proj")]
    more = [*nodes, ("one", "x3", "only")]
    seen["one"] = [*want["x3"][0], "only"]
    expected = set()
    for k, p in keywords:
        parts = k.split(".")
        parts = parts[1:] if len(parts) > 1 and parts[0] == p else parts
        named = [i for i, path in seen.items() if path[-1] == parts[-1]]
        expected |= {(k, i) for i in named if len(named) == 1 or seen[i][-len(parts) :] == parts}
    got = structure.dotted_matches(spark.createDataFrame(keywords, "keyword string, project string"), structure.labelled(spark.createDataFrame(more, SHAPE)))
    assert {tuple(x) for x in got.collect()} == expected


def test_positions_are_gapless_over_ranges(spark):
    rows = spark.range(0, 5000, 1, 7).select(F.sha2(F.col("id").cast("string"), 256).alias("k"))
    got = sorted((r.k, r.at) for r in structure.numbered(rows, "k", "at").collect())
    assert [at for _, at in got] == list(range(5000))


def test_empty_tree(spark):
    tree = structure.labelled(spark.createDataFrame([], SHAPE))
    assert tree.count() == structure.below(tree, tree).count() == structure.topmost(tree).count() == 0


def brute_hunks(lines, context):
    """Lines of one file as (old line, text) in order -> hunks as (pre_start, pre_len, post_start, post_len, body)."""
    keep = set()
    for i, (hunk, _, text) in enumerate(lines):
        if text[0] in "+-":
            keep |= {j for j in range(i - context, i + context + 1) if 0 <= j < len(lines) and lines[j][0] == hunk}
    out, delta, end = [], 0, None
    for i in sorted(keep):
        _, at, text = lines[i]
        if at != end:
            out.append([at, 0, at, 0, []])
        out[-1][1] += text[0] != "+"
        out[-1][3] += text[0] != "-"
        out[-1][4].append(text)
        end = at + (text[0] != "+")
    for h in out:
        h[2] += delta
        delta += h[3] - h[1]
        h[4] = "\n".join(h[4])
    return [tuple(h) for h in out]


def test_minimal_hunks_equal_a_walk(spark):
    r, rows, walked = random.Random(8), [], {}
    for file in range(12):
        at = 1
        for hunk in range(4):
            at += r.choice([0, 30])
            start = at
            for k in range(r.randint(1, 15)):
                text = r.choice("+-    ") + f"l{k}"
                rows.append((1, file, hunk, start, k, text))
                walked.setdefault(file, []).append((hunk, at, text))
                at += text[0] != "+"
    df = spark.createDataFrame(rows, "patch long, file long, old_hunk long, pre_start long, line_no long, line string")
    for context in (0, 1, 3):
        got = {}
        for x in generation.minimal_hunks(df, context).orderBy("file", "hunk").collect():
            got.setdefault(x.file, []).append((x.pre_start, x.pre_len, x.post_start, x.post_len, x.body))
        assert got == {f: h for f, lines in walked.items() if (h := brute_hunks(lines, context))}


def test_lemmas_need_a_known_base_form(spark):
    said = "test tests boxes box classes class glass news wolf wolves women woman cities city bus buses its it ss".split()
    t = spark.createDataFrame([(w,) for w in said * 2 + ["once", "onces"]], "token string")
    forms = {r.word: r.lemma for r in lemmas.base_forms(t.select(F.col("token").alias("word")), lemmas.vocabulary(t)).collect()}
    assert forms == {"tests": "test", "boxes": "box", "classes": "class", "wolves": "wolf", "women": "woman", "cities": "city", "buses": "bus"}
    got = [r.token for r in lemmas.lemmatised(t.where("token in ('tests', 'once')"), spark.createDataFrame(forms.items(), "word string, lemma string")).collect()]
    assert sorted(got) == ["once", "test", "test"]


def test_most_similar_trees_equal_all_pairs(spark):
    r, rows = random.Random(9), []
    for root in range(30):
        tree = [(0, "r", 1.0)]
        for _ in range(r.randint(0, 9)):
            name = r.choice("abcde")
            tree.append((r.randint(1, min(3, tree[-1][0] + 1)), name, 0.1 + "abcde".index(name) / 5))
        rows.append((root, tree))
    g = spark.createDataFrame(rows, f"root int, tree {trees.TREE}")
    a, b = g.selectExpr("root as root_a", "tree as tree_a"), g.selectExpr("root as root_b", "tree as tree_b")
    pairs = a.join(b, F.col("root_a") != F.col("root_b"))
    every = {}
    for x in trees.similarities(pairs).collect():
        every.setdefault(x.root_a, []).append((-x.sim, x.root_b))
    got = {}
    for x in trees.most_similar(pairs, 3).collect():
        got.setdefault(x.root_a, []).append((-x.sim, x.root_b))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v)[:3] for k, v in every.items()}
    bounds = pairs.withColumn("bound", trees.likeness_bound(F.col("tree_a"), F.col("tree_b"))).join(trees.similarities(pairs), ["root_a", "root_b"])
    assert bounds.where("sim > bound + 1e-6").count() == 0
