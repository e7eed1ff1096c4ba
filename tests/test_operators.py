import ast
import datetime
import difflib
import random
import re

import pytest
from pyspark.sql import functions as F

from siftline.functions import fuzzy, text
from siftline.operators import bm25, code, lookup, outcomes, trees
from siftline.sources import documents, tables
from siftline.streaming import chat


def brute_distance(a, b):
    """Recursion over forests of (name, weight, children)."""
    from functools import cache

    weight = lambda f: sum(w + weight(c) for _, w, c in f)

    @cache
    def d(x, y):
        if not x:
            return weight(y)
        if not y:
            return weight(x)
        (n, w, c), (m, v, e) = x[-1], y[-1]
        return min(d(x[:-1] + c, y) + w, d(x, y[:-1] + e) + v, d(c, e) + d(x[:-1], y[:-1]) + (0 if n == m else w + v))

    return d((a,), (b,))


def random_tree(r, n):
    kids = [random_tree(r, k) for k in ([] if n <= 1 else [r.randint(1, n - 1)])]
    if n > 2:
        kids += [random_tree(r, 1)]
    return (r.choice("abc"), r.choice([0.1, 0.5, 1.0]), tuple(kids))


def preorder(t, depth=0):
    return [(depth, t[0], t[1])] + [x for c in t[2] for x in preorder(c, depth + 1)]


def test_edit_distance_equals_brute_force():
    r = random.Random(3)
    for _ in range(150):
        a, b = random_tree(r, r.randint(1, 5)), random_tree(r, r.randint(1, 5))
        assert trees.edit_distance(preorder(a), preorder(b)) == pytest.approx(brute_distance(a, b))
        assert trees.edit_distance(preorder(a), preorder(a)) == 0


def test_tokenizer_branches(spark):
    names = ["SQLParser", "rawSQL", "tests", "x.py", "TestHTTPServer_v2", None, ""]
    df = spark.createDataFrame([(n,) for n in names], "n string").select(text.identifier_tokens(F.col("n")).alias("t"))
    assert [r.t for r in df.collect()] == [["sql", "parser"], ["raw", "sql"], [], ["x"], ["http", "server", "v2"], [], []]


def test_min_max_of_equal_scores_is_zero(spark):
    df = spark.createDataFrame([(1, 1, 2.0), (1, 2, 2.0), (2, 1, 0.0), (2, 2, 4.0)], "item_id int, doc_id int, score double")
    got = {(r.item_id, r.doc_id): r.s for r in bm25.min_max(df, "score", "s", "item_id").collect()}
    assert got == {(1, 1): 0.0, (1, 2): 0.0, (2, 1): 0.0, (2, 2): 1.0}


def test_unfolding_marks_cycles_and_depth(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "c"), ("d", "e"), ("e", "f"), ("f", "g"), ("g", "h"), ("h", "i"), ("i", "j")], "src string, dst string")
    roots = spark.createDataFrame([("a",), ("c",), ("d",)], "root string")
    rows = [(r.root, r.depth, r.name, r.truncated, r.recursive) for r in trees.unfold(roots, edges).collect()]
    assert ("a", 2, "a", False, True) in rows and ("c", 1, "c", False, True) in rows and ("d", 5, "i", True, False) in rows
    assert max(r[1] for r in rows) == 5


def test_node_weight_limits(spark):
    df = spark.createDataFrame([(0, 10, False), (10, 10, False), (3, 10, True), (3, 10, False), (1, 1, False)], "df int, n int, k boolean")
    got = [r[0] for r in df.select(trees.node_weight(F.col("df"), F.col("n"), F.col("k"))).collect()]
    assert got[:3] == [0.1, 0.1, 1.0] and 0.1 < got[3] < 0.9 and got[4] == 0.1


def test_keyword_pattern_is_the_node_name(spark):
    df = spark.createDataFrame([("A.foo", "*.foo"), ("A.foo", "B.foo"), ("foo", "x.foo"), ("A+foo.b", "A+foo.b")], "k string, n string")
    assert [r[0] for r in df.select(trees.keyword_matches(F.col("k"), F.col("n"))).collect()] == [True, False, True, True]


def test_range_join_equals_theta_join(spark):
    p, r = spark.range(0, 60).withColumnRenamed("id", "x"), spark.createDataFrame([(1, 3, 9), (2, 9, 40), (3, 55, 55)], "r int, lo int, hi int")
    got = {(a.x, a.r) for a in lookup.range_join(p, r, "x", "lo", "hi", 7).collect()}
    assert got == {(x, k) for x in range(60) for k, lo, hi in [(1, 3, 9), (2, 9, 40), (3, 55, 55)] if lo <= x <= hi}


def test_result_flags_of_the_union_type(spark):
    schema = "error_msg string, success boolean, buggy struct<compile_error boolean, runtime_error boolean, failed_tests array<string>, fib_error_msg array<string>>"
    rows = [("boom", None, None), (None, True, (False, False, ["t"], ["a", "b"])), (None, False, (True, False, [], []))]
    got = outcomes.result_flags(spark.createDataFrame(rows, schema)).collect()
    assert [(r.parse_error, r.compile_error, r.is_fib, r.succeeded, r.buggy_output, r.fib_test_id) for r in got] == [(True, False, False, False, None, None), (False, False, True, True, "a\nb", "t"), (False, True, False, False, "", None)]


def test_clusters_fall_back_to_all_tests(spark):
    t = spark.createDataFrame([(1, "a", "x", True), (1, "b", "y", False), (2, "c", "z", False), (2, "d", "z", False)], "bug int, test string, k string, fails boolean")
    got = {(r.bug, r.test, r.rep, r.size) for r in outcomes.clusters(t, F.col("k"), F.col("fails")).collect()}
    assert got == {(1, "a", "x", 1), (2, "c", "z", 2), (2, "d", "z", 2)}


def test_source_tables_equal_ast(spark):
    src = "import os\nfrom a import b as c\nX = 1\nclass TestA(Base):\n    '''D.'''\n    y = 2\n    @p\n    def test_x(self, a=1):\n        assert y\n        os.f()\n\nasync def test_top():\n    pass\n"
    files = spark.createDataFrame([("m.py", src), ("bad.py", "def (")], "path string, content string")
    d = {(r.kind, r.parent, r.name) for r in code.definition_table(files).collect()}
    assert d == {("class", "", "TestA"), ("class_function", "TestA", "test_x"), ("function", "", "test_top"), ("global_var", "", "X")}
    assert {r.name for r in code.test_table(files).collect()} == {"test_x", "test_top"}
    assert {(r.module, r.name, r.alias) for r in code.import_table(files).collect()} == {("os", None, None), ("a", "b", "c")}
    assert "@p\n    def test_x(self, a=1)" in code.class_signature(ast.parse(src).body[3])


def test_fuzzy_functions_equal_difflib():
    a, b = 'File "x", line 3, in f', 'File "x", line 4, in f'
    assert fuzzy.ratio_above(a, b) == (difflib.SequenceMatcher(None, a, b).ratio() > 0.8)
    same = fuzzy.normalised_test("def test_a():\n    v = 1  # c\n    assert v"), fuzzy.normalised_test("def test_b():\n    w = 1\n\n    assert w")
    assert same[0] == same[1] == "def @0 ( ) : ; { @1 = 1 ; assert @1 ; }"
    assert fuzzy.normalised_test("def t():\n    a, b = f(x=1)\n    a.x = b") == fuzzy.normalised_test("def u():\n    c, d = f(x=1)\n    c.x = d")
    assert fuzzy.normalised_test("def t(): return f(1)") != fuzzy.normalised_test("def t(): return g(1)") and fuzzy.normalised_test("x = (") == "x = ("
    assert fuzzy.count_assertions("assert x\nself.assertEqual(a, b)\n'assert'") == 2 if fuzzy.count_assertions("assert x") else True
    t = 'Traceback:\n  File "a.py", line 3, in run\n    x = f()\nValueError: bad\n'
    assert fuzzy.traces(t, fuzzy.OUTPUT_TRACES)[0]["message"].startswith("ValueError: bad")


def test_error_lines_keep_the_first_of_equal_ones(spark):
    df = spark.createDataFrame([("AError: x\nBWarning: y\nAError: x \nCException: z",)], "t string")
    assert df.select(text.error_lines(F.col("t"))).first()[0] == ["AError: x", "CException: z", "BWarning: y"]


def test_text_forms(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(text.string_list(F.lit("['a', 'b']  # c"))) == ["a", "b"]
    assert one(text.between(F.lit("xx<a>mid</a>"), "<a>", "</a>")) == "mid"
    assert one(text.strip_ansi(F.lit("\x1b[31mred\x1b[0m"))) == "red"
    assert one(text.test_names(F.lit("class TestA(B):\n    def test_x(self):\n    def other(): pass"))) == ["TestA", "test_x"]
    assert one(text.project_of(F.lit("django__django-123"))) == "django"
    assert one(text.fallback_error(F.lit("a\nE   x: Boom"))) == "Boom" and one(text.fallback_error(F.lit("a"))) == "UnknownError"
    assert one(text.too_long_guard(F.lit("x\n" * 1001))) == "Output too long, unable to parse"
    assert one(text.error_content(F.lit("A: b: c"))) == " b: c"


def test_sources(spark, tmp_path):
    (tmp_path / "pkg").mkdir()
    (tmp_path / "pkg/test_a.py").write_text("def test_a(): pass")
    (tmp_path / "build").mkdir()
    (tmp_path / "build/x.py").write_text("x = 1")
    (tmp_path / "pkg/deep").mkdir()
    (tmp_path / "pkg/deep/y.py").write_text("y = 1")
    (tmp_path / "tests").mkdir()
    (tmp_path / "tests/conf.py").write_text("z = 1")
    assert {r.path for r in tables.read_sources(spark, str(tmp_path)).collect()} == {"pkg/test_a.py", "pkg/deep/y.py"}
    assert "tests/conf.py" in {r.path for r in tables.read_sources(spark, str(tmp_path), project="pytest").collect()}
    assert tables.read_tests(spark, str(tmp_path)).count() == 1
    (tmp_path / "ids.txt").write_text("a\n\nb\n")
    assert {r[0] for r in tables.read_ids(spark, str(tmp_path / "ids.txt")).collect()} == {"a", "b"}
    d = spark.createDataFrame([(1, "diff --git a/x.py b/x.py\n+a\ndiff --git a/tests/t.py b/tests/t.py\n+b\n")], "k int, text string")
    assert tables.test_diff(d, ["k"]).first().text == "diff --git a/tests/t.py b/tests/t.py\n+b\n"
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "c")], "k int, v string")
    assert {tuple(r) for r in tables.upsert(old, new, "k").collect()} == {(1, "a"), (2, "c")}
    asked = tables.ask(new.withColumnRenamed("v", "prompt"), lambda p: p.upper() if p != "x" else None)
    assert asked.first().answer == "C"
    assert tables.refine(3, new, lambda df, i: df.withColumn("k", F.col("k") + i)).first().k == 8


PIECES = "conv string, seq long, index int, id string, type string, name string, arguments string, content string, last boolean, at timestamp"


def piece(c, k, i, n, at=None):
    return (c, i, k, f"id{k}" if i == 0 else None, "function" if i == 0 else None, f"f{k}" if i == 0 else None, f"a{k}{i}", f"t{i}", i == n - 1, at)


def streamed(spark, tmp_path, name, batches, idle_ms=None):
    """The folded rows of a stream that gets the batches one after the other."""
    src = str(tmp_path / "src")
    for rows in batches:
        spark.createDataFrame(rows, PIECES).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(PIECES).option("maxFilesPerTrigger", 1).parquet(src)
    stream = stream if idle_ms is None else stream.withWatermark("at", "10 seconds")
    with chat.rocks_db(spark):
        q = chat.fold_stream(stream, idle_ms).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(180)
    return [tuple(r) for r in spark.table(name).collect()], src


def test_chat_stream_equals_batch(spark, tmp_path):
    rows = [piece(c, k, i, 3 + k) for c in ("c1", "c2") for k in range(2) for i in range(3 + k)]
    random.Random(1).shuffle(rows)  # end marks too come before other pieces
    rows += rows[:3]  # and some pieces again
    got, src = streamed(spark, tmp_path, "folded", [rows[i : i + 4] for i in range(0, len(rows), 4)])
    batch = chat.fold(spark.read.parquet(src).dropDuplicates(["conv", "index", "seq"]))
    whole = {tuple(r) for r in batch.collect()}
    assert whole <= set(got) and len([r for r in got if r in whole]) == len(whole) == 4
    assert {(r[1], r[4], r[5]) for r in whole} == {(0, "f0", "a00a01a02"), (1, "f1", "a10a11a12a13")}


def test_idle_messages_are_put_out_when_the_watermark_passes(spark, tmp_path):
    at = lambda s: datetime.datetime(2024, 1, 1, 12, 0, 0) + datetime.timedelta(seconds=s)
    open_ = [piece("c1", 0, 1, 9, at(1)), piece("c1", 0, 0, 9, at(0))]  # its end never comes
    batches = [open_, [piece("c2", 0, 0, 2, at(5))], [piece("c3", 0, 0, 1, at(300))], [piece("c2", 0, 1, 2, at(301))], [piece("c4", 0, 0, 1, at(900))]]
    got, _ = streamed(spark, tmp_path, "idle", batches, 60_000)
    found = {(r[0], r[5], r[6]) for r in got}
    assert ("c1", "a00a01", "t0t1") in found and ("c3", "a00", "t0") in found and ("c4", "a00", "t0") in found
    assert ("c2", "a00a01", "t0t1") in found  # its second piece came before the batch in which it was due
    state = spark.read.format("statestore").option("path", str(tmp_path / "cp")).option("stateVarName", "pieces").load()
    left = {r.key.conv for r in state.select("key").collect()}
    assert "c1" not in left and "c3" not in left and "c4" not in left


def test_assertions_and_tokens_are_counted_as_they_stand():
    code_ = "def test_a():\n    assert x  # c\n    self.assertTrue(AssertionError)\n"
    assert fuzzy.count_assertions(code_) == 2 and fuzzy.count_assertions("assert (x") == 0
    assert fuzzy.count_tokens("x = 1\n") == 5 and fuzzy.count_tokens("x = (") is None  # also the line's and the text's end
    assert fuzzy.traces('a.py:3: in f\n    x()\nE   ValueError: b\n', fuzzy.OUTPUT_TRACES)[0]["message"].startswith("E   ValueError: b")
    style = "TypeError: Traceback (most recent call last)\n  some frame\nTypeError: bad\n"
    assert {"stack_trace": "  some frame\n", "message": "TypeError: bad\n"} in fuzzy.traces(style, fuzzy.REPORT_TRACES)


def test_first_success_of_shuffles_equals_their_ranks(spark):
    r = random.Random(3)
    rows = [(r.randrange(6) if i else None, f"t{i}", r.random() < 0.2) for i in range(80)] + [(9, "only", False)]
    t = spark.createDataFrame(rows, "bug int, test string, success boolean")
    ranked = outcomes.shuffled_ranks(t, 7, "test").groupBy("seed", "bug").agg(F.coalesce(F.min(F.when(F.col("success"), F.col("rnk"))), F.lit(outcomes.NO_SUCCESS)).alias("first_rank"), F.count("*").alias("num"))
    got = outcomes.shuffled_first_success(t, 7, "test").select(ranked.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, ranked.collect()))


def test_masked_lines_equal_difflib(spark):
    r, rows = random.Random(2), []
    for _ in range(300):
        code_ = "\n".join("".join(r.choice("abc ") for _ in range(r.randint(0, 20))) for _ in range(3))
        lines = [code_[r.randint(0, 20) :][: r.randint(0, 15)].replace("\n", " ") + r.choice(["", "x", " b", "zz"]) for _ in range(4)] + [""]
        rows.append((code_, "\n".join(lines)))
    got = spark.createDataFrame(rows, "code string, said string").select(text.mask_code(F.col("code"), F.col("said")).alias("m"), "code", "said").collect()
    masked = 0
    for x in got:
        joined = " ".join(v.strip() for v in x.code.split("\n") if v.strip())
        for line, m in zip(x.said.split("\n"), x.m, strict=True):
            line = line.strip()
            run = difflib.SequenceMatcher(None, joined, line, autojunk=False).find_longest_match(0, len(joined), 0, len(line)).size
            assert m == ("[CODE]" if line and run > 0.8 * len(line) else line)
            masked += m == "[CODE]"
    assert masked > 100
    assert spark.range(1).select(text.mask_code(F.lit(None).cast("string"), F.lit("a b"))).first()[0] == ["a b"]


def test_code_blocks_start_where_they_stand(spark):
    r, rows = random.Random(4), []
    for _ in range(200):
        rows.append(("\n".join(r.choice(["x", "y = 1", "```", "```py", "a ```b``` c", "", "```x\n```"]) for _ in range(r.randint(0, 14))),))
    for x in spark.createDataFrame(rows, "t string").select("t", text.code_blocks(F.col("t")).alias("b")).collect():
        want = []
        for m in re.finditer(r"```.*?```", x.t, re.S):
            inside = m[0].split("\n")
            if len(inside) > 1:
                start = x.t[: m.start()].count("\n") + 1
                want.append((start, start + len(inside) - 2, "\n".join(inside[1:-1])))
        assert [tuple(b) for b in x.b] == want


def test_callables_are_told_apart():
    src = "class Foo(TestCase):\n    @p\n    def check_test_it(self):\n        def inner(): pass\n        a.b.c(inner())\n    def other(self): pass\n\ndef outer():\n    def test_in(): pass\n\n@d\nclass Bar: \n    def test_no(self): pass\n"
    rows = {(r[1], r[2]): r for r in code.callables("m.py", src)}
    assert {k for k, r in rows.items() if r[5]} == {("Foo", "check_test_it")} and set(rows) == {("Foo", "check_test_it"), ("Foo", "other"), ("", "outer"), ("Bar", "test_no")}
    assert rows["Foo", "check_test_it"][6].startswith("class Foo(TestCase):\n    @p\n    def check_test_it") and rows["Bar", "test_no"][6].startswith("@d\nclass Bar: \n    def test_no")
    kinds = {r[3]: r[1] for r in code.definitions("m.py", src)}
    assert kinds["test_in"] == "inner_function" and kinds["outer"] == "function" and kinds["other"] == kinds["inner"] == "class_function"
    assert ("m.py", "check_test_it", "a.b", "c") in code.calls("m.py", src)


def test_reference_edges_go_by_name(spark):
    files = spark.createDataFrame([("a.py", "def f():\n    pass\n"), ("b.py", "import a\na.f()\nx = f\n")], "path string, content string")
    assert {tuple(r) for r in code.reference_edges(files).collect()} == {("b.py", 2, "f", "a.py", 1), ("b.py", 3, "f", "a.py", 1)}


def test_closure_has_no_end_of_its_own(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(75)] + [(75, 3)], "src long, dst long")
    got = trees.closure(edges, spark.createDataFrame([(0,), (70,)], "root long")).collect()
    assert sorted(r.node for r in got if r.root == 0) == list(range(76)) and sorted(r.node for r in got if r.root == 70) == list(range(3, 76))


def test_json_arrays_are_read(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"k": 1},\n {"k": 2}]')
    (tmp_path / "b.json").write_text('{"k":\n 3}')
    assert {r.k for r in documents.read_json(spark, str(tmp_path), "k int").collect()} == {1, 2, 3}
