import difflib
import random
import re

from siftline.operators import includes, messages, runlogs


def test_similar_pairs_equal_all_pairs(spark):
    r = random.Random(3)

    def near(text):
        return "".join(c if r.random() < 0.93 else r.choice("xyz") for c in text if r.random() < 0.96)

    said = ["".join(r.choice("abcdefghij ") for _ in range(r.choice([1, 2, 3, 4, 5, 6, 9, 30, 80]))) for _ in range(60)]
    left = [(r.randrange(3), t) for t in said] + [(0, ""), (1, None), (None, "abc"), (2, "aaaaaaaaaa"), (2, "aaaaaaaaaa")]
    right = [(r.randrange(3), near(r.choice(said))) for _ in range(150)] + [(2, "aaaaaaaa"), (2, "abaaaaaaa"), (0, ""), (1, None), (None, "abc")]
    for limit in (0.7, 0.8, 0.95):
        want = {
            (k, a, b) for k, a in left for q, b in right if k is not None and k == q and a and b and difflib.SequenceMatcher(None, a, b).ratio() > limit
        }
        got = messages.similar_pairs(spark.createDataFrame(left, "key long, text string"), spark.createDataFrame(right, "key long, text string"), limit)
        assert {tuple(x) for x in got.collect()} == want and len(want) > 10


def brute_expanded(texts, pattern, name, trail=()):
    def one(m):
        return m[0] if m[1] not in texts or m[1] in (*trail, name) else brute_expanded(texts, pattern, m[1], (*trail, name))

    return re.sub(pattern, one, texts[name])


def test_includes_equal_recursion(spark):
    r = random.Random(5)
    texts = {f"n{i}": "".join(r.choice(["a\n", "b ", "%{n" + str(r.randrange(12)) + "}", "%{no}", "%{}", "{x}"]) for _ in range(r.randint(0, 5))) for i in range(10)}
    rows = [(k, v) for k, v in texts.items()] + [("none", None)]
    got = {x.name: x.text for x in includes.expanded(spark.createDataFrame(rows, "name string, text string")).collect()}
    assert got == {k: brute_expanded(texts, includes.TEMPLATE, k) for k in texts} | {"none": ""}


def test_requirements_are_followed(spark):
    rows = [("r.txt", "numpy\n-r dev.txt\n  -r  more.txt \npytest"), ("dev.txt", "black\n-r r.txt"), ("more.txt", "x==1")]
    got = {x.name: x.text for x in includes.expanded(spark.createDataFrame(rows, "name string, text string"), includes.REQUIREMENTS).collect()}
    assert got["r.txt"] == "numpy\nblack\n-r r.txt\nx==1\npytest"


def test_sections_of_a_long_run_equal_a_walk(spark):
    r, rows = random.Random(7), []
    for run, n in ((1, 9000), (2, 5)):
        rows += [(run, i, f"____ test_{i} ____" if r.random() < 0.0008 else "line", "pytest") for i in range(n)]
    lines = spark.createDataFrame(rows, "run_id long, line_no long, line string, dialect string").repartition(5)
    got = {(x.run_id, x.line_no): (x.section, x.about, x.offset) for x in runlogs.sections(lines).collect()}
    state = {}
    for run, i, line, _ in rows:
        number, about, at = state.get(run, (0, None, None))
        if line.startswith("____"):
            number, about, at = number + 1, line.split()[1], i
        state[run] = number, about, at
        assert got[run, i] == (number, about, None if at is None else i - at)


def test_outcomes_of_each_dialect(spark):
    logs = {
        (1, "pytest"): ["x", "=== FAILURES ===", "____ test_a ____", "E  boom", "== short test summary info ==", "FAILED t.py::test_a - x", "=== FAILURES ===", "1 failed, 2 passed"],
        (2, "pytest"): ["== warnings summary ==", "3 passed"],
        (3, "unittest"): ["FAIL: test_b (m.C)", "Traceback", "Ran 2 tests in 1s", "FAILED (failures=1)"],
        (4, "unittest"): ["ERROR: test_c (m.C)", "FAILED (errors=2)"],
        (5, "finished"): ["____", "___ m:test_d", "FAIL", "tests finished: 1 passed, 1 failed, in 2 s"],
        (6, "other"): ["FAILED a::b", "1 failed"],
    }
    rows = [(run, i, line, kind) for (run, kind), said in logs.items() for i, line in enumerate(said)]
    lines = spark.createDataFrame(rows, "run_id long, line_no long, line string, dialect string")
    got = {x.run_id: (x.n_failed, x.n_errors, x.status, x.first, x.last) for x in runlogs.outcomes(lines).collect()}
    assert got == {1: (1, 0, 1, 1, 4), 2: (0, 0, 0, None, None), 3: (1, 0, 1, 0, 2), 4: (0, 2, -1, 0, 2), 5: (1, 0, 1, 2, 3), 6: (0, 0, 0, None, None)}
    assert {tuple(x) for x in runlogs.failed_tests(lines).collect()} == {(1, "t.py::test_a - x"), (3, "test_b (m.C)"), (4, "test_c (m.C)"), (5, "m:test_d")}
    assert [(x.line_no, x.about) for x in runlogs.reports(lines).where("run_id = 1").orderBy("line_no").collect()] == [(1, None), (2, "test_a"), (3, "test_a")]
