"""Test outcomes: flags, clusters, two-tier ranking and its metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Weights of a cluster's size, length and assertions, and the rank of a bug without success.
WEIGHTS = {"size": 0.3, "length": 0.5, "asserts": 0.2}
NO_SUCCESS = 100000


def fail_to_pass(fails_before: Column, fails_after: Column) -> Column:
    """A missing result after counts as failing."""
    return F.coalesce(fails_before, F.lit(False)) & ~F.coalesce(fails_after, F.lit(True))


def result_flags(rows: DataFrame) -> DataFrame:
    """Flags of run results(error_msg, success, buggy, fixed): a bare error message is a parse error; see `buggy`'s fields."""
    broken = F.col("error_msg").isNotNull() | F.col("buggy").isNull()
    b = lambda f: F.coalesce(F.col(f"buggy.{f}"), F.lit(False))
    failed = F.coalesce(F.size("buggy.failed_tests") > 0, F.lit(False))
    return rows.withColumns(
        {
            "parse_error": broken, "compile_error": ~broken & b("compile_error"), "has_error": ~broken & (b("compile_error") | b("runtime_error")),
            "is_fib": ~broken & (failed | b("runtime_error")), "succeeded": ~broken & F.coalesce("success", F.lit(False)),
            "buggy_output": F.when(~broken, F.array_join("buggy.fib_error_msg", "\n")), "fib_test_id": F.try_element_at("buggy.failed_tests", F.lit(1)),
        }
    )


def clusters(tests: DataFrame, key: Column, fails: Column) -> DataFrame:
    """(bug, rep, test, size): a bug's failing tests by their key; all of its tests, if none fails."""
    w = Window.partitionBy("bug")
    any_fails = F.max(fails.cast("int")).over(w)
    rows = tests.withColumns({"rep": key, "_any": any_fails}).where(fails | (F.col("_any") == 0))
    return rows.withColumn("size", F.count("*").over(Window.partitionBy("bug", "rep"))).drop("_any")


def rank_tests(features: DataFrame) -> DataFrame:
    """bug, test, rnk, score from (bug, cluster, test, pos, length, assertions, exception_match, trace_match).

    Clusters that match the report come first; within both tiers by score: size, least length and least assertions on
    log scales relative to the tier; then tests by (-match, assertions, length).
    """
    c = features.groupBy("bug", "cluster").agg(
        F.count("*").alias("size"), F.min("length").alias("min_length"), F.min("assertions").alias("min_assertions"), F.min("pos").alias("first_pos"),
        F.min_by(F.col("exception_match").cast("int") + 2 * F.col("trace_match").cast("int"), "pos").alias("match"),
    )
    tier = Window.partitionBy("bug", F.col("match") > 0)
    top = lambda x: F.max(x).over(tier)
    up = lambda x: F.when(top(x) > 0, 100 * F.log1p(x) / F.log1p(top(x))).otherwise(100 * F.log1p(x) / F.log1p(F.lit(1.0)))
    down = lambda x: 100 - up(x)
    score = WEIGHTS["size"] * up("size") + WEIGHTS["length"] * down("min_length") + WEIGHTS["asserts"] * down("min_assertions")
    c = c.withColumn("score", F.round(score, 6)).select("bug", "cluster", "match", "score", "first_pos")
    place = Window.partitionBy("bug").orderBy((F.col("match") > 0).desc(), F.desc("score"), "first_pos", "cluster", F.desc("exception_match"), "assertions", "length", "pos")
    return features.join(c, ["bug", "cluster"]).withColumn("rnk", F.row_number().over(place))


def first_success(ranked: DataFrame) -> DataFrame:
    """(bug, first_rank, num) of ranked(bug, rnk, success)."""
    return ranked.groupBy("bug").agg(F.coalesce(F.min(F.when(F.col("success"), F.col("rnk"))), F.lit(NO_SUCCESS)).alias("first_rank"), F.count("*").alias("num"))


def accuracy(first: DataFrame, ns: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """(n, acc, frac) over all bugs."""
    n = F.explode(F.array(*[F.lit(x) for x in ns])).alias("n")
    return first.select("*", n).groupBy("n").agg(F.count_if(F.col("first_rank") <= F.col("n")).alias("acc"), F.round(F.avg((F.col("first_rank") <= F.col("n")).cast("double")), 6).alias("frac"))


def wasted_effort(first: DataFrame, ns: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """(n, total, mean): rank - 1 if within n, else the smaller of the number of tests and n."""
    waste = F.when(F.col("first_rank") <= F.col("n"), F.col("first_rank") - 1).otherwise(F.least("num", "n"))
    rows = first.select("*", F.explode(F.array(*[F.lit(x) for x in ns])).alias("n"))
    return rows.groupBy("n").agg(F.sum(waste).alias("total"), F.round(F.avg(waste.cast("double")), 6).alias("mean"))


def shuffled_ranks(tests: DataFrame, seeds: int, key: str) -> DataFrame:
    """seed, bug, rnk and the rest: a reproducible random order for each seed, by md5 of seed and key."""
    rows = tests.withColumn("seed", F.explode(F.sequence(F.lit(0), F.lit(seeds - 1))))
    order = F.md5(F.concat(F.col("seed").cast("string"), F.lit("-"), F.col(key).cast("string")))
    return rows.withColumn("rnk", F.row_number().over(Window.partitionBy("seed", "bug").orderBy(order)))


#: A bug of so many tests at most is ranked in one row; others are added up by all tasks.
FEW_TESTS = 10_000


def shuffled_first_success(tests: DataFrame, seeds: int, key: str, few: int = FEW_TESTS) -> DataFrame:
    """(seed, bug, first_rank, num): first_success of shuffled_ranks for each seed, without sorting or shuffling a row for each
    seed: the first success stands behind the tests whose md5 is below the least md5 of one. The tests of a bug are moved once, as
    an array that gives the ranks of all seeds; bugs of more than `few` tests go another way."""
    counts = tests.groupBy(F.col("bug").alias("_bug")).agg(F.count("*").alias("_tests"))
    long = F.broadcast(counts.where(F.col("_tests") > few).select("_bug"))
    on = F.col("bug").eqNullSafe(F.col("_bug"))
    each = F.explode(F.sequence(F.lit(0), F.lit(seeds - 1))).alias("seed")
    rows = tests.select("bug", F.col(key).cast("string").alias("k"), F.coalesce("success", F.lit(False)).alias("s")).join(long, on, "left_anti")
    rows = rows.groupBy("bug").agg(F.collect_list(F.struct("k", "s")).alias("x")).select("bug", "x", each)
    order = F.transform("x", lambda t: F.struct(F.md5(F.concat(F.col("seed").cast("string"), F.lit("-"), t["k"])).alias("h"), t["s"].alias("s")))
    rows = rows.select("seed", "bug", order.alias("x"))
    rows = rows.select("seed", "bug", "x", F.array_min(F.transform(F.filter("x", lambda t: t["s"]), lambda t: t["h"])).alias("least"))
    behind = F.size(F.filter("x", lambda t: t["h"] < F.col("least"))).cast("long")
    rows = rows.select("seed", "bug", F.when(F.col("least").isNotNull(), behind + 1).otherwise(NO_SUCCESS).alias("first_rank"), F.size("x").cast("long").alias("num"))
    return rows.unionByName(_long_first_success(tests.join(long, on, "left_semi"), seeds, key))


def _long_first_success(tests: DataFrame, seeds: int, key: str) -> DataFrame:
    """shuffled_first_success of bugs of many tests. The least md5 are found first, a row a bug and seed after each task has added
    up its own; a bug's are then one array beside its tests."""
    order = lambda seed: F.md5(F.concat(seed.cast("string"), F.lit("-"), F.col(key).cast("string")))
    each = F.explode(F.sequence(F.lit(0), F.lit(seeds - 1)))
    least = tests.where("success").select("bug", key, each.alias("seed")).groupBy("bug", "seed").agg(F.min(order(F.col("seed"))).alias("least"))
    least = least.groupBy(F.col("bug").alias("_bug")).agg(F.transform(F.sort_array(F.collect_list(F.struct("seed", "least"))), lambda x: x["least"]).alias("least"))
    rows = tests.select("bug", key).join(least, F.col("bug").eqNullSafe(F.col("_bug")), "left").select("bug", key, "least", each.alias("seed"))
    behind = F.count_if(order(F.col("seed")) < F.get("least", F.col("seed")))
    won = F.first(F.col("least").isNotNull())
    return rows.groupBy("seed", "bug").agg(F.when(won, behind + 1).otherwise(NO_SUCCESS).alias("first_rank"), F.count("*").alias("num"))
