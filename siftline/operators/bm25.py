"""BM25 over an inverted index, min-max scaling and blended similarity."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.documents import staged

K1, B, EPSILON = 1.5, 0.75, 0.25


def exploded(df: DataFrame, keep: list[Column | str], array: Column | str, name: str) -> DataFrame:
    """The columns of keep and an element of the array a row, as by explode(). For that, Spark first asks of each array whether
    it is null or empty, and an array that is a column's expression is made up again for each question; here that is asked of
    the rows."""
    return df.select(*keep, F.posexplode_outer(array).alias("_at", name)).where("_at is not null").drop("_at")


def document_frequency(docs: DataFrame) -> DataFrame:
    """(token, df) of docs(doc_id, tokens): distinct within a row first, so only counts are shuffled."""
    return exploded(docs, [], F.array_distinct("tokens"), "token").groupBy("token").agg(F.count("*").alias("df"))


#: Terms of queries are broadcast up to so many, tens of bytes each; beyond, they are shuffled.
BROADCAST_TERMS = 200_000


@dataclass(frozen=True)
class Index:
    """postings: (doc_id, token, tf, dl); terms: (token, idf, avgdl, df, bound), bound being no less than what one mention
    of the token in a query adds to any document's score."""

    postings: DataFrame
    terms: DataFrame


def index(docs: DataFrame) -> Index:
    """The inverted index of docs(doc_id, tokens), in the shared folder: documents are tokenised once, whatever is asked of
    it, and moved once. What a document holds stays one row, so that readers add up its scores before anything is shuffled.
    Terms in more than half of the documents get the floor value."""
    rows = exploded(docs.repartition("doc_id"), ["doc_id", F.size("tokens").cast("long").alias("dl")], "tokens", "token")
    rows = rows.groupBy("doc_id", "token").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))
    held = staged(rows.groupBy("doc_id").agg(F.collect_list(F.struct("token", "tf", "dl")).alias("x")))
    held = held.select("doc_id", F.explode("x").alias("x")).select("doc_id", "x.token", "x.tf", "x.dl")
    counted = held.groupBy("token").agg(F.count("*").alias("df"), F.sum("tf").alias("all"), F.max("tf").alias("most"), F.min("dl").alias("least"))
    counted = staged(counted)
    about = docs.agg(F.count("*").alias("n")).crossJoin(F.broadcast(counted.agg(F.sum("all").alias("all")))).select("n", (F.col("all") / F.col("n")).alias("avgdl"))
    raw = counted.crossJoin(F.broadcast(about)).withColumn("raw", F.ln(F.col("n") - F.col("df") + 0.5) - F.ln(F.col("df") + 0.5))
    eps = raw.agg((EPSILON * F.avg("raw")).alias("eps"))
    idf = F.when(F.col("raw") < 0, F.col("eps")).otherwise(F.col("raw"))
    terms = raw.crossJoin(F.broadcast(eps)).select("token", idf.alias("idf"), "avgdl", "df", "most", "least")
    bound = F.greatest(F.lit(0.0), F.col("idf") * _saturated(F.col("most"), F.col("least"), F.col("avgdl")))
    return Index(held, terms.select("token", "idf", "avgdl", "df", bound.alias("bound")))


def _saturated(tf: Column, dl: Column, avgdl: Column) -> Column:
    """What mentions of a term count for: rising with tf, falling with the length of the document."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))


def _small(df: DataFrame) -> DataFrame:
    """df, written; marked for broadcast if it has few rows."""
    df = staged(df)
    return F.broadcast(df) if df.count() <= BROADCAST_TERMS else df


def _asked(queries: DataFrame, terms: DataFrame) -> DataFrame:
    """(item_id, token, weight, bound, avgdl, df): terms of queries(item_id, tokens) that the index has; repeated ones count as
    often."""
    asked = queries.select("item_id", F.explode("tokens").alias("token")).groupBy("item_id", "token").agg(F.count("*").alias("times"))
    some = terms.join(_small(asked.select("token").distinct()), "token", "left_semi")
    return asked.join(some, "token").select("item_id", "token", (F.col("times") * F.col("idf")).alias("weight"), (F.col("times") * F.col("bound")).alias("bound"), "avgdl", "df")


def _part() -> Column:
    return F.col("weight") * _saturated(F.col("tf"), F.col("dl"), F.col("avgdl"))


def scores(queries: DataFrame, docs: DataFrame) -> DataFrame:
    """(item_id, doc_id, score) of every query(item_id, tokens) and document(doc_id, tokens) that share a term.

    Query terms repeat; unknown ones add nothing; terms in more than half of the documents get the floor value. Statistics
    come from the whole index; only the terms of queries are followed in it.
    """
    held = index(docs)
    return _scored(held.postings, _asked(queries, held.terms))


def _scored(postings: DataFrame, q: DataFrame) -> DataFrame:
    terms = _small(q.select("item_id", "token", "weight", "avgdl"))
    return postings.join(terms, "token").groupBy("item_id", "doc_id").agg(F.round(F.sum(_part()), 6).alias("score"))


#: Scores are sums of doubles, rounded to six places: bounds give way by more than that.
SLACK = 1e-5


#: So many postings are scored as they are: the steps of bounds take longer.
FEW_POSTINGS = 20_000_000


def top_scores(queries: DataFrame, docs: DataFrame, k: int, seeds: int = 2000, few: int = FEW_POSTINGS) -> DataFrame:
    """(item_id, doc_id, score) of the k best documents of each query, and of those that tie with the kth: as top_k of
    scores, but most postings of frequent terms are left alone.

    A query's rarest terms, `seeds` postings or so, name a few documents, whose scores give a bound that the kth best
    reaches. Terms whose largest possible weights add up to less can't lift a document there by themselves: only documents
    with one of the others are candidates, and frequent terms are looked up for those that may still reach the bound. A query
    without k such documents keeps all its terms. If all terms have `few` postings at most, these are scored at once, with
    the same result.
    """
    held = index(docs)
    q = staged(_asked(queries, held.terms))
    if (q.agg(F.sum("df")).first()[0] or 0) <= few:
        total = _scored(held.postings, q)
        best = F.rank().over(Window.partitionBy("item_id").orderBy(F.desc("score")))
        return total.withColumn("r", best).where(F.col("r") <= k).drop("r")
    by_df = Window.partitionBy("item_id").orderBy("df", "token").rowsBetween(Window.unboundedPreceding, -1)
    rare = q.withColumn("before", F.coalesce(F.sum("df").over(by_df), F.lit(0))).where(F.col("before") < seeds)
    few = held.postings.join(_small(rare.select("item_id", "token", "weight", "avgdl")), "token").groupBy("item_id", "doc_id").agg(F.sum(_part()).alias("part"))
    nth = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("part"), "doc_id"))
    named = few.withColumn("r", nth).where(F.col("r") <= 2 * k).select("item_id", "doc_id")
    known = _looked_up(named, q, held.postings).groupBy("item_id", "doc_id").agg(F.sum(_part()).alias("score"))
    nth = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score")))
    floor = known.withColumn("r", nth).where(F.col("r") == k).select("item_id", (F.col("score") - SLACK).alias("floor"))
    by_bound = Window.partitionBy("item_id").orderBy("bound", F.desc("df"), "token")
    q = q.join(floor, "item_id", "left").withColumn("below", F.sum("bound").over(by_bound))
    needed = F.coalesce(F.col("below") >= F.col("floor"), F.lit(True))
    rest = F.sum(F.when(~F.col("needed"), F.col("bound"))).over(Window.partitionBy("item_id"))
    q = q.withColumn("needed", needed).withColumn("rest", F.coalesce(rest, F.lit(0.0)))
    # The terms that aren't needed are looked up in two steps, those of the larger bounds first.
    q = staged(q.withColumn("step", F.when(F.col("needed"), 0).when(F.col("below") > F.col("rest") / 2, 1).otherwise(2)))
    terms = lambda step: q.where(F.col("step") == step)
    left = q.groupBy("item_id").agg(F.first("floor").alias("floor"), F.first("rest").alias("rest"), F.coalesce(F.sum(F.when(F.col("step") == 2, F.col("bound"))), F.lit(0.0)).alias("last"))
    left = _small(left)
    reaches = lambda bound: F.col("floor").isNull() | (F.col("part") + F.col(bound) >= F.col("floor"))
    found = held.postings.join(_small(terms(0).select("item_id", "token", "weight", "avgdl")), "token").groupBy("item_id", "doc_id").agg(F.sum(_part()).alias("part"))
    for step, bound in ((1, "rest"), (2, "last")):
        found = staged(found.join(left, "item_id").where(reaches(bound)).select("item_id", "doc_id", "part"))
        more = _looked_up(found, terms(step), held.postings).select("item_id", "doc_id", _part().alias("part"))
        found = found.unionByName(more).groupBy("item_id", "doc_id").agg(F.sum("part").alias("part"))
    total = found.select("item_id", "doc_id", F.round("part", 6).alias("score"))
    best = F.rank().over(Window.partitionBy("item_id").orderBy(F.desc("score")))
    return total.withColumn("r", best).where(F.col("r") <= k).drop("r")


def _looked_up(pairs: DataFrame, q: DataFrame, postings: DataFrame) -> DataFrame:
    """Postings of the documents of pairs(item_id, doc_id) for the terms of their queries."""
    rows = postings.join(_small(q.select("item_id", "token", "weight", "avgdl")), "token")
    return rows.join(_small(pairs.select("item_id", "doc_id")), ["item_id", "doc_id"], "left_semi")


def top_k(scored: DataFrame, k: int, by: str = "score", keys: str = "item_id", tie: str = "doc_id") -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(keys).orderBy(F.desc(by), tie))
    return scored.withColumn("rnk", rank).where(F.col("rnk") <= k)


def positive(scored: DataFrame, by: str = "score") -> DataFrame:
    return scored.where(F.col(by) > 0)


def min_max_of(scored: DataFrame, docs: DataFrame, value: str, out: str) -> DataFrame:
    """min_max within item_id over all of docs: those without a row in scored count as 0, and get none. Least and
    largest values are a row a query, so the scores themselves are not moved."""
    most = scored.groupBy(F.col("item_id").alias("_item")).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.count("*").alias("_rows"))
    some = F.col("_rows") < F.col("_n")
    most = most.crossJoin(F.broadcast(docs.agg(F.count("*").alias("_n"))))
    most = most.select("_item", F.when(some, F.least(F.lit(0.0), "_lo")).otherwise(F.col("_lo")).alias("_lo"), F.when(some, F.greatest(F.lit(0.0), "_hi")).otherwise(F.col("_hi")).alias("_hi"))
    rows = scored.join(F.broadcast(most), F.col("item_id").eqNullSafe(F.col("_item")))  # a row a query
    lo, hi = F.col("_lo"), F.col("_hi")
    return rows.withColumn(out, F.when(hi > lo, F.round((F.col(value) - lo) / (hi - lo), 6)).otherwise(0.0)).drop("_item", "_lo", "_hi")


def min_max(df: DataFrame, value: str, out: str, keys: str) -> DataFrame:
    """(x - min) / (max - min) within keys; all 0 if equal."""
    w = Window.partitionBy(keys)
    lo, hi = F.min(value).over(w), F.max(value).over(w)
    return df.withColumn(out, F.when(hi > lo, F.round((F.col(value) - lo) / (hi - lo), 6)).otherwise(0.0))


def soft_max(df: DataFrame, value: str, out: str, keys: str) -> DataFrame:
    return df.withColumn(out, F.round(F.exp(value) / F.sum(F.exp(value)).over(Window.partitionBy(keys)), 6))


def blend(name: DataFrame, code: DataFrame, docs: DataFrame, weight: float = 0.5) -> DataFrame:
    """name_sim and code_sim of all that share a term with either, blended and scaled again as sem."""
    a, b = min_max_of(name, docs, "score", "name_sim").drop("score"), min_max_of(code, docs, "score", "code_sim").drop("score")
    both = a.join(b, ["item_id", "doc_id"], "full").select("item_id", "doc_id", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("name_sim", "code_sim")])
    both = both.withColumn("_raw", weight * F.col("name_sim") + (1 - weight) * F.col("code_sim"))
    return min_max_of(both, docs, "_raw", "sem").drop("_raw")
