"""Base forms of nouns by rules of endings, held against the words of the corpus itself."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.documents import staged

#: Endings of plural nouns and what stands there in the singular, tried in this order.
ENDINGS = [("s", ""), ("ses", "s"), ("ves", "f"), ("xes", "x"), ("zes", "z"), ("ches", "ch"), ("shes", "sh"), ("men", "man"), ("ies", "y")]
#: Maps of up to so many words are broadcast.
BROADCAST_WORDS = 200_000


def vocabulary(tokens: DataFrame, at_least: int = 2) -> DataFrame:
    """(word, n): the words of tokens(token) that come at least so often."""
    return tokens.where("token is not null").groupBy(F.col("token").alias("word")).agg(F.count("*").alias("n")).where(F.col("n") >= at_least)


def base_forms(words: DataFrame, known: DataFrame) -> DataFrame:
    """(word, lemma) of the words(word) that have another base form: that of the first rule which gives a word of known(word).
    A word is never shorter than three letters, and words that end on `ss` or `us` are no plurals."""
    rules = F.array(*[F.struct(F.lit(i).alias("rule"), F.lit(e).alias("ending"), F.lit(to).alias("to")) for i, (e, to) in enumerate(ENDINGS)])
    w = words.select("word").distinct().where(~F.col("word").rlike("(ss|us)$"))
    tries = w.select("word", F.explode(rules).alias("r")).where(F.endswith("word", F.col("r.ending")))
    form = F.concat(F.expr("left(word, length(word) - length(r.ending))"), F.col("r.to"))
    tries = tries.select("word", form.alias("lemma"), F.col("r.rule").alias("rule")).where("length(lemma) > 2")
    hits = tries.join(known.select(F.col("word").alias("k")).distinct(), F.col("lemma") == F.col("k"), "left_semi")
    return hits.groupBy("word").agg(F.min_by("lemma", "rule").alias("lemma"))


def lemmatised(tokens: DataFrame, forms: DataFrame) -> DataFrame:
    """tokens with their token replaced by its base form, if it has one."""
    forms = staged(forms.select(F.col("word").alias("_word"), "lemma"))
    forms = F.broadcast(forms) if forms.count() <= BROADCAST_WORDS else forms
    rows = tokens.join(forms, F.col("token") == F.col("_word"), "left")
    return rows.select(*[F.coalesce("lemma", "token").alias("token") if c == "token" else c for c in tokens.columns])
