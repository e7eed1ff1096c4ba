"""Mixing sources to target weights along a curriculum of changing source weights. DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import GAP, field, hash_bucket, materialize, packed, prefix_sums, unpacked, word_count


@dataclass(frozen=True)
class MixPlan:
    """Sources by code point, null last, take `weights` in turn and share `share` of all sizes; no source exceeds `cap`
    times its size. schedule: for each weight, the source's rate at the begin and at the end of training, linear
    between."""

    weights: tuple[float, ...] = (5.0, 2.0, 1.0)
    share: float = 1.5
    cap: float = 2.0
    schedule: tuple[tuple[float, float], ...] = ((1.5, 0.5), (1.0, 1.0), (0.5, 1.5))


def source_targets(sizes: DataFrame, plan: MixPlan) -> DataFrame:
    """From (source, source_size): target, w0 and w1. Runs over one row a source.

    Water filling in closed form: by rising cap / weight, a source is capped if its cap is at most the level that the
    sources before it leave; the others get weight times the level of the first uncapped one.
    """
    pick = lambda values: F.element_at(F.array(*[F.lit(float(v)) for v in values]), (F.pmod(F.col("n") - 1, F.lit(len(values))) + 1).cast("int"))
    s = sizes.withColumn("n", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    s = s.withColumns({"weight": pick(plan.weights), "w0": pick([a for a, _ in plan.schedule]), "w1": pick([b for _, b in plan.schedule]), "limit": plan.cap * F.col("source_size")})
    order = Window.orderBy(F.col("limit") / F.col("weight"), "n")
    before, after, every = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing), order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = plan.share * F.sum("source_size").over(every) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))
    s = s.withColumn("level", left / F.sum("weight").over(after))
    s = s.withColumn("capped", F.col("limit") <= F.col("level") * F.col("weight"))
    s = s.withColumn("at", F.first(F.when(~F.col("capped"), F.col("level")), ignorenulls=True).over(every))
    target = F.when(F.col("capped"), F.col("limit")).otherwise(F.least("limit", F.col("at") * F.col("weight")))
    return s.select("source", "source_size", target.alias("target"), "w0", "w1")


def when_consumed(share: Column, w0: Column, w1: Column) -> Column:
    """Time in [0, 1] at which a source has given this share of its target: the inverse of the integral of its rate."""
    mean = (w0 + w1) / 2
    return F.when(share > 0, 2 * share * mean / (w0 + F.sqrt(F.greatest(F.lit(0.0), w0 * w0 + 2 * (w1 - w0) * share * mean)))).otherwise(0.0)


def _planned(docs: DataFrame, plan: MixPlan, carry: bool) -> DataFrame:
    """The columns of plan_mix, and at, w0, w1; with carry also `row`, all columns of docs, which can't clash with them.
    Words are counted once and written; rows with their texts are read once more only where they are carried."""
    d = packed(docs).select("row", *[field(docs, c).alias(c) for c in ("doc_id", "source")], field(docs, "text").cast("string").alias("_text"))
    d = d.select("row", "doc_id", "source", word_count(F.col("_text")).alias("size"), F.xxhash64("doc_id", F.xxhash64("_text")).alias("u"))
    d = d.withColumn("b", hash_bucket(F.col("u")))
    narrow = materialize(d.drop("row"))
    t = source_targets(narrow.groupBy("source").agg(F.sum("size").cast("double").alias("source_size")), plan)
    t = t.select(F.col("source").alias("t_source"), F.col("source_size").alias("total"), "target", "w0", "w1")
    d = prefix_sums(d if carry else narrow, ["source"], ["u", "doc_id", "size"], "b", {"at": "size"}, narrow)
    j = d.join(t, F.col("source").eqNullSafe(F.col("t_source")))
    full = F.when(F.col("total") > 0, F.floor(F.col("target") / F.col("total"))).otherwise(0)
    rest = F.floor(F.col("target")) - full * F.col("total").cast("long")
    extra = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("at")))
    j = j.withColumns({"full": full.cast("long"), "extra": extra.cast("long")})
    taken = F.col("full") * F.col("size") + F.col("extra")
    position = F.when(taken > 0, when_consumed(F.col("at") / F.col("target"), F.col("w0"), F.col("w1")))
    return j.select(
        *(["row"] if carry else []), "doc_id", "source", "size", F.col("total").cast("long").alias("source_size"), "target", taken.alias("taken"), position.alias("position"), "full", "extra", "at", "w0", "w1"
    )


def plan_mix(docs: DataFrame, plan: MixPlan = MixPlan()) -> DataFrame:
    """doc_id, source, size, source_size, target, taken (words), position in training, full (whole repeats) and extra (words of a
    partial one) for documents(doc_id, text, source).

    Documents of a source stand in the order of a hash; running word counts (by hash buckets, so a hot source is spread
    over tasks) give what each takes: whole repeats first, then the remainder of the target from the start of the
    order, the last document in part. So a source takes its target exactly, rounded down. position: the time at which
    the schedule reaches the document's first word; null if nothing is taken. Null texts have size 0; null source is a
    source; repeated rows are documents of their own; an empty table stays empty; other columns are ignored, whatever
    their names.
    """
    return _planned(docs, plan, False).drop("at", "w0", "w1")


def mixed_documents(docs: DataFrame, plan: MixPlan = MixPlan()) -> DataFrame:
    """The mix itself, range-sorted by training position: a row for each repeat of a document, with the columns of docs,
    whatever their names; n_chars follows the text.

    A repeat that takes only part of a document holds its first words (joined by single spaces). Documents without words
    are in no mix; nulls, repeated rows and empty tables as in plan_mix.
    """
    p = _planned(docs, plan, True)
    repeats = F.when(F.col("taken") > 0, F.sequence(F.lit(0), (F.col("full") - F.when(F.col("extra") > 0, 0).otherwise(1)).cast("int")))
    p = p.withColumn("epoch", F.explode(repeats))
    part = (F.col("epoch") == F.col("full")) & (F.col("extra") < F.col("size"))
    share = (F.col("at") + F.col("epoch") * F.col("source_size")) / F.col("target")
    p = p.withColumns({"position": when_consumed(share, F.col("w0"), F.col("w1")), "new": F.when(part, _first_words(field(docs, "text"), F.col("extra")))})
    p = p.repartitionByRange(F.col("position")).sortWithinPartitions("position", "doc_id", "epoch")
    whole = F.col("new").isNull()
    changed = {"text": F.coalesce("new", field(docs, "text")), "n_chars": F.when(whole, field(docs, "n_chars")).otherwise(F.length("new")).cast(dict(docs.dtypes).get("n_chars", "long"))}
    return unpacked(p, docs, **changed)


def _first_words(text: Column, n: Column) -> Column:
    """The first n words, joined by single spaces."""
    words = F.filter(F.split(text, GAP), lambda w: w != "")
    return F.array_join(F.slice(words, F.lit(1), n.cast("int")), " ")
