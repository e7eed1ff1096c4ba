"""Quality rules: base rules of a text, and cross-document line frequency per host. DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, bounded, field, let, only_columns, packed, unpacked, word_array

SYMBOLS = "[#*$%&|<>]"


@dataclass(frozen=True)
class LineLimits:
    """A line is boilerplate of its host if more than min_documents different texts of the host, and more than
    max_share of them, hold it. A document is depleted if fewer than min_words words or less than min_left of its
    words are left."""

    min_documents: int = 10
    max_share: float = 0.1
    min_words: int = 50
    min_left: float = 0.3


def has_word(line: Column) -> Column:
    return F.length(F.btrim(line, F.lit(BLANKS))) > 0


def repeated_window_words(positions: Column) -> Column:
    """Words covered by windows at the given rising positions (3 words each)."""
    return F.aggregate(
        positions,
        F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")),
        lambda a, p: F.struct((a["n"] + F.least(F.lit(3), p - a["last"])).alias("n"), p.alias("last")),
        lambda a: a["n"],
    )


def base_metrics(docs: DataFrame) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) and base_failed to doc_id, source, text.

    Windows of three words are compared by a 64-bit hash, sorted with their positions: n log n, no pairs.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = let(F.filter(F.split(text, "\n"), has_word), lambda x: F.size(x) - F.size(F.array_distinct(x)))

    def windows(w: Column) -> Column:  # sorted (hash, position); too few words have none
        at = F.sequence(F.lit(0), F.size(w) - 3)
        each = F.transform(at, lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("p")))
        return F.sort_array(F.when(F.size(w) >= 4, each).otherwise(F.array().cast("array<struct<h: bigint, p: int>>")))

    def repeated(s: Column) -> Column:  # rising positions of windows whose hash stands beside an equal one
        near = lambda i, x: F.coalesce(F.get(s, i)["h"] == x["h"], F.lit(False))
        twice = F.filter(s, lambda x, i: near(i - 1, x) | near(i + 1, x))
        return F.sort_array(F.transform(twice, lambda x: x["p"]))

    counted = let(
        word_array(text),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            let(windows(w), lambda s: repeated_window_words(repeated(s))).cast("long").alias("n_repeat_words"),
        ),
    )
    a = docs.withColumns({"_c": counted, "n_symbols": F.regexp_count(text, F.lit(SYMBOLS)).cast("long"), "n_dup_lines": lines.cast("long")})
    a = a.withColumns({c: F.col("_c")[c] for c in ("n_words", "word_chars", "n_repeat_words")}).drop("_c")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return a.withColumn("base_failed", failed)


def line_hashes(text: Column, words: bool = False) -> Column:
    """Hash of each normalised line (lower case, runs of blanks as one space, ends trimmed), null for blank lines; with
    words, structs of line and words."""
    flat = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09\x0B-\x0D]+", " ")
    lines = F.split(F.trim(flat), " ?\n ?")
    if not words:
        return F.transform(lines, lambda x: F.when(x != "", F.xxhash64(x)))
    n = lambda x: (F.length(x) - F.length(F.replace(x, F.lit(" "))) + 1).cast("long")
    return F.transform(lines, lambda x: F.when(x != "", F.struct(F.xxhash64(x).alias("line"), n(x).alias("words"))))


def boilerplate_lines(docs: DataFrame, limits: LineLimits = LineLimits()) -> DataFrame:
    """(host, line): hashes of lines above the limits of their host. Equal texts of a host count as one document.

    Counting goes through (host, line, text) first, so a line that every document holds is summed map-side.
    """
    each = docs.select(F.col("source").alias("host"), F.xxhash64("text").alias("t"), F.array_distinct(line_hashes(F.col("text"))).alias("ls"))
    sizes = each.groupBy("host").agg(F.count_distinct("t").alias("n_texts"))
    counts = each.select("host", "t", F.explode("ls").alias("line")).where("line is not null").groupBy("host", "line").agg(F.count_distinct("t").alias("n"))
    often = counts.where(F.col("n") > limits.min_documents).alias("c")
    sizes = sizes.alias("s")
    return (
        often.join(sizes, F.col("c.host").eqNullSafe(F.col("s.host")))
        .where(F.col("n") > limits.max_share * F.col("n_texts"))
        .select(F.col("c.host").alias("host"), "line")
    )


def _removed(docs: DataFrame, limits: LineLimits) -> DataFrame:
    """(k, h, gone): for each document with boilerplate lines, their positions. k, h: what identifies its row."""
    # The lines of a document are few beside its text: only hashes and positions are dealt.
    rows = docs.select(
        F.col("doc_id").alias("k"), F.xxhash64("source", "text").alias("h"), F.col("source").alias("r_host"), F.posexplode(line_hashes(F.col("text"), words=True)).alias("p", "r")
    ).where("r is not null")
    rows = rows.select("k", "h", "r_host", "p", F.col("r.line").alias("r_line"), "r.words")
    bad = boilerplate_lines(docs, limits)
    hit = rows.join(bad, F.col("r_line").eqNullSafe(F.col("line")) & F.col("r_host").eqNullSafe(F.col("host")))
    return hit.groupBy("k", "h").agg(F.sort_array(F.collect_set(F.struct("p", "words"))).alias("gone"))


def without(text: Column, gone: Column) -> Column:
    """The text without the lines at the rising positions of gone(p, words): the stretches between them, in linear time."""
    at = lambda i: F.get(gone, i)["p"]

    def stretch(ls: Column, i: Column) -> Column:
        begin = F.when(i == 0, 0).otherwise(at(i - 1) + 1)
        end = F.when(i == F.size(gone), F.size(ls)).otherwise(at(i))
        return F.slice(ls, begin + 1, end - begin)

    return let(F.split(text, "\n"), lambda ls: F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), F.size(gone)), lambda i: stretch(ls, i))), "\n"))


def without_lines(measured: DataFrame, removed: DataFrame, limits: LineLimits, keep_lines: bool = False) -> DataFrame:
    """Adds words_left, n_lines_removed, cleaned and kept to rows with doc_id, source, text, n_words, base_failed;
    keep_lines: and gone."""
    m = measured.withColumn("_h", F.xxhash64("source", "text"))
    j = m.join(removed, m["doc_id"].eqNullSafe(removed["k"]) & (m["_h"] == removed["h"]), "left")
    lost = F.aggregate("gone", F.lit(0).cast("long"), lambda a, g: a + g["words"])
    j = j.withColumns(
        {
            "words_left": F.col("n_words") - F.coalesce(lost, F.lit(0)),
            "n_lines_removed": F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long"),
            "cleaned": F.when(F.col("gone").isNull(), F.col("text")).otherwise(without(F.col("text"), F.col("gone"))),
        }
    )
    kept = ~F.col("base_failed") & (F.col("words_left") >= limits.min_words) & (F.col("words_left") >= limits.min_left * F.col("n_words"))
    return j.withColumn("kept", kept).drop("k", "h", "_h", *([] if keep_lines else ["gone"]))


BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def quality_rules(docs: DataFrame, limits: LineLimits = LineLimits()) -> DataFrame:
    """Base rules and line frequency of documents(doc_id, text, source).

    Returns doc_id, the base columns, base_failed, kept, words_left, n_lines_removed, and cleaned, the text without its
    boilerplate lines. Null or empty texts have no words and fail the base rules; a null source is a host of its own;
    repeated rows each return a row; an empty table returns none; other columns are ignored.
    """
    d = only_columns(docs, "doc_id", "text", "source")
    j = without_lines(base_metrics(d), _removed(d, limits), limits)
    return j.select("doc_id", *BASE, "base_failed", "kept", "words_left", "n_lines_removed", "cleaned")


def keep_good(docs: DataFrame, limits: LineLimits = LineLimits()) -> DataFrame:
    """The documents that pass, without their boilerplate lines; all their columns stay, whatever their names, and n_chars
    follows the text. Null, empty and short texts fail the base rules; of repeated rows all stay or none; an empty table
    stays empty."""
    d = only_columns(docs, "doc_id", "text", "source")
    j = without_lines(base_metrics(d), _removed(d, limits), limits, keep_lines=True)
    changed = j.where("not kept or gone is not null").groupBy(F.col("doc_id").alias("k"), F.xxhash64("source", "text").alias("h")).agg(F.first("kept").alias("kept"), F.first("gone").alias("gone"))
    changed = bounded(changed, "gone")
    rows = packed(docs)
    text, key = field(docs, "text"), F.xxhash64(field(docs, "source"), field(docs, "text"))
    rows = rows.join(changed, field(docs, "doc_id").eqNullSafe(changed["k"]) & (key == changed["h"]), "left").where("coalesce(kept, true)")
    whole = F.col("gone").isNull()
    new = F.when(whole, text).otherwise(without(text, F.col("gone")))
    return unpacked(rows, docs, text=new, n_chars=F.when(whole, field(docs, "n_chars")).otherwise(F.length(new)).cast(dict(docs.dtypes).get("n_chars", "long")))
