"""Chat formatting: turn-aligned windows of a token budget, and the way back. DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import only_columns, prefix_sums, word_count

#: Turns of this many successive turn numbers are summed together before prefix sums run over a conversation.
TURN_BLOCK = 64


@dataclass(frozen=True)
class WindowBudget:
    """Tokens a window may hold, tokens of it for repeated history, tokens that a turn's marks cost."""

    tokens: int = 2048
    history: int = 256
    marks: int = 4


def escape(c: Column) -> Column:
    r"""Puts a backslash before each `\`, `#` and `<`, so that no mark of the template can arise in a text."""
    return F.regexp_replace(c, r"([\\#<])", r"\\$1")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)\\(.)", "$1")


HEAD, AFTER_ROLE, TAIL = "### ", ": ", "</turn>\n"


def format_windows(conversations: DataFrame, budget: WindowBudget = WindowBudget()) -> DataFrame:
    """Windows of each conversation(conv_id, turn, role, text).

    A turn is rendered as `### role: text</turn>` and a newline, control characters in role and text escaped. Prefix
    sums of turn tokens put each turn into a window: with room = tokens - history - system turn, a turn that lies inside
    one stretch of `room` tokens goes to that stretch's window, one that straddles stretches to a window of its own. So
    a window exceeds the budget only if a single turn does. Each window begins with the system turn (the first turn, if
    its role is system) and repeats the turns before it that fit into `history` tokens; only the first appearance of an
    assistant turn is under the loss mask.

    Returns conv_id, window (long, rising), n_tokens, formatted, and turns: array of (seq, role_start, role_len, start,
    len, repeated, loss) with offsets in code points of formatted. Null roles and texts count as empty; a null conv_id
    is a conversation; turns are ordered by (turn, role, text), nulls first; repeated rows are turns of their own; an
    empty table gives no windows; other columns are ignored. No task needs a whole conversation.
    """
    rows = only_columns(conversations, "conv_id", "turn", "role", "text").select(
        "conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    rows = rows.withColumns({"tokens": word_count(F.col("text")) + budget.marks, "one": F.lit(1).cast("long"), "block": F.coalesce(F.floor(F.col("turn") / TURN_BLOCK), F.lit(-(2**62)))})
    rows = prefix_sums(rows, ["conv_id"], ["turn", "role", "text"], "block", {"at": "tokens", "seq": "one"}).select("conv_id", "seq", "at", "tokens", "role", "text")
    is_system = (F.col("seq") == 0) & (F.col("role") == "system")
    system = rows.where(is_system).select(F.col("conv_id").alias("s_conv"), F.col("tokens").alias("s_tokens"), F.col("role").alias("s_role"), F.col("text").alias("s_text"))
    lengths = system.select(F.col("s_conv").alias("l_conv"), F.col("s_tokens").alias("l_tokens"))
    said = rows.where(~is_system).join(lengths, F.col("conv_id").eqNullSafe(F.col("l_conv")), "left")
    skip = F.coalesce("l_tokens", F.lit(0))
    said = said.withColumns({"at": F.col("at") - skip, "room": F.greatest(F.lit(1), budget.tokens - budget.history - skip)})
    cell = lambda x: F.floor(x / F.col("room"))
    said = said.withColumn("window", cell(F.col("at")) + cell(F.col("at") + F.col("tokens") - 1)).drop("l_conv", "l_tokens", "room")

    windows = said.groupBy("conv_id", "window").agg(F.min("at").alias("w_at")).withColumnRenamed("conv_id", "w_conv")
    first = said.groupBy("conv_id").agg(F.min("window").alias("first")).withColumnRenamed("conv_id", "f_conv")
    # A turn is history of the windows that begin at most `history` tokens after its start: matched by stretches of
    # that length, so the join has few rows per key.
    step = budget.history
    spots = windows.withColumn("h", F.explode(F.array(F.floor(F.col("w_at") / step), F.floor(F.col("w_at") / step) - 1)))
    past = said.drop("window").withColumn("h", F.floor((F.col("at") + F.col("tokens")) / step)).alias("t")
    near = F.col("conv_id").eqNullSafe(F.col("w_conv")) & (F.col("t.h") == F.col("w.h"))
    history = past.join(spots.alias("w"), near).where((F.col("at") + F.col("tokens") <= F.col("w_at")) & (F.col("at") >= F.col("w_at") - step))
    lead = system.join(windows, F.col("s_conv").eqNullSafe(F.col("w_conv")), "left").join(first, F.col("s_conv").eqNullSafe(F.col("f_conv")), "left")

    shape = lambda df, window, repeated: df.select("conv_id", window.alias("window"), "seq", "role", "text", "tokens", repeated.alias("repeated"))
    parts = shape(said, F.col("window"), F.lit(False))
    parts = parts.union(shape(history, F.col("window"), F.lit(True)))
    lead = lead.select(F.col("s_conv").alias("conv_id"), "window", "first", F.lit(0).cast("long").alias("seq"), F.col("s_role").alias("role"), F.col("s_text").alias("text"), F.col("s_tokens").alias("tokens"))
    parts = parts.union(shape(lead, F.coalesce("window", F.lit(0)), F.coalesce(F.col("window") > F.col("first"), F.lit(False))))

    turn = F.struct("seq", "repeated", (F.col("role") == "assistant").alias("assistant"), "tokens", escape(F.col("role")).alias("role"), escape(F.col("text")).alias("body"))
    grouped = parts.groupBy("conv_id", "window").agg(F.sort_array(F.collect_list(turn)).alias("ts"))
    around = len(HEAD), len(AFTER_ROLE), len(TAIL)
    text = F.array_join(F.transform("ts", lambda t: F.concat(F.lit(HEAD), t["role"], F.lit(AFTER_ROLE), t["body"], F.lit(TAIL))), "")
    grouped = grouped.withColumn("ends", F.transform("ts", lambda t: F.length(t["role"]) + F.length(t["body"]) + sum(around)))
    # Running offsets; a window holds few turns, as each costs its marks.
    grouped = grouped.withColumn("begins", F.transform("ends", lambda x, i: F.aggregate(F.slice("ends", F.lit(1), i), F.lit(0), lambda a, y: a + y)))

    def span(t: Column, i: Column) -> Column:
        role_at = F.get("begins", i) + around[0]
        return F.struct(
            t["seq"].alias("seq"), role_at.alias("role_start"), F.length(t["role"]).alias("role_len"), (role_at + F.length(t["role"]) + around[1]).alias("start"),
            F.length(t["body"]).alias("len"), t["repeated"].alias("repeated"), (t["assistant"] & ~t["repeated"]).alias("loss"),
        )

    total = F.aggregate("ts", F.lit(0).cast("long"), lambda a, t: a + t["tokens"])
    return grouped.select("conv_id", "window", total.alias("n_tokens"), text.alias("formatted"), F.transform("ts", span).alias("turns"))


def read_back(windows: DataFrame) -> DataFrame:
    """(conv_id, seq, role, text, loss): each turn once, read from the formatted text by its offsets and unescaped."""
    cut = lambda at, n: unescape(F.substring(F.col("formatted"), at + 1, n))
    turns = F.transform(
        F.filter("turns", lambda t: ~t["repeated"]),
        lambda t: F.struct(t["seq"].alias("seq"), cut(t["role_start"], t["role_len"]).alias("role"), cut(t["start"], t["len"]).alias("text"), t["loss"].alias("loss")),
    )
    return windows.select("conv_id", F.explode(turns).alias("t")).select("conv_id", "t.*")


def digests(windows: DataFrame) -> DataFrame:
    """Per conversation, what its windows hold. A digest of a whole conversation needs its text in one value; this
    is for verification, formatting itself never gathers a conversation."""
    turns = read_back(windows).groupBy("conv_id").agg(F.count("*").alias("n_turns"), F.sort_array(F.collect_list(F.struct("seq", "role", "text", "loss"))).alias("ts"))
    said = F.array_join(F.transform("ts", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("ts", lambda t: t["loss"]), lambda t: t["text"]), "")
    sizes = windows.groupBy("conv_id").agg(F.sum(F.length("formatted")).cast("long").alias("formatted_chars"), F.count("*").alias("n_windows"))
    turns = turns.select(F.col("conv_id").alias("t_conv"), "n_turns", F.sha2(said, 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"))
    return sizes.join(turns, F.col("conv_id").eqNullSafe(F.col("t_conv"))).drop("t_conv")
