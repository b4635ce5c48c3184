"""Operator 9: chat formatting in budgeted windows, in DataFrame functions only.

Turns are written as <|turn|>role<|says|>text<|end|>. Control strings inside roles and texts, those
of this template and of other common ones, are escaped with a backslash, reversibly. Prefix sums of
the turns' tokens choose which new turns share a window: those that start and end within the same
stretch of `budget - history - system turn` tokens; a turn that crosses a stretch's end has a window
of its own (so only a turn that is larger than the budget itself exceeds it). The system turn has
a first window of its own, and every later window repeats it and as many preceding whole turns as fit `history` tokens. The loss covers the texts
of assistant turns that are new in a window; repeated ones are masked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TURN, SAYS, END = "<|turn|>", "<|says|>", "<|end|>"
#: Opening and closing strings of other chat templates.
OTHER_CONTROLS = r"(</?s>|\[/?INST\]|<</?SYS>>)"
TOKEN = r" ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+"
TURN_TOKENS = 4


def escape(text: Column) -> Column:
    """Put a backslash into or before every control string, and before every backslash."""
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(F.replace(doubled, F.lit("<|"), F.lit("<\\|")), OTHER_CONTROLS, r"\\$1")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_windows(conversations: DataFrame, budget: int = 1024, history: int = 256) -> DataFrame:
    """One row per window: conv_id, window (increasing), text, loss (array of start and end, in code points), repeated (turns at the
    start that an earlier window has), n_turns.

    Null roles and texts count as empty. Turns are in the order of (turn, role, text), nulls first; repeated rows are
    repeated turns. A null conv_id is a conversation of its own. Extra columns are ignored; an empty table gives none.
    """
    rows = conversations.select("conv_id", "turn", *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")))
    rows = rows.withColumn("cost", F.regexp_count("text", F.lit(TOKEN)) + TURN_TOKENS)
    said = F.concat(F.lit(TURN), escape(F.col("role")), F.lit(SAYS))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = rows.select("conv_id", "turn", "cost", "role", "text", F.row_number().over(order).alias("n"), said.alias("head"), escape(F.col("text")).alias("body"))
    system = (F.col("n") == 1) & (F.col("role") == "system")
    piece = F.struct("n", "head", "body", (F.col("role") == "assistant").alias("target"))
    rows = rows.select("conv_id", "n", "cost", system.alias("system"), piece.alias("piece"))
    before = Window.partitionBy("conv_id").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("conv_id").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first = F.first(F.when(F.col("system"), F.struct("cost", "piece"))).over(whole)
    rows = rows.withColumn("first", first).withColumn("start", F.coalesce(F.sum(F.when(~F.col("system"), F.col("cost"))).over(before), F.lit(0)))
    room = F.greatest(F.lit(budget - history) - F.coalesce("first.cost", F.lit(0)), F.lit(1))
    stretch, ends = F.floor(F.col("start") / room), F.floor((F.col("start") + F.col("cost") - 1) / room)
    rows = rows.withColumn("window", F.when(F.col("system"), 0).otherwise(2 * stretch + (ends > stretch).cast("int") + 1))
    back = Window.partitionBy("conv_id").orderBy("start").rangeBetween(-history, -1)
    rows = rows.withColumn("past", F.collect_list(F.when(~F.col("system"), F.col("piece"))).over(back))
    made = rows.groupBy("conv_id", "window").agg(F.array_sort(F.collect_list("piece")).alias("new"), F.min_by("past", "n").alias("past"), F.any_value("first").alias("first"))
    only_system = F.col("window") == 0
    made = made.withColumn("shown", F.when(only_system | F.col("first").isNull(), F.array().cast(made.schema["new"].dataType)).otherwise(F.array("first.piece")))
    made = made.withColumn("old", F.concat("shown", F.array_sort("past")))
    pieces = F.concat(F.transform("old", lambda x: x.withField("target", F.lit(False))), F.col("new"))
    written = lambda x: F.concat(x["head"], x["body"], F.lit(END))
    size = lambda xs: F.aggregate(xs, F.lit(0), lambda a, x: a + F.length(x["head"]) + F.length(x["body"]) + len(END))

    def spans(xs: Column) -> Column:
        at = lambda x, i: size(F.slice(xs, 1, i)) + F.length(x["head"])
        return F.filter(F.transform(xs, lambda x, i: F.when(x["target"], F.struct(at(x, i).alias("start"), (at(x, i) + F.length(x["body"])).alias("end")))), lambda s: s.isNotNull())

    made = made.withColumn("pieces", pieces)
    return made.select("conv_id", "window", F.array_join(F.transform("pieces", written), "").alias("text"), F.get(F.transform(F.array("pieces"), spans), F.lit(0)).alias("loss"), F.size("old").alias("repeated"), F.size("new").alias("n_turns"))


def read_turns(text: Column, repeated: Column) -> Column:
    """Array of (role, text) of a window's new turns, read back from its text."""
    parts = F.split(text, r"<\|end\|>")
    mine = F.slice(parts, repeated + 1, F.size(parts) - 1 - repeated)
    halves = F.transform(mine, lambda x: F.split(F.substring(x, F.lit(len(TURN) + 1), F.length(x)), r"<\|says\|>"))
    return F.transform(halves, lambda h: F.struct(unescape(F.get(h, F.lit(0))).alias("role"), unescape(F.get(h, F.lit(1))).alias("text")))


def read_loss(text: Column, loss: Column) -> Column:
    """All text under a window's loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(loss, lambda s: unescape(F.substring(text, s["start"] + 1, s["end"] - s["start"]))), "")
