"""Chat formatting in budgeted windows, by DataFrame functions alone.

Prefix sums of turn tokens cut each conversation into turn-aligned spans. A window holds the system turn, a
limited history repeated from the span before, and the span's own turns; only the assistant texts among the
latter are under the loss mask, so each is learned once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import materialize, n_words, prefix_sum

START, END = "<|im_start|>", "<|im_end|>"
#: New tokens that a window begins with before the next one opens, tokens of repeated history, tokens of a turn's marks.
STRIDE, HISTORY, MARKS = 1024, 256, 4
TURNS_A_BUCKET = 256


def escape(text: Column) -> Column:
    r"""Doubles backslashes and parts `<|` as `<\|`: no control string is left, and unescape() takes it back."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def escape_line(text: Column) -> Column:
    return F.replace(escape(text), F.lit("\n"), F.lit("\\n"))


def unescape(text: Column) -> Column:
    parts = F.transform(F.split(text, r"\\\\", -1), lambda p: F.replace(F.replace(p, F.lit("\\|"), F.lit("|")), F.lit("\\n"), F.lit("\n")))
    return F.array_join(parts, "\\")


def format_windows(turns: DataFrame, stride: int = STRIDE, history: int = HISTORY) -> DataFrame:
    """(conv_id, turn, role, text) -> a row per window: conv_id, window, n_context, formatted, loss_spans.

    Tokens are words of the text plus MARKS a turn. A window's own turns are those that begin in its stride,
    so of its own it holds at most stride tokens and one turn more; turns are never cut, so a long one makes a long
    window. history must not exceed stride. Context turns (the conversation's first turn if it is the system's, and at
    most history tokens and one turn) come first, on top of that. loss_spans are code points of
    formatted, end exclusive. Rows are ordered by turn, nulls first, then role and text; null roles and
    texts are empty; a null conv_id is a conversation; repeated rows are turns each. Other columns are ignored.
    """
    if not 0 <= history <= stride:
        raise ValueError("history must be at most stride")
    rows = turns.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce(F.col("conv_id").cast("string"), F.lit("null")).alias("key"), F.lit(1).cast("long").alias("one"),
    ).withColumn("tokens", n_words(F.col("text")) + MARKS)
    placed = prefix_sum(rows, "key", F.floor(F.col("turn") / TURNS_A_BUCKET), [F.col("turn"), F.col("role"), F.col("text")], {"tokens": "start", "one": "pos"})
    placed = placed.withColumn("win", F.floor(F.col("start") / F.lit(stride)))
    placed = materialize(placed.drop("one", "tokens", "turn"), "placed_turns")
    system = (F.col("pos") == 0) & (F.col("role") == "system")
    heads = materialize(placed.groupBy("key", "win").agg(F.min("start").alias("head")), "window_heads")
    turn = ["key", "conv_id", "pos", "role", "text"]

    own = placed.select(*turn, "win", F.lit(False).alias("repeated"))
    after = heads.select(F.col("key").alias("h_key"), (F.col("win") - 1).alias("h_win"), "head")
    near = placed.filter(~system).join(after, (F.col("key") == F.col("h_key")) & (F.col("win") == F.col("h_win")) & (F.col("start") >= F.col("head") - F.lit(history)))
    near = near.select(*turn, (F.col("win") + 1).alias("win"), F.lit(True).alias("repeated"))
    later = heads.filter("win > 0").select(F.col("key").alias("h_key"), F.col("win").alias("h_win"))
    kept = placed.filter(system).join(later, F.col("key") == F.col("h_key"))
    kept = kept.select(*turn, F.col("h_win").alias("win"), F.lit(True).alias("repeated"))

    windows = own.unionByName(near).unionByName(kept).groupBy("key", "conv_id", "win").agg(
        F.sort_array(F.collect_list(F.struct("pos", "repeated", "role", "text"))).alias("turns")
    )
    pieces = F.transform("turns", lambda t: F.struct(
        F.concat(F.lit(START), escape_line(t["role"]), F.lit("\n")).alias("head"), escape(t["text"]).alias("body"),
        (~t["repeated"] & (t["role"] == "assistant")).alias("loss"),
    ))
    windows = windows.select("conv_id", F.col("win").alias("window"), F.size(F.filter("turns", lambda t: t["repeated"])).alias("n_context"), pieces.alias("pieces"))
    tail = F.lit(END + "\n")
    size = lambda p: (F.length(p["head"]) + F.length(p["body"]) + len(END) + 1).cast("long")
    ends = F.aggregate("pieces", F.array(F.lit(0).cast("long")), lambda acc, p: F.concat(acc, F.array(F.element_at(acc, -1) + size(p))))
    windows = windows.withColumn("at", ends)
    spans = F.zip_with("pieces", F.slice("at", 1, F.size("pieces")), lambda p, a: F.struct(
        (a + F.length(p["head"])).alias("start"), (a + F.length(p["head"]) + F.length(p["body"])).alias("end"), p["loss"].alias("loss")
    ))
    loss_spans = F.transform(F.filter(spans, lambda s: s["loss"]), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
    formatted = F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"], tail)), "")
    return windows.select("conv_id", "window", "n_context", formatted.alias("formatted"), loss_spans.alias("loss_spans"))


def read_windows(windows: DataFrame) -> DataFrame:
    """Adds to format_windows()' rows what they say: turns, the window's own as (role, text), and loss, the text under the mask."""
    line = lambda p: F.substring_index(p, "\n", 1)
    parts = F.split("formatted", r"<\|im_start\|>", -1)
    own = F.slice(parts, F.col("n_context") + 2, F.greatest(F.size(parts), F.lit(1)))
    rest = lambda p: F.substring(p, F.length(line(p)) + 2, F.length(p) - F.length(line(p)) - 1 - len(END) - 1)
    turns = F.transform(own, lambda p: F.struct(unescape(line(p)).alias("role"), unescape(rest(p)).alias("text")))
    loss = F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))
    return windows.withColumns({"turns": turns, "loss": F.array_join(loss, "")})
