r"""Chat formatting in budgeted windows (DataFrame functions only).

A conversation becomes windows of whole turns. Each turn has a token count;
prefix sums of these counts, cut at multiples of what a window has left for new
turns, choose the spans: the turns that lie inside the k-th stretch form one
span, a turn that crosses its end forms a span alone. A window shows the first
system turn, then the last few turns before the span (at most
``history_turns`` and ``history_tokens``), then the span. Only the assistant
turns of the span are under the loss mask, so a turn that is repeated as
history or as system turn is never trained on twice.

Budget: a window holds at most ``max_tokens``, unless one turn alone (or the
system turn) is larger than its part; such a turn is kept whole, never cut.

Template per turn: ``<|im_start|>`` role newline text ``<|im_end|>`` newline.
Inside roles and texts, ``<``, any number n of backslashes and ``|`` gets one
backslash more, so the control strings can't occur and the step can be undone.
In roles a backslash and a newline are written as two characters.

Prefix sums take two levels, blocks of ``BLOCK`` turn numbers and then turns,
so a conversation with a third of all rows is spread over many tasks. A
window's turns are few by its budget, so only bounded groups are gathered.

Defined results: null roles and texts are empty; null turn numbers come first;
rows equal in turn number are ordered by role, then text, and repeated rows are
turns of their own; the null conversation is one conversation; an empty table
gives no windows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runlens.llm.common import column, group_key, word_count

START, END = "<|im_start|>", "<|im_end|>\n"
#: Turn numbers per block of the two-level prefix sums.
BLOCK = 256
#: Tokens that the template adds to a turn.
TURN_TOKENS = 4


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: Column) -> Column:
    # \\ -> \ and \n -> newline, left to right: a pair of backslashes is parked on a control character first
    role = F.replace(unescape(role), F.lit("\\\\"), F.lit("\\\x00"))
    return F.replace(F.replace(role, F.lit("\\n"), F.lit("\n")), F.lit("\\\x00"), F.lit("\\"))


def piece(role: Column, text: Column) -> Column:
    return F.concat(F.lit(START), escape_role(role), F.lit("\n"), escape(text), F.lit(END))


def _turns(rows: DataFrame, tokens: Callable[[Column], Column], max_tokens: int, history_tokens: int) -> DataFrame:
    """Turns with their place, prefix sum, system turn and window number."""
    text = F.coalesce(column(rows, "text").cast("string"), F.lit(""))
    role = F.coalesce(column(rows, "role").cast("string"), F.lit(""))
    turn = column(rows, "turn").cast("long")
    base = rows.select(
        column(rows, "conv_id").alias("conv_id"), group_key(column(rows, "conv_id")).alias("key"),
        turn.alias("turn"), role.alias("role"), text.alias("text"), tokens(text).cast("long").alias("tokens"),
        F.coalesce(F.floor(turn / BLOCK), F.lit(-(2**56))).alias("block"))
    order = F.struct("turn", "role", "text", "tokens")
    blocks = base.groupBy("key", "block").agg(
        F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("s"),
        F.min(F.when(F.col("role") == "system", order)).alias("system"))
    earlier = Window.partitionBy("key").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(
        "key", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n0"),
        F.coalesce(F.sum("s").over(earlier), F.lit(0)).alias("s0"),
        F.min("system").over(Window.partitionBy("key")).alias("system"))
    inside = Window.partitionBy("key", "block").orderBy("turn", "role", "text")
    running = inside.rowsBetween(Window.unboundedPreceding, 0)
    turns = base.join(blocks, ["key", "block"]).select(
        "conv_id", "key", "turn", "role", "text", "tokens", "system",
        (F.col("n0") + F.row_number().over(inside) - 1).alias("place"),
        (F.col("s0") + F.sum("tokens").over(running) - F.col("tokens")).alias("before"))
    # the system turn is one of the repeated rows if there are several: the first by place is not known here, any equal one is
    room = F.greatest(F.lit(max_tokens - history_tokens) - F.coalesce(F.col("system.tokens"), F.lit(0)),
                      F.lit(max(1, max_tokens // 8)))
    turns = turns.withColumn("room", room).withColumn("k", F.floor(F.col("before") / F.col("room")))
    crosses = F.col("before") + F.col("tokens") > (F.col("k") + 1) * F.col("room")
    return turns.withColumn("window", 2 * F.col("k") + F.when(crosses, 1).otherwise(0))


def format_windows(conversations: DataFrame, max_tokens: int = 512, history_turns: int = 2, history_tokens: int = 128,
                   tokens: Callable[[Column], Column] | None = None) -> DataFrame:
    """One row per window: conv_id, window (ascending), text, repeated (leading
    turns that are context only), n_turns, n_tokens, loss_spans (start from 0
    and length, in code points of ``text``)."""
    tokens = tokens or (lambda t: word_count(t) + TURN_TOKENS)
    turns = _turns(conversations, tokens, max_tokens, history_tokens)
    own = turns.select("conv_id", "key", "window", F.lit(2).alias("part"), "place", "role", "text", "tokens")
    spans = turns.groupBy("conv_id", "key", "window").agg(F.min("place").alias("first"), F.min("before").alias("start"))
    wanted = spans.select(
        "key", "window", "start", F.explode(F.sequence(F.lit(1), F.lit(history_turns))).alias("d"), "first",
    ).select("key", F.col("window").alias("to_window"), "start", (F.col("first") - F.col("d")).alias("place")).where("place >= 0") \
        if history_turns > 0 else None
    parts = own
    if wanted is not None:
        seen = turns.join(wanted, ["key", "place"])
        near = (F.col("start") - F.col("before") <= history_tokens) & ~F.coalesce(
            F.struct("turn", "role", "text").eqNullSafe(F.struct("system.turn", "system.role", "system.text")), F.lit(False))
        parts = parts.unionByName(seen.where(near).select(
            "conv_id", "key", F.col("to_window").alias("window"), F.lit(1).alias("part"), "place", "role", "text", "tokens"))
    # the system turn stands in every window but the one whose span holds it
    held = F.min(F.when(
        F.struct("turn", "role", "text").eqNullSafe(F.struct("system.turn", "system.role", "system.text")), F.col("window")))
    heads = turns.groupBy("key").agg(F.first("system", ignorenulls=True).alias("system"), held.alias("held")).where("system is not null")
    head_rows = spans.join(heads, "key").where(F.col("window") != F.col("held")).select(
        "conv_id", "key", "window", F.lit(0).alias("part"), F.lit(-1).cast("long").alias("place"),
        F.col("system.role").alias("role"), F.col("system.text").alias("text"), F.col("system.tokens").alias("tokens"))
    parts = parts.unionByName(head_rows).withColumn("piece", piece(F.col("role"), F.col("text"))).select(
        "conv_id", "key", "window", "tokens", F.struct(
            "part", "place", "piece", F.length("piece").alias("size"),
            # code points before the text: marker, role and newline
            (F.lit(len(START) + 1) + F.length(escape_role(F.col("role")))).alias("lead"),
            ((F.col("part") == 2) & (F.col("role") == "assistant")).alias("loss")).alias("t"))
    grouped = parts.groupBy("conv_id", "key", "window").agg(
        F.array_sort(F.collect_list("t")).alias("ts"), F.sum("tokens").alias("n_tokens"))
    # starts of the turns in the window's text, carried along one pass over its few turns
    spans_of = F.aggregate(
        "ts", F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans")),
        lambda a, t: F.struct(
            (a["at"] + t["size"]).alias("at"),
            F.when(t["loss"], F.array_append(a["spans"], F.struct(
                (a["at"] + t["lead"]).alias("start"),
                (t["size"] - t["lead"] - len(END)).alias("length")))).otherwise(a["spans"]).alias("spans")),
        lambda a: a["spans"])
    return grouped.select(
        "conv_id", "window", F.array_join(F.transform("ts", lambda t: t["piece"]), "").alias("text"),
        F.size(F.filter("ts", lambda t: t["part"] < 2)).alias("repeated"), F.size("ts").alias("n_turns"),
        "n_tokens", spans_of.alias("loss_spans"))


def read_turns(window_text: Column, repeated: Column) -> Column:
    """The window's new turns, parsed and unescaped: array of (role, text)."""
    parts = F.split(window_text, r"<\|im_start\|>")  # the first is what stands before the first marker: nothing
    bare = F.transform(F.slice(parts, repeated + 2, F.size(parts)), lambda p: p.substr(F.lit(1), F.length(p) - len(END)))
    return F.transform(bare, lambda p: F.struct(
        unescape_role(F.substring_index(p, "\n", 1)).alias("role"),
        unescape(p.substr(F.locate("\n", p) + 1, F.length(p))).alias("text")))


def read_loss(window_text: Column, spans: Column) -> Column:
    """The texts under the loss mask, unescaped: array of strings."""
    return F.transform(spans, lambda s: unescape(window_text.substr(s["start"] + 1, s["length"])))
