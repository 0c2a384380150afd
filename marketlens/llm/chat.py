"""Chat formatting with DataFrame functions only: budgeted windows of turns.

Template (fixed): every turn is ``[INST] role [/INST] text</s>``. Control
strings begin with ``[`` or ``<``; inside roles and texts a backslash becomes
``\\0``, ``<`` becomes ``\\1`` and ``[`` becomes ``\\2``, so no control string can
occur there, and reading back is exact.

A conversation's turns are ordered by (turn, role, text). Prefix sums of the
turns' tokens (words and marks) choose windows: a window takes whole new turns
while system turn, history and new turns stay within ``budget`` tokens, and at
least one. Each window begins with the conversation's system turn (if its first
turn is one) and as many whole turns before its first new turn as fit into
``history`` tokens. Repeated turns are masked; the loss mask holds the texts of
the new turns of ``target`` role, so each such text is a target exactly once.

Rows meet once, by conversation (one shuffle); the prefix sums are a window
function there, and everything after is array work in the conversation's row. A conversation is one training example, so its turns must meet in
one row whatever the method; nothing else is gathered.

Defined cases: null text is empty, a null role is empty; a null turn number
comes first; equal rows are turns of their own; a null conversation id is a
conversation; a turn above the budget is a window of its own, uncut; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The template.
OPEN, CLOSE, END = "[INST] ", " [/INST] ", "</s>"
ESCAPES = (("\\", "\\0"), ("<", "\\1"), ("[", "\\2"))
TOKEN = r"\w+|[^\w\s]"
MARKUP = 2  # tokens that a turn costs besides those of its text


def escape(text: Column) -> Column:
    for plain, code in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for plain, code in reversed(ESCAPES):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def _turns(conversations: DataFrame) -> DataFrame:
    """One row per conversation: its turns in order, each with the tokens of
    all turns before it (``before``) and of it and those (``upto``)."""
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role"), F.lit("")).alias("role"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )
    rows = rows.withColumn("size", F.regexp_count("text", F.lit(TOKEN)).cast("long") + MARKUP)
    in_order = (
        Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, 0)
    )
    rows = rows.withColumn("upto", F.sum("size").over(in_order))
    turn = F.struct("turn", "upto", "role", "text", (F.col("upto") - F.col("size")).alias("before"))
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))


def format_windows(
    conversations: DataFrame, budget: int = 512, history: int = 128, target: str = "assistant"
) -> DataFrame:
    """One row per window: conv_id, window (from 0), formatted, loss_spans
    (array of start and length in ``formatted``, code points), n_repeated
    (turns at its head that are no new ones), n_tokens."""
    base = _turns(conversations)
    n = F.size("turns")
    turn = lambda i: F.get(F.col("turns"), i)
    has_system = turn(F.lit(0))["role"] == "system"
    base = base.withColumn("lead", F.when(has_system, F.lit(1)).otherwise(F.lit(0)))
    head = F.when(F.col("lead") == 1, turn(F.lit(0))["upto"]).otherwise(F.lit(0).cast("long"))

    def first_repeated(begin: Column) -> Column:
        """The earliest turn from which the history up to ``begin`` fits. Every
        turn has MARKUP tokens or more, so a bounded look back is enough."""
        new = turn(begin)
        room = F.least(F.lit(history).cast("long"), budget - head - (new["upto"] - new["before"]))
        back = F.sequence(F.greatest(F.col("lead"), begin - history // MARKUP), begin)
        return F.coalesce(F.array_min(F.filter(back, lambda i: new["before"] - turn(i)["before"] <= room)), begin)

    def cut(acc: Column, i: Column) -> Column:
        """acc: the windows so far; turn i opens one if it no longer fits."""
        last = F.element_at(acc, -1)
        kept = F.when(last["begin"] == 0, F.lit(0).cast("long")).otherwise(head)
        used = kept + turn(i)["upto"] - turn(last["from"])["before"]
        fresh = F.struct(i.alias("begin"), first_repeated(i).alias("from"))
        return F.when(used > budget, F.concat(acc, F.array(fresh))).otherwise(acc)

    opening = F.array(F.struct(F.lit(0).alias("begin"), F.lit(0).alias("from")))
    later = F.when(n > 1, F.sequence(F.lit(1), n - 1)).otherwise(F.array().cast("array<int>"))
    base = base.withColumn("windows", F.aggregate(later, opening, cut))

    def window(w: Column, i: Column) -> Column:
        lead = F.when(w["begin"] > 0, F.col("lead")).otherwise(F.lit(0))
        end = F.coalesce(F.get("windows", i + 1)["begin"], n)
        own = F.slice("turns", w["from"] + 1, end - w["from"])
        tokens = turn(end - 1)["upto"] - turn(w["from"])["before"] + F.when(lead == 1, head).otherwise(0)
        return F.struct(
            F.concat(F.slice("turns", F.lit(1), lead), own).alias("parts"),
            (lead + w["begin"] - w["from"]).alias("n_repeated"),
            tokens.alias("n_tokens"),
        )

    rows = base.select("conv_id", F.posexplode(F.transform("windows", window)).alias("window", "w"))
    rows = rows.select("conv_id", "window", "w.parts", "w.n_repeated", "w.n_tokens")
    pieces = F.transform(
        "parts",
        lambda t, i: F.struct(
            F.concat(F.lit(OPEN), escape(t["role"]), F.lit(CLOSE)).alias("head"),
            escape(t["text"]).alias("body"),
            ((i >= F.col("n_repeated")) & (t["role"] == target)).alias("loss"),
        ),
    )
    rows = rows.withColumn("pieces", pieces)
    spans = F.aggregate(
        "pieces",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans")),
        lambda acc, p: F.struct(
            (acc["at"] + F.length(p["head"]) + F.length(p["body"]) + len(END)).alias("at"),
            F.when(
                p["loss"],
                F.concat(
                    acc["spans"],
                    F.array(
                        F.struct(
                            (acc["at"] + F.length(p["head"])).alias("start"), F.length(p["body"]).alias("length")
                        )
                    ),
                ),
            )
            .otherwise(acc["spans"])
            .alias("spans"),
        ),
        lambda acc: acc["spans"],
    )
    text = F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"], F.lit(END))), "")
    return rows.select(
        "conv_id",
        "window",
        text.alias("formatted"),
        spans.alias("loss_spans"),
        "n_repeated",
        "n_tokens",
    )


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>> of a formatted window."""
    chunks = F.filter(F.split(formatted, END, -1), lambda c: c != "")
    return F.transform(
        chunks,
        lambda c: F.struct(
            unescape(F.substring_index(F.substr(c, F.lit(len(OPEN) + 1)), CLOSE, 1)).alias("role"),
            unescape(F.substr(c, F.instr(c, CLOSE) + len(CLOSE))).alias("text"),
        ),
    )


def read_targets(formatted: Column, loss_spans: Column) -> Column:
    """The unescaped texts under the loss mask, in order, nothing between."""
    return F.array_join(
        F.transform(loss_spans, lambda s: unescape(F.substr(formatted, s["start"] + 1, s["length"]))), ""
    )
