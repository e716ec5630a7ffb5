"""Chat formatting by prefix-target expansion: every assistant turn is an example, with all turns before it as context and only it trained on.

A turn is written ``<|turn|>role<|text|>text<|end|>``. Inside roles and texts, every string that could pass for a control string (of this
template or of common others) gets a backslash behind its first character; where backslashes stand there already, one is added, so undoing
it is exact. An example is the formatted turns up to its target; ``loss_start`` and ``loss_chars`` give the code points of the target's
text in it. A conversation that does not end with an assistant has one more example, without a target, so that no turn is lost.

Only DataFrame functions are used. Turns are collected by conversation with one shuffle, and what follows keeps that partitioning. A conversation
is one row, because its last example is one text that holds all of it; every example is the beginning of that text, so what is carried to
the examples is this text and where they end.

Other columns are not looked at, whatever their names. Null role and null text are empty. Turns of one number are in the order of role, then text. A null conv_id is a conversation of its own.
A conversation without assistant turns has only the example without a target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quireline.llm.columns import named

TURN, TEXT, END, TARGET = "<|turn|>", "<|text|>", "<|end|>", "assistant"
#: What may follow ``<`` or ``[`` in a control string.
_REST = r"(\||/?s>|/?INST\]|</?SYS>>)"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])(\\*)" + _REST, r"$1\\$2$3")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\(\\*)" + _REST, r"$1$2$3")


def expand(turns: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", target: str = TARGET) -> DataFrame:
    """Per example: conv_id, example (from 1), n_examples, n_turns, formatted, loss_start (from 0), loss_chars; the last two are 0 without a target."""
    row = F.struct(named(turn).alias("turn"), F.coalesce(named(role), F.lit("")).alias("role"), F.coalesce(named(text), F.lit("")).alias("text"))
    whole = turns.groupBy(named(conv_id).alias("conv_id")).agg(F.array_sort(F.collect_list(row)).alias("rows"))
    head = lambda t: F.concat(F.lit(TURN), escaped(t["role"]), F.lit(TEXT))
    parts = whole.select("conv_id", F.transform("rows", lambda t: F.struct(head(t).alias("head"), escaped(t["text"]).alias("body"), (t["role"] == target).alias("own"))).alias("parts"))
    # where each turn ends in the text of all, and which of them end an example
    start = F.struct(F.lit(0).alias("end"), F.array().cast("array<struct<n_turns:int,end:int,loss_start:int,loss_chars:int>>").alias("turns"))

    def place(acc: Column, p: Column) -> Column:
        text_at = acc["end"] + F.length(p["head"])
        end = text_at + F.length(p["body"]) + len(END)
        one = F.struct((F.size(acc["turns"]) + 1).alias("n_turns"), end.alias("end"), F.when(p["own"], text_at).otherwise(0).alias("loss_start"), F.when(p["own"], F.length(p["body"])).otherwise(0).alias("loss_chars"))
        return F.struct(end.alias("end"), F.concat(acc["turns"], F.array(one)).alias("turns"))

    held = parts.select(
        "conv_id",
        F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"], F.lit(END))), "").alias("all"),
        F.size("parts").alias("size"),
        F.transform("parts", lambda p: p["own"]).alias("own"),
        F.aggregate("parts", start, place, lambda acc: acc["turns"]).alias("turns"),
    )
    ends = F.filter("turns", lambda t, i: F.element_at("own", i + 1) | (i == F.col("size") - 1))
    each = held.select("conv_id", "all", ends.alias("ends")).select("conv_id", "all", F.size("ends").alias("n_examples"), F.posexplode("ends").alias("pos", "at"))
    return each.select("conv_id", (F.col("pos") + 1).alias("example"), "n_examples", "at.n_turns", F.substring("all", F.lit(1), F.col("at.end")).alias("formatted"), "at.loss_start", "at.loss_chars")


def turns_of(formatted: Column) -> Column:
    """Array of (role, text) read back from a formatted example."""
    pieces = F.filter(F.split(formatted, r"<\|turn\|>"), lambda p: p != "")

    def parted(piece: Column) -> Column:
        role = F.substring_index(piece, TEXT, 1)
        body = F.substring(piece, F.length(role) + len(TEXT) + 1, F.length(piece) - F.length(role) - len(TEXT) - len(END))
        return F.struct(unescaped(role).alias("role"), unescaped(body).alias("text"))

    return F.transform(pieces, parted)


def trained_text(formatted: Column, start: Column, chars: Column) -> Column:
    return unescaped(F.substring(formatted, start + 1, chars))


def report(examples: DataFrame) -> DataFrame:
    """Per conversation, read back from its examples: turns, text under the loss masks, and characters of all examples."""
    last = F.col("example") == F.col("n_examples")
    read = examples.select(
        "conv_id",
        "example",
        F.when(last, turns_of(F.col("formatted"))).alias("turns"),
        trained_text(F.col("formatted"), F.col("loss_start"), F.col("loss_chars")).alias("piece"),
        F.length("formatted").cast("long").alias("chars"),
    )
    joined = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    small = read.select("conv_id", "example", F.size("turns").cast("long").alias("n_turns"), F.sha2(joined, 256).alias("turns_sha256"), "piece", "chars")
    pieces = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("example", "piece"))), lambda p: p["piece"]), "")
    return (
        small.groupBy("conv_id")
        .agg(
            F.max("n_turns").alias("n_turns"),
            F.max("turns_sha256").alias("turns_sha256"),
            F.sum(F.length("piece")).cast("long").alias("loss_chars"),
            F.sha2(pieces, 256).alias("loss_sha256"),
            F.sum("chars").alias("formatted_chars"),
        )
    )
