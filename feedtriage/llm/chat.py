r"""Chat formatting with Spark expressions only.

The turns of a conversation are collected as structs and sorted; adjacent turns of
one role become one block; blocks are concatenated::

    <|start|>role\ntext<|next|>text<|end|>\n

Control strings inside roles and texts get a backslash after their first character,
and backslashes are doubled, so the output can be parsed back exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

START, NEXT, END, BREAK = "<|start|>", "<|next|>", "<|end|>", "<|nl|>"
#: Starts of control strings: those of this template and those of common other ones.
CONTROL = r"<(?=\|[a-z_]+\|>|/?s>|</?SYS>>)|\[(?=/?INST\])"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), CONTROL, r"$0\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_chats(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """One row per conv_id: conv_id, formatted, loss_spans (code points, end exclusive).

    Turns are in the order of turn, then role, then text, nulls first; repeated rows
    stay. Null text and null role are empty. Rows of a null conv_id are one
    conversation. Other columns are not read. An empty table gives an empty result.
    A conversation is one output value, so it must fit into one.
    """
    clean = turns.select("conv_id", F.struct(
        "turn", F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    chats = clean.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    chats = chats.withColumn("starts", F.filter(
        F.sequence(F.lit(0), F.size("turns") - 1),
        lambda i: (i == 0) | (F.col("turns")[i]["role"] != F.col("turns")[i - 1]["role"])))

    def block(start: Column, k: Column) -> Column:
        after = F.when(k + 1 < F.size("starts"), F.col("starts")[k + 1]).otherwise(F.size("turns"))
        return F.struct(F.col("turns")[start]["role"].alias("role"),
                        F.slice("turns", start + 1, after - start)["text"].alias("texts"))

    def pieces(b: Column) -> Column:
        """The block as (content, under the loss) pieces; their contents add up to it."""
        head = F.concat(F.lit(START), F.replace(escape(b["role"]), F.lit("\n"), F.lit(BREAK)), F.lit("\n"))
        body = F.transform(b["texts"], lambda t, i: F.struct(
            F.when(i == 0, head).otherwise(F.lit(NEXT)).alias("before"), escape(t).alias("content"),
            F.when(i + 1 == F.size(b["texts"]), F.lit(END + "\n")).otherwise(F.lit("")).alias("after"),
            (b["role"] == loss_role).alias("loss")))
        return body

    chats = chats.select("conv_id", F.transform("starts", block).alias("blocks"))
    chats = chats.select("conv_id", F.flatten(F.transform("blocks", pieces)).alias("pieces"))
    text = F.concat_ws("", F.transform("pieces", lambda p: F.concat(p["before"], p["content"], p["after"])))
    spans = F.aggregate(
        "pieces", F.struct(F.lit(0).alias("at"), F.expr("array_repeat(struct(0 as start, 0 as end), 0)").alias("spans")),
        lambda acc, p: F.struct(
            (acc["at"] + F.length(p["before"]) + F.length(p["content"]) + F.length(p["after"])).alias("at"),
            F.when(p["loss"], F.concat(acc["spans"], F.array(F.struct(
                (acc["at"] + F.length(p["before"])).alias("start"),
                (acc["at"] + F.length(p["before"]) + F.length(p["content"])).alias("end")))))
            .otherwise(acc["spans"]).alias("spans")),
        lambda acc: acc["spans"])
    return chats.select("conv_id", text.alias("formatted"), spans.alias("loss_spans"))


def parse_chat(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation."""
    blocks = F.filter(F.split(formatted, r"<\|end\|>\n", -1), lambda b: b != "")

    def turns(b: Column) -> Column:
        role = F.substring_index(F.substr(b, F.lit(len(START) + 1)), "\n", 1)
        body = F.substr(b, F.lit(len(START) + 2) + F.length(role))
        name = unescape(F.replace(role, F.lit(BREAK), F.lit("\n")))
        return F.transform(F.split(body, r"<\|next\|>", -1),
                           lambda t: F.struct(name.alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss, unescaped."""
    return F.concat_ws("", F.transform(spans, lambda s: unescape(
        F.substr(formatted, s["start"] + 1, s["end"] - s["start"]))))
