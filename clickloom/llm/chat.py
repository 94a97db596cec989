"""Chat formatting by prefix-target expansion, with DataFrame functions only.

Every assistant turn becomes an example of its own: all turns before it are context, and its reply alone is under
the loss mask. A conversation that does not end with a reply gives a last example of context only, so that no turn
is lost. A turn is written ``<s>role[/INST]text</s>``; control strings inside texts get a backslash after their
bracket, and one more if they have some, which is taken off again on reading.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, MIDDLE, CLOSE = "<s>", "[/INST]", "</s>"
_CONTROL = r"([<\[])(\\*)(/?s>|/?INST\])"
_ESCAPED = r"([<\[])\\(\\*)(/?s>|/?INST\])"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, r"$1$2$3")


def expand(conversations: DataFrame, reply_role: str = "assistant") -> DataFrame:
    """Examples: conv_id, example (0, 1, ..), text, loss_start (0-based), loss_chars, is_last.

    Turns stand in the order of (turn, role, text), nulls first; repeated rows count each. Null roles and texts are
    empty strings. Each row without conv_id is a conversation of its own, of one turn: nothing tells what it belongs to,
    and together such rows could be any part of the table. ``loss_chars`` is 0 where there is no reply.
    """
    turn = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("t"))
    whole = rows.where("conv_id is not null").groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    talks = whole.unionByName(rows.where("conv_id is null").select("conv_id", F.array("t").alias("turns")))
    written = talks.select(
        "conv_id",
        F.transform("turns", lambda t: t["role"] == reply_role).alias("replies"),
        F.transform("turns", lambda t: F.concat(F.lit(OPEN), escape(t["role"]), F.lit(MIDDLE))).alias("heads"),
        F.transform("turns", lambda t: escape(t["text"])).alias("texts"),
    )
    n = F.size("texts")
    ends = F.filter(F.sequence(F.lit(1), n), lambda i: F.element_at("replies", i) | (i == n))
    one = written.select("*", F.posexplode(ends).alias("example", "end"))
    whole = F.transform(F.arrays_zip("heads", "texts"), lambda x: F.concat(x["heads"], x["texts"], F.lit(CLOSE)))
    context = F.array_join(F.slice(whole, F.lit(1), F.col("end") - 1), "")
    head, text = F.element_at("heads", F.col("end")), F.element_at("texts", F.col("end"))
    parts = one.select("conv_id", "example", (F.col("end") == n).alias("is_last"), F.element_at("replies", F.col("end")).alias("is_reply"), F.concat(context, head).alias("before"), text.alias("last"))
    return parts.select(
        "conv_id",
        "example",
        F.concat("before", "last", F.lit(CLOSE)).alias("text"),
        F.length("before").cast("long").alias("loss_start"),
        F.when(F.col("is_reply"), F.length("last")).otherwise(0).cast("long").alias("loss_chars"),
        "is_reply",
        "is_last",
    )


def parse(text: Column) -> Column:
    """Formatted text to an array of (role, text), unescaped."""
    pieces = F.filter(F.split(text, CLOSE), lambda x: x != "")  # a turn is never empty, what follows the last is
    role = lambda x: F.regexp_extract(x, r"(?s)^<s>(.*?)\[/INST\]", 1)
    body = lambda x: F.regexp_extract(x, r"(?s)^<s>.*?\[/INST\](.*)$", 1)
    return F.transform(pieces, lambda x: F.struct(unescape(role(x)).alias("role"), unescape(body(x)).alias("text")))


def read_back(examples: DataFrame) -> DataFrame:
    """One row per conversation, from the formatted examples: turns from the last, replies from under the masks.

    An example without conv_id is a conversation of its own.
    """
    under = unescape(F.substr("text", (F.col("loss_start") + 1).cast("int"), F.col("loss_chars").cast("int")))
    mine = examples.select(
        "conv_id",
        "example",
        F.length("text").cast("long").alias("formatted"),
        F.when(F.col("is_reply"), under).alias("reply"),
        F.when(F.col("is_last"), F.col("text")).alias("whole"),
    )
    per = mine.where("conv_id is not null").groupBy("conv_id").agg(
        F.sum("formatted").alias("formatted_chars"),
        F.sort_array(F.collect_list(F.struct("example", "reply"))).alias("replies"),
        F.max("whole").alias("whole"),
        F.count("*").alias("n_examples"),
    )
    alone = F.array(F.struct("example", "reply")).alias("replies")
    per = per.unionByName(mine.where("conv_id is null").select("conv_id", F.col("formatted").alias("formatted_chars"), alone, "whole", F.lit(1).cast("long").alias("n_examples")))
    loss = F.array_join(F.transform("replies", lambda r: r["reply"]), "")
    turns = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return per.select("conv_id", "formatted_chars", "n_examples", loss.alias("loss"), parse(F.col("whole")).alias("turns")).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(turns, "").cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
        F.col("n_examples").cast("long").alias("n_examples"),
    )
