"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are context, and
only its reply is trainable. A conversation that does not end with the assistant gets one
more example without a trainable part, so that the output holds every turn.

The template is <|im_start|>role, a line break, the text, <|im_end|>, a line break. Inside
roles and texts every backslash is doubled and "<|" becomes "<\\|" (in roles a line break
becomes "<\\n"), so control strings are never part of them and the change can be undone:
after escaping, a "<" followed by exactly one backslash is always an escape.

Rows are ordered by turn, rows of one turn by role and text; a null turn comes first. Null
roles and texts are empty. Rows without conv_id form a conversation of their own. Further
columns are left out; an empty table gives an empty result. A conversation's turns are
gathered in one row, and its examples together grow with the square of their number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
ASSISTANT = "assistant"


def _sub(col: Column, old: str, new: str) -> Column:
    return F.replace(col, F.lit(old), F.lit(new))


def escape(text: Column) -> Column:
    return _sub(_sub(text, "\\", "\\\\"), "<|", "<\\|")


def unescape(text: Column) -> Column:
    return _sub(_sub(text, "<\\|", "<|"), "\\\\", "\\")


def escape_role(role: Column) -> Column:
    return _sub(escape(role), "\n", "<\\n")


def unescape_role(role: Column) -> Column:
    return unescape(_sub(role, "<\\n", "\n"))


def turn_string(role: Column, text: Column) -> Column:
    return F.concat(F.lit(START), escape_role(role), F.lit("\n"), escape(text), F.lit(END + "\n"))


def examples(conversations: DataFrame) -> DataFrame:
    """conv_id, target (index of the trainable turn, null without one), formatted, loss_start, loss_chars.

    loss_start and loss_chars are code points of formatted: the reply, neither its header nor its end mark.
    """
    empty = F.lit("")
    turn = F.struct("turn", F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text"))
    convs = conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("_turns"))
    n = F.size("_turns")
    parts = convs.select(
        "conv_id",
        F.transform("_turns", lambda t: turn_string(t["role"], t["text"])).alias("_parts"),
        F.transform("_turns", lambda t: t["role"] == ASSISTANT).alias("_asked"),
        F.transform("_turns", lambda t: F.length(escape(t["text"]))).alias("_chars"),
        n.alias("_n"),
    )
    ends = F.filter(F.sequence(F.lit(0), F.col("_n") - 1), lambda k: F.get("_asked", k) | (k == F.col("_n") - 1))
    spread = parts.select("*", F.explode(ends).alias("_at"))
    trained = F.get("_asked", F.col("_at"))
    formatted = spread.select(
        "conv_id",
        F.when(trained, F.col("_at")).alias("target"),
        F.array_join(F.slice("_parts", 1, F.col("_at") + 1), "").alias("formatted"),
        F.get("_chars", F.col("_at")).alias("_len"),
        trained.alias("_trained"),
    )
    return formatted.select(
        "conv_id",
        "target",
        "formatted",
        F.when(F.col("_trained"), F.length("formatted") - len(END + "\n") - F.col("_len")).alias("loss_start"),
        F.when(F.col("_trained"), F.col("_len")).otherwise(0).alias("loss_chars"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted example, as an array of (role, text)."""
    pieces = F.slice(F.split(formatted, r"<\|im_start\|>"), 2, 2_000_000_000)
    body = lambda p: F.substring(p, F.lit(1), F.length(p) - len(END + "\n"))
    return F.transform(
        pieces,
        lambda p: F.struct(
            unescape_role(F.substring_index(p, "\n", 1)).alias("role"),
            unescape(F.substring(body(p), F.length(F.substring_index(p, "\n", 1)) + 2, F.lit(2_000_000_000))).alias("text"),
        ),
    )


def digests(formatted: DataFrame) -> DataFrame:
    """Per conversation, from its examples alone: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    loss = F.substring("formatted", F.col("loss_start") + 1, F.col("loss_chars"))
    own = formatted.select(
        "conv_id",
        F.length("formatted").cast("long").alias("_chars"),
        F.when(F.col("target").isNotNull(), F.struct("target", unescape(loss).alias("text"))).alias("_loss"),
        F.col("formatted"),
    )
    grouped = own.groupBy("conv_id").agg(
        F.sum("_chars").alias("formatted_chars"),
        F.max_by("formatted", "_chars").alias("_all"),
        F.array_sort(F.collect_list("_loss")).alias("_losses"),
    )
    turns = read_turns(F.col("_all"))
    text = F.array_join(F.transform("_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    reply = F.array_join(F.transform("_losses", lambda t: t["text"]), "")
    return grouped.withColumn("_turns", turns).select(
        "conv_id",
        F.size("_turns").cast("long").alias("n_turns"),
        F.sha2(text.cast("binary"), 256).alias("turns_sha256"),
        F.length(reply).cast("long").alias("loss_chars"),
        F.sha2(reply.cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )
