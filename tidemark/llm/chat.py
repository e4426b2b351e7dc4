"""Chat formatting of typed content parts, with DataFrame functions alone.

A message is a role and a list of parts: struct<kind, text, ref, tokens>. Visiting the parts in order gives one body per
message: text parts are escaped, other kinds become a placeholder; each placeholder's place, reference and token count
are recorded. A conversation is its messages by turn, each between a header and an end mark, with a loss mask of the
spans (in code points) that the assistant said.

Escaping. Control strings start with "<|", "<s>", "</s>", "[INST]" or "[/INST]". Inside a text one backslash is put after
the bracket that starts such a string, and after a bracket with backslashes before the rest of such a string; taking one
away gives the text back. So no text, whatever it holds, can show a control string.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PART = "struct<kind:string,text:string,ref:string,tokens:int>"
#: Placeholder of each kind of attachment; an unknown kind is shown as a file.
PLACEHOLDERS = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"}
OTHER_PLACEHOLDER = "<|file|>"
HEAD, HEAD_END, END = "<|turn|>", "<|says|>", "<|done|>"
_AFTER = r"(?=\||s>|/s>)"
_AFTER_SQUARE = r"(?=/?INST\])"


def escape(text: Column) -> Column:
    """text without any control string; unescape gives it back."""
    out = F.regexp_replace(text, r"<(\\*)" + _AFTER, r"<\\$1")
    return F.regexp_replace(out, r"\[(\\*)" + _AFTER_SQUARE, r"[\\$1")


def unescape(text: Column) -> Column:
    out = F.regexp_replace(text, r"<\\(\\*)" + _AFTER, "<$1")
    return F.regexp_replace(out, r"\[\\(\\*)" + _AFTER_SQUARE, "[$1")


def text_parts(text: Column) -> Column:
    """The list of parts of a message that is one text; null text is an empty one."""
    return F.array(
        F.struct(
            F.lit("text").alias("kind"),
            F.coalesce(text, F.lit("")).alias("text"),
            F.lit(None).cast("string").alias("ref"),
            F.lit(None).cast("int").alias("tokens"),
        )
    ).cast(f"array<{PART}>")


def _shown(part: Column) -> Column:
    """What a part is in the body. A part without a kind is text."""
    other = F.lit(OTHER_PLACEHOLDER)
    for kind, mark in PLACEHOLDERS.items():
        other = F.when(part["kind"] == kind, F.lit(mark)).otherwise(other)
    return F.when(F.coalesce(part["kind"], F.lit("text")) == "text", escape(F.coalesce(part["text"], F.lit("")))).otherwise(other)


def flatten_parts(df: DataFrame, parts: str = "parts") -> DataFrame:
    """df with body (string), attachments (array of kind, ref, at, tokens: place is the offset of the placeholder in the
    body in code points) and expanded_tokens (what the placeholders expand to, summed).

    Null or empty lists give an empty body; null parts are skipped; unknown kinds get the general placeholder; null token
    counts are 0. Order and repetition of parts are kept.
    """
    visited = F.aggregate(
        F.filter(F.coalesce(F.col(parts), F.array().cast(f"array<{PART}>")), lambda p: p.isNotNull()),
        F.struct(
            F.lit("").alias("body"),
            F.array().cast("array<struct<kind:string,ref:string,at:int,tokens:int>>").alias("attachments"),
            F.lit(0).cast("long").alias("expanded"),
        ),
        lambda acc, p: F.struct(
            F.concat(acc["body"], _shown(p)).alias("body"),
            F.when(F.coalesce(p["kind"], F.lit("text")) == "text", acc["attachments"])
            .otherwise(
                F.concat(
                    acc["attachments"],
                    F.array(
                        F.struct(
                            p["kind"].alias("kind"),
                            p["ref"].alias("ref"),
                            F.length(acc["body"]).alias("at"),
                            F.coalesce(p["tokens"], F.lit(0)).alias("tokens"),
                        )
                    ),
                )
            )
            .alias("attachments"),
            (acc["expanded"] + F.when(F.coalesce(p["kind"], F.lit("text")) == "text", 0).otherwise(F.coalesce(p["tokens"], F.lit(0)))).alias("expanded"),
        ),
    )
    return (
        df.withColumn("__visited", visited)
        .withColumn("body", F.col("__visited.body"))
        .withColumn("attachments", F.col("__visited.attachments"))
        .withColumn("expanded_tokens", F.col("__visited.expanded"))
        .drop("__visited")
    )


def format_chats(messages: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """One row per conversation of (conv_id, turn, role, parts): formatted, loss_mask (array of start, chars: offsets in
    code points, from 0), attachments (each with its turn's number and its place in `formatted`) and expanded_tokens.

    Turns are ordered by turn, nulls first; equal turns by role, then body; repeated rows all stay. A null role is empty.
    A null conv_id is a conversation of its own. An empty table gives no rows; other columns are ignored. All of a
    conversation meets in one row, as its string must.
    """
    rows = flatten_parts(messages.select("conv_id", "turn", "role", "parts")).drop("parts").withColumn("role", F.coalesce("role", F.lit("")))
    rows = rows.withColumn("head", F.concat(F.lit(HEAD), escape(F.col("role")), F.lit(HEAD_END)))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "body", "attachments", "expanded_tokens")
    size = F.length("head") + F.length("body") + len(END)
    # running sums over a conversation's turns, dealt as the groups are: no second shuffle, and linear in the turns
    before = F.coalesce(F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.select("*", (F.row_number().over(order) - 1).alias("n"), (before + F.length("head")).alias("start"))
    turn = F.struct(
        "n",
        "start",
        F.length("body").cast("long").alias("chars"),
        (F.col("role") == loss_role).alias("learnt"),
        "attachments",
        F.concat("head", "body", F.lit(END)).alias("shown"),
    )
    rows = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"), F.sum("expanded_tokens").alias("expanded_tokens"))
    placed = F.transform(
        "turns",
        lambda t: F.transform(
            t["attachments"],
            lambda a: F.struct(
                t["n"].alias("turn_number"), a["kind"].alias("kind"), a["ref"].alias("ref"), (t["start"] + a["at"]).alias("at"), a["tokens"].alias("tokens")
            ),
        ),
    )
    return rows.select(
        "conv_id",
        F.array_join(F.transform("turns", lambda t: t["shown"]), "").alias("formatted"),
        F.transform(F.filter("turns", lambda t: t["learnt"]), lambda t: F.struct(t["start"].alias("start"), t["chars"].alias("chars"))).alias("loss_mask"),
        F.flatten(placed).alias("attachments"),
        "expanded_tokens",
    )


def read_back(formatted: Column) -> Column:
    """array<struct<role, body>> of a formatted conversation, unescaped; placeholders stay in the body."""
    pieces = F.filter(F.split(formatted, r"<\|done\|>"), lambda p: p != "")
    return F.transform(
        pieces,
        lambda p: F.struct(
            unescape(F.substring_index(F.substr(p, F.lit(len(HEAD) + 1)), HEAD_END, 1)).alias("role"),
            unescape(F.substr(p, F.locate(HEAD_END, p) + len(HEAD_END))).alias("body"),
        ),
    )


def masked_text(formatted: Column, mask: Column) -> Column:
    """All text under the mask, unescaped span by span, with nothing between."""
    return F.array_join(F.transform(mask, lambda m: unescape(F.substr(formatted, (m["start"] + 1).cast("int"), m["chars"].cast("int")))), "")
