"""Chat formatting by prefix-target expansion.

A conversation is rendered once. Every assistant turn then becomes an example of its
own: all turns before it are context, and only its text is trainable. Because rendering
is a concatenation, an example is a prefix of the rendered conversation, so the expanded
table can hold offsets (linear in the input) or, on request, the texts themselves.

Control strings inside texts are escaped reversibly: a backslash is doubled and ``<|``
becomes ``<\\|``; roles are percent-encoded. A rendered text therefore holds ``<|`` only
where the template put it.

Defined cases: null text is empty, null role is the empty role, turns with equal numbers
are ordered by role and text, repeated rows are turns of their own, a conversation without
an assistant turn yields no example, a null conversation id is a conversation of its own,
an empty table gives empty results, and extra columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def render(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row a conversation: ``conv_id``, ``formatted``, and ``segments`` with the place of each turn's text.

    ``segments`` is an array of (role, start, end): code points of the escaped text, end exclusive.
    Grouping is by conversation, whose text has to fit in a row; parts are sorted inside the row.
    """
    head = F.concat(F.lit(START), F.url_encode(F.coalesce(F.col(role), F.lit(""))), F.lit("\n"))
    body = escape(F.coalesce(F.col(text), F.lit("")))
    part = F.struct(
        F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), body.alias("body"), F.length(head).alias("head"), F.concat(head, body, F.lit(END + "\n")).alias("all")
    )
    grouped = turns.groupBy(F.col(conv).alias("conv_id")).agg(F.sort_array(F.collect_list(part)).alias("parts"))
    placed = F.aggregate(
        F.col("parts"),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<role:string,start:int,end:int>>").alias("out")),
        lambda a, p: F.struct(
            (a["at"] + F.length(p["all"])).alias("at"),
            F.concat(a["out"], F.array(F.struct(p["role"].alias("role"), (a["at"] + p["head"]).alias("start"), (a["at"] + p["head"] + F.length(p["body"])).alias("end")))).alias("out"),
        ),
        lambda a: a["out"],
    )
    return grouped.select("conv_id", F.array_join(F.transform("parts", lambda p: p["all"]), "").alias("formatted"), placed.alias("segments"))


def expand(rendered: DataFrame, target_role: str = "assistant", texts: bool = False) -> DataFrame:
    """One row for each turn of ``target_role``: its number among the turns, where its context ends, and its loss span.

    With ``texts`` each row also carries ``example``: the whole context and the reply, ready
    to train on. Without, the example is the first ``example_end`` code points of ``formatted``.
    """
    out = rendered.select("conv_id", "formatted", F.posexplode("segments").alias("target_turn", "s")).where(F.col("s.role") == target_role)
    out = out.select(
        "conv_id", "target_turn", F.col("s.start").alias("loss_start"), F.col("s.end").alias("loss_end"), (F.col("s.end") + len(END)).alias("example_end"), "formatted"
    )
    if texts:
        out = out.withColumn("example", F.substring(F.col("formatted"), F.lit(1), F.col("example_end")))
    return out if texts else out.drop("formatted")


def parse(formatted: Column) -> Column:
    """The turns of a rendered conversation as an array of (role, text), read from the rendering alone."""
    pieces = F.filter(F.split(formatted, r"<\|im_start\|>"), lambda _, i: i > 0)
    return F.transform(
        pieces,
        lambda p: F.struct(
            F.url_decode(F.substring_index(p, "\n", 1)).alias("role"),
            unescape(F.regexp_replace(p, r"(?s)\A[^\n]*\n(.*)<\|im_end\|>\n\z", "$1")).alias("text"),
        ),
    )
