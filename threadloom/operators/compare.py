"""Shapes of threads and their differences."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from .order import picture_numbers

FIELDS = ("pos", "sender", "time", "source", "flags", "lines", "quoted_by", "variants", "recipients", "attachments", "images")


def shape(messages: DataFrame) -> DataFrame:
    """R2: per message a line without identities: (thread_id, pos, fields, line)."""
    w = Window.partitionBy("thread_id")
    pos = (F.row_number().over(w.orderBy("ord")) - 1).alias("pos")
    placed = messages.select("*", pos)
    first = F.min("pos").over(Window.partitionBy("thread_id", "sender.email"))
    numbered = placed.withColumn("_first", first).withColumn("who", F.dense_rank().over(w.orderBy("_first")))
    homes = placed.select("thread_id", F.col("id").alias("quoted_by"), F.col("pos").alias("quoter"))
    linked = numbered.join(homes, ["thread_id", "quoted_by"], "left")
    flags = F.array_join(
        F.filter(
            F.array(
                *[F.when(tx.yes(F.col(c)), F.lit(n)) for c, n in (("ts_estimated", "estimated"), ("zone_unknown", "zoneless"), ("ordered_by_quote", "chained"), ("history_carrier", "carrier"), ("is_current_user", "you"))]
            ),
            lambda f: f.isNotNull(),
        ),
        "+",
    )
    size = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0)).cast("string")
    values = (
        F.concat(F.lit("#"), F.col("pos")),
        F.col("who").cast("string"),
        F.coalesce(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("none")),
        F.coalesce("source", F.lit("direct")),
        F.when(flags != "", flags).otherwise(F.lit("none")),
        F.size(F.split(F.coalesce("body", F.lit("")), "\n", -1)).cast("string"),
        F.coalesce(F.concat(F.lit("#"), F.col("quoter")), F.lit("none")),
        size("quoted_variants"),
        size("recipients"),
        size("attachments"),
        F.array_join(picture_numbers(tx.image_keys(F.col("body_html"))), ","),
    )
    fields = F.array(*values)
    line = F.array_join(F.zip_with(F.array(*[F.lit(f) for f in FIELDS]), fields, lambda n, v: F.concat_ws("=", n, v)), " ")
    return linked.select("thread_id", "pos", fields.alias("fields"), line.alias("line"))


def differences(left: DataFrame, right: DataFrame, names: tuple[str, str] = ("left", "right"), limit: int | None = 24) -> DataFrame:
    """Positions where two shapes differ, with the fields that do; ``limit`` a thread (W10), None for all."""
    a = left.select("thread_id", "pos", F.col("fields").alias("a"))
    b = right.select("thread_id", "pos", F.col("fields").alias("b"))
    both = a.join(b, ["thread_id", "pos"], "full_outer")
    index = F.sequence(F.lit(0), F.lit(len(FIELDS) - 1))
    label = F.array(*[F.lit(f) for f in FIELDS])
    moved = F.transform(F.filter(index, lambda i: ~F.get("a", i).eqNullSafe(F.get("b", i))), lambda i: F.get(label, i))
    what = F.when(F.col("a").isNull(), F.lit(f"only in {names[1]}")).when(F.col("b").isNull(), F.lit(f"only in {names[0]}")).otherwise(F.array_join(moved, ", "))
    out = both.where(~F.col("a").eqNullSafe(F.col("b"))).select("thread_id", "pos", what.alias("difference"))
    if limit is None:
        return out
    n = F.row_number().over(Window.partitionBy("thread_id").orderBy("pos"))
    return out.withColumn("_n", n).where(F.col("_n") <= limit).drop("_n")


def value_differences(left: DataFrame, right: DataFrame, key: list[str], value: str) -> DataFrame:
    """J13 on one value: rows of a full outer join by position where the values differ."""
    a, b = left.select(*key, F.col(value).alias("a")), right.select(*key, F.col(value).alias("b"))
    return a.join(b, key, "full_outer").where(~F.col("a").eqNullSafe(F.col("b")))


def upsert(incoming: DataFrame, state: DataFrame, key: list[str]) -> DataFrame:
    """Incoming rows first, then the rows of the state that no incoming row replaces."""
    return incoming.unionByName(state.join(incoming.select(*key).distinct(), key, "left_anti"))

