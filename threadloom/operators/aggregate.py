"""Aggregates over a thread's messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def participants(messages: DataFrame, pos: str = "ord") -> DataFrame:
    """A1: per thread and address the first sender, the number of messages, and the clock of the first one in reply order."""
    return messages.groupBy("thread_id", F.col("sender.email").alias("email")).agg(
        F.min_by("sender", pos).alias("sender"), F.count("*").alias("message_count"), F.min_by("ts", pos).alias("first_seen"), F.min(pos).alias("first_pos")
    )


def last_senders(messages: DataFrame, pos: str = "ord") -> DataFrame:
    """A3: per thread and address the last sender given, with the place of its first message."""
    return messages.groupBy("thread_id", F.col("sender.email").alias("email")).agg(F.max_by("sender", pos).alias("sender"), F.min(pos).alias("first_pos"))


def distinct_recipients(*lists: Column) -> Column:
    """A4: distinct recipients of several lists in order; null where there are none."""
    empty = F.array().cast("array<string>")
    every = F.array_distinct(F.concat(*[F.coalesce(x, empty) for x in lists]))
    return F.when(F.size(every) > 0, every)


def distinct_attachments(*lists: Column) -> Column:
    """A5: attachments distinct by name, size label and address, the first one kept; null where there are none."""
    kind = "array<struct<name:string,mime_type:string,size_label:string,download_url:string>>"
    every = F.concat(*[F.coalesce(x, F.array().cast(kind)) for x in lists])
    same = lambda a, b: a["name"].eqNullSafe(b["name"]) & a["size_label"].eqNullSafe(b["size_label"]) & a["download_url"].eqNullSafe(b["download_url"])
    kept = F.aggregate(every, F.array().cast(kind), lambda out, x: F.when(F.exists(out, lambda y: same(x, y)), out).otherwise(F.array_append(out, x)))
    return F.when(F.size(kept) > 0, kept)


def participation(messages: DataFrame, user: Column, pos: str = "ord") -> DataFrame:
    """Per thread where the reader comes in: (message_id, kind), kind being authored, recipient or available.

    ``user`` is a column of the message rows. A reader who is there from the first message has
    no boundary; one who is never named gets the first direct message, unless that is the first.
    """
    me = F.lower(F.trim(user))
    named = (F.coalesce(me, F.lit("")) != "") & (F.col("sender.email").eqNullSafe(me) | F.coalesce(F.array_contains("recipients", me), F.lit(False)))
    found = messages.groupBy("thread_id").agg(
        F.min(pos).alias("first"),
        F.min(F.when(named, F.struct(F.col(pos).alias("pos"), F.col("id").alias("id"), F.col("sender.email").eqNullSafe(me).alias("authored")))).alias("mine"),
        F.min(F.when(F.col("source") == "direct", F.struct(F.col(pos).alias("pos"), F.col("id").alias("id")))).alias("direct"),
    )
    explicit = F.col("mine").isNotNull()
    kind = (
        F.when(explicit & (F.col("mine.pos") > F.col("first")), F.when(F.col("mine.authored"), F.lit("authored")).otherwise(F.lit("recipient")))
        .when(~explicit & (F.col("direct.pos") > F.col("first")), F.lit("available"))
    )
    return found.withColumn("kind", kind).where("kind is not null").select("thread_id", F.coalesce("mine.id", "direct.id").alias("message_id"), "kind")


def message_counts(messages: DataFrame) -> DataFrame:
    """A8."""
    return messages.groupBy("thread_id").agg(F.count("*").alias("message_count"))


def reader_counters(snapshots: DataFrame) -> DataFrame:
    """What a reader did, per thread: batches, snapshots, time in all and at most; ``ms`` and ``batch`` are columns of the rows."""
    return snapshots.groupBy("thread_id").agg(
        F.count_distinct("batch").alias("batches"), F.count("*").alias("snapshots"), F.sum("ms").alias("snapshot_ms"), F.max("ms").alias("longest_ms")
    )


def truncation(captured: DataFrame) -> DataFrame:
    """A10: per thread the number of truncated containers and whether there are any."""
    cut = F.coalesce(F.col("container_truncated"), F.lit(False))
    return captured.groupBy("thread_id").agg(F.count_if(cut).alias("truncated"), F.bool_or(cut).alias("any_truncated"))


def used_bytes(store: DataFrame, key: str) -> DataFrame:
    """Bytes held by all other keys."""
    return store.agg(F.coalesce(F.sum(F.when(F.col("key") != key, F.col("size"))), F.lit(0)).alias("used"))


def reader_addresses(messages: DataFrame) -> DataFrame:
    """Per thread and address whether any of its messages is the reader's."""
    return messages.groupBy("thread_id", F.col("sender.email").alias("email")).agg(F.bool_or(F.coalesce("is_current_user", F.lit(False))).alias("is_reader"))


def total_messages(participants: DataFrame) -> DataFrame:
    """P11."""
    return participants.groupBy("thread_id").agg(F.sum("message_count").alias("total"))
