"""The query surface: filters, search and display columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx


def by_participant(messages: DataFrame, email: str | None) -> DataFrame:
    """Messages of one address; all of them where none is chosen."""
    return messages if email is None else messages.where(F.col("sender.email") == email)


def matches(needle: str, *texts: Column, variants: Column | None = None) -> Column:
    """Case-insensitive substring of any of the texts, or of a retained variant. The needle is not trimmed."""
    low = needle.lower()
    found = F.lit(False)
    for t in texts:
        found = found | F.coalesce(F.contains(F.lower(t), F.lit(low)), F.lit(False))
    if variants is not None:
        found = found | F.coalesce(F.exists(variants, lambda v: F.contains(F.lower(v["body"]), F.lit(low))), F.lit(False))
    return found


def search(messages: DataFrame, needle: str) -> DataFrame:
    """P2 over message rows; a blank needle finds everything."""
    if not needle.strip():
        return messages
    return messages.where(matches(needle, F.col("body"), F.col("sender.name"), F.col("sender.email"), variants=F.col("quoted_variants")))


def find(messages: DataFrame, email: str | None = None, needle: str = "") -> DataFrame:
    """Search within a participant's messages."""
    return search(by_participant(messages, email), needle)


def worth_showing(body: Column, html: Column, history: Column, attachments: Column) -> Column:
    """A message with words, a picture, quoted messages or attachments."""
    has = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0
    return (F.coalesce(body, F.lit("")) != "") | F.coalesce(html.rlike(r"(?i)<img\b"), F.lit(False)) | has(history) | has(attachments)


def is_carrier(body: Column, html: Column, history: Column) -> Column:
    """P5: a message that only passes others on."""
    return (F.coalesce(body, F.lit("")) == "") & ~F.coalesce(html.rlike(r"(?i)<img\b"), F.lit(False)) & (F.coalesce(F.size(history), F.lit(0)) > 0)


def kept_quote(body: Column, html: Column) -> Column:
    """A recovered message with words, a table or a picture."""
    return (F.length(F.coalesce(body, F.lit(""))) > 0) | F.coalesce(html.rlike(r"(?i)<(?:table|img)\b"), F.lit(False))


def usable(captured: DataFrame) -> DataFrame:
    """P7."""
    return captured.where(F.col("snapshot").isNotNull())


def ready(threads: DataFrame) -> DataFrame:
    """Threads that have messages."""
    return threads.where(F.coalesce(F.size("messages"), F.lit(0)) > 0)


def display_time(ts: Column, estimated: Column) -> Column:
    """P10: a readable clock, or that there is none."""
    return F.when(tx.yes(estimated) | ts.isNull(), F.lit("Time unavailable · approximate order")).otherwise(F.date_format(ts, "MMM d, yyyy, hh:mm a"))


def time_hint(ordered_by_quote: Column, zone_unknown: Column, estimated: Column) -> Column:
    """P10: why a clock may mislead: its place came from the reply chain, or it has no zone."""
    return F.when(tx.yes(ordered_by_quote), F.lit("quote-order")).when(tx.yes(zone_unknown) & ~tx.yes(estimated), F.lit("no-zone"))


def shown_pictures(images: DataFrame, displayed: DataFrame) -> DataFrame:
    """Requested pictures that the current thread displays, by ``url`` within ``thread_id``."""
    return images.join(displayed.select("thread_id", "url").distinct(), ["thread_id", "url"], "left_semi")


def mark_boundary(messages: DataFrame, boundary: DataFrame) -> DataFrame:
    """``participation`` on the one message that the boundary names."""
    b = boundary.select("thread_id", F.col("message_id").alias("id"), F.col("kind").alias("participation"))
    return messages.join(b, ["thread_id", "id"], "left")
