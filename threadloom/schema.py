"""Row shapes that all operators share."""

from __future__ import annotations

from pyspark.sql import types as T

SENDER = T.StructType([T.StructField("name", T.StringType()), T.StructField("email", T.StringType())])
ATTACHMENT = T.StructType([T.StructField(c, T.StringType()) for c in ("name", "mime_type", "size_label", "download_url")])
VARIANT = T.StructType([T.StructField("body", T.StringType()), T.StructField("body_html", T.StringType())])

#: A message as one row; ``ord`` is its place of arrival in the thread, ``idx`` its place in the mailbox.
MESSAGE = T.StructType(
    [
        T.StructField("thread_id", T.StringType()),
        T.StructField("id", T.StringType()),
        T.StructField("ord", T.LongType()),
        T.StructField("idx", T.IntegerType()),
        T.StructField("sender", SENDER),
        T.StructField("ts", T.TimestampType()),
        T.StructField("ts_raw", T.StringType()),
        T.StructField("ts_estimated", T.BooleanType()),
        T.StructField("zone_unknown", T.BooleanType()),
        T.StructField("source", T.StringType()),
        T.StructField("body", T.StringType()),
        T.StructField("body_html", T.StringType()),
        T.StructField("is_current_user", T.BooleanType()),
        T.StructField("quoted_by", T.StringType()),
        T.StructField("ordered_by_quote", T.BooleanType()),
        T.StructField("history_carrier", T.BooleanType()),
        T.StructField("recipients", T.ArrayType(T.StringType())),
        T.StructField("attachments", T.ArrayType(ATTACHMENT)),
        T.StructField("quoted_variants", T.ArrayType(VARIANT)),
    ]
)

#: One provider container as read: the header row, the markup of its body, the live image addresses.
SNAPSHOT = T.StructType(
    [
        T.StructField("thread_id", T.StringType()),
        T.StructField("session", T.StringType()),
        T.StructField("seq", T.LongType()),
        T.StructField("current_user", T.StringType()),
        T.StructField("message", MESSAGE),
        T.StructField("html", T.StringType()),
        T.StructField("image_sources", T.ArrayType(T.StringType())),
    ]
)
