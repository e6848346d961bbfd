"""Rows for tests, about invented people."""

from threadloom.functions import dates
from threadloom.operators.split import to_rows
from threadloom.schema import MESSAGE

ANCHOR = dates.instant("2026-04-10T17:00:00Z")
LONG_BODY = (
    "The delivery schedule for the northern warehouse was agreed with the carrier this morning and the first trucks leave on Monday so "
    "please confirm that the loading bays are free and that the night shift knows about the change of route"
)


def direct(id_, body, at="2026-04-10T09:00:00Z", email="ana@firma.example", name="Ana Ruiz", **more):
    return {"thread_id": "t", "id": id_, "sender": {"name": name, "email": email}, "ms": dates.instant(at) if at else None, "ts_raw": at, "source": "direct", "body": body, "idx": 0} | more


def quoted(id_, body, at="2026-04-10T09:00:00Z", email="ana@firma.example", name="Ana Ruiz", **more):
    return direct(id_, body, at, email, name, source="quoted", idx=-1) | more


def frame(spark, rows):
    return spark.createDataFrame([tuple(r[n] for n in MESSAGE.fieldNames()) for r in to_rows(rows)], MESSAGE)
