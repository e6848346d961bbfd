"""Threads kept up to date from a stream of snapshots.

A stream of snapshot rows is deduplicated against the last version of each container,
split, and folded into the state of its thread; each micro-batch emits the whole of every
thread it changed, with a version. Late containers are never dropped: a thread is
reconciled anew from its state and what has come, so the order of arrival does not matter.
State is per thread and goes when the thread moves to another session, is cleared, or
has been idle for the time to live.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import reconcile as rc
from ..operators import split as sp
from ..schema import SNAPSHOT

#: Snapshots in a batch; idle time after which a thread's state goes.
BATCH = 4
TTL_MS = 24 * 3_600_000
#: What the stateful operators emit: the whole thread, as JSON rows, with a version.
EMITTED = T.StructType(
    [T.StructField("thread_id", T.StringType()), T.StructField("session", T.StringType()), T.StructField("version", T.LongType()), T.StructField("messages", T.StringType())]
)
_JSON_MESSAGE = "array<struct<id:string,ms:bigint,ord:int,idx:int,sender:struct<name:string,email:string>,source:string,body:string,body_html:string,ts_estimated:boolean,zone_unknown:boolean,is_current_user:boolean,quoted_by:string,ordered_by_quote:boolean,history_carrier:boolean,recipients:array<string>,ts_raw:string,attachments:array<struct<name:string,mime_type:string,size_label:string,download_url:string>>,quoted_variants:array<struct<body:string,body_html:string>>>>"


def read_snapshots(spark: SparkSession, path: str, files: int = BATCH) -> DataFrame:
    """A folder of snapshot files as a stream, old files first as the backfill, ``files`` a trigger."""
    return spark.readStream.schema(SNAPSHOT).option("maxFilesPerTrigger", files).parquet(path)


def fingerprint(snapshots: DataFrame) -> DataFrame:
    """``mark`` of what a container holds; equal marks are no change."""
    body = F.to_json(F.struct("message", "html", "image_sources"))
    return snapshots.withColumn("mark", F.concat_ws(":", F.xxhash64(body).cast("string"), F.crc32(body.cast("binary")).cast("string")))


def classify(changes: DataFrame) -> DataFrame:
    """What a change to a page touches: ``body``, ``header``, ``structure``, or nothing that matters.

    Rows have ``in_message``, ``in_body``, ``added`` and ``attribute``.
    """
    kind = (
        F.when(F.col("in_message") & F.col("in_body"), F.lit("body"))
        .when(F.col("in_message"), F.lit("header"))
        .when(F.coalesce(F.col("added"), F.lit(0)) > 0, F.lit("structure"))
        .otherwise(F.lit("ignored"))
    )
    return changes.withColumn("change", kind)


class ThreadState(StatefulProcessor):
    """The messages and container marks of one thread.

    The group key gives one batch at a time per thread (I8). Sessions of a batch are read one after
    another, in order of their first rows; a new one first clears what the last one left (I4), and late rows
    of one that has been left are dropped. Unchanged containers are skipped (I6). The state is
    merged with the batch (I10), and the thread is emitted with the next version if anything
    changed (I11). Idle state is cleared by a timer (I12, I13).
    """

    def __init__(self, ttl_ms: int = TTL_MS):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("thread", T.StructType([T.StructField("session", T.StringType()), T.StructField("version", T.LongType()), T.StructField("messages", T.StringType()), T.StructField("marks", T.StringType()), T.StructField("past", T.StringType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        session, version, messages, marks, past = None, 0, [], {}, []
        if self.held.exists():
            session, version, old, old_marks, old_past = self.held.get()
            messages, marks, past = json.loads(old), json.loads(old_marks), json.loads(old_past)
        changed = False
        batch = pd.concat(list(rows), ignore_index=True)
        batch = batch[~batch["session"].isin(past)]
        arrived = {s: i for i, s in enumerate(dict.fromkeys([session, *batch["session"]]))}
        batch = batch.assign(arrived=batch["session"].map(arrived)).sort_values(["arrived", "seq"], kind="stable").drop(columns="arrived")
        for row in batch.to_dict("records"):
            if row["session"] != session:
                past += [session] if session is not None else []
                session, messages, marks, changed = row["session"], [], {}, True
            snap = json.loads(row["snapshot"])
            own = snap["message"]["id"]
            if marks.get(own) == row["mark"]:
                continue
            marks[own] = row["mark"]
            found = sp.messages_of(snap)
            names = {m["id"] for m in found}
            after = rc.merge([*found, *(m for m in messages if m["id"] not in names)])
            changed, messages = changed or after != messages, after
        if changed:
            version += 1
            self.held.update((session, version, json.dumps(messages), json.dumps(marks), json.dumps(past)))
            yield pd.DataFrame({"thread_id": [key[0]], "session": [session], "version": [version], "messages": [json.dumps(messages)]})
        if timerValues is not None and self.ttl_ms and timerValues.getCurrentProcessingTimeInMs() > 0:
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.ttl_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.held.clear()
        return iter([])

    def close(self) -> None:
        pass


def packed(snapshots: DataFrame) -> DataFrame:
    """Snapshot rows as (thread_id, session, seq, mark, snapshot JSON), the form that the state reads."""
    ms = F.unix_millis("message.ts")
    marked = fingerprint(snapshots.where(F.col("message").isNotNull() & (F.coalesce("thread_id", F.lit("")) != "")))
    body = F.struct("thread_id", "current_user", F.col("message").withField("ms", ms).dropFields("ts").alias("message"), "html", "image_sources")
    return marked.select("thread_id", F.coalesce("session", F.lit("")).alias("session"), F.coalesce("seq", F.lit(0)).alias("seq"), "mark", F.to_json(body, {"ignoreNullFields": "false"}).alias("snapshot"))


def threads(snapshots: DataFrame, ttl_ms: int = 0) -> DataFrame:
    """The stream of changed threads, in update mode. The state store has to be RocksDB (``use_rocksdb``)."""
    mode = "ProcessingTime" if ttl_ms else "None"
    return packed(snapshots).groupBy("thread_id").transformWithStateInPandas(ThreadState(ttl_ms), EMITTED, "Update", mode)


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def messages_of(emitted: DataFrame) -> DataFrame:
    """The message rows of emitted threads."""
    rows = emitted.select("thread_id", "version", F.posexplode(F.from_json("messages", _JSON_MESSAGE)).alias("pos", "m"))
    return rows.select("thread_id", "version", F.col("pos").alias("ord"), *[F.col(f"m.{c}").alias(c) for c in ("id", "sender", "source", "body", "body_html", "ts_estimated", "zone_unknown", "is_current_user", "quoted_by", "ordered_by_quote", "history_carrier", "recipients", "ts_raw", "attachments", "quoted_variants")], F.timestamp_millis("m.ms").alias("ts"))


def latest(emitted: DataFrame) -> DataFrame:
    """Of each thread the emission with the highest version, whatever order they were read in."""
    last = emitted.groupBy("thread_id").agg(F.max_by(F.struct("session", "version", "messages"), "version").alias("t"))
    return last.select("thread_id", "t.*")


class LatestThreads:
    """A ``foreachBatch`` sink that keeps the last version of each thread in a folder.

    A batch is written under its number and readers take the highest version, so a batch that
    is replayed after a failure overwrites itself and nothing is counted twice.
    """

    def __init__(self, path: str):
        self.path = path.rstrip("/")

    def __call__(self, batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{self.path}/batch={number}")

    def read(self, spark: SparkSession) -> DataFrame:
        return latest(spark.read.schema(EMITTED).parquet(self.path))

    def compact(self, spark: SparkSession, out: str) -> None:
        """The last versions alone, written elsewhere."""
        self.read(spark).write.mode("overwrite").parquet(out)


def start(emitted: DataFrame, sink: LatestThreads, checkpoint: str, interval: str = "250 milliseconds"):
    """Run the stream into the sink."""
    return emitted.writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(processingTime=interval).start()


__all__ = ["ThreadState", "LatestThreads", "classify", "fingerprint", "latest", "messages_of", "read_snapshots", "start", "threads", "use_rocksdb"]
