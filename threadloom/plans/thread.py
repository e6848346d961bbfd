"""The main job: containers to threads, and its verification by capture and replay."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import aggregate, compare, mask, order, query, reconcile, split
from ..sources import extract


@dataclass(frozen=True)
class Threads:
    """What a mailbox run gives: messages in reply order, participants by rank, and where the reader comes in."""

    messages: DataFrame
    participants: DataFrame
    participation: DataFrame

    def views(self) -> None:
        """Register the frames as SQL views of their names."""
        for name in ("messages", "participants", "participation"):
            getattr(self, name).createOrReplaceTempView(name)

    def find(self, thread: str | None = None, email: str | None = None, needle: str = "") -> DataFrame:
        """The panel's query: a thread's messages of one participant that hold a text."""
        rows = self.messages if thread is None else self.messages.where(F.col("thread_id") == thread)
        return query.find(rows, email, needle).orderBy("thread_id", "ord")


def build(snapshots: DataFrame) -> Threads:
    """Snapshots to threads: split (no shuffle), reconcile (one shuffle by thread), aggregates on the same key."""
    messages = reconcile.reconcile(split.split(snapshots))
    users = snapshots.groupBy("thread_id").agg(F.max("current_user").alias("current_user"))
    people = order.rank_participants(aggregate.participants(messages))
    boundary = aggregate.participation(messages.join(users, "thread_id", "left"), F.col("current_user"))
    return Threads(messages, people, boundary)


def from_pages(pages: DataFrame, client: str) -> Threads:
    """Provider pages to threads."""
    return build(extract.snapshots(pages, client))


def replay(snapshots: DataFrame, batch: int = 4) -> DataFrame:
    """Messages as a mailbox that delivers ``batch`` containers at a time would end up with them; 0 reads all at once.

    Every step merges what has come so far with the next containers of each thread, as the
    incremental reader does, so the number of steps is that of the longest thread's batches.
    """
    if batch == 0:
        return reconcile.reconcile(split.split(snapshots))
    numbered = order.batches(snapshots, ["thread_id"], "seq", batch)
    last = numbered.agg(F.max("batch")).first()[0]
    parts = [split.split(numbered.where(F.col("batch") == i).drop("batch")) for i in range((last if last is not None else -1) + 1)]
    return reduce(_absorb, parts, None) if parts else reconcile.reconcile(split.split(snapshots))


def _absorb(state: DataFrame | None, incoming: DataFrame) -> DataFrame:
    from ..functions.storage import checkpoint

    if state is None:
        return checkpoint(reconcile.reconcile(incoming))
    shifted = state.withColumn("ord", F.col("ord") + 1_000_000_000)
    return checkpoint(reconcile.reconcile(compare.upsert(incoming, shifted, ["thread_id", "id"])))


@dataclass(frozen=True)
class Fidelity:
    """Whether a masked copy reads as the original does, and batches as the whole."""

    differences: DataFrame
    order_differences: DataFrame

    @property
    def same_structure(self) -> bool:
        return self.differences.isEmpty()

    @property
    def order_independent(self) -> bool:
        return self.order_differences.isEmpty()

    def report(self) -> DataFrame:
        """One row: same_structure, order_independent, and the differences as text, in order."""
        line = F.concat(F.lit("message "), (F.col("pos") + 1).cast("string"), F.lit(": "), F.col("difference"))
        order_line = F.concat(F.lit("order dependence — "), line)
        every = self.differences.select(F.lit(0).alias("k"), "thread_id", "pos", line.alias("line")).unionByName(
            self.order_differences.select(F.lit(1).alias("k"), "thread_id", "pos", order_line.alias("line"))
        )
        found = every.agg(F.sort_array(F.collect_list(F.struct("k", "thread_id", "pos", "line"))).alias("f"))
        lines = F.transform("f", lambda x: x["line"])
        return found.select(
            (F.size(F.filter("f", lambda x: x["k"] == 0)) == 0).alias("same_structure"), (F.size(F.filter("f", lambda x: x["k"] == 1)) == 0).alias("order_independent"), lines.alias("differences")
        )


def verify_masking(snapshots: DataFrame, batch: int = 4) -> tuple[DataFrame, Fidelity]:
    """A masked copy of snapshots, and whether it reads as the original does."""
    masked = mask.mask_snapshots(snapshots)
    return masked, fidelity(snapshots, masked, batch)


def fidelity(original: DataFrame, masked: DataFrame, batch: int = 4) -> Fidelity:
    """R3 on two sets of snapshot rows whose threads have the same ids."""
    shapes = {(kind, size): compare.shape(replay(rows, size)) for kind, rows in (("original", original), ("masked", masked)) for size in (batch, 0)}
    between = compare.differences(shapes["original", batch], shapes["masked", batch], ("original", "masked copy"))
    within = [
        compare.differences(shapes[kind, batch], shapes[kind, 0], (f"batched {kind}", f"whole {kind}"), 6).withColumn("copy", F.lit(kind)) for kind in ("original", "masked")
    ]
    return Fidelity(between, within[0].unionByName(within[1]))


def require_capture(captures: DataFrame) -> DataFrame:
    """The captures, or an error where there is none with a message."""
    if captures.where(F.coalesce(F.size("messages"), F.lit(0)) > 0).isEmpty():
        raise ValueError("no message was readable")
    return captures
