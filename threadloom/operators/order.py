"""Order of a thread: unread clocks placed, quote nesting respected."""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import iso
from ..functions.text import let


def place_unread(rows: list[dict]) -> list[dict]:
    """W5 on rows: direct messages without a readable clock lie between their neighbours in the mailbox."""
    direct = sorted((r for r in rows if r.get("source") != "quoted"), key=lambda r: r.get("idx") or 0)
    read = [i for i, r in enumerate(direct) if r.get("ms") is not None and not r.get("ts_estimated") and not r.get("zone_unknown")]
    if not read or len(read) == len(direct):
        return rows
    placed: dict[int, int] = {}
    behind = [None] * len(direct)
    ahead = [None] * len(direct)
    known = set(read)
    for i in range(len(direct)):
        behind[i] = i if i in known else behind[i - 1] if i else None
    for i in reversed(range(len(direct))):
        ahead[i] = i if i in known else ahead[i + 1] if i + 1 < len(direct) else None
    for i, r in enumerate(direct):
        if i in known:
            continue
        a, b = behind[i], ahead[i]
        if a is not None and b is not None:
            low, high = direct[a]["ms"], direct[b]["ms"]
            at = low + (high - low) * (i - a) / (b - a)
        else:
            at = direct[a]["ms"] + (i - a) * 1000 if a is not None else direct[b]["ms"] - (b - i) * 1000
        placed[id(r)] = int(at)
    return [r | {"ms": placed[id(r)], "ts_raw": iso(placed[id(r)]), "ts_estimated": True} if id(r) in placed else r for r in rows]


def sequence(rows: list[dict], edges: list[tuple[int, int]]) -> list[dict]:
    """By clock, but no message before one that it quotes; contradicted clocks are flagged.

    Of the messages whose quoted ones are placed the earliest goes next. A cycle is broken at
    its earliest message.
    """
    by_clock = sorted(range(len(rows)), key=lambda i: (rows[i].get("ms") is None, rows[i].get("ms") or 0, rows[i].get("idx") or 0, i))
    turn = {i: n for n, i in enumerate(by_clock)}
    later: dict[int, set[int]] = {}
    waits = [0] * len(rows)
    for old, new in edges:
        if old != new and new not in later.setdefault(old, set()):
            later[old].add(new)
            waits[new] += 1
    free = [turn[i] for i in by_clock if not waits[i]]
    heapq.heapify(free)
    done, stuck, out = [False] * len(rows), 0, []
    while len(out) < len(rows):
        if free:
            i = by_clock[heapq.heappop(free)]
            if done[i]:
                continue
        else:
            while done[by_clock[stuck]]:
                stuck += 1
            i = by_clock[stuck]
        done[i] = True
        out.append(i)
        for k in later.get(i, ()):
            waits[k] -= 1
            if not waits[k] and not done[k]:
                heapq.heappush(free, turn[k])
    result = [dict(rows[i]) for i in out]
    latest = None
    for r in result:
        if r.get("ms") is None:
            continue
        if latest is not None and r["ms"] < latest["ms"]:
            r["ordered_by_quote"] = latest["ordered_by_quote"] = True
        else:
            latest = r
    return result


# --- columns and windows ---------------------------------------------------------------


def by_clock() -> list[Column]:
    """Clock, then mailbox place, then arrival; unreadable clocks last."""
    return [F.col("ts").asc_nulls_last(), F.col("idx").asc_nulls_last(), F.col("ord").asc_nulls_last()]


def direct_first() -> list[Column]:
    """W1."""
    return [(F.col("source") == "quoted").asc_nulls_first(), F.col("ord").asc()]


def chronological(messages: DataFrame) -> DataFrame:
    """``pos``: the place in the thread by clock alone, the whole order where nothing is quoted."""
    return messages.withColumn("pos", F.row_number().over(Window.partitionBy("thread_id").orderBy(*by_clock())) - 1)


def interpolate(rows: DataFrame, key: list[str], order: str, value: str, out: str) -> DataFrame:
    """Missing values placed linearly between the nearest known ones, a second a step beyond them.

    ``value`` is in milliseconds. Known values stay.
    """
    w = Window.partitionBy(*key).orderBy(order)
    back, front = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    at = F.when(F.col(value).isNotNull(), F.col("_i"))
    known = rows.withColumn("_i", F.row_number().over(w))
    known = known.withColumns(
        {
            "_lo": F.last(value, True).over(back),
            "_a": F.last(at, True).over(back),
            "_hi": F.first(value, True).over(front),
            "_b": F.first(at, True).over(front),
        }
    )
    between = F.col("_lo") + (F.col("_hi") - F.col("_lo")) * (F.col("_i") - F.col("_a")) / (F.col("_b") - F.col("_a"))
    placed = F.coalesce(
        F.col(value).cast("double"),
        between.cast("double"),
        (F.col("_lo") + (F.col("_i") - F.col("_a")) * 1000).cast("double"),
        (F.col("_hi") - (F.col("_b") - F.col("_i")) * 1000).cast("double"),
    )
    return known.withColumn(out, placed).drop("_i", "_lo", "_a", "_hi", "_b")


def out_of_order(rows: DataFrame, key: list[str], order: str, clock: str) -> DataFrame:
    """``behind`` on rows whose clock is below the running maximum, and on the row that holds it."""
    w = Window.partitionBy(*key).orderBy(order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    high = F.max(F.when(F.col(clock).isNotNull(), F.struct(F.col(clock).alias("t"), F.col(order).alias("o")))).over(before)
    marked = rows.withColumn("_high", high).withColumn("_late", F.coalesce(F.col(clock) < F.col("_high.t"), F.lit(False)))
    overtaken = F.collect_set(F.when(F.col("_late"), F.col("_high.o"))).over(Window.partitionBy(*key))
    return marked.withColumn("behind", F.col("_late") | F.array_contains(overtaken, F.col(order))).drop("_high", "_late")


def first_appearance(rows: DataFrame, key: list[str], value: str, order: str, out: str) -> DataFrame:
    """Values numbered by where they first appear."""
    first = F.min(order).over(Window.partitionBy(*key, value))
    return rows.withColumn("_first", first).withColumn(out, F.dense_rank().over(Window.partitionBy(*key).orderBy("_first"))).drop("_first")


def picture_numbers(keys: Column) -> Column:
    """Pictures numbered by first appearance in the message, ``?`` as it is."""

    def numbered(p: Column) -> Column:
        return F.transform(p["keys"], lambda k: F.when(k == "?", k).otherwise(F.array_position(p["known"], k).cast("string")))

    return let(F.struct(keys.alias("keys"), F.array_distinct(F.filter(keys, lambda k: k != "?")).alias("known")), numbered)


def rank_participants(participants: DataFrame) -> DataFrame:
    """``place`` by message count, the first seen before others with as many."""
    w = Window.partitionBy("thread_id").orderBy(F.desc("message_count"), "first_pos")
    return participants.withColumn("place", F.row_number().over(w))


def sender_runs(rows: DataFrame, key: list[str], order: str, sender: str, mine: Column) -> DataFrame:
    """``show_sender`` where a run of one sender begins, but never on the reader's own messages."""
    prev = F.lag(sender).over(Window.partitionBy(*key).orderBy(order))
    return rows.withColumn("show_sender", ~prev.eqNullSafe(F.col(sender)) & ~F.coalesce(mine, F.lit(False)))


def batches(rows: DataFrame, key: list[str], order: str, size: int = 4) -> DataFrame:
    """Consecutive batches of ``size`` rows."""
    n = F.row_number().over(Window.partitionBy(*key).orderBy(order)) - 1
    return rows.withColumn("batch", F.floor(n / size).cast("int"))
