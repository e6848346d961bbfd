"""Removal of repeated word windows, prefiltered by a count-min sketch.

A window is ``WINDOW`` consecutive words of one text. Its anchor is the leftmost smallest
fingerprint among the runs of ``ANCHOR`` words inside it; equal windows have equal anchors
at equal offsets, so an anchor occurs at least as often as each window it stands for. The
first pass counts anchors in a sketch of bounded size, merged from the partitions'
sketches: an overestimate of window counts that costs a tenth of their number. The second
pass groups only the windows whose estimate is two or more, by a 128-bit fingerprint,
exactly; none that repeats is lost, and one that only seemed to repeat is found single
there.

Grouping is skew-proof: a task first settles the windows it holds twice itself and passes
on one row for each of them, so a window of a third of all documents arrives as one row
a task. A third pass takes the covered words out.

Defined cases: null text has no words; texts shorter than a window stay whole; a window
that starts twice in one text is repeated; repeated rows repeat all of their windows;
extra columns stay; columns named like a result are replaced; an empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import sketch, tokens
from .common import carried, unpacked

WINDOW, ANCHOR = 35, 16
ROWS = 2
#: Sketch buckets for each byte of the input's files: about four for each anchor.
BUCKETS_A_BYTE = 1 / 14
#: Passes over the texts at the most, each with a sketch of its own part of the anchors, where one sketch would be too large.
MAX_PASSES = 4
_FLUSH = 1 << 21
OUT = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType())])


def _anchors(grams: np.ndarray, many: int, width: int) -> np.ndarray:
    """For each of the first ``many`` starts, the place of the leftmost smallest of the ``width`` grams from there."""
    value, place, size = grams, np.arange(len(grams)), 1

    def joined(shift: int) -> tuple[np.ndarray, np.ndarray]:
        a, b = value[: len(value) - shift], value[shift:]
        right = b < a
        return np.where(right, b, a), np.where(right, place[shift:], place[: len(place) - shift])

    while size * 2 <= width:
        value, place = joined(size)
        size *= 2
    if size < width:
        value, place = joined(width - size)
    return place[:many]


class Windows:
    """The windows of a run of texts: starts, anchors' fingerprints, words."""

    def __init__(self, texts: list[bytes]):
        self.docs = [t.split() for t in texts]
        self.words, self.ends = tokens.hashed(self.docs)
        self.at = np.flatnonzero(tokens.starts(self.ends, WINDOW, len(self.words)))
        self.grams = tokens.rolling(self.words, ANCHOR)
        self.anchor = _anchors(self.grams, len(self.words) - WINDOW + 1, WINDOW - ANCHOR + 1)[self.at] if len(self.at) else np.zeros(0, int)


def passes_for(df: DataFrame) -> int:
    """How many passes keep the sketches as sparse as intended, up to ``MAX_PASSES``."""
    wanted, held = (sketch.bits_for(df, BUCKETS_A_BYTE, rows) for rows in (0, ROWS))
    return min(MAX_PASSES, 1 << max(0, wanted - held))


def _part(keys: np.ndarray, passes: int) -> np.ndarray:
    """The pass that each anchor belongs to, by bits that the sketch's buckets do not use first."""
    return keys & np.uint64(passes - 1)


def estimate(df: DataFrame, text: str = "text", number: int = 0, passes: int = 1) -> sketch.Planes:
    """The merged sketch of the anchors of one pass (a power of two of them) over a table."""

    def keys(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for _, run in tokens.raw(batch.column(0)):
            w = Windows(run)
            found = w.grams[np.unique(w.anchor)]
            yield found[_part(found, passes) == number]

    return sketch.build(df.select(text), keys, sketch.bits_for(df, BUCKETS_A_BYTE / passes, ROWS), ROWS)


def _candidates(rows: DataFrame, sent: Broadcast, number: int = 0, passes: int = 1) -> DataFrame:
    """Windows estimated repeated, first settled within a task.

    The lowest two bits of ``place`` are 1 for a window that the task holds once, 2 for one row
    standing for a window it holds more often, 0 for a run of ``h2`` starts that are settled as
    repeated; above them come the start (30 bits) and the text's fingerprint (32).
    """

    def settled(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        h1, h2, doc, k, pos = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((h2, h1))
        h1, h2, doc, k, pos = h1[order], h2[order], doc[order], k[order], pos[order]
        new = np.ones(len(h1), bool)
        new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        first = np.flatnonzero(new)
        many = np.diff(np.append(first, len(h1))) > 1
        single, shared = first[~many], first[many]
        again = np.repeat(many, np.diff(np.append(first, len(h1))))
        order = np.lexsort((pos[again], k[again], doc[again]))
        d, c, p = doc[again][order], k[again][order], pos[again][order]
        run = np.ones(len(d), bool)
        run[1:] = (d[1:] != d[:-1]) | (c[1:] != c[:-1]) | (p[1:] != p[:-1] + 1)
        head = np.flatnonzero(run)
        place = k.astype(np.int64) << 32 | pos << 2
        length = np.diff(np.append(head, len(d)))
        zero = np.zeros(len(shared), np.int64)
        return pa.RecordBatch.from_pydict(
            {
                "h1": np.concatenate((h1[single], h1[shared], tokens.mix(d[head].astype(np.uint64) + p[head].astype(np.uint64)))).astype(np.int64),
                "h2": np.concatenate((h2[single].astype(np.int64), h2[shared].astype(np.int64), length)),
                "doc": np.concatenate((doc[single], zero, d[head])),
                "place": np.concatenate((place[single] | 1, zero | 2, c[head].astype(np.int64) << 32 | p[head] << 2)),
            }
        )

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes, held, size = sent.value, [], 0
        for batch in batches:
            docs, keys = batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(zero_copy_only=False)
            for begin, run in tokens.raw(batch.column(0)):
                w = Windows(run)
                if not len(w.at):
                    continue
                anchors = w.grams[w.anchor]
                at = w.at[planes.least(anchors) & (_part(anchors, passes) == number)]
                if not len(at):
                    continue
                row = np.searchsorted(w.ends, at, "right") - 1
                held.append((tokens.rolling(w.words, WINDOW, 0)[at], tokens.rolling(w.words, WINDOW, 1)[at], docs[begin + row], keys[begin + row], at - w.ends[row]))
                size += len(at)
                if size >= _FLUSH:
                    yield settled(held)
                    held, size = [], 0
        if held:
            yield settled(held)
        held = None
        tokens.trim()

    return rows.mapInArrow(found, "h1 bigint, h2 bigint, doc bigint, place bigint")


def _cut() -> F.udf:
    @F.arrow_udf(OUT)
    def cut(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, spans in batches:
            total, gone, kept = [], [], []
            for text, span in zip(texts, spans, strict=True):
                words = (text.as_buffer().to_pybytes() if text.is_valid else b"").split()
                total.append(len(words))
                if span.is_valid and len(span.values):
                    pos, size = (span.values.field(i).to_numpy() for i in (0, 1))
                    edge = np.zeros(len(words) + 1, np.int64)
                    np.add.at(edge, pos, 1)
                    np.add.at(edge, pos + size + WINDOW - 1, -1)
                    stay = np.cumsum(edge[:-1]) == 0
                    words = [w for w, s in zip(words, stay.tolist(), strict=True) if s]
                gone.append(total[-1] - len(words))
                kept.append(b" ".join(words).decode("utf-8"))
            yield pa.StructArray.from_arrays([pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], ["n_words", "n_removed", "kept_text"])

    return cut


def dedup(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``df`` with ``n_words``, ``n_removed`` and ``kept_text``: the words no repeated window covers, joined by one space."""
    passes = passes_for(df)
    doc = F.coalesce(F.col(f"`{doc_id}`").cast("long"), F.lit(-(1 << 63)))
    key = (F.crc32(F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary")) - (1 << 31)).cast("int")
    slim = df.select(F.col(f"`{text}`").alias("t"), doc.alias("doc"), key.alias("k"))
    send = df.sparkSession.sparkContext.broadcast
    # equal windows have equal anchors and so meet in one pass; their rows are grouped together afterwards
    rows = reduce(DataFrame.unionAll, [_candidates(slim, send(estimate(slim, "t", i, passes)), i, passes) for i in range(passes)])
    n = F.col("place").bitwiseAND(F.lit(3))
    total = F.sum(n).over(Window.partitionBy("h1", "h2"))
    repeated = rows.withColumn("total", total).where((n == 0) | ((n == 1) & (F.col("total") >= 2)))
    pos = F.shiftright("place", 2).bitwiseAND(F.lit((1 << 30) - 1)).cast("int")
    span = F.struct(pos.alias("pos"), F.when(n == 0, F.col("h2")).otherwise(F.lit(1)).cast("int").alias("len"))
    spans = repeated.groupBy("doc", F.shiftright("place", 32).cast("int").alias("k")).agg(F.collect_list(span).alias("spans"))
    joined = carried(df, doc=doc, k=key).join(spans, ["doc", "k"], "left")
    cut = joined.select("_row", _cut()(F.col(f"_row.`{text}`"), F.col("spans")).alias("cut"))
    return unpacked(cut, df.columns, {c: F.col(f"cut.{c}") for c in ("n_words", "n_removed", "kept_text")})
