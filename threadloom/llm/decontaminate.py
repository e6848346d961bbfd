"""Benchmark decontamination by greedy string tiling.

Seeds are runs of ``SEED`` tokens that a document and a benchmark item share. A sketch of the
benchmark's seeds, of bounded size, tells which runs of a document can be seeds at all; those
left are joined with the seeds of the items. The item positions under shared seeds bound what
tiles can cover, so pairs below the threshold are left out without loss. The others are tiled:
the longest match between unmarked tokens is found with running Karp-Rabin fingerprints (its
length by bisection, as every shorter length matches too), its non-overlapping occurrences
are marked, and so on down to ``SEED`` tokens. The share of the item under tiles is its
coverage; passages in another order are covered all the same.

The benchmark is a table like any other: only the sketch is sent to the executors, and a
fuller sketch lets more runs through to the join, never fewer. Texts do not move: a document passes on
its seeds and its tokens under them, equal texts once. Both joins are dealt by salts, as an item
may be in a third of all documents.

Defined cases: null texts have no tokens and match nothing; items with fewer tokens than
``SEED`` match only as whole runs; items without a token match nothing; repeated rows are
judged each, as are items that share an id; an empty table or benchmark gives an empty result;
extra columns are ignored by ``leaks`` and kept by ``match`` and ``clean``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import sketch
from . import tokens as tk
from .common import carried, materialize, unpacked

SEED = 5
THRESHOLD = 0.5
#: Parts that the seeds and items are dealt in, each of them held against its share of the documents.
SALTS = 16
#: ASCII punctuation, which separates tokens as white space does.
PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_TABLE = bytes.maketrans(PUNCTUATION, b" " * len(PUNCTUATION))
_GAP = 0
OUT = "array<struct<item_id:bigint,coverage:double,tiles:int,longest:int>>"


def tokens(text: str | None) -> list[bytes]:
    """Lower-case (A to Z) runs between ASCII white space and punctuation."""
    return _split((text or "").encode("utf-8"))


def _split(raw: bytes) -> list[bytes]:
    return raw.lower().translate(_TABLE).split()


def _hashed(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The fingerprints of all tokens, none of them that of a gap, and where each text begins and ends."""
    h, ends = tk.hashed([_split(t) for t in texts])
    h[h == _GAP] = 1
    return h, ends


def _prints(h: np.ndarray, n: int) -> np.ndarray:
    """The fingerprint of each run of n tokens."""
    return tk.rolling(h, n) + np.uint64(n)


def tile(doc: list[int], item: list[int], least: int = SEED) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (start in doc, start in item, length) of each tile, longest first, leftmost on ties."""
    doc_free, item_free = [True] * len(doc), [True] * len(item)
    tiles: list[tuple[int, int, int]] = []
    base, mod = 1_000_003, (1 << 61) - 1

    def prints(seq: list[int], free: list[bool], n: int) -> Iterator[tuple[int, int]]:
        """Running Karp-Rabin: the fingerprint of each window of n tokens that were unmarked at first."""
        power, h, run = pow(base, n - 1, mod), 0, 0
        for i, f in enumerate(free):
            if not f:
                run = h = 0
                continue
            if run == n:
                h = (h - seq[i - n] * power) % mod
                run -= 1
            h = (h * base + seq[i]) % mod
            run += 1
            if run == n:
                yield i - n + 1, h

    def places(n: int) -> dict[int, list[int]]:
        where: dict[int, list[int]] = {}
        for i, h in prints(item, item_free, n):
            where.setdefault(h, []).append(i)
        return where

    def matches(n: int) -> bool:
        where = places(n)
        return any(doc[d : d + n] == item[i : i + n] for d, h in prints(doc, doc_free, n) for i in where.get(h, ()))

    most, least = min(len(doc), len(item)), max(1, min(least, len(item)))
    while most >= least:
        low, high = least, most
        while low <= high:
            mid = (low + high) // 2
            low, high = (mid + 1, high) if matches(mid) else (low, mid - 1)
        size = high
        if size < least:
            break
        where, after = places(size), 0
        for d, h in prints(doc, list(doc_free), size):
            if d < after or h not in where:
                continue
            left = [i for i in where[h] if item_free[i] and item_free[i + size - 1]] if not item_free[where[h][0]] else where[h]
            for i in left:
                if item_free[i] and item_free[i + size - 1] and doc[d : d + size] == item[i : i + size]:
                    tiles.append((d, i, size))
                    doc_free[d : d + size] = item_free[i : i + size] = [False] * size
                    after = d + size
                    break
            if left:
                where[h] = left
            else:
                del where[h]  # its places are all marked
        most = size - 1
    return tiles


def _under(doc: list[int], item: list[int], n: int) -> list[int]:
    """The document's tokens under runs of n that the item has, a gap between them becoming a token that matches nothing."""
    runs = {tuple(item[i : i + n]) for i in range(len(item) - n + 1)}
    out, reach = [], -1
    for d in range(len(doc) - n + 1):
        if tuple(doc[d : d + n]) in runs:
            if d > reach:
                out.append(-1)
            out += doc[max(d, reach) : d + n]
            reach = d + n
    return out


def _items(benchmark: DataFrame, item_id: str, text: str) -> DataFrame:
    """The items that have tokens: (item, item_id, words), ``item`` numbering them."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, run in tk.raw(batch.column(1)):
                h, ends = _hashed(run)
                some = np.flatnonzero(np.diff(ends))
                words = pa.array([h[ends[i] : ends[i + 1]].view(np.int64) for i in some], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(begin + some)), words], ["item_id", "words"])

    rows = benchmark.select(F.col(f"`{item_id}`").cast("long").alias("i"), F.col(f"`{text}`").alias("t"))
    found = rows.mapInArrow(read, "item_id bigint, words array<bigint>")
    return materialize(found.withColumn("item", F.monotonically_increasing_id()), "leak-items")


def _seeds(items: DataFrame) -> DataFrame:
    """The items' seeds: (fp, item, size, places)."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, words in zip(batch.column(0), batch.column(1), strict=True):
                h = words.values.to_numpy().view(np.uint64)
                grams = _prints(h, min(SEED, len(h)))
                order = np.argsort(grams, kind="stable")
                kinds, first = np.unique(grams[order], return_index=True)
                places = pa.ListArray.from_arrays(pa.array(np.append(first, len(order)).astype(np.int32)), pa.array(order.astype(np.int32)))
                same = pa.array(np.full(len(kinds), item.as_py()))
                yield pa.RecordBatch.from_arrays([pa.array(kinds.view(np.int64)), same, pa.array(np.full(len(kinds), len(h), np.int32)), places], ["fp", "item", "size", "places"])

    return materialize(items.select("item", "words").mapInArrow(made, "fp bigint, item bigint, size int, places array<int>"), "leak-seeds")


def _hits(docs: DataFrame, sent: Broadcast, lengths: list[int]) -> DataFrame:
    """Documents (k1, k2, text) with runs that may be seeds: (k1, k2, fps, words), the runs' fingerprints and the tokens under them."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = sent.value
        for batch in batches:
            for begin, run in tk.raw(batch.column(2)):
                h, ends = _hashed(run)
                near, at, prints = np.zeros(len(h), bool), [], []
                for n in lengths:
                    grams = _prints(h, n)
                    here = np.flatnonzero(tk.starts(ends, n, len(h)) & planes.least(grams)) if len(grams) else np.zeros(0, int)
                    at.append(here)
                    prints.append(grams[here])
                    for j in range(n):
                        near[here + j] = True
                where, fps = np.concatenate(at), np.concatenate(prints)
                if not len(where):
                    continue
                owner = np.searchsorted(ends, where, "right") - 1
                order = np.argsort(owner, kind="stable")
                docs_, first = np.unique(owner[order], return_index=True)
                runs, words = [], []
                for k, (a, b) in zip(docs_, zip(first, np.append(first[1:], len(order)), strict=True), strict=True):
                    runs.append(np.unique(fps[order[a:b]]).view(np.int64))
                    inside = np.flatnonzero(near[ends[k] : ends[k + 1]])
                    words.append(np.insert(h[ends[k] + inside], np.flatnonzero(np.diff(inside) > 1) + 1, _GAP).view(np.int64))
                keys = [batch.column(i).take(pa.array(begin + docs_)) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([*keys, *(pa.array(x, pa.list_(pa.int64())) for x in (runs, words))], ["k1", "k2", "fps", "words"])
        tk.trim()

    return docs.mapInArrow(found, "k1 bigint, k2 bigint, fps array<bigint>, words array<bigint>")


_TILED = T.StructType([T.StructField("coverage", T.DoubleType()), T.StructField("tiles", T.IntegerType()), T.StructField("longest", T.IntegerType())])


@F.arrow_udf(_TILED)
def _tiled(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """Coverage, number of tiles and the longest one, for the tokens of a document and of an item."""
    for docs, items in batches:
        rows = []
        for doc, item in zip(docs, items, strict=True):
            own = item.as_py()
            found = tile(_under(doc.as_py(), own, min(SEED, len(own))), own)
            rows.append((sum(t[2] for t in found) / len(own), len(found), max((t[2] for t in found), default=0)))
        cols = list(zip(*rows, strict=True)) or [(), (), ()]
        yield pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.float64(), pa.int32(), pa.int32()), strict=True)], _TILED.names)


def _keys(text: str) -> dict[str, Column]:
    """Two fingerprints that tell texts apart."""
    whole = F.coalesce(F.col(text), F.lit(""))
    return {"k1": F.xxhash64(whole), "k2": F.shiftleft(F.crc32(whole.cast("binary")), 31) + F.length(whole)}


def _covered(docs: DataFrame, benchmark: DataFrame, text: str, threshold: float, item_id: str, item_text: str) -> DataFrame:
    """(k1, k2, item_id, coverage, tiles, longest): each different text with each item that it covers to the threshold."""
    items = _items(benchmark, item_id, item_text)
    seeds = _seeds(items)
    size = F.col("size")
    lengths = sorted(r[0] for r in seeds.select(F.least(size, F.lit(SEED))).distinct().collect())  # SEED numbers at the most
    bits = sketch.bits_of(64 * seeds.count())
    planes = sketch.build(seeds.select("fp"), lambda b: iter([b.column(0).to_numpy().view(np.uint64)]), bits, 1, (1,))
    sent = docs.sparkSession.sparkContext.broadcast(planes)
    rows = docs.select(*[c.alias(n) for n, c in _keys(f"`{text}`").items()], F.col(f"`{text}`").alias("t"))
    several = _hits(rows, sent, lengths or [SEED]).groupBy("k1", "k2").agg(F.first("fps").alias("fps"), F.first("words").alias("words"))
    hits = materialize(several, "leak-hits")
    sent.destroy()  # the hits are written, nothing asks the sketch again
    salt, every = F.pmod("k1", F.lit(SALTS)).cast("int").alias("salt"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    met = hits.select("k1", "k2", salt, F.explode("fps").alias("fp")).join(seeds.select("*", every), ["fp", "salt"])
    near = met.groupBy("k1", "k2", "salt", "item").agg(F.flatten(F.collect_list("places")).alias("places"), F.first("size").alias("size"))
    under = F.size(F.array_distinct(F.flatten(F.transform("places", lambda p: F.sequence(p, p + F.least(size, F.lit(SEED)) - 1)))))
    pairs = near.where(under >= threshold * size).select("k1", "k2", "salt", "item")
    both = pairs.join(hits.select("k1", "k2", F.col("words").alias("doc")), ["k1", "k2"]).join(items.select("item", "item_id", "words", every), ["item", "salt"])
    tiled = both.select("k1", "k2", "item_id", _tiled("doc", "words").alias("t"))
    return tiled.where(F.col("t.coverage") >= threshold).select("k1", "k2", "item_id", "t.*")


def match(docs: DataFrame, benchmark: DataFrame, text: str = "text", threshold: float = THRESHOLD, name: str = "leaks", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs`` with the column ``name``: an array of (item_id, coverage, tiles, longest), one for each item that the text covers."""
    found = _covered(docs, benchmark, text, threshold, item_id, item_text)
    listed = found.groupBy("k1", "k2").agg(F.sort_array(F.collect_list(F.struct("item_id", "coverage", "tiles", "longest"))).alias("found"))
    held = carried(docs, **_keys(f"`{text}`")).join(listed, ["k1", "k2"], "left")
    return unpacked(held, docs.columns, {name: F.coalesce("found", F.array().cast(OUT))})


def leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row for each document and each benchmark item that it covers to the threshold."""
    found = materialize(_covered(docs, benchmark, text, threshold, "item_id", "text"), "leaks")
    held = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), *[c.alias(n) for n, c in _keys(f"`{text}`").items()])
    return held.join(found, ["k1", "k2"]).drop("k1", "k2")


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that cover no benchmark item."""
    found = materialize(_covered(docs, benchmark, text, threshold, "item_id", "text").select("k1", "k2").distinct(), "leaks")
    return unpacked(carried(docs, **_keys(f"`{text}`")).join(found, ["k1", "k2"], "left_anti"), docs.columns)
