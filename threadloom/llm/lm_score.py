"""Stupid-backoff scores from n-gram counts of the whole corpus.

The corpus is its own language model: a document is scored with the counts of all other
documents, its own occurrences taken away, so that nothing is predicted from itself.

    S(w | u v) = c(u v w) / c(u v)              if c(u v w) > 0
               = ALPHA * c(v w) / c(v)          else if c(v w) > 0
               = ALPHA^2 * c(w) / N             else if c(w) > 0
               = ALPHA^3 / N                    else

N counts all words of other documents, one at least. A document's score is the sum of log10 S
over its words, the first two words having shorter contexts.

The counts are a table partitioned by hash. Exploded n-grams are not moved one by one:
documents are dealt into blocks by a hash of the document, a block sends each n-gram that
it holds once, with its count, to the n-gram's partition (sorted fingerprints as
transposed differences); the partition adds up all blocks and answers each block in its own
order; the block joins the answers to its n-grams and sums per document. A first pass measures
the texts; blocks and partitions are as many as their bytes ask for, so either side's memory is bounded,
and an n-gram that every document holds travels once for each block. Rows are dealt by all of their columns
and the partition they are read from, so that repeated rows spread.

Defined cases: words are lower-case (A to Z) runs between ASCII white space; null or empty
texts have no words, a score of 0 and a null mean; repeated rows are documents of their
own; an empty table stays empty; ``score`` adds ``n_words``, ``log_score``, ``mean_log_score``
to the columns of its input and replaces columns of these names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import tokens
from .common import carried, fingerprint, unpacked

ORDER = 3
ALPHA = 0.4
#: Bytes of text for each block of documents, and for each partition of the counts.
BLOCK_BYTES, PART_BYTES = 14 << 20, 14 << 20
#: Low bits of a fingerprint that are dropped; 56 are kept, which n-grams share by chance about once in seven million where ten billion differ.
DROPPED = np.uint64(8)
_RUN = 1 << 20


def measure(df: DataFrame, text: str = "text") -> tuple[int, int]:
    """(bytes, words) of all texts."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = words = 0
        for batch in batches:
            for _, run in tokens.raw(batch.column(0)):
                size += sum(map(len, run))
                words += sum(len(t.split()) for t in run)
        tokens.trim()
        yield pa.RecordBatch.from_arrays([pa.array([size]), pa.array([words])], ["size", "words"])

    found = df.select(F.col(f"`{text}`").alias("t")).mapInArrow(counted, "size bigint, words bigint").agg(F.sum("size"), F.sum("words")).first()
    return found[0] or 0, found[1] or 0


class Block:
    """The n-grams of a block's documents: for each order the fingerprints in document order and the distinct ones, sorted."""

    def __init__(self, texts: pa.ChunkedArray | pa.Array):
        words, sizes = [], []
        for chunk in texts.chunks if isinstance(texts, pa.ChunkedArray) else [texts]:
            for _, run in tokens.raw(chunk, _RUN):
                h, ends = tokens.hashed([t.lower().split() for t in run])
                words.append(h)
                sizes.append(np.diff(ends))
        h = np.concatenate(words) if words else np.zeros(0, np.uint64)
        del words
        size = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
        self.n_words = size
        self.ends = np.concatenate(([0], np.cumsum(size)))
        self.doc = np.repeat(np.arange(len(size), dtype=np.int32), size)
        self.kinds, self.at, self.own = [], [], []
        for n in range(1, ORDER + 1):
            grams = (tokens.rolling(h, n) + np.uint64(n)) >> DROPPED << DROPPED
            inside = self.doc[: len(grams)] == self.doc[n - 1 :] if len(grams) else np.zeros(0, bool)
            codes, kinds = pd.factorize(grams[inside])
            order = np.argsort(kinds)
            place = np.empty(len(kinds), np.int32)
            place[order] = np.arange(len(kinds), dtype=np.int32)
            at = np.full(len(h), -1, np.int32)  # by first word, -1 where the text ends before
            at[np.flatnonzero(inside)] = place[codes]
            self.kinds.append(kinds[order])
            self.at.append(at)
            self.own.append(np.bincount(codes, minlength=len(kinds))[order])

    def _elsewhere(self, n: int, totals: np.ndarray) -> np.ndarray:
        """At each word that begins an n-gram: how often it occurs in other documents."""
        at = self.at[n]
        ok = np.flatnonzero(at >= 0)
        pair = self.doc[ok].astype(np.int64) << 32 | at[ok]
        codes, kinds = pd.factorize(pair)
        out = np.zeros(len(at), np.int64)
        out[ok] = totals[at[ok]] - np.bincount(codes, minlength=len(kinds))[codes]
        return out

    def score(self, totals: list[np.ndarray], all_words: int) -> tuple[np.ndarray, np.ndarray]:
        """(words, sum of log10 S) of each document, given each distinct n-gram's count in the corpus."""
        others = np.maximum(1, all_words - self.n_words)[self.doc].astype(float)
        shorter = self._elsewhere(0, totals[0])
        before = (np.arange(len(self.doc)) - self.ends[self.doc]).astype(np.int32)  # words before each in its text
        longest = np.minimum(ORDER - 1, before)  # the history it can have
        value = ALPHA ** longest.astype(float) * np.where(shorter > 0, np.maximum(shorter, 1), ALPHA) / others
        del others
        for n in range(1, ORDER):
            longer = self._elsewhere(n, totals[n])
            word = np.flatnonzero(before >= n)
            word = word[longer[word - n] > 0]
            value[word] = ALPHA ** (longest[word] - n).astype(float) * longer[word - n] / shorter[word - n]
            shorter = longer
        sums = np.bincount(self.doc, np.log10(value), len(self.n_words)) if len(value) else np.zeros(len(self.n_words))
        return self.n_words, sums


def pack(values: np.ndarray) -> bytes:
    """Sorted fingerprints as differences, bytes of equal weight together."""
    return np.diff(values >> DROPPED, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def unpack(raw: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view("<u8").ravel(), dtype=np.uint64) << DROPPED


def _thin(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _thick(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


_SENT = "part int, block int, n int, grams binary, counts binary"
_ANSWER = "block int, part int, n int, counts binary"


def score(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with ``n_words``, ``log_score`` and ``mean_log_score`` of each text."""
    size, all_words = measure(df, text)
    blocks = max(1, -(-size // BLOCK_BYTES))
    bits = max(1, -(-size // PART_BYTES)).bit_length()
    place = F.pmod(fingerprint(df, F.spark_partition_id()), F.lit(blocks)).cast("int")
    dealt = carried(df, block=place).select("block", "_row")
    texts = lambda table: table.column("_row").combine_chunks().field(text)

    def send(table: pa.Table) -> pa.Table:
        block = Block(texts(table))
        number = table.column("block")[0].as_py()
        del table
        out: dict[str, list] = {"part": [], "block": [], "n": [], "grams": [], "counts": []}
        for n in range(ORDER):
            kinds, own = block.kinds[n], block.own[n]
            part = (kinds >> np.uint64(64 - bits)).astype(np.int32)
            cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(kinds)] if len(kinds) else [0]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                for key, v in zip(out, (int(part[a]), number, n, pack(kinds[a:b]), _thin(own[a:b])), strict=True):
                    out[key].append(v)
        del block
        tokens.trim()
        return pa.table([pa.array(v, k) for v, k in zip(out.values(), (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], list(out))

    def add(table: pa.Table) -> pa.Table:
        grams = [unpack(x.as_py()) for x in table.column("grams")]
        counts = [_thick(x.as_py()) for x in table.column("counts")]
        back, kinds = pd.factorize(np.concatenate(grams))
        total = np.bincount(back, np.concatenate(counts), len(kinds)).astype(np.int64)
        ends = np.cumsum([len(g) for g in grams])
        answers = [_thin(total[back[e - len(g) : e]]) for g, e in zip(grams, ends, strict=True)]
        del grams, counts, back, kinds, total
        tokens.trim()
        return pa.table([table.column("block"), table.column("part"), table.column("n"), pa.array(answers, pa.binary())], ["block", "part", "n", "counts"])

    sent = dealt.groupBy("block").applyInArrow(send, _SENT)
    answers = sent.groupBy("part").applyInArrow(add, _ANSWER)
    scored = pa.struct([("n_words", pa.int64()), ("log_score", pa.float64())])

    def join(left: pa.Table, right: pa.Table) -> pa.Table:
        block = Block(texts(left))
        totals = []
        part, order = right.column("part").to_numpy(), right.column("n").to_numpy()
        for n in range(ORDER):
            mine = np.flatnonzero(order == n)
            mine = mine[np.argsort(part[mine])]
            found = [_thick(right.column("counts")[int(i)].as_py()) for i in mine]
            totals.append(np.concatenate(found) if found else np.zeros(0, np.int64))
        n_words, sums = block.score(totals, all_words)
        out = pa.table([left.column("_row"), pa.StructArray.from_arrays([pa.array(n_words, pa.int64()), pa.array(sums)], fields=list(scored))], ["_row", "s"])
        del block, totals
        tokens.trim()
        return out

    kind = dealt.select("_row").schema.add("s", T.StructType([T.StructField("n_words", T.LongType()), T.StructField("log_score", T.DoubleType())]))
    out = dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(join, kind)
    mean = F.when(F.col("s.n_words") > 0, F.col("s.log_score") / F.col("s.n_words"))
    return unpacked(out, df.columns, {"n_words": F.col("s.n_words"), "log_score": F.col("s.log_score"), "mean_log_score": mean})
