"""Language identification by prediction by partial matching (PPM) over bytes.

For each language a context tree of up to ``ORDER`` bytes is kept as counts of
(context, next byte). Coding a byte starts at the longest context; where the byte was
not seen there, an escape is paid (method C: as many escapes as different bytes seen)
and the next shorter context is tried, down to a uniform byte. Statistics are frozen
after training, so the code length of a text is an exact sum over its bytes, and the
language with the shortest code wins.

Training takes a bounded sample: for each language the ``TRAIN_DOCS`` labelled documents
with the smallest hash, as far as they fit in ``TRAIN_CHARS`` characters. The model is
therefore bounded by the number of languages. Labels are counted first, and only documents
whose hash is below ``SPARE`` times the share that is wanted are put in order, so that a language of
any size brings no more to one task than a small one. Prediction reads whole texts.

Defined cases: null text, or text without a letter, is ``und`` with score 0, as is every
text if nothing could be learned; null labels teach nothing; ties go to the first
language in order; repeated rows are predicted each; extra columns stay, ``lang_pred``
and ``score`` are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import slices
from .common import carried, unpacked

ORDER = 3
TRAIN_DOCS, TRAIN_CHARS = 400, 1_500_000
#: Documents put in order for each one wanted; four times 400 leave less than 400 in no realistic case.
SPARE = 4
_HASHES = 1 << 40
OUT = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Each byte with the ORDER bytes before it as one 32-bit key, and where each text begins; starts are padded with zeros."""
    raw = [t.lower().encode("utf-8") for t in texts]
    joined = np.frombuffer(b"".join(b"\0" * ORDER + r for r in raw), np.uint8).astype(np.uint32)
    sizes = np.array([len(r) for r in raw], np.int64)
    key = joined.copy()
    for i in range(1, ORDER + 1):
        key[i:] |= joined[:-i] << np.uint32(8 * i)
    real = np.ones(len(key), bool)
    begins = np.concatenate(([0], np.cumsum(sizes + ORDER)[:-1])).astype(np.int64)
    for i in range(ORDER):
        real[begins + i] = False
    return key[real], np.concatenate(([0], np.cumsum(sizes)))


class Tree:
    """The frozen statistics of one language, by context length."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        self.levels = []
        for order in range(ORDER + 1):
            part = keys & np.uint32((1 << 8 * (order + 1)) - 1)
            gram, back = np.unique(part, return_inverse=True)
            n = np.bincount(back, counts, len(gram))
            context, to = np.unique(gram >> np.uint32(8), return_inverse=True)
            total, kinds = np.bincount(to, n, len(context)), np.bincount(to, minlength=len(context))
            self.levels.append((gram, np.log2(n / (total + kinds)[to]), context, np.log2(kinds / (total + kinds))))

    def bits(self, keys: np.ndarray) -> np.ndarray:
        """Code length of the last byte of each key after the bytes before it."""
        out, left = np.zeros(len(keys)), np.arange(len(keys))
        for order in range(ORDER, -1, -1):
            gram, seen, context, escape = self.levels[order]
            part = keys[left] & np.uint32((1 << 8 * (order + 1)) - 1)
            at = np.minimum(np.searchsorted(gram, part), len(gram) - 1)
            hit = gram[at] == part
            out[left[hit]] -= seen[at[hit]]
            left, part = left[~hit], part[~hit] >> np.uint32(8)
            at = np.minimum(np.searchsorted(context, part), len(context) - 1)
            known = context[at] == part
            out[left[known]] -= escape[at[known]]
        out[left] += 8
        return out


def count(df: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """Counts of (lang, key) over the rows of a sample."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in sorted(set(batch.column(0).to_pylist())):
                mine = batch.filter(pa.compute.equal(batch.column(0), name)).column(1)
                for run in slices(mine):
                    keys, n = np.unique(grams(run)[0], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(keys), pa.string()), pa.array(keys.astype(np.int64)), pa.array(n)], ["lang", "key", "n"])

    rows = df.select(F.col(lang).alias("lang"), F.col(text).alias("text")).mapInArrow(counted, "lang string, key bigint, n bigint")
    return rows.groupBy("lang", "key").agg(F.sum("n").alias("n"))


def fit(df: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> dict[str, Tree]:
    """The model of the labelled rows of ``df``; reads its ids, labels and lengths, then the sampled texts only."""
    labelled = df.select(*[F.col(f"`{c}`").alias(n) for c, n in ((doc_id, "doc"), (text, "text"), (lang, "lang"))]).where("lang is not null and text is not null")
    slim = labelled.select("lang", "doc", F.pmod(F.xxhash64("doc"), F.lit(_HASHES)).alias("h"), F.length("text").alias("size"))
    known = slim.groupBy("lang").agg((SPARE * TRAIN_DOCS / F.count("*")).alias("share"), F.min("h").alias("least"))
    below = slim.join(F.broadcast(known), "lang").where((F.col("h") < F.col("share") * _HASHES) | (F.col("h") == F.col("least")))  # a row a language
    order = Window.partitionBy("lang").orderBy("h", "doc", "size")
    first = below.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= TRAIN_DOCS)
    fits = first.withColumn("chars", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))).where((F.col("chars") <= TRAIN_CHARS) | (F.col("rn") == 1))
    picked = fits.select("doc", "lang").distinct()
    sample = labelled.join(F.broadcast(picked), ["doc", "lang"], "left_semi")
    counts = count(sample).toPandas()
    return {name: Tree(part["key"].to_numpy(np.uint32), part["n"].to_numpy(float)) for name, part in counts.groupby("lang", sort=True)}


def predict(df: DataFrame, model: dict[str, Tree], text: str = "text") -> DataFrame:
    """``df`` with ``lang_pred`` and ``score``, the share of the winner under equal priors."""
    sent = df.sparkSession.sparkContext.broadcast((list(model), list(model.values())))

    @F.arrow_udf(OUT)
    def predicted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        names, trees = sent.value
        for batch in batches:
            langs, scores = [], []
            for run in slices(batch):
                sums = np.zeros((len(trees), len(run)))
                keys, ends = grams(run)
                if len(keys) and trees:
                    codes, kinds = pd.factorize(keys)
                    some = np.flatnonzero(np.diff(ends) > 0)
                    for i, tree in enumerate(trees):
                        sums[i, some] = np.add.reduceat(tree.bits(kinds)[codes], ends[some])
                for j, t in enumerate(run):
                    if not trees or not any(map(str.isalpha, t)):
                        langs.append("und")
                        scores.append(0.0)
                        continue
                    best = int(np.argmin(sums[:, j]))
                    langs.append(names[best])
                    scores.append(float(1 / np.exp2(np.maximum(sums[best, j] - sums[:, j], -1000)).sum()))
            yield pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["lang_pred", "score"])

    held = carried(df, p=predicted(F.col(f"`{text}`")))
    return unpacked(held, df.columns, {"lang_pred": F.col("p.lang_pred"), "score": F.col("p.score")})
