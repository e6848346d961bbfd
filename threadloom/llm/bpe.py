"""BPE encoding with a segment tree over adjacent pair ranks, and decoding.

A word starts as single symbols. The leaves of a segment tree hold, for each adjacent
pair, its merge rank and its place; inner nodes hold the smaller child, so the root is
the leftmost pair of lowest rank. A merge changes at most three leaves and so costs a
logarithmic number of steps; the word is done when the root holds no rank.

The vocabulary file is that of a public tokenizer: NFC, white space folded, lower case,
words split by a pattern, bytes written as printable characters, ``</w>`` on a word's last
symbol, special tokens recognised in the raw text. Its path is a parameter.

Defined cases: a null or empty text gives no ids and an empty decoding; extra columns stay,
one named like a result is replaced; repeated rows are encoded each; texts of any length
are encoded whole.
"""

from __future__ import annotations

import functools
import json
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import carried, unpacked
from .tokens import trim

#: Bytes that are printable and stand for themselves in a byte-level vocabulary; the others follow from U+0100 on.
_PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
#: Words remembered by each Python worker, in two generations: the older one goes when the younger is full.
CACHE_WORDS = 150_000
_RUN = 1 << 20
OUT = T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType(), False)), T.StructField("decoded", T.StringType())])


def _byte_letters() -> dict[int, str]:
    rest = [b for b in range(256) if b not in set(_PRINTABLE)]
    return {b: chr(b) for b in _PRINTABLE} | {b: chr(256 + i) for i, b in enumerate(rest)}


class PairTree:
    """Adjacent pair ranks of one word under point updates; ``top`` is the leftmost pair of lowest rank."""

    NONE = 1 << 62

    def __init__(self, ranks: list[int]):
        self.size = size = 1 << max(0, len(ranks) - 1).bit_length()
        none = self.NONE
        self.node = node = [none] * (2 * size)
        for i, r in enumerate(ranks):
            if r >= 0:
                node[size + i] = r * size + i
        for i in range(size - 1, 0, -1):
            a, b = node[2 * i], node[2 * i + 1]
            node[i] = a if a < b else b

    def top(self) -> tuple[int, int] | None:
        v = self.node[1]
        return None if v == self.NONE else divmod(v, self.size)

    def put(self, i: int, rank: int) -> None:
        node, k = self.node, self.size + i
        v = rank * self.size + i if rank >= 0 else self.NONE
        if node[k] == v:
            return
        node[k] = v
        k >>= 1
        while k:
            a, b = node[2 * k], node[2 * k + 1]
            v = a if a < b else b
            if node[k] == v:
                return
            node[k] = v
            k >>= 1


class Bpe:
    """A vocabulary file ready for encoding and decoding."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.rank: dict[int, int] = {}
        self.made: list[int] = []
        for n, (a, b) in enumerate(model["merges"]):
            self.rank[self.vocab[a] << 20 | self.vocab[b]] = n
            self.made.append(self.vocab[a + b])
        letters = _byte_letters()
        self.inner = [self.vocab[letters[b]] for b in range(256)]
        self.last = [self.vocab[letters[b] + self.suffix] for b in range(256)]
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(split["pattern"]["Regex"], regex.V1).findall
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def word(self, text: str) -> list[int]:
        """The ids of one word."""
        raw = text.encode("utf-8")
        inner = self.inner
        ids = [inner[b] for b in raw[:-1]]
        ids.append(self.last[raw[-1]])
        n, get = len(ids), self.rank.get
        if n == 1:
            return ids
        tree = PairTree([get(ids[i] << 20 | ids[i + 1], -1) for i in range(n - 1)])
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while (top := tree.top()) is not None:
            rank, i = top
            j = after[i]
            k = after[j]
            ids[i] = made = self.made[rank]
            ids[j] = -1
            after[i] = k
            if k < n:
                tree.put(j, -1)
                before[k] = i
                tree.put(i, get(made << 20 | ids[k], -1))
            else:
                tree.put(i, -1)
            if (p := before[i]) >= 0:
                tree.put(p, get(ids[p] << 20 | made, -1))
        return [x for x in ids if x >= 0]

    def normalise(self, text: str) -> str:
        """NFC and lower case letter by letter (a final sigma has no form of its own); the splitting pattern skips white space anyway."""
        text = unicodedata.normalize("NFC", text)
        return (text.replace("Σ", "σ") if "Σ" in text else text).lower()

    def known(self, words: list[str]) -> dict[str, bytes]:
        """The ids of each of the words, as little-endian 32-bit integers."""
        young, old = self.young, self.old
        found: dict[str, bytes] = {}
        for w in set(words):
            b = young.get(w)
            if b is None:
                b = old.get(w)
                if b is None:
                    b = array("i", self.word(w)).tobytes()
                young[w] = b
            found[w] = b
        if len(young) > CACHE_WORDS:
            self.old, self.young = young, {}
        return found

    def encode_bytes(self, text: str) -> bytes:
        out = []
        for part in self.cut(text):
            if part in self.special:
                out.append(array("i", [self.special[part]]).tobytes())
            elif part:
                words = self.words(self.normalise(part))
                out.append(b"".join(map(self.known(words).__getitem__, words)))
        return b"".join(out)

    def encode(self, text: str) -> list[int]:
        return list(array("i", self.encode_bytes(text)))

    def decode(self, ids) -> str:
        """Tokens joined by one space, special ones kept, as the vocabulary has no decoder of its own."""
        return " ".join(map(self.token.__getitem__, ids))


@functools.lru_cache(4)
def load(path: str) -> Bpe:
    """One vocabulary for each Python worker and path."""
    return Bpe(path)


def slices(texts: pa.Array, most: int = 1 << 22) -> Iterator[list[str]]:
    """The texts of a batch in runs of bounded size (or single texts), null as empty."""
    run, size = [], 0
    for t in texts:
        s = t.as_py() or ""
        run.append(s)
        size += len(s)
        if size >= most:
            yield run
            run, size = [], 0
    if run:
        yield run


def transcoder(path: str):
    """An Arrow function from texts to (ids, decoding of these ids)."""

    @F.arrow_udf(OUT)
    def transcode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = load(path)
        token = np.array([bpe.token[i] for i in range(len(bpe.token))], dtype=object)
        for batch in batches:
            for run in slices(batch, _RUN):
                ids = [np.frombuffer(bpe.encode_bytes(t), np.int32) for t in run]
                ends = np.zeros(len(run) + 1, np.int32)
                np.cumsum([len(x) for x in ids], out=ends[1:])
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids)))
                decoded = pa.array([" ".join(token[x].tolist()) for x in ids], pa.string())
                yield pa.StructArray.from_arrays([lists, decoded], ["ids", "decoded"])
        trim()

    return transcode


def transcode(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``df`` with ``ids`` of the whole text and ``decoded``, read back from them."""
    held = carried(df, bpe=transcoder(path)(F.col(f"`{text}`")))
    return unpacked(held, df.columns, {"ids": F.col("bpe.ids"), "decoded": F.col("bpe.decoded")})
