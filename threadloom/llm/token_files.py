"""Token ids in grammar-compressed shard files.

Documents are dealt into ranges of ascending ``doc_id``. Each task turns its range into
shards of about ``SHARD_IDS`` ids and compresses each with Re-Pair: the frequent
adjacent pairs of symbols are replaced by nonterminals, again and again, until no pair
is left ``LEAST_COUNT`` times. A shard stores its rules, the length that each rule expands to, the remaining
sequence, and where every document begins in it. No rule crosses the end of a document,
so a document is decoded by expanding its own symbols only; ``Shard.lengths`` also places
any id without expanding what is before it.

Layout of a shard, little-endian: ``MAGIC``; version, symbol width in bytes, number of
documents, of ids, of base symbols, of rules, of sequence symbols (seven 64-bit integers);
document ids (64), documents' first ids and the end (64), documents' first symbols and
the end (64), rules as symbol pairs (32), expansion lengths (32), the sequence; then the
CRC-32 of all that. Shards are the rows of a Parquet table, as Spark's writers reach any
store: ``part``, ``seq``, ``inside`` (ids before it in its range), ``n_docs``, ``n_ids``, ``shard``.

Defined cases: a null or empty text has the end id only; null ids come first, equal ids
are ordered by text; repeated rows are stored each; an empty table gives an empty table;
extra columns are not stored.
"""

from __future__ import annotations

import gc
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .bpe import _byte_letters
from .tokens import raw, trim

MAGIC, VERSION = b"TLRP", 1
END_ID = 1
SHARD_IDS = 1 << 19
#: Re-Pair: pairs replaced in one round, and least occurrences of a pair.
PAIRS_A_ROUND, LEAST_COUNT = 2048, 32
#: Bytes of input files for each range of documents.
RANGE_BYTES = 12 << 20
#: Ranges at the most, which bounds the table of their sizes (16 bytes each) that a reader broadcasts.
MAX_RANGES = 1 << 20
#: Words in one generation of a worker's cache.
CACHE_WORDS = 350_000
_COUNT_BITS, _RUN = 17, 1 << 19
#: 16-bit symbols that a rule takes up.
_RULE = 6


#: Small letters of ASCII and Latin-1, and a group of marks after them, of which no special token or contraction can be a part.
_MARKS = "#*$%&.,;:!?"
_STEM = re.compile(rb"((?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+)([" + re.escape(_MARKS).encode() + rb"]*)").fullmatch
_LETTERS = {b: c for b, c in _byte_letters().items() if b >= 0x80}


def _spelled(words: list[bytes]) -> str:
    """The words as a byte-level vocabulary writes them."""
    return b" ".join(words).decode("latin-1").translate(_LETTERS)


class WordCache:
    """The library's ids of words, kept in two generations; a text's ids are those of its words, as white space separates tokens.

    New words are encoded in long texts, as the library takes much longer over many short
    ones. Words of letters only become one token group each, whose last id ends a word, so
    spaces part them; a mark of punctuation after them is a group of its own. Other words
    are parted by a special token.
    """

    _CHUNK = 1000

    def __init__(self, path: str):
        gc.freeze()
        gc.disable()  # millions of small objects without cycles: collections would only walk them
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; threads of its own only wait for one another
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        special = [(t.content, i) for i, t in self.tokenizer.get_added_tokens_decoder().items() if t.special and not (t.normalized or t.lstrip or t.rstrip or t.single_word)]
        self.mark = special[0] if special else None
        self.texts = [t for t, _ in special]
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.last = np.zeros(self.tokenizer.get_vocab_size(with_added_tokens=True), bool)
        if suffix:
            self.last[[i for t, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if t.endswith(suffix)]] = True
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.direct = self._direct(path) if suffix else None

    def _direct(self, path: str):
        """The library's model without its normalising and splitting, for words that these leave alone; None where a probe of the vocabulary disagrees."""
        from tokenizers import Tokenizer, pre_tokenizers

        found = Tokenizer.from_file(path)
        found.no_padding()
        found.no_truncation()
        found.normalizer = None
        found.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        suffix = self.tokenizer.model.end_of_word_suffix
        probe = sorted({t.removesuffix(suffix) for t in self.tokenizer.get_vocab(with_added_tokens=False)})
        probe = [t for t in probe if t.isascii() and t.isalpha() and t == t.lower()]
        words = [a + b for a, b in zip(probe, probe[7:] + probe[:7], strict=True)][::17] + probe[::5]
        accents = [chr(c) for c in (0xDF, *range(0xE0, 0xF7), *range(0xF8, 0x100))]
        for i, w in enumerate(probe[: 40 * len(accents)]):
            c = accents[i % len(accents)]
            words += [c + w, w + c, w[:1] + c + w[1:]]
        same = self._ids([" ".join(words)])[0].tolist() == self._ids([_spelled([w.encode() for w in words])], found)[0].tolist()
        tails = [*_MARKS, *(a + b for a in _MARKS for b in _MARKS)]
        apart = all(a.tolist() == b.tolist() for a, b in zip(self._ids([f"ab{t}" for t in tails]), self._ids([f"ab {t}" for t in tails]), strict=True))
        return found if same and apart and probe else None

    def _ids(self, texts: list[str], tokenizer=None) -> list[np.ndarray]:
        return [np.array(e.ids, np.int32) for e in (tokenizer or self.tokenizer).encode_batch_fast(texts, add_special_tokens=False)]

    def _spell(self, words: list[bytes], into: dict[bytes, bytes]) -> None:
        """The ids of words that the model takes without normalising and splitting."""
        parts = [words[i : i + self._CHUNK] for i in range(0, len(words), self._CHUNK)]
        for part, ids in zip(parts, self._ids([_spelled(part) for part in parts], self.direct), strict=True):
            raw_ids, a = ids.tobytes(), 0
            for w, b in zip(part, ((np.flatnonzero(self.last[ids]) + 1) * 4).tolist(), strict=True):
                into[w] = raw_ids[a:b]
                a = b

    def _learn(self, words: list[bytes]) -> None:
        young, plain, rest = self.young, [], []
        if self.direct is not None:
            ready, tailed, others = [], [], []
            for w in words:
                if w.isalpha() and w.islower():  # ASCII, as these are bytes
                    ready.append(w)
                elif (m := _STEM(w)) is None:
                    others.append(w)
                elif m[2]:
                    tailed.append((w, *m.groups()))
                else:
                    ready.append(w)
            self._spell(ready, young)
            own: dict[bytes, bytes] = {}
            self._spell(list({x for _, x, _ in tailed if x not in young}), own)
            marks = list({t for _, _, t in tailed})
            after = dict(zip(marks, (x.tobytes() for x in self._ids([t.decode("ascii") for t in marks])), strict=True))
            for w, x, t in tailed:
                young[w] = (own.get(x) or young[x]) + after[t]
            words = others
        for w in words:
            s = w.decode("utf-8")
            if s.isalpha():
                plain.append((w, s, ""))
            elif s[-1] in ".,;:!?" and s[:-1].isalpha():
                plain.append((w, s[:-1], s[-1]))
            else:
                rest.append((w, s))
        tails = {"": b""} | {t: self._ids([t])[0].tobytes() for t in {x[2] for x in plain} - {""}}
        parts = [plain[i : i + self._CHUNK] for i in range(0, len(plain), self._CHUNK)]
        for part, ids in zip(parts, self._ids([" ".join(x[1] for x in part) for part in parts]), strict=True):
            ends = (np.flatnonzero(self.last[ids]) + 1) * 4
            if len(ends) != len(part):  # a letter that lower case turns into more than letters
                rest += [(w, s + t) for w, s, t in part]
                continue
            raw_ids, a = ids.tobytes(), 0
            for (w, _, t), b in zip(part, ends.tolist(), strict=True):
                young[w] = raw_ids[a:b] + tails[t]
                a = b
        odd = [x for x in rest if self.mark is None or any(t in x[1] for t in self.texts)]
        for (w, _), ids in zip(odd, self._ids([s for _, s in odd]), strict=True):
            young[w] = ids.tobytes()
        rest = [x for x in rest if x[0] not in young] if odd else rest
        parts = [rest[i : i + self._CHUNK] for i in range(0, len(rest), self._CHUNK)] if self.mark else []
        for part, ids in zip(parts, self._ids([self.mark[0].join(s for _, s in part) for part in parts]) if parts else [], strict=True):
            raw_ids, a = ids.tobytes(), 0
            for (w, _), b in zip(part, [*(np.flatnonzero(ids == self.mark[1]) * 4).tolist(), len(raw_ids)], strict=True):
                young[w] = raw_ids[a:b]
                a = b + 4

    def encode(self, texts: list[bytes], end: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, each text closed by ``end``, and where each begins and the last one ends."""
        docs = [_apart(t).split() for t in texts]
        if len(self.young) > CACHE_WORDS:
            self.old, self.young = self.young, {}
        young = self.young
        found = [list(map(young.get, d)) for d in docs]
        gaps = [_gaps(f) for f in found]
        unknown = {d[i] for d, g in zip(docs, gaps, strict=True) for i in g}
        if unknown:
            kept = {w: x for w in unknown if (x := self.old.get(w)) is not None}
            young.update(kept)
            self._learn(list(unknown - kept.keys()))
            for d, f, g in zip(docs, found, gaps, strict=True):
                for i in g:
                    f[i] = young[d[i]]
        last = np.array([end], np.int32).tobytes()
        for f in found:
            f.append(last)
        parts = [b"".join(f) for f in found]
        ends = np.cumsum([0] + [len(p) // 4 for p in parts])
        return np.frombuffer(b"".join(parts), np.int32), ends


def _gaps(values: list) -> list[int]:
    """Where None stands in a list, most of which is something else."""
    out, at = [], -1
    try:
        while True:
            at = values.index(None, at + 1)
            out.append(at)
    except ValueError:
        return out


_KIND = bytes(ord(" ") if c in b" \t\n\r\x0b\x0c" else ord("a") if c >= 128 or chr(c).isalnum() else ord("p") for c in range(256))
_ASCII = bytes(range(128))


def _apart(text: bytes) -> bytes:
    """The text with fewer different words, but the same ids: ASCII letters in lower case, single marks after letters or digits apart.

    Left as it is where a special token could be in it, where a mark might belong to a group of
    marks, or where it has characters other than ASCII and the Latin-1 letters.
    """
    if b"<|" in text:
        return text
    text = text.lower()
    if not text.isascii():
        other = text.translate(None, _ASCII)
        if other.count(b"\xc3") * 2 != len(other) or b"\xc3\x97" in other or b"\xc3\xb7" in other:
            return text
    if b"pp" in text.translate(_KIND):
        return text
    for mark in (b".", b","):
        text = text.replace(mark + b" ", b" " + mark + b" ").replace(mark + b"\n", b" " + mark + b"\n")
    return text


def _gather(table: np.ndarray, start: np.ndarray, size: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """The stretches of ``table`` that the codes name, one after another."""
    n = size[codes]
    first = np.cumsum(n) - n
    return table[np.repeat(start[codes] - first, n) + np.arange(int(n.sum()))] if len(codes) else table[:0]


_CACHES: dict[str, WordCache] = {}


def cache(path: str) -> WordCache:
    """One for each Python worker and path."""
    if path not in _CACHES:
        _CACHES[path] = WordCache(path)
    return _CACHES[path]


def repair(ids: np.ndarray, base: int, end: int = END_ID) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Re-Pair by rounds: (sequence, rules, original places of the sequence's symbols).

    Each round counts adjacent pairs in a table of hashed buckets, counts the pairs of full
    buckets exactly, and replaces the most frequent ones. Where chosen pairs overlap, the
    more frequent one is replaced, and of equals every other one from the left. Rounds go on
    until no pair reaches ``LEAST_COUNT``, or symbols of 16 bits run out: one more rule would
    widen every symbol.
    """
    seq, place, rules = ids.astype(np.int32), np.arange(len(ids), dtype=np.int32), []
    n_rules, most = 0, (1 << 16) - base if base <= 1 << 16 else 1 << 31
    while len(seq) > 1 and n_rules < most:
        a, b = seq[:-1], seq[1:]
        bucket = ((a.astype(np.uint32) * np.uint32(2654435761) + b.astype(np.uint32) * np.uint32(40503)) >> np.uint32(32 - _COUNT_BITS)).astype(np.int32)
        apart = (a == end) | (b == end)
        full = np.bincount(bucket, minlength=1 << _COUNT_BITS) - np.bincount(bucket[apart], minlength=1 << _COUNT_BITS)
        for limit in (max(LEAST_COUNT, int(np.partition(full, -PAIRS_A_ROUND)[-PAIRS_A_ROUND])), LEAST_COUNT):
            at = np.flatnonzero((full >= limit)[bucket] & ~apart)
            key = a[at].astype(np.int64) << 32 | b[at]
            codes, kinds = pd.factorize(key)
            n = np.bincount(codes, minlength=len(kinds))
            chosen = np.lexsort((kinds, -n))[: min(PAIRS_A_ROUND, most - n_rules)]
            chosen = chosen[n[chosen] >= LEAST_COUNT]
            if len(chosen) or limit == LEAST_COUNT:
                break
        if not len(chosen):
            break
        rank = np.full(len(kinds) + 1, PAIRS_A_ROUND, np.int32)
        rank[chosen] = np.arange(len(chosen), dtype=np.int32)
        here = np.full(len(seq) + 1, PAIRS_A_ROUND, np.int32)
        here[at + 1] = rank[codes]
        mid = here[1:-1]
        same = np.flatnonzero((mid == here[:-2]) & (mid < PAIRS_A_ROUND))  # inside runs of one symbol
        if len(same):
            first = np.concatenate(([True], np.diff(same) > 1))
            nth = np.arange(len(same)) - np.maximum.accumulate(np.where(first, np.arange(len(same)), 0))
            mid[same[nth % 2 == 0]] = PAIRS_A_ROUND
        put = np.flatnonzero((mid < PAIRS_A_ROUND) & (mid < here[:-2]) & (mid <= here[2:]))
        good = np.bincount(mid[put], minlength=len(chosen)) > _RULE  # where others took its places, a pair waits for the next round
        put = put[good[mid[put]]]
        picked = kinds[chosen[good]]
        rules.append(np.stack((picked >> 32, picked & 0xFFFFFFFF), 1).astype(np.int32))
        seq[put] = base + n_rules + (np.cumsum(good) - 1)[mid[put]]
        stay = np.ones(len(seq), bool)
        stay[put + 1] = False
        seq, place = seq[stay], place[stay]
        n_rules += len(picked)
    return seq, np.concatenate(rules) if rules else np.zeros((0, 2), np.int32), place


def pack(doc_ids: np.ndarray, starts: np.ndarray, ids: np.ndarray, base: int, end: int = END_ID) -> bytes:
    """One shard."""
    seq, rules, place = repair(ids, base, end)
    length = np.ones(base + len(rules), np.int64)
    for i, (x, y) in enumerate(rules.tolist()):
        length[base + i] = length[x] + length[y]
    symbol = np.searchsorted(place, starts)
    width = np.uint16 if base + len(rules) <= 1 << 16 else np.uint32
    head = np.array([VERSION, np.dtype(width).itemsize, len(doc_ids), len(ids), base, len(rules), len(seq)], "<i8")
    body = b"".join(
        x.tobytes()
        for x in (head, doc_ids.astype("<i8"), starts.astype("<i8"), symbol.astype("<i8"), rules.astype("<i4"), length[base:].astype("<u4"), seq.astype(width))
    )
    return MAGIC + body + np.uint32(zlib.crc32(MAGIC + body)).tobytes()


class Shard:
    """A shard opened for reading."""

    def __init__(self, blob: bytes):
        if blob[:4] != MAGIC or zlib.crc32(blob[:-4]) != int(np.frombuffer(blob[-4:], "<u4")[0]):
            raise ValueError("not a whole shard")
        version, width, docs, self.n_ids, self.base, rules, size = np.frombuffer(blob, "<i8", 7, 4).tolist()
        if version != VERSION:
            raise ValueError(f"shard version {version}")
        at = 4 + 56
        parts = []
        for kind, n in (("<i8", docs), ("<i8", docs + 1), ("<i8", docs + 1), ("<i4", 2 * rules), ("<u4", rules), (f"<u{width}", size)):
            parts.append(np.frombuffer(blob, kind, n, at))
            at += parts[-1].nbytes
        self.doc_ids, self.starts, self.symbols, pairs, self.lengths, self.seq = parts
        flat, first = [np.arange(self.base, dtype=np.int32)], np.concatenate((np.arange(self.base), np.zeros(rules, np.int64)))
        grown: list[np.ndarray] = []
        total = self.base
        one = lambda s: grown[s - self.base] if s >= self.base else flat[0][s : s + 1]
        for i, (a, b) in enumerate(pairs.reshape(-1, 2).tolist()):
            grown.append(np.concatenate((one(a), one(b))))
            first[self.base + i] = total
            total += len(grown[-1])
        self.table = np.concatenate(flat + grown)
        self.first = first
        self.size = np.concatenate((np.ones(self.base, np.int64), self.lengths.astype(np.int64)))

    def ids(self, doc: int, to: int | None = None) -> np.ndarray:
        """The ids of one document of the shard, or of the documents from ``doc`` up to ``to``."""
        part = self.seq[self.symbols[doc] : self.symbols[doc + 1 if to is None else to]].astype(np.int64)
        return _gather(self.table, self.first, self.size, part)


def write(df: DataFrame, path: str, vocabulary: str, doc_id: str = "doc_id", text: str = "text", end: int = END_ID) -> None:
    """Write the ids of all texts of ``df`` as shards to ``path``, in ascending ``doc_id`` order."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size()))
    ranges = max(1, min(MAX_RANGES, -(-size // RANGE_BYTES))) if size < 1 << 60 else 200

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part, seq, inside = cache(vocabulary), TaskContext.get().partitionId(), 0, 0
        base = max(words.tokenizer.get_vocab_size(with_added_tokens=True), end + 1)
        docs, ids, ends, held = [], [], [np.zeros(1, np.int64)], 0

        def done() -> pa.RecordBatch:
            every = np.concatenate(ids)
            blob = pack(np.concatenate(docs), np.concatenate(ends), every, base, end)
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            values = (part, seq, inside, sum(map(len, docs)), len(every), blob)
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], ["part", "seq", "inside", "n_docs", "n_ids", "shard"])

        for batch in batches:
            names = batch.column(0).fill_null(-(1 << 63)).to_numpy(zero_copy_only=False)
            for begin, run in raw(batch.column(1), _RUN):
                got, edges = words.encode(run, end)
                docs.append(names[begin : begin + len(run)])
                ids.append(got)
                ends.append(edges[1:] + held)
                held += len(got)
                if held >= SHARD_IDS:
                    yield done()
                    inside += held
                    seq, docs, ids, ends, held = seq + 1, [], [], [np.zeros(1, np.int64)], 0
        if docs:
            yield done()
        docs = ids = ends = None
        trim()

    rows = df.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).alias("t"))
    placed = rows.repartitionByRange(ranges, F.col("doc").asc_nulls_first()).sortWithinPartitions(F.col("doc").asc_nulls_first(), "t")
    placed.mapInArrow(shards, "part int, seq int, inside bigint, n_docs bigint, n_ids bigint, shard binary").write.parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The documents of a written table: ``doc_id``, ``start`` (ids before it), ``ids``."""
    files = spark.read.parquet(path)
    kind = pa.list_(pa.int32())

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words in _CACHES.values():  # a worker that has written before holds words that reading needs no more
            words.young, words.old = {}, {}
        trim()
        for batch in batches:
            for before, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                shard = Shard(blob)
                for lo in range(0, len(shard.doc_ids), 1000):
                    hi = min(lo + 1000, len(shard.doc_ids))
                    offsets = pa.array((shard.starts[lo : hi + 1] - shard.starts[lo]).astype(np.int32))
                    doc = shard.doc_ids[lo:hi]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(doc, mask=doc == -(1 << 63)), pa.array(before + shard.starts[lo:hi]), pa.ListArray.from_arrays(offsets, pa.array(shard.ids(lo, hi))).cast(kind)],
                        ["doc_id", "start", "ids"],
                    )

    return _placed(files).select("before", "shard").mapInArrow(opened, "doc_id bigint, start bigint, ids array<int>")


def _placed(files: DataFrame) -> DataFrame:
    """Shards with ``before``: the ids of all shards before theirs. Only the ranges' sizes move, not the shards."""
    ranges = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    ahead = ranges.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("ahead"))
    return files.join(F.broadcast(ahead), "part").withColumn("before", F.col("ahead") + F.col("inside"))


@F.arrow_udf(LongType())
def crc32(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The unsigned CRC-32 of each array of ids as little-endian unsigned 32-bit integers."""
    for batch in batches:
        yield pa.array([zlib.crc32(x.values.to_numpy().astype("<u4").tobytes()) for x in batch], pa.int64())
