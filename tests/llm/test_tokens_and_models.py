"""BPE, token files, language models and the pipeline against libraries and brute force."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadloom.llm import bpe, langid, lm_score, queries, token_files

PATH = queries.vocabulary()
ODD = [
    None, "", "a", "<|endoftext|>x<|startoftext|> <|EndOfText|>", "ΑΣ ΣΑΣ. İI foo", "é ́x ﬁ ½ ² ①", "it's we'LL don't 'S", "\x1c\x85\xa0  x　y", "a" * 3000, "日本語テキスト 😀😀👍🏽",
    "123 ١٢٣ Ⅷ", "\x00\x01\x7f", "ǅ Ǆ ß ẞ ŉ", "a\r\n\tb  c the. a.. Å, 가각 ﷺ. ﻿x ...", "é. ñ, × ÷, x", "the the. THE, the.\nthe", "one two. three... \"four\" (five), six.",
]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def sample(spark, n=60):
    return [r[0] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").limit(n).select("text").collect()]


def test_encoding_is_the_library_s(spark, library):
    texts = ODD + sample(spark)
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    for r in bpe.transcode(df, PATH).collect():
        want = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert list(r.ids) == want, repr(texts[r.doc_id])[:80]
        assert r.decoded == library.decode(want, skip_special_tokens=False)
    assert bpe.transcode(df.where("false"), PATH).count() == 0


def test_segment_tree_root_is_the_leftmost_least():
    for seed in range(50):
        rnd = random.Random(seed)
        ranks = [rnd.choice([-1, *range(6)]) for _ in range(rnd.randint(1, 20))]
        tree = bpe.PairTree(ranks)
        for _ in range(30):
            want = min(((r, i) for i, r in enumerate(ranks) if r >= 0), default=None)
            assert tree.top() == want
            i = rnd.randrange(len(ranks))
            ranks[i] = rnd.choice([-1, *range(6)])
            tree.put(i, ranks[i])


def test_cache_generations(library, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_WORDS", 3)
    b = bpe.Bpe(PATH)
    for text in ("a b c d e", "c d e f g", "a b c", "z"):
        assert b.encode(text) == library.encode(text, add_special_tokens=False).ids and b.decode(b.encode(text)) == " ".join(b.token[i] for i in b.encode(text))


def test_words_that_need_no_splitting(library, monkeypatch):
    words = token_files.WordCache(PATH)
    monkeypatch.setattr(words, "_ids", lambda texts, tokenizer=None, ids=words._ids: ids(texts, tokenizer) if tokenizer or all(t[0] in token_files._MARKS for t in texts) else 1 / 0)
    texts = ["ab", "straßenña$$$ éàíÿb", "é\u00e0!! füreinaustau.&&& öö?", "doosos### doosos ab.,;:!? ß"]
    got, ends = words.encode([t.encode() for t in texts], 1)
    want = [[*library.encode(t, add_special_tokens=False).ids, 1] for t in texts]
    assert [got[a:b].tolist() for a, b in zip(ends, ends[1:], strict=False)] == want


@pytest.mark.parametrize("shard", [1 << 20, 50])
def test_token_files(spark, tmp_path, library, monkeypatch, shard):
    monkeypatch.setattr(token_files, "SHARD_IDS", shard)
    texts = ODD + sample(spark, 30)
    order = list(range(len(texts)))
    random.Random(1).shuffle(order)
    df = spark.createDataFrame([(i, texts[i], 0) for i in order] + [(None, "null id", 0)], "doc_id long, text string, start int").repartition(3)
    token_files.write(df, str(tmp_path / "ids"), PATH)
    got = token_files.read(spark, str(tmp_path / "ids")).withColumn("crc", token_files.crc32("ids")).collect()
    at = 0
    for r, t in zip(sorted(got, key=lambda r: -1 if r.doc_id is None else r.doc_id), ["null id", *texts], strict=True):
        want = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        assert (r.start, list(r.ids), r.crc) == (at, want, zlib.crc32(np.array(want, "<u4").tobytes()))
        at += len(want)
    token_files.write(df.where("false"), str(tmp_path / "none"), PATH)
    assert token_files.read(spark, str(tmp_path / "none")).count() == 0


def test_shards_decode_at_random():
    rnd = np.random.default_rng(0)
    docs = [np.append(rnd.choice([7, 8, 9, 10], rnd.integers(0, 300)), 1) for _ in range(200)]
    starts = np.concatenate(([0], np.cumsum([len(d) for d in docs])))
    blob = token_files.pack(np.arange(200), starts, np.concatenate(docs).astype(np.int32), 20)
    shard = token_files.Shard(blob)
    assert len(shard.lengths) > 0 and shard.lengths.max() > 2 and len(shard.seq) < 0.8 * starts[-1]
    assert all((shard.ids(i) == docs[i]).all() for i in range(200))
    assert (shard.ids(0, 200) == np.concatenate(docs)).all()
    with pytest.raises(ValueError):
        token_files.Shard(blob[:-9] + b"x" + blob[-8:])


def test_wide_symbols():
    ids = np.tile(np.array([70_000, 70_001, 5], np.int32), 500)
    shard = token_files.Shard(token_files.pack(np.array([3]), np.array([0, len(ids)]), ids, 80_000))
    assert (shard.ids(0) == ids).all()


def test_rules_grow_until_no_pair_is_frequent():
    rnd = np.random.default_rng(1)
    passage, docs = rnd.integers(100, 4000, 300), []
    for i in range(120):
        docs.append(np.concatenate((rnd.integers(100, 4000, 20), passage, np.full(i, 9), [1])))
    ids = np.concatenate(docs).astype(np.int32)
    starts = np.concatenate(([0], np.cumsum([len(d) for d in docs])))
    shard = token_files.Shard(token_files.pack(np.arange(120), starts, ids, 5000))
    assert all((shard.ids(i) == docs[i]).all() for i in range(120))
    pairs = Counter((a, b) for a, b in zip(shard.seq[:-1].tolist(), shard.seq[1:].tolist(), strict=True) if 1 not in (a, b))
    assert shard.lengths.max() >= 300 and max(pairs.values()) < token_files.LEAST_COUNT
    assert len(shard.seq) < 30 * 120


def brute_scores(texts):
    ws = [(t or "").encode().lower().split() for t in texts]
    grams = lambda w, n: [tuple(w[i : i + n]) for i in range(len(w) - n + 1)]
    count = Counter(g for w in ws for n in (1, 2, 3) for g in grams(w, n))
    total, out = sum(map(len, ws)), []
    for w in ws:
        own = Counter(g for n in (1, 2, 3) for g in grams(w, n))
        c, n, s = (lambda g, own=own: count[g] - own[g]), max(1, total - len(w)), 0.0
        for i in range(len(w)):
            k, a = min(2, i), 1.0
            while k and not c(tuple(w[i - k : i + 1])):
                k, a = k - 1, a * lm_score.ALPHA
            g = tuple(w[i - k : i + 1])
            s += math.log10(a * c(g) / c(g[:-1]) if k else a * (c(g) or lm_score.ALPHA) / n)
        out.append((len(w), s))
    return out


@pytest.mark.parametrize("size", [8 << 20, 3000])
def test_backoff_scores(spark, monkeypatch, size):
    monkeypatch.setattr(lm_score, "BLOCK_BYTES", size)
    monkeypatch.setattr(lm_score, "PART_BYTES", size)
    texts = [None, "", "one", "one two", "one two three", "Two two two", "unseen", *sample(spark, 40), "one two three four", "one two three four"]
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, n_words int").repartition(4)
    got = {r.doc_id: r for r in lm_score.score(df).collect()}
    assert len(got) == len(texts)
    for i, (n, s) in enumerate(brute_scores(texts)):
        assert got[i].n_words == n and abs(got[i].log_score - s) < 1e-9
        assert got[i].mean_log_score is None if n == 0 else abs(got[i].mean_log_score - s / n) < 1e-9
    assert lm_score.score(df.where("false")).count() == 0
    twice = lm_score.score(spark.createDataFrame([(1, "a b c"), (1, "a b c")], "doc_id long, text string")).collect()
    assert len(twice) == 2 and twice[0].log_score == twice[1].log_score


def test_packing():
    h = np.sort(np.random.default_rng(1).integers(0, 1 << 63, 500, dtype=np.uint64) >> lm_score.DROPPED << lm_score.DROPPED)
    assert (lm_score.unpack(lm_score.pack(h)) == h).all() and (lm_score._thick(lm_score._thin(np.arange(9))) == np.arange(9)).all()
    assert len(lm_score.unpack(b"")) == 0


def test_languages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    model = langid.fit(docs.where(~held))
    out = langid.predict(docs.where(held).withColumn("score", F.lit("x")), model)
    right = out.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.min("score"), F.max("score")).first()
    assert right[0] > 0.98 and 0 <= right[1] <= right[2] <= 1
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 !? ½"), (4, "the"), (4, "the"), (5, "ß" * 50_000)], "doc_id long, text string")
    got = [(r.doc_id, r.lang_pred, r.score) for r in langid.predict(odd, model).collect()]
    assert len(got) == 6 and all(g == (i, "und", 0.0) for g, i in zip(got[:3], (1, 2, 3), strict=True)) and got[3] == got[4] and got[5][1] == "de"
    assert langid.fit(docs.where("false")) == {} and langid.predict(odd, {}).where("lang_pred <> 'und'").count() == 0
    assert langid.predict(odd.where("false"), model).count() == 0


def test_code_lengths():
    """PPM with method C escapes, byte by byte."""
    text = "banana bandana"
    keys, _ = langid.grams([text])
    kinds, n = np.unique(keys, return_counts=True)
    tree = langid.Tree(kinds, n.astype(float))
    raw = b"\0" * langid.ORDER + text.encode()
    seen = {}
    for i in range(langid.ORDER, len(raw)):
        for k in range(langid.ORDER + 1):
            seen.setdefault(raw[i - k : i], Counter())[raw[i]] += 1

    def bits(context, byte):
        total = 0.0
        for k in range(langid.ORDER, -1, -1):
            c = seen.get(context[len(context) - k :])
            if c is None:
                continue
            size, kinds = sum(c.values()), len(c)
            if c[byte]:
                return total - math.log2(c[byte] / (size + kinds))
            total -= math.log2(kinds / (size + kinds))
        return total + 8

    probe = b"\0" * langid.ORDER + b"bananas and bxq"
    want = [bits(probe[i - langid.ORDER : i], probe[i]) for i in range(langid.ORDER, len(probe))]
    got = tree.bits(langid.grams(["bananas and bxq"])[0])
    assert np.allclose(got, want)


def test_pipeline(spark):
    import corpus_pipeline as cp

    d = "/root/testdata/sf0.001"
    assert [n for n, _ in cp.STAGES] == ["quality_rules", "ngram_join", "decontaminate", "pii", "bpe"]
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns = docs.columns
    seen = {}
    for name, stage in cp.STAGES[:-1]:
        docs = stage(spark, docs, d)
        assert docs.columns == columns, name
        seen[name] = {r.doc_id: r.text for r in docs.collect()}
    out = {r.doc_id: r for r in cp.run(spark, d).collect()}
    assert set(out) == set(seen["pii"]) == set(seen["decontaminate"]) < set(seen["ngram_join"]) < set(seen["quality_rules"])
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    import test_native as native
    import test_windows_and_sets as sets

    def keeps(t):
        w = native.words(t)
        n, chars, symbols, dup, repeats = native.measures(t)
        lines = len([x for x in t.split("\n") if native.words(x)])
        letters, upper = sum(c.isalpha() for c in t), sum(c.isupper() for c in t)
        return not (n < 50 or 100 * repeats > 50 * n or 10 * symbols > n or 2 * dup > lines or chars < 2 * n or chars > 12 * n or 2 * upper > letters or 2 * letters < chars or not w)

    kept = sorted(i for i, t in texts.items() if keeps(t))
    assert kept == sorted(seen["quality_rules"])
    comp = sets.components([sets.shingles(texts[i]) for i in kept])
    one = [i for n, i in enumerate(kept) if comp[n] == n]
    assert one == sorted(seen["ngram_join"])
    from threadloom.llm.decontaminate import tokens

    items = [tokens(r.text) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]

    def leaks(t):
        doc = tokens(t)
        runs = {tuple(doc[i : i + 5]) for i in range(len(doc) - 4)}
        near = [it for it in items if sum(tuple(it[i : i + 5]) in runs for i in range(len(it) - 4)) > 0]
        return any(sum(x[2] for x in sets.brute_tiles(doc, it, 5)) >= 0.5 * len(it) for it in near)

    assert sorted(seen["decontaminate"]) == [i for i in one if not leaks(texts[i])]
    for i, t in seen["pii"].items():
        assert not native.base(t) and (t == texts[i] or "[" in t)


def test_queries_of_the_contract(spark):
    d = "/root/testdata/sf0.001"
    n = spark.read.parquet(f"{d}/documents.parquet").count()
    for name, f in queries.queries().items():
        rows = f(spark, d).collect()
        assert name == "op3_chat_format" or name == "op9_decontaminate" or len(rows) == n, name
