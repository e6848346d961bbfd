"""Near duplicates, repeated windows and decontamination against brute force."""

import gc
import random
import time

import numpy as np
import pytest

from threadloom.llm import common, decontaminate, ngram_join, sketch, substring_dedup, tokens


def corpus(seed, n=120):
    rnd = random.Random(seed)
    word = lambda: "w" + str(rnd.randint(0, 400))
    shared = [" ".join(word() for _ in range(50)) for _ in range(3)]
    docs = [None, "", " ", "one", "one", "One", "a b c", "a b c d e", "x " * 90, "x " * 90]
    originals = [[word() for _ in range(rnd.randint(5, 150))] for _ in range(25)]
    while len(docs) < n:
        w = list(rnd.choice(originals))
        kind = rnd.random()
        if kind < 0.5:
            for _ in range(rnd.randint(0, 6)):
                w[rnd.randrange(len(w))] = word()
        elif kind < 0.7:
            w = w[: rnd.randint(1, len(w))]
        elif kind < 0.9:
            w = [word() for _ in range(rnd.randint(1, 60))] + shared[rnd.randrange(3)].split() + [word() for _ in range(rnd.randint(0, 40))]
        docs.append((" ".join(w)).upper() if rnd.random() < 0.1 else rnd.choice([" ", "\n", "\t"]).join(w))
    return docs


def shingles(t):
    w = (t or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def components(sets):
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(sets))]


@pytest.mark.parametrize(("seed", "group", "leaders", "large"), [(1, 250, 16, 32), (2, 8, 2, 2)])
def test_components(spark, monkeypatch, seed, group, leaders, large):
    monkeypatch.setattr(ngram_join, "LARGE", large)
    monkeypatch.setattr(ngram_join, "GROUP", group)
    monkeypatch.setattr(ngram_join, "LEADERS", leaders)
    docs = corpus(seed)
    sets = [shingles(t) for t in docs]
    want = components(sets)
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(docs)], "doc_id long, text string, component_id string").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join(df).collect()}
    assert got == {i: (len(s), c) for i, (s, c) in enumerate(zip(sets, want, strict=True))}
    kept = ngram_join.one_of_each(df)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want)) and kept.columns == df.columns


@pytest.mark.parametrize(("group", "leaders"), [(70, 2)])
def test_boilerplate(spark, monkeypatch, group, leaders):
    """Many texts that share most of their words, some of them above and some below the threshold, of different sizes."""
    monkeypatch.setattr(ngram_join, "GROUP", group)
    monkeypatch.setattr(ngram_join, "LEADERS", leaders)
    monkeypatch.setattr(ngram_join, "LARGE", 12)
    rnd = random.Random(5)
    terms = [f"b{i}" for i in range(120)]
    docs = [" ".join(terms[: rnd.randint(60, 120)] + [f"u{i}_{k}" for k in range(rnd.randint(0, 40))]) for i in range(120)]
    docs += [" ".join(terms[rnd.randint(0, 20) :] + [f"v{i % 9}_{k}" for k in range(30)]) for i in range(60)]
    got = ngram_join.join(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").repartition(4)).orderBy("doc_id").collect()
    assert [r.component_id for r in got] == components([shingles(t) for t in docs])


def test_set_cases(spark):
    text = " ".join(f"v{i}" for i in range(30))
    df = spark.createDataFrame([(5, text), (5, text), (7, text), (None, text), (None, "alone by itself"), (9, None), (9, None)], "doc_id long, text string")
    got = [tuple(r) for r in ngram_join.join(df).select("doc_id", "n_shingles", "component_id").collect()]
    assert sorted(got, key=str) == sorted([(5, 26, 5), (5, 26, 5), (7, 26, 5), (None, 26, 5), (None, 1, None), (9, 0, 9), (9, 0, 9)], key=str)
    assert sorted((r.doc_id or 0, r.text) for r in ngram_join.one_of_each(df).where("text is not null").collect()) == [(0, "alone by itself"), (5, text)]
    assert ngram_join.join(df.where("false")).count() == ngram_join.one_of_each(df.where("false")).count() == 0


def test_null_and_repeated_ids(spark):
    """Rows without an id, or with one that others have, link by their own texts only."""
    a, b, c = ([f"{x}{i}" for i in range(60)] for x in "abc")
    near = lambda w, k: " ".join([*w[:-1], f"{w[0]}_{k}"])
    rows = [(3, near(a, 0)), (9, near(b, 0)), (None, near(a, 1)), (None, near(b, 1)), (None, near(c, 0)), (None, near(c, 1))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.text: r.component_id for r in ngram_join.join(df).collect()}
    assert got == {near(a, 0): 3, near(a, 1): 3, near(b, 0): 9, near(b, 1): 9, near(c, 0): None, near(c, 1): None}
    kept = ngram_join.one_of_each(df).collect()
    assert sorted(r.doc_id or 0 for r in kept) == [0, 3, 9]
    twice = spark.createDataFrame([(3, near(a, 0)), (9, near(b, 0)), (5, near(a, 1)), (5, near(b, 1)), (None, near(a, 2))], "doc_id long, text string")
    got = {r.text: r.component_id for r in ngram_join.join(twice).collect()}
    assert got == {near(a, 0): 3, near(a, 1): 3, near(a, 2): 3, near(b, 0): 5, near(b, 1): 5}


def test_driver_gives_memory_back(spark, monkeypatch):
    runtime, called = spark.sparkContext._jvm.java.lang.Runtime.getRuntime(), []
    used = lambda: runtime.totalMemory() - runtime.freeMemory()
    spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.long, 8 << 20)  # 64 MB that nothing refers to
    gc.collect()
    before = used()
    common.tidy(spark)
    assert used() < before - (48 << 20)
    monkeypatch.setattr(ngram_join, "tidy", called.append)
    df = spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f g")], "doc_id long, text string")
    assert ngram_join.classes(df).count() == 2 and called


def test_chain_of_links(spark):
    base = [f"k{i}" for i in range(200)]
    docs = [" ".join(base[:-1 - 4 * i][4 * i :] + [f"n{i}_{k}" for k in range(3 * i)]) for i in range(12)]
    want = components([shingles(t) for t in docs])
    got = ngram_join.join(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r.component_id for r in got] == want


def removed(docs, n=35):
    ws = [(t or "").encode().split() for t in docs]
    seen = {}
    for w in ws:
        for i in range(len(w) - n + 1):
            seen[tuple(w[i : i + n])] = seen.get(tuple(w[i : i + n]), 0) + 1
    out = []
    for w in ws:
        gone = {i + k for i in range(len(w) - n + 1) if seen[tuple(w[i : i + n])] > 1 for k in range(n)}
        out.append((len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    return out


@pytest.mark.parametrize("flush", [1 << 21, 50])
def test_repeated_windows(spark, monkeypatch, flush):
    monkeypatch.setattr(substring_dedup, "_FLUSH", flush)
    docs = [*corpus(4), "y " * 200, " ".join(f"z{i % 7}" for i in range(120))]
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(docs)], "doc_id long, text string, n_words int").repartition(6)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in substring_dedup.dedup(df).collect()}
    assert got == dict(enumerate(removed(docs)))


def test_several_passes(spark, monkeypatch):
    monkeypatch.setattr(sketch, "MIN_BITS", 4)
    monkeypatch.setattr(sketch, "MAX_BYTES", 256)
    docs = corpus(6)
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    assert substring_dedup.passes_for(df) == substring_dedup.MAX_PASSES
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in substring_dedup.dedup(df).collect()}
    assert got == dict(enumerate(removed(docs)))


def test_window_cases(spark):
    text = " ".join(f"v{i}" for i in range(40))
    df = spark.createDataFrame([(1, text), (1, text), (None, "a b"), (3, None), (1, text + " more")], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_words, r.n_removed, r.kept_text) for r in substring_dedup.dedup(df).collect())
    assert got == [(0, 2, 0, "a b"), (1, 40, 40, ""), (1, 40, 40, ""), (1, 41, 40, "more"), (3, 0, 0, "")]
    assert substring_dedup.dedup(df.where("false")).count() == 0


def test_anchor_is_the_leftmost_least():
    g = np.array([5, 3, 9, 3, 3, 8, 1, 7], np.uint64)
    assert substring_dedup._anchors(g, 4, 5).tolist() == [1, 1, 6, 6]


def test_sketch_never_underestimates(spark):
    rnd = np.random.default_rng(0)
    keys = rnd.integers(0, 1 << 63, 3000, dtype=np.uint64)
    every = np.concatenate((keys, keys[:1000], keys[:500], keys[:500]))
    df = spark.createDataFrame([(int(x),) for x in every.astype(np.int64)], "k long").repartition(7)
    planes = sketch.build(df, lambda b: iter([b.column(0).to_numpy().view(np.uint64)]), 18, 2, (2, 4))
    two, four = planes.least(keys), planes.least(keys, 1)
    assert two[:1000].all() and four[:500].all() and two[1000:].mean() < 0.02 and four[500:].mean() < 0.02


def test_rolling_fingerprints():
    words = np.arange(50, dtype=np.uint64) ** 3 + 7
    for n in (1, 2, 5, 16, 35):
        f = tokens.rolling(words, n)
        assert len(f) == 51 - n and len(set(f.tolist())) == 51 - n
        assert tokens.rolling(words[3 : 3 + n], n)[0] == f[3]


ITEM = "the quick brown fox jumps over the lazy dog while seven wizards quietly mix strong potions in the tower tonight"


def leaks(spark, docs, items, **kw):
    d = spark.createDataFrame([(i, t, 1) for i, t in enumerate(docs)], "doc_id long, text string, item_id int")
    b = spark.createDataFrame(items, "item_id long, text string")
    return {(r.doc_id, r.item_id): (round(r.coverage, 3), r.tiles) for r in decontaminate.leaks(d, b, **kw).collect()}


def test_reordered_passages(spark):
    w = ITEM.split()
    noise = " ".join(f"n{i}" for i in range(400))
    docs = [noise, f"{noise} {ITEM.upper()} {noise}", " ".join(w[10:] + ["gap"] + w[:10]), " ".join(w[:6]), None, "", " ".join(reversed(w)), f"{ITEM}, {ITEM}!"]
    assert leaks(spark, docs, [(7, ITEM), (8, None), (9, "")]) == {(1, 7): (1.0, 1), (2, 7): (1.0, 2), (7, 7): (1.0, 1)}
    assert leaks(spark, docs, [(7, ITEM)], threshold=0.25)[(3, 7)] == (0.3, 1)
    assert leaks(spark, docs, [(1, "gap the")]) == {(2, 1): (1.0, 1)}
    assert leaks(spark, [], [(1, ITEM)]) == leaks(spark, docs, []) == {}


def test_items_and_clean(spark, monkeypatch):
    items = [(i, f"{ITEM} item{i} extra{i}") for i in range(9)]
    docs = [items[4][1], "nothing here", None, items[4][1], f"nothing {items[2][1]} here"]
    whole = leaks(spark, docs, items)
    assert {(0, i) for i in range(9)} <= whole.keys() and {d for d, _ in whole} == {0, 3, 4}
    monkeypatch.setattr(decontaminate.sketch, "MIN_BITS", 1)
    monkeypatch.setattr(decontaminate.sketch, "MAX_BYTES", 1)  # a sketch so full that every run goes to the join
    assert leaks(spark, docs, items) == whole
    d = spark.createDataFrame([(i, t, i, i) for i, t in enumerate(docs)], "doc_id long, text string, k1 int, leaks int")
    bench = spark.createDataFrame([*items, (4, "two words"), (None, "nothing here")], "item_id long, text string")
    kept = decontaminate.clean(d, bench)
    assert sorted(r.doc_id for r in kept.collect()) == [2] and kept.columns == d.columns
    found = decontaminate.match(d, bench)
    assert found.columns == ["doc_id", "text", "k1", "leaks"] and {r.doc_id: len(r.leaks) for r in found.collect()} == {0: 9, 1: 1, 2: 0, 3: 9, 4: 9}


def test_tiling_of_repeats_is_quick():
    began = time.perf_counter()
    assert decontaminate.tile([1] * 20_000, [1] * 1000) == [(0, 0, 1000)]
    assert sum(t[2] for t in decontaminate.tile([1, 2, 3, 4, 5, 6, -1] * 3000, [1, 2, 3, 4, 5, 6, 7] * 150)) == 900
    assert time.perf_counter() - began < 3


def brute_tiles(doc, item, least):
    doc, item, tiles = list(doc), list(item), []
    while True:
        best = (0, 0, 0)
        for i in range(len(doc)):
            for j in range(len(item)):
                n = 0
                while i + n < len(doc) and j + n < len(item) and doc[i + n] is not None and doc[i + n] == item[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, -i, -j)
        n, i, j = best[0], -best[1], -best[2]
        if n < least:
            return tiles
        tiles.append((i, j, n))
        doc[i : i + n] = [None] * n
        item[j : j + n] = [-1] * n


def test_tiling_covers_as_brute_force():
    for seed in range(60):
        rnd = random.Random(seed)
        item = [rnd.randint(1, 12) for _ in range(rnd.randint(5, 25))]
        doc = [rnd.randint(1, 12) for _ in range(rnd.randint(1, 30))]
        for _ in range(rnd.randint(0, 3)):
            a = rnd.randrange(len(item))
            doc[rnd.randrange(len(doc)) : 0] = item[a : a + rnd.randint(3, 9)]
        assert sum(t[2] for t in decontaminate.tile(doc, item, 3)) == sum(t[2] for t in brute_tiles(doc, item, 3)), seed


