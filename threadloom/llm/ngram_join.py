"""N-gram Jaccard join with set-relation skipping.

A document's set holds the fingerprints of its distinct five-word shingles; two sets
link at Jaccard similarity of at least three quarters. The result is the component of
each document under links, exactly, without a pair for every link:

1. A count-min sketch of bounded size tells which shingles occur more than once; counts are
   only ever overestimated. A set in which fewer than three quarters of the shingles were
   seen elsewhere can link with nothing and leaves here. Equal sets become one. What is
   left is sketched and sifted again, now with several levels of counts.
2. Relations between sets. Sets are grouped by their least shingles under two hashes, those of the
   commonest shingles first, and held against the first few of the group that link with none
   before them. A set that links with such a leader follows it, at a known distance (one less
   the similarity, which keeps the triangle inequality). Groups above ``GROUP`` sets are split
   by salts, each by its own size, and their leaders meet in further rounds, so that one of any size
   is never read by one task.
3. Index. The rarest shingles of a set are posted to lists, cut in blocks by set size; of two
   sets the smaller one is listed, with a seventh of its shingles, and the larger one probes, with
   a quarter. Before anything meets, a probe leaves out the blocks of sizes that cannot link
   and those where what follows its position is too short for the overlap that the block's
   least size needs. Followers of one leader stand in a list as one entry, with their best
   position and least size, and those that are in one component already are not compared.
4. Leaders whose entries met are compared, one pair for all their followers. From that answer the
   followers' answers are derived: leaders that link join their components; leaders further
   apart than a link and both of their followers' distances settle that no followers link. Only
   between leaders in the gap, followers are probed themselves, and only those that the
   triangle inequality leaves open are compared.
5. Components by least labels with pointer jumping.

Defined cases: null or empty texts have no shingle, link with nothing and stand alone; texts
of fewer words than a shingle have one shingle, all of their words; repeated rows link; rows are
documents, whether their ids are null or repeated: different texts under one ``doc_id`` are
told apart, and a component is named by the least ``doc_id`` in it that is not null, or by null; an
empty table gives an empty result; extra columns stay, columns named like a result are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import sketch, tokens
from .common import carried, materialize, tidy, unpacked

SHINGLE = 5
THRESHOLD = 0.75
#: Levels of the second sketch: a shingle's class is the number of levels that its count reaches.
LEVELS = (2, 4, 16, 64, 250)
#: Sketch buckets for each byte of the input's files: about two for each shingle.
BUCKETS_A_BYTE = 0.5
#: Sets of one group that one task reads, and leaders that it holds. Groups get larger where there are sets for more than MOST_GROUPS of them.
GROUP, LEADERS, MOST_GROUPS = 250, 16, 1 << 16
#: Sets from which a component is large.
LARGE = 32
#: Rounds of leaders go on while they leave fewer leaders in split groups than this share of the last round's.
SHRINKS = 0.9
_EPS = 1e-9


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """The sorted distinct shingle fingerprints of each text."""
    docs = [t.lower().split() for t in texts]
    words, ends = tokens.hashed(docs)
    grams = tokens.rolling(words, SHINGLE)
    out = []
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        if b - a >= SHINGLE:
            out.append(np.unique(grams[a : b - SHINGLE + 1]))
        elif b > a:
            out.append(tokens.mix(tokens.rolling(words[a:b], b - a) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def estimate(df: DataFrame, text: str) -> sketch.Planes:
    def keys(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for _, run in tokens.raw(batch.column(0)):
            yield np.concatenate(shingle_sets(run))

    return sketch.build(df.select(text), keys, sketch.bits_for(df, BUCKETS_A_BYTE))


_SETS = "doc bigint, k bigint, n bigint, s1 bigint, s2 bigint, shingles array<bigint>"


def _sets(df: DataFrame, sent: Broadcast) -> DataFrame:
    """Each document's size and set fingerprint; for those that may link also the set itself."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = sent.value
        for batch in batches:
            for begin, run in tokens.raw(batch.column(2)):
                rows: list[tuple] = []
                for s in shingle_sets(run):
                    n = len(s)
                    s1 = int(tokens.mix(s).sum(dtype=np.uint64).astype(np.int64)) if n else 0
                    s2 = int(tokens.mix(s * tokens.LANES[0]).sum(dtype=np.uint64).astype(np.int64)) if n else 0
                    may = n and planes.least(s).sum() >= np.ceil(THRESHOLD * n - _EPS)
                    rows.append((n, s1, s2, s.astype(np.int64) if may else None))
                cols = list(zip(*rows, strict=True))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
                names = [batch.column(i).slice(begin, len(rows)) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays(names + [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc", "k", "n", "s1", "s2", "shingles"])
        tokens.trim()

    return df.mapInArrow(made, _SETS)


_SIFTED = "id bigint, n bigint, n0 int, m0 bigint, m1 bigint, common double, shingles array<bigint>"


def _sift(sets: DataFrame) -> DataFrame:
    """The sets of (id, shingles) that can link with another one, rarest shingles first.

    ``n0`` is the number of shingles that no other set has, ``m0`` and ``m1`` are grouping keys,
    ``common`` is the mean class of the shingles.
    """
    size = sets.agg(F.sum(F.size("shingles"))).first()[0] or 0

    def keys(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        yield batch.column(0).flatten().to_numpy().view(np.uint64)

    bits = sketch.bits_of(2 * size, 1, len(LEVELS))
    sent = sets.sparkSession.sparkContext.broadcast(sketch.build(sets.select("shingles"), keys, bits, 1, LEVELS))

    def sifted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = sent.value
        for batch in batches:
            rows = []
            for id_, values in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                s = values.values.to_numpy().view(np.uint64)
                kind = sum(planes.least(s, i).astype(np.int8) for i in range(len(LEVELS)))
                n, n0 = len(s), int((kind == 0).sum())
                if n - n0 < np.ceil(THRESHOLD * n - _EPS):
                    continue
                shared = s[kind > 0]
                keys = (int(tokens.mix(shared * lane).min().astype(np.int64)) for lane in tokens.LANES)
                rows.append((id_, n, n0, *keys, float(kind.mean()), s[np.lexsort((s, kind))].view(np.int64)))
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.int64()))
                cols = zip(zip(*rows, strict=True), kinds, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in cols], ["id", "n", "n0", "m0", "m1", "common", "shingles"])
        tokens.trim()

    out = materialize(sets.select("id", "shingles").mapInArrow(sifted, _SIFTED), "ngram-sifted")
    sent.destroy()  # the sets are written, nothing asks the sketch again
    return out


def _lead(rows: DataFrame) -> DataFrame:
    """Links (a, b, d) of sets to leaders of their groups (m, salt), verified; d is their distance."""

    def led(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, leaders = None, []
        for batch in batches:
            links = []
            for id_, at, salt, values in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3), strict=True):
                if (at, salt) != group:
                    group, leaders = (at, salt), []
                own = values.values.to_numpy()
                for other, lead in leaders:
                    if 4 * min(len(own), len(lead)) < 3 * max(len(own), len(lead)):
                        continue
                    both = len(np.intersect1d(own, lead, assume_unique=True))
                    if 4 * both >= 3 * (len(own) + len(lead) - both):
                        links.append((id_, other, 1 - both / (len(own) + len(lead) - both)))
                        break
                else:
                    if len(leaders) < LEADERS:
                        leaders.append((id_, own))
            if links:
                kinds = (pa.int64(), pa.int64(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*links, strict=True), kinds, strict=True)], ["a", "b", "d"])

    placed = rows.repartition("m", "salt").sortWithinPartitions("m", "salt", F.desc("common"), "id")
    return placed.select("id", "m", "salt", "shingles").mapInArrow(led, "a bigint, b bigint, d double")


def _following(sets: DataFrame, total: int) -> DataFrame:
    """All (a, b, d) of sets and leaders that they follow, after as many rounds as split groups need."""
    group = max(GROUP, -(-total // MOST_GROUPS))
    keys = F.explode(F.array("m0", "m1")).alias("m")
    places, edges, last, step = sets.select("id", keys), None, None, 0
    while True:
        sizes = places.groupBy("m").agg(F.count("*").alias("size")).where(F.col("size") > group)
        hot = materialize(sizes, "ngram-groups")  # MOST_GROUPS at the most
        split = F.coalesce(F.pmod(F.xxhash64("id", F.lit(step)), F.ceil(F.col("size") / group)), F.lit(0)).alias("salt")
        if edges is None:
            rows = sets.select("id", keys, "common", "shingles").join(F.broadcast(hot), "m", "left")
        else:
            rows = sets.join(places, "id").join(F.broadcast(hot), "m", "left")
        found = materialize(_lead(rows.select("id", "m", split, "shingles", "common")), "ngram-led")
        edges, step = found if edges is None else edges.unionByName(found), step + 1
        if hot.isEmpty():
            return edges
        heads = places.join(F.broadcast(hot.select("m")), "m").join(edges.select(F.col("a").alias("id")).distinct(), "id", "left_anti")
        places = materialize(heads.select("id", "m"), "ngram-heads")
        left = places.count()
        if not left or last is not None and left > SHRINKS * last:
            return edges
        last = left


def _fronts(sets: DataFrame, led: DataFrame, labels: DataFrame) -> DataFrame:
    """The shingles that each set probes with: (id, n, n0, front, head, d, label).

    ``head`` is the nearest leader of a set, at distance ``d``, or the set itself. Shingles that no other set has are left out.
    """
    front = F.greatest(F.lit(0), F.col("n") - F.ceil(THRESHOLD * F.col("n") - _EPS) + 1 - F.col("n0")).cast("int")
    slim = sets.select("id", "n", "n0", F.slice("shingles", F.col("n0") + 1, front).alias("front")).where(F.size("front") > 0)
    near = led.groupBy(F.col("a").alias("id")).agg(F.min(F.struct("d", "b")).alias("near"))
    named = slim.join(near, "id", "left").join(labels, "id", "left").select(
        "id", "n", "n0", "front", F.coalesce("near.b", "id").alias("head"), F.coalesce("near.d", F.lit(0.0)).alias("d"), F.coalesce("label", "id").alias("label")
    )
    return materialize(named, "ngram-fronts")


def _overlap(a: Column, b: Column) -> Column:
    """Shingles that sets of these sizes must share to link, not rounded up."""
    return THRESHOLD / (1 + THRESHOLD) * (a + b) - _EPS


def _sides(fronts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The entries of the lists, and the probes with the ``block`` that each goes to; of two sets the larger one probes.

    A row is a shingle, ``token``, of a set; ``rest`` counts the shingles from its position on.
    """
    block = F.floor(F.log(F.col("n").cast("double")) / float(-np.log(THRESHOLD)) + _EPS).cast("int").alias("block")
    posts = fronts.select(*[c for c in fronts.columns if c != "front"], block, F.posexplode("front").alias("at", "token"))
    posts = posts.withColumn("rest", F.col("n") - F.col("n0") - F.col("at")).drop("n0", "at")
    listed = posts.where(F.col("rest") >= _overlap(F.col("n"), F.col("n")))
    least = F.greatest(F.pow(F.lit(1 / THRESHOLD), F.col("block")) * (1 - 1e-6), THRESHOLD * F.col("n"))
    sent = posts.withColumn("block", F.explode(F.array(F.col("block") - 1, F.col("block"))))
    return listed, sent.where(F.col("rest") >= _overlap(F.col("n"), least))


def _met(fronts: DataFrame) -> DataFrame:
    """Pairs (a, b) of leaders of different components, some of whose sets may link."""
    listed, sent = _sides(fronts)

    def entries(rows: DataFrame, x: str) -> DataFrame:
        least = [F.max("rest").alias(f"{x}_rest"), F.min("n").alias(f"{x}_n"), F.max("n").alias(f"{x}_most")]
        return rows.groupBy("token", "block", F.col("head").alias(x), F.col("label").alias(f"{x}_label")).agg(*least)

    fits = (
        (F.col("a_label") != F.col("b_label"))
        & (F.col("b_most") >= THRESHOLD * F.col("a_n") - _EPS)
        & (F.col("b_n") <= F.col("a_most"))
        & (F.least("a_rest", "b_rest") >= _overlap(F.col("a_n"), F.col("b_n")))
    )
    both = entries(sent, "a").join(entries(listed, "b"), ["token", "block"]).where(fits)
    return both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _between(fronts: DataFrame, labels: DataFrame, open_: DataFrame) -> DataFrame:
    """Pairs (a, b) of sets that may link, between the leaders (h, g, far) of ``open_``, ``far`` being how far apart these are.

    Sets of large components do not probe lists of large components, most entries of which are of
    their own; large components meet by their open leaders only.
    """
    heads = open_.select(F.col("h").alias("head")).unionByName(open_.select(F.col("g").alias("head"))).distinct()
    named = fronts.drop("label").join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
    sizes = named.groupBy("label").agg((F.count("*") >= LARGE).alias("large"))
    listed, sent = _sides(named.join(heads, "head", "left_semi").join(sizes, "label"))
    side = lambda rows, x, *keys: rows.select("token", "block", *keys, *[F.col(c).alias(f"{x}_{c}") for c in ("id", "n", "rest", "head", "d", "label")])
    ways = open_.select(F.col("h").alias("a_head"), F.col("g").alias("b_head"), "far")
    ways = ways.unionByName(open_.select(F.col("g").alias("a_head"), F.col("h").alias("b_head"), "far"))
    fits = (
        ((F.col("a_n") > F.col("b_n")) | (F.col("a_n") == F.col("b_n")) & (F.col("a_id") > F.col("b_id")))
        & (F.col("b_n") >= THRESHOLD * F.col("a_n") - _EPS)
        & (F.least("a_rest", "b_rest") >= _overlap(F.col("a_n"), F.col("b_n")))
        & (F.col("a_label") != F.col("b_label"))
    )
    near = F.col("a_d") + F.col("b_d") >= F.col("far") - (1 - THRESHOLD) - _EPS
    asked = F.explode(F.when(F.col("large"), F.array(F.lit(False))).otherwise(F.array(F.lit(False), F.lit(True)))).alias("to")
    some = side(sent, "a", asked).join(side(listed, "b", F.col("large").alias("to")), ["token", "block", "to"]).where(fits).join(ways, ["a_head", "b_head"]).where(near)
    big = lambda rows: rows.where("large")
    known = heads.join(labels.withColumnRenamed("id", "head"), "head", "left").withColumn("label", F.coalesce("label", "head"))
    both = big(known.join(sizes, "label")).select("head")
    between = ways.join(both.withColumnRenamed("head", "a_head"), "a_head", "left_semi").join(both.withColumnRenamed("head", "b_head"), "b_head", "left_semi")
    large = side(big(sent), "a").join(between, "a_head").where(F.col("a_d") + 1 - THRESHOLD >= F.col("far") - (1 - THRESHOLD) - _EPS).join(side(big(listed), "b"), ["token", "block", "b_head"]).where(fits & near)
    return some.select(F.col("a_id").alias("a"), F.col("b_id").alias("b")).unionByName(large.select(F.col("a_id").alias("a"), F.col("b_id").alias("b"))).distinct()


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``pairs`` with ``link`` and the distance ``d``, from the intersection of both sets."""
    side = lambda x: sets.select(F.col("id").alias(x), F.col("n").alias(f"{x}_n"), F.col("shingles").alias(f"{x}_s"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").withColumn("both", F.size(F.array_intersect("a_s", "b_s")))
    any_ = F.col("a_n") + F.col("b_n") - F.col("both")
    return both.select("a", "b", (4 * F.col("both") >= 3 * any_).alias("link"), (1 - F.col("both") / any_).alias("d"))


def _links(sets: DataFrame, led: DataFrame) -> DataFrame:
    """(id, label) of the components of all links."""
    labels = components(led)
    tidy(sets.sparkSession)
    fronts = _fronts(sets, led, labels)
    heads = materialize(_verified(_met(fronts), sets), "ngram-leaders")
    edges = led.select("a", "b")
    linked = heads.where("link").select("a", "b")
    if not linked.isEmpty():
        edges = edges.unionByName(linked)
        labels = components(edges)
    reach = led.groupBy(F.col("a").alias("id")).agg(F.min(F.struct("d", "b")).alias("near")).groupBy(F.col("near.b").alias("id")).agg(F.max("near.d").alias("reach"))
    about = lambda x: labels.join(reach, "id", "full").select(F.col("id").alias(x), F.col("label").alias(f"{x}_label"), F.col("reach").alias(f"{x}_reach"))
    apart = heads.where("not link").join(about("a"), "a", "left").join(about("b"), "b", "left")
    reached = F.coalesce("a_reach", F.lit(0.0)) + F.coalesce("b_reach", F.lit(0.0))
    gap = apart.where((F.coalesce("a_label", "a") != F.coalesce("b_label", "b")) & (reached > 0) & (F.col("d") <= 1 - THRESHOLD + reached + _EPS))
    open_ = materialize(gap.select(F.col("a").alias("h"), F.col("b").alias("g"), F.col("d").alias("far")), "ngram-open")
    if open_.isEmpty():
        return labels
    tidy(sets.sparkSession)
    more = materialize(_verified(_between(fronts, labels, open_), sets).where("link").select("a", "b"), "ngram-links")
    return labels if more.isEmpty() else components(edges.unionByName(more))


def components(edges: DataFrame) -> DataFrame:
    """(id, label) for every node of an edge list (a, b): the smallest id of its component.

    Each round takes the least label among a node's neighbours and then follows labels to
    their own, so long chains shrink by halves; rounds end when nothing changes.
    """
    tidy(edges.sparkSession)
    both = materialize(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "cc-edges")
    labels = materialize(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "cc-labels")
    while True:
        near = both.join(labels, both["b"] == labels["id"]).groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        met = labels.join(near, "id", "left").select("id", F.col("label").alias("was"), F.least("label", F.coalesce("near", "label")).alias("label"))
        of = labels.select(F.col("id").alias("label"), F.col("label").alias("next"))
        after = materialize(met.join(of, "label", "left").select("id", "was", F.least("label", F.coalesce("next", "label")).alias("label")), "cc-labels")
        labels = after.select("id", "label")
        if after.where("label <> was").isEmpty():
            return labels


def _print(text: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def join(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``df`` with ``n_shingles`` and ``component_id``, the smallest ``doc_id`` that links reach."""
    once = classes(df, doc_id, text).select(F.col("doc").alias("d"), F.col("k").alias("c"), "n_shingles", "component_id").distinct()
    held = carried(df, doc=F.col(f"`{doc_id}`").cast("long"), k=_print(f"`{text}`"))
    found = held.join(once, F.col("doc").eqNullSafe(F.col("d")) & (F.col("k") == F.col("c")), "left")
    return unpacked(found, df.columns, {"n_shingles": F.col("n_shingles"), "component_id": F.col("component_id")})


def one_of_each(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of ``df`` for each component: of its least ``doc_id``, nulls last. Of rows equal in id and text one stays."""
    found = materialize(classes(df, doc_id, text).select("doc", "k", "class"), "ngram-classes")
    first = found.where("class is not null").groupBy("class").agg(F.min(F.struct(F.col("doc").isNull().alias("none"), "doc", "k")).alias("x"))
    stay = first.select("x.doc", "x.k").unionByName(found.where("class is null").select("doc", "k"))
    # plain columns for a null id, so that the join and the last grouping need one exchange of the rows, not two
    keys = lambda doc, k: {"id": F.coalesce(doc, F.lit(0)), "none": doc.isNull(), "k": k}
    held = carried(df, **keys(F.col(f"`{doc_id}`").cast("long"), _print(f"`{text}`")))
    kept = held.join(stay.select(*[c.alias(n) for n, c in keys(F.col("doc"), F.col("k")).items()]), ["id", "none", "k"], "left_semi")
    return unpacked(kept.dropDuplicates(["id", "none", "k"]), df.columns)


def classes(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of ``df``: ``doc``, ``k`` (a fingerprint of the text), ``n_shingles``, ``component_id``, ``class``.

    ``class`` tells components apart; it is null for texts that can link with nothing.
    """
    slim = df.select(F.col(f"`{doc_id}`").cast("long").alias("doc"), _print(f"`{text}`").alias("k"), F.col(f"`{text}`").alias("t"))
    sent = df.sparkSession.sparkContext.broadcast(estimate(slim, "t"))
    base = materialize(_sets(slim, sent), "ngram-sets")
    sent.destroy()  # the sets are written, nothing asks the sketch again
    several = base.where("shingles is not null").groupBy("s1", "s2").agg(F.min("doc").alias("least"), F.first("shingles").alias("shingles"))
    reps = materialize(several.withColumn("id", F.monotonically_increasing_id()), "ngram-reps")
    sets = _sift(_sift(reps))
    labels = _links(sets, _following(sets, sets.count()))
    tidy(df.sparkSession)
    named = reps.select("s1", "s2", "id", "least").join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
    least = named.groupBy("label").agg(F.min("least").alias("component_id"))
    dim = named.select("s1", "s2", "label").join(least, "label").select("s1", "s2", F.col("label").alias("class"), "component_id")
    met = base.where("shingles is not null").select("doc", "k", "n", "s1", "s2").join(dim, ["s1", "s2"])
    alone = base.where("shingles is null").select("doc", "k", "n", F.col("doc").alias("component_id"), F.lit(None).cast("bigint").alias("class"))
    return met.select(*alone.columns).unionByName(alone).withColumnRenamed("n", "n_shingles")
