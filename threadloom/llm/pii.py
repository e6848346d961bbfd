"""Personal data by bootstrapped contextual extraction, with built-in expressions only.

Base patterns give the seeds. Every token that holds a digit or ``@`` is a candidate
instance; the words around it on its line are its lexical patterns: two before it, one
before it, one at the start of its line, those on both sides of a number before it, and
one after it. Patterns and instances form a bipartite graph whose edges are counted once. Scoring alternates until nothing changes:
a pattern's confidence for a kind is the share of its distinct instances believed to
be of that kind, an instance's belief is the noisy-or of its confident patterns.
Confident patterns finally mark the candidates that no base pattern found. Identifiers of fewer
than ``MIN_CORE`` characters (years, counts, prices for the most part) are no candidates: contexts neither
learn from them nor find them; base patterns do.

Offsets are code points, ends exclusive. Matches are leftmost and non-overlapping for
each kind; different kinds may overlap. A match that fails its check is dropped and
not retried. The patterns carry possessive quantifiers and start only where a run
starts (or where the last match ended), which changes no match and keeps long runs linear.

Defined cases: null text counts as empty; an empty table gives an empty result; repeated
rows get the same spans each; a column of the input named like a result is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WS, carried, fingerprint, let, materialize, unpacked

#: Kinds in the order that breaks ties, ``secret`` being one that only contexts and key-like seeds give.
KINDS = ("email", "ip", "card", "phone", "secret")
_MAIL, _DOM = r"[A-Za-z0-9._%+-]", r"[A-Za-z0-9-]"
PATTERNS = {
    "email": rf"(?:(?<!{_MAIL})|\G){_MAIL}++@{_DOM}++(?:\.{_DOM}++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?:(?<![0-9])|\G)[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A cheap test that a text can hold a match at all.
MAYBE = {
    "email": lambda t: F.contains(t, F.lit("@")),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9]"),
    "phone": lambda t: t.rlike(r"\+[0-9]"),
}
#: A token with a digit or @, whole; the text between two of these is the context of the second.
CANDIDATE = rf"(?<![^{WS}])[^{WS}0-9@]*+[0-9@][^{WS}]*+"
#: The identifier inside a token: its first run of identifier characters with a digit or @.
CORE = r"[\p{L}._%+/=:-]*+[0-9@][\p{L}\p{N}@._%+/=:-]*+"
MIN_CORE = 6
#: A pattern is believed when this many different instances of a kind have it, and this share of all of its
#: instances, PRIOR imagined failures included.
MIN_SUPPORT, MIN_CONFIDENCE, PRIOR = 5, 0.8, 2
#: Beliefs only grow, in ever smaller steps; a smaller change of a confidence is none.
LEAST_CHANGE = 1e-6
_CHUNK = 512
_SPANS = "array<struct<start:int,rank:int,end:int>>"


def _luhn(digits: Column) -> Column:
    places = F.sequence(F.lit(1), F.length(digits))

    def worth(i: Column) -> Column:
        d = F.ascii(F.substring(digits, i, F.lit(1))) - 48
        twice = d * 2
        return F.when((F.length(digits) - i) % 2 == 1, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d)

    return F.aggregate(places, F.lit(0), lambda a, i: a + worth(i)) % 10 == 0


def _valid(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "ip":
        return F.forall(
            F.split(match, r"\."), lambda p: let(F.regexp_replace(p, "^0+", ""), lambda d: (F.length(d) <= 2) | ((F.length(d) == 3) & (d <= "255")))
        )
    if kind == "card":
        return let(digits, lambda d: F.when(F.length(d).between(14, 19), _luhn(d)).otherwise(F.lit(False)))
    if kind == "phone":
        return F.length(digits).between(10, 15)
    return F.lit(True)


def _running(lengths: Column) -> Column:
    """Running sums of an array of ints. Appending is done in chunks, so that long arrays stay far from quadratic."""

    def within(part: Column, base: Column) -> Column:
        return F.aggregate(
            part,
            F.struct(base.alias("at"), F.array().cast("array<int>").alias("out")),
            lambda a, n: F.struct((a["at"] + n).alias("at"), F.concat(a["out"], F.array(a["at"] + n)).alias("out")),
            lambda a: a["out"],
        )

    def over(arr: Column) -> Column:
        chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(arr) - 1) / _CHUNK).cast("int")), lambda c: F.slice(arr, c * _CHUNK + 1, F.lit(_CHUNK)))

        def joined(parts: Column) -> Column:
            totals = F.transform(parts, lambda p: F.aggregate(p, F.lit(0), lambda a, n: a + n))
            bases = within(totals, F.lit(0))
            return F.flatten(let(bases, lambda b: F.transform(parts, lambda p, k: within(p, F.coalesce(F.get(b, k - 1), F.lit(0))))))

        return F.when(F.size(arr) == 0, F.array().cast("array<int>")).otherwise(let(chunks, joined))

    return let(lengths, over)


def matches(text: Column, pattern: str) -> Column:
    """All matches of a pattern as an array of (start, end, match), ends exclusive, with the text before each since the last one."""
    return let(
        F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("gaps")),
        lambda s: let(
            _running(F.zip_with(s["m"], F.slice(s["gaps"], F.lit(1), F.size(s["m"])), lambda m, g: F.length(m) + F.length(g))),
            lambda ends: F.transform(
                s["m"],
                lambda m, i: F.struct((F.get(ends, i) - F.length(m)).alias("start"), F.get(ends, i).alias("end"), m.alias("m"), F.get(s["gaps"], i).alias("gap"), F.get(s["gaps"], i - 1).alias("before"), F.get(s["gaps"], i + 1).alias("after")),
            ),
        ),
    )


def base_spans(text: Column) -> Column:
    """The base kinds found in a non-null text, as an array of (start, rank, end) in order."""
    none = F.array().cast(_SPANS)

    def of(rank: int, kind: str) -> Column:
        good = F.filter(matches(text, PATTERNS[kind]), lambda x: _valid(kind, x["m"]))
        hits = F.transform(good, lambda x: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), x["end"].alias("end")))
        return F.when(MAYBE[kind](text), hits).otherwise(none)

    return F.sort_array(F.concat(*[of(rank, kind) for rank, kind in enumerate(KINDS[:4])]))


def _contexts(x: Column) -> Column:
    """The patterns of a candidate, told apart by line ends and tabs, which no word holds."""
    word, blank, begin = rf"[^{WS}]++", r"[\x20\x09]++", rf"(?<![^{WS}])"
    tail = F.concat(F.when(x["before"].isNull(), F.lit("\n")).otherwise(F.lit("")), x["gap"])
    left = F.regexp_extract(x["gap"], rf"{begin}({word}){blank}$", 1)
    two = F.regexp_extract(x["gap"], rf"{begin}({word}{blank}{word}){blank}$", 1)
    first = F.regexp_extract(tail, rf"[\n\r\x0b\x0c][\x20\x09]*+({word}){blank}$", 1)
    far = F.regexp_extract(x["before"], rf"{begin}({word}){blank}$", 1)
    near = F.regexp_extract(x["gap"], rf"^(?:{blank}({word}))?{blank}$", 1)
    right = F.regexp_extract(x["after"], rf"^{blank}({word})", 1)
    beyond = F.when(x["gap"].rlike(rf"^{blank}(?:{word}{blank})?$") & (far != ""), F.concat(far, F.lit("\n#\n"), near))
    named = lambda mark, c: F.when(c != "", F.concat(F.lit(mark), c))
    return F.transform(F.array_compact(F.array(named("", two), named("", left), named("\n", first), beyond, named("\t", right))), F.lower)


def candidates(text: Column) -> Column:
    """Tokens with a digit or @, as an array of (start, end, inst, ctx): the identifier's place, its value, the patterns around it."""
    held = "array<struct<start:int,end:int,m:string,gap:string,before:string,after:string>>"
    raw = F.transform(
        F.when(text.rlike("[0-9@]"), matches(text, CANDIDATE)).otherwise(F.array().cast(held)),
        lambda x: let(
            F.regexp_extract(x["m"], CORE, 0),
            lambda core: F.struct(
                (x["start"] + F.instr(x["m"], core) - 1).alias("start"),
                (x["start"] + F.instr(x["m"], core) - 1 + F.length(core)).alias("end"),
                F.lower(core).alias("inst"),
                F.when(F.length(core) >= MIN_CORE, _contexts(x)).otherwise(F.array().cast("array<string>")).alias("ctx"),
            ),
        ),
    )
    return F.filter(raw, lambda x: F.size(x["ctx"]) > 0)


def _kind_of(base: Column, c: Column) -> Column:
    """The seed kind of a candidate: that of a base span over it, or ``secret`` for a long mixed hexadecimal key."""
    over = F.filter(base, lambda s: (s["start"] < c["end"]) & (s["end"] > c["start"]))
    key = c["inst"].rlike("^[0-9a-f]{32,}$") & c["inst"].rlike("[a-f]") & c["inst"].rlike("[0-9]")
    return F.coalesce(F.get(over, F.lit(0))["rank"], F.when(key, F.lit(4)))


def scan(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with ``base`` spans and the ``cands`` of each text, seeds marked by ``rank``."""
    whole = F.coalesce(F.col(text), F.lit(""))
    held = df.withColumns({"base": base_spans(whole), "cands": candidates(whole)})
    return held.withColumn(
        "cands",
        let(
            F.struct("base", "cands"),
            lambda s: F.transform(
                s["cands"],
                lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), F.xxhash64(c["inst"]).alias("inst"), c["ctx"].alias("ctx"), _kind_of(s["base"], c).alias("rank")),
            ),
        ),
    )


def bootstrap(scanned: DataFrame, rounds: int | None = None) -> DataFrame:
    """Confident patterns: (ctx, rank, conf), one kind for each, from the pattern-instance graph of all rows.

    Edges are distinct (pattern, instance) pairs, so copies of a document add nothing and a
    pattern that a third of the corpus holds is counted by partial aggregation. Rounds go on
    until no pattern is new and no confidence changes, unless a number of them is given.
    """
    cand = scanned.select(F.explode("cands").alias("c")).select(F.explode("c.ctx").alias("ctx"), "c.inst", "c.rank")
    edges = materialize(cand.groupBy("ctx", "inst").agg(F.min("rank").alias("rank")), "pii-edges")
    belief = edges.where("rank is not null").groupBy("inst").agg(F.min("rank").alias("rank")).withColumn("belief", F.lit(1.0))
    total = edges.groupBy("ctx").agg(F.count("*").alias("n_inst")).where(F.col("n_inst") >= MIN_SUPPORT)
    patterns, step = None, 0
    while rounds is None or step < rounds:
        scored = edges.select("ctx", "inst").join(belief, "inst").groupBy("ctx", "rank").agg(F.sum("belief").alias("support"))
        best = scored.where(F.col("support") >= MIN_SUPPORT).groupBy("ctx").agg(F.max(F.struct("support", (-F.col("rank")).alias("k"))).alias("b"))
        found = best.join(total, "ctx").select("ctx", (-F.col("b.k")).alias("rank"), F.least(F.lit(1.0), F.col("b.support") / (F.col("n_inst") + PRIOR)).alias("conf"))
        found = materialize(found.where(F.col("conf") >= MIN_CONFIDENCE), "pii-patterns")
        last, patterns, step = patterns, found, step + 1
        if last is not None:
            was = last.select("ctx", "rank", F.col("conf").alias("was"))
            if found.join(was, ["ctx", "rank"], "left").where(F.col("was").isNull() | (F.abs(F.col("conf") - F.col("was")) > LEAST_CHANGE)).isEmpty():
                break
        told = edges.select("ctx", "inst").join(patterns, "ctx").groupBy("inst", "rank").agg(
            (1 - F.exp(F.sum(F.log(F.greatest(F.lit(1e-9), 1 - F.col("conf")))))).alias("belief")
        )
        belief = materialize(belief.unionByName(told).groupBy("inst", "rank").agg(F.max("belief").alias("belief")), "pii-beliefs")
    return patterns


def find(df: DataFrame, text: str = "text", rounds: int | None = None) -> DataFrame:
    """``df`` with ``base`` and ``spans``: arrays of (start, rank, end); ``spans`` holds ``base`` and what contexts add.

    The texts are scanned once; offsets and candidates are written to the shared folder and
    joined there. Rows meet their additions again by a fingerprint of all their columns.
    """
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    keyed = carried(df, k=F.struct(fingerprint(df).alias("a"), F.crc32(whole.cast("binary")).alias("b"), F.length(whole).alias("c")), t=whole)
    slim = materialize(scan(keyed.select("k", "t"), "t").select("k", "base", "cands"), "pii-scan")
    patterns = bootstrap(slim, rounds)
    loose = slim.select("k", F.explode("cands").alias("c"), "base").where(
        ~F.exists("base", lambda s: (s["start"] < F.col("c.end")) & (s["end"] > F.col("c.start")))
    )
    new = (
        loose.select("k", F.col("c.start").alias("start"), F.col("c.end").alias("end"), F.explode("c.ctx").alias("ctx"))
        .join(patterns, "ctx")
        .groupBy("k", "start", "end")
        .agg(F.max(F.struct("conf", (-F.col("rank")).alias("r"))).alias("b"))
        .groupBy("k")
        .agg(F.collect_set(F.struct("start", (-F.col("b.r")).alias("rank"), "end")).alias("added"))
    )
    found = slim.select("k", "base").distinct().join(new, "k", "left").select("k", "base", F.sort_array(F.concat("base", F.coalesce("added", F.array().cast(_SPANS)))).alias("spans"))
    return unpacked(keyed.join(found, "k", "left"), df.columns, {"base": F.col("base"), "spans": F.col("spans")})


def spell(spans: Column) -> Column:
    """``kind:start:end`` of all spans, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"], s["end"])), ",")


def redact(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with every span of ``text`` replaced by ``[KIND]``; spans that touch the same characters become one. Null stays null."""
    labels = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    held = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), F.col(text).alias("_text"))
    found = find(held, "_text")

    def merged(spans: Column) -> Column:
        start = F.struct(F.lit(0).alias("end"), F.array().cast("array<struct<gap:int,start:int,rank:int>>").alias("out"))
        return F.aggregate(
            spans,
            start,
            lambda a, s: F.struct(
                F.greatest(a["end"], s["end"]).alias("end"),
                F.when(s["start"] < a["end"], a["out"]).otherwise(F.concat(a["out"], F.array(F.struct(a["end"].alias("gap"), s["start"].alias("start"), s["rank"].alias("rank"))))).alias("out"),
            ),
        )

    def cut(m: Column) -> Column:
        parts = F.transform(m["out"], lambda x: F.concat(F.substring(F.col("_text"), x["gap"] + 1, x["start"] - x["gap"]), F.get(labels, x["rank"])))
        return F.concat(F.array_join(parts, ""), F.substring(F.col("_text"), m["end"] + 1, F.lit(2147483647)))

    clean = F.when(F.col("_text").isNull() | (F.size("spans") == 0), F.col("_text")).otherwise(let(merged(F.col("spans")), cut))
    return found.select(*[clean.alias(c) if c == text else F.col(f"_row.`{c}`").alias(c) for c in df.columns])
