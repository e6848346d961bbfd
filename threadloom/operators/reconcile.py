"""Deciding which copies are one message, and what that message then says.

The evidence is available in two forms. Set-based: column predicates and joins, blocked by
author and core text, for analysis over many threads. And ``merge``, the fold that the
semantics need: direct copies first, each copy held against the messages combined so
far. The fold looks its candidates up by id and by author keys, so it does not compare
every pair, and runs for each thread where the thread's rows are.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from dataclasses import field as dc_field
from itertools import combinations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import text as tx
from ..functions.markup import nfkc
from ..functions.storage import checkpoint
from ..schema import MESSAGE

# Fixed values, in milliseconds and characters.
SKEW, QUARTER, LEAST_SHIFT, MOST_SHIFT = 300_000, 900_000, 840_000, 14 * 3_600_000
MINUTE = 60_000
LONG, SPECIFIC, EXACT, CONFIRMED, ESTIMATED = 160, 40, 24, 12, 100
NEAR_RATIO = 0.85
#: One in so many words of a text is marked in each of its words of bits (powers of two).
MARK_SHARES = (4, 16, 128)
_CHANGES = re.compile(r"\d|^(?:no|not|never|cancel|cancelled|revoked|reject|rejected|instead|except)$", re.I)
_WORD = re.compile(r"(?:[^\W_]|['-])+")
_NOISE = [re.compile(p.replace(r"\z", r"\Z")) for p in tx.NOISE]
_SIGN_OFF, _CLIPPED = re.compile(tx.SIGN_OFF), re.compile(tx.CLIPPED)
_QUOTE_MARK = re.compile(r"^\s*>+\s?", re.M)
_STRAIGHT = str.maketrans("‘’“”", "''\"\"")


def picture_keys(html: str | None) -> list[str]:
    """F15 on a string."""
    keys = []
    for tag in re.findall(r"<img\b[^>]*>", html or "", re.I):
        m = re.search(r'(?:src|data-tl-image-src)="([^"]*)"', tag, re.I)
        raw = m[1] if m else ""
        proxied, url = re.search(r'#(https?://[^"\s]+)$', raw), re.match(r"([a-z][a-z0-9+.-]*://[^/?#]*)([^?#]*)", raw, re.I)
        if proxied:
            keys.append(proxied[1])
        elif re.match("data:", raw, re.I):
            keys.append(raw)
        elif re.match("cid:", raw, re.I):
            keys.append(raw.lower())
        elif re.match("blob:", raw, re.I) or re.search(r"googleusercontent\.com/proxy/", raw, re.I):
            keys.append("?")
        else:
            keys.append(url[1].lower() + (url[2] or "/") if url else raw or "?")
    return keys


def pictures_conflict(a: list[str], b: list[str]) -> bool:
    """The shorter list of pictures is not the longer one with some left out; ``?`` may be any."""
    few, many = (a, b) if len(a) <= len(b) else (b, a)
    left = iter(many)
    return bool(few) and not all(any("?" in (k, other) or k == other for other in left) for k in few)


def normal(body: str) -> str:
    """F19 on a string, compatibility forms folded."""
    return " ".join(nfkc(_QUOTE_MARK.sub("", body)).translate(_STRAIGHT).split()).lower()


def _plain(body: str) -> str:
    for p in _NOISE:
        body = p.sub(" ", body)
    return body


def _unclipped(text: str) -> str:
    cut = _CLIPPED.search(text)
    return re.sub(r"[\s.…]+\Z", "", text[: cut.start()]) if cut else text


def core(body: str) -> str:
    """F22 on a string."""
    text = _QUOTE_MARK.sub("", _plain(body))
    signed = _SIGN_OFF.search(text)
    return normal(_unclipped(text[: signed.start()] if signed else text)) or normal(body)


def near_copy(a: str, b: str) -> bool:
    """The longer text is the shorter with a few words put in, none of which changes its sense."""
    if min(len(a), len(b)) < LONG:
        return False
    few, many = sorted((_WORD.findall(a), _WORD.findall(b)), key=len)
    if len(few) / max(1, len(many)) < NEAR_RATIO:
        return False
    at, added = 0, []
    for w in many:
        if at < len(few) and w == few[at]:
            at += 1
        else:
            added.append(w)
    return at == len(few) and not any(_CHANGES.search(w) for w in added)


def key_of(name: str) -> str:
    return re.sub(r"[^a-z0-9]+", "", name.lower())


def specific(name: str) -> str:
    """F18 on a string."""
    key = key_of(name)
    return key if len(key) >= 4 and key not in tx.PLACEHOLDER_NAMES else ""


@dataclass(eq=False)
class Face:
    """One presentation of a message: its words and pictures, read once."""

    body: str
    html: str | None
    shown: str = dc_field(init=False)
    clipped: bool = dc_field(init=False)
    pictures: list[str] = dc_field(init=False)

    def __post_init__(self):
        self.shown = normal(_unclipped(_plain(self.body)))
        self.clipped = bool(_CLIPPED.search(self.body))
        self.pictures = picture_keys(self.html)

    def like(self, other: Face) -> bool:
        """F24."""
        x, y = self.shown, other.shown
        begun = min(len(x), len(y)) >= SPECIFIC and (self.clipped and y.startswith(x) or other.clipped and x.startswith(y))
        return (x == y or begun) and not pictures_conflict(self.pictures, other.pictures)

    @property
    def worth(self) -> tuple[bool, int, int]:
        """Whole before clipped, then more pictures, then more that are known."""
        return not self.clipped, len(self.pictures), sum(k != "?" for k in self.pictures)


@dataclass(eq=False)
class Copy:
    """A message while copies are merged: the row, and what the evidence reads of it."""

    row: dict
    variants: list[Face] = dc_field(default_factory=list)

    def __post_init__(self):
        r = self.row
        self.face = Face(r.get("body") or "", r.get("body_html"))
        self.core = core(self.face.body)
        self.email = re.sub(r"\s", "", (r["sender"]["email"] or "").lower())
        self.name = r["sender"]["name"] or ""
        self.quoted = r.get("source") == "quoted"
        self.clock()

    def clock(self) -> None:
        r = self.row
        self.ms, self.estimated, self.zoneless = r.get("ms"), bool(r.get("ts_estimated")), bool(r.get("zone_unknown"))
        self.anchored = self.ms is not None and not self.estimated and not self.zoneless

    @property
    def rank(self) -> int:
        """F27."""
        return 0 if self.ms is None else 1 + (not self.estimated) + 2 * (not self.zoneless)

    def keys(self) -> list[str]:
        """Two copies can have one author only if they share one of these."""
        if self.email.startswith("unknown:") or "@" not in self.email:
            name = specific(self.name)
            return [f"e:{self.email}", *([f"n:{name}"] if name else [])]
        return [f"e:{self.email}", f"n:{key_of(self.name)}", f"n:{re.sub('[^a-z0-9]+', '', self.email.split('@')[0])}"]

    def same_author(self, other: Copy) -> bool:
        if self.email == other.email:
            return "@" in self.email or bool(specific(self.name))
        named, known = (self, other) if self.email.startswith("unknown:") else (other, self)
        if not named.email.startswith("unknown:") or "@" not in known.email:
            return False
        name = specific(named.name)
        return bool(name) and name in (key_of(known.name), re.sub("[^a-z0-9]+", "", known.email.split("@")[0]))


def shifted(a: Copy, b: Copy) -> bool:
    """The clocks differ by what a time zone would make of one clock."""
    if not (a.zoneless or b.zoneless) or a.ms is None or b.ms is None:
        return False
    gap = abs(a.ms - b.ms)
    return LEAST_SHIFT <= gap <= MOST_SHIFT and min(gap % QUARTER, QUARTER - gap % QUARTER) < SKEW


def offset(a: Copy, b: Copy) -> int | None:
    """From the clock without a zone to the anchored one."""
    quote, other = (a, b) if a.zoneless else (b, a)
    return other.ms - quote.ms if quote.zoneless and other.anchored and quote.ms is not None else None


def proven(gap: int | None, known: list[int]) -> bool:
    return gap is not None and any(abs(k - gap) < SKEW for k in known)


def is_copy(a: Copy, b: Copy, known: list[int]) -> bool:
    """Whether the evidence makes two copies one message."""
    if a.row["id"] == b.row["id"]:
        return True
    x, y = a.core, b.core
    if not (a.quoted or b.quoted) or not x or not y or not a.same_author(b):
        return False
    shortest = min(len(x), len(y))
    begun = shortest >= SPECIFIC and (a.face.clipped and y.startswith(x) or b.face.clipped and x.startswith(y))
    exact = x == y or begun
    if not (exact and shortest >= SPECIFIC) and pictures_conflict(a.face.pictures, b.face.pictures):
        return False
    both = a.ms is not None and b.ms is not None
    if both and abs(a.ms - b.ms) < (SKEW if exact else MINUTE) or exact and (a.estimated or b.estimated) and len(x) >= ESTIMATED:
        return exact or near_copy(x, y)
    if shifted(a, b):
        gap = offset(a, b)
        sure = proven(gap, known)
        if exact:
            held = gap is not None and any(c.anchored and not c.quoted for c in (a, b))
            return shortest >= (CONFIRMED if sure else SPECIFIC if held else LONG)
        if (a.anchored or b.anchored) and shortest >= (SPECIFIC if sure else LONG):
            return near_copy(x, y)
    if (a.estimated or b.estimated) and both:
        from ..functions.dates import iso

        return iso(a.ms)[5:16] == iso(b.ms)[5:16] and near_copy(x, y)
    return False


def voted_offsets(copies: list[Copy]) -> list[int]:
    """A2: the offsets that word-for-word copies agree on; of those with most weight, all."""
    groups: dict[str, list[Copy]] = defaultdict(list)
    for c in copies:
        if len(c.core) >= EXACT:
            groups[c.core].append(c)
    pairs: dict[int, int] = defaultdict(int)
    weight: dict[int, int] = defaultdict(int)
    for words, group in groups.items():
        for a, b in combinations(group, 2):
            if not (a.quoted or b.quoted) or not shifted(a, b) or not a.same_author(b) or pictures_conflict(a.face.pictures, b.face.pictures):
                continue
            if (gap := offset(a, b)) is not None:
                quarter = (2 * gap + QUARTER) // (2 * QUARTER) * QUARTER
                pairs[quarter] += 1
                weight[quarter] += len(words)
    good = [q for q in pairs if pairs[q] > 1 or weight[q] >= LONG]
    best = max((weight[q] for q in good), default=0)
    return [q for q in good if best and weight[q] == best]


def combine(main: Copy, other: Copy) -> Copy:
    """One message of two copies, the first giving whatever is not compared."""
    faces = [main.face, other.face, *main.variants, *other.variants]
    display = main.face
    for f in faces:
        if f.like(display) and f.worth > display.worth:
            display = f
    kept: list[Face] = []
    for f in faces:
        if f.like(display) and len(f.pictures) <= len(display.pictures):
            continue
        at = next((i for i, k in enumerate(kept) if k.like(f)), None)
        if at is None:
            kept.append(f)
        elif f.worth > kept[at].worth:
            kept[at] = f
    row = dict(main.row) | {"body": display.body, "body_html": display.html}
    if other.rank > main.rank:
        row |= {"ms": other.ms, "ts_raw": other.row.get("ts_raw"), "ts_estimated": other.estimated, "zone_unknown": other.zoneless}
    recipients = list(dict.fromkeys([*(main.row.get("recipients") or []), *(other.row.get("recipients") or [])]))
    files = {(f["name"], f["size_label"], f["download_url"]): f for f in reversed([*(main.row.get("attachments") or []), *(other.row.get("attachments") or [])])}
    row |= {"recipients": recipients or None, "attachments": list(reversed(files.values())) or None}
    out = Copy(row, kept)
    row["quoted_variants"] = [{"body": f.body, "body_html": f.html} for f in kept] or None
    return out


def fold(copies: list[Copy], known: list[int]) -> tuple[list[Copy], list[int], dict[int, int]]:
    """The messages that the copies make, offsets that long merges show, and where each copy went."""
    made: list[Copy] = []
    by_id: dict[str, int] = {}
    by_author: dict[str, set[int]] = defaultdict(set)
    seen: list[int] = []
    place: dict[int, int] = {}
    for i in sorted(range(len(copies)), key=lambda i: copies[i].quoted):
        c = copies[i]
        at = by_id.get(c.row["id"])
        if at is None:
            near = sorted({k for key in c.keys() for k in by_author.get(key, ())})
            hits = [k for k in near if is_copy(made[k], c, known)]
            if len(hits) > 1:
                # The one whose gap is none, or is this thread's own
                gaps = [(k, offset(made[k], c) if shifted(made[k], c) else 0) for k in hits]
                hits = [k for k, gap in gaps if gap == 0 or proven(gap, known)]
            if len(hits) != 1:
                place[i] = len(made)
                by_id[c.row["id"]] = len(made)
                for key in c.keys():
                    by_author[key].add(len(made))
                made.append(combine(c, c) if c.variants else c)
                continue
            at = hits[0]
            gap = offset(made[at], c) if shifted(made[at], c) else None
            if gap is not None and min(len(made[at].core), len(c.core)) >= LONG:
                seen.append(gap)
        place[i] = at
        made[at] = combine(made[at], c)
    return made, seen, place


def merge(rows: Iterable[dict]) -> list[dict]:
    """Copies of a thread in order of arrival as its messages, reconciled, dated, ordered and identified."""
    from .identify import resolve_names
    from .order import place_unread, sequence

    rows = list(rows)
    copies = [Copy(r, [Face(v["body"] or "", v["body_html"]) for v in r.get("quoted_variants") or []]) for r in rows]
    known = voted_offsets(copies)
    made, seen, place = fold(copies, known)
    if seen:
        made, _, place = fold(copies, known + seen)
    home = {r["id"]: place[i] for i, r in enumerate(rows)}
    edges = [(place[i], home[r["quoted_by"]]) for i, r in enumerate(rows) if r.get("quoted_by") in home]
    return resolve_names(sequence(place_unread([c.row for c in made]), edges))


def reconcile(messages: DataFrame) -> DataFrame:
    """Message rows as reconciled messages: one row each, ``ord`` being the place in the thread.

    One shuffle by thread. A thread is merged where its rows meet, as order and earlier merges
    decide later ones; rows without a thread are left out.
    """
    from .split import from_row, to_rows

    schema = to_arrow_schema(MESSAGE)

    def merged(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: (r["ord"] is None, r["ord"] or 0, r["id"] or ""))
        done = merge(from_row(r) for r in rows)
        return pa.Table.from_pylist(to_rows(done), schema)

    named = messages.where(F.coalesce("thread_id", F.lit("")) != "").select(*MESSAGE.fieldNames())
    return named.groupBy("thread_id").applyInArrow(merged, MESSAGE)


# --- set-based forms -------------------------------------------------------------------


def evidence(messages: DataFrame, compatibility: Column | None = None) -> DataFrame:
    """Message rows with what pairwise evidence reads, computed once before any self-join."""
    return messages.withColumns(
        {
            "core": tx.core_text(F.coalesce("body", F.lit(""))),
            "pictures": tx.image_keys(F.col("body_html")),
            "author_key": F.regexp_replace(F.lower("sender.email"), r"\s", ""),
            "ms": F.unix_millis("ts"),
            "anchored": tx.anchored_time(F.col("ts"), F.col("ts_estimated"), F.col("zone_unknown")),
        }
    )


def zone_shift(a_ms: Column, b_ms: Column) -> Column:
    """J6 on columns, given that one side has no zone."""
    gap = F.abs(a_ms - b_ms)
    return gap.between(LEAST_SHIFT, MOST_SHIFT) & (F.least(gap % QUARTER, QUARTER - gap % QUARTER) < SKEW)


def _by_size(a: Column, b: Column) -> Column:
    return F.when(F.size(a) <= F.size(b), F.struct(a.alias("few"), b.alias("many"))).otherwise(F.struct(b.alias("few"), a.alias("many")))


def pictures_conflict_col(a: Column, b: Column) -> Column:
    """X3 on columns."""

    def conflict(p: Column) -> Column:
        few = p["few"]
        fits = lambda k, at: (k == "?") | (F.get(few, at) == "?") | (F.get(few, at) == k)
        met = F.aggregate(p["many"], F.lit(0), lambda at, k: F.when((at < F.size(few)) & fits(k, at), at + 1).otherwise(at))
        return (F.size(few) > 0) & (met < F.size(few))

    return tx.let(_by_size(a, b), conflict)


def near_copy_col(a: Column, b: Column) -> Column:
    """X4 on columns of core text."""
    words = lambda c: F.regexp_extract_all(c, F.lit(r"[\p{L}\p{N}'-]+"), F.lit(0))
    changes = r"(?i)\d|^(?:no|not|never|cancel|cancelled|revoked|reject|rejected|instead|except)\z"

    def inserted(p: Column) -> Column:
        few = p["few"]
        met = F.aggregate(
            p["many"],
            F.struct(F.lit(0).alias("at"), F.lit(True).alias("fine")),
            lambda s, w: F.when(F.get(few, s["at"]) == w, F.struct((s["at"] + 1).alias("at"), s["fine"].alias("fine"))).otherwise(
                F.struct(s["at"].alias("at"), (s["fine"] & ~w.rlike(changes)).alias("fine"))
            ),
            lambda s: (s["at"] == F.size(few)) & s["fine"],
        )
        return (F.size(few) >= NEAR_RATIO * F.size(p["many"])) & met

    pair = tx.let(F.struct(words(a).alias("x"), words(b).alias("y")), lambda w: tx.let(_by_size(w["x"], w["y"]), inserted))
    return (F.least(F.length(a), F.length(b)) >= LONG) & pair


def _marks(ranks: Column) -> list[Column]:
    """Three words of 64 bits, each of a share of the hashes: if one text holds all words of another, its bits include the other's.

    The shares suit texts of about 200, 700 and 6000 different words; fuller words of bits tell less, and never exclude a pair wrongly.
    """
    kept = lambda share: F.filter(ranks, lambda r: F.shiftright(r, 6).bitwiseAND(F.lit(share - 1)) == 0)
    bit = lambda r: F.call_function("shiftleft", F.lit(1).cast("long"), r.bitwiseAND(F.lit(63)).cast("int"))
    return [F.aggregate(kept(share), F.lit(0).cast("long"), lambda s, r: s.bitwiseOR(bit(r))).alias(f"m{share}") for share in MARK_SHARES]


def near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """X4 over a whole table: (members: ``body``, ``id``; pairs: ``few``, ``many``).

    Texts of the same words are one body, named by a digest of them. A pair names a body and
    one with words put in. Its candidates are complete: all words of the shorter are in the
    longer, which has at most ``1 - NEAR_RATIO`` of its own besides. So in any order of words,
    the shorter's first is among as many first ones of the longer and one more; the order is
    by length, as long words are rare. Lists are cut in blocks by the number of words, and
    only candidates whose bits include the shorter's (``_marks``) take their texts along. Null keys are left out.
    """
    whole = docs.where(F.col(key).isNotNull() & (F.length(text) >= LONG)).select(F.col(key).alias("id"), F.lower(text).alias("text"))
    words = F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}'-]+"), F.lit(0))
    body = lambda w: F.md5(F.array_join(w, " ").cast("binary"))
    rank = lambda x: F.shiftleft(-F.least(F.length(x), F.lit(127)).cast("long"), 56).bitwiseOR(F.xxhash64(x).bitwiseAND(F.lit((1 << 56) - 1)))
    order = lambda w: F.sort_array(F.array_distinct(F.transform(w, rank)))
    rest = lambda n: (n - F.ceil(NEAR_RATIO * n - 1e-9) + 1).cast("int")
    told = lambda w: tx.let(order(w), lambda o: F.struct(F.slice(o, F.lit(1), rest(F.size(w))).alias("first"), *_marks(o)))
    read = whole.select("id", tx.let(words, lambda w: F.struct(body(w).alias("body"), F.size(w).alias("n"), told(w).alias("told"))).alias("r"))
    bodies = read.groupBy("r.body").agg(F.min("id").alias("id"), F.first("r.n").alias("n"), F.first("r.told").alias("told"))
    bodies = checkpoint(bodies.where("n > 0").withColumn("no", F.monotonically_increasing_id()))

    marks = [f"m{share}" for share in MARK_SHARES]
    block = F.floor(F.log(F.col("n").cast("double")) / -math.log(NEAR_RATIO) + 1e-9)
    side = lambda x: [F.col("n").alias(f"{x}_n"), F.col("no").alias(x), *[F.col(f"told.{m}").alias(f"{x}_{m}") for m in marks]]
    few = bodies.select(F.get("told.first", F.lit(0)).alias("word"), F.explode(F.array(block, block + 1)).alias("block"), *side("few"))
    many = bodies.select(F.explode("told.first").alias("word"), block.alias("block"), *side("many"))
    fits = (F.col("few_n") < F.col("many_n")) & (F.col("few_n") >= NEAR_RATIO * F.col("many_n"))
    for m in marks:
        fits = fits & (F.col(f"few_{m}").bitwiseAND(F.col(f"many_{m}")) == F.col(f"few_{m}"))
    likely = checkpoint(few.join(many, ["word", "block"]).where(fits).select("few", "many"))

    asked = likely.select(F.col("few").alias("no")).union(likely.select("many")).distinct().join(bodies.select("no", "id", "body"), "no")
    held = whole.join(asked, "id").where(body(words) == F.col("body")).groupBy("no").agg(F.first("body").alias("body"), F.first("text").alias("text"))
    held = checkpoint(held)
    texts = lambda x: held.select(F.col("no").alias(x), F.col("body").alias(f"{x}_body"), F.col("text").alias(f"{x}_text"))
    pairs = likely.join(texts("few"), "few").join(texts("many"), "many").where(near_copy_col(F.col("few_text"), F.col("many_text")))
    return read.select("r.body", "id"), pairs.select(F.col("few_body").alias("few"), F.col("many_body").alias("many"))


def near_copy_classes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The same by the least key of each body, a row each: ``relation``, ``a``, ``b``.

    'same': ``b`` has the words of the body of ``a``; 'longer': the body of ``b`` is that of ``a`` with words put in.
    Rows grow with the members and the pairs of bodies, not with the square of a group of copies.
    """
    members, pairs = near_copies(docs, key, text)
    least = checkpoint(members.groupBy("body").agg(F.min("id").alias("a")))
    same = members.join(least, "body").where("id <> a").select(F.lit("same").alias("relation"), "a", F.col("id").alias("b")).distinct()
    few = pairs.join(least.withColumnRenamed("body", "few"), "few")
    across = few.join(least.select(F.col("body").alias("many"), F.col("a").alias("b")), "many").where("a <> b")
    return same.unionByName(across.select(F.lit("longer").alias("relation"), "a", "b").distinct())


def copy_groups(messages: DataFrame, least: int = EXACT) -> DataFrame:
    """Groups of word-for-word copies: thread, core, how many, their ids."""
    found = evidence(messages).where(F.length("core") >= least)
    return found.groupBy("thread_id", "core").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("id")).alias("ids")).where("n > 1")


def offset_votes(messages: DataFrame) -> DataFrame:
    """A2 as joins: (thread_id, quarter, pairs, weight) of the offsets with most weight in each thread."""
    e = evidence(messages).where(F.length("core") >= EXACT).select("thread_id", "id", "ord", "core", "author_key", "ms", "anchored", "pictures", "source", tx.yes(F.col("zone_unknown")).alias("zoneless"))
    a, b = (e.select("thread_id", "core", "author_key", *[F.col(c).alias(f"{x}_{c}") for c in ("ord", "ms", "anchored", "zoneless", "pictures", "source")]) for x in "ab")
    pair = a.join(b, ["thread_id", "core", "author_key"]).where(
        "a_zoneless AND b_anchored AND (a_source = 'quoted' OR b_source = 'quoted')"
    ).where(zone_shift(F.col("a_ms"), F.col("b_ms")) & ~pictures_conflict_col(F.col("a_pictures"), F.col("b_pictures")))
    quarter = (F.floor((F.col("b_ms") - F.col("a_ms")) / QUARTER + 0.5) * QUARTER).cast("long")
    votes = pair.groupBy("thread_id", quarter.alias("quarter")).agg(F.count("*").alias("pairs"), F.sum(F.length("core")).alias("weight"))
    top = F.rank().over(Window.partitionBy("thread_id").orderBy(F.desc("weight")))
    return votes.where((F.col("pairs") > 1) | (F.col("weight") >= LONG)).withColumn("r", top).where("r = 1").drop("r")


def quote_links(messages: DataFrame) -> DataFrame:
    """(thread_id, older_id, newer_id), a message and the one that quotes it."""
    older = messages.where("quoted_by is not null").select("thread_id", F.col("id").alias("older_id"), F.col("quoted_by").alias("newer_id"))
    return older.join(messages.select("thread_id", F.col("id").alias("newer_id")), ["thread_id", "newer_id"], "left_semi").select("thread_id", "older_id", "newer_id").where("older_id <> newer_id").distinct()


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        yield from batch.to_pylist()
