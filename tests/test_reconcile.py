import random

from people import LONG_BODY, direct, frame, quoted

from threadloom.functions import dates
from threadloom.operators import aggregate, identify, order, reconcile as rc
from pyspark.sql import functions as F


def bodies(rows):
    return [r["body"] for r in rc.merge(rows)]


def test_direct_copies_never_merge():
    assert len(rc.merge([direct("a", "Approved."), direct("b", "Approved.")])) == 2


def test_ambiguous_quote_stays():
    assert len(rc.merge([direct("a", "Approved by me."), direct("b", "Approved by me."), quoted("q", "Approved by me.")])) == 3


def test_quote_of_one_message_merges():
    assert len(rc.merge([direct("a", "Approved by me today."), quoted("q", "Approved by me today.", "2026-04-10T09:03:00Z")])) == 1
    assert len(rc.merge([direct("a", "Approved by me today."), quoted("q", "Approved by me today.", "2026-04-10T11:00:00Z")])) == 2


def test_changed_sense_stays_apart():
    words = LONG_BODY.split()
    for extra in ("not", "17", "cancelled"):
        assert len(rc.merge([direct("a", LONG_BODY), quoted("q", " ".join([*words[:9], extra, *words[9:]]))])) == 2
    assert len(rc.merge([direct("a", LONG_BODY), quoted("q", " ".join([*words[:9], "also", *words[9:]]))])) == 1


def test_zone_shift_takes_the_provider_clock():
    merged = rc.merge([quoted("q", LONG_BODY, "2026-04-10T13:30:00Z", zone_unknown=True), direct("a", LONG_BODY)])
    assert len(merged) == 1 and merged[0]["ms"] == dates.instant("2026-04-10T09:00:00Z")
    for at in ("2026-04-10T09:37:00Z", "2026-04-11T00:30:00Z"):
        assert len(rc.merge([quoted("q", LONG_BODY, at, zone_unknown=True), direct("a", LONG_BODY)])) == 2


def test_voted_offset_resolves_short_copies():
    rows = [direct("a", "Thanks, that works for me."), direct("b", "Please send it over now.", "2026-04-10T10:00:00Z"), direct("c", "Will do it today.", "2026-04-10T11:00:00Z")]
    rows += [quoted(f"q{i}", r["body"], dates.iso(r["ms"] + 4 * 3_600_000), zone_unknown=True) for i, r in enumerate(rows)]
    assert len(rc.merge(rows)) == 3


def test_pictures():
    one, two = '<img src="https://x.example/1.png">', '<img src="https://x.example/1.png"><img src="https://x.example/2.png">'
    merged = rc.merge([direct("a", LONG_BODY, body_html=one), quoted("q", LONG_BODY, body_html=two)])
    assert len(merged) == 1 and merged[0]["body_html"] == two
    assert rc.pictures_conflict(["a"], ["b"]) and not rc.pictures_conflict(["a"], ["b", "a"]) and not rc.pictures_conflict([], ["a"]) and not rc.pictures_conflict(["?"], ["b"])


def test_merging_again_changes_nothing():
    rows = [direct("a", LONG_BODY), quoted("q", LONG_BODY, "2026-04-10T13:30:00Z", zone_unknown=True, quoted_by="b"), direct("b", "Noted, thank you all.", "2026-04-10T15:00:00Z"), quoted("r", "Other words", at=None, ts_estimated=True)]
    once = rc.merge(rows)
    assert rc.merge(once) == once


def test_order_of_arrival_does_not_matter():
    rows = [direct(f"d{i}", f"{LONG_BODY} item {i}", f"2026-04-10T0{i}:00:00Z", idx=i) for i in range(5)]
    rows += [quoted(f"q{i}", f"{LONG_BODY} item {i}", f"2026-04-10T0{i}:01:00Z") for i in range(5)]
    expect = [r["id"] for r in rc.merge(rows)]
    for seed in range(5):
        random.Random(seed).shuffle(rows)
        assert [r["id"] for r in rc.merge(rows)] == expect


def test_unread_clocks_are_placed():
    rows = [direct("a", "one", "2026-04-10T09:00:00Z", idx=0), direct("b", "two", at=None, idx=1), direct("c", "three", at=None, idx=2), direct("d", "four", "2026-04-10T12:00:00Z", idx=3)]
    merged = rc.merge(rows)
    assert [r["id"] for r in merged] == ["a", "b", "c", "d"]
    assert merged[1]["ms"] == dates.instant("2026-04-10T10:00:00Z") and merged[1]["ts_estimated"]


def test_nesting_beats_clocks():
    rows = [quoted("old", "first words", "2026-04-10T13:28:00Z", zone_unknown=True, quoted_by="new"), direct("new", "an answer", "2026-04-10T09:04:00Z"), direct("later", "much later", "2026-04-10T20:00:00Z")]
    merged = rc.merge(rows)
    assert [r["id"] for r in merged] == ["old", "new", "later"]
    assert [bool(r.get("ordered_by_quote")) for r in merged] == [True, True, False]


def test_cycles_do_not_stall():
    rows = [direct("a", "x", quoted_by="b"), direct("b", "y", "2026-04-10T08:00:00Z", quoted_by="a")]
    assert sorted(r["id"] for r in rc.merge(rows)) == ["a", "b"]


def test_names():
    known = [direct("a", "hello there"), direct("b", "hi", email="sarah.jones@firma.example", name="Sarah Jones")]
    lone = direct("c", "by name", email="unknown:Sarah", name="Sarah")
    assert identify.resolve_names([*known, lone])[2]["sender"]["email"] == "sarah.jones@firma.example"
    two = direct("d", "x", email="sarah.connor@firma.example", name="Sarah Connor")
    assert identify.resolve_names([*known, two, lone])[3]["sender"]["email"] == "unknown:Sarah"
    for name in ("Unknown", "DJ", "Sally"):
        assert identify.resolve_names([*known, direct("e", "x", email=f"unknown:{name}", name=name)])[2]["sender"]["name"] == name


def test_names_as_joins(spark):
    rows = [direct("a", "hello"), direct("b", "hi", email="sarah.jones@firma.example", name="Sarah Jones"), direct("c", "x", email="unknown:sarah", name="Sarah"), direct("d", "y", email="unknown:unknown", name="Unknown"), direct("e", "z", email="unknown:ana ruiz", name="Ana Ruiz")]
    got = {r.id: r.sender.email for r in identify.resolve(frame(spark, rows)).collect()}
    assert got == {r["id"]: r["sender"]["email"] for r in identify.resolve_names(rows)}


def test_reconcile_rows(spark):
    rows = [direct("a", LONG_BODY), quoted("q", LONG_BODY, "2026-04-10T13:30:00Z", zone_unknown=True), direct("x", "other", thread_id="u"), direct("y", "no thread", thread_id="")]
    got = rc.reconcile(frame(spark, rows)).orderBy("thread_id", "ord").collect()
    assert [(r.thread_id, r.id, r.ord) for r in got] == [("t", "a", 0), ("u", "x", 0)]
    assert rc.reconcile(frame(spark, [])).count() == 0


def test_column_forms_agree(spark):
    pairs = [(LONG_BODY, LONG_BODY + " too"), (LONG_BODY, LONG_BODY + " not"), (LONG_BODY, "short"), (LONG_BODY, LONG_BODY)]
    df = spark.createDataFrame(pairs, "a string, b string")
    assert [r[0] for r in df.select(rc.near_copy_col(F.col("a"), F.col("b"))).collect()] == [rc.near_copy(a, b) for a, b in pairs]
    lists = [(["a"], ["b"]), (["a"], ["b", "a"]), ([], ["a"]), (["?"], ["b"]), (["a", "b"], ["b", "a"])]
    df = spark.createDataFrame(lists, "a array<string>, b array<string>")
    assert [r[0] for r in df.select(rc.pictures_conflict_col(F.col("a"), F.col("b"))).collect()] == [rc.pictures_conflict(a, b) for a, b in lists]


def test_near_copies_are_found_wherever_words_are_put_in(spark):
    said = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(40)]
    texts = [(0, " ".join(said), "en"), (1, " ".join(["well", *said]), "en"), (2, " ".join([*said, "indeed"]), "de"), (3, " ".join([said[0], "so", *said[1:]]), None)]
    texts += [(4, " ".join(["not", *said]), "en"), (5, " ".join(said), None), (6, " ".join([*said, "7"]), "en"), (7, ". ".join(said).upper(), "en"), (None, " ".join(said), "en"), (8, "?" * 200, "en"), (9, "!" * 200, None)]
    texts += [(10 + n, " ".join([*said, *["and"] * n]), "en") for n in range(6, 10)]
    docs = spark.createDataFrame(texts, "doc_id long, text string, lang string")
    want = sorted((a, b) for a, t, _ in texts for b, u, _ in texts if None not in (a, b) and a < b and (rc.near_copy(t.lower(), u.lower()) or (a, b) == (8, 9)))
    classes = list(map(tuple, rc.near_copy_classes(docs).collect()))
    of = {b: a for kind, a, b in classes if kind == "same"}
    same = lambda a: [a, *[b for b, c in of.items() if c == a]]
    copies = {(a, b) for x in {*of.values()} for a in same(x) for b in same(x) if a < b}
    across = {(min(a, b), max(a, b)) for kind, x, y in classes if kind == "longer" for a in same(x) for b in same(y)}
    assert sorted(copies | across) == want and len(set(classes)) == len(classes)
    assert all(a == min(same(a)) and a not in of for _, a, _ in classes)
    assert {(0, 1), (0, 2), (0, 3), (0, 5), (0, 7), (0, 16), (0, 17)} <= set(want) and not {(0, 4), (0, 6), (0, 18)} & set(want)
    assert rc.near_copies(docs)[0].select("body").distinct().count() == 11


def test_participation(spark):
    rows = [direct("a", "x"), direct("b", "y", recipients=["bo@firma.example"]), direct("c", "z", email="bo@firma.example")]
    find = lambda rs, user: [(r.message_id, r.kind) for r in aggregate.participation(frame(spark, rs), F.lit(user)).collect()]
    assert find(rows, "bo@firma.example") == [("b", "recipient")]
    assert find([rows[0], rows[2]], "Bo@firma.example") == [("c", "authored")]
    assert find(rows, "ana@firma.example") == []
    assert find([quoted("q", "old"), rows[0]], "nobody@firma.example") == [("a", "available")]
    assert find([rows[0]], "nobody@firma.example") == []


def test_attachments_distinct(spark):
    one = {"name": "a.pdf", "mime_type": "application/pdf", "size_label": "1 KB", "download_url": "u"}
    rows = frame(spark, [direct("a", "x", attachments=[one, one | {"name": "b.pdf"}, one])])
    got = rows.select(aggregate.distinct_attachments(F.col("attachments"), F.col("attachments")).alias("f")).first().f
    assert [f.name for f in got] == ["a.pdf", "b.pdf"]


def test_votes_as_joins(spark):
    rows = [direct("a", LONG_BODY), quoted("q", LONG_BODY, "2026-04-10T13:30:00Z", zone_unknown=True)]
    got = [(r.quarter, r.pairs) for r in rc.offset_votes(frame(spark, rows)).collect()]
    assert got == [(-16_200_000, 1)] and rc.voted_offsets([rc.Copy(r) for r in rows]) == [-16_200_000]


def test_batches_and_order(spark):
    rows = frame(spark, [direct(f"m{i}", "x", f"2026-04-10T0{9 - i}:00:00Z") for i in range(6)])
    assert [r.id for r in order.chronological(rows).orderBy("pos").collect()] == ["m5", "m4", "m3", "m2", "m1", "m0"]
    assert [r.batch for r in order.batches(rows, ["thread_id"], "ord").orderBy("ord").collect()] == [0, 0, 0, 0, 1, 1]
