from html import escape

from people import ANCHOR

from threadloom.functions import dates
from threadloom.operators import split as sp

USER = "bo@firma.example"


def plain(text):
    return sp.extract(escape(text).replace("\n", "<br>"), USER, "t", ANCHOR, "carrier")


def nested(n):
    html = f"<div>note number {n} for the file</div>"
    if n > 1:
        who = f'On Mon, Apr {1 + (n - 1) // 24}, 2026 at {(n - 1) % 12 + 1}:00 AM Person{n - 1} &lt;<a href="mailto:p{n - 1}@firma.example">p{n - 1}@firma.example</a>&gt; wrote:<br>'
        html += f'<div class="gmail_quote"><div class="gmail_attr">{who}</div><blockquote class="gmail_quote">{nested(n - 1)}</blockquote></div>'
    return html


def test_deep_chain():
    body, _, history = sp.extract(nested(40), USER, "t", ANCHOR, "carrier")
    assert body == "note number 40 for the file"
    assert [m["body"] for m in history] == [f"note number {n} for the file" for n in range(39, 0, -1)]
    assert history[0]["quoted_by"] == "carrier"
    assert all(a["id"] == b["quoted_by"] for a, b in zip(history, history[1:], strict=False))
    assert len({m["id"] for m in history}) == 39


def test_field_blocks_and_wrapped_recipients():
    text = (
        "See below.\n\nFrom: Ana Ruiz <ana@firma.example>\nSent: Friday, April 10, 2026 9:12 AM\nTo: Bo <bo@firma.example>; Cleo West\n <cleo@firma.example>; dan@firma.example\n"
        "Subject: Plan\n\nThe plan is attached.\n\nThis e-mail and any attachments are confidential.\n\nFrom: Bo <bo@firma.example>\nSent: Thursday, April 9, 2026 4:00 PM\nTo: ana@firma.example\nSubject: Plan\n\nCould you send the plan?\n"
    )
    body, _, history = plain(text)
    assert body == "See below."
    first, second = history
    assert first["body"] == "The plan is attached."
    assert first["recipients"] == ["bo@firma.example", "cleo@firma.example", "dan@firma.example"]
    assert second["is_current_user"] and second["quoted_by"] == first["id"]
    assert first["zone_unknown"] and not first["ts_estimated"]


def test_other_languages():
    for who, when, to, about in (("De", "Envoyé", "À", "Objet"), ("Von", "Gesendet", "An", "Betreff"), ("Van", "Verzonden", "Aan", "Betreff")):
        _, _, history = plain(f"Hi\n{who}: Ana <ana@firma.example>\n{when}: 10 Apr 2026 09:12\n{to}: bo@firma.example\n{about}: x\n\nold words")
        assert [m["body"] for m in history] == ["old words"]


def test_prose_is_not_split():
    assert plain("From: here to there\nTo: the end\nand no date at all")[2] == []
    assert plain("nothing quoted")[2] == []


def test_attribution_over_two_lines():
    _, _, history = plain("Hi\nOn Fri, Apr 10, 2026 at 9:12 AM Ana Ruiz\n<ana@firma.example> wrote:\nold words here")
    assert [(m["sender"]["email"], m["body"]) for m in history] == [("ana@firma.example", "old words here")]


def test_text_after_a_nested_quote_stays_with_its_author():
    html = (
        '<div>top</div><div class="gmail_quote"><div class="gmail_attr">On Mon, Apr 6, 2026 at 2:57 PM Ana &lt;<a href="mailto:ana@firma.example">ana@firma.example</a>&gt; wrote:</div>'
        '<blockquote class="gmail_quote">ana begins<div class="gmail_attr">On Sun, Apr 5, 2026 at 1:00 PM Dan &lt;<a href="mailto:dan@firma.example">dan@firma.example</a>&gt; wrote:</div>'
        '<blockquote class="gmail_quote">dan wrote this</blockquote>ana ends</blockquote></div>'
    )
    _, _, history = sp.extract(html, USER, "t", ANCHOR, "c")
    assert history[0]["body"].split() == ["ana", "begins", "ana", "ends"]
    assert history[1]["body"] == "dan wrote this"


def test_dates():
    late = dates.instant("2026-10-01T00:00:00Z")
    assert dates.mail_date("8 Sep, 09:44 +0000", late) == (dates.instant("2026-09-08T09:44:00Z"), True)
    assert dates.mail_date("Dec 31", dates.instant("2026-01-02")) == (dates.instant("2025-12-31"), True)
    assert dates.mail_date("Friday, April 10, 2026 9:12 PM", 0) == (dates.instant("2026-04-10T21:12:00Z"), False)
    assert dates.mail_date("Fri, 10 Apr 2026 09:12:30 +0530", 0) == (dates.instant("2026-04-10T03:42:30Z"), False)
    assert dates.mail_date("no date", 5) == (5, True)
    assert dates.has_zone("10:00 +0200") and not dates.has_zone("10:00 AM")


def test_snapshot_with_only_history_is_a_carrier():
    html = f"<div></div>{nested(3).split('</div>', 1)[1]}"
    head = {"id": "d1", "sender": {"name": "Bo", "email": USER}, "ms": ANCHOR, "recipients": ["cleo@firma.example", "dan@firma.example", "eve@firma.example", "flo@firma.example"], "source": "direct"}
    rows = sp.messages_of({"thread_id": "t", "current_user": USER, "message": head, "html": html, "image_sources": []})
    own = rows[-1]
    assert own["history_carrier"] and "cleo@firma.example, dan@firma.example and 2 others" in own["body"]
    assert sp.messages_of({"thread_id": "t", "current_user": USER, "message": head, "html": "", "image_sources": None}) == []


def test_legacy_strip():
    assert sp.strip_quoted('<div>mine</div><blockquote>theirs</blockquote>') == ("mine", "theirs")


def test_split_rows(spark):
    from people import direct, frame
    from pyspark.sql import functions as F

    base = frame(spark, [direct("d1", ""), direct("d2", "")]).withColumn("n", F.col("ord"))
    header = F.struct(*[c for c in base.columns if c != "n"]).alias("message")
    snaps = base.select("thread_id", F.lit("s").alias("session"), F.col("n").alias("seq"), F.lit(USER).alias("current_user"), header, F.when(F.col("n") == 0, F.lit(nested(3))).alias("html"), F.array().cast("array<string>").alias("image_sources"))
    rows = sp.split(snaps).collect()
    assert [r.source for r in sorted(rows, key=lambda r: r.ord)] == ["quoted", "quoted", "direct"]
    assert len({r.ord for r in rows}) == 3
