import json

import pytest
from people import ANCHOR, direct, frame
from pyspark.sql import functions as F

from threadloom.functions import dates
from threadloom.operators import compare
from threadloom.plans import thread as plan
from threadloom.schema import MESSAGE
from threadloom.sources import extract, files
from threadloom.streaming import incremental as inc

PAGE = (
    '<div data-message-id="m1"><span class="gD" email="Ana@firma.example" name="Ana Ruiz"></span><span class="hb"><span email="bo@firma.example"></span></span><span class="g3" title="Apr 10, 2026, 9:00 AM">9:00</span>'
    '<div class="aZo" data-tooltip="plan.pdf"><span class="aV3">plan.pdf</span><span class="aV7">12 KB</span></div><div class="a3s">first words <img src="https://i.example/1.png"></div></div>'
    '<div data-message-id="m2"><span class="gD" email="bo@firma.example" name="Bo"></span><span class="g3" title="Apr 10, 2026, 10:00 AM"></span><div class="a3s">an answer'
    '<div class="gmail_quote"><div class="gmail_attr">On Fri, Apr 10, 2026 at 9:00 AM Ana Ruiz &lt;<a href="mailto:ana@firma.example">ana@firma.example</a>&gt; wrote:</div><blockquote class="gmail_quote">first words</blockquote></div></div></div>'
    '<div data-message-id="m3"><span class="gD" email="x@firma.example"></span></div>'
)


def test_containers():
    one, two = extract.read_containers(PAGE, "gmail", "bo@firma.example", ANCHOR, "t1")
    m = one["message"]
    assert (m["id"], m["sender"], m["recipients"]) == ("m1", {"name": "Ana Ruiz", "email": "ana@firma.example"}, ["bo@firma.example"])
    assert m["attachments"] == [{"name": "plan.pdf", "mime_type": "application/pdf", "size_label": "12 KB", "download_url": ""}]
    assert dates.to_ms(m["ts"]) == dates.instant("2026-04-10T09:00:00Z") and one["image_sources"] == ["https://i.example/1.png"]
    assert two["message"]["is_current_user"] and two["seq"] == 1
    other = '<div data-unique-id="u1"><span class="itemSender"><i title="Ana Ruiz &lt;ana@firma.example&gt;"></i></span><time datetime="2026-04-10T09:00:00Z"></time><div role="document">hello</div></div>'
    (only,) = extract.read_containers(other, "outlook", "", ANCHOR, "t2")
    assert only["message"]["sender"]["email"] == "ana@firma.example" and only["html"] == "hello"


def test_pages_to_threads(spark):
    pages = spark.createDataFrame([("t1", PAGE, "bo@firma.example", dates.from_ms(ANCHOR)), ("", PAGE, "", dates.from_ms(ANCHOR))], "thread_id string, html string, current_user string, anchor timestamp")
    threads = plan.from_pages(pages, "gmail")
    rows = threads.messages.orderBy("ord").collect()
    assert [(r.id, r.source) for r in rows] == [("m1", "direct"), ("m2", "direct")]
    assert [(p.email, p.message_count) for p in threads.participants.orderBy("place").collect()] == [("ana@firma.example", 1), ("bo@firma.example", 1)]
    assert threads.participation.count() == 0
    assert [r.id for r in threads.find("t1", needle="answer").collect()] == ["m2"]
    threads.views()
    assert spark.sql("SELECT count(*) FROM messages").first()[0] == 2


def snapshot_rows(spark, n=6):
    rows = [direct(f"m{i}", "", f"2026-04-10T0{i}:00:00Z", idx=i) for i in range(n)]
    base = frame(spark, rows)
    header = F.struct(*MESSAGE.fieldNames()).alias("message")
    html = F.concat(F.lit("<p>words of message "), F.col("ord"), F.lit("</p>"))
    return base.select("thread_id", F.lit("s1").alias("session"), F.col("ord").alias("seq"), F.lit("").alias("current_user"), header, html.alias("html"), F.array().cast("array<string>").alias("image_sources"))


def test_replay_and_fidelity(spark):
    snaps = snapshot_rows(spark)
    whole, parts = plan.replay(snaps, 0), plan.replay(snaps, 4)
    assert compare.differences(compare.shape(parts), compare.shape(whole)).count() == 0
    found = plan.fidelity(snaps, snaps.where("seq <> 2"))
    assert not found.same_structure and found.order_independent


def test_stream_equals_batch(spark, tmp_path):
    snaps = snapshot_rows(spark)
    for i in range(3):
        snaps.where(F.col("seq").between(2 * i, 2 * i + 1)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    snaps.where("seq = 0").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))  # unchanged
    inc.use_rocksdb(spark)
    sink = inc.LatestThreads(str(tmp_path / "out"))
    stream = inc.threads(inc.read_snapshots(spark, str(tmp_path / "in"), 1))
    q = stream.writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    last = sink.read(spark)
    assert last.select("version").first()[0] == 3
    got = [(r.id, r.body) for r in inc.messages_of(last).orderBy("ord").collect()]
    assert got == [(r.id, r.body) for r in plan.replay(snaps, 0).orderBy("ord").collect()] and len(got) == 6


def test_change_classes(spark):
    rows = spark.createDataFrame([(True, True, 0), (True, False, 0), (False, False, 2), (False, False, None)], "in_message boolean, in_body boolean, added int")
    assert [r.change for r in inc.classify(rows).collect()] == ["body", "header", "structure", "ignored"]


def test_capture_files(spark, tmp_path):
    capture = {"format": 1, "threadId": "t", "subject": "Plan", "currentUserEmail": "bo@firma.example", "messages": [
        {"position": 0, "snapshot": {"message": {"id": "m1", "sender": {"name": "Ana", "email": "ana@firma.example"}, "timestamp": "2026-04-10T09:00:00.000Z", "index": 0}, "html": "<p>hello</p>", "imageSources": []}},
        {"position": 1, "snapshot": None}]}
    (tmp_path / "c.json").write_text(json.dumps(capture, indent=1))
    read = files.read_captures(spark, str(tmp_path / "c.json"))
    plan.require_capture(read)
    snaps = files.capture_snapshots(read)
    assert [(r.id, r.body) for r in plan.replay(snaps).collect()] == [("m1", "hello")]
    with pytest.raises(ValueError):
        plan.require_capture(read.where("false"))
    cut = extract.capture_rows(spark.createDataFrame([("t", 0, "x" * 600_000), ("t", 1, "y")], "thread_id string, position int, html string"))
    assert [(len(r.container_html), r.container_truncated) for r in cut.orderBy("position").collect()] == [(512 * 1024, True), (1, False)]


def test_export(spark, tmp_path):
    rows = frame(spark, [direct("a", "one < two", attachments=[{"name": "f.pdf", "mime_type": "x", "size_label": "1 KB", "download_url": "https://secret.example"}])])
    docs = files.conversation_html(rows, spark.createDataFrame([("t", "Plan: A/B")], "thread_id string, subject string"))
    html = docs.first().html
    assert "one &lt; two" in html and "f.pdf — 1 KB" in html and "secret" not in html and files.POLICY in html
    files.export(docs, str(tmp_path / "out"), F.lit("2026-04-10").cast("date"))
    (folder,) = [p for p in (tmp_path / "out").iterdir() if p.is_dir()]
    assert folder.name.startswith("file=conversation-Plan") and folder.name.endswith("2026-04-10-no-images.html")
    (part,) = folder.glob("part-*")
    assert "one &lt; two" in part.read_text()


def test_attachment_store(spark, tmp_path):
    store = files.AttachmentStore(spark, str(tmp_path / "store"))
    put = lambda *r: store.put(spark.createDataFrame([(k, bytearray(v)) for k, v in r], "key string, content binary"))
    put(("a", b"one"), ("b", b"two"))
    put(("a", b"three"))
    assert {r.key: bytes(r.content) for r in store.rows().collect()} == {"a": b"three", "b": b"two"}
    store.remove("b")
    assert store.get("b").count() == 0 and store.get("a").count() == 1
    with pytest.raises(files.StoreFull):
        put(("c", b"x" * (files.MAX_FILE + 1)))
    assert store.rows().count() == 1


def test_pictures(spark):
    df = spark.createDataFrame([(bytearray(b"\x01\x02"), "image/png"), (bytearray(b"x"), "text/html")], "b binary, m string")
    urls = [r[0] for r in df.select(files.as_data_url(F.col("b"), F.col("m"))).collect()]
    assert urls == ["data:image/png;base64,AQI=", None]
    back = spark.createDataFrame([(urls[0],), ("https://x.example",)], "u string").select(files.from_data_url(F.col("u"))).collect()
    assert [r[0] if r[0] is None else bytes(r[0]) for r in back] == [b"\x01\x02", None]


def test_page_headers():
    page = '<title>Plan - Outlook</title><div role="button" aria-label="Account manager for Bo" title="Bo (Bo@firma.example)"></div><h2 class="hP">Plan A</h2>'
    assert extract.page_user(page, "outlook") == "bo@firma.example" and extract.page_subject(page, "outlook") == "Plan"
    assert extract.page_subject(page, "gmail") == "Plan A" and extract.page_user(page, "gmail") == "" and extract.page_subject("", "gmail") == "Email Thread"


def test_registered_provider(spark):
    own = extract.Provider("own", "[data-row]", ".text", "time[datetime]", lambda el, i: ("Ana", f"ana{i}@firma.example"), lambda el: [], ("data-row",))
    extract.register(own)
    pages = spark.createDataFrame([("t", '<div data-row="r1"><time datetime="2026-04-10T09:00:00Z"></time><p class="text">hello</p></div>', "", dates.from_ms(ANCHOR))], "thread_id string, html string, current_user string, anchor timestamp")
    (row,) = extract.snapshots(pages, "own").collect()
    assert (row.message.id, row.message.sender.email, row.html) == ("r1", "ana0@firma.example", "hello")


def test_masked_snapshots_read_alike(spark):
    snaps = snapshot_rows(spark).withColumn("html", F.concat(F.lit('<p>Ana Ruiz <a href="mailto:ana@firma.example">ana@firma.example</a> says '), F.col("html"), F.lit('</p><img src="data:image/png;base64,AAAA">')))
    masked, found = plan.verify_masking(snaps)
    assert "Ana" not in masked.agg(F.concat_ws(" ", F.collect_list("html"))).first()[0]
    report = found.report().first()
    assert report.same_structure and report.order_independent and report.differences == []
    worse = plan.fidelity(snaps, masked.where("seq <> 1")).report().first()
    assert not worse.same_structure and worse.differences and worse.differences[-1].startswith("message 6: only in original")


def test_folded_snapshots(spark):
    from threadloom.functions import markup

    snaps = snapshot_rows(spark, 1).withColumns({"html": F.lit('<img src="data:image/png;base64,AAAA">'), "image_sources": F.array(F.lit("data:image/png;base64,AAAA"), F.lit("cid:1"))})
    r = markup.fold_snapshot(snaps).first()
    assert r.image_sources[0] in r.html and "folded" in r.html and r.image_sources[1] == "cid:1"


def test_sessions_of_one_batch(spark, tmp_path):
    """Sessions are read one after another; late rows of one that was left are dropped; whole messages come out."""
    file = [{"name": "f.pdf", "mime_type": "x", "size_label": "1 KB", "download_url": "u"}]
    rows = frame(spark, [direct(f"m{i}", f"body number {i}", attachments=file) for i in range(4)])
    head = F.struct(*[F.col(n).alias(n) for n in rows.columns])
    snaps = rows.select("thread_id", F.col("ord").alias("seq"), F.lit("").alias("current_user"), head.alias("message"), F.concat(F.lit("<p>"), "body", F.lit("</p>")).alias("html"), F.array().cast("array<string>").alias("image_sources"))
    names = ["thread_id", "session", "seq", "current_user", "message", "html", "image_sources"]
    of = lambda s: snaps.withColumn("session", F.lit(s)).select(*names).coalesce(1)
    of("s1").unionByName(of("s2")).coalesce(1).write.parquet(str(tmp_path / "in"))
    inc.use_rocksdb(spark)
    sink = inc.LatestThreads(str(tmp_path / "out"))

    def run():
        stream = inc.threads(inc.read_snapshots(spark, str(tmp_path / "in"), 1))
        stream.writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
        last = sink.read(spark)
        return last.first(), inc.messages_of(last).collect()

    last, found = run()
    assert last.session == "s2" and len(found) == 4 and all(r.attachments[0].name == "f.pdf" for r in found)
    of("s1").where("seq = 0").write.mode("append").parquet(str(tmp_path / "in"))
    last, found = run()
    assert last.session == "s2" and len(found) == 4


def test_long_threads_and_wide_characters(spark):
    from threadloom.operators.split import split

    rows = frame(spark, [direct("a", "hello there")])
    head = F.struct(*[F.col(n).alias(n) for n in rows.columns])
    snaps = rows.select("thread_id", F.lit("s").alias("session"), F.lit(3_000_000).cast("long").alias("seq"), F.lit("").alias("current_user"), head.alias("message"), F.lit("<p>hello there</p>").alias("html"), F.array().cast("array<string>").alias("image_sources"))
    assert split(snaps).first().ord == 300_000_000_000
    from threadloom.functions import text as tx

    one = spark.createDataFrame([("a😀b", "c")], "x string, y string").select(tx.stable_id(F.col("x"), F.col("y")).alias("id")).first().id
    assert one == "msg-3zhu8c"


def test_shared_names_and_banners(spark, tmp_path):
    rows = frame(spark, [direct("a", "first"), direct("b", "second")])
    other = F.array(F.struct(F.lit("x < y").alias("body"), F.lit("<p onclick='z()'>rich</p>").alias("body_html")), F.struct(F.lit("x < y").alias("body"), F.lit(None).cast("string").alias("body_html")))
    rows = rows.withColumn("quoted_variants", F.when(F.col("id") == "b", other))
    thread = rows.first().thread_id
    boundary = spark.createDataFrame([(thread, "b", "available")], "thread_id string, message_id string, kind string")
    html = files.conversation_html(rows, spark.createDataFrame([(thread, "Plan")], "thread_id string, subject string"), participation=boundary).first().html
    assert html.index("first") < html.index("Your available mailbox history starts here") < html.index("second")
    assert "Quoted copy differs (2)" in html and "<p>rich</p>" in html and "x &lt; y" in html and "onclick" not in html
    docs = spark.createDataFrame([("t/1", "Same", "one"), ("t:1", "Same", "two"), ("t2", None, "three")], "thread_id string, subject string, html string")
    files.export(docs, str(tmp_path / "out"), F.lit("2026-04-10").cast("date"), images=True)
    names = [p.name for p in (tmp_path / "out").iterdir() if p.is_dir()]
    assert len(names) == 3 and sum("Same" in n for n in names) == 2
    files.export(docs.limit(0), str(tmp_path / "none"), F.lit("2026-04-10").cast("date"))


def test_many_captures(spark, tmp_path):
    one = [(str(i), [{"position": 0}]) for i in range(5)]
    files.write_captures(spark.createDataFrame(one, "threadId string, messages array<struct<position:int>>").coalesce(1), str(tmp_path / "c"))
    assert {r.threadId for r in files.read_captures(spark, str(tmp_path / "c")).collect()} == {str(i) for i in range(5)}


def test_payloads_have_no_breaks(spark):
    row = spark.createDataFrame([(bytearray(200), "image/png")], "c binary, m string").select(files.as_data_url(F.col("c"), F.col("m")).alias("u")).first()
    assert "\n" not in row.u and row.u.endswith("=")
