"""Queries for single steps of the engine, on inputs whose answer SQL can state.

Each row of a table becomes a page, a body or a capture of a known shape, numbered by its key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .functions import dates, markup
from .functions import text as tx
from .functions.storage import folder
from .operators import compare, mask, query, reconcile
from .operators import split as sp
from .plans import thread as plan
from .queries import _query, _t, messages
from .schema import MESSAGE
from .sources import extract, files
from .streaming import incremental as inc

ANCHOR = "2026-04-11 00:00:00"


def filled(template: str, **values: Column) -> Column:
    """A template with columns in place of their names in braces."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), value.cast("string"))
    return out


def message(**given: Column) -> Column:
    """A message struct of the shared schema; fields that are not given are null."""
    return F.struct(*[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in MESSAGE.fields])


def sender(name: Column, email: Column) -> Column:
    return F.struct(name.alias("name"), email.alias("email"))


def containers(rows: DataFrame, key: str, html: Column) -> DataFrame:
    """Rows as snapshots of one container each, written by Dora, a day after what it quotes."""
    head = message(thread_id=F.col(key), id=F.lit("own"), ord=F.lit(0), idx=F.lit(0), source=F.lit("direct"), sender=sender(F.lit("Dora"), F.lit("dora@x.example")), ts=F.lit(ANCHOR).cast("timestamp"))
    none = F.array().cast("array<string>")
    return rows.select(F.col(key).cast("string").alias("thread_id"), F.lit("s").alias("session"), F.lit(0).cast("long").alias("seq"), F.lit("user@example.net").alias("current_user"), head.alias("message"), html.alias("html"), none.alias("image_sources"))


# --- sources ------------------------------------------------------------------------------


@_query("""
SELECT c_custkey::VARCHAR AS thread_id, 'm' || c_custkey AS id, c_name AS name, 'c' || c_custkey || '@x.example' AS email, 'to' || c_custkey || '@x.example' AS recipients,
       'f' || c_custkey || '.pdf' AS file, 'application/pdf' AS mime, (c_custkey % 90) || ' KB' AS size_label, epoch_ms(make_timestamp(2026, 4, (c_custkey % 28 + 1)::BIGINT, 9, 0, 0)) AS ms, false AS estimated,
       'https://i.example/' || c_custkey || '.png' AS pictures FROM customer""")
def container_scan(spark, d):
    """One container with all its parts and one without a body, which is left out."""
    page = filled(
        '<div data-message-id="m{k}"><span class="gD" email="C{k}@X.example" name="{name}"></span><span class="hb"><span email="to{k}@x.example"></span></span><span class="g3" title="Apr {day}, 2026, 9:00 AM">9:00</span>'
        '<div class="aZo" data-tooltip="f{k}.pdf"><span class="aV3">f{k}.pdf</span><span class="aV7">{size} KB</span></div><div class="a3s">words <img src="https://i.example/{k}.png"><span email="no@x.example"></span></div></div>'
        '<div data-message-id="n"><span class="gD" email="x@x.example"></span></div>',
        k=F.col("c_custkey"), name=F.col("c_name"), day=F.col("c_custkey") % 28 + 1, size=F.col("c_custkey") % 90,
    )
    pages = _t(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("thread_id"), page.alias("html"), F.lit("").alias("current_user"), F.lit(ANCHOR).cast("timestamp").alias("anchor"))
    m, file = "message.", F.get("message.attachments", F.lit(0))
    return extract.snapshots(pages, "gmail").select(
        "thread_id", F.col(m + "id"), F.col(m + "sender.name"), F.col(m + "sender.email"), F.array_join(m + "recipients", ",").alias("recipients"), file["name"].alias("file"), file["mime_type"].alias("mime"),
        file["size_label"].alias("size_label"), F.unix_millis(m + "ts").alias("ms"), F.col(m + "ts_estimated").alias("estimated"), F.array_join("image_sources", ",").alias("pictures"),
    )


@_query("""
SELECT s_suppkey::VARCHAR AS thread_id, CASE s_suppkey % 3 WHEN 0 THEN 'Ana ' || s_suppkey WHEN 1 THEN 's' || s_suppkey ELSE 'Unknown Sender' END AS name,
       CASE s_suppkey % 3 WHEN 2 THEN 'unknown-0@outlook' ELSE 's' || s_suppkey || '@x.example' END AS email, 'f.zip' AS file, 'application/zip' AS mime,
       epoch_ms(TIMESTAMP '2026-04-10 07:30:00') AS ms, s_suppkey % 2 = 0 AND s_suppkey % 3 <> 2 AS mine FROM supplier""")
def container_scan_b(spark, d):
    """The other provider, with a sender's title, an address attribute, or neither; linked files; a clock with a zone."""
    k = F.col("s_suppkey")
    who = F.when(k % 3 == 0, filled('<div class="TopSender"><span title="Ana {k} &lt;S{k}@x.example&gt;"></span></div>', k=k)).when(k % 3 == 1, filled('<span data-pe-id="s{k}@x.example"></span>', k=k)).otherwise(F.lit(""))
    page = F.concat(filled('<div data-unique-id="u{k}">', k=k), who, F.lit('<time datetime="2026-04-10T09:30:00+02:00"></time><div role="document">words</div><a download="f.zip" href="u">get</a></div>'))
    user = F.when(k % 2 == 0, filled("s{k}@X.example", k=k)).otherwise(F.lit("me@x.example"))
    pages = _t(spark, d, "supplier").select(k.cast("string").alias("thread_id"), page.alias("html"), user.alias("current_user"), F.lit(ANCHOR).cast("timestamp").alias("anchor"))
    file = F.get("message.attachments", F.lit(0))
    return extract.snapshots(pages, "outlook").select("thread_id", "message.sender.name", "message.sender.email", file["name"].alias("file"), file["mime_type"].alias("mime"), F.unix_millis("message.ts").alias("ms"), F.col("message.is_current_user").alias("mine"))


@_query("SELECT page_id, 'me' || page_id || '@x.example' AS account, CASE WHEN page_id % 2 = 0 THEN 'About ' || page_id ELSE 'Email Thread' END AS subject FROM pages")
def page_identity(spark, d):
    """Whose page it is, and what it is about."""
    k = F.col("page_id")
    page = F.concat(filled('<div data-ogsr-up><a data-email="Me{k}@x.example"></a></div>', k=k), F.when(k % 2 == 0, filled('<h2 class="hP"> About {k}</h2>', k=k)).otherwise(F.lit('<h2 class="hP"></h2>')))
    user, subject = (markup.text_udf(lambda t, f=f: f(t, "gmail")) for f in (extract.page_user, extract.page_subject))
    return _t(spark, d, "pages").select("page_id", user(page).alias("account"), subject(page).alias("subject"))


@_query("""
SELECT n_nationkey::VARCHAR AS thread_id, p::INT AS position, CASE WHEN p = 0 THEN 524288 ELSE 9 END AS kept, p = 0 AS truncated
FROM nation, (SELECT unnest([0, 1, 2]) AS p)""")
def captured_containers(spark, d):
    """Containers cut to the limit; the first of each thread is too long."""
    rows = _t(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("thread_id"), F.explode(F.array(*[F.lit(i) for i in range(3)])).alias("position"))
    html = F.when(F.col("position") == 0, F.repeat(F.lit("0123456789"), F.lit(60_000))).otherwise(F.lit("container"))
    return extract.capture_rows(rows.withColumn("html", html)).select("thread_id", "position", F.length("container_html").alias("kept"), F.col("container_truncated").alias("truncated"))


@_query("""
SELECT conv_id::VARCHAR AS thread_id, turn::BIGINT AS ord, conv_id || '-' || turn AS id, role AS name, role || '@example.net' AS email, md5(text) AS html, epoch_ms(TIMESTAMP '2026-04-10 09:00:00') AS ms, 'a.png' AS pictures
FROM conversations WHERE turn % 2 = 0""")
def capture_files(spark, d):
    """Conversations written as capture files and read back; odd turns were not captured."""
    who = F.struct(F.col("role").alias("name"), F.concat("role", F.lit("@example.net")).alias("email"))
    given = F.struct(F.concat_ws("-", "conv_id", "turn").alias("id"), who.alias("sender"), F.lit("2026-04-10T09:00:00.000Z").alias("timestamp"), F.col("turn").cast("int").alias("index"))
    snap = F.when(F.col("turn") % 2 == 0, F.struct(given.alias("message"), F.col("text").alias("html"), F.array(F.lit("a.png")).alias("imageSources")))
    entry = F.struct(F.col("turn").cast("int").alias("position"), snap.alias("snapshot"))
    captures = _t(spark, d, "conversations").groupBy(F.col("conv_id").cast("string").alias("threadId")).agg(F.lit(1).alias("format"), F.lit("me@x.example").alias("currentUserEmail"), F.sort_array(F.collect_list(entry)).alias("messages"))
    path = folder(spark)
    files.write_captures(captures, path)
    back = files.capture_snapshots(plan.require_capture(files.read_captures(spark, path)))
    return back.select("thread_id", F.col("seq").cast("long").alias("ord"), "message.id", "message.sender.name", "message.sender.email", F.md5(F.col("html").cast("binary")).alias("html"), F.unix_millis("message.ts").alias("ms"), F.array_join("image_sources", ",").alias("pictures"))


@_query("""
SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'data:image/png;base64,' || to_base64(repeat(s_name, 9)::BLOB) END AS source, CASE WHEN s_suppkey % 2 = 0 THEN repeat(s_name, 9) END AS content FROM supplier""")
def picture_payloads(spark, d):
    """Raster pictures as payloads and back; other kinds are refused."""
    source = files.as_data_url(F.repeat("s_name", F.lit(9)).cast("binary"), F.when(F.col("s_suppkey") % 2 == 0, F.lit("image/png")).otherwise(F.lit("image/svg+xml")))
    return _t(spark, d, "supplier").select("s_suppkey", source.alias("source")).select("s_suppkey", "source", files.from_data_url(F.col("source")).cast("string").alias("content"))


@_query("SELECT 'k' || n_nationkey AS key, CASE WHEN n_nationkey % 2 = 0 THEN upper(n_name) || '!' ELSE n_name END AS content FROM nation WHERE n_nationkey <> 3")
def stored_files(spark, d):
    """Files put, half of them put again, one removed."""
    store = files.AttachmentStore(spark, folder(spark))
    rows = _t(spark, d, "nation").select("n_nationkey", F.concat(F.lit("k"), F.col("n_nationkey")).alias("key"), F.col("n_name").alias("content"))
    binary = F.col("content").cast("binary")
    store.put(rows.select("key", binary.alias("content")))
    store.put(rows.where("n_nationkey % 2 = 0").withColumn("content", F.concat(F.upper("content"), F.lit("!"))).select("key", binary.alias("content")))
    store.remove("k3")
    return store.rows().select("key", F.col("content").cast("string").alias("content"))


@_query("""
SELECT 'conversation-' || CASE WHEN n_nationkey < 2 THEN left(md5(n_nationkey::VARCHAR), 12) || ' Same' ELSE n_name END || '-2026-04-10-no-images.html' AS file, '<p>image-1.png</p>' || n_nationkey AS html FROM nation""")
def exported_files(spark, d):
    """Documents in files of their names, pictures by name; two threads share a subject and a day and stay apart."""
    k = F.col("n_nationkey")
    doc = F.concat(F.lit('<p><img src="cid:1"></p>'), k.cast("string"))
    docs = _t(spark, d, "nation").select(k.cast("string").alias("thread_id"), F.when(k < 2, F.lit("Same")).otherwise(F.col("n_name")).alias("subject"), doc.alias("html"))
    path = folder(spark)
    files.export(docs, path, F.lit("2026-04-10").cast("date"))
    back = spark.read.schema("value string, file string").text(path, wholetext=True)
    return back.select("file", F.regexp_replace("value", r"<span[^>]*>|</span>|\n\z", "").alias("html"))


# --- splitting ----------------------------------------------------------------------------


@_query("""
SELECT s_suppkey::VARCHAR AS thread_id, source, body, email, recipients, clock FROM supplier, LATERAL (
  SELECT 'quoted' AS source, 'The plan of ' || s_suppkey AS body, 'ana' || s_suppkey || '@x.example' AS email, 'bo@x.example,cleo@x.example,dan@x.example' AS recipients, '2026-04-10 09:12' AS clock
  UNION ALL SELECT 'quoted', 'Could you send it?', 'bo@x.example', 'ana@x.example', '2026-04-09 16:00'
  UNION ALL SELECT 'direct', 'See below.', 'dora@x.example', '', '2026-04-11 00:00')""")
def field_blocks(spark, d):
    """Two blocks of fields, recipients over two lines, a disclaimer cut off."""
    body = filled(
        "See below.\n\nFrom: Ana Ruiz <ana{k}@x.example>\nSent: Friday, April 10, 2026 9:12 AM\nTo: Bo <bo@x.example>; Cleo West\n <cleo@x.example>; dan@x.example\nSubject: Plan\n\nThe plan of {k}\n\n"
        "This e-mail and any attachments are confidential.\n\nFrom: Bo <bo@x.example>\nSent: Thursday, April 9, 2026 4:00 PM\nTo: ana@x.example\nSubject: Plan\n\nCould you send it?\n",
        k=F.col("s_suppkey"),
    )
    rows = sp.split(containers(_t(spark, d, "supplier"), "s_suppkey", sp.plain_to_html(body)))
    return rows.select("thread_id", "source", "body", F.col("sender.email").alias("email"), F.coalesce(F.array_join("recipients", ","), F.lit("")).alias("recipients"), F.date_format("ts", "yyyy-MM-dd HH:mm").alias("clock"))


@_query("""
SELECT c_custkey::VARCHAR AS thread_id, 'old words of ' || c_custkey AS body, 'Ana Ruiz' AS name, 'ana' || c_custkey || '@x.example' AS email,
  'msg-' || lower(to_base(abs(list_reduce(list_prepend(0::BIGINT, list_transform(string_split(c_custkey || ':ana' || c_custkey || '@x.example:Fri, Apr 10, 2026 at 9:12 AM:old words of ' || c_custkey || ':-chain', ''), lambda x: unicode(x)::BIGINT)),
  lambda h, c: ((((h * 31 + c + 2147483648) % 4294967296) + 4294967296) % 4294967296) - 2147483648)), 36)) AS id FROM customer""")
def wrapped_attribution(spark, d):
    """An attribution over two lines of plain text; ids are digests of what a message holds."""
    body = filled("Hi\nOn Fri, Apr 10, 2026 at 9:12 AM Ana Ruiz\n<ana{k}@x.example> wrote:\nold words of {k}", k=F.col("c_custkey"))
    rows = sp.split(containers(_t(spark, d, "customer"), "c_custkey", sp.plain_to_html(body)))
    return rows.where("source = 'quoted'").select("thread_id", "body", "sender.name", "sender.email", "id")


@_query("""
SELECT s_suppkey::VARCHAR AS thread_id, words, by_ AS quoted_by FROM supplier, LATERAL (
  SELECT 'ana begins ana ends' AS words, 'own' AS by_ UNION ALL SELECT 'dan ' || s_suppkey, 'ana begins ana ends')""")
def nested_quoters(spark, d):
    """Text after a nested quote stays with its author; an empty quote between is passed over."""
    quote = '<div class="gmail_attr">On {date} {who} &lt;<a href="mailto:{mail}">{mail}</a>&gt; wrote:</div><blockquote class="gmail_quote">'

    def head(date: str, who: str) -> str:
        return quote.replace("{date}", date).replace("{who}", who).replace("{mail}", f"{who.lower()}@x.example")

    html = filled(
        '<div>top</div><div class="gmail_quote">' + head("Mon, Apr 6, 2026 at 2:57 PM", "Ana") + "ana begins" + head("Mon, Apr 6, 2026 at 1:57 PM", "Eve") + head("Sun, Apr 5, 2026 at 1:00 PM", "Dan") + "dan {k}</blockquote></blockquote>ana ends</blockquote></div>",
        k=F.col("s_suppkey"),
    )
    rows = sp.split(containers(_t(spark, d, "supplier"), "s_suppkey", html))
    words = F.trim(F.regexp_replace("body", r"\s+", " "))
    quoted = rows.where("source = 'quoted'").select("thread_id", "id", words.alias("words"), "quoted_by")
    by = quoted.select("thread_id", F.col("id").alias("quoted_by"), F.col("words").alias("by_words"))
    return quoted.join(by, ["thread_id", "quoted_by"], "left").select("thread_id", "words", F.coalesce("by_words", "quoted_by").alias("quoted_by"))


@_query("SELECT page_id, 'mine ' || page_id AS body, 'theirs' AS quoted FROM pages")
def legacy_strip(spark, d):
    """The older form, one body without its quotes."""
    html = filled("<div>mine {k}</div><blockquote>theirs</blockquote>", k=F.col("page_id"))
    parts = [markup.text_udf(lambda t, i=i: sp.strip_quoted(t)[i]) for i in (0, 1)]
    return _t(spark, d, "pages").select("page_id", parts[0](html).alias("body"), parts[1](html).alias("quoted"))


# --- dates and markup ---------------------------------------------------------------------


@_query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 2 THEN epoch_ms(TIMESTAMP '2026-01-02') WHEN o_orderkey % 3 = 1 THEN epoch_ms(TIMESTAMP '2025-12-31') ELSE epoch_ms(o_orderdate::TIMESTAMP + INTERVAL 1272 MINUTE) END AS ms, o_orderkey % 3 <> 0 AS estimated FROM orders""")
def mail_dates(spark, d):
    """a whole date, one without a year that lies ahead, and none."""
    raw = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.date_format("o_orderdate", "EEEE, MMMM d, yyyy"), F.lit(" at 9:12 PM"))).when(F.col("o_orderkey") % 3 == 1, F.lit("Dec 31")).otherwise(F.lit("no date"))
    at = dates.to_ms(dates.from_ms(1_767_312_000_000))
    read = markup.counted_udf(lambda t: (str(dates.mail_date(t, at)[0]), int(dates.mail_date(t, at)[1])))
    return _t(spark, d, "orders").select("o_orderkey", read(raw).alias("r")).select("o_orderkey", F.col("r.html").cast("long").alias("ms"), (F.col("r.n") == 1).alias("estimated"))


@_query("SELECT page_id, 'Page ' || page_id || chr(10) || chr(10) || '• one' || chr(10) || '• two & three' || chr(10) || '[Image: a map]' AS body, 'Page ' || page_id || 'onetwo & three' AS bare FROM pages")
def readable_markup(spark, d):
    """A paragraph, a list, an entity and a picture, as text and without tags."""
    html = filled('<p>Page {k}</p><ul><li>one</li><li>two &amp; three</li></ul><img alt="a map">', k=F.col("page_id"))
    return _t(spark, d, "pages").select("page_id", markup.text_udf(markup.to_text)(html).alias("body"), markup.text_udf(markup.strip_tags)(html).alias("bare"))


@_query("""
SELECT page_id, '<p><mark>Plan</mark> ' || page_id || ' <a href="https://x.example/plan" target="_blank" rel="noopener noreferrer">a <mark>plan</mark></a></p>' AS html FROM pages""")
def marked_markup(spark, d):
    """H2, H5: sanitised, and matches marked in text but not in addresses."""
    html = filled('<p onclick="x()">Plan {k} <a href="https://x.example/plan">a plan</a><script>plan()</script></p>', k=F.col("page_id"))
    return _t(spark, d, "pages").select("page_id", markup.text_udf(lambda t: markup.highlight(t, "plan"))(html).alias("html"))


@_query("""
SELECT page_id, '<p><img src="https://i.example/' || page_id || '.png"><img src="b.png"></p>' AS html, 'https://i.example/' || page_id || '.png,b.png' AS pictures FROM pages""")
def put_pictures(spark, d):
    """Live addresses put back by place; an empty one changes nothing, source sets go."""
    html = filled('<p><img src="x{k}.png"><img src="b.png" srcset="c.png 2x"></p>|https://i.example/{k}.png', k=F.col("page_id"))
    put = markup.text_udf(lambda t: markup.put_sources(t.split("|")[0], [t.split("|")[1], ""]))
    rows = _t(spark, d, "pages").select("page_id", put(html).alias("html"))
    return rows.select("page_id", "html", F.array_join(markup.list_udf(markup.image_sources)(F.col("html")), ",").alias("pictures"))


@_query("SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 0 ELSE 1 END AS missing, page_id % 2 = 0 AS embedded FROM pages")
def embedded_pictures(spark, d):
    """H6: a picture replaced by its payload where there is one."""
    html = filled('<img src="https://i.example/{k}.png" alt="map">', k=F.col("page_id") % 2)
    embed = markup.counted_udf(lambda t: markup.embed_images(t, {"https://i.example/0.png": "data:image/png;base64,AA=="}))
    rows = _t(spark, d, "pages").select("page_id", embed(html).alias("r"))
    return rows.select("page_id", F.col("r.n").alias("missing"), F.contains("r.html", F.lit("base64,AA==")).alias("embedded"))


@_query("""
SELECT conv_id::VARCHAR AS thread_id, n FROM (SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1) WHERE n >= 3""")
def ready_threads(spark, d):
    """Threads with messages; those of fewer than three turns count as unread."""
    rows = messages(spark, d).groupBy("thread_id").agg(F.count("*").alias("n"), F.collect_list("id").alias("all"))
    return query.ready(rows.withColumn("messages", F.when(F.col("n") >= 3, F.col("all")))).select("thread_id", "n")


# --- merging ------------------------------------------------------------------------------


def copies(rows: DataFrame, key: str, *made: dict) -> DataFrame:
    """Message rows of one thread a key, from dicts of columns."""
    parts = [message(thread_id=F.col(key), ord=F.lit(i), idx=F.lit(i), **m) for i, m in enumerate(made)]
    return rows.select(F.explode(F.array(*parts)).alias("m")).select("m.*")


def _at(clock: str) -> Column:
    return F.lit(f"2026-04-10 {clock}").cast("timestamp")


@_query("""
SELECT c_custkey::VARCHAR AS thread_id, 1::BIGINT AS n, 'ana' || c_custkey || '@x.example' AS email, 'd' AS id FROM customer""")
def name_only_copy(spark, d):
    """A quoted copy that knows its author by name only is the direct message."""
    body = filled("the budget of customer {k} was agreed by all of us on Friday", k=F.col("c_custkey"))
    mail = filled("ana{k}@x.example", k=F.col("c_custkey"))
    rows = copies(
        _t(spark, d, "customer"), "c_custkey",
        {"id": F.lit("d"), "source": F.lit("direct"), "sender": sender(F.lit("Ana Ruiz"), mail), "ts": _at("09:00:00"), "body": body},
        {"id": F.lit("q"), "source": F.lit("quoted"), "sender": sender(F.lit("Ana Ruiz"), F.lit("unknown:ana ruiz")), "ts": _at("09:00:20"), "body": body},
    )
    return reconcile.reconcile(rows).groupBy("thread_id").agg(F.count("*").alias("n"), F.max("sender.email").alias("email"), F.max("id").alias("id"))


@_query("""
SELECT s_suppkey::VARCHAR AS thread_id, CASE s_suppkey % 3 WHEN 0 THEN 1 ELSE 2 END::BIGINT AS n FROM supplier""")
def short_repeats(spark, d):
    """A short text again: the same minute, two hours later, from another author."""
    k = F.col("s_suppkey") % 3
    later = F.when(k == 1, _at("11:00:10")).otherwise(_at("09:00:10"))
    who = F.when(k == 2, F.lit("bo@x.example")).otherwise(F.lit("ana@x.example"))
    rows = copies(
        _t(spark, d, "supplier"), "s_suppkey",
        {"id": F.lit("d"), "source": F.lit("direct"), "sender": sender(F.lit("A"), F.lit("ana@x.example")), "ts": _at("09:00:00"), "body": F.lit("Thanks!")},
        {"id": F.lit("q"), "source": F.lit("quoted"), "sender": sender(F.lit("A"), who), "ts": later, "body": F.lit("Thanks!")},
    )
    return reconcile.reconcile(rows).groupBy("thread_id").agg(F.count("*").alias("n"))


@_query("SELECT s_suppkey::VARCHAR AS thread_id, 1::BIGINT AS n, CASE WHEN s_suppkey % 2 = 0 THEN 1 END AS variants FROM supplier")
def kept_variants(spark, d):
    """One message, and a copy that reads differently is kept beside it."""
    text = "the delivery to the north office was moved to Monday because the road is closed, so please tell the drivers and the people at the gate before the end of this week, and ask them for the new times of arrival"
    other = F.when(F.col("s_suppkey") % 2 == 0, F.lit(text.replace("the drivers", "all the drivers"))).otherwise(F.lit(text))
    who = sender(F.lit("Ana"), F.lit("ana@x.example"))
    rows = copies(
        _t(spark, d, "supplier"), "s_suppkey",
        {"id": F.lit("d"), "source": F.lit("direct"), "sender": who, "ts": _at("09:00:00"), "body": F.lit(text)},
        {"id": F.lit("q"), "source": F.lit("quoted"), "sender": who, "ts": _at("09:00:20"), "body": other},
    )
    return reconcile.reconcile(rows).groupBy("thread_id").agg(F.count("*").alias("n"), F.max(F.when(F.size("quoted_variants") > 0, F.size("quoted_variants"))).alias("variants"))


# --- replay and streams -------------------------------------------------------------------


def turns(spark, d) -> DataFrame:
    """Every turn of a conversation as a container of its own."""
    m = messages(spark, d)
    header = F.struct(*[F.col(n) for n in MESSAGE.fieldNames()])
    return m.select("thread_id", F.lit("s").alias("session"), F.col("ord").alias("seq"), F.lit("user@example.net").alias("current_user"), header.alias("message"), sp.plain_to_html(F.col("body")).alias("html"), F.array().cast("array<string>").alias("image_sources"))


@_query("SELECT conv_id::VARCHAR AS thread_id, count(*) AS messages, count(DISTINCT role) AS people FROM conversations WHERE trim(text) <> '' GROUP BY 1")
def replayed_threads(spark, d):
    """Threads as they end up when containers come four at a time."""
    return plan.replay(turns(spark, d)).groupBy("thread_id").agg(F.count("*").alias("messages"), F.countDistinct("sender.email").alias("people"))


@_query("SELECT conv_id::VARCHAR AS thread_id, count(*) - 1 AS pos, 'only in original' AS difference FROM conversations WHERE trim(text) <> '' GROUP BY 1")
def lost_messages(spark, d):
    """Threads read four containers at a time against copies, read whole, that lost their last message: nothing else differs."""
    rows = turns(spark, d)
    last = F.max("seq").over(Window.partitionBy("thread_id"))
    copy = rows.withColumn("last", last).where("seq < last").drop("last")
    return compare.differences(compare.shape(plan.replay(rows)), compare.shape(plan.replay(copy, 0)), ("original", "copy")).select("thread_id", F.col("pos").cast("long").alias("pos"), "difference")


@_query("""
SELECT event_id, CASE WHEN user_id % 2 = 0 AND event_id % 2 = 0 THEN 'body' WHEN user_id % 2 = 0 THEN 'header' WHEN event_id % 3 = 0 THEN 'structure' ELSE 'ignored' END AS change FROM events""")
def change_kinds(spark, d):
    """What a change to a page touches."""
    e = _t(spark, d, "events").select("event_id", (F.col("user_id") % 2 == 0).alias("in_message"), (F.col("event_id") % 2 == 0).alias("in_body"), F.when(F.col("event_id") % 3 == 0, 1).alias("added"))
    return inc.classify(e).select("event_id", "change")


@_query("SELECT conv_id::VARCHAR AS thread_id, count(*) AS rows, 1::BIGINT AS marks FROM conversations GROUP BY 1")
def container_marks(spark, d):
    """Containers that hold the same have one mark."""
    same = turns(spark, d).withColumns({"message": F.col("message").withField("id", F.lit("m")).withField("ord", F.lit(0)).withField("idx", F.lit(0)).withField("sender", F.lit(None)).withField("ts", F.lit(None)).withField("body", F.lit("")).withField("is_current_user", F.lit(None)), "html": F.lit("x")})
    return inc.fingerprint(same).groupBy("thread_id").agg(F.count("*").alias("rows"), F.countDistinct("mark").alias("marks"))


@_query("SELECT conv_id::VARCHAR AS thread_id, 's2' AS session, count(*) AS messages, count(DISTINCT role) AS people FROM conversations WHERE trim(text) <> '' GROUP BY 1")
def streamed_threads(spark, d):
    """Conversations as a stream of containers. A first session holds the first turn alone and is left for a second with all; every container comes twice, and the stream is stopped and taken up again between."""
    rows, path = turns(spark, d), folder(spark)
    second = rows.withColumns({"session": F.lit("s2"), "seq": F.col("seq") + 1_000})
    first = rows.where("seq = 0").withColumn("session", F.lit("s1"))
    inc.use_rocksdb(spark)
    sink = inc.LatestThreads(path + "/out")
    for part in (first, second, second):
        part.write.mode("append").parquet(path + "/in")
        stream = inc.threads(inc.read_snapshots(spark, path + "/in", 10_000))
        stream.writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", path + "/state").trigger(availableNow=True).start().awaitTermination()
    last = sink.read(spark)
    return inc.messages_of(last).join(last.select("thread_id", "session"), "thread_id").groupBy("thread_id", "session").agg(F.count("*").alias("messages"), F.countDistinct("sender.email").alias("people"))


@_query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'cid:a' ELSE 'https://x.example/a.png' END AS key FROM documents")
def one_picture_key(spark, d):
    """What names a picture, whatever its size."""
    source = F.when(F.col("doc_id") % 2 == 0, F.lit("CID:A")).otherwise(filled("https://x.example/a.png?w={k}", k=F.col("doc_id")))
    return _t(spark, d, "documents").select("doc_id", tx.image_identity(F.concat(F.lit('<img src="'), source, F.lit('">'))).alias("key"))


@_query("""SELECT page_id, '<p><span class="image-placeholder" data-image-name="map-' || page_id || '.png">map-' || page_id || '.png — the map</span></p>' AS html, 1 AS pictures FROM pages""")
def named_pictures(spark, d):
    """H7: pictures replaced by their names."""
    html = filled('<p><img src="https://i.example/map-{k}.png?w=1" alt="the  map"></p>', k=F.col("page_id"))
    return _t(spark, d, "pages").select("page_id", markup.counted_udf(markup.strip_images)(html).alias("r")).select("page_id", "r.html", F.col("r.n").alias("pictures"))


@_query("SELECT s_suppkey::VARCHAR AS thread_id, 'old words of ' || s_suppkey AS body FROM supplier")
def stranded_fields(spark, d):
    """Fields left behind below an attribution are no words of its author."""
    body = filled("Hi\nOn Fri, Apr 10, 2026 at 9:12 AM Ana Ruiz <ana@x.example> wrote:\nTo: bo@x.example\nSubject: Plan\n\nold words of {k}", k=F.col("s_suppkey"))
    return sp.split(containers(_t(spark, d, "supplier"), "s_suppkey", sp.plain_to_html(body))).where("source = 'quoted'").select("thread_id", "body")


@_query("""
SELECT s_suppkey::VARCHAR AS thread_id, id, ord::BIGINT AS ord, s_suppkey % 2 = 0 AS ordered_by_quote FROM supplier, LATERAL (
  SELECT 'old' AS id, 0 AS ord UNION ALL SELECT 'new', 1)""")
def reply_order(spark, d):
    """No message before one that it quotes; half of the quoted ones have a later clock, which both are told."""
    who = sender(F.lit("Ana"), F.lit("ana@x.example"))
    clock = F.when(F.col("s_suppkey") % 2 == 0, _at("09:30:00")).otherwise(_at("08:30:00"))
    rows = copies(
        _t(spark, d, "supplier"), "s_suppkey",
        {"id": F.lit("new"), "source": F.lit("direct"), "sender": who, "ts": _at("09:00:00"), "body": F.lit("an answer to all of that")},
        {"id": F.lit("old"), "source": F.lit("quoted"), "sender": who, "ts": clock, "body": F.lit("the question that came first"), "quoted_by": F.lit("new")},
    )
    return reconcile.reconcile(rows).select("thread_id", "id", "ord", F.coalesce("ordered_by_quote", F.lit(False)).alias("ordered_by_quote"))


@_query("SELECT s_suppkey::VARCHAR AS thread_id, CASE WHEN s_suppkey % 2 = 0 THEN 2 ELSE 3 END::BIGINT AS n FROM supplier")
def doubtful_copies(spark, d):
    """A quoted copy that fits two follow-ups joins the one of its own clock, or stays where neither is."""
    who = sender(F.lit("Ana"), F.lit("ana@x.example"))
    text = F.lit("please send me the signed form for the north office by the end of this week")
    quoted = F.when(F.col("s_suppkey") % 2 == 0, _at("15:00:10")).otherwise(_at("12:00:00"))
    rows = copies(
        _t(spark, d, "supplier"), "s_suppkey",
        {"id": F.lit("d1"), "source": F.lit("direct"), "sender": who, "ts": _at("09:00:00"), "body": text},
        {"id": F.lit("d2"), "source": F.lit("direct"), "sender": who, "ts": _at("15:00:00"), "body": text},
        {"id": F.lit("q"), "source": F.lit("quoted"), "sender": who, "ts": quoted, "zone_unknown": F.lit(True), "body": text},
    )
    return reconcile.reconcile(rows).groupBy("thread_id").agg(F.count("*").alias("n"))


@_query("SELECT event_id, event_type <> 'error' AND user_id % 3 <> 0 AS anchored FROM events")
def anchored_direct(spark, d):
    """F26."""
    source = F.when(F.col("user_id") % 3 == 0, F.lit("quoted")).when(F.col("user_id") % 3 == 1, F.lit("direct"))
    return _t(spark, d, "events").select("event_id", tx.anchored_direct(source, F.col("ts").cast("timestamp"), F.col("event_type") == "error", F.lit(None).cast("boolean")).alias("anchored"))


@_query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'map ' || p_partkey || '.jpg' WHEN 1 THEN 'part-' || p_partkey || '.webp' ELSE 'inline-image.webp' END AS name FROM part")
def download_names(spark, d):
    """F32: the label's name, the address's, or none, with the extension of what was fetched."""
    k = F.col("p_partkey") % 3
    source = F.when(k == 1, filled("https://i.example/part-{k}.png", k=F.col("p_partkey"))).otherwise(F.lit("cid:1"))
    alt = F.when(k == 0, filled(" map {k}.png ", k=F.col("p_partkey"))).otherwise(F.lit("Inline image"))
    return _t(spark, d, "part").select("p_partkey", tx.image_download_name(source, alt, F.when(k == 0, F.lit("image/jpeg")).otherwise(F.lit("image/webp"))).alias("name"))


@_query("SELECT page_id::VARCHAR AS thread_id, 'Person 1' AS name, 'person1@company1.example' AS email, 'Dear Person 2, write to person2@company2.example' AS body FROM pages")
def masked_containers(spark, d):
    """Containers masked, their markup by the people that the thread names."""
    k, rows = F.col("page_id"), _t(spark, d, "pages")
    ts = F.lit(ANCHOR).cast("timestamp")
    ana = message(thread_id=k, id=F.lit("a"), ord=F.lit(0), idx=F.lit(0), source=F.lit("direct"), sender=sender(F.lit("Ana Ruiz"), F.lit("ana@northwind.example")), ts=ts)
    eve = message(thread_id=k, id=F.lit("e"), ord=F.lit(1), idx=F.lit(1), source=F.lit("direct"), sender=sender(F.lit("Eve Stone"), F.lit("eve.stone@southgate.example")), ts=ts)
    one = containers(rows, "page_id", F.lit("Dear Eve Stone, write to eve.stone@southgate.example"))
    pairs = rows.select(k.cast("string").alias("thread_id"), F.posexplode(F.array(ana, eve)).alias("at", "who"))
    both = one.drop("message", "seq").join(pairs, "thread_id").withColumns({"message": F.col("who"), "seq": F.col("at").cast("long")})
    return mask.mask_snapshots(both).where("seq = 0").select("thread_id", "message.sender.name", "message.sender.email", F.col("html").alias("body"))
