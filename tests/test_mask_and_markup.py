from people import LONG_BODY, direct, frame, quoted
from pyspark.sql import functions as F

from threadloom.functions import markup
from threadloom.functions import text as tx
from threadloom.operators import compare, mask, query


def thread():
    return [
        direct("a", "Hi Boris, call me on +44 7700 900123. Ana", name="Ana Ruiz", email="ana@northwind.example", recipients=["boris@northwind.example"], idx=0),
        direct("b", "Ana, order 123456789 of 2026-04-10 is with Northwind.", name="Boris Vale", email="boris@northwind.example", quoted_by=None, idx=1),
        quoted("c", "as Ana Ruiz said", email="unknown:ana ruiz", name="Ana Ruiz", quoted_by="b"),
    ]


def test_one_stand_in_for_each_person():
    a, b, c = mask.mask_rows(thread())
    assert a["sender"] == {"name": "Person 1", "email": "person1@company1.example"}
    assert b["sender"]["email"] == a["recipients"][0] == "person2@company1.example"
    assert c["sender"]["name"] == "Person 1" and c["sender"]["email"] == "unknown:person 1"
    assert a["body"] == "Hi Person 2, call me on [phone-1]. Person 1"
    assert b["body"] == "Person 1, order [number-2] of 2026-04-10 is with Company 1."
    assert [a["id"], b["id"], c["id"]] == ["masked-2", "masked-3", "masked-4"] and c["quoted_by"] == "masked-3"
    whole = repr((a, b, c)).lower()
    assert not any(w in whole for w in ("ana", "boris", "ruiz", "vale", "northwind", "7700"))


def test_masked_markup():
    own = '<p class="x" title="Ana">Dear Ana <a href="https://northwind.example/ana?t=1">link</a><img src="https://i.example/p.jpg?x=1"><img src="cid:AB"></p>'
    theirs = '<div class="k" data-hovercard-id="ana@northwind.example" data-message-id="m9" datetime="2026">Ana</div>'
    m = mask.Rewriter(mask.book([*mask.of_person("ana@northwind.example", "Ana Ruiz"), *mask.of_markup(own), *mask.of_markup(theirs, True)]))
    html = m.html(own)
    assert html == '<p class="x" title="Person 1">Dear Person 1 <a href="https://company1.example/Person 1?masked">link</a><img src="https://images.example/image-1.jpg"><img src="cid:masked-2@company.example"></p>'
    assert m.image("https://i.example/p.jpg?other") == "https://images.example/image-1.jpg"
    assert m.url("data:x") == "masked:image" and m.url("mailto:ana@northwind.example") == "mailto:person1@company1.example"
    provider = m.html(theirs, True)
    assert m.text("new@elsewhere.example") == "person@company.example" and m.image("https://new.example/1.gif") == "https://images.example/image-0.gif"
    assert "ana" not in provider and 'datetime="2026"' in provider and 'data-message-id="masked-1"' in provider


def test_masked_rows_keep_their_shape(spark):
    rows = frame(spark, thread())
    masked = mask.mask(rows).drop("thread_no").withColumn("thread_id", F.lit("t"))
    assert compare.differences(compare.shape(rows), compare.shape(masked)).count() == 0
    fewer = masked.where("id <> 'masked-3'")
    found = compare.differences(compare.shape(rows), compare.shape(fewer), ("original", "masked copy")).orderBy("pos").collect()
    assert found[-1].difference == "only in original" and found


def test_renumbering_and_books(spark):
    rows = frame(spark, thread())
    got = mask.renumber(rows, ["thread_id"], ["id", "quoted_by"], "ord").orderBy("ord").select("id", "quoted_by").collect()
    assert [tuple(r) for r in got] == [("masked-1", None), ("masked-2", None), ("masked-3", "masked-2")]
    docs = spark.createDataFrame([(1, "x b@y.example a@y.example"), (2, "A@y.example")], "n int, t string")
    assert [tuple(r) for r in mask.address_book(docs, "t", "n").orderBy("person").collect()] == [("b@y.example", 1), ("a@y.example", 2)]


def test_html_to_text():
    assert markup.to_text("<p>One&nbsp;two</p><ul><li>a</li><li>b</li></ul><table><tr><td>x</td><td>y</td></tr></table>") == "One two\n\n• a\n• b\nx\ty"
    assert markup.to_text('<div>a &lt;b@c.d&gt;</div><img alt="Logo">') == "a <b@c.d>\n[Image: Logo]"


def test_sanitise():
    html = '<div onclick="x()" style="color:red;position:fixed"><script>1</script><font>hi</font><a href="javascript:x">l</a><a href="https://a.example">m</a><blockquote></blockquote><img src="x.png"><img width=1 height=1 src="https://t.example"></div>'
    clean = markup.sanitize(html)
    assert "script" not in clean and "onclick" not in clean and "position" not in clean and "blockquote" not in clean
    assert 'style="color:red"' in clean and "[Image unavailable: Inline image]" in clean and 'href="https://a.example"' in clean
    assert markup.sanitize(clean) == clean
    assert markup.highlight("<table><tr><td>Alpha beta</td></tr></table>", "BETA") == "<table><tr><td>Alpha <mark>beta</mark></td></tr></table>"


def test_images():
    assert markup.strip_images('<p><img src="https://a.example/x%20y.png" alt="A face"></p>') == ('<p><span class="image-placeholder" data-image-name="x-y.png">x-y.png — A face</span></p>', 1)
    folded = markup.fold_images('<img src="data:image/png;base64,AAAA"><img srcset="data:x 1x">')
    assert "AAAA" not in folded and 'srcset=""' in folded and markup.fold_source("cid:x") == "cid:x"
    html, missing = markup.embed_images('<img src="https://a.example/1.png"><img src="https://a.example/2.png" alt="two">', {"https://a.example/1.png": "data:image/png;base64,AA"})
    assert missing == 1 and "base64,AA" in html and "not embedded: two" in html
    assert markup.put_sources('<img src="a"><img src="b" srcset="c">', ["x"]) == '<img src="x"><img src="b">'


def test_columns(spark):
    one = lambda c, *v: spark.createDataFrame([tuple(v)], ", ".join(f"c{i} string" for i in range(len(v)))).select(c(*[F.col(f"c{i}") for i in range(len(v))]).alias("x")).first().x
    assert tuple(one(tx.sender_of, "Ana Ruiz <Ana@Firma.example>")) == ("Ana Ruiz", "ana@firma.example")
    assert tuple(one(tx.sender_of, "Ana Ruiz")) == ("Ana Ruiz", "unknown:ana ruiz")
    assert one(tx.continues_recipients, " Cleo West <cleo@firma.example>;") and not one(tx.continues_recipients, "please write to cleo@firma.example now")
    assert one(tx.recipients_unfinished, "a@b.example,") and not one(tx.recipients_unfinished, "a@b.example")
    assert one(tx.core_text, "> Hello there\n\nKind regards,\nAna") == "hello there"
    assert one(tx.core_text, "[EXTERNAL] Hi. [Message clipped] View entire message") == "hi"
    assert one(tx.specific_name, "No Reply") == "" and one(tx.specific_name, "Ana Ruiz") == "anaruiz"
    assert one(tx.safe_image_source, "https://u:p@x.example/a") == "" and one(tx.safe_image_source, "blob:https://mail.google.com/1") != ""
    assert one(tx.title_subject, "Plan - Outlook") == "Plan" and one(tx.title_subject, "") == "Email Thread"
    assert one(tx.inline_image_name, "data:image/jpeg;base64,x", "3") == "image-3.jpg"
    assert one(tx.image_download_name, "https://a.example/z.png", "My: photo.gif", "image/jpeg") == "My- photo.jpg"
    assert one(tx.first_filled, "", "b") == "b"


def test_search(spark):
    rows = frame(spark, [direct("a", "Hello World"), direct("b", LONG_BODY, quoted_variants=[{"body": "hidden word", "body_html": None}])])
    ids = lambda n, e=None: [r.id for r in query.find(rows, e, n).collect()]
    assert ids("WORLD") == ["a"] and ids("hidden") == ["b"] and ids("  ") == ["a", "b"] and ids("ruiz") == ["a", "b"] and ids("hello ", "nobody") == []


def test_noise_in_both_forms(spark):
    from threadloom.operators import reconcile as rc

    texts = [
        "plain words only", "ⓘ note", "a️b", "see [image: logo] here", "[Image unavailable: x] y", "Image removed by sender. z", "[ CAUTION: outside ] hi", "External E-mail:\nhello", "> warning - check it\nwords",
        "This message originated from outside the firm.\n\nreal words", "This e-mail was sent from an external source\n\nreal", "Do not click links or open attachments unless sure.\n\nreal", "Hi\n-- \nAna", "Hi\n\nSent from my iPhone",
        "Best regards", "> > quoted\nreply", "cut ... [Message clipped] rest", "",
    ]
    rows = spark.createDataFrame(list(enumerate(texts)), "n int, t string").select("n", tx.core_text(F.col("t")).alias("c")).collect()
    assert {r.n: r.c for r in rows} == {i: rc.core(t) for i, t in enumerate(texts)}


def test_clipped_cores_is_its_sql(spark, tmp_path):
    import duckdb

    from threadloom import queries

    texts = [
        None, "", " \n", "...", " … .", ">", "Hello there.", "> hi\n> there", "a\u2007b", "hi\nWith", "hi there\nbest", "hi\nKind \n", "a\n many ", "hi\nthanks &",
    ]
    rows = [(2 * i + odd, t) for i, t in enumerate(texts) for odd in (0, 1)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = {tuple(r) for r in queries.QUERIES["clipped_cores"](spark, str(tmp_path)).collect()}
    assert got == set(con.execute(queries.SQL["clipped_cores"]).fetchall()) and len(got) == len(rows)


def test_sign_off_ends_at_blank_lines(spark):
    from threadloom.operators import reconcile as rc

    cores = {
        "hi\nWith\n\nKind regards,\nAna": "hi with", "hi\nthanks &\n \nRegards": "hi thanks &", "hi\nWith\nkind regards\nAna": "hi", "hi\n\nThanks &\nRegards\nAna": "hi", "hi\nMany\u2007thanks!\nAna": "hi",
        "\n\nKind regards,\nAna": "kind regards, ana",
    }
    rows = spark.createDataFrame([(t,) for t in cores], "t string").select("t", tx.core_text(F.col("t")).alias("c")).collect()
    assert {r.t: r.c for r in rows} == cores == {t: rc.core(t) for t in cores}


def test_long_runs_before_a_notice(spark):
    texts = ["hi" + "." * 9000 + " [Message clipped]", "hi" + " ." * 9000 + "\n[Message clipped] View entire message"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(tx.core_text(F.col("t")).alias("c"), tx.presentation(F.col("t")).alias("p")).collect()
    assert [tuple(r) for r in rows] == [("hi", "hi")] * 2
