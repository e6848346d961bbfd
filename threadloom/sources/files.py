"""Files in and out: captures, fixtures, exports, attachments, pictures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import markup
from ..functions import text as tx
from ..operators import aggregate

#: Largest stored file, and all stored files together, in bytes.
MAX_FILE, MAX_STORE = 20 * 1024 * 1024, 100 * 1024 * 1024
MAX_PICTURE = 8 * 1024 * 1024

_SENDER = T.StructType([T.StructField("name", T.StringType()), T.StructField("email", T.StringType())])
_FILE = T.StructType([T.StructField(c, T.StringType()) for c in ("name", "mimeType", "sizeLabel", "downloadUrl")])
_MESSAGE = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("sender", _SENDER),
        T.StructField("timestamp", T.StringType()),
        T.StructField("index", T.IntegerType()),
        T.StructField("source", T.StringType()),
        T.StructField("isCurrentUser", T.BooleanType()),
        T.StructField("timestampEstimated", T.BooleanType()),
        T.StructField("timestampZoneUnknown", T.BooleanType()),
        T.StructField("recipients", T.ArrayType(T.StringType())),
        T.StructField("attachments", T.ArrayType(_FILE)),
    ]
)
#: A capture file; unknown fields are left out, missing ones are null.
CAPTURE = T.StructType(
    [
        T.StructField("format", T.IntegerType()),
        T.StructField("appVersion", T.StringType()),
        T.StructField("masked", T.BooleanType()),
        T.StructField("capturedAt", T.StringType()),
        T.StructField("client", T.StringType()),
        T.StructField("threadId", T.StringType()),
        T.StructField("subject", T.StringType()),
        T.StructField("currentUserEmail", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("readerStats", T.MapType(T.StringType(), T.DoubleType())),
        T.StructField(
            "messages",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("position", T.IntegerType()),
                        T.StructField("live", T.BooleanType()),
                        T.StructField("bodyFound", T.BooleanType()),
                        T.StructField(
                            "snapshot",
                            T.StructType(
                                [T.StructField("message", _MESSAGE), T.StructField("html", T.StringType()), T.StructField("imageSources", T.ArrayType(T.StringType()))]
                            ),
                        ),
                        T.StructField("containerHtml", T.StringType()),
                        T.StructField("containerTruncated", T.BooleanType()),
                    ]
                )
            ),
        ),
        T.StructField("notes", T.ArrayType(T.StringType())),
    ]
)


def read_captures(spark: SparkSession, path: str) -> DataFrame:
    """Capture files, one row each."""
    return spark.read.schema(CAPTURE).json(path, multiLine=True)


def capture_snapshots(captures: DataFrame) -> DataFrame:
    """The usable snapshots of captures, as snapshot rows."""
    m = captures.select("threadId", "currentUserEmail", F.explode("messages").alias("m")).where("m.snapshot is not null")
    h = "m.snapshot.message."
    ts = F.to_timestamp(F.col(h + "timestamp"))
    files = F.transform(F.col(h + "attachments"), lambda a: F.struct(a["name"].alias("name"), a["mimeType"].alias("mime_type"), a["sizeLabel"].alias("size_label"), a["downloadUrl"].alias("download_url")))
    none = lambda kind: F.lit(None).cast(kind)
    message = F.struct(
        F.col("threadId").alias("thread_id"), F.col(h + "id").alias("id"), F.col("m.position").alias("ord"), F.col(h + "index").alias("idx"), F.col(h + "sender").alias("sender"),
        ts.alias("ts"), F.col(h + "timestamp").alias("ts_raw"), F.col(h + "timestampEstimated").alias("ts_estimated"), F.col(h + "timestampZoneUnknown").alias("zone_unknown"),
        F.coalesce(F.col(h + "source"), F.lit("direct")).alias("source"), F.lit("").alias("body"), none("string").alias("body_html"), F.col(h + "isCurrentUser").alias("is_current_user"),
        none("string").alias("quoted_by"), none("boolean").alias("ordered_by_quote"), none("boolean").alias("history_carrier"), F.col(h + "recipients").alias("recipients"),
        files.alias("attachments"), none("array<struct<body:string,body_html:string>>").alias("quoted_variants"),
    )
    return m.select(
        F.col("threadId").alias("thread_id"), none("string").alias("session"), F.col("m.position").alias("seq"), F.col("currentUserEmail").alias("current_user"),
        message.alias("message"), F.col("m.snapshot.html").alias("html"), F.col("m.snapshot.imageSources").alias("image_sources"),
    )


def write_captures(captures: DataFrame, path: str) -> None:
    """One file a capture, as ``read_captures`` reads them."""
    captures.write.option("maxRecordsPerFile", 1).json(path)


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """Whole files as (path, value)."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")


def read_files(spark: SparkSession, path: str, most: int = MAX_FILE) -> DataFrame:
    """Stored files within the size limit."""
    return spark.read.format("binaryFile").load(path).where(F.col("length") <= most)


def as_data_url(content: Column, mime: Column) -> Column:
    """Raster pictures within the limit as payloads, null for anything else."""
    payload = F.translate(F.base64(content), "\r\n", "")  # Spark may break lines
    return F.when(tx.raster_mime(mime) & (F.length(content) <= MAX_PICTURE), F.concat(F.lit("data:"), mime, F.lit(";base64,"), payload))


def from_data_url(source: Column) -> Column:
    """The bytes of a raster payload, null for anything else."""
    pattern = r"(?i)^data:image/(?:png|jpeg|gif|webp|avif);base64,([a-z0-9+/=\s]+)\z"
    body = F.regexp_replace(F.regexp_extract(source, pattern, 1), r"\s", "")
    return F.when(source.rlike(pattern), F.try_to_binary(body, F.lit("base64")))


# --- conversation export ------------------------------------------------------------------


def articles(messages: DataFrame, pos: str = "ord") -> DataFrame:
    """One rendered article a message: metadata escaped, bodies sanitised, attachments named without addresses."""
    esc = tx.escape_html
    clean = markup.text_udf(markup.sanitize)
    when = F.when(tx.yes(F.col("ts_estimated")) | F.col("ts").isNull(), F.lit("Time unavailable · approximate order")).otherwise(F.date_format("ts", "EEEE, d MMMM yyyy, HH:mm:ss 'UTC'"))
    body = F.when(F.coalesce("body_html", F.lit("")) != "", clean(F.col("body_html"))).otherwise(F.concat(F.lit('<div class="plain">'), esc(F.coalesce("body", F.lit(""))), F.lit("</div>")))
    files = F.transform("attachments", lambda a: F.concat(F.lit("<li>"), esc(a["name"]), F.when(a["size_label"] != "", F.concat(F.lit(" — "), esc(a["size_label"]))).otherwise(F.lit("")), F.lit("</li>")))
    listed = F.when(F.coalesce(F.size("attachments"), F.lit(0)) > 0, F.concat(F.lit("<aside><strong>Attachments</strong><ul>"), F.array_join(files, ""), F.lit("</ul></aside>"))).otherwise(F.lit(""))
    note = lambda flag, text: F.when(flag, F.lit(f" · {text}")).otherwise(F.lit(""))
    head = F.concat(
        F.lit("<header><strong>"), esc(F.col("sender.name")), F.lit("</strong> <span>"), tx.address_label(F.col("sender.email")), F.lit('</span><div class="meta">'), when,
        note(F.col("source") == "quoted", "Recovered from quoted history"), note(tx.yes(F.col("ordered_by_quote")), "Placed by the quoted reply chain"),
        note(tx.yes(F.col("is_current_user")), "You"), F.lit("</div></header>"),
    )
    extra = F.coalesce(F.size("quoted_variants"), F.lit(0))
    # all copies are sanitised as one text, as a function of Python cannot be called for each element
    each = F.transform("quoted_variants", lambda v: F.concat(F.lit("<div>"), F.when(F.coalesce(v["body_html"], F.lit("")) != "", v["body_html"]).otherwise(esc(F.coalesce(v["body"], F.lit("")))), F.lit("</div>")))
    copies = F.when(extra > 0, F.concat(F.lit("<details><summary>Quoted copy differs ("), extra.cast("string"), F.lit(")</summary>"), clean(F.array_join(each, "")), F.lit("</details>"))).otherwise(F.lit(""))
    article = F.concat(F.lit("<article>"), head, F.lit('<div class="email-body">'), body, F.lit("</div>"), copies, listed, F.lit("</article>"))
    return messages.select("thread_id", F.col(pos).alias("pos"), "id", article.alias("article"))


#: The exported document runs no script and loads nothing but pictures.
POLICY = "default-src 'none'; img-src data: https:; style-src 'unsafe-inline'; base-uri 'none'; form-action 'none'"


# What a reader is told where they come in, by kind.
BANNERS = {
    "authored": ("You were participating by this message", "This is your first authored message in the available history; you may have joined earlier."),
    "recipient": ("You joined here · first visible inclusion", "This is the first available header that explicitly includes your address. It does not prove when you originally joined."),
    "available": ("Your available mailbox history starts here", "Earlier messages were recovered from quoted history. Recipient information is insufficient to determine when you joined."),
}


def with_banners(parts: DataFrame, boundary: DataFrame) -> DataFrame:
    """The articles, one under the banner of the boundary (thread_id, message_id, kind) that names its message."""
    told = F.create_map(*[F.lit(x) for kind, (title, detail) in BANNERS.items() for x in (kind, f'<section class="participation"><strong>{title}</strong><p>{detail}</p></section>')])
    at = boundary.select("thread_id", F.col("message_id").alias("id"), told[F.col("kind")].alias("banner"))
    return parts.join(at, ["thread_id", "id"], "left").withColumn("article", F.concat(F.coalesce("banner", F.lit("")), "article")).drop("banner")


def conversation_html(messages: DataFrame, subjects: DataFrame, masked: bool = False, participation: DataFrame | None = None) -> DataFrame:
    """One document a thread: (thread_id, subject, html). ``messages`` are reconciled; ``subjects`` is (thread_id, subject), ``participation`` as ``aggregate.participation`` gives it."""
    told = articles(messages)
    told = told if participation is None else with_banners(told, participation)
    parts = told.groupBy("thread_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "article"))), lambda x: x["article"]), "\n").alias("articles"), F.count("*").alias("n"))
    people = aggregate.last_senders(messages).groupBy("thread_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("first_pos", "sender"))), lambda x: F.concat_ws(" ", tx.escape_html(x["sender"]["name"]), tx.address_label(x["sender"]["email"]))), " · ").alias("people"),
        F.count("*").alias("n_people"),
    )
    rows = parts.join(people, "thread_id").join(subjects, "thread_id", "left")
    title = tx.escape_html(F.coalesce("subject", F.lit("Email Thread")))
    mask_note = F.lit('<p class="masked-note">Identities are masked.</p>' if masked else "")
    html = F.concat(
        F.lit(f'<!doctype html>\n<html lang="en"><head><meta charset="utf-8"><meta http-equiv="Content-Security-Policy" content="{POLICY}"><title>'), title,
        F.lit('</title></head><body><main><section class="overview"><h1>'), title, F.lit("</h1><p>"), F.col("n").cast("string"), F.lit(" messages · "), F.col("n_people").cast("string"),
        F.lit(' participants</p><p class="participants">'), F.col("people"), F.lit("</p>"), mask_note, F.lit("</section>"), F.col("articles"), F.lit("</main></body></html>"),
    )
    return rows.select("thread_id", "subject", html.alias("html"))


def export(documents: DataFrame, path: str, day: Column, images: bool = False, masked: bool = False) -> None:
    """Documents written as text, one directory a file name; pictures are replaced by names unless kept.

    Threads of one subject and day would share a name: each of these has a digest of its ``thread_id`` before the subject.
    """
    if masked or not images:
        strip = markup.counted_udf(markup.strip_images)
        documents = documents.withColumn("html", strip(F.col("html"))["html"])
    subject, suffix = F.coalesce("subject", F.lit("")), "masked" if masked else "" if images else "no-images"
    own = F.concat(F.left(F.md5(F.col("thread_id").cast("binary")), F.lit(12)), F.lit(" "), subject)
    named = documents.select(tx.export_name(subject, day, suffix).alias("name"), tx.export_name(own, day, suffix).alias("own"), F.col("html").alias("value"))
    shared = named.groupBy("name").agg(F.count("*").alias("n")).where("n > 1").select("name", F.lit(True).alias("shared"))
    file = F.when(F.col("shared"), F.col("own")).otherwise(F.col("name"))
    named.join(shared, "name", "left").select(file.alias("file"), "value").write.partitionBy("file").text(path)


# --- attachment store ---------------------------------------------------------------------


class StoreFull(ValueError):
    """A file that does not fit; the store is unchanged."""


class AttachmentStore:
    """A keyed store in a folder, each version a whole Parquet table, so a failed write leaves the last one."""

    SCHEMA = "key string, content binary, size bigint, saved_at timestamp"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _versions(self) -> list[int]:
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in fs.listStatus(hadoop)] if fs.exists(hadoop) else []
        done = [int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit()]
        return sorted(v for v in done if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/v{v}/_SUCCESS")))

    def rows(self) -> DataFrame:
        found = self._versions()
        return self.spark.read.schema(self.SCHEMA).parquet(f"{self.path}/v{found[-1]}") if found else self.spark.createDataFrame([], self.SCHEMA)

    def _write(self, rows: DataFrame) -> None:
        found = self._versions()
        rows.write.mode("overwrite").parquet(f"{self.path}/v{found[-1] + 1 if found else 0}")

    def put(self, files: DataFrame) -> None:
        """Files (key, content) in place of those with the same keys, all or none within the limits."""
        new = files.select("key", "content", F.length("content").cast("long").alias("size"), F.current_timestamp().alias("saved_at"))
        old = self.rows().join(new.select("key"), "key", "left_anti")
        size = new.agg(F.max("size").alias("most"), F.coalesce(F.sum("size"), F.lit(0)).alias("sum")).first()
        held = old.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
        if (size["most"] or 0) > MAX_FILE:
            raise StoreFull("a file exceeds the limit")
        if held + size["sum"] > MAX_STORE:
            raise StoreFull("the store is full")
        self._write(old.unionByName(new))

    def get(self, key: str) -> DataFrame:
        return self.rows().where(F.col("key") == key)

    def remove(self, key: str) -> None:
        self._write(self.rows().where(F.col("key") != key))


def latest_sessions(updates: DataFrame) -> DataFrame:
    """The last version of each tab's thread; a null thread clears the tab."""
    last = updates.groupBy("tab").agg(F.max_by(F.struct("thread_id", "data"), "version").alias("s"), F.max("version").alias("version"))
    return last.where("s.data is not null").select("tab", "s.thread_id", "s.data", "version")
