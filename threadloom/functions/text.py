"""Text, identity and time as native column expressions.

Every function takes and returns Columns, stays in the JVM and is null-safe: null in, null
out, unless it says otherwise. White space includes the no-break space, as in mail.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
PALETTE = ("#4F86C6", "#E07B54", "#5BAD8F", "#9B6DC5", "#D4A843", "#C85C8E", "#4EAAA1", "#E05454")
MIME = {
    "pdf": "application/pdf",
    "doc": "application/msword",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "xls": "application/vnd.ms-excel",
    "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    "txt": "text/plain",
    "csv": "text/csv",
    "zip": "application/zip",
    "png": "image/png",
    "jpg": "image/jpeg",
    "jpeg": "image/jpeg",
    "gif": "image/gif",
}
PLACEHOLDER_NAMES = ("unknown", "sender", "unknownsender", "noreply", "noreplies", "mailer", "daemon", "automated", "support")
ADDRESS = r"[\w.!#$%&'*+/=?^`{|}~-]+@[\w.-]+\.[A-Za-z]{2,}"
S = r"[\s\u00a0\u2007\u202f\ufeff]"
#: A sign-off may be wrapped, but a blank line ends the words before it.
_GAP = rf"(?!{S}*\n{S}*\n)"
SIGN_OFF = (
    rf"(?im)\n{S}*(?:--{S}*$|(?:(?:many|kind(?:est)?|best|warm(?:est)?|with){_GAP}{S}+|thanks{S}*(?:&|and){_GAP}{S}*){{0,2}}"
    rf"(?:regards|thanks|wishes|thank you)[,!.]?{S}*$|sent from my (?:iphone|ipad|android))"
)
CLIPPED = r"(?i)\[message clipped\]|view entire message"
#: What a clipping notice leaves before it; looked for only where such a run begins.
_CUT_END = rf"(?<![{S}.…])[{S}.…]++\z"
DISCLAIMER = r"(?i)this e-?mail and any attachments|this message contains information that is confidential|agreements binding|e-?mail transmissions are not secure"
#: Marks that a provider adds to one copy of a message and not to another, each replaced by a space.
NOISE = (
    r"[ⓘℹ️⚠❯▶]",
    r"(?i)\[image(?: unavailable)?:[^\]\n]*\]",
    r"(?i)\bimage removed by sender\.?",
    r"(?i)\[\s*(?:external|extern|caution|suspicious)[^\]\n]{0,60}\]",
    r"(?i)\bexternal\s+e-?mail\b[\s:;>|.-]*",
    r"(?im)^[ \t>|]*(?:caution|warning)\b[^\n]{0,200}$",
    r"(?i)\bthis\s+(?:e-?mail|message)\s+(?:originated|was\s+sent|came)\s+from\s+(?:outside|an\s+external)[\s\S]{0,200}?(?:\n\s*\n|\z)",
    r"(?i)\bdo\s+not\s+click\s+(?:any\s+)?links\s+or\s+open\s+attachments[\s\S]{0,200}?(?:\n\s*\n|\z)",
)
#: What every one of the marks begins with or holds.
_ANY_NOISE = r"(?i)[ⓘℹ\ufe0f⚠❯▶\[]|image removed|external|caution|warning|this\s+(?:e-?mail|message)|do\s+not\s+click"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once; inside a lambda a plain expression would be computed again for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def js_trim(c: Column) -> Column:
    """Without white space at both ends, the no-break space counting as such."""
    return F.regexp_replace(c, rf"\A{S}+|{S}+\z", "")


def initials(name: Column) -> Column:
    """first letters of the space-separated parts, two at most, upper case; ``??`` if there are none."""
    parts = F.filter(F.split(name, " "), lambda x: x != "")
    letters = F.upper(F.array_join(F.transform(parts, lambda x: F.left(x, F.lit(1))), ""))
    return F.when(F.length(letters) > 0, F.left(letters, F.lit(2))).otherwise(F.lit("??"))


def utf16(text: Column) -> Column:
    """The UTF-16 units of a text as longs; characters beyond the basic plane are two."""
    points = F.transform(F.filter(F.split(text, ""), lambda x: x != ""), lambda x: F.ascii(x).cast("long"))
    high = lambda c: F.floor((c - 65536) / 1024) + 55296
    return F.flatten(F.transform(points, lambda c: F.when(c < 65536, F.array(c)).otherwise(F.array(high(c), (c - 65536) % 1024 + 56320))))


def palette_index(text: Column) -> Column:
    """position in the palette, a 31-hash kept below its size."""
    return F.aggregate(utf16(text), F.lit(0).cast("long"), lambda h, c: (h * 31 + c) % len(PALETTE)).cast("int")


def palette_colour(text: Column) -> Column:
    return F.get(F.array(*[F.lit(p) for p in PALETTE]), palette_index(text))


def build_sender(name: Column, email: Column) -> Column:
    """(name, email, initials, avatar_color) of a raw name and address."""
    local = F.substring_index(email, "@", 1)
    clean = F.when(js_trim(name) != "", js_trim(name)).otherwise(local)
    return F.struct(clean.alias("name"), js_trim(F.lower(email)).alias("email"), initials(clean).alias("initials"), palette_colour(F.lower(email)).alias("avatar_color"))


def mime_of(filename: Column) -> Column:
    """media type by extension."""
    ext = F.lower(F.element_at(F.split(filename, r"\."), -1))
    known = F.create_map(*[F.lit(x) for kv in MIME.items() for x in kv])
    return F.when(filename.isNull(), F.lit(None).cast("string")).otherwise(F.coalesce(F.try_element_at(known, ext), F.lit("application/octet-stream")))


def hash31(text: Column) -> Column:
    """A 31-hash wrapped to a signed 32-bit integer after each step, as a long."""
    return F.aggregate(utf16(text), F.lit(0).cast("long"), lambda h, c: F.pmod(h * 31 + c + F.lit(2147483648), F.lit(4294967296)) - F.lit(2147483648))


def stable_id(*parts: Column) -> Column:
    """``msg-`` and the base-36 magnitude of the 31-hash of the parts joined by ``-``."""
    return F.concat(F.lit("msg-"), F.lower(F.conv(F.abs(hash31(F.concat_ws("-", *parts))).cast("string"), 10, 36)))


def safe_link(url: Column) -> Column:
    """the address if its scheme is http, https or mailto, else empty."""
    trimmed = js_trim(url)
    ok = trimmed.rlike(r"(?i)^(?:https?:/*[^/\s?#]+|mailto:)")
    return F.when(ok, trimmed).otherwise(F.when(url.isNotNull(), F.lit("")))


def addresses(text: Column) -> Column:
    """distinct lower-case addresses in order of appearance."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(ADDRESS), F.lit(0)), F.lower))


def sender_of(raw: Column) -> Column:
    """F8: (name, email) of an author line; ``unknown:<name>`` where it has no address."""
    email = F.regexp_extract(raw, ADDRESS, 0)
    bare = F.regexp_replace(F.replace(raw, F.when(email == "", F.lit("\u0000")).otherwise(email), F.lit("")), r"(?i)\[mailto:[^\]]*\]|[<>\"()]", "")
    name = js_trim(F.regexp_replace(F.regexp_replace(bare, rf"\A(?:{S}|[,;:·•-])+", ""), rf"(?:{S}|[,;:])+\z", ""))
    local = F.substring_index(email, "@", 1)
    shown = F.when(name != "", name).when(local != "", local).otherwise(F.lit("Unknown"))
    return F.struct(shown.alias("name"), F.lower(F.when(email != "", email).otherwise(F.concat(F.lit("unknown:"), name))).alias("email"))


def has_zone(raw: Column) -> Column:
    """whether a written date names its offset."""
    return raw.rlike(r"(?i)[+-]\d{2}:?\d{2}\b|\b(?:GMT|UTC|UT|Z)\b|\dZ\z")


def recipient_rest(line: Column) -> Column:
    """what a recipient line holds besides addresses and their names."""
    rest = F.regexp_replace(line, rf"(?:\"[^\"]*\"|[^<>;,]+)?<?{ADDRESS}>?", "")
    return js_trim(F.regexp_replace(rest, rf"(?:{S}|[;,])+", " "))


_NAME_TAIL = r"^[\p{Lu}\p{N}][\p{L}\p{N}.'’-]*(?:[ \t]+[\p{Lu}\p{N}][\p{L}\p{N}.'’-]*){0,4}\z"


def continues_recipients(line: Column) -> Column:
    """whether a line can only be more of a wrapped recipient list."""
    rest = recipient_rest(line)
    return (F.size(addresses(line)) > 0) & ((rest == "") | ((F.length(rest) <= 60) & rest.rlike(_NAME_TAIL)))


def recipients_unfinished(value: Column) -> Column:
    """whether a recipient list goes on in the next line."""
    return value.rlike(rf"[,;]{S}*\z") | (recipient_rest(value) != "")


def image_keys(html: Column) -> Column:
    """what survives of each picture's address in every copy; ``?`` names no picture."""
    tags = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r"(?i)<img\b[^>]*>"), F.lit(0))

    def key(tag: Column) -> Column:
        raw = F.regexp_extract(tag, r'(?i)(?:src|data-tl-image-src)="([^"]*)"', 1)
        proxied = F.regexp_extract(raw, r'#(https?://[^"\s]+)\z', 1)
        url = F.regexp_extract(raw, r"(?i)^([a-z][a-z0-9+.-]*://[^/?#]*)", 1)
        path = F.regexp_extract(raw, r"(?i)^[a-z][a-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
        return (
            F.when(proxied != "", proxied)
            .when(raw.rlike("(?i)^data:"), raw)
            .when(raw.rlike("(?i)^cid:"), F.lower(raw))
            .when(raw.rlike(r"(?i)^blob:|googleusercontent\.com/proxy/"), F.lit("?"))
            .when(url != "", F.concat(F.lower(url), F.when(path == "", F.lit("/")).otherwise(path)))
            .when(raw != "", raw)
            .otherwise(F.lit("?"))
        )

    return F.transform(tags, key)


def image_identity(html: Column) -> Column:
    """F16."""
    return F.array_join(image_keys(html), "|")


def name_key(name: Column) -> Column:
    """lower-case ASCII letters and digits of a name."""
    return F.regexp_replace(F.lower(name), "[^a-z0-9]+", "")


def specific_name(name: Column) -> Column:
    """the name's key, or empty where it identifies nobody."""
    key = name_key(name)
    return F.when((F.length(key) >= 4) & ~key.isin(*PLACEHOLDER_NAMES), key).otherwise(F.lit(""))


def normal_body(body: Column, nfkc=None) -> Column:
    """quote marks stripped, quotes straightened, white space folded, lower case; ``nfkc`` is a UDF where compatibility forms matter."""
    plain = F.regexp_replace(body, rf"(?m)^{S}*>+{S}?", "")
    plain = nfkc(plain) if nfkc is not None else plain
    return F.lower(js_trim(F.regexp_replace(F.translate(plain, "‘’“”", "''\"\""), rf"{S}+", " ")))


def is_clipped(body: Column) -> Column:
    """F20."""
    return body.rlike(CLIPPED)


def without_noise(body: Column) -> Column:
    """F21. Bodies without any of the marks, which are most, are looked at once instead of once for each mark."""
    return F.when(body.rlike(_ANY_NOISE), reduce(lambda c, p: F.regexp_replace(c, p, " "), NOISE, body)).otherwise(body)


def authored(body: Column, nfkc=None) -> Column:
    """F22 before its last resort: what the author wrote, without signature, clipping notice and provider marks; may be empty."""
    text = F.regexp_replace(without_noise(body), rf"(?m)^{S}*>+{S}?", "")
    unsigned = F.get(F.split(text, SIGN_OFF, 2), F.lit(0))
    cut = F.get(F.split(unsigned, CLIPPED, 2), F.lit(0))
    kept = F.when(unsigned.rlike(CLIPPED), F.regexp_replace(cut, _CUT_END, "")).otherwise(unsigned)
    return normal_body(kept, nfkc)


def core_text(body: Column, nfkc=None) -> Column:
    """what the author wrote; the whole body where nothing else is left."""
    core = authored(body, nfkc)
    return F.when(core != "", core).otherwise(normal_body(body, nfkc))


def presentation(body: Column, nfkc=None) -> Column:
    """like the core, but with the signature."""
    text = without_noise(body)
    cut = F.regexp_replace(F.get(F.split(text, CLIPPED, 2), F.lit(0)), _CUT_END, "")
    return normal_body(F.when(text.rlike(CLIPPED), cut).otherwise(text), nfkc)


def same_words(a: Column, b: Column, a_clipped: Column, b_clipped: Column) -> Column:
    """Equal presentations, or one a clipped beginning of the other and long enough to be specific."""
    enough = F.least(F.length(a), F.length(b)) >= 40
    return (a == b) | (enough & ((a_clipped & F.startswith(b, a)) | (b_clipped & F.startswith(a, b))))


def yes(flag: Column) -> Column:
    """A flag that may be missing, as true or false."""
    return F.coalesce(flag, F.lit(False))


def anchored_time(ts: Column, estimated: Column, zone_unknown: Column) -> Column:
    """a readable clock that is neither estimated nor without a zone."""
    return ts.isNotNull() & ~yes(estimated) & ~yes(zone_unknown)


def anchored_direct(source: Column, ts: Column, estimated: Column, zone_unknown: Column) -> Column:
    """F26."""
    return ~source.eqNullSafe(F.lit("quoted")) & anchored_time(ts, estimated, zone_unknown)


def time_rank(ts: Column, estimated: Column, zone_unknown: Column) -> Column:
    """how good a clock is, 0 to 4."""
    return F.when(ts.isNull(), 0).otherwise(1 + F.when(yes(estimated), 0).otherwise(1) + F.when(yes(zone_unknown), 0).otherwise(2))


def same_day_clock(a: Column, b: Column) -> Column:
    """equal month, day, hour and minute."""
    return F.date_format(a, "MM-dd HH:mm") == F.date_format(b, "MM-dd HH:mm")


def escape_html(text: Column) -> Column:
    """F29."""
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def address_label(email: Column) -> Column:
    """F30."""
    return F.when(F.contains(email, F.lit("@")), F.concat(F.lit("&lt;"), escape_html(email), F.lit("&gt;"))).otherwise(F.lit("(address not recorded)"))


def highlight(text: Column, query: str) -> Column:
    """literal, case-insensitive matches between ``<mark>`` tags; a blank query marks nothing."""
    if not query.strip():
        return text
    literal = "(?iu)(" + "".join(f"\\{c}" if not c.isalnum() and c.isascii() and not c.isspace() else c for c in query) + ")"
    return F.regexp_replace(text, literal, "<mark>$1</mark>")


def inline_image_name(source: Column, index: Column) -> Column:
    """the address's own file name, or ``image-N`` with the payload's extension."""
    path = F.regexp_extract(source, r"(?i)^[a-z][a-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    base = F.regexp_replace(F.try_url_decode(F.element_at(F.split(path, "/"), -1)), rf"{S}+", "-")
    mime = F.lower(F.regexp_extract(source, r"(?i)^data:image/([a-z0-9]+)", 1))
    ext = F.when(mime == "jpeg", F.lit("jpg")).when(mime.isin("png", "gif", "webp", "avif"), mime).otherwise(F.lit("png"))
    own = base.rlike(r"(?i)\.(png|jpe?g|gif|webp|avif)\z") & (F.length(base) <= 80)
    return F.when(own, base).otherwise(F.concat(F.lit("image-"), index.cast("string"), F.lit("."), ext))


def image_download_name(source: Column, alt: Column, mime: Column, nfkc=None) -> Column:
    """F32: a useful file name with the downloaded format's extension."""
    own, label = inline_image_name(source, F.lit(1)), js_trim(alt)
    pattern = r"(?i)\.(?:png|jpe?g|gif|webp|avif)\z"
    pick = (
        F.when(label.rlike(pattern), label)
        .when(~own.rlike(r"^image-1\."), own)
        .when((label != "") & ~label.rlike(r"(?i)^inline image\z"), label)
        .otherwise(F.lit("inline-image"))
    )
    stem = F.regexp_replace(pick, pattern, "")
    stem = file_stem(nfkc(stem) if nfkc is not None else stem)
    ext = F.when(F.lower(mime) == "image/jpeg", F.lit("jpg")).otherwise(F.get(F.split(F.lower(mime), "/"), F.lit(1)))
    return F.concat(F.when(stem != "", stem).otherwise(F.lit("inline-image")), F.lit("."), ext)


def file_stem(name: Column) -> Column:
    """A name without characters that files cannot have, 100 characters at most."""
    clean = F.regexp_replace(F.regexp_replace(name, r"[<>:\"/\\|?*\x00-\x1f\x7f]", "-"), rf"{S}+", " ")
    return js_trim(F.left(F.regexp_replace(clean, r"\A[. ]+|[. ]+\z", ""), F.lit(100)))


def export_name(subject: Column, day: Column, suffix: str = "", extension: str = "html") -> Column:
    """File name of an export."""
    stem = file_stem(subject)
    tail = f"-{suffix}" if suffix else ""
    return F.concat(F.lit("conversation-"), F.when(stem != "", stem).otherwise(F.lit("untitled")), F.lit("-"), F.date_format(day, "yyyy-MM-dd"), F.lit(f"{tail}.{extension}"))


def safe_image_source(raw: Column) -> Column:
    """H3: raster payloads below the size limit, https without user information, blobs of the mail origins; else empty."""
    payload = raw.rlike(r"(?i)^data:image/(?:png|jpeg|gif|webp|avif);base64,[a-z0-9+/=\s]+\z") & (F.length(raw) < int(8 * 1024 * 1024 * 1.4))
    https = raw.rlike(r"(?i)^https://[^/?#@\s]+(?:[/?#]|\z)")
    blob = raw.rlike(r"(?i)^blob:https://(?:mail\.google\.com|outlook\.(?:live|office|office365)\.com)(?:/|\z)")
    return F.when(payload | https | blob, raw).otherwise(F.lit(""))


def raster_mime(mime: Column) -> Column:
    """H4."""
    return mime.rlike(r"(?i)^image/(png|jpeg|gif|webp|avif)(?:;|\z)")


def attachment_url(raw: Column) -> Column:
    """Https addresses of the four attachment hosts, else empty."""
    host = F.lower(F.regexp_extract(raw, r"(?i)^https://([^/?#:@]+)(?::443)?(?:[/?#]|\z)", 1))
    return F.when(host.isin("mail.google.com", "outlook.live.com", "outlook.office.com", "outlook.office365.com"), raw).otherwise(F.lit(""))


def attachment_key(message_id: Column, name: Column, size_label: Column) -> Column:
    """S29."""
    return F.concat_ws(":", message_id, name, size_label)


def thread_key(fragment: Column) -> Column:
    """Last segment of an address fragment if it looks like a thread id, else empty."""
    last = F.element_at(F.split(fragment, "/"), -1)
    return F.when(last.rlike(r"^[A-Za-z0-9]{9,}\z"), last).otherwise(F.lit(""))


def sender_title(raw: Column) -> Column:
    """(name, email) of a title such as ``Name <a@b.c>``, ``Name (a@b.c)``, an address, or a name."""
    mail = r"[\w.+\-]+@[\w.\-]+\.\w+"
    angle, paren = rf"^(.*?)\s*<({mail})>\s*\z", rf"^(.*?)\s*\(({mail})\)\s*\z"
    inner = F.regexp_extract(raw, mail, 0)
    stripped = js_trim(F.regexp_replace(F.replace(raw, F.when(inner == "", F.lit("\u0000")).otherwise(inner), F.lit("")), "[<>()]", ""))

    def part(pattern: str) -> Column:
        name = js_trim(F.regexp_extract(raw, pattern, 1))
        email = F.regexp_extract(raw, pattern, 2)
        return F.struct(F.when(name != "", name).otherwise(email).alias("name"), F.lower(email).alias("email"))

    return (
        F.when(raw.rlike(angle), part(angle))
        .when(raw.rlike(paren), part(paren))
        .when(raw.rlike(rf"^{mail}\z"), F.struct(F.substring_index(raw, "@", 1).alias("name"), F.lower(raw).alias("email")))
        .when(inner != "", F.struct(F.when(stripped != "", stripped).otherwise(F.substring_index(inner, "@", 1)).alias("name"), F.lower(inner).alias("email")))
        .otherwise(F.struct(js_trim(raw).alias("name"), F.lit("").alias("email")))
    )


def first_filled(*columns: Column) -> Column:
    """The first of the columns that is neither null nor empty."""
    return F.coalesce(*[F.when(c != "", c) for c in columns])


def title_subject(title: Column) -> Column:
    """A page title without the provider's suffix, or the default subject."""
    bare = js_trim(F.regexp_replace(title, r"(?i)\s*[-–|]\s*Outlook.*\z", ""))
    return F.when(F.coalesce(bare, F.lit("")) != "", bare).otherwise(F.lit("Email Thread"))


def carrier_notice(name: Column, email: Column, recipients: Column) -> Column:
    """The sentence shown for an email that only passed a conversation on."""
    who = F.when(js_trim(name) != "", js_trim(name)).otherwise(email)
    to = F.filter(F.coalesce(recipients, F.array().cast("array<string>")), lambda r: (r != "") & (r != email))
    several = F.concat(F.array_join(F.slice(to, 1, 2), ", "), F.lit(" and "), (F.size(to) - 2).cast("string"), F.lit(" others"))
    named = F.when(F.size(to) <= 3, F.array_join(to, ", ")).otherwise(several)
    rest = F.lit(" without adding a message. Everything below was quoted from the thread.")
    return F.concat(who, F.lit(" passed this conversation on"), F.when(named != "", F.concat(F.lit(" to "), named)).otherwise(F.lit("")), rest)
