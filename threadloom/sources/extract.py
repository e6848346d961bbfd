"""Reading provider containers into snapshots.

A provider is a set of selectors and strategies (``Provider``); new ones are registered by
name. Containers arrive as rows of markup and leave as snapshot rows through one
Arrow-batched map without a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import dates, markup
from ..functions.markup import Node
from ..functions.text import MIME
from ..operators.split import addresses, stable_id
from ..schema import SNAPSHOT

#: Largest container, and largest capture, in characters.
MAX_CONTAINER, MAX_CAPTURE = 512 * 1024, 16 * 1024 * 1024
_MAIL = re.compile(r"[\w.+\-]+@[\w.\-]+\.\w+")
_SIMPLE = re.compile(r'([a-z0-9*]+)?((?:\.[\w-]+|\[[^\]]+\])*)', re.I)
_TEST = re.compile(r'\.([\w-]+)|\[([\w-]+)(?:([*^$~]?=)"([^"]*)"(\s+i)?)?\]')


def _compile(simple: str) -> Callable[[Node], bool]:
    tag, tests = _SIMPLE.fullmatch(simple).groups()
    found = [m.groups() for m in _TEST.finditer(tests or "")]

    def test(n: Node) -> bool:
        if tag and tag != "*" and n.tag != tag.lower():
            return False
        for cls, attr, op, want, fold in found:
            if cls:
                if cls not in n.classes:
                    return False
                continue
            have = n.attrs.get(attr.lower())
            if have is None:
                return False
            if op:
                h, w = (have.lower(), want.lower()) if fold else (have, want)
                if not {"=": h == w, "*=": w in h, "^=": h.startswith(w), "$=": h.endswith(w), "~=": w in h.split()}[op]:
                    return False
        return True

    return test


class Selector:
    """A list of selectors of elements, classes and attributes, with descendants: ``.a b[c*="d" i], e``."""

    def __init__(self, text: str):
        self.paths = [[_compile(s) for s in re.findall(r'(?:\[[^\]]*\]|[^\s\[])+', p)] for p in _split(text)]

    def matches(self, n: Node) -> bool:
        for path in self.paths:
            if path[-1](n):
                rest, up = path[:-1], n.parent
                while rest and up is not None:
                    if up.tag and rest[-1](up):
                        rest = rest[:-1]
                    up = up.parent
                if not rest:
                    return True
        return False

    def all(self, root: Node) -> list[Node]:
        return [n for n in root.elements() if self.matches(n)]

    def first(self, root: Node) -> Node | None:
        return next((n for n in root.walk() if n is not root and n.tag and self.matches(n)), None)


def _split(text: str) -> list[str]:
    return [p.strip() for p in re.findall(r'(?:\[[^\]]*\]|[^,\[])+', text) if p.strip()]


def sender_title(raw: str) -> tuple[str, str]:
    """S4 on a string."""
    for pattern in (rf"(.*?)\s*<({_MAIL.pattern})>\s*\Z", rf"(.*?)\s*\(({_MAIL.pattern})\)\s*\Z"):
        if m := re.match(pattern, raw, re.S):
            return m[1].strip() or m[2], m[2].lower()
    if m := _MAIL.search(raw):
        rest = raw if m[0] == raw else re.sub("[<>()]", "", raw.replace(m[0], "", 1)).strip()
        return (rest if m[0] != raw and rest else m[0].split("@")[0]), m[0].lower()
    return raw.strip(), ""


def mime_of(name: str) -> str:
    return MIME.get(name.rsplit(".", 1)[-1].lower(), "application/octet-stream")


@dataclass(frozen=True)
class Provider:
    """How one provider's markup is read. Strategies are tried in order, the first that finds something counts."""

    name: str
    items: str
    bodies: str
    times: str
    sender: Callable[[Node, int], tuple[str, str]]
    attachments: Callable[[Node], list[dict]]
    ids: tuple[str, ...]
    users: tuple[tuple[str, tuple[str, ...]], ...] = ()
    subjects: str = ""
    suffix: str = ""
    recipients: str = (
        '.hb [email], .g2[email], [data-recipient-email], [data-recipient-type] [email], [data-testid="recipient"], [class*="Recipient"] [title]'
    )


def _clicked_sender(el: Node, index: int) -> tuple[str, str]:
    n = Selector(".gD, [email]").first(el)
    link = Selector('a[href^="mailto:"]').first(n) if n else None
    name = (n.attrs.get("name") or n.content.strip() if n else "") or "Unknown"
    email = (n.attrs.get("email") if n else "") or (link.attrs["href"][7:] if link else "") or f"sender-{index}@unknown"
    return name, email


def _titled_sender(el: Node, index: int) -> tuple[str, str]:
    """S3."""
    n = Selector('[class*="Sender"] [title]').first(el)
    if n and n.attrs["title"] and (found := sender_title(n.attrs["title"]))[0]:
        return found
    n = Selector("[data-pe-id]").first(el)
    if n and n.attrs["data-pe-id"]:
        email = n.attrs["data-pe-id"]
        return (n.attrs.get("title") or n.content.strip() or email.split("@")[0]), email.lower()
    for attr in ("title", "aria-label"):
        n = Selector(f"[{attr}]").first(el)
        if n and n.attrs[attr] and (found := sender_title(n.attrs[attr]))[0]:
            return found
    return "Unknown Sender", f"unknown-{index}@outlook"


def _chips(el: Node) -> list[dict]:
    """S8."""
    for family in (".aZo", ".M2 .aQy", '[data-tooltip*="."]'):
        chips = Selector(family).all(el)
        if chips:
            break
    out = []
    for c in chips:
        inner = Selector("[data-tooltip]").first(c)
        tip = c.attrs.get("data-tooltip", inner.attrs["data-tooltip"] if inner else "")
        label = Selector(".aV3, .aQw").first(c)
        name = ((label.content if label else "") or tip).strip()
        if "." in name:
            size, link = Selector('.aV7, [class*="size"]').first(c), Selector('a[href*="view=att"], a[href*="attid"]').first(c)
            href = link.attrs["href"] if link else c.attrs.get("href", "") if c.tag == "a" else ""
            out.append({"name": name, "mime_type": mime_of(name), "size_label": size.content.strip() if size else "", "download_url": href})
    return out


def _linked_files(el: Node) -> list[dict]:
    out = []
    for a in Selector('a[download], a[href*="attachment" i], a[href*="GetFileAttachment" i]').all(el):
        name = a.attrs.get("download") or a.attrs.get("title") or a.content.strip() or "Attachment"
        out.append({"name": name, "mime_type": mime_of(name), "size_label": "", "download_url": a.attrs.get("href", "")})
    return out


PROVIDERS: dict[str, Provider] = {
    "gmail": Provider(
        "gmail",
        "[data-message-id]",
        ".a3s.aiL, .a3s, .ii.gt div, [data-message-text]",
        ".g3, time[datetime], .gH [title], .gH [data-tooltip], .xW [title], .xY [title]",
        _clicked_sender,
        _chips,
        ("data-message-id",),
        (("[data-ogsr-up] [data-email]", ("data-email",)), ('a[href*="myaccount.google.com"], [aria-label*="Google Account"]', ("title", "aria-label"))),
        ".hP, h2[data-legacy-thread-id]",
    ),
    "outlook": Provider(
        "outlook",
        '[data-unique-id], [class*="ConversationItem"], [role="option"]',
        '.allowTextSelection, [data-block], [role="document"], .elementToProof',
        'time[datetime], time[title], [class*="Time"][title], [class*="Time"] [title]',
        _titled_sender,
        _linked_files,
        ("data-unique-id",),
        (('[aria-label*="profile"], [aria-label*="account"], [aria-label*="Account manager"], [data-automationid="meControl"]', ("title", "aria-label")),),
        '[data-testid="subject"], [aria-label="Subject"], .allowTextSelection h1, h1[class*="subject" i], .jGFnO',
        r"\s*[-–|]\s*Outlook.*$",
    ),
}


def register(provider: Provider) -> None:
    """Make a provider known by its name, on the driver; it travels to the executors with the job."""
    PROVIDERS[provider.name] = provider


def page_user(page: str, client: str) -> str:
    """The address of the account that a page belongs to, lower case, empty where it is not shown."""
    root = markup.parse(page)
    for selector, attrs in PROVIDERS[client].users:
        for n in Selector(selector).all(root):
            for a in attrs:
                if m := _MAIL.search(n.attrs.get(a, "")):
                    return m[0].lower()
    return ""


def page_subject(page: str, client: str) -> str:
    """The subject that a page shows, else its title without the provider's suffix, else the default."""
    p, root = PROVIDERS[client], markup.parse(page)
    shown = next((n.content.strip() for n in Selector(p.subjects).all(root) if n.content.strip()), "")
    title = next((n.content for n in root.elements("title")), "") if p.suffix else ""
    return shown or re.sub(p.suffix, "", title, flags=re.I).strip() or "Email Thread"


def recipients_of(el: Node, body: Node, provider: Provider) -> list[str]:
    """Distinct addresses of header chips, not of the body."""
    out: dict[str, None] = {}
    for n in Selector(provider.recipients).all(el):
        if body is not n and body not in n.ancestors():
            raw = next((n.attrs[a] for a in ("data-recipient-email", "email", "title") if n.attrs.get(a)), n.content)
            out |= dict.fromkeys(addresses(raw))
    return list(out)


def timestamp_of(el: Node, provider: Provider, fallback: int) -> tuple[int, bool]:
    """The first complete date of any candidate, else the first estimate, else the fallback."""
    guess = None
    for n in Selector(provider.times).all(el):
        for raw in (n.attrs.get("datetime"), n.attrs.get("title"), n.attrs.get("data-tooltip"), n.content):
            if raw and re.search(r"\d", raw):
                at = dates.mail_date(raw, fallback)
                if not at[1]:
                    return at
                guess = guess or at
    return guess or (fallback, True)


def read_containers(html: str, client: str, user: str, anchor: int, thread: str, provider: Provider | None = None) -> list[dict]:
    """Every container of a page as a snapshot; containers without a body are left out, nested ones belong to the outermost."""
    p, root, out = provider or PROVIDERS[client], markup.parse(html), []
    items = Selector(p.items).all(root)
    held = {id(n) for n in items}
    items = [n for n in items if not any(id(a) in held for a in n.ancestors())]
    for i, el in enumerate(items):
        body = Selector(p.bodies).first(el)
        if body is None:
            continue
        name, email = p.sender(el, i)
        at, estimated = timestamp_of(el, p, anchor + i * 1000)
        key = next((el.attrs[a] for a in p.ids if el.attrs.get(a)), None) or stable_id(email, str(i))
        message = {
            "thread_id": thread, "id": key, "ord": i, "idx": i, "sender": {"name": name.strip() or email.split("@")[0], "email": email.lower().strip()},
            "ts": dates.from_ms(at), "ts_raw": dates.iso(at), "ts_estimated": estimated, "source": "direct", "body": "",
            "is_current_user": bool(user) and email.lower() == user.lower(), "recipients": recipients_of(el, body, p), "attachments": p.attachments(el) or None,
        }
        inner = body.html()
        out.append({"thread_id": thread, "session": None, "seq": i, "current_user": user, "message": message, "html": inner, "image_sources": markup.image_sources(inner)})
    return out


def snapshots(pages: DataFrame, client: str) -> DataFrame:
    """Pages (thread_id, html, current_user, anchor timestamp) as snapshot rows."""
    from pyspark.sql import types as T

    provider, kind = PROVIDERS[client], T.ArrayType(SNAPSHOT)
    arrow = to_arrow_type(kind)
    fields = {f.name: [x.name for x in f.dataType.fields] for f in SNAPSHOT.fields if isinstance(f.dataType, T.StructType)}

    @F.arrow_udf(kind)
    def read(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                found = read_containers(row["html"] or "", client, row["current_user"] or "", dates.to_ms(row["anchor"]) or 0, row["thread_id"] or "", provider)
                out.append([s | {"message": {n: s["message"].get(n) for n in fields["message"]}} for s in found])
            yield pa.array(out, arrow)

    return pages.where(F.coalesce("thread_id", F.lit("")) != "").select(F.explode(read(F.struct("thread_id", "html", "current_user", "anchor"))).alias("s")).select("s.*")


def capture_rows(containers: DataFrame) -> DataFrame:
    """Containers (thread_id, position, html) cut to the container limit, and dropped where a thread's file limit is reached.

    ``container_html`` is what the capture keeps; the running sum is by position within a thread.
    """
    cut = containers.withColumns({"container_html": F.left("html", F.lit(MAX_CONTAINER)), "container_truncated": F.length("html") > MAX_CONTAINER})
    before = F.sum(F.length("container_html")).over(Window.partitionBy("thread_id").orderBy("position").rowsBetween(Window.unboundedPreceding, -1))
    room = F.greatest(F.lit(0), F.lit(MAX_CAPTURE) - F.coalesce(before, F.lit(0)))
    fits = F.length("container_html") <= room
    return cut.withColumns({"container_truncated": F.col("container_truncated") | ~fits, "container_html": F.when(fits, F.col("container_html")).otherwise(F.left("container_html", room.cast("int")))}).drop("html")
