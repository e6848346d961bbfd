"""Splitting a container into the messages it holds.

A body is laid out as text with the span of every node. Three readers look for the
headers of quoted messages in it: marked attributions, blocks of fields in four
languages, and plain "On ... wrote:" lines. Each header opens an interval; a message is its
interval without the intervals nested in it, cut back out of the tree as sanitised markup.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import dates, markup
from ..functions.markup import Node
from ..schema import MESSAGE

# The fields of a quoted header in four languages.
FROM, WHEN = "From|De|Von|Van", "Sent|Date|Envoyé|Gesendet|Verzonden"
TO, ABOUT = "To|À|An|Aan|Cc", "Subject|Objet|Betreff"
MAX_FIELD_LINES, MAX_STRAY, MAX_STRAY_CHARS, MAX_STRANDED, MAX_DEPTH = 24, 2, 80, 8, 2
ADDRESS = re.compile(r"[\w.!#$%&'*+/=?^`{|}~-]+@[\w.-]+\.[a-z]{2,}", re.I)
DISCLAIMER = re.compile(r"this e-?mail and any attachments|this message contains information that is confidential|agreements binding|e-?mail transmissions are not secure", re.I)
UNSPLIT = re.compile(rf"^[ \t>]*(?:{FROM}):[ \t]*\S[^\n]*\n[\s\S]{{0,800}}?^[ \t>]*(?:{WHEN}):", re.I | re.M)
_OPENING = re.compile(rf"^[ \t>]*(?:{FROM}):[ \t]*([^\n]+)\n", re.I | re.M)
_FIELD = re.compile(rf"^[\s>]*({WHEN}|{TO}|{ABOUT}):\s*(.*)$", re.I)
_STRANDED = re.compile(rf"^[\s>]*(?:{WHEN}|{TO}|Bcc|{ABOUT}):", re.I)
_BLOCK = re.compile(rf"^[\s>]*(?:{FROM}):", re.I)
_IS_TO, _IS_WHEN = re.compile(rf"(?:{TO})\Z", re.I), re.compile(rf"(?:{WHEN})\Z", re.I)
_FORWARDED = re.compile(r"[-─—]{5,}\s*(?:Forwarded message|Original Message)\s*[-─—]{5,}\s*\Z", re.I)
_DATE_FIRST = r"(.+?\d{1,2}:\d{2}(?::\d{2})?\s*(?:AM|PM)?(?:\s*(?:[+-]\d{4}|GMT|UTC))?)"
_PLAIN = re.compile(r"^[ \t>]*On[ \t]+([^\n]+(?:\n[ \t>]*[^\n]+){0,2}?)\s+wrote:[ \t]*$", re.I | re.M)
_ADDRESSED = re.compile(r"(?:\"[^\"]*\"|[^<>;,]+)?<?[\w.!#$%&'*+/=?^`{|}~-]+@[\w.-]+\.[a-z]{2,}>?", re.I)


def addresses(text: str) -> list[str]:
    """F11 on a string."""
    return list(dict.fromkeys(a.lower() for a in ADDRESS.findall(text)))


def author(raw: str) -> tuple[str, str]:
    """F8 on a string: (name, email)."""
    found = ADDRESS.search(raw)
    email = found[0] if found else ""
    name = re.sub(r"\[mailto:[^\]]*\]", "", raw.replace(email, "", 1) if email else raw, flags=re.I)
    name = re.sub(r"[\s,;:]+\Z", "", re.sub(r"\A[\s,;:·•-]+", "", re.sub(r'[<>"()]', "", name))).strip()
    return name or email.split("@")[0] or "Unknown", (email or f"unknown:{name}").lower().strip()


def _rest(line: str) -> str:
    return re.sub(r"[\s;,]+", " ", _ADDRESSED.sub("", line)).strip()


def _name_like(text: str) -> bool:
    """A display name rather than prose: up to five words that begin with a capital or a digit."""
    words = re.split(r"[ \t]+", text)
    return len(words) <= 5 and all(w and (w[0].isupper() or w[0].isnumeric()) and all(c.isalnum() or c in ".'’-" for c in w) for w in words)


def more_recipients(line: str) -> bool:
    """F13 on a string."""
    rest = _rest(line)
    return bool(addresses(line)) and (not rest or len(rest) <= 60 and _name_like(rest))


def unfinished(value: str) -> bool:
    """F14 on a string."""
    return bool(re.search(r"[,;]\s*\Z", value)) or bool(_rest(value))


def stable_id(text: str, tail: str) -> str:
    """F6 on strings, over UTF-16 units."""
    h = 0
    units = f"{text}-{tail}".encode("utf-16-le", "surrogatepass")
    for i in range(0, len(units), 2):
        h = (h * 31 + (units[i] | units[i + 1] << 8) + 0x80000000) % 0x100000000 - 0x80000000
    return "msg-" + markup.base36(abs(h))


class Layout:
    """A tree's text, the span of each of its nodes, and pieces of it as markup."""

    def __init__(self, root: Node):
        self.root, self.spans, self.leaves = root, {}, []
        parts: list[str] = []
        size = 0

        def put(text: str, node: Node | None) -> None:
            nonlocal size
            if text:
                if node is not None:
                    self.leaves.append((size, size + len(text), node))
                parts.append(text)
                size += len(text)

        stack: list[tuple[Node, bool, int]] = [(root, False, 0)]
        while stack:
            node, closing, start = stack.pop()
            block = node.tag in markup.BLOCK_TAGS
            if closing:
                self.spans[id(node)] = (start, size)
                if block:
                    put("\n", None)
            elif node.tag is None:
                put(node.text, node)
            elif node.tag == "img":
                put("￼", node)
            else:
                if block or node.tag == "br":
                    put("\n", node if node.tag == "br" else None)
                stack.append((node, True, size))
                stack.extend((k, False, 0) for k in reversed(node.kids))
        self.text = "".join(parts)

    def cut(self, start: int, end: int) -> str:
        """The markup of an interval. Elements around all of it are kept, but for the quote wrappers of whoever passed it on."""
        while start < end and self.text[start].isspace():
            start += 1
        while end > start and self.text[end - 1].isspace():
            end -= 1
        if start == end:
            return ""
        out = Node("div")
        copies: dict[int, Node] = {id(self.root): out}
        first = max(0, bisect_right(self.leaves, start, key=lambda x: x[0]) - 1)
        for a, b, leaf in self.leaves[first:]:
            if a >= end:
                break
            if b <= start:
                continue
            path = []
            up = leaf.parent
            while id(up) not in copies:
                path.append(up)
                up = up.parent
            for n in reversed(path):
                s, e = self.spans[id(n)]
                whole = s <= start and e >= end
                parent = copies[id(n.parent)]
                copies[id(n)] = parent if whole and _is_quote(n) else parent.add(Node(n.tag, dict(n.attrs)))
            copies[id(leaf.parent)].add(Node(text=leaf.text[max(a, start) - a : min(b, end) - a]) if leaf.tag is None else Node(leaf.tag, dict(leaf.attrs)))
        return markup.sanitize(out.html())


def _is_quote(n: Node) -> bool:
    return n.tag == "blockquote" or "gmail_quote" in n.classes


@dataclass
class Header:
    start: int
    end: int
    name: str
    email: str
    date: str
    scope: int | None = None
    recipients: list[str] | None = None


@dataclass
class _Block:
    """What is read below a From line."""

    size: int = 0
    date: str = ""
    fields: int = 0
    other: bool = False
    recipients: list[str] = field(default_factory=list)

    @property
    def complete(self) -> bool:
        return bool(self.date) and self.other and self.fields >= 2


def _fields(lines: list[str]) -> _Block:
    block, stray, last, open_list = _Block(), 0, "", False
    for i, line in enumerate(lines):
        found = _FIELD.match(line)
        if found:
            last, open_list = found[1], unfinished(found[2])
            block.fields += 1
            if _IS_WHEN.match(last):
                block.date = found[2]
            else:
                block.other = True
            if _IS_TO.match(last):
                block.recipients += addresses(found[2])
        elif line.strip():
            if _IS_TO.match(last) and open_list and more_recipients(line):
                block.recipients += addresses(line)
                open_list = unfinished(line)
            else:
                nearby = lines[i + 1 : i + 4]
                goes_on = next((k for k, x in enumerate(nearby) if _FIELD.match(x)), None)
                another = next((k for k, x in enumerate(nearby) if _BLOCK.match(x)), None)
                noise = stray < MAX_STRAY and len(line.strip()) <= MAX_STRAY_CHARS and not _BLOCK.match(line)
                if not noise or goes_on is None or another is not None and another < goes_on:
                    break
                stray += 1
        block.size += len(line) + 1
    return block


def _attributions(layout: Layout) -> Iterator[Header]:
    """Elements that the provider marks as attributions."""
    for el in layout.root.elements():
        if "gmail_attr" not in el.classes:
            continue
        raw = el.content.strip()
        if not re.search(r"wrote:\s*\Z", raw, re.I):
            continue
        dated = re.match(r"On\s+" + _DATE_FIRST, raw, re.I)
        loose = re.match(r"On\s+([\s\S]+?)\s+(.+?)\s+wrote:\s*\Z", raw, re.I)
        date = dated[1] if dated else loose[1] if loose else ""
        name, email = author(re.sub(r"wrote:\s*\Z", "", raw[len(date) + 3 :], flags=re.I))
        link = next((a for a in el.elements("a") if a.attrs.get("href", "").startswith("mailto:")), None)
        if link is not None:
            email = link.attrs["href"][7:].split("?")[0]
            name = name if name and name != email else link.content.strip() or email
            email = email.lower().strip()
        kids = el.parent.kids
        after = kids[next(i for i, k in enumerate(kids) if k is el) + 1 :]
        beside = next((k for k in after if k.tag and (_is_quote(k) or "gmail_attr" in k.classes)), None)
        scope = beside if beside is not None and _is_quote(beside) else next((a for a in el.ancestors() if _is_quote(a)), None)
        start, end = layout.spans[id(el)]
        yield Header(start, end, name.strip() or email.split("@")[0], email, date, layout.spans[id(scope)][1] if scope is not None else None)


def _blocks(text: str) -> Iterator[Header]:
    for m in _OPENING.finditer(text):
        block = _fields(text[m.end() :].split("\n", MAX_FIELD_LINES)[:MAX_FIELD_LINES])
        if block.complete:
            line = _FORWARDED.search(text[max(0, m.start() - 400) : m.start()])
            start = m.start() if not line else max(0, m.start() - 400) + line.start()
            yield Header(start, m.end() + block.size, *author(m[1]), block.date, None, block.recipients)


def _plain(text: str, known: list[Header]) -> Iterator[Header]:
    """E5, and J16: lines inside a header that is known already are left alone."""
    for m in _PLAIN.finditer(text):
        if any(h.start <= m.start() < h.end for h in known):
            continue
        if d := re.match(_DATE_FIRST + r"[,\s]+(.+)\Z", re.sub(r"\n[ \t>]*", " ", m[1]), re.I):
            yield Header(m.start(), m.end(), *author(d[2]), d[1])


def headers_of(layout: Layout) -> list[Header]:
    """The headers in order, without overlaps, each with the end of its scope."""
    found = [*_attributions(layout), *_blocks(layout.text)]
    found += list(_plain(layout.text, found))
    found.sort(key=lambda h: h.start)
    kept = [h for i, h in enumerate(found) if i == 0 or h.start >= found[i - 1].end]
    for i, h in enumerate(kept):
        if h.scope is None:
            around = [p.scope for p in kept if p is not h and p.start < h.start and p.scope is not None and p.scope > h.end]
            h.scope = min([len(layout.text), *around])
    return kept


class Container:
    """A laid-out body with its headers."""

    def __init__(self, root: Node):
        for n in root.elements():
            if n.tag in ("script", "style", "iframe", "object", "form") or n.tag == "u" and "q" in n.classes:
                n.remove()
        self.layout = Layout(root)
        self.headers = headers_of(self.layout)

    def _past_stranded(self, start: int, end: int) -> int:
        """E8."""
        text, at, skipped = self.layout.text, start, 0
        while at < end and skipped < MAX_STRANDED:
            stop = text.find("\n", at, end)
            stop = end if stop < 0 else stop
            line = text[at:stop]
            if line.strip():
                if not _STRANDED.match(line) and not more_recipients(line):
                    break
                skipped += 1
            at = stop + 1
        return min(at, end) if skipped else start

    def content(self, start: int, end: int) -> tuple[str, str]:
        """(body, markup) of an interval without the intervals nested in it; a disclaimer ends each piece."""
        start = self._past_stranded(start, end)
        pieces, at = [], start
        for h in self.headers:
            if start <= h.start < end:
                if h.start > at:
                    pieces.append((at, h.start))
                at = max(at, min(h.scope, end))
        if at < end:
            pieces.append((at, end))
        html = []
        for a, b in pieces:
            notice = DISCLAIMER.search(self.layout.text, a, b)
            html.append(self.layout.cut(a, notice.start() if notice else b))
        joined = "<br>".join(x for x in html if x)
        return markup.to_text(joined), joined


def _shown(body: str, html: str) -> bool:
    return bool(body.strip()) or bool(re.search(r"<(?:table|img)\b", html or "", re.I))


def extract(html: str, user: str, thread: str, anchor: int, carrier: str, depth: int = 0, root: Node | None = None) -> tuple[str, str, list[dict]]:
    """(own body, own markup, quoted messages) of one container, before copies are merged."""
    from .reconcile import picture_keys

    box = Container(root if root is not None else markup.parse(html))
    heads = box.headers
    bodies = [box.content(h.end, h.scope) for h in heads]
    outer = [max((j for j, p in enumerate(heads) if p.start < h.start and p.scope > h.start), default=-1) for h in heads]
    drafts = []
    for i, (h, (body, rich)) in enumerate(zip(heads, bodies, strict=True)):
        fallback = anchor - (i + 1) * 1000
        at, estimated = dates.mail_date(h.date, fallback)
        words = " ".join(body.split())
        drafts.append(
            {
                "thread_id": thread,
                "id": stable_id(f"{thread}:{h.email}:{h.date}:{words}:{'|'.join(picture_keys(rich))}", "chain"),
                "idx": -i - 1,
                "sender": {"name": h.name, "email": h.email},
                "ms": at,
                "ts_raw": dates.iso(at),
                "ts_estimated": estimated,
                "zone_unknown": at != fallback and not dates.has_zone(h.date),
                "source": "quoted",
                "body": body,
                "body_html": rich,
                "is_current_user": bool(user) and h.email == user.lower(),
                "recipients": h.recipients or None,
            }
        )
    stays = [bool(d["body"]) or _shown("", d["body_html"]) for d in drafts]

    def quoter(i: int) -> str:
        """The nearest quoter that is kept, the carrier at last."""
        i = outer[i]
        while i >= 0 and not stays[i]:
            i = outer[i]
        return carrier if i < 0 else drafts[i]["id"]

    history = [d | {"quoted_by": quoter(i)} for i, d in enumerate(drafts) if stays[i]]
    body, rich = box.content(0, len(box.layout.text))
    if depth < MAX_DEPTH:
        history = [m for d in history for m in _again(d, user, thread, depth)]
        if rich and UNSPLIT.search(body):
            inner, inner_rich, more = extract(rich, user, thread, anchor, carrier, depth + 1)
            if more:
                body, rich, history = inner, inner_rich, history + more
    return body, rich, history


def _again(message: dict, user: str, thread: str, depth: int) -> list[dict]:
    """A recovered body that still holds a whole header is read once more."""
    if not message["body_html"] or not UNSPLIT.search(message["body"]):
        return [message]
    body, rich, more = extract(message["body_html"], user, thread, message["ms"], message["id"], depth + 1)
    if not more:
        return [message]
    if _shown(body, rich):
        return [message | {"body": body, "body_html": rich}, *more]
    return [m | {"quoted_by": message["quoted_by"]} if m["quoted_by"] == message["id"] else m for m in more]


def carrier_text(message: dict) -> str:
    """E17 on a row."""
    who = (message["sender"]["name"] or "").strip() or message["sender"]["email"]
    to = [a for a in message.get("recipients") or [] if a and a != message["sender"]["email"]]
    named = ", ".join(to) if len(to) <= 3 else f"{', '.join(to[:2])} and {len(to) - 2} others"
    return f"{who} passed this conversation on{' to ' + named if named else ''} without adding a message. Everything below was quoted from the thread."


def messages_of(snapshot: dict) -> list[dict]:
    """All messages of one snapshot, the container's own last; none if it holds nothing."""
    from .reconcile import merge

    head = dict(snapshot["message"])
    root = markup.parse(markup.put_sources(snapshot["html"] or "", snapshot["image_sources"]))
    anchor = head.get("ms") or 0
    body, rich, history = extract("", snapshot["current_user"] or "", snapshot["thread_id"], anchor, head["id"], root=root)
    history = merge(history)
    picture = bool(re.search(r"<img\b", rich, re.I))
    if not body and not picture and not history and not head.get("attachments"):
        return []
    carrier = not body and not picture and bool(history)
    own = head | {"thread_id": snapshot["thread_id"], "source": head.get("source") or "direct", "history_carrier": carrier}
    return [*history, own | {"body": carrier_text(head) if carrier else body, "body_html": "" if carrier else rich}]


def to_rows(messages: list[dict]) -> list[dict]:
    """Python messages as rows of the shared schema."""
    names = MESSAGE.fieldNames()
    return [{n: dates.from_ms(m.get("ms")) if n == "ts" else m.get(n) for n in names} | {"ord": i} for i, m in enumerate(messages)]


def from_row(row: dict) -> dict:
    """A row of the shared schema as a Python message; a raw date is read where no timestamp is given."""
    ms = dates.to_ms(row.get("ts"))
    return {**row, "ms": ms if ms is not None else dates.instant(row["ts_raw"]) if row.get("ts_raw") else None}


def split(snapshots: DataFrame) -> DataFrame:
    """Snapshots as message rows: one row for each message that a container holds, in its order.

    A narrow, Arrow-batched map with no shuffle; a snapshot that cannot hold a message gives no row.
    """
    kind = T.ArrayType(MESSAGE)
    arrow = to_arrow_type(kind)

    @F.arrow_udf(kind)
    def explode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            out = []
            for s in batch.to_pylist():
                s["message"] = from_row(s["message"])
                out.append(to_rows(messages_of(s)))
            yield pa.array(out, arrow)

    usable = snapshots.where(F.col("message").isNotNull())
    packed = F.struct("thread_id", "current_user", "message", "html", "image_sources")
    # ord is made unique within the thread: snapshot sequence first, place in the snapshot second
    rows = usable.select("seq", F.posexplode(explode(packed)).alias("at", "m"))
    return rows.select("m.*", "seq", "at").withColumn("ord", F.col("seq").cast("long") * 100_000 + F.col("at")).drop("seq", "at")


def plain_to_html(text: Column) -> Column:
    """A plain-text body as markup: escaped, lines broken."""
    from ..functions.text import escape_html

    return F.replace(escape_html(text), F.lit("\n"), F.lit("<br>"))


def strip_quoted(html: str) -> tuple[str, str | None]:
    """(body, quoted text) with quotes, attributions and hidden parts taken out."""
    root, quoted = markup.parse(html), []
    for pick in (lambda n: "gmail_quote" in n.classes, lambda n: n.tag == "blockquote"):
        for n in root.elements():
            if pick(n) and (n is root or root in n.ancestors()):
                text = n.content.strip()
                if text:
                    quoted.append(text)
                n.remove()
    for n in root.elements():
        style = n.attrs.get("style", "")
        if "gmail_attr" in n.classes or n.tag == "u" and "q" in n.classes or "elided" in n.attrs.get("class", "") or "display:none" in style or "display: none" in style:
            n.remove()
    return markup.to_text(root.html()), "\n---\n".join(quoted).strip() or None
