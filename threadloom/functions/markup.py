"""Mail markup: a small tree over the standard library's tokenizer, and what is done with it.

The tree is not an HTML5 tree builder: end tags are matched to the nearest open element of
their name, and elements that cannot have content are closed at once. Well-formed mail
markup reads the same; markup that needs foster parenting or implied end tags may differ.

Python functions work on strings; ``*_udf`` are their Arrow-batched Spark forms.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from html import escape, unescape
from html.parser import HTMLParser
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
KEPT_TAGS = frozenset("p div br b i strong em u s a ul ol li table tr td th thead tbody tfoot pre code blockquote span h1 h2 h3 h4 h5 h6 hr".split())
DROPPED_TAGS = frozenset("script style iframe object embed form input button link meta svg math".split())
STYLES = frozenset(
    "color background-color font-weight font-style text-decoration text-align vertical-align white-space border border-color "
    "border-width border-style padding padding-left padding-right padding-top padding-bottom".split()
)
BLOCK_TAGS = frozenset("div p blockquote tr h1 h2 h3 h4 h5 h6 li pre hr".split())
MAX_IMAGE_CHARS = int(8 * 1024 * 1024 * 1.4)
MAX_EMBEDDED = 50 * 1024 * 1024


class Node:
    """An element (``tag``) or a text (``text``)."""

    __slots__ = ("tag", "attrs", "text", "kids", "parent")

    def __init__(self, tag: str | None = None, attrs: dict[str, str] | None = None, text: str = ""):
        self.tag, self.attrs, self.text = tag, attrs or {}, text
        self.kids: list[Node] = []
        self.parent: Node | None = None

    def add(self, kid: Node) -> Node:
        kid.parent = self
        self.kids.append(kid)
        return kid

    def walk(self) -> Iterator[Node]:
        """This node and all below it, in document order; deep trees need no recursion."""
        stack = [self]
        while stack:
            n = stack.pop()
            yield n
            stack.extend(reversed(n.kids))

    def elements(self, *tags: str) -> list[Node]:
        return [n for n in self.walk() if n.tag and n is not self and (not tags or n.tag in tags)]

    @property
    def content(self) -> str:
        return "".join(n.text for n in self.walk() if n.tag is None)

    @property
    def classes(self) -> list[str]:
        return self.attrs.get("class", "").split()

    def replace(self, *others: Node) -> None:
        kids = self.parent.kids
        at = next(i for i, k in enumerate(kids) if k is self)
        for o in others:
            o.parent = self.parent
        kids[at : at + 1] = others

    def remove(self) -> None:
        self.replace()

    def ancestors(self) -> Iterator[Node]:
        n = self.parent
        while n is not None:
            yield n
            n = n.parent

    def html(self) -> str:
        """Inner markup."""
        out: list[str] = []
        stack: list[Node | str] = list(reversed(self.kids))
        while stack:
            n = stack.pop()
            if isinstance(n, str):
                out.append(n)
            elif n.tag is None:
                raw = n.parent is not None and n.parent.tag in ("script", "style")
                out.append(n.text if raw else n.text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace(" ", "&nbsp;"))
            else:
                attrs = "".join(f' {k}="{v.replace("&", "&amp;").replace(chr(34), "&quot;")}"' for k, v in n.attrs.items())
                out.append(f"<{n.tag}{attrs}>")
                if n.tag not in VOID:
                    stack.append(f"</{n.tag}>")
                    stack.extend(reversed(n.kids))
        return "".join(out)


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("div")

    def handle_starttag(self, tag, attrs):
        kid = self.at.add(Node(tag, {k: v or "" for k, v in reversed(attrs)}))
        kid.attrs = dict(reversed(kid.attrs.items()))
        if tag not in VOID:
            self.at = kid

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        n = self.at
        while n is not self.root and n.tag != tag:
            n = n.parent
        if n is not self.root:
            self.at = n.parent

    def handle_data(self, data):
        last = self.at.kids[-1] if self.at.kids else None
        if last is not None and last.tag is None:
            last.text += data
        else:
            self.at.add(Node(text=data))


def parse(markup: str | None) -> Node:
    """The tree of a piece of markup, under a ``div``."""
    b = _Builder()
    b.feed(markup or "")
    b.close()
    return b.root


def strip_tags(markup: str) -> str:
    """text content, trimmed."""
    return parse(markup).content.strip()


_TEXT_STEPS = (
    (re.compile(r"</(?:p|h[1-6])>", re.I), "\n\n"),
    (re.compile(r"</(?:tr|blockquote|div|li)>|<br\s*/?>", re.I), "\n"),
    (re.compile(r"</t[dh]>", re.I), "\t"),
    (re.compile(r"<li[^>]*>", re.I), "• "),
    (re.compile(r"&nbsp;", re.I), " "),
)


def to_text(markup: str) -> str:
    """H1: readable text with paragraphs, cells and list items; pictures as ``[Image: alt]``."""
    for pattern, put in _TEXT_STEPS:
        markup = pattern.sub(put, markup)
    root = parse(markup)
    for img in root.elements("img"):
        img.replace(Node(text=f"[Image: {img.attrs.get('alt') or 'Inline image'}]"))
    return re.sub(r"\n{3,}", "\n\n", root.content).strip()


def safe_link(raw: str) -> str:
    """F7 on a string."""
    raw = raw.strip()
    try:
        parts = urlsplit(raw)
    except ValueError:
        return ""
    if parts.scheme in ("http", "https"):
        return raw if parts.netloc else ""
    return raw if parts.scheme == "mailto" else ""


_PAYLOAD = re.compile(r"data:image/(?:png|jpeg|gif|webp|avif);base64,[a-z0-9+/=\s]+\Z", re.I)
_BLOB = re.compile(r"blob:https://(?:mail\.google\.com|outlook\.(?:live|office|office365)\.com)(?:/|\Z)", re.I)


def safe_image(raw: str) -> str:
    """H3 on a string."""
    if _PAYLOAD.match(raw) and len(raw) < MAX_IMAGE_CHARS or _BLOB.match(raw):
        return raw
    try:
        parts = urlsplit(raw)
        return raw if parts.scheme == "https" and parts.netloc and "@" not in parts.netloc else ""
    except ValueError:
        return ""


def _small(value: str | None) -> bool:
    return bool(value and re.fullmatch(r"\d+(\.\d+)?", value) and 0 < float(value) <= 2)


def _clean_image(n: Node) -> Node | None:
    if _small(n.attrs.get("width")) and _small(n.attrs.get("height")):
        return None
    alt = n.attrs.get("alt") or "Inline image"
    src = safe_image(next((n.attrs[a] for a in ("src", "data-tl-image-src", "data-src") if n.attrs.get(a)), ""))
    if not src:
        return Node(text=f"[Image unavailable: {alt}]")
    attrs = {"data-tl-image-src" if src.startswith("blob:") else "src": src, "alt": alt, "loading": "lazy", "decoding": "async", "referrerpolicy": "no-referrer"}
    attrs |= {a: n.attrs[a] for a in ("width", "height") if re.fullmatch(r"\d{1,5}", n.attrs.get(a, ""))}
    return Node("img", attrs)


def _clean_attrs(n: Node) -> dict[str, str]:
    attrs: dict[str, str] = {}
    styles = []
    for part in n.attrs.get("style", "").split(";"):
        prop, colon, value = part.partition(":")
        prop, value = prop.strip().lower(), value.strip()
        if colon and value and prop in STYLES and not re.search(r"url|expression|var\(|@|[<>\\]", value, re.I):
            styles.append(f"{prop}:{value}")
    if styles:
        attrs["style"] = ";".join(styles)
    if n.tag in ("td", "th"):
        attrs |= {a: n.attrs[a] for a in ("colspan", "rowspan") if re.fullmatch(r"\d{1,3}", n.attrs.get(a, ""))}
    if n.tag == "ol" and re.fullmatch(r"-?\d{1,5}", n.attrs.get("start", "")):
        attrs["start"] = n.attrs["start"]
    if n.tag == "a" and (href := safe_link(n.attrs.get("href", ""))):
        attrs |= {"href": href, "target": "_blank", "rel": "noopener noreferrer"}
    return attrs


def sanitize(markup: str) -> str:
    """H2: the markup with allowed tags, attributes and styles only, without active content, trackers and empty quotes."""
    root = parse(markup)
    for n in root.elements(*DROPPED_TAGS):
        n.remove()
    for n in reversed(root.elements("blockquote")):
        if not n.content.strip() and not n.elements("img"):
            n.remove()
    for n in reversed(root.elements()):
        if n.tag == "img":
            clean = _clean_image(n)
            n.replace(*[clean] if clean else [])
        elif n.tag not in KEPT_TAGS:
            n.replace(*n.kids)
        else:
            n.attrs = _clean_attrs(n)
    return root.html()


def highlight(markup: str, query: str) -> str:
    """H5: sanitised markup with matches marked inside text nodes, so tables and links keep their structure."""
    root = parse(sanitize(markup))
    if query.strip():
        needle = query.lower()
        for n in [n for n in root.walk() if n.tag is None]:
            low, parts, start = n.text.lower(), [], 0
            while (at := low.find(needle, start)) >= 0 and len(low) == len(n.text):
                mark = Node("mark")
                mark.add(Node(text=n.text[at : at + len(query)]))
                parts += [Node(text=n.text[start:at]), mark]
                start = at + len(query)
            if parts:
                n.replace(*[p for p in (*parts, Node(text=n.text[start:])) if p.tag or p.text])
    return root.html()


def image_name(source: str, index: int) -> str:
    """F33 on a string."""
    from urllib.parse import unquote

    try:
        base = re.sub(r"\s+", "-", unquote(urlsplit(source).path.split("/")[-1])) if "://" in source else ""
    except ValueError:
        base = ""
    if re.search(r"\.(png|jpe?g|gif|webp|avif)$", base, re.I) and len(base) <= 80:
        return base
    kind = re.match(r"data:image/([a-z0-9]+)", source, re.I)
    ext = kind[1].lower() if kind else "png"
    return f"image-{index}.{'jpg' if ext == 'jpeg' else ext if ext in ('png', 'gif', 'webp', 'avif') else 'png'}"


def strip_images(markup: str) -> tuple[str, int]:
    """H7: every picture replaced by its file name; and how many there were."""
    root = parse(markup)
    images = root.elements("img")
    for i, img in enumerate(images, 1):
        name = image_name(img.attrs.get("src") or img.attrs.get("data-tl-image-src") or "", i)
        alt = " ".join((img.attrs.get("alt") or "").split())[:120]
        holder = Node("span", {"class": "image-placeholder", "data-image-name": name})
        holder.add(Node(text=f"{name} — {alt}" if alt and alt.lower() != "inline image" else name))
        img.replace(holder)
    return root.html(), len(images)


def embed_images(markup: str, payloads: dict[str, str]) -> tuple[str, int]:
    """H6: pictures replaced by payloads while these fit in the budget; and how many could not be."""
    root, missing, used = parse(markup), 0, 0
    for img in root.elements("img"):
        data = payloads.get(img.attrs.get("src") or img.attrs.get("data-tl-image-src") or "")
        used += len(data or "")
        if data and used <= MAX_EMBEDDED:
            img.attrs["src"] = data
            img.attrs.pop("data-tl-image-src", None)
        else:
            missing += 1
            note = Node("span")
            note.add(Node(text=f" [Image not embedded: {img.attrs.get('alt') or 'inline image'}]"))
            img.replace(img, note)
    return root.html(), missing


def digest(value: str) -> str:
    """two mixed 32-bit hashes over UTF-16 units, in base 36."""
    units = value.encode("utf-16-le", "surrogatepass")
    low, high = 0x811C9DC5, 0x01000193
    for i in range(0, len(units), 2):
        code = units[i] | units[i + 1] << 8
        low = (low ^ code) * 16777619 & 0xFFFFFFFF
        high = (high + code + i // 2) * 2246822519 & 0xFFFFFFFF
    return base36(low) + base36(high)


def base36(n: int) -> str:
    out = ""
    while True:
        n, r = divmod(n, 36)
        out = "0123456789abcdefghijklmnopqrstuvwxyz"[r] + out
        if not n:
            return out


def fold_source(raw: str) -> str:
    """H8: a payload replaced by its digest; every other address as it is."""
    m = re.fullmatch(r"\s*data:([a-z0-9/+.=-]*);base64,([\s\S]*)", raw, re.I)
    return f"data:{m[1]};base64,folded{digest(m[2])}" if m else raw


def fold_images(markup: str) -> str:
    """H9: payloads in picture attributes folded, source sets with payloads emptied; the rest untouched."""
    markup = re.sub(r"(\b(?:src|data-src|data-tl-image-src|href)\s*=\s*)([\"'])(data:[^\"']*)\2", lambda m: f"{m[1]}{m[2]}{fold_source(m[3])}{m[2]}", markup, flags=re.I)
    return re.sub(r"(\bsrcset\s*=\s*)([\"'])([^\"']*data:[^\"']*)\2", r"\1\2\2", markup, flags=re.I)


def fold_snapshot(snapshots):
    """Snapshot rows with the payloads of their markup and picture lists folded."""
    fold = list_map_udf(fold_source)
    return snapshots.withColumns({"html": text_udf(fold_images)(F.col("html")), "image_sources": fold(F.col("image_sources"))})


def image_sources(markup: str) -> list[str]:
    """The address of each picture, in order."""
    return [next((i.attrs[a] for a in ("src", "data-src") if i.attrs.get(a)), "") for i in parse(markup).elements("img")]


def put_sources(markup: str, sources: list[str] | None) -> str:
    """The nth picture gets the nth address; source sets go."""
    root = parse(markup)
    for img, src in zip(root.elements("img"), [*(sources or []), *[""] * len(markup)], strict=False):
        if src:
            img.attrs["src"] = src
        img.attrs.pop("srcset", None)
    return root.html()


def nfkc(text: str) -> str:
    return unicodedata.normalize("NFKC", text)


def _udf(f: Callable[[str], object], kind: T.DataType, arrow: pa.DataType):
    @F.arrow_udf(kind)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([None if t is None else f(t) for t in batch.to_pylist()], arrow)

    return run


def text_udf(f: Callable[[str], str]):
    """A string function as an Arrow-batched column function; null stays null."""
    return _udf(f, T.StringType(), pa.string())


def counted_udf(f: Callable[[str], tuple[str, int]]):
    """The same for a function that returns (html, count)."""
    kind = T.StructType([T.StructField("html", T.StringType()), T.StructField("n", T.IntegerType())])
    return _udf(lambda t: dict(zip(("html", "n"), f(t), strict=True)), kind, pa.struct([("html", pa.string()), ("n", pa.int32())]))


def list_map_udf(f: Callable[[str], str]):
    """A string function over the elements of a list column."""
    return _udf(lambda xs: [None if x is None else f(x) for x in xs], T.ArrayType(T.StringType()), pa.list_(pa.string()))


def list_udf(f: Callable[[str], list[str]]):
    return _udf(f, T.ArrayType(T.StringType()), pa.list_(pa.string()))


__all__ = ["Node", "parse", "to_text", "sanitize", "highlight", "strip_images", "embed_images", "fold_images", "fold_source", "digest", "text_udf", "escape", "unescape"]
