"""HTML readers that need a parser: links and markdown; and text of simple PDFs. Run in Arrow batches."""

from __future__ import annotations

import re
import zlib
from html.parser import HTMLParser
from urllib.parse import urldefrag, urljoin

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import sliced

LINKS = "array<struct<anchor: string, url: string>>"
_LINK_TYPE = pa.list_(pa.struct([("anchor", pa.string()), ("url", pa.string())]))
_NO_PAGE = ("#", *(f"{scheme}:" for scheme in ("tel", "mailto", "javascript")))


class _Anchors(HTMLParser):
    """(text, href) of each closed anchor: its first href that isn't empty; one inside another starts anew."""

    def __init__(self):
        HTMLParser.__init__(self)
        self.found: list[tuple[str, str]] = []
        self.href: str | None = None
        self.words: list[str] = []

    def handle_starttag(self, tag, attrs):
        href = next((v for k, v in attrs if k == "href" and v), None) if tag == "a" else None
        if href:
            self.href, self.words = href, []

    def handle_endtag(self, tag):
        if tag == "a" and self.href is not None:
            self.found.append((" ".join("".join(self.words).split()), self.href))
            self.href = None

    def handle_data(self, data):
        if self.href is not None:
            self.words.append(data)


def links_of(html: str | None, base: str | None) -> list[tuple[str, str]] | None:
    """Absolute http(s) links of a page in order, each URL with its first anchor text; None if a link can't be resolved."""
    if not html:
        return []
    parser = _Anchors()
    try:
        parser.feed(html)
        parser.close()
        first: dict[str, str] = {}
        for text, href in parser.found:
            if not href.startswith(_NO_PAGE):
                url = urldefrag(urljoin(base or "", href)).url
                if re.match("https?://", url):
                    first.setdefault(url, text)
    except (ValueError, AssertionError):
        return None
    return [(t, u) for u, t in first.items()]


@F.arrow_udf(T.ArrayType(T.StructType([T.StructField("anchor", T.StringType()), T.StructField("url", T.StringType())])))
@sliced
def extract_links(html: pa.Array, base: pa.Array) -> pa.Array:
    """``links_of`` each page; null where a link of the page can't be resolved."""
    rows = (links_of(h, b) for h, b in zip(html.to_pylist(), base.to_pylist()))
    return pa.array([None if r is None else [{"anchor": a, "url": u} for a, u in r] for r in rows], _LINK_TYPE)


_BLOCKS = {"p", "div", "section", "article", "main", "header", "footer", "nav", "aside", "ul", "ol", "table", "form", "blockquote", "figure", "dl", "dt", "dd", "fieldset", "address"}


class _Markdown(HTMLParser):
    def __init__(self):
        HTMLParser.__init__(self)
        self.out: list[str] = []
        self.skip = 0
        self.lists: list[list] = []
        self.pre = 0
        self.href: list[tuple[str, int]] = []
        self.row: list[str] | None = None
        self.rows = 0

    def gap(self, n: int = 2) -> None:
        if n > 1 or not (self.out and self.out[-1].endswith("\0")):
            self.out.append("\0" * n)

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag in ("script", "style", "noscript", "template"):
            self.skip += 1
        elif re.fullmatch("h[1-6]", tag):
            self.gap()
            self.out.append("#" * int(tag[1]) + " ")
        elif tag == "br":
            self.gap(1)
        elif tag == "hr":
            self.out.append("\0\0---\0\0")
        elif tag in ("ul", "ol"):
            self.gap(1 if self.lists else 2)
            self.lists.append([tag, 0])
        elif tag == "li":
            self.gap(1)
            level = self.lists[-1] if self.lists else ["ul", 0]
            level[1] += 1
            self.out.append("  " * max(0, len(self.lists) - 1) + (f"{level[1]}. " if level[0] == "ol" else "* "))
        elif tag == "pre":
            self.pre += 1
            self.out.append("\0\0```\0")
        elif tag in ("b", "strong"):
            self.out.append("**")
        elif tag in ("i", "em"):
            self.out.append("*")
        elif tag == "code" and not self.pre:
            self.out.append("`")
        elif tag == "img":
            self.out.append(f"![{a.get('alt') or ''}]({a.get('src') or ''})")
        elif tag == "a" and a.get("href"):
            self.href.append((a["href"], len(self.out)))
        elif tag == "tr":
            self.gap(1)
            self.row = []
        elif tag in ("td", "th") and self.row is not None:
            self.out.append("| ")
            self.row.append(tag)
        elif tag in _BLOCKS:
            if tag == "table":
                self.rows = 0
            self.gap()

    def handle_endtag(self, tag):
        if tag in ("script", "style", "noscript", "template"):
            self.skip = max(0, self.skip - 1)
        elif re.fullmatch("h[1-6]", tag) or tag in _BLOCKS:
            if tag in ("ul", "ol") and self.lists:
                self.lists.pop()
            self.gap(1 if tag in ("ul", "ol") and self.lists else 2)
        elif tag == "pre":
            self.pre = max(0, self.pre - 1)
            self.out.append("\0```\0\0")
        elif tag in ("b", "strong"):
            self.out.append("**")
        elif tag in ("i", "em"):
            self.out.append("*")
        elif tag == "code" and not self.pre:
            self.out.append("`")
        elif tag == "a" and self.href:
            href, at = self.href.pop()
            text = "".join(self.out[at:]).replace("\0", " ").strip()
            self.out[at:] = [f"[{text}]({href})"] if text else []
        elif tag in ("td", "th"):
            self.out.append(" ")
        elif tag == "tr" and self.row is not None:
            self.out.append("|")
            self.rows += 1
            if self.rows == 1 and self.row:
                self.out.append("\0" + "| --- " * len(self.row) + "|")
            self.row = None

    def handle_data(self, data):
        if self.skip:
            return
        if self.pre:
            self.out.append(data.replace("\n", "\0"))
            return
        text = re.sub(r"\s+", " ", data)
        if self.out and self.out[-1].endswith(("\0", " ")) or not self.out:
            text = text.lstrip(" ")
        self.out.append(text)


def markdown_of(html: str) -> str:
    """Headings, lists, tables, links, images, emphasis, code; blocks apart by one blank line."""
    parser = _Markdown()
    parser.feed(html)
    parser.close()
    text = re.sub(r" *(\0+) *(?=\0|$)", r"\1", "".join(parser.out))
    text = re.sub(r"[ ]*\0{2,}", "\n\n", text)
    return re.sub(r"[ ]*\0", "\n", text).strip()


def pdf_text(data: bytes) -> str:
    """The strings that a PDF's plain or deflated content streams show; enough for PDFs with simple fonts."""
    lines = []
    for stream in re.findall(rb"stream\r?\n(.*?)\r?\nendstream", data, re.S):
        try:
            stream = zlib.decompress(stream)
        except zlib.error:
            pass
        for shown in re.findall(rb"\[((?:[^\[\]\\]|\\.)*)\]\s*TJ|(\((?:[^()\\]|\\.)*\))\s*(?:Tj|')", stream, re.S):
            parts = re.findall(rb"\(((?:[^()\\]|\\.)*)\)", shown[0] or shown[1], re.S)
            text = re.sub(rb"\\([nrtbf()\\])", lambda m: {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"", b"f": b""}.get(m[1], m[1]), b"".join(parts))
            lines.append(text.decode("latin-1"))
    return "\n".join(lines)


def read_document(data: bytes | str | None, content_type: str | None) -> str:
    if not data:
        return ""
    if "pdf" in (content_type or "").lower():
        return pdf_text(data if isinstance(data, bytes) else data.encode("latin-1", "replace"))
    return markdown_of(data.decode("utf-8", "replace") if isinstance(data, bytes) else data)


@F.arrow_udf(T.StringType())
@sliced
def to_markdown(content: pa.Array, content_type: pa.Array) -> pa.Array:
    """Markdown of HTML or PDF bodies (strings or bytes); null where a body breaks the reader."""
    out = []
    for data, kind in zip(content.to_pylist(), content_type.to_pylist()):
        try:
            out.append(read_document(data, kind))
        except Exception:  # noqa: BLE001 - one page's failure costs that page only
            out.append(None)
    return pa.array(out, pa.string())
