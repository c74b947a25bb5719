"""Pages to text lines, tables, links and metadata: a small DOM per page in Arrow batches, the rest in Catalyst."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape
from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = {"script", "style", "noscript"}
LINES = {"h1", "h2", "h3", "h4", "p", "li", "td", "th", "span", "div"}
HEADS = {"h1", "h2", "h3", "h4", "h5"}

#: What can be asked of a page, with its Spark and its Arrow type.
_TABLE = pa.struct([("title", pa.string()), ("headers", pa.list_(pa.string())), ("rows", pa.list_(pa.list_(pa.string())))])
PARTS = {
    "title": ("string", pa.string()),
    "title_source": ("string", pa.string()),
    "text": ("string", pa.string()),
    "tables": ("array<struct<title:string,headers:array<string>,rows:array<array<string>>>>", pa.list_(_TABLE)),
    "links": ("array<struct<text:string,url:string>>", pa.list_(pa.struct([("text", pa.string()), ("url", pa.string())]))),
    "meta": ("array<struct<name:string,content:string>>", pa.list_(pa.struct([("name", pa.string()), ("content", pa.string())]))),
}
#: Pages and their characters that are passed on at once.
PAGES, CHARS = 1000, 1 << 21

#: Plain markup, of which most pages consist: text, tags with attributes in double quotes, comments, scripts and styles.
_PLAIN = re.compile(
    r"""([^<]+)|</([a-zA-Z][a-zA-Z0-9]*)>|<(script|style)((?:[ \t\n]+[a-zA-Z][-a-zA-Z0-9_:]*="[^"<>&]*")*)>((?:(?!(?i:</\3)|<!--).)*+)</\3>
    |<([a-zA-Z][a-zA-Z0-9]*)((?:[ \t\n]+[a-zA-Z][-a-zA-Z0-9_:]*="[^"<>&]*")*)[ \t\n]*(/?)>|<!--[^<>]*-->|<!(?:DOCTYPE|doctype)[ ][a-zA-Z]+>""",
    re.DOTALL | re.VERBOSE,
)
_ATTRIBUTE = re.compile(r'([a-zA-Z][-a-zA-Z0-9_:]*)="([^"]*)"')
#: Tags in which markup may be text; the parser of the standard library knows them.
_OTHER = set("script style title textarea xmp iframe noembed noframes noscript plaintext svg math".split())
_TITLE = re.compile(r"<title\b[^>]*>(.*?)</title", re.DOTALL | re.IGNORECASE)


class _Page:
    """The elements of a page in document order, as columns: what is in an element are the elements and strings of a range.

    Strings are held twice: all of them, and those that no hidden element is around.
    """

    __slots__ = ("attrs", "every", "every_from", "every_to", "hidden", "hides", "kept", "last", "opened", "shown", "shown_from", "shown_to", "stack", "tags", "to", "upper", "within")

    def __init__(self) -> None:
        self.tags, self.attrs, self.upper, self.to, self.hidden, self.kept = [], {}, [], [], [], []
        self.shown, self.shown_from, self.shown_to, self.every, self.hides, self.every_from, self.every_to = [], [], [], [], [], [], []
        self.stack, self.opened, self.within, self.last = [], Counter(), [-1], {}

    def start(self, tag: str, attrs: dict | None, stays: bool) -> None:
        n, upper = len(self.tags), self.stack[-1] if self.stack else -1
        self.tags.append(tag)
        if attrs:
            self.attrs[n] = attrs
        self.upper.append(upper)
        self.kept.append(self.last.get(upper, -1))
        if tag in HEADS:
            self.last[upper] = n
        inner = n if tag in HIDDEN else self.within[-1]
        self.hidden.append(inner)
        self.to.append(n + 1)
        at, all_at = len(self.shown), len(self.every)
        self.shown_from.append(at)
        self.shown_to.append(at)
        self.every_from.append(all_at)
        self.every_to.append(all_at)
        if stays:
            self.stack.append(n)
            self.within.append(inner)
            self.opened[tag] += 1

    def end(self, tag: str) -> None:
        if self.opened[tag]:
            while self._close() != tag:
                pass

    def _close(self) -> str:
        n = self.stack.pop()
        self.within.pop()
        self.to[n], self.shown_to[n], self.every_to[n] = len(self.tags), len(self.shown), len(self.every)
        self.opened[self.tags[n]] -= 1
        return self.tags[n]

    def data(self, text: str) -> None:
        text = text.strip()
        inner = self.within[-1]
        if inner < 0:
            self.shown.append(text)
        self.every.append(text)
        self.hides.append(inner)

    def close(self) -> None:
        while self.stack:
            self._close()

    def text(self, n: int) -> str:
        """An element's text, without that of hidden elements in it."""
        if self.hidden[n] < 0:
            return "".join(self.shown[self.shown_from[n] : self.shown_to[n]])
        a, b = self.every_from[n], self.every_to[n]
        return "".join(s for s, h in zip(self.every[a:b], self.hides[a:b], strict=True) if h <= n)

    def whole_text(self, n: int) -> str:
        return "".join(self.every[self.every_from[n] : self.every_to[n]])

    def among(self, n: int, *tags: str) -> list[int]:
        """The elements in an element that have one of the tags."""
        return [k for k in range(n + 1, self.to[n]) if self.tags[k] in tags]

    def first(self, n: int, tag: str) -> int | None:
        return next((k for k in range(n + 1, self.to[n]) if self.tags[k] == tag), None)


class _Tree(HTMLParser):
    def __init__(self, page: _Page) -> None:
        super().__init__(convert_charrefs=True)
        self.page = page

    def handle_starttag(self, tag, attrs):
        self.page.start(tag, {k: v or "" for k, v in attrs}, tag not in VOID)

    def handle_startendtag(self, tag, attrs):
        self.page.start(tag, {k: v or "" for k, v in attrs}, False)

    def handle_endtag(self, tag):
        self.page.end(tag)

    def handle_data(self, data):
        self.page.data(data)


def _plain_page(html: str) -> _Page | None:
    """The page if its markup is plain throughout, as the parser of the standard library reads it; else none."""
    page, at = _Page(), 0
    title = False
    for m in _PLAIN.finditer(html):
        if m.start() != at:
            return None
        at = m.end()
        text, ended, raw, _, inside, tag, attrs, single = m.groups()
        if text is not None:
            page.data(unescape(text) if "&" in text else text)
        elif ended is not None:
            ended = ended.lower()
            if title and ended != "title":
                return None
            title = False
            page.end(ended)
        elif tag is not None:
            tag = tag.lower()
            if title or (tag in _OTHER and (tag != "title" or single)):
                return None
            title = tag == "title"
            found = {k.lower(): v for k, v in _ATTRIBUTE.findall(attrs)} if attrs and tag in ("a", "meta") else None
            page.start(tag, found, not single and tag not in VOID)
        elif raw is not None:
            if title:
                return None
            page.start(raw, None, True)
            if inside:
                page.data(inside)
            page.end(raw)
        elif title:
            return None
    return page if at == len(html) and not title else None


def read_page(html: str) -> _Page:
    page = _plain_page(html)
    if page is None:
        page = _Page()
        tree = _Tree(page)
        tree.feed(html)
        tree.close()
    page.close()
    return page


def _table(page: _Page, n: int) -> dict | None:
    head = page.first(n, "thead")
    if head is not None:
        row = page.first(head, "tr")
    else:
        row = next((r for r in page.among(n, "tr") if page.first(r, "th") is not None), None)
    headers = [] if row is None else [page.text(c) for c in page.among(row, "th", "td")]
    body = page.first(n, "tbody")
    rows = [cells for r in page.among(n if body is None else body, "tr") if (cells := [page.text(c) for c in page.among(r, "td")])]
    if not rows:
        return None
    if len(headers) != len(rows[0]):
        headers = [str(k) for k in range(max(map(len, rows)))]
    if any(len(r) > len(headers) for r in rows):
        return None
    heading = page.kept[n]
    if heading < 0 and page.upper[n] >= 0:
        heading = page.kept[page.upper[n]]
    return {"title": page.text(heading) if heading >= 0 else None, "headers": headers, "rows": [r + ["None"] * (len(headers) - len(r)) for r in rows]}


def _links(page: _Page, url: str) -> list[dict]:
    links = []
    for n, tag in enumerate(page.tags):
        if tag != "a" or "href" not in (attrs := page.attrs.get(n, {})):
            continue
        href, text = attrs["href"], page.text(n)
        if not text:
            continue
        if not href.startswith(("http://", "https://", "mailto:")):
            try:
                href = urljoin(url, href)
            except ValueError:
                continue
        if href.startswith("http"):
            links.append({"text": text[:128], "url": href})
            if len(links) == 50:
                break
    return links


def _meta(page: _Page) -> list[dict]:
    meta = {}
    for n, attrs in page.attrs.items():
        if page.tags[n] == "meta":
            name = attrs.get("name") or attrs.get("property")
            if name and attrs.get("content"):
                meta[name] = attrs["content"][:256]
    return [{"name": k, "content": v} for k, v in sorted(meta.items())]


def _title(page: _Page) -> str:
    n = next((k for k, tag in enumerate(page.tags) if tag == "title"), None)
    return "Untitled Page" if n is None else page.whole_text(n)


def _title_source(html: str, title: str) -> str:
    """The title as it is written, with its character references."""
    return next((s for m in _TITLE.finditer(html) if unescape(s := m[1].strip()) == title), title)


def parse(html: str, url: str, parts: tuple[str, ...] = tuple(PARTS)) -> dict:
    """The asked parts of a page, and its lines with the text that is made of them."""
    page, out = read_page(html), {}
    if "title" in parts or "title_source" in parts:
        out["title"] = _title(page)
    if "title_source" in parts:
        out["title_source"] = _title_source(html, out["title"])
    if "text" in parts:
        out["lines"] = [t for n, tag in enumerate(page.tags) if tag in LINES and page.hidden[n] < 0 and len(t := page.text(n)) > 1]
        out["text"] = "\n".join(dict.fromkeys(out["lines"]))
    if "tables" in parts:
        out["tables"] = [t for n, tag in enumerate(page.tags) if tag == "table" and page.hidden[n] < 0 and (t := _table(page, n))]
    if "links" in parts:
        out["links"] = _links(page, url)
    if "meta" in parts:
        out["meta"] = _meta(page)
    return out


def parse_pages(pages: DataFrame, *asked: str) -> DataFrame:
    """pages (page_id, url, html) -> page_id, url and what is asked of title, title_source, text (the distinct lines), word_count, tables, links, meta and content_hash; by default all.

    Only what is asked is made. Pages are passed on a few at a time, whatever the size of a batch.
    """
    wanted = asked or ("title", "text", "word_count", "tables", "links", "meta", "content_hash")
    parts = tuple(p for p in PARTS if p in wanted or (p == "text" and "word_count" in wanted))
    words = F.size(F.filter(F.split("text", r"(?U)\s+"), lambda w: w != "")).cast("long").alias("word_count")
    hashed = [F.sha2(F.coalesce("html", F.lit("")), 256).alias("content_hash")] if "content_hash" in wanted else []
    if not parts:
        return pages.select("page_id", "url", *hashed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(batch: pa.RecordBatch, found: list[dict]) -> pa.RecordBatch:
            kept = [batch.column(k) for k in range(batch.num_columns) if k != 2]
            names = [n for k, n in enumerate(batch.schema.names) if k != 2]
            return pa.RecordBatch.from_arrays([*kept, *[pa.array([f[p] for f in found], PARTS[p][1]) for p in parts]], [*names, *parts])

        for batch in batches:
            at, size, found = 0, 0, []
            for k in range(batch.num_rows):
                html, url = batch.column(2)[k].as_py() or "", batch.column(1)[k].as_py() or ""
                found.append(parse(html, url, parts))
                size += len(html)
                if len(found) >= PAGES or size >= CHARS:
                    yield told(batch.slice(at, k + 1 - at), found)
                    at, size, found = k + 1, 0, []
            if found:
                yield told(batch.slice(at), found)

    given = pages.select("page_id", "url", "html", *hashed)
    shape = ", ".join([f"page_id {given.schema['page_id'].dataType.simpleString()}", "url string", *["content_hash string"] * len(hashed), *[f"{p} {PARTS[p][0]}" for p in parts]])
    return given.mapInArrow(run, shape).select("page_id", "url", *[words if c == "word_count" else c for c in wanted])


def concat_pages(pages: DataFrame) -> DataFrame:
    """pages (doc_id, page, text) -> (doc_id, n_pages, text, word_count): a document's pages in order with an empty line between them."""
    held = pages.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page", F.coalesce("text", F.lit("")).alias("text")))).alias("x"))
    text = F.array_join(F.transform("x", lambda p: p["text"]), "\n\n")
    words = F.size(F.filter(F.split(text, r"(?U)\s+"), lambda w: w != ""))
    return held.select("doc_id", F.size("x").alias("n_pages"), text.alias("text"), words.cast("long").alias("word_count"))
