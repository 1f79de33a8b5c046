"""Web pages to text: visible length, metadata, main content, Markdown."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_HIDDEN = r"(?is)<(script|style|noscript|template)\b[^>]*>.*?</(?:script|style|noscript|template)\s*>"


def visible_text(html: Column) -> Column:
    """Without comments, scripts, styles and tags; white space collapsed."""
    out = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?s)<!--.*?-->", " ")
    out = F.regexp_replace(F.regexp_replace(out, _HIDDEN, " "), r"(?s)<[^>]*>", " ")
    return F.trim(F.regexp_replace(out, r"[\s\x{00A0}]+", " "))


def text_length(html: Column) -> Column:
    return F.length(visible_text(html))


def title(html: Column) -> Column:
    found = F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)
    return F.nullif(F.trim(F.regexp_replace(found, r"\s+", " ")), F.lit(""))


def meta(html: Column, name: str) -> Column:
    """Content of the meta element of that name or property."""
    found = F.regexp_extract(html, rf'(?is)<meta\s[^>]*(?:name|property)="{re.escape(name)}"[^>]*content="([^"]*)"', 1)
    back = F.regexp_extract(html, rf'(?is)<meta\s[^>]*content="([^"]*)"[^>]*(?:name|property)="{re.escape(name)}"', 1)
    return F.coalesce(F.nullif(found, F.lit("")), F.nullif(back, F.lit("")))


def metadata(html: Column, url: Column) -> Column:
    """(title, author, date, url), each by the first source that has it."""
    published = F.regexp_extract(html, r'"datePublished"\s*:\s*"([^"]+)"', 1)
    timed = F.regexp_extract(html, r'(?is)<time\s[^>]*datetime="([^"]+)"', 1)
    date = F.coalesce(meta(html, "article:published_time"), meta(html, "date"), F.nullif(published, F.lit("")), F.nullif(timed, F.lit("")))
    heading = F.regexp_extract(html, r"(?is)<h1[^>]*>(.*?)</h1>", 1)
    return F.struct(
        F.coalesce(meta(html, "og:title"), title(html), F.nullif(visible_text(heading), F.lit(""))).alias("title"),
        F.coalesce(meta(html, "author"), meta(html, "article:author")).alias("author"),
        F.substring(date, 1, 10).alias("date"),
        F.coalesce(meta(html, "og:url"), url).alias("url"),
    )


def empty_extraction(body: Column, html: Column, source: int = 20_000, least: int = 200) -> Column:
    """A large page of which hardly any text came out."""
    return (F.length(html) >= source) & (F.length(F.coalesce(body, F.lit(""))) < least)


VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
SKIPPED = frozenset("script style noscript template svg iframe form button select".split())
CHROME = frozenset("nav header footer aside".split())
CHROME_WORDS = re.compile(r"(?i)\b(?:nav|menu|sidebar|footer|cookie|banner|advert|ads?|promo|share|social|breadcrumb|newsletter)\b")


class Element:
    """start: the start tag as it is written; inner: where the source of the content begins and ends (-1: no end tag)."""

    __slots__ = ("attrs", "children", "inner", "parent", "start", "tag")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Element | None):
        self.tag, self.attrs, self.parent, self.children, self.start, self.inner = tag, attrs, parent, [], "", (0, -1)

    def walk(self):
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(c for c in reversed(node.children) if isinstance(c, Element))

    def text(self) -> str:
        out, stack = [], [self]
        while stack:
            node = stack.pop()
            if isinstance(node, str):
                out.append(node)
            elif node.tag not in SKIPPED:
                stack.extend(reversed(node.children))
        return " ".join(" ".join(out).split())


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Element("root", {}, None)

    def handle_starttag(self, tag, attrs):
        node = Element(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.at.children.append(Element(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag):
        node = self.at
        while node.parent is not None and node.tag != tag:
            node = node.parent
        if node.parent is not None:
            self.at = node.parent

    def handle_data(self, data):
        self.at.children.append(data)


def parse(html: str | None) -> Element:
    builder = _Builder()
    builder.feed(html or "")
    builder.close()
    return builder.root


def find_all(root: Element, tag: str | None = None, cls: str | None = None, attr: str | None = None, value: str | None = None) -> list[Element]:
    return [
        e for e in root.walk()
        if e.tag != "root" and (tag is None or e.tag == tag) and (cls is None or cls in e.attrs.get("class", "").split()) and (attr is None or attr in e.attrs and (value is None or e.attrs[attr] == value))
    ]


def strip_chrome(root: Element) -> Element:
    """Without navigation, advertising and interactive parts."""
    for e in list(root.walk()):
        named = CHROME_WORDS.search(e.attrs.get("class", "") + " " + e.attrs.get("id", "") + " " + e.attrs.get("role", ""))
        if e.parent is not None and (e.tag in SKIPPED or e.tag in CHROME or named and e.tag not in ("body", "main", "article")):
            e.parent.children = [c for c in e.parent.children if c is not e]
    return root


#: Tiers of containers; the first tier that has one with text gives the main content.
TIERS = (("article",), ("main",), ("section", "div"), ("body",), ("root",))


def main_content(root: Element, page_title: str = "") -> Element:
    """In the first tier with content the container of most text, more if it holds the page's title."""
    words = {w for w in page_title.lower().split() if len(w) > 3}
    for tier in TIERS:
        found = [e for e in root.walk() if e.tag in tier or e.attrs.get("role") == "main" and "main" in tier]
        scored = [(len(t := e.text()) * (1.5 if words and sum(w in t.lower() for w in words) * 2 >= len(words) else 1.0), -k, e) for k, e in enumerate(found)]
        if scored and max(scored, key=lambda s: s[:2])[0] >= 80:
            return max(scored, key=lambda s: s[:2])[2]
    return root


def grid(table: Element) -> list[list[str]]:
    """Cells of a table as a rectangle; row and column spans repeat their text, both at most 1000."""
    taken: dict[tuple[int, int], str] = {}
    for r, row in enumerate(e for e in table.walk() if e.tag == "tr"):
        c = 0
        for cell in (e for e in row.children if isinstance(e, Element) and e.tag in ("td", "th")):
            while (r, c) in taken:
                c += 1
            number = lambda name, cell=cell: min(1000, max(1, int(v))) if (v := cell.attrs.get(name, "1")).isdigit() else 1
            for i in range(number("rowspan")):
                for j in range(number("colspan")):
                    taken[r + i, c + j] = cell.text()
            c += number("colspan")
    rows = len([e for e in table.walk() if e.tag == "tr"])
    width = max((c for r, c in taken if r < rows), default=-1) + 1
    return [[taken.get((r, c), "") for c in range(width)] for r in range(rows)]


def to_markdown(root: Element) -> str:
    """Headings, paragraphs, lists, links, emphasis, code and tables."""
    out: list[str] = []

    def inline(node: Element | str) -> str:
        if isinstance(node, str):
            return re.sub(r"\s+", " ", node)
        if node.tag in SKIPPED:
            return ""
        if node.tag == "math":
            note = next((e for e in node.walk() if e.tag == "annotation" and "tex" in e.attrs.get("encoding", "").lower()), None)
            raw = note.text() if note is not None else node.attrs.get("alttext") or node.text()
            return f"$${raw}$$" if node.attrs.get("display") == "block" else f"${raw}$"
        inner = "".join(map(inline, node.children))
        if node.tag == "br":
            return "\n"
        if node.tag == "a" and node.attrs.get("href") and inner.strip():
            return f"[{inner.strip()}]({node.attrs['href']})"
        if node.tag == "img" and node.attrs.get("src"):
            return f"![{node.attrs.get('alt', '')}]({node.attrs['src']})"
        sign = {"b": "**", "strong": "**", "i": "*", "em": "*", "code": "`", "del": "~~"}.get(node.tag, "")
        return f"{sign}{inner.strip()}{sign}" if sign and inner.strip() else inner

    def items(node: Element, depth: int) -> list[str]:
        rows = []
        for k, item in enumerate((c for c in node.children if isinstance(c, Element) and c.tag == "li"), 1):
            own = "".join(inline(c) for c in item.children if isinstance(c, str) or c.tag not in ("ul", "ol")).strip()
            rows.append("  " * depth + (f"{k}. " if node.tag == "ol" else "- ") + own)
            for c in item.children:
                if isinstance(c, Element) and c.tag in ("ul", "ol"):
                    rows += items(c, depth + 1)
        return rows

    blocks = frozenset("p h1 h2 h3 h4 h5 h6 ul ol pre table blockquote div section article main body header footer aside nav figure hr root html dl dt dd figcaption".split())

    def block(node: Element, depth: int = 0) -> None:
        if depth > 200:
            out.append(node.text())
            return
        if node.tag in SKIPPED or node.tag == "head":
            return
        if re.fullmatch("h[1-6]", node.tag):
            out.append("#" * int(node.tag[1]) + " " + inline(node).strip())
        elif node.tag == "p":
            out.append(inline(node).strip())
        elif node.tag in ("ul", "ol"):
            out.append("\n".join(items(node, 0)))
        elif node.tag == "pre":
            raw = "".join(c if isinstance(c, str) else c.text() for c in node.children)
            out.append("```\n" + raw.strip("\n") + "\n```")
        elif node.tag == "hr":
            out.append("---")
        elif node.tag == "table":
            rows = [[c.replace("|", "\\|") for c in row] for row in grid(node)]
            if rows and rows[0]:
                out.append("\n".join("| " + " | ".join(r) + " |" for r in (rows[0], ["---"] * len(rows[0]), *rows[1:])))
        else:
            run: list[str] = []
            first = len(out)
            for c in node.children:
                if isinstance(c, Element) and c.tag in blocks:
                    if "".join(run).strip():
                        out.append("".join(run).strip())
                    run = []
                    block(c, depth + 1)
                else:
                    run.append(inline(c))
            if "".join(run).strip():
                out.append("".join(run).strip())
            if node.tag == "blockquote":
                out[first:] = ["\n".join("> " + line for x in out[first:] for line in x.split("\n"))]

    block(root)
    return "\n\n".join(x for x in out if x.strip())


@F.pandas_udf(T.StringType())
def page_markdown(html: pd.Series) -> pd.Series:
    """Whole page, chrome removed, as Markdown."""
    return html.map(lambda h: None if h is None else to_markdown(strip_chrome(parse(h))))


@F.pandas_udf(T.StringType())
def reader_markdown(html: pd.Series) -> pd.Series:
    """Main content as Markdown."""

    def read(h: str | None) -> str | None:
        if h is None:
            return None
        m = re.search(r"(?is)<title[^>]*>(.*?)</title>", h)
        return to_markdown(main_content(strip_chrome(parse(h)), m[1] if m else ""))

    return html.map(read)


class _Placing(_Builder):
    """A builder that notes the source of each element."""

    def __init__(self, html: str):
        super().__init__()
        self.line_starts = [0, *(m.end() for m in re.finditer("\n", html))]
        self.feed(html)
        self.close()

    def place(self) -> int:
        line, column = self.getpos()
        return self.line_starts[line - 1] + column

    def handle_starttag(self, tag, attrs):
        super().handle_starttag(tag, attrs)
        self.written(self.at if self.at.tag == tag and tag not in VOID else self.at.children[-1])

    def handle_startendtag(self, tag, attrs):
        super().handle_startendtag(tag, attrs)
        self.written(self.at.children[-1])

    def written(self, node: Element) -> None:
        node.start = self.get_starttag_text()
        node.inner = (self.place() + len(node.start), -1)

    def handle_endtag(self, tag):
        node = self.at
        super().handle_endtag(tag)
        while node is not self.at and node.tag != tag:
            node = node.parent
        if node is not self.at:
            node.inner = (node.inner[0], self.place())


def element_sources(html: Column, tag: str | None = None, cls: str | None = None, attr: str | None = None, value: str | None = None) -> Column:
    """(start, inner) of the elements of a tag, class or attribute, in the page's order: the start tag and the content as they are written,
    with tags and references; inner is null without an end tag. Null for null."""

    @F.pandas_udf(T.ArrayType(T.StructType([T.StructField("start", T.StringType()), T.StructField("inner", T.StringType())])))
    def found(pages: pd.Series) -> pd.Series:
        source = lambda h, e: {"start": e.start, "inner": h[slice(*e.inner)] if e.inner[1] >= 0 else None}
        return pages.map(lambda h: None if h is None else [source(h, e) for e in find_all(_Placing(h).root, tag, cls, attr, value)])

    return found(html)


def element_texts(html: Column, tag: str | None = None, cls: str | None = None, attr: str | None = None, value: str | None = None) -> Column:
    """The texts of the elements of a tag, class or attribute, in the page's order."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def found(pages: pd.Series) -> pd.Series:
        return pages.map(lambda h: [] if h is None else [e.text() for e in find_all(parse(h), tag, cls, attr, value)])

    return found(html)


#: Marks of pages that scripts build: an almost empty element that a framework fills.
APP_ROOTS = r"""(?is)<div[^>]+id=["'](?:root|app|__next|__nuxt|q-app)["'][^>]*>\s*</div>|<app-root[^>]*>\s*</app-root>|\bdata-reactroot\b|\bng-version="""


def is_application(html: Column, least: int = 200) -> Column:
    """Whether a page is built by scripts: it has the mark of a framework, or hardly any text beside many scripts."""
    scripts = F.regexp_count(html, F.lit(r"(?i)<script\b"))
    return F.coalesce((html.rlike(APP_ROOTS) & (text_length(html) < least)) | ((text_length(html) < least) & (scripts >= 5)), F.lit(False))


_DROPPED = frozenset("script style noscript template iframe object embed canvas svg form button input select textarea dialog".split())
_ADVERTS = re.compile(r"(?i)(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|cookie\w*|consent|popup|modal|newsletter|social|share|related|comments?)(?:$|[\s_-])")
_HIDING = re.compile(r"(?i)display\s*:\s*none|visibility\s*:\s*hidden")


def preprocess(root: Element) -> Element:
    """What a page has for machines or visitors' clicks goes: scripts and interactive parts, hidden elements, advertising, pixels, empty links
    and blocks; lazy images get their address, wrappers of one block give way to it, headings lose their anchors, and relative breaks become spaces."""
    for e in list(root.walk()):
        if e.parent is None:
            continue
        words = f"{e.attrs.get('class', '')} {e.attrs.get('id', '')} {e.attrs.get('role', '')}"
        hidden = "hidden" in e.attrs or e.attrs.get("aria-hidden") == "true" or _HIDING.search(e.attrs.get("style", ""))
        advert = _ADVERTS.search(words) and e.tag not in ("html", "body", "main", "article")
        pixel = e.tag == "img" and e.attrs.get("width") in ("0", "1") and e.attrs.get("height") in ("0", "1")
        if e.tag in _DROPPED or hidden or advert or pixel:
            e.parent.children = [c for c in e.parent.children if c is not e]
        elif e.tag == "img":
            late = e.attrs.get("data-src") or e.attrs.get("data-original") or (e.attrs.get("data-srcset", "").split() or [""])[0]
            if late and (not e.attrs.get("src") or e.attrs["src"].startswith("data:")):
                e.attrs["src"] = late
    _prune(root)
    return root


def _prune(root: Element) -> None:
    """Without links and blocks that hold nothing, from the leaves up; permalinks inside headings go, wrappers of a single block are left out."""
    for e in reversed(list(root.walk())):
        if e.parent is None:
            continue
        media = any(x.tag in ("img", "video", "audio", "table", "br", "hr") for x in e.walk())
        if not media and not e.text() and e.tag in ("a", "p", "div", "span", "section", "li", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6", "b", "i", "em", "strong"):
            e.parent.children = [c for c in e.parent.children if c is not e]
        elif e.tag == "a" and re.fullmatch(r"h[1-6]", e.parent.tag) and e.text() in ("#", "\u00b6", "\U0001f517"):
            e.parent.children = [c for c in e.parent.children if c is not e]
        elif e.tag == "div" and e.parent.tag == "div" and len([c for c in e.parent.children if isinstance(c, Element) or c.strip()]) == 1:
            for c in e.children:
                if isinstance(c, Element):
                    c.parent = e.parent
            e.parent.children = list(e.children)


@F.pandas_udf(T.StringType())
def clean_markdown(html: pd.Series) -> pd.Series:
    """The page after preprocess(), as Markdown; navigation and such stay."""
    return html.map(lambda h: None if h is None else to_markdown(preprocess(parse(h))))


@F.pandas_udf(T.ArrayType(T.ArrayType(T.ArrayType(T.StringType()))))
def html_tables(html: pd.Series) -> pd.Series:
    """All tables as grids, spans filled."""
    return html.map(lambda h: [] if h is None else [grid(t) for t in find_all(parse(h), "table")])


@F.pandas_udf(T.StringType())
def normal_math(md: pd.Series) -> pd.Series:
    r"""\( \) and \[ \] as $ and $$, outside code."""

    def change(text: str | None) -> str | None:
        if text is None:
            return None
        parts = re.split(r"(```.*?```|`[^`\n]*`)", text, flags=re.S)
        for k in range(0, len(parts), 2):
            parts[k] = re.sub(r"\\\[(.+?)\\\]", r"$$\1$$", parts[k], flags=re.S)
            parts[k] = re.sub(r"\\\((.+?)\\\)", r"$\1$", parts[k], flags=re.S)
        return "".join(parts)

    return md.map(change)


@F.pandas_udf(T.StringType())
def linked_to(html: pd.Series, base: pd.Series) -> pd.Series:
    """Relative href and src values made absolute."""
    from urllib.parse import urljoin

    def change(h: str | None, b: str | None) -> str | None:
        return None if h is None else re.sub(r'((?:href|src)=")([^"]*)(")', lambda m: m[1] + urljoin(b or "", m[2]) + m[3], h)

    return pd.Series([change(h, b) for h, b in zip(html, base, strict=True)])


def tidy_markdown(md: Column) -> Column:
    """Blank runs collapsed, trailing blanks, attribute braces and empty headings removed; fences stay as they are."""
    def clean(text: Column) -> Column:
        out = F.regexp_replace(text, r"(?m)[ \t]+$", "")
        out = F.regexp_replace(out, r"(?m)^#{1,6}[ \t]*$\n?", "")
        out = F.regexp_replace(out, r"\{[:.#][^}\n]*\}", "")
        return F.regexp_replace(out, r"\n{3,}", "\n\n")

    code = F.regexp_extract_all(md, F.lit(r"(?ms)(^```.*?^```[ \t]*$)"), F.lit(1))
    rest = F.split(md, r"(?ms)^```.*?^```[ \t]*$")
    woven = F.zip_with(F.transform(rest, clean), code, lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    return F.regexp_replace(F.array_join(woven, ""), r"^\s+|\s+$", "")
