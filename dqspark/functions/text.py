"""Scalar text functions: URLs, ids, sentences, front matter, links, sections."""

from __future__ import annotations

import re
import unicodedata
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMES = ("http", "https", "mailto")


def clean(col: Column) -> Column:
    """White space collapsed, ends trimmed."""
    return F.trim(F.regexp_replace(col, r"[\s\p{Z}]+", " "))


def _first(col: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(col, pattern, group), F.lit(""))


def host(url: Column) -> Column:
    return F.lower(_first(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)"))


def registrable(url: Column) -> Column:
    """The last two labels of the host, three below a second-level country label."""
    h = host(url)
    return F.coalesce(_first(h, r"([^.]+\.(?:co|com|org|net|ac|gov)\.[a-z]{2})$"), _first(h, r"([^.]+\.[^.]+)$"), h)


def source_of(url: Column, sources: dict[str, tuple[str, ...]]) -> Column:
    """Name of the source whose host list holds the url's host or a parent of it."""
    h, out = host(url), F.lit(None).cast("string")
    for name, hosts in sources.items():
        fits = F.lit(False)
        for x in hosts:
            fits = fits | (h == x) | h.endswith("." + x)
        out = F.when(fits, name).otherwise(out)
    return out


#: Well-known video, post and podcast addresses, from their public url forms.
VIDEO_ID = r"(?:youtube\.com/(?:watch\?(?:[^#]*&)?v=|embed/|shorts/|live/)|youtu\.be/)([A-Za-z0-9_\-]{11})"
VIMEO_ID = r"vimeo\.com/(?:video/)?([0-9]+)"
POST_ID = r"(?:twitter|x)\.com/[^/]+/status/([0-9]+)"


def media_id(url: Column) -> Column:
    return F.coalesce(_first(url, VIDEO_ID), _first(url, VIMEO_ID), _first(url, POST_ID))


def embed_host(url: Column) -> Column:
    return source_of(url, {"youtube": ("youtube.com", "youtu.be"), "vimeo": ("vimeo.com",), "loom": ("loom.com",), "wistia": ("wistia.com", "wistia.net")})


def lesson_url(url: Column) -> Column:
    """(group, course, lesson) of addresses like host/group/classroom/course?md=lesson."""
    pattern = r"^https?://[^/]+/([^/?#]+)/classroom/([^/?#]+)(?:\?(?:[^#]*&)?md=([^&#]+))?"
    return F.struct(*[_first(url, pattern, k).alias(n) for k, n in enumerate(("group", "course", "lesson"), 1)])


def resources(raw: Column) -> Column:
    """A JSON list of {title, link, file_name}."""
    return F.from_json(raw, "array<struct<title:string,link:string,file_name:string>>")


def url_date(url: Column) -> Column:
    """Month of an arXiv-style id (YYMM.NNNNN) in the url, as YYYY-MM."""
    yy, mm = _first(url, r"/(?:abs|pdf|html)/(\d{2})\d{2}\.\d{4,5}"), _first(url, r"/(?:abs|pdf|html)/\d{2}(0[1-9]|1[0-2])\.\d{4,5}")
    return F.when(yy.isNotNull() & mm.isNotNull(), F.concat(F.lit("20"), yy, F.lit("-"), mm))


def unwrapped(url: Column) -> Column:
    """The target of a tracking redirect: a redirecting path and a parameter that holds a whole address."""
    target = _first(url, r"[?&](?:url|u|target|dest|redirect|to)=(https?(?:%3A|:)[^&#]+)")
    return F.when(url.rlike(r"(?i)/(?:redirect|redir|click|track|out|l\.php|link)\b") & target.isNotNull(), F.url_decode(target)).otherwise(url)


def compact_date(raw: Column) -> Column:
    """20240131 as 2024-01-31; null if it is no date."""
    return F.date_format(F.to_date(F.try_to_timestamp(F.when(raw.rlike(r"^\d{8}$"), raw), F.lit("yyyyMMdd"))), "yyyy-MM-dd")


def tolerant_int(raw: Column) -> Column:
    return F.trim(raw).try_cast("int")


def without_data_images(md: Column) -> Column:
    return F.regexp_replace(md, r"!\[[^\]]*\]\(data:[^)]*\)", "")


def clean_image_alts(md: Column) -> Column:
    return F.regexp_replace(md, r"!\[([^\]<]*)<[^>]*>([^\]]*)\]", "![$1$2]")


def size_tier(changed: Column, before: Column) -> Column:
    """small, medium or large by changed lines and their share of the section."""
    share = F.coalesce(F.try_divide(changed, before), F.lit(1.0))
    return F.when((changed <= 3) & (share <= 0.25), "small").when((changed <= 15) & (share <= 0.5), "medium").otherwise("large")


def reference_name(ref: Column) -> Column:
    """The last part of a qualified or slashed name, without a leading slash and in lower case."""
    return F.lower(F.element_at(F.split(F.regexp_replace(F.trim(ref), r"^/+|/+$", ""), r"[:/]"), -1))


def path_matches(path: Column, name: str) -> Column:
    """Whether a whole segment of the path is the name."""
    return F.array_contains(F.split(path, "/"), name)


def file_role(path: Column) -> Column:
    suffix = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    return (
        F.when(suffix.isin("vtt", "srt", "ttml"), "captions").when(suffix.isin("md", "txt", "rst"), "prose").when(suffix.isin("pdf", "docx", "pptx", "xlsx"), "document")
        .when(suffix.isin("png", "jpg", "jpeg", "gif", "svg", "webp"), "image").when(suffix.isin("mp3", "mp4", "wav", "m4a", "webm"), "media")
        .when(suffix.isin("json", "yaml", "yml", "csv"), "data").otherwise("other")
    )


def grouping(name: Column) -> Column:
    """How a file name groups: prefix (a number first), base (name before a dash or underscore suffix), flat."""
    return F.when(name.rlike(r"^\d+[\s_.\-]"), "prefix").when(name.rlike(r"^[^_\-.]+[_\-][^.]+"), "base").otherwise("flat")


def group_key(name: Column) -> Column:
    return F.coalesce(_first(name, r"^(\d+)[\s_.\-]"), _first(name, r"^([^_\-.]+)[_\-]"), name)


def unsafe_name(name: Column) -> Column:
    """Names that could leave their folder or break a line."""
    return name.isNull() | (F.trim(name) == "") | name.rlike(r"[/\\\x00-\x1F\x7F]") | name.isin(".", "..") | name.startswith(".")


ABBREVIATIONS = ("e.g.", "i.e.", "etc.", "vs.", "mr.", "mrs.", "dr.", "prof.", "st.", "no.", "fig.", "cf.")
SENTENCE_CHARS = 200


def first_sentence(text: Column) -> Column:
    """Up to the first . ! or ? before white space that ends no abbreviation, else the first 200 characters."""
    flat = clean(text)
    # abbreviations give up their points while the end is looked for
    masked = flat
    for a in ABBREVIATIONS:
        masked = F.regexp_replace(masked, rf"(?i)(?<![A-Za-z]){re.escape(a[:-1])}\.", a[:-1].replace(".", "\x01") + "\x01")
    end = F.regexp_instr(masked, F.lit(r"[.!?](?:\s|$)"))
    return F.when(end > 0, F.substring(flat, F.lit(1), end)).otherwise(F.substring(flat, 1, SENTENCE_CHARS))


def page_summary(description: Column, body: Column) -> Column:
    """One line about a page: its description, else the first sentence of its summary section, else of its first plain paragraph."""
    lines = F.filter(F.split(F.regexp_replace(body, r"(?s)^---\r?\n.*?\r?\n---\s*(?:\r?\n|$)", ""), r"\r?\n"), lambda x: ~x.rlike(r"^\s*(?:#|[-*+>|]|\d+\.|$)"))
    summary = F.nullif(clean(section(body, "Summary")), F.lit(""))
    return F.coalesce(F.nullif(clean(description), F.lit("")), first_sentence(summary), first_sentence(F.get(lines, F.lit(0))), F.lit(""))


#: Our own words that promise nothing, and marks of unfinished text.
WEAK = r"(?i)\b(?:should|could|might|maybe|perhaps|usually|generally|try to|if possible|as needed|appropriate(?:ly)?)\b"
PLACEHOLDER = r"(?i)\b(?:TODO|TBD|FIXME|XXX)\b|<(?:your|insert)[^>\n]*>|\[(?:placeholder|insert[^\]\n]*)\]|lorem ipsum"
WINDOWS_PATH = r"\b[A-Za-z]:\\[^\s`'\"]+|(?:[\w.-]+\\){1,8}[\w.-]+\.\w{1,5}\b"


def structure_gaps(text: Column, sections: tuple[str, ...]) -> Column:
    """What a document lacks or should not have, as an array of (gap, detail, line): missing sections, weak words, placeholders, backslash paths.

    Fenced code is not looked at; line is that of the match, null for a missing section.
    """
    body = F.regexp_replace(text, r"(?ms)^```.*?^```[ \t]*$", "")
    lines = F.split(F.regexp_replace(text, r"\r\n?", "\n"), "\n")
    gap = lambda kind, detail, line: F.struct(F.lit(kind).alias("gap"), detail.alias("detail"), line.alias("line"))
    none = F.lit(None).cast("int")
    missing = [F.when(~F.coalesce(body.rlike(rf"(?mi)^#{{1,6}}[ \t]+{re.escape(s)}\b"), F.lit(False)), gap("section", F.lit(s), none)) for s in sections]
    step = lambda acc, line: F.struct((acc["open"] != line.rlike(r"^\s{0,3}```")).alias("open"), F.concat(acc["out"], F.array(F.when(acc["open"] | line.rlike(r"^\s{0,3}```"), F.lit("")).otherwise(line))).alias("out"))
    prose = F.aggregate(lines, F.struct(F.lit(False).alias("open"), F.array().cast("array<string>").alias("out")), step, lambda acc: acc["out"])
    numbered = F.transform(prose, lambda line, k: F.struct(line.alias("line"), (k + 1).alias("k")))
    marks = lambda kind, pattern: F.flatten(F.transform(numbered, lambda x: F.transform(F.regexp_extract_all(x["line"], F.lit(f"({pattern})"), F.lit(1)), lambda m: gap(kind, m, x["k"]))))
    return F.concat(F.array_compact(F.array(*missing)), marks("weak word", WEAK), marks("placeholder", PLACEHOLDER), marks("path", WINDOWS_PATH))


def description_text(fields: dict[str, Column], title: Column, body: Column) -> Column:
    """A description file: front matter, the title as heading, and the body with its own headings one level down, outside of code."""
    lower = F.regexp_replace(body, r"(?m)^(#{1,5})(?=[ \t])", "$1#")
    parts = F.split(body, r"(?ms)^```.*?^```[ \t]*$")
    code = F.regexp_extract_all(body, F.lit(r"(?ms)(^```.*?^```[ \t]*$)"), F.lit(1))
    woven = F.zip_with(F.transform(parts, lambda p: F.regexp_replace(p, r"(?m)^(#{1,5})(?=[ \t])", "$1#")), code, lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    shown = F.when(F.size(code) > 0, F.array_join(woven, "")).otherwise(lower)
    return F.concat(front_matter_text(fields), F.lit("\n# "), clean(title), F.lit("\n\n"), shown, F.lit("\n"))


def wiki_links(masked: Column) -> Column:
    """(target, anchor) of [[target#anchor|label]] in masked text; embeds are left out."""
    found = F.regexp_extract_all(F.concat(F.lit(" "), masked), F.lit(r"[^!]\[\[([^\]\[|]+)(?:\|[^\]]*)?\]\]"), F.lit(1))
    return F.transform(found, lambda t: F.struct(F.trim(F.regexp_replace(t, r"#.*$", "")).alias("target"), F.nullif(F.regexp_extract(t, r"#(.*)$", 1), F.lit("")).alias("anchor")))


def _section_pattern(title: str) -> str:
    return rf"(?ms)^##[ \t]+{re.escape(title)}[ \t]*$\n?(.*?)(?=^##[ \t]|\z)"


def section(text: Column, title: str) -> Column:
    """Body of the first second-level section of that title, null without one."""
    return F.when(text.rlike(_section_pattern(title)), F.regexp_extract(text, _section_pattern(title), 1))


def replace_section(text: Column, title: str, body: str) -> Column:
    quoted = body.replace("\\", "\\\\").replace("$", "\\$")
    return F.regexp_replace(text, _section_pattern(title), f"## {title}\n{quoted}\n")


def insert_before(text: Column, title: str, new: str) -> Column:
    quoted = new.replace("\\", "\\\\").replace("$", "\\$")
    return F.regexp_replace(text, rf"(?m)^(##[ \t]+{re.escape(title)}[ \t]*)$", f"{quoted}\n\n$1")


def keep_sections(text: Column, tags: tuple[str, ...]) -> Column:
    """Second-level sections whose heading carries one of the [tags]; what stands before them stays."""
    parts = F.split(text, r"(?m)(?=^##[ \t])")
    wanted = "|".join(re.escape(t) for t in tags)
    return F.array_join(F.filter(parts, lambda p: ~p.rlike(r"^##[ \t]") | p.rlike(rf"^##[^\n]*\[(?:{wanted})\]")), "")


def front_matter(text: Column) -> Column:
    """The leading block between --- lines as a map of names to lists of texts (scalars have one)."""
    block = F.regexp_extract(text, r"(?s)^---\r?\n(.*?)\r?\n---\s*(?:\r?\n|$)", 1)
    return _front_matter(block)


@F.pandas_udf(T.MapType(T.StringType(), T.ArrayType(T.StringType())))
def _front_matter(block: pd.Series) -> pd.Series:
    def parse(raw: str | None) -> dict[str, list[str]]:
        out: dict[str, list[str]] = {}
        key = None
        for line in (raw or "").splitlines():
            if m := re.match(r"^([A-Za-z0-9_\-]+):\s*(.*)$", line):
                key, value = m[1], m[2].strip()
                if value.startswith("[") and value.endswith("]"):
                    out[key] = [v.strip().strip("'\"") for v in re.findall(r"\s*('[^']*'|\"[^\"]*\"|[^,]+)", value[1:-1]) if v.strip()]
                else:
                    out[key] = [value.strip("'\"")] if value else []
            elif key and (m := re.match(r"^\s+-\s+(.*)$", line)):
                out[key].append(m[1].strip().strip("'\""))
        return out

    return block.map(parse)


def front_matter_text(fields: dict[str, Column]) -> Column:
    """A front matter block; values are quoted, quotes and line breaks inside them escaped."""
    quote = lambda c: F.concat(F.lit('"'), F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n")), F.lit('"'))
    rows = [F.concat(F.lit(f"{name}: "), quote(col.cast("string"))) for name, col in fields.items()]
    return F.concat(F.lit("---\n"), F.concat_ws("\n", *rows), F.lit("\n---\n"))


@F.pandas_udf(T.StringType())
def wiki_slug(text: pd.Series) -> pd.Series:
    """Compatibility-normalised, lower case, letters and digits of any script joined by dashes."""
    return text.map(lambda t: None if t is None else re.sub(r"[^\w]+", "-", unicodedata.normalize("NFKC", t).lower()).strip("-"))


@F.pandas_udf(T.StringType())
def unescaped(text: pd.Series) -> pd.Series:
    """HTML entities decoded."""
    import html

    return text.map(lambda t: None if t is None else html.unescape(t))


@F.pandas_udf(T.StringType())
def absolute_url(href: pd.Series, base: pd.Series) -> pd.Series:
    return pd.Series([None if h is None else urljoin(b or "", h) for h, b in zip(href, base, strict=True)])


@F.pandas_udf(T.IntegerType())
def longest_common(a: pd.Series, b: pd.Series) -> pd.Series:
    """Length of the longest common substring, by a suffix automaton of the shorter text."""

    def length(x: str | None, y: str | None) -> int:
        x, y = sorted((x or "", y or ""), key=len)
        steps, links, sizes, last = [{}], [-1], [0], 0
        for c in x:
            steps.append({})
            links.append(0)
            sizes.append(sizes[last] + 1)
            new, p = len(steps) - 1, last
            while p >= 0 and c not in steps[p]:
                steps[p][c] = new
                p = links[p]
            if p >= 0:
                q = steps[p][c]
                if sizes[p] + 1 == sizes[q]:
                    links[new] = q
                else:
                    steps.append(dict(steps[q]))
                    links.append(links[q])
                    sizes.append(sizes[p] + 1)
                    copy = len(steps) - 1
                    while p >= 0 and steps[p].get(c) == q:
                        steps[p][c] = copy
                        p = links[p]
                    links[q] = links[new] = copy
            last = new
        best = at = n = 0
        for c in y:
            while at and c not in steps[at]:
                at = links[at]
                n = sizes[at]
            if c in steps[at]:
                at, n = steps[at][c], n + 1
            best = max(best, n)
        return best

    return pd.Series([length(x, y) for x, y in zip(a, b, strict=True)])


@F.pandas_udf(T.StringType())
def rich_text(payload: pd.Series) -> pd.Series:
    """A ProseMirror-like JSON document as Markdown; deeper than 32 levels is cut, unknown nodes give their content."""
    import json

    def inline(nodes: list) -> str:
        out = []
        for node in nodes or []:
            text = node.get("text", "\n" if node.get("type") == "hardBreak" else "")
            for mark in node.get("marks") or []:
                kind = mark.get("type")
                href = str((mark.get("attrs") or {}).get("href") or "")
                if kind == "link" and href.split(":")[0].lower() in SCHEMES:
                    text = f"[{text}]({href})"
                else:
                    sign = {"bold": "**", "strong": "**", "italic": "*", "em": "*", "code": "`", "strike": "~~"}.get(kind, "")
                    text = f"{sign}{text}{sign}"
            out.append(text)
        return "".join(out)

    def block(node: dict, depth: int) -> list[str]:
        kind, content = node.get("type"), node.get("content") or []
        if depth > 32:
            return []
        if kind == "heading":
            return ["#" * int((node.get("attrs") or {}).get("level", 1)) + " " + inline(content)]
        if kind == "paragraph":
            return [inline(content)]
        if kind == "codeBlock":
            return ["```\n" + inline(content) + "\n```"]
        if kind == "horizontalRule":
            return ["---"]
        if kind in ("bulletList", "orderedList"):
            rows = []
            for k, item in enumerate(content, 1):
                own = "\n".join(x for part in item.get("content") or [] for x in block(part, depth + 1))
                rows.append((f"{k}. " if kind == "orderedList" else "- ") + own.replace("\n", "\n  "))
            return ["\n".join(rows)]
        inner = [x for part in content for x in block(part, depth + 1)]
        if kind == "blockquote":
            return ["\n".join("> " + line for x in inner for line in x.split("\n"))]
        return inner or ([inline([node])] if "text" in node else [])

    def whole(raw: str | None) -> str | None:
        try:
            doc = json.loads(raw or "")
        except ValueError:
            return None
        return "\n\n".join(x for x in block(doc, 0) if x) if isinstance(doc, dict) else None

    return payload.map(whole)


@F.pandas_udf(T.StringType())
def json_node(raw: pd.Series, wanted: pd.Series) -> pd.Series:
    """The first object with that id anywhere in a JSON text, as JSON."""
    import json

    def find(doc: str | None, name: str | None) -> str | None:
        try:
            stack = [json.loads(doc or "")]
        except ValueError:
            return None
        while stack:
            node = stack.pop()
            if isinstance(node, dict):
                if str(node.get("id")) == name:
                    return json.dumps(node, ensure_ascii=False, sort_keys=True)
                stack.extend(reversed(list(node.values())))
            elif isinstance(node, list):
                stack.extend(reversed(node))
        return None

    return pd.Series([find(d, w) for d, w in zip(raw, wanted, strict=True)])
