"""Sinks: CSV, JSON, Markdown, findings, indexes."""

from __future__ import annotations

import json
import re
from decimal import Decimal

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dqspark.functions import values as V
from dqspark.operators import findings as found
from dqspark.session import put_file


def _shown(df: DataFrame, escape: str, dates: str) -> list[Column]:
    out = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.StringType):
            c = V.escape_formula(c, escape)
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            c = V.datetime_text(c, dates)
        out.append(c.alias(f.name))
    return out


def write_csv(df: DataFrame, path: str, sep: str = ",", by: list[str] | None = None, escape: str = "quote", dates: str = "iso") -> None:
    """Formula-like text is made harmless; by: a folder for each value, such as sheet and region."""
    writer = df.select(*_shown(df, escape, dates)).write.option("header", True).option("quote", '"').option("escape", '"')
    (writer.partitionBy(*by) if by else writer).csv(path, sep=sep)


def write_json(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """JSON lines, nulls kept."""
    writer = df.write.option("ignoreNullFields", "false")
    (writer.partitionBy(*by) if by else writer).json(path)


def nested_json(regions: dict[tuple[str, str], DataFrame], most: int = 100_000) -> str:
    """One document of small tables: rows; {sheet: rows}; {region: rows}; or {sheet: {region: rows}}, by how many there are."""
    sheets = list(dict.fromkeys(s for s, _ in regions))
    rows = {}
    for key, df in regions.items():
        own = [json.loads(r[0]) for r in df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).limit(most + 1).collect()]
        if len(own) > most:
            raise ValueError(f"{key} has over {most} rows; write it as JSON lines")
        rows[key] = own
    single = all(sum(s == x for x, _ in regions) == 1 for s in sheets)
    if len(sheets) == 1:
        doc = next(iter(rows.values())) if single else {r: v for (_, r), v in rows.items()}
    else:
        doc = {s: next(v for (x, _), v in rows.items() if x == s) if single else {r: v for (x, r), v in rows.items() if x == s} for s in sheets}
    return json.dumps(doc, ensure_ascii=False)


def markdown_rows(df: DataFrame) -> DataFrame:
    """(line) of a pipe table's rows; markdown_head gives what stands above them."""
    cells = [F.coalesce(V.markdown_cell(F.col(f"`{c}`").cast("string")), F.lit("")) for c in df.columns]
    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))


def markdown_head(df: DataFrame) -> str:
    return "| " + " | ".join(c.replace("|", "\\|") for c in df.columns) + " |\n|" + " --- |" * len(df.columns)


def markdown_table(df: DataFrame, order: list[str], most: int = 10_000) -> str:
    """A small table as one text."""
    lines = [r["line"] for r in markdown_rows(df.orderBy(*order)).limit(most + 1).collect()]
    if len(lines) > most:
        raise ValueError(f"over {most} rows; write markdown_rows() as text")
    return "\n".join([markdown_head(df), *lines])


def choose_format(spans: DataFrame, header_levels: int, values: DataFrame | None = None) -> str:
    """html for a region that a pipe table cannot show: merged cells in its data or several header rows, or line breaks in the text column value; else gfm."""
    if header_levels > 1 or not spans.isEmpty():
        return "html"
    return "html" if values is not None and not values.where(F.col("value").contains("\n")).isEmpty() else "gfm"


def region_markdown(df: DataFrame, order: list[str], form: str = "gfm", most: int = 10_000) -> str:
    """A small region as a pipe table or an HTML table."""
    if form == "gfm":
        return markdown_table(df, order, most)
    rows = [r["line"] for r in html_rows(df.orderBy(*order)).limit(most + 1).collect()]
    if len(rows) > most:
        raise ValueError(f"over {most} rows; write html_rows() as text")
    head = "".join(f"<th>{_escaped(c)}</th>" for c in df.columns)
    return "\n".join(["<table>", f"<tr>{head}</tr>", *rows, "</table>"])


def _escaped(text: str) -> str:
    return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")


def html_rows(df: DataFrame) -> DataFrame:
    """(line) of an HTML table's rows, text escaped."""
    safe = lambda c: F.replace(F.replace(F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    cells = [F.concat(F.lit("<td>"), safe(F.col(f"`{c}`")), F.lit("</td>")) for c in df.columns]
    return df.select(F.concat(F.lit("<tr>"), *cells, F.lit("</tr>")).alias("line"))


def write_findings(findings: DataFrame, path: str, summarise_after: int = 100, most: int = 1000, severities: tuple[str, ...] = ()) -> DataFrame:
    """Collapsed, then capped findings as JSON lines under findings/, and the counters of all under summary/; gives the counters."""
    counters = found.summary(findings)
    shown = found.with_severity(findings, *severities) if severities else findings
    out = found.cap(found.collapse(shown, summarise_after).drop("collapsed"), most)
    write_json(found.ordered(out), f"{path}/findings")
    write_json(counters, f"{path}/summary")
    return counters


def error_cells(cells: DataFrame) -> DataFrame:
    """(value, sheet, row, col) of each error code in long-form cells."""
    return cells.where(F.col("value").isin(*V.ERROR_CODES)).select("value", "sheet", "row", "col")


def write_pages(pages: DataFrame, path: str) -> None:
    """Pages (name, text, fields map) as Markdown with front matter, a folder for each name."""
    quoted = F.transform(F.array_sort(F.map_entries("fields")), lambda e: F.concat(e["key"], F.lit(': "'), F.replace(e["value"], F.lit('"'), F.lit('\\"')), F.lit('"')))
    text = F.concat(F.lit("---\n"), F.array_join(quoted, "\n"), F.lit("\n---\n\n"), F.col("text"))
    pages.select("name", text.alias("value")).write.partitionBy("name").text(path)


def state_report(pages: DataFrame, most: int = 20) -> DataFrame:
    """(kind, n, names): how many pages there are of each kind, and the first of their names, joined by commas."""
    counts = pages.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
    ranked = pages.select("kind", "name").distinct().withColumn("_k", F.row_number().over(Window.partitionBy("kind").orderBy("name"))).where(F.col("_k") <= most)
    first = ranked.groupBy("kind").agg(F.array_join(F.array_sort(F.collect_list("name")), ",").alias("names"))
    return counts.join(first, "kind", "left")


def last_entries(log: DataFrame, order: str, n: int) -> DataFrame:
    """The last entries of a log, the latest first."""
    return log.orderBy(F.desc(order)).limit(n)


def index_rows(pages: DataFrame) -> DataFrame:
    """(kind, line): an index entry for each page, in order of name within its kind."""
    return pages.select("kind", "name", F.concat(F.lit("- [["), F.col("name"), F.lit("]] "), F.coalesce("summary", F.lit(""))).alias("line")).orderBy("kind", "name")


def benchmark_report(summary: DataFrame, order: list[str]) -> str:
    """Grouped statistics as a Markdown report."""
    return "# Benchmark\n\n" + markdown_table(summary, order) + "\n"


def stat_sidecar(df: DataFrame, path: str) -> DataFrame:
    """Writes a table's number of rows and, for each column, of values, nulls and distinct values as one JSON document; gives them as (column, filled, nulls, distinct, rows)."""
    n = F.count(F.lit(1))
    facts = [F.struct(F.lit(c).alias("column"), F.count(f"`{c}`").alias("filled"), (n - F.count(f"`{c}`")).alias("nulls"), F.count_distinct(F.col(f"`{c}`")).alias("distinct"), n.alias("rows")) for c in df.columns]
    # one row, a field for each column
    one = df.agg(*[f.alias(f"f{k}") for k, f in enumerate(facts)])
    out = one.select(F.inline(F.array(*[F.col(f"f{k}") for k in range(len(facts))])))
    rows = [r.asDict() for r in out.collect()]
    put_file(df.sparkSession, path, json.dumps({"rows": rows[0]["rows"] if rows else 0, "columns": [{k: v for k, v in r.items() if k != "rows"} for r in rows]}, ensure_ascii=False, indent=1))
    return df.sparkSession.createDataFrame([tuple(r.values()) for r in rows], "column string, filled long, nulls long, distinct long, rows long")


def append_log(spark: SparkSession, path: str, entry: str) -> None:
    """Adds an entry to a small text file as a whole: readers see it with the entry or without."""
    try:
        old = spark.read.text(path, wholetext=True).first()
    except AnalysisException:
        old = None
    put_file(spark, path, (old["value"].rstrip("\n") + "\n" if old and old["value"] else "") + entry.rstrip("\n") + "\n")


#: Parts of a workbook package and the namespaces of its format.
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_RELATIONS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"


def workbook_bytes(sheets: dict[str, DataFrame], freeze: bool = True, auto_filter: bool = True, most: int = 1_048_575) -> bytes:
    """Small tables as a workbook: a bold header row that stays in sight, a filter, numbers as numbers, dates as serials, text never as a formula.

    Rows are streamed partition by partition; more than a sheet takes are refused.
    """
    import io
    import zipfile
    from xml.sax.saxutils import escape, quoteattr

    bad = re.compile(r"[^\t\n\r\x20-\uD7FF\uE000-\uFFFD\U00010000-\U0010FFFF]")
    text = lambda v: f'<is><t xml:space="preserve">{escape(bad.sub("", str(v)))}</t></is>'

    def cell(ref: str, value: object, style: int = 0) -> str:
        mark = f' s="{style}"' if style else ""
        if value is None:
            return ""
        if isinstance(value, bool):
            return f'<c r="{ref}"{mark} t="b"><v>{int(value)}</v></c>'
        if isinstance(value, (int, float, Decimal)) and value == value and abs(value) != float("inf"):
            return f'<c r="{ref}"{mark}><v>{value!r}</v></c>' if not isinstance(value, Decimal) else f'<c r="{ref}"{mark}><v>{value}</v></c>'
        return f'<c r="{ref}"{mark} t="inlineStr">{text(value)}</c>'

    out = io.BytesIO()
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for k, (name, df) in enumerate(sheets.items(), 1):
            letters = [_letters(c) for c in range(len(df.columns))]
            dates = [isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)) for f in df.schema]
            shown = df.select(*[V.date_serial(F.col(f"`{c}`")).alias(c) if d else F.col(f"`{c}`") for c, d in zip(df.columns, dates, strict=True)])
            with z.open(f"xl/worksheets/sheet{k}.xml", "w") as f:
                pane = '<sheetViews><sheetView workbookViewId="0"><pane ySplit="1" topLeftCell="A2" activePane="bottomLeft" state="frozen"/></sheetView></sheetViews>' if freeze else ""
                f.write(f'{head}<worksheet xmlns="{_MAIN}">{pane}<sheetData><row r="1">'.encode())
                f.write("".join(cell(f"{x}1", c, 1) for x, c in zip(letters, df.columns, strict=True)).encode() + b"</row>")
                last = 1
                for last, row in enumerate(shown.toLocalIterator(), 2):
                    if last > most + 1:
                        raise ValueError(f"{name} has over {most} rows")
                    f.write((f'<row r="{last}">' + "".join(cell(f"{x}{last}", v, 2 if d else 0) for x, v, d in zip(letters, row, dates, strict=True)) + "</row>").encode())
                ref = f"A1:{letters[-1] if letters else 'A'}{last}"
                f.write(("</sheetData>" + (f'<autoFilter ref="{ref}"/>' if auto_filter and letters else "") + "</worksheet>").encode())
        names = list(sheets)
        z.writestr("xl/workbook.xml", f'{head}<workbook xmlns="{_MAIN}" xmlns:r="{_RELATIONS}"><sheets>' + "".join(f'<sheet name={quoteattr(n)} sheetId="{k}" r:id="rId{k}"/>' for k, n in enumerate(names, 1)) + "</sheets></workbook>")
        links = [(f"rId{k}", "worksheet", f"worksheets/sheet{k}.xml") for k in range(1, len(names) + 1)] + [("rIdS", "styles", "styles.xml")]
        z.writestr("xl/_rels/workbook.xml.rels", f'{head}<Relationships xmlns="{_PACKAGE}/relationships">' + "".join(f'<Relationship Id="{i}" Type="{_RELATIONS}/{t}" Target="{x}"/>' for i, t, x in links) + "</Relationships>")
        z.writestr("_rels/.rels", f'{head}<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="rId1" Type="{_RELATIONS}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/styles.xml", f'{head}<styleSheet xmlns="{_MAIN}"><fonts count="2"><font/><font><b/></font></fonts><fills count="2"><fill><patternFill patternType="none"/></fill><fill><patternFill patternType="gray125"/></fill></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="3"><xf/><xf fontId="1" applyFont="1"/><xf numFmtId="22" applyNumberFormat="1"/></cellXfs></styleSheet>')
        kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
        parts = [("xl/workbook.xml", f"{kind}.sheet.main+xml"), ("xl/styles.xml", f"{kind}.styles+xml"), *[(f"xl/worksheets/sheet{k}.xml", f"{kind}.worksheet+xml") for k in range(1, len(names) + 1)]]
        z.writestr("[Content_Types].xml", f'{head}<Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>' + "".join(f'<Override PartName="/{n}" ContentType="{t}"/>' for n, t in parts) + "</Types>")
    return out.getvalue()


def _letters(index: int) -> str:
    out = ""
    index += 1
    while index:
        index, rest = divmod(index - 1, 26)
        out = chr(65 + rest) + out
    return out


def write_workbook(sheets: dict[str, DataFrame], path: str, freeze: bool = True, auto_filter: bool = True) -> None:
    """Names must be fit for sheets (see tables.sheet_names)."""
    put_file(next(iter(sheets.values())).sparkSession, path, workbook_bytes(sheets, freeze, auto_filter))
