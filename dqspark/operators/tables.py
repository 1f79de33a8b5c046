"""Tables inside sheets: regions, headers, spans, unions of keys.

A sheet is its non-empty cells in long form: (sheet, row, col, value).
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dqspark.functions.binding import let
from dqspark.operators import pairs
from dqspark.operators.merge import suffixed_names


def islands(df: DataFrame, by: list[str], place: str, gap: int, label: str = "island") -> DataFrame:
    """Runs of an integer place: a new one starts where more than `gap` places are missing. Numbered from 0."""
    w = Window.partitionBy(*by).orderBy(place)
    places = df.select(*by, place).distinct()
    broken = F.coalesce(F.col(place) - F.lag(place).over(w) > gap + 1, F.lit(False)).cast("int")
    return places.withColumn("_new", broken).withColumn(label, F.sum("_new").over(w).cast("int")).drop("_new")


def regions(cells: DataFrame, gap_rows: int = 2, gap_cols: int = 1) -> DataFrame:
    """(sheet, top, left, bottom, right): split at so many empty rows, then at so many empty columns, boxes tight."""
    rows = islands(cells, ["sheet"], "row", gap_rows - 1, "_band")
    banded = cells.join(rows, ["sheet", "row"])
    cols = islands(banded, ["sheet", "_band"], "col", gap_cols - 1, "_strip")
    return banded.join(cols, ["sheet", "_band", "col"]).groupBy("sheet", "_band", "_strip").agg(
        F.min("row").alias("top"), F.min("col").alias("left"), F.max("row").alias("bottom"), F.max("col").alias("right")
    ).drop("_band", "_strip")


def whole_sheets(cells: DataFrame) -> DataFrame:
    return cells.groupBy("sheet").agg(F.min("row").alias("top"), F.min("col").alias("left"), F.max("row").alias("bottom"), F.max("col").alias("right"))


def _meets(a: str, b: str) -> Column:
    c = lambda side, name: F.col(f"{side}.{name}")
    return (c(a, "sheet") == c(b, "sheet")) & (c(a, "top") <= c(b, "bottom")) & (c(b, "top") <= c(a, "bottom")) & (c(a, "left") <= c(b, "right")) & (c(b, "left") <= c(a, "right"))


def detect(declared: DataFrame, named: DataFrame, cells: DataFrame, gap_rows: int = 2, gap_cols: int = 1) -> DataFrame:
    """Declared tables; named ranges that meet none of them; regions by gaps in the cells that are left. Adds source and name."""
    box = ["sheet", "top", "left", "bottom", "right"]
    first = declared.select(*box, F.lit("table").alias("source"), "name")
    second = named.alias("x").join(declared.alias("y"), _meets("x", "y"), "left_anti").select(*box, F.lit("range").alias("source"), "name")
    claimed = first.unionByName(second)
    inside = (F.col("c.sheet") == F.col("b.sheet")) & F.col("c.row").between(F.col("b.top"), F.col("b.bottom")) & F.col("c.col").between(F.col("b.left"), F.col("b.right"))
    free = cells.alias("c").join(claimed.alias("b"), inside, "left_anti")
    return claimed.unionByName(regions(free, gap_rows, gap_cols).withColumns({"source": F.lit("gap"), "name": F.lit(None).cast("string")}))


def overlapping(spans: DataFrame, cell: int | None = None) -> DataFrame:
    """Pairs of rectangles (with id) of one sheet that share a cell. Equal rectangles are compared as one.

    cell: compare only rectangles that lie in a common square of so many rows and columns; the
    pairs are the same, a rectangle is copied into each square it meets.
    """
    box = ["sheet", "top", "left", "bottom", "right"]
    members = spans.select(F.struct(*box).alias("value"), "id")
    kinds = members.select("value").distinct().select("value", "value.*")
    if cell is None:
        a, b, near = kinds.alias("a"), kinds.alias("b"), F.lit(True)
    else:
        part = lambda c: F.floor(F.col(c) / cell)
        squares = kinds.withColumn("_y", F.explode(F.sequence(part("top"), part("bottom")))).withColumn("_x", F.explode(F.sequence(part("left"), part("right"))))
        a, b = squares.alias("a"), squares.alias("b")
        # a pair counts in the square of the first cell that both share
        first = lambda c: F.floor(F.greatest(F.col(f"a.{c}"), F.col(f"b.{c}")) / cell)
        near = (F.col("a._y") == F.col("b._y")) & (F.col("a._x") == F.col("b._x")) & (F.col("a._y") == first("top")) & (F.col("a._x") == first("left"))
    links = a.join(b, near & _meets("a", "b") & (F.col("a.value") <= F.col("b.value"))).select(F.col("a.value").alias("a"), F.col("b.value").alias("b"), F.col("a.sheet").alias("sheet"))
    return pairs.of_members(members, links, "sheet").select("sheet", "left_id", "right_id")


def reserved(name: Column, most: int = 255) -> Column:
    """Names that mean something to spreadsheets themselves: empty, too long, or with a reserved prefix."""
    bare = F.lower(F.regexp_replace(name, r"[\x{200B}-\x{200D}\x{FEFF}]", ""))
    return (bare == "") | (F.length(bare) > most) | bare.rlike(r"^(_xlnm\.|_xlfn\.|_xlpm\.|print_area$|print_titles$|criteria$|extract$|database$)")


def header_depths(spans: DataFrame, regions: DataFrame) -> DataFrame:
    """(sheet, top, depth) of each region (sheet, top, left, bottom, right): the rows from its top that horizontal spans in it cover without a gap, and one row of labels."""
    box = regions.select("sheet", F.col("top").alias("_t"), F.col("left").alias("_l"), F.col("bottom").alias("_b"), F.col("right").alias("_r"))
    wide = spans.where(F.col("right") > F.col("left")).join(box, "sheet").where("bottom >= _t AND top <= _b AND left <= _r AND right >= _l")
    rows = wide.select("sheet", "_t", "_l", F.explode(F.sequence(F.greatest("top", "_t"), F.least("bottom", "_b"))).alias("_row")).distinct()
    place = F.row_number().over(Window.partitionBy("sheet", "_t", "_l").orderBy("_row"))
    # rows in order without a gap have the same distance to their place
    run = rows.withColumn("_k", place).where(F.col("_row") - F.col("_t") + 1 == F.col("_k")).groupBy("sheet", "_t", "_l").agg(F.count(F.lit(1)).alias("_n"))
    return box.join(run, ["sheet", "_t", "_l"], "left").select("sheet", F.col("_t").alias("top"), F.col("_l").alias("left"), (F.coalesce("_n", F.lit(0)) + 1).cast("int").alias("depth"))


def header_depth(spans: DataFrame, top: int) -> int:
    """The same for one region of one sheet, from its top to the end of the sheet."""
    below = spans.where((F.col("right") > F.col("left")) & (F.col("bottom") >= top))
    rows = below.select(F.explode(F.sequence(F.greatest("top", F.lit(top)), F.col("bottom"))).alias("_row")).distinct()
    run = rows.withColumn("_k", F.row_number().over(Window.orderBy("_row"))).where(F.col("_row") - top + 1 == F.col("_k"))  # header rows of one sheet
    return run.count() + 1


def flat_headers(cells: DataFrame, spans: DataFrame, top: int, depth: int, sep: str = " / ") -> DataFrame:
    """(sheet, col, header): a span's label stands in all its columns; levels are joined, blanks and repeats dropped."""
    label = fill_spans(cells.where(F.col("row") < top + depth), spans, "fill")
    levels = label.groupBy("sheet", "col").agg(F.array_sort(F.collect_list(F.struct("row", F.trim("value").alias("value")))).alias("_l"))
    texts = F.filter(F.transform("_l", lambda x: x["value"]), lambda v: v.isNotNull() & (v != ""))
    kept = F.filter(F.sequence(F.lit(0), F.size(texts) - 1), lambda k: (k == 0) | (F.get(texts, k) != F.get(texts, k - 1)))
    names = F.transform(F.when(F.size(texts) > 0, kept).otherwise(F.array().cast("array<int>")), lambda k: F.get(texts, k))
    return levels.select("sheet", "col", F.array_join(names, sep).alias("header"))


def header_runs(headers: DataFrame, sep: str = " / ") -> DataFrame:
    """(level, first, last, label): flat headers (col, header) as rows again; neighbours of one label under the same labels above share a cell.

    Headers of fewer levels stand in the lowest rows; a gap in the columns parts cells.
    """
    parts = headers.select("col", F.split("header", f"\\Q{sep}\\E").alias("_p"))
    depth = parts.agg(F.max(F.size("_p")).alias("_depth"))
    full = parts.join(F.broadcast(depth)).select("col", F.concat(F.array_repeat(F.lit(""), F.col("_depth") - F.size("_p")), "_p").alias("_p"))  # one row of depth
    levels = full.select("col", F.posexplode("_p").alias("level", "label"), F.col("_p").alias("_all")).withColumn("_path", F.array_join(F.slice("_all", F.lit(1), F.col("level") + 1), "\x00"))
    w = Window.partitionBy("level").orderBy("col")  # the columns of one region
    new = F.coalesce((F.lag("_path").over(w) != F.col("_path")) | (F.col("col") - F.lag("col").over(w) > 1), F.lit(True))
    runs = levels.withColumn("_new", new.cast("int")).withColumn("_run", F.sum("_new").over(w))
    return runs.groupBy("level", "_run").agg(F.min("col").alias("first"), F.max("col").alias("last"), F.first("label").alias("label")).drop("_run")


def leaf(header: Column, sep: str = " / ") -> Column:
    return F.element_at(F.split(header, f"\\Q{sep}\\E"), -1)


def _tiled(spans: DataFrame) -> DataFrame:
    """The spans in each tile that they meet, at most four: tiles of a span are as high and wide as the powers of two (_ly, _lx) from its size on."""
    level = lambda a, b: F.length(F.bin(F.col(b) - F.col(a)))
    leveled = spans.where("top <= bottom AND left <= right").select("sheet", "top", "left", "bottom", "right", level("top", "bottom").alias("_ly"), level("left", "right").alias("_lx"))
    return leveled.withColumn("_y", F.expr("explode(sequence(shiftright(top, _ly), shiftright(bottom, _ly)))")).withColumn("_x", F.expr("explode(sequence(shiftright(left, _lx), shiftright(right, _lx)))"))


def covered(cells: DataFrame, spans: DataFrame) -> DataFrame:
    """(sheet, row, col), once each, of the cells inside a span. A cell looks in one tile of each size that there is, so neither the number nor the size of spans multiplies the work."""
    tiles = _tiled(spans)
    sizes = F.broadcast(tiles.select("_ly", "_lx").distinct())  # 1024 at most
    own = cells.select("sheet", "row", "col").distinct().join(sizes).withColumns({"_y": F.expr("shiftright(row, _ly)"), "_x": F.expr("shiftright(col, _lx)")})
    tile = ["sheet", "_ly", "_lx", "_y", "_x"]
    same = [F.col(f"c.{c}") == F.col(f"s.{c}") for c in tile]
    inside = F.col("c.row").between(F.col("s.top"), F.col("s.bottom")) & F.col("c.col").between(F.col("s.left"), F.col("s.right"))
    return own.alias("c").join(tiles.alias("s"), [*same, inside], "left_semi").select("sheet", "row", "col").distinct()


def fill_spans(cells: DataFrame, spans: DataFrame, policy: str) -> DataFrame:
    """Cells of merged spans: anchor keeps the first cell's value only, fill repeats it, blank empties the span but keeps its anchor out too."""
    rest = cells.join(covered(cells, spans), ["sheet", "row", "col"], "left_anti")
    if policy == "blank":
        return rest.select(*cells.columns)
    first = cells.select("sheet", F.col("row").alias("top"), F.col("col").alias("left"), "value")
    anchors = spans.join(first, ["sheet", "top", "left"])
    if policy == "anchor":
        anchors = anchors.select("sheet", F.col("top").alias("row"), F.col("left").alias("col"), "value")
    else:
        anchors = anchors.select("sheet", F.explode(F.sequence("top", "bottom")).alias("row"), "left", "right", "value").select("sheet", "row", F.explode(F.sequence("left", "right")).alias("col"), "value")
    return rest.select("sheet", "row", "col", "value").unionByName(anchors)


def straddling(spans: DataFrame, top: int, depth: int) -> DataFrame:
    """Spans that begin inside the header and end below it."""
    return spans.where((F.col("top") < top + depth) & (F.col("bottom") >= top + depth))


def synthetic_headers(width: int) -> list[str]:
    return [f"col_{k}" for k in range(1, width + 1)]


def key_order(rows: DataFrame, order: str, keys: str) -> DataFrame:
    """(key, place): all keys of rows (array column) in the order in which they are first seen."""
    seen = rows.select(F.col(order).alias("_o"), F.posexplode(keys).alias("_p", "key")).groupBy("key").agg(F.min(F.struct("_o", "_p")).alias("_first"))
    return seen.select("key", (F.row_number().over(Window.orderBy("_first")) - 1).alias("place"))


def without_empty_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.where(F.exists(F.array(*[F.col(c).cast("string") for c in columns]), lambda v: v.isNotNull() & (F.trim(v) != "")))


def header_offset(cells: DataFrame, most: int = 20) -> DataFrame:
    """(sheet, row): the likeliest header row, past a block of notes: a wide row of texts over rows with the same columns."""
    head = cells.where(F.col("row") <= most)
    number = F.col("value").rlike(r"^[+-]?\d+([.,]\d+)?$")
    rows = head.groupBy("sheet", "row").agg(F.count(F.lit(1)).alias("width"), F.count_if(number).alias("numbers"))
    w = Window.partitionBy("sheet").orderBy("row")
    following = F.coalesce(F.lead("width").over(w), F.lit(0))
    score = F.col("width") * 2 - F.col("numbers") * 3 + F.least(F.col("width"), following) - F.col("row") * 0.1
    return rows.withColumn("_s", score).groupBy("sheet").agg(F.max_by("row", F.struct("_s", -F.col("row"))).alias("row"))


def sheet_names(df: DataFrame, name: str, order: str, most: int = 31) -> DataFrame:
    """Names fit for sheets: without []:*?/\\, at most 31 characters, unique but for case by a suffix that fits too."""
    bare = F.regexp_replace(F.coalesce(F.col(name), F.lit("")), r"[\[\]:*?/\\]", "_")
    bare = F.substring(F.when(F.trim(bare) == "", "Sheet").otherwise(bare), 1, most)
    k = F.row_number().over(Window.partitionBy(F.lower("_bare")).orderBy(order))
    suffix = F.when(F.col("_k") > 1, F.concat(F.lit("_"), F.col("_k").cast("string"))).otherwise("")
    out = df.withColumn("_bare", bare).withColumn("_k", k).withColumn("sheet_name", F.concat(F.expr(f"substring(_bare, 1, {most} - length(CASE WHEN _k > 1 THEN concat('_', _k) ELSE '' END))"), suffix))
    # a suffixed name may meet a given one: such rows get a second suffix
    again = F.row_number().over(Window.partitionBy(F.lower("sheet_name")).orderBy("_k", order))
    return out.withColumn("_a", again).withColumn("sheet_name", F.when(F.col("_a") > 1, F.concat(F.expr(f"substring(sheet_name, 1, {most - 3})"), F.lit("~"), F.col("_a").cast("string"))).otherwise(F.col("sheet_name"))).drop("_bare", "_k", "_a")


def pipe_table(block: Column) -> Column:
    """A GFM pipe table as (header, align, rows), null if it is none. Rows have the header's width, blank cells are null."""
    lines = F.filter(F.transform(F.split(block, r"\r?\n"), lambda x: F.trim(x)), lambda x: x != "")
    cells = lambda line: F.transform(
        F.split(F.regexp_replace(F.regexp_replace(line, r"^\|", ""), r"(?<!\\)\|$", ""), r"(?<!\\)\|"),
        lambda c: F.nullif(F.trim(F.replace(c, F.lit("\\|"), F.lit("|"))), F.lit("")),
    )
    width = lambda t: F.size(t["header"])
    fit = lambda t, row: F.slice(F.concat(row, F.array_repeat(F.lit(None).cast("string"), width(t))), F.lit(1), width(t))

    def table(t: Column) -> Column:
        good = (F.size(t["lines"]) >= 2) & (F.size(t["marks"]) == width(t)) & F.forall(t["marks"], lambda m: F.coalesce(m.rlike(r"^:?-+:?$"), F.lit(False)))
        align = F.transform(t["marks"], lambda m: F.when(m.rlike(r"^:-+:$"), "center").when(m.rlike(r"^-+:$"), "right").when(m.rlike(r"^:-+$"), "left"))
        rows = F.transform(F.slice(t["lines"], 3, 2_000_000_000), lambda line: fit(t, cells(line)))
        return F.when(good, F.struct(t["header"].alias("header"), align.alias("align"), rows.alias("rows")))

    heads = lambda ls: F.struct(ls.alias("lines"), cells(F.get(ls, F.lit(0))).alias("header"), cells(F.get(ls, F.lit(1))).alias("marks"))
    return let(lines, lambda ls: let(heads(ls), table))


def read_region(cells: DataFrame, spans: DataFrame, box: tuple[str, int, int, int, int], policy: str = "anchor", depth: int | None = None, header: str = "flat") -> tuple[DataFrame, list[str]]:
    """A region (sheet, top, left, bottom, right) as a table of texts, with the warnings that reading it gives.

    Its merged spans are resolved, its header rows (depth of them, else as header_depth() finds)
    become column names: flat joins the levels, leaf keeps the last; missing ones are col_<n>,
    repeated ones get a suffix. Rows keep their place in the sheet as _row.
    """
    sheet, top, left, bottom, right = box
    inside = lambda c: (F.col("sheet") == sheet) & F.col("row").between(top, bottom) & F.col("col").between(left, right)
    own = cells.where(inside(None)).select("sheet", "row", "col", "value")
    merged = spans.where((F.col("sheet") == sheet) & (F.col("top") >= top) & (F.col("bottom") <= bottom) & (F.col("left") >= left) & (F.col("right") <= right))
    depth = header_depth(merged, top) if depth is None else depth
    warnings = [f"the span at row {r['top']}, column {r['left']} reaches from the header into the data" for r in straddling(merged, top, depth).orderBy("top", "left").limit(100).collect()]
    heads = {r["col"]: r["header"] for r in flat_headers(own, merged, top, depth).collect()} if depth else {}
    names = []
    for place, col in enumerate(range(left, right + 1), 1):
        text = heads.get(col) or f"col_{place}"
        names.append(text.split(" / ")[-1] if header == "leaf" else text)
    unique = suffixed_names(names)
    if unique != names:
        warnings.append("headers are used twice: " + ", ".join(sorted({n for n in names if names.count(n) > 1})))
    data = fill_spans(own, merged, policy).where(F.col("row") >= top + depth)
    wide = data.groupBy(F.col("row").alias("_row")).agg(*[F.max(F.when(F.col("col") == c, F.col("value"))).alias(n) for c, n in zip(range(left, right + 1), unique, strict=True)])
    return wide, warnings


def payloads(cells: DataFrame, spans: DataFrame, regions: DataFrame, mode: str = "auto", sheet: str | None = None, **how) -> Iterator[tuple[str, str, DataFrame, list[str]]]:
    """(sheet, region name, table, warnings) of the regions that a mode asks for, in order: tables (declared ones and ranges), gaps, whole (a region for each sheet) or auto (all but whole).

    regions: as detect() gives them.
    """
    chosen = whole_sheets(cells).withColumns({"source": F.lit("whole"), "name": F.lit(None).cast("string")}) if mode == "whole" else regions
    if mode in ("tables", "gaps"):
        chosen = chosen.where(F.col("source") == "gap" if mode == "gaps" else F.col("source") != "gap")
    chosen = chosen if sheet is None else chosen.where(F.col("sheet") == sheet)
    for k, r in enumerate(chosen.orderBy("sheet", "top", "left").collect(), 1):  # as many as a person lays out
        yield r["sheet"], r["name"] or f"region_{k}", *read_region(cells, spans, (r["sheet"], r["top"], r["left"], r["bottom"], r["right"]), **how)
