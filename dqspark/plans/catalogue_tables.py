"""Queries of table regions, link graphs, findings, ranking and merges (B, F, G07, H, K), with inputs laid out from the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dqspark.operators import evalstats, findings, graph, infer, merge, tables
from dqspark.plans.catalogue_text import lit_concat
from dqspark.plans.catalogue_values import cases
from dqspark.plans.registry import query, read
from dqspark.plans.rules import Rule, run_rules
from dqspark.sources import files, sinks

# --- B ----------------------------------------------------------------------------------------


def _cells(spark: SparkSession, d: str) -> DataFrame:
    """A sheet for each brand: parts in rows, after every tenth three empty rows, a block of sizes in columns 1 and 2 and one of names in column 5."""
    part = read(spark, d, "part")
    row = (F.col("p_partkey") + F.floor(F.col("p_partkey") / 10) * 3 + 1).cast("int").alias("row")
    cell = lambda c, v: F.struct(F.lit(c).alias("col"), v.cast("string").alias("value"))
    return part.select(F.lit("s").alias("sheet"), row, F.inline(F.array(cell(1, F.col("p_partkey")), cell(2, F.col("p_size")), cell(5, F.col("p_name")))))


_BLOCKS = """WITH r AS (SELECT p_partkey // 10 AS b, CAST(min(p_partkey) + p_partkey // 10 * 3 + 1 AS INT) AS top, CAST(max(p_partkey) + p_partkey // 10 * 3 + 1 AS INT) AS bottom FROM part GROUP BY p_partkey // 10)"""


@query("b01_regions", f"""{_BLOCKS}, boxes AS (SELECT 's' AS sheet, top, 1 AS "left", bottom, 2 AS "right", 'gap' AS source, NULL::VARCHAR AS name FROM r WHERE b NOT IN (0, 1)
  UNION ALL SELECT 's', top, 5, bottom, 5, 'gap', NULL FROM r WHERE b NOT IN (0, 1))
SELECT * FROM boxes UNION ALL SELECT 's', 1, 1, 11, 5, 'table', 'T' UNION ALL SELECT 's', 13, 1, 24, 6, 'range', 'R'""")
def _(spark: SparkSession, d: str) -> DataFrame:
    box = "sheet string, top int, left int, bottom int, right int, name string"
    declared = spark.createDataFrame([("s", 1, 1, 11, 5, "T")], box)
    named = spark.createDataFrame([("s", 13, 1, 24, 6, "R"), ("s", 10, 1, 12, 2, "meets T")], box)
    return tables.detect(declared, named, _cells(spark, d))


@query("b22_whole_sheets", "SELECT 's' AS sheet, 1 AS top, 1 AS \"left\", CAST(max(p_partkey + p_partkey // 10 * 3 + 1) AS INT) AS bottom, 5 AS \"right\" FROM part")
def _(spark: SparkSession, d: str) -> DataFrame:
    return tables.whole_sheets(_cells(spark, d))


@query("b05_reserved_names", "SELECT p_partkey, p_partkey % 5 <> 0 AS reserved FROM part")
def _(spark: SparkSession, d: str) -> DataFrame:
    name = cases(F.col("p_partkey"), F.col("p_name"), F.lit("_xlnm.Print_Area"), F.lit("PRINT​_AREA"), F.lit(""), F.repeat(F.lit("x"), 256))
    return read(spark, d, "part").select("p_partkey", tables.reserved(name).alias("reserved"))


_SPAN = "sheet string, top int, left int, bottom int, right int"


def _headed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Sheets s0, s1, s2 with two notes, then headers of one, two and three rows from row 70 on, then a row for each nation."""
    heads, spans = [], [(f"s{k}", r, 1, r, 2) for k in range(3) for r in range(1, 67)]  # spans above the region say nothing about its header
    for k in range(3):
        for level in range(k):
            heads += [(f"s{k}", 70 + level, 1, f"Group {level}"), (f"s{k}", 70 + level, 3, " Other ")]
            spans.append((f"s{k}", 70 + level, 1, 70 + level, 2))
        heads += [(f"s{k}", 70 + k, 1, "key"), (f"s{k}", 70 + k, 2, "name"), (f"s{k}", 70 + k, 3, "Other")]
    nation = read(spark, d, "nation")
    own = [nation.select(F.lit(f"s{k}").alias("sheet"), (F.col("n_nationkey") + 71 + k).alias("row"), F.inline(F.array(*[F.struct(F.lit(c).alias("col"), F.col(n).cast("string").alias("value")) for c, n in ((1, "n_nationkey"), (2, "n_name"), (3, "n_regionkey"))]))) for k in range(3)]
    cells = spark.createDataFrame(heads, "sheet string, row int, col int, value string")
    for part in own:
        cells = cells.unionByName(part)
    return cells, spark.createDataFrame(spans, _SPAN)


@query("b06_header_depths", "SELECT unnest(['s0', 's1', 's2']) AS sheet, 70 AS top, 1 AS \"left\", unnest([1, 2, 3]) AS depth")
def _(spark: SparkSession, d: str) -> DataFrame:
    _, spans = _headed(spark, d)
    return tables.header_depths(spans, spark.createDataFrame([(f"s{k}", 70, 1, 200, 3) for k in range(3)], _SPAN))


@query("b07_flat_headers", """SELECT unnest([1, 2, 3]) AS col, unnest(['Group 0 / Group 1 / key', 'Group 0 / Group 1 / name', 'Other']) AS header, unnest(['key', 'name', 'Other']) AS leaf""")
def _(spark: SparkSession, d: str) -> DataFrame:
    cells, spans = _headed(spark, d)
    of = lambda df: df.where("sheet = 's2'")
    flat = tables.flat_headers(of(cells).where("row >= 70"), of(spans), 70, 3)
    return flat.select("col", "header", tables.leaf(F.col("header")).alias("leaf"))


@query("b17_header_runs", """SELECT unnest([0, 0, 1, 1, 1, 1, 2, 2, 2, 2]) AS level, unnest([1, 4, 1, 2, 4, 5, 1, 2, 4, 5]) AS "first", unnest([2, 5, 1, 2, 4, 5, 1, 2, 4, 5]) AS "last",
  unnest(['G', '', 'x', 'y', '', 'z', 'a', 'a', 'only', 'b']) AS label""")
def _(spark: SparkSession, d: str) -> DataFrame:
    headers = [(1, "G / x / a"), (2, "G / y / a"), (4, "only"), (5, "z / b")]
    return tables.header_runs(spark.createDataFrame(headers, "col int, header string"))


@query("b08_synthetic_names", "SELECT unnest([1, 2, 3]) AS col, unnest(['col_1', 'col_2', 'col_3']) AS name")
def _(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame(list(enumerate(tables.synthetic_headers(3), 1)), "col int, name string")


@query("b09_straddling", """SELECT p_size AS top, p_size + p_partkey % 4 AS bottom FROM part WHERE p_size < 12 AND p_size + p_partkey % 4 >= 12""")
def _(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("p_size")
    spans = read(spark, d, "part").select(F.lit("s").alias("sheet"), s.alias("top"), F.lit(1).alias("left"), (s + F.col("p_partkey") % 4).alias("bottom"), F.lit(2).alias("right"))
    return tables.straddling(spans, 2, 10).select("top", "bottom")


_FILLED = """SELECT p_partkey * 2 + 1 AS row, 1 AS col, p_name AS value, 'anchor' AS policy FROM part
UNION ALL SELECT p_partkey * 2 + 1, 3, p_brand, 'anchor' FROM part
UNION ALL SELECT p_partkey * 2 + 1 + r, c, p_name, 'fill' FROM part, (VALUES (0, 1), (0, 2), (1, 1), (1, 2)) AS v(r, c) UNION ALL SELECT p_partkey * 2 + 1, 3, p_brand, 'fill' FROM part
UNION ALL SELECT p_partkey * 2 + 1, 3, p_brand, 'blank' FROM part"""


@query("b10_merge_policies", _FILLED)
def _(spark: SparkSession, d: str) -> DataFrame:
    part, top = read(spark, d, "part"), (F.col("p_partkey") * 2 + 1).alias("row")
    cells = part.select(F.lit("s").alias("sheet"), top, F.inline(F.array(*[F.struct(F.lit(c).alias("col"), v.alias("value")) for c, v in ((1, F.col("p_name")), (3, F.col("p_brand")), (2, F.concat(F.lit("lost "), "p_brand")))])))
    spans = part.select(F.lit("s").alias("sheet"), top.alias("top"), F.lit(1).alias("left"), (F.col("p_partkey") * 2 + 2).alias("bottom"), F.lit(2).alias("right"))
    out = None
    for policy in ("anchor", "fill", "blank"):
        own = tables.fill_spans(cells, spans, policy).select("row", "col", "value", F.lit(policy).alias("policy"))
        out = own if out is None else out.unionAll(own)
    return out


@query("b11_overlapping_merges", "SELECT a.s_suppkey AS left_id, b.s_suppkey AS right_id FROM supplier a JOIN supplier b ON a.s_suppkey < b.s_suppkey AND abs(a.s_nationkey - b.s_nationkey) <= 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("s_nationkey")
    spans = read(spark, d, "supplier").select(F.lit("s").alias("sheet"), F.col("s_suppkey").alias("id"), n.alias("top"), (n + 1).alias("bottom"), F.lit(1).alias("left"), F.lit(2).alias("right"))
    return tables.overlapping(spans, cell=4).select("left_id", "right_id")


@query("b14_pipe_tables", r"""SELECT p_partkey, p_name || ',b|c' AS header, 'left,right' AS align, CAST(p_size AS VARCHAR) || ',~' AS row, '~,y' AS short, p_partkey % 2 = 0 AS good FROM part""")
def _(spark: SparkSession, d: str) -> DataFrame:
    block = lit_concat("| ", F.col("p_name"), " | b\\|c |\n| :--- | ---: |\n| ", F.col("p_size"), " | |\n|  | y | extra |\n")
    broken = F.lit("| a | b |\n| --- |\n| 1 | 2 |")
    own = read(spark, d, "part").select("p_partkey", tables.pipe_table(block).alias("t"), tables.pipe_table(F.when(F.col("p_partkey") % 2 == 0, block).otherwise(broken)).isNotNull().alias("good"))
    joined = lambda a: F.array_join(a, ",", "~")
    return own.select("p_partkey", joined("t.header").alias("header"), joined("t.align").alias("align"), joined(F.get("t.rows", F.lit(0))).alias("row"), joined(F.get("t.rows", F.lit(1))).alias("short"), "good")


@query("b16_sheet_names", """SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN CASE WHEN k > 1 THEN left(repeat('n', 31), 31 - length('_' || k)) || '_' || k ELSE repeat('n', 31) END ELSE 'a_b' || s_suppkey END AS sheet_name
FROM (SELECT s_suppkey, row_number() OVER (PARTITION BY s_suppkey % 3 = 0 ORDER BY s_suppkey) AS k FROM supplier)""")
def _(spark: SparkSession, d: str) -> DataFrame:
    name = F.when(F.col("s_suppkey") % 3 == 0, F.repeat(F.lit("n"), 40)).otherwise(lit_concat("a/b", F.col("s_suppkey")))
    own = read(spark, d, "supplier").select("s_suppkey", name.alias("name"))
    return tables.sheet_names(own, "name", "s_suppkey").select("s_suppkey", "sheet_name")


@query("b19_empty_rows", "SELECT p_partkey FROM part WHERE p_partkey % 3 = 0")
def _(spark: SparkSession, d: str) -> DataFrame:
    filled = F.col("p_partkey") % 3 == 0
    own = read(spark, d, "part").select("p_partkey", F.when(filled, F.col("p_size")).alias("a"), F.when(filled, F.lit(None)).otherwise(F.lit("  ")).alias("b"))
    return tables.without_empty_rows(own, ["a", "b"]).select("p_partkey")


@query("b20_header_offsets", "SELECT DISTINCT 's' || (p_partkey % 5) AS sheet, CAST(p_partkey % 5 + 2 AS INT) AS row FROM part")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Sheets with up to five rows of one note each, then a header of four texts, then numbers."""
    k = F.pmod("p_partkey", F.lit(5))
    keys = read(spark, d, "part").select(k.cast("int").alias("k")).distinct()
    rows = keys.select(F.concat(F.lit("s"), F.col("k").cast("string")).alias("sheet"), "k", F.explode(F.sequence(F.lit(1), F.col("k") + 8)).alias("row"))
    width = F.when(F.col("row") < F.col("k") + 2, 1).otherwise(4)
    cells = rows.select("sheet", "k", "row", F.explode(F.sequence(F.lit(1), width)).alias("col"))
    return tables.header_offset(cells.select("sheet", "row", "col", F.when(F.col("row") <= F.col("k") + 2, "text").otherwise(F.col("row").cast("string")).alias("value")))


@query("b13_b21_read_regions", """SELECT 's' || k AS sheet, n_nationkey + 71 + k AS _row, CAST(n_nationkey AS VARCHAR) AS key, n_name AS name, CAST(n_regionkey AS VARCHAR) AS other, 'region_' || (k + 1) AS region FROM nation, (VALUES (0), (1), (2)) AS v(k)""")
def _(spark: SparkSession, d: str) -> DataFrame:
    cells, spans = _headed(spark, d)
    regions = spark.createDataFrame([(f"s{k}", 70, 1, 200, 3, "gap", None) for k in range(3)], f"{_SPAN}, source string, name string")
    out = None
    for sheet, name, table, _ in tables.payloads(cells, spans, regions, "gaps", header="leaf"):
        own = table.select(F.lit(sheet).alias("sheet"), "_row", "key", "name", F.col("Other").alias("other"), F.lit(name).alias("region"))
        out = own if out is None else out.unionAll(own)
    return out


@query("b18_union_by_name", "SELECT p_partkey AS key, p_name AS name, NULL::DOUBLE AS balance FROM part UNION ALL SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def _(spark: SparkSession, d: str) -> DataFrame:
    parts = read(spark, d, "part").select(F.col("p_partkey").alias("key"), F.col("p_name").alias("name"))
    suppliers = read(spark, d, "supplier").select(F.col("s_acctbal").alias("balance"), F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"))
    return infer.union_by_name([parts, suppliers])


# --- F ----------------------------------------------------------------------------------------

_LAYERED = r"""e AS (SELECT regexp_extract(url, '://[^/?#]*[.]([a-z]+)', 1) AS layer, 'page' || page_id AS src,
  unnest(list_transform(regexp_extract_all(html, '<a\s[^>]*href="([^"]*)"', 1), lambda h: regexp_extract(regexp_replace(regexp_extract(h, '^([^?#]*)', 1), '/+$', ''), '([^/]*)$', 1))) AS target FROM pages)"""


@query("f04_layer_dangling", f"""WITH {_LAYERED} SELECT layer, target, count(DISTINCT src) AS n_referrers FROM e WHERE target <> '' AND length(target) % 2 = 1 GROUP BY layer, target""")
def _(spark: SparkSession, d: str) -> DataFrame:
    pages = read(spark, d, "pages").select(F.concat(F.lit("page"), F.col("page_id").cast("string")).alias("src"), F.regexp_extract("url", r"://[^/?#]*[.]([a-z]+)", 1).alias("layer"), "html")
    edges = graph.html_links(pages, "src", "html").join(pages.select("src", "layer"), "src")
    return graph.layer_dangling(edges, edges.where(F.length("target") % 2 == 0).select(F.col("target").alias("name")))


@query("f07_bad_prefixes", """SELECT p_partkey AS name, target FROM (SELECT p_partkey, (['courses/a/', 'courses/a', 'courses/b/x/', 'other/', 'courses/a1/'])[p_partkey % 5 + 1] || CASE WHEN p_partkey % 5 = 1 THEN '' ELSE p_name END AS target FROM part)
WHERE NOT (starts_with(target, 'courses/a/') OR starts_with(target, 'courses/b/x/'))""")
def _(spark: SparkSession, d: str) -> DataFrame:
    k, n = F.col("p_partkey"), F.col("p_name")
    target = cases(k, *[F.concat(F.lit(p), n) if p != "courses/a" else F.lit(p) for p in ("courses/a/", "courses/a", "courses/b/x/", "other/", "courses/a1/")])
    notes = read(spark, d, "part").select(k.alias("name"), target.alias("target"))
    return graph.bad_prefixes(notes, spark.createDataFrame([("courses/a",), ("courses/b/x",)], "prefix string"))


@query("f08_shared_pages", r"""WITH l AS (SELECT regexp_extract(url, '://[^/?#]*[.]([a-z]+)', 1) AS layer, regexp_extract(url, '^[^?#]*/([a-z]{2}/[0-9]{1,3})', 1) AS name FROM pages)
SELECT name FROM l WHERE layer = 'org' AND name IN (SELECT name FROM l WHERE layer <> 'org')""")
def _(spark: SparkSession, d: str) -> DataFrame:
    url = F.col("url")
    layers = read(spark, d, "pages").select(F.regexp_extract(url, r"://[^/?#]*[.]([a-z]+)", 1).alias("layer"), F.regexp_extract(url, r"^[^?#]*/([a-z]{2}/[0-9]{1,3})", 1).alias("name"))
    return graph.shared(layers, "org")


@query("f09_group_keys", """SELECT g AS "group", 'n' AS rule_id FROM (SELECT CASE WHEN c_custkey % 5 = 1 THEN NULL ELSE c_mktsegment END AS g FROM customer WHERE c_custkey % 5 <> 0) GROUP BY g HAVING NOT count(*) <= 1""")
def _(spark: SparkSession, d: str) -> DataFrame:
    """A row's group is told by a column of the same row: null is a group, rows with an error code as key are in none."""
    segment = cases(F.col("c_custkey"), F.lit("#REF!"), F.lit(None).cast("string"), *[F.col("c_mktsegment")] * 3)
    own = read(spark, d, "customer").select("c_custkey", "c_acctbal", segment.alias("segment"))
    return run_rules(own, [Rule("n", "c_acctbal", "count_by:segment <= 1")], "customer", F.col("c_custkey")).select("group", "rule_id")


@query("f10_time_fallback", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN n_chars::DOUBLE ELSE quality::DOUBLE END AS time_seconds FROM documents LEFT JOIN labels USING (doc_id)")
def _(spark: SparkSession, d: str) -> DataFrame:
    runs = read(spark, d, "documents").select("doc_id", "n_chars")
    own = F.when(F.col("doc_id") % 2 == 0, F.col("n_chars").cast("double"))
    return files.with_times(runs, read(spark, d, "labels").select("doc_id", F.col("quality").cast("double").alias("_s")), ["doc_id"], own, "_s").select("doc_id", "time_seconds")


@query("f11_comments", """SELECT o_orderkey AS row, string_agg(t, chr(10) ORDER BY t) AS text, (SELECT count(*) FROM (SELECT o_custkey FROM orders GROUP BY o_custkey HAVING NOT sum(o_totalprice) <= 400000)) AS dropped FROM (
  SELECT o_orderkey, '[error] price: o_totalprice fails value <= 300000' AS t FROM orders WHERE NOT o_totalprice <= 300000 UNION ALL SELECT o_orderkey, '[info] even: o_totalprice fails value > 100000' FROM orders WHERE NOT o_totalprice > 100000) GROUP BY 1""")
def _(spark: SparkSession, d: str) -> DataFrame:
    rules = [Rule("price", "o_totalprice", "value <= 300000"), Rule("even", "o_totalprice", "value > 100000", severity="info"), Rule("group", "o_totalprice", "sum_by:o_custkey <= 400000")]
    found = run_rules(read(spark, d, "orders"), rules, "orders", F.col("o_orderkey"))
    return findings.comments(found).select("row", "text").join(F.broadcast(findings.without_cell(found)))


# --- G07, H -----------------------------------------------------------------------------------


@query("g07_findings_order", """WITH f AS (SELECT o_orderkey AS row, 'price' AS rule_id, NULL AS g FROM orders WHERE NOT o_totalprice <= 300000 UNION ALL SELECT o_orderkey, 'cust', NULL FROM orders WHERE NOT o_custkey > 5
  UNION ALL SELECT NULL, 'group', CAST(o_custkey AS VARCHAR) FROM orders GROUP BY o_custkey HAVING NOT count(*) <= 12)
SELECT row, rule_id, g AS "group", row_number() OVER (ORDER BY coalesce(row, 9223372036854775807), CASE rule_id WHEN 'cust' THEN 'o_custkey' ELSE 'o_totalprice' END, rule_id, coalesce(g, '')) AS place FROM f""")
def _(spark: SparkSession, d: str) -> DataFrame:
    rules = [Rule("group", "o_totalprice", "count_by:o_custkey <= 12"), Rule("price", "o_totalprice", "value <= 300000"), Rule("cust", "o_custkey", "value > 5")]
    found = run_rules(read(spark, d, "orders"), rules, "orders", F.col("o_orderkey"))
    keyed = found.select("*", *[c.alias(f"_o{k}") for k, c in enumerate(findings.order())])
    placed = evalstats.numbered(keyed, [f"_o{k}" for k in range(len(findings.order()))])
    return placed.select("row", "rule_id", "group", (F.col("_place") + 1).alias("place"))


@query("h01_cap_bounds", "SELECT 1000 AS n, count(*) > 1000 AS truncated, CASE WHEN count(*) > 1000 THEN (count(*) - 999) || ' findings left out' END AS message FROM orders WHERE NOT o_totalprice <= 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    found = run_rules(read(spark, d, "orders"), [Rule("p", "o_totalprice", "value <= 1")], "orders", F.col("o_orderkey"))
    last = F.col("rule_id") == "truncated"
    return findings.cap(found, 1000).agg(F.count(F.lit(1)).cast("int").alias("n"), F.bool_or(last).alias("truncated"), F.max(F.when(last, F.col("message"))).alias("message"))


@query("h03_limited_report", "SELECT o_orderkey, o_totalprice, (SELECT count(*) > 25 FROM orders) AS truncated FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def _(spark: SparkSession, d: str) -> DataFrame:
    return graph.limited(read(spark, d, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), "o_orderkey"], 25)


@query("h06_primary_files", """SELECT source, name FROM (SELECT source, name, row_number() OVER (PARTITION BY source ORDER BY log10(n_chars + 1) + CASE WHEN name LIKE 'readme%' THEN 5 ELSE 0 END + CASE WHEN name LIKE '%.md' OR name LIKE '%.html' THEN 2 ELSE 0 END DESC, name) AS k
  FROM (SELECT source, n_chars, (['readme', 'notes', 'page'])[doc_id % 3 + 1] || doc_id || (['.md', '.pdf', '.html', '.bin'])[doc_id % 4 + 1] AS name FROM documents)) WHERE k = 1""")
def _(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id")
    name = F.concat(cases(k, *map(F.lit, ("readme", "notes", "page"))), k.cast("string"), cases(k, *map(F.lit, (".md", ".pdf", ".html", ".bin"))))
    own = read(spark, d, "documents").select("source", "n_chars", name.alias("name"))
    return merge.best(own, ["source"], merge.file_score(F.col("name"), F.col("n_chars"), ("readme",)), ["name"]).select("source", "name")


_FACTS = "(SELECT p_partkey AS k, p_brand || ' ' || p_type || ' costs ' || p_size AS t FROM part)"


@query("h10_contradiction_pairs", f"""SELECT a.k AS left_id, b.k AS right_id, lower(split_part(a.t, ' ', 1) || ' ' || split_part(a.t, ' ', 2)) AS head FROM {_FACTS} a JOIN {_FACTS} b
  ON split_part(a.t, ' ', 1) = split_part(b.t, ' ', 1) AND split_part(a.t, ' ', 2) = split_part(b.t, ' ', 2) AND a.k < b.k AND a.t <> b.t""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return merge.contradictions(_facts(spark, d), "k", "t")


@query("h10_contradiction_groups", f"SELECT lower(split_part(t, ' ', 1) || ' ' || split_part(t, ' ', 2)) AS head, count(*) AS n_facts, count(DISTINCT t) AS n_texts FROM {_FACTS} GROUP BY 1 HAVING count(DISTINCT t) > 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    return merge.contradiction_groups(_facts(spark, d), "k", "t")


def _facts(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part").select(F.col("p_partkey").alias("k"), lit_concat(F.col("p_brand"), " ", F.col("p_type"), " costs ", F.col("p_size")).alias("t"))


@query("h13_lost_rows", "SELECT c_nationkey, c_mktsegment FROM customer WHERE c_custkey % 10 = 3")
def _(spark: SparkSession, d: str) -> DataFrame:
    before = read(spark, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    after = before.where("c_custkey % 10 <> 3")
    return evalstats.lost_rows(before.drop("c_custkey"), after.drop("c_custkey"))


# --- K: rows of reports -----------------------------------------------------------------------


@query("k04_markdown_rows", r"""SELECT '| ' || p_partkey || ' | a\|' || p_name || '<br>b |' AS gfm, '<tr><td>' || p_partkey || '</td><td>a|' || p_name || chr(10) || 'b</td></tr>' AS html FROM part""")
def _(spark: SparkSession, d: str) -> DataFrame:
    own = read(spark, d, "part").select("p_partkey", lit_concat("a|", F.col("p_name"), "\nb").alias("text"))
    key = F.regexp_extract("line", r"(\d+)", 1)
    gfm, page = sinks.markdown_rows(own).select(key.alias("k"), F.col("line").alias("gfm")), sinks.html_rows(own).select(key.alias("k"), F.col("line").alias("html"))
    return gfm.join(page, "k").select("gfm", "html")


@query("k08_error_cells", "SELECT '#N/A' AS value, 's' AS sheet, CAST(p_partkey AS INT) AS row, 2 AS col FROM part WHERE p_partkey % 9 = 4")
def _(spark: SparkSession, d: str) -> DataFrame:
    value = F.when(F.col("p_partkey") % 9 == 4, "#N/A").otherwise(F.col("p_name"))
    return sinks.error_cells(read(spark, d, "part").select(F.lit("s").alias("sheet"), F.col("p_partkey").cast("int").alias("row"), F.lit(2).alias("col"), value.alias("value")))


@query("k11_index_rows", "SELECT lang AS kind, 'd' || doc_id AS name, '- [[d' || doc_id || ']] ' || source AS line FROM documents")
def _(spark: SparkSession, d: str) -> DataFrame:
    pages = read(spark, d, "documents").select(F.col("lang").alias("kind"), lit_concat("d", F.col("doc_id")).alias("name"), F.col("source").alias("summary"))
    return sinks.index_rows(pages)


@query("i37_state_report", """WITH k AS (SELECT DISTINCT lang AS kind, 'd' || (doc_id % 50) AS name FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY name) AS p FROM k)
SELECT kind, (SELECT count(*) FROM documents WHERE lang = kind) AS n, string_agg(name, ',' ORDER BY name) FILTER (p <= 20) AS names FROM r GROUP BY kind""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return sinks.state_report(read(spark, d, "documents").select(F.col("lang").alias("kind"), lit_concat("d", F.col("doc_id") % 50).alias("name")))


@query("i37_last_entries", "SELECT event_id, ts FROM events ORDER BY event_id DESC LIMIT 5")
def _(spark: SparkSession, d: str) -> DataFrame:
    return sinks.last_entries(read(spark, d, "events").select("event_id", "ts"), "event_id", 5)


@query("k13_demoted_pages", """SELECT 'l' || (p_partkey % 3) AS layer, p_brand AS name, string_agg(DISTINCT p_name, ',' ORDER BY p_name) AS facts FROM part WHERE p_partkey % 3 < 2 GROUP BY ALL
UNION ALL SELECT 'root', 'kept', 'x'""")
def _(spark: SparkSession, d: str) -> DataFrame:
    """A root page for each brand holds the facts of two layers, one of which has the page already."""
    part = read(spark, d, "part").where("p_partkey % 3 < 2").select(lit_concat("l", F.col("p_partkey") % 3).alias("layer"), F.col("p_brand").alias("name"), F.col("p_name").alias("text"))
    fact = F.collect_set(F.struct("layer", "text"))
    root = part.groupBy("name").agg(fact.alias("facts")).select(F.lit("root").alias("layer"), "name", F.lit("d").alias("description"), "facts")
    there = part.where("layer = 'l0'").groupBy("layer", "name").agg(fact.alias("facts")).select("layer", "name", F.lit("dd").alias("description"), "facts")
    kept = spark.range(1).select(F.lit("root").alias("layer"), F.lit("kept").alias("name"), F.lit("d").alias("description"), F.array(F.struct(F.lit("l0").alias("layer"), F.lit("x").alias("text"))).alias("facts"))
    out = merge.demote(root.unionByName(there).unionByName(kept), "root", part.select("name"))
    return out.select("layer", "name", F.array_join(F.array_sort(F.array_distinct(F.transform("facts", lambda f: f["text"]))), ",").alias("facts"))


@query("k14_promoted_pages", """WITH f AS (SELECT 'l' || (p_partkey % 3) AS layer, p_brand AS name, p_type || ' is ' || p_size AS fact FROM part)
SELECT name, string_agg(DISTINCT layer, ',' ORDER BY layer) AS layers, count(DISTINCT fact) AS n_facts, count(DISTINCT lower(split_part(fact, ' ', 1))) < count(DISTINCT fact) AS contradicted FROM f GROUP BY name HAVING count(DISTINCT layer) > 1""")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "part").select(lit_concat("l", F.col("p_partkey") % 3).alias("layer"), F.col("p_brand").alias("name"), lit_concat(F.col("p_type"), " is ", F.col("p_size")).alias("fact"))
    pages = rows.groupBy("layer", "name").agg(F.collect_set("fact").alias("facts")).withColumn("description", F.lit("d"))
    return merge.promote(pages, "root").select("name", F.array_join("layers", ",").alias("layers"), F.size("facts").cast("long").alias("n_facts"), "contradicted")
