"""Queries of value functions, rules and aggregates (C, D, E), with inputs made from the tables by the same arithmetic in both languages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dqspark.functions import text
from dqspark.functions import values as V
from dqspark.operators import documents, findings, infer
from dqspark.plans.registry import query, read
from dqspark.plans.rules import Rule, RuleError, lint_pattern, parse_check, rules_from, run_rules
from dqspark.plans.scopes import Sheet, parse_scope, qualified, run_book, split_sheet


def cases(key: Column, *options: Column) -> Column:
    """One of the options, by the remainder of a key."""
    k = F.pmod(key, F.lit(len(options)))
    out = options[-1]
    for n in range(len(options) - 2, -1, -1):
        out = F.when(k == n, options[n]).otherwise(out)
    return out


# --- C ----------------------------------------------------------------------------------------


@query("c02_text_dates", """WITH t AS (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y/%m/%d')
  WHEN 2 THEN strftime(o_orderdate, '%d.%m.%Y') WHEN 3 THEN strftime(o_orderdate, '%m/%d/%Y') ELSE '2024-02-31' END AS t FROM orders)
SELECT o_orderkey, coalesce(try_strptime(t, '%Y-%m-%d'), try_strptime(t, '%Y/%m/%d'), try_strptime(t, '%d.%m.%Y'), try_strptime(t, '%m/%d/%Y'))::DATE AS day FROM t""")
def _(spark: SparkSession, d: str) -> DataFrame:
    day = F.col("o_orderdate")
    t = cases(F.col("o_orderkey"), *[F.date_format(day, f) for f in ("yyyy-MM-dd", "yyyy/MM/dd", "dd.MM.yyyy", "MM/dd/yyyy")], F.lit("2024-02-31"))
    return read(spark, d, "orders").select("o_orderkey", V.text_date(t).alias("day"))


@query("c03_serial_dates", """WITH n AS (SELECT o_orderkey, CASE o_orderkey WHEN 0 THEN 25568 WHEN 1 THEN 25569 WHEN 2 THEN 73050 WHEN 3 THEN 73051 ELSE o_orderkey * 37 % 90000 END + 0.5 * (o_orderkey % 2) AS n FROM orders)
SELECT o_orderkey, n BETWEEN 25569 AND 73050 AS is_date, DATE '1899-12-30' + CAST(floor(n) AS INT) AS day FROM n""")
def _(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    whole = F.when(k == 0, 25568).when(k == 1, 25569).when(k == 2, 73050).when(k == 3, 73051).otherwise(k * 37 % 90000)
    n = whole + F.lit(0.5) * (k % 2)
    return read(spark, d, "orders").select("o_orderkey", V.is_serial_date(n).alias("is_date"), V.serial_date(n).alias("day"))


_ISO = ("2024-02-30", "2024-02-29", "2024-13-01T10:00:00", "2024-05-06T07:08:09", "2024-05-06T07:08:09+02:00", "plain text", "20240101")


@query("c07_json_values", f"""WITH t AS (SELECT o_orderkey, CASE o_orderkey % 7 {' '.join(f"WHEN {k} THEN '{v}'" for k, v in enumerate(_ISO))} END AS t FROM orders)
SELECT o_orderkey, o_orderkey % 7 IN (0, 2) AS bad, CASE o_orderkey % 7 WHEN 1 THEN TIMESTAMP '2024-02-29 00:00:00' WHEN 3 THEN TIMESTAMP '2024-05-06 07:08:09' WHEN 4 THEN TIMESTAMP '2024-05-06 05:08:09' END AS moment FROM t""")
def _(spark: SparkSession, d: str) -> DataFrame:
    t = cases(F.col("o_orderkey"), *map(F.lit, _ISO))
    dated = F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}"), V.utc_naive(t))
    return read(spark, d, "orders").select("o_orderkey", V.bad_iso(t).alias("bad"), dated.alias("moment"))


@query("c08_number_text", """SELECT l_orderkey, l_linenumber, printf('%.1f', l_discount * 100) || '%' AS percent, format('{:,}', CAST(l_orderkey * 7919 AS BIGINT)) AS thousands,
  printf('%.2f', l_extendedprice) AS decimals, lpad(CAST(l_suppkey AS VARCHAR), 8, '0') AS padded, strftime(DATE '1899-12-30' + CAST(l_partkey % 40000 AS INT), '%Y-%m-%d') AS day FROM lineitem""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", V.number_text(F.col("l_discount"), "percent:1").alias("percent"), V.number_text(F.col("l_orderkey") * 7919, "thousands:0").alias("thousands"),
        V.number_text(F.col("l_extendedprice"), "decimals:2").alias("decimals"), V.number_text(F.col("l_suppkey"), "zeros:8").alias("padded"), V.number_text(F.col("l_partkey") % 40000, "date").alias("day"),
    )


@query("c09_date_forms", """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS iso FROM orders""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "orders").select("o_orderkey", V.datetime_text(F.col("o_orderdate")).alias("iso"))


@query("c10_rich_runs", "SELECT p_partkey, p_name || ' / ' || p_brand AS flat FROM part")
def _(spark: SparkSession, d: str) -> DataFrame:
    run = lambda t, bold: F.struct(t.alias("text"), F.lit(bold).alias("bold"))
    runs = F.array(run(F.col("p_name"), True), run(F.lit(" / "), False), run(F.lit(None).cast("string"), False), run(F.col("p_brand"), False))
    return read(spark, d, "part").select("p_partkey", V.flat_runs(runs).alias("flat"))


@query("c12_c14_links_and_cells", r"""SELECT page_id, CASE page_id % 3 WHEN 0 THEN '[a|b' || chr(10) || 'c](' || url || ')' WHEN 1 THEN 'a|b' || chr(10) || 'c' ELSE '[a|b' || chr(10) || 'c](mailto:x@y.example)' END AS link,
  'a\|' || url || '<br>c<br>d' AS cell FROM pages""")
def _(spark: SparkSession, d: str) -> DataFrame:
    href = cases(F.col("page_id"), F.col("url"), F.concat(F.lit("javascript:"), F.col("url")), F.lit("mailto:x@y.example"))
    cell = F.concat(F.lit("a|"), F.col("url"), F.lit("\nc\r\nd"))
    return read(spark, d, "pages").select("page_id", V.hyperlink(F.lit("a|b\nc"), href).alias("link"), V.markdown_cell(cell).alias("cell"))


@query("c13_inline_markdown", "SELECT p_partkey, 'bold ' || p_name || ' and link text code, old & <new> \"q\"' AS plain FROM part")
def _(spark: SparkSession, d: str) -> DataFrame:
    marked = F.concat(F.lit("**bold** *"), F.col("p_name"), F.lit("* and [link text](http://h.example/a_b) `code`, ~~old~~ &amp; &lt;new&gt; &quot;q&quot;"))
    return read(spark, d, "part").select("p_partkey", text.unescaped(V.strip_inline_markdown(marked)).alias("plain"))


@query("c15_wiki_slug", r"""SELECT c_custkey, regexp_replace(regexp_replace(lower(c_name) || '-é-' || lower(c_mktsegment) || '-a', '[^\p{L}\p{N}_]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM customer""")
def _(spark: SparkSession, d: str) -> DataFrame:
    # a decomposed e with its accent, and a full-width letter and sign
    raw = F.concat(F.lit("  "), F.col("c_name"), F.lit(" e\u0301! "), F.col("c_mktsegment"), F.lit(" \uff21\uff1f"))
    return read(spark, d, "customer").select("c_custkey", text.wiki_slug(raw).alias("slug"))


@query("c18_dotted_path", """SELECT event_id, json_extract_string('{"a": {"b": {"c": "x' || event_id || '"}, "props": ' || props || '}}', '$.a.b.c') AS deep,
  json_extract_string(props, '$.k') AS k, NULL::VARCHAR AS none FROM events""")
def _(spark: SparkSession, d: str) -> DataFrame:
    doc = F.concat(F.lit('{"a": {"b": {"c": "x'), F.col("event_id").cast("string"), F.lit('"}, "props": '), F.col("props"), F.lit("}}"))
    return read(spark, d, "events").select("event_id", V.json_path(doc, "a.b.c").alias("deep"), V.json_path(doc, "a.props.k").alias("k"), V.json_path(doc, "a.x.y").alias("none"))


@query("c19_page_ranges", """SELECT p_partkey, p_size AS "first", p_size + 2 AS "last", 'part ' || p_partkey AS name FROM part
UNION ALL SELECT p_partkey, p_size + 5, p_size + 5, NULL FROM part""")
def _(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("p_size")
    spec = F.concat(s.cast("string"), F.lit("-"), (s + 2).cast("string"), F.lit(":part "), F.col("p_partkey").cast("string"), F.lit(", "), (s + 5).cast("string"), F.lit(",x-y"))
    return read(spark, d, "part").select("p_partkey", F.inline(V.page_ranges(spec)))


@query("c06_typed_cells", r"""SELECT p_partkey, 'text' AS code_kind, CASE p_partkey % 4 WHEN 0 THEN 'integer' WHEN 1 THEN 'number' WHEN 2 THEN 'date' ELSE 'text' END AS mixed_kind,
  CASE p_partkey % 4 WHEN 0 THEN p_size::DOUBLE WHEN 1 THEN p_size + 0.5 END AS mixed_number FROM part""")
def _(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("p_size").cast("string")
    own = read(spark, d, "part").select("p_partkey", F.concat(F.lit("0"), s).alias("code"), cases(F.col("p_partkey"), s, F.concat(s, F.lit(",5")), F.lit("2024-01-31"), F.lit("x")).alias("mixed"))
    return infer.typed_cells(own, ["code", "mixed"]).select("p_partkey", F.col("code.kind").alias("code_kind"), F.col("mixed.kind").alias("mixed_kind"), F.col("mixed.number").alias("mixed_number"))


@query("c05_typed_columns", """SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k, value AS amount, event_type FROM events""")
def _(spark: SparkSession, d: str) -> DataFrame:
    amount = F.when(F.col("event_id") % 2 == 0, F.replace(F.col("value").cast("string"), F.lit("."), F.lit(","))).otherwise(F.col("value").cast("string"))
    own = read(spark, d, "events").select("event_id", F.concat(F.lit(" "), F.get_json_object("props", "$.k")).alias("k"), amount.alias("amount"), "event_type")
    return infer.typed(own, ["k", "amount", "event_type"])


# --- D ----------------------------------------------------------------------------------------


@query("d04_required", "SELECT o_orderkey AS row, 'status' AS \"column\", 'd04_required' AS rule_id FROM orders WHERE o_orderkey % 5 < 2")
def _(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("o_orderkey") % 5 == 0, F.lit(" \t")).when(F.col("o_orderkey") % 5 != 1, F.col("o_orderstatus"))
    own = read(spark, d, "orders").select("o_orderkey", status.alias("status"))
    return run_rules(own, [Rule("d04_required", "status", "required")], "orders", F.col("o_orderkey")).select("row", "column", "rule_id")


_PATTERNS = ("[A-Z]+", "(a+)+", "(x*)*y", "[", r"\d{4}-\d{2}", "(ab|cd)+", "(a|b+)*", "a" * 1001)


@query("d06_pattern_lint", "SELECT unnest([0, 1, 2, 3, 4, 5, 6, 7]) AS place, unnest([true, false, false, false, true, true, false, false]) AS ok")
def _(spark: SparkSession, d: str) -> DataFrame:
    def good(pattern: str) -> bool:
        try:
            lint_pattern(pattern)
        except RuleError:
            return False
        return True

    return spark.createDataFrame([(k, good(p)) for k, p in enumerate(_PATTERNS)], "place int, ok boolean")


@query("d12_cross_column", """SELECT l_orderkey AS row, 'price' AS rule_id FROM lineitem WHERE NOT l_extendedprice >= l_quantity * 1000 + l_partkey
UNION ALL SELECT l_orderkey, 'same' FROM lineitem WHERE NOT abs(l_linenumber - l_quantity) <= 1e-9""")
def _(spark: SparkSession, d: str) -> DataFrame:
    own = [Rule("price", "l_extendedprice", "value >= [l_quantity] * 1000 + [l_partkey]"), Rule("same", "l_linenumber", "value == [l_quantity]")]
    return run_rules(read(spark, d, "lineitem"), own, "lineitem", F.col("l_orderkey")).select("row", "rule_id")


@query("d14_error_values", """SELECT c_custkey AS row, 'len' AS rule_id, '#N/A' AS value FROM customer WHERE c_custkey % 7 = 3
UNION ALL SELECT c_custkey, 'error', c_mktsegment FROM customer WHERE c_custkey % 7 <> 3""")
def _(spark: SparkSession, d: str) -> DataFrame:
    own = read(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 7 == 3, "#N/A").otherwise(F.col("c_mktsegment")).alias("segment"))
    rules = [Rule("len", "segment", "len >= 1"), Rule("error", "segment", "is_error")]
    return run_rules(own, rules, "customer", F.col("c_custkey")).select("row", "rule_id", "value")


@query("d15_messages", """SELECT o_orderkey AS row, 'orders!' || o_orderkey || ' o_totalprice is ' || CAST(o_orderkey % 11 AS VARCHAR) || ', not 5: $odd' AS message FROM orders WHERE o_orderkey % 11 > 5""")
def _(spark: SparkSession, d: str) -> DataFrame:
    own = read(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 11).alias("o_totalprice"))
    rule = Rule("m", "o_totalprice", "value <= 5", message="$table!$row $column is $value, not 5: $odd")
    return run_rules(own, [rule], "orders", F.col("o_orderkey")).select("row", "message")


@query("d16_d18_scopes", """WITH s AS (SELECT o_orderkey + 2 AS r, o_totalprice AS a, o_custkey AS b FROM orders)
SELECT 'Q1 ''26' AS "table", r AS row, 'total' AS "column", 'range' AS rule_id FROM s WHERE r BETWEEN 5 AND 40 AND NOT a <= 100000
UNION ALL SELECT 'Q1 ''26', r, 'cust', 'column' FROM s WHERE NOT b > 20
UNION ALL SELECT 'Q1 ''26', r, 'total', 'letters' FROM s WHERE NOT a < 400000
UNION ALL SELECT 'Q1 ''26', r, 'cust', 'letters' FROM s WHERE NOT b < 400000
UNION ALL SELECT 'Q1 ''26', r, 'cust', 'cell' FROM s WHERE r = 7
UNION ALL SELECT 'Q1 ''26', r, 'total', 'row' FROM s WHERE r = 9
UNION ALL SELECT 'Q1 ''26', r, 'cust', 'row' FROM s WHERE r = 9
UNION ALL SELECT 'Q1 ''26', r, 'cust', 'named' FROM s WHERE r BETWEEN 3 AND 6
UNION ALL SELECT 'Q1 ''26', r, 'cust', 'table' FROM s WHERE r BETWEEN 11 AND 20
UNION ALL SELECT 'Parts', p_partkey + 2, 'size', 'sheet' FROM part WHERE NOT p_size < 45
UNION ALL SELECT 'Q1 ''26', NULL, 'total', 'mean' FROM s WHERE r BETWEEN 2 AND 11 HAVING NOT avg(a) < 0""")
def _(spark: SparkSession, d: str) -> DataFrame:
    orders = read(spark, d, "orders").select((F.col("o_orderkey") + 2).alias("r"), F.col("o_totalprice").alias("total"), F.col("o_custkey").alias("cust"))
    parts = read(spark, d, "part").select((F.col("p_partkey") + 2).alias("r"), F.col("p_size").alias("size"))
    sheets = {"Q1 '26": Sheet(orders, "r"), "Parts": Sheet(parts, "r")}
    rules = rules_from("""
version: 1
defaults: {severity: warning}
rules:
  - id: range          # the first 39 rows of data
    scope: "'Q1 ''26'!A5:A40"
    check: value <= 100000
  - {id: column, scope: "col:cust", check: value > 20}
  - {id: letters, scope: "cols:A,B", check: "value < 400000"}
  - id: cell
    scope: "cell:'Q1 ''26'!B7"
    check: is_text
  - id: row
    scope: row:9
    check: is_text
  - {id: named, scope: "named:Top", check: is_text}
  - {id: table, scope: "table:Block[cust]", check: is_text}
  - {id: sheet, scope: "sheet:Parts", check: "value < 45"}
  - {id: mean, scope: "A2:A11", check: "avg() < 0"}
""")
    out = run_book(sheets, rules, {"Top": "B3:B6"}, {"Block": "'Q1 ''26'!A10:B20"})
    return out.select("table", "row", "column", "rule_id")


_SCOPES = ("cell:H1", "A2:A100", "Sheet2!col:Hours", "'Q1 2026'!col:Hours", "'Bob''s Sheet'!A1:B2", "table:T1[Hours]", "row:x", "'open!A1:B2", "a:b!col:x")


@query("d18_sheet_names", """SELECT unnest([0, 1, 2, 3, 4, 5, 6, 7, 8]) AS place, unnest([NULL, NULL, 'Sheet2', 'Q1 2026', 'Bob''s Sheet', NULL, 'error', 'error', 'error']) AS sheet,
  unnest(['cell', 'range', 'cols', 'cols', 'range', 'table', NULL, NULL, NULL]) AS kind""")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = []
    for k, t in enumerate(_SCOPES):
        try:
            s = parse_scope(t)
            assert s.sheet is None or split_sheet(qualified(s.sheet, "col:x")) == (s.sheet, "col:x")
            rows.append((k, s.sheet, s.kind))
        except RuleError:
            rows.append((k, "error", None))
    return spark.createDataFrame(rows, "place int, sheet string, kind string")


@query("d17_headers", "SELECT l_orderkey AS row, ' l_quantity ' AS \"column\" FROM lineitem WHERE NOT l_quantity <= 40")
def _(spark: SparkSession, d: str) -> DataFrame:
    own = read(spark, d, "lineitem").select("l_orderkey", F.col("l_quantity").alias(" l_quantity "), F.col("l_tax").alias("L_QUANTITY"))
    return run_rules(own, [Rule("h", "l_quantity", "value <= 40")], "lineitem", F.col("l_orderkey")).select("row", "column")


_CHECKS = ("value<=5", "value  <=  5", "between: 1, 3", "between:1,3", "in [a, 'b']", "in ['a','b']", "sum(x) > 3", "sum( x )>3")


@query("d19_canonical", "SELECT unnest([0, 1, 2, 3, 4, 5, 6, 7]) AS place, unnest([0, 0, 2, 2, 4, 4, 6, 6]) AS same_as")
def _(spark: SparkSession, d: str) -> DataFrame:
    seen: dict[str, int] = {}
    rows = [(k, seen.setdefault(parse_check(c).canonical(), k)) for k, c in enumerate(_CHECKS)]
    return spark.createDataFrame(rows, "place int, same_as int")


@query("a08_rule_files", "SELECT unnest(['json', 'yaml', 'anchor', 'tag', 'twice', 'version', 'scope and column']) AS source, unnest([2, 2, NULL, NULL, NULL, NULL, NULL]) AS n_rules")
def _(spark: SparkSession, d: str) -> DataFrame:
    sources = {
        "json": '{"version": 1, "rules": [{"id": "a", "column": "x", "check": "value > 1"}, {"id": "b", "scope": "col:y", "check": "required"}]}',
        "yaml": "# rules\nversion: 1\nrules:\n- id: a\n  column: x\n  check: 'value > 1'\n- {id: b, scope: 'col:y', check: required}\n",
        "anchor": "version: 1\nrules:\n- &a {id: a, column: x, check: required}\n",
        "tag": "version: !!int 1\nrules: []\n",
        "twice": "version: 1\nversion: 1\nrules: []\n",
        "version": "version: 2\nrules: []\n",
        "scope and column": "version: 1\nrules:\n- {id: a, scope: 'col:y', column: x, check: required}\n",
    }

    def size(source: str) -> int | None:
        try:
            return len(rules_from(source))
        except RuleError:
            return None

    return spark.createDataFrame([(n, size(s)) for n, s in sources.items()], "source string, n_rules int")


# --- E ----------------------------------------------------------------------------------------


@query("e19_exit_codes", """SELECT l_suppkey, CASE WHEN e > 0 THEN 1 WHEN w > 0 THEN 2 ELSE 0 END AS code, CASE WHEN e > 0 OR w > 0 THEN 1 ELSE 0 END AS strict FROM (
  SELECT l_suppkey, count(*) FILTER (l_quantity > 49 AND l_tax > 0.07) AS e, count(*) FILTER (l_quantity > 48) AS w FROM lineitem GROUP BY l_suppkey)""")
def _(spark: SparkSession, d: str) -> DataFrame:
    counted = read(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count_if(F.expr("l_quantity > 49 AND l_tax > 0.07")).alias("e"), F.count_if(F.expr("l_quantity > 48")).alias("w"))
    e, w = F.col("e"), F.col("w")
    return counted.select("l_suppkey", findings.exit_code(e, w).alias("code"), findings.exit_code(e, w, strict=True).alias("strict"))


@query("e22_scanned_documents", """SELECT l_orderkey, bool_or(l_quantity > 25) AND bool_and(l_linenumber * 12 <= 50) AS scanned FROM lineitem GROUP BY l_orderkey""")
def _(spark: SparkSession, d: str) -> DataFrame:
    pages = read(spark, d, "lineitem").select("l_orderkey", (F.col("l_quantity") > 25).alias("scanned"), (F.col("l_linenumber") * 12).alias("char_count"))
    return documents.scanned_documents(pages, "l_orderkey")
