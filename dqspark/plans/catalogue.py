"""All registered queries of the data-quality and document operators, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dqspark.functions import captions, html, scan, text
from dqspark.functions import values as V
from dqspark.operators import evalstats, findings, folds, graph, merge, tables
from dqspark.plans.registry import ORACLES, QUERIES, query, read
from dqspark.plans.rules import Rule, run_rules
from dqspark.session import shared_dir

# --- J, E18: content scanning ----------------------------------------------------------------

_PII = {p.name.replace(" ", "_"): p.regex for p in scan.PERSONAL}
_N = ", ".join(f"CAST(sum(len(regexp_extract_all(text, '{r}'))) AS BIGINT) AS n_{n}" for n, r in _PII.items())


@query("j04_pii_counts", f"SELECT lang, count(*) AS n_docs, {_N} FROM documents GROUP BY lang")
def _(spark: SparkSession, d: str) -> DataFrame:
    per_doc = read(spark, d, "documents").select("lang", *scan.counts(F.col("text"), scan.PERSONAL))
    names = [c for c in per_doc.columns if c.startswith("n_")]
    return per_doc.groupBy("lang").agg(F.count(F.lit(1)).alias("n_docs"), *[F.sum(c).alias(c) for c in names])


_FLAGS = ", ".join(f"regexp_matches(text, '{p.regex}') AS {p.name.replace(' ', '_')}" for p in scan.INJECTION)


@query("j03_injection_flags", f"SELECT doc_id, {_FLAGS} FROM documents")
def _(spark: SparkSession, d: str) -> DataFrame:
    own = read(spark, d, "documents").select("doc_id", "text", scan.folded(F.col("text")).alias("lower"))
    return own.select("doc_id", *[scan.matches(F.col("text"), p, F.col("lower")).alias(p.name.replace(" ", "_")) for p in scan.INJECTION])


_ISSUES = "\nUNION ALL\n".join(
    f"SELECT doc_id, '{p.name}' AS name, '{p.category}' AS category, '{p.severity}' AS severity, "
    f"CAST(len(split(regexp_extract(text, '(?s)^(.*?)(?:{p.regex})', 1), chr(10))) AS BIGINT) AS line FROM documents WHERE regexp_matches(text, '{p.regex}')"
    for p in scan.ALL
)


@query("j01_j02_j04_issues", _ISSUES)
def _(spark: SparkSession, d: str) -> DataFrame:
    return scan.issues(read(spark, d, "documents"), "doc_id", "text")


@query(
    "j05_long_lines",
    f"""SELECT doc_id, line, CAST(length(content) AS BIGINT) AS chars FROM (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS content, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents)
WHERE length(content) > {scan.LONG_LINE}""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return scan.long_lines(read(spark, d, "documents"), "doc_id", "text")


@query(
    "j05_line_entropy",
    """WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS content, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents
), c AS (
  SELECT doc_id, line, length(content) AS n, unnest(string_split(content, '')) AS ch FROM l WHERE length(content) > 50
), k AS (
  SELECT doc_id, line, n, ch, count(*) AS m FROM c GROUP BY ALL
)
SELECT doc_id, line, round(-sum((m / n) * log2(m / n)), 6) AS bits FROM k GROUP BY doc_id, line""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    own = scan.lines(read(spark, d, "documents"), "doc_id", "text").where(F.length("content") > scan.ENTROPY_CHARS)
    return own.select("doc_id", "line", F.round(scan.entropy(F.col("content")), 6).alias("bits"))


_ANY = {s: " OR ".join(f"regexp_matches(text, '{p.regex}')" for p in scan.ALL if p.severity == s) for s in ("critical", "error")}


@query("e18_risk_level", f"SELECT source, CASE WHEN {_ANY['critical']} THEN 'DANGER' WHEN {_ANY['error']} THEN 'CAUTION' ELSE 'SAFE' END AS risk, count(*) AS n FROM documents GROUP BY ALL")
def _(spark: SparkSession, d: str) -> DataFrame:
    own = read(spark, d, "documents").select("source", "text", scan.folded(F.col("text")).alias("lower"))
    return own.select("source", scan.risk_level(F.col("text"), lower=F.col("lower")).alias("risk")).groupBy("source", "risk").agg(F.count(F.lit(1)).alias("n"))


# --- H02, I: search and text -----------------------------------------------------------------

_TERMS = ["licensed", "version", "the"]


@query("h02_keyword_search", "SELECT doc_id, CAST(len(regexp_extract_all(lower(text), 'licensed|version|the')) AS BIGINT) AS score FROM documents WHERE regexp_matches(lower(text), 'licensed|version|the') ORDER BY score DESC, doc_id LIMIT 50")
def _(spark: SparkSession, d: str) -> DataFrame:
    return graph.search(read(spark, d, "documents"), "doc_id", "text", _TERMS, 50)


@query("i22_first_sentence")
def _(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", text.first_sentence(F.col("text")).alias("sentence"))


_VISIBLE = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '<!--.*?-->', ' ', 'gs'), '<(script|style|noscript|template)\b[^>]*>.*?</(?:script|style|noscript|template)\s*>', ' ', 'gis'), '<[^>]*>', ' ', 'gs'), '[\s\x{00A0}]+', ' ', 'g'))"


@query("i01_text_length", f"SELECT page_id, CAST(length({_VISIBLE}) AS BIGINT) AS chars FROM pages")
def _(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "pages").select("page_id", html.text_length(F.col("html")).cast("long").alias("chars"))


@query("i03_meta", r"SELECT page_id, nullif(trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\s+', ' ', 'g')), '') AS title, url FROM pages")
def _(spark: SparkSession, d: str) -> DataFrame:
    m = html.metadata(F.col("html"), F.col("url"))
    return read(spark, d, "pages").select("page_id", m.alias("m")).select("page_id", F.col("m.title").alias("title"), F.col("m.url").alias("url"))


@query("i09_page_markdown")
def _(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "pages").select("page_id", html.page_markdown("html").alias("markdown"))


@query("i07_reader_markdown")
def _(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "pages").select("page_id", html.reader_markdown("html").alias("markdown"))


@query("i10_tidy")
def _(spark: SparkSession, d: str) -> DataFrame:
    marked = read(spark, d, "pages").select("page_id", html.page_markdown("html").alias("md"))
    return marked.select("page_id", html.tidy_markdown(F.col("md")).alias("markdown"))


@query("i17_i18_hosts", r"""SELECT host, count(*) AS n FROM (
  SELECT lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)) AS h,
         regexp_extract(h, '([^.]+\.[^.]+)$', 1) AS host FROM pages) GROUP BY host""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "pages").select(text.registrable(F.col("url")).alias("host")).groupBy("host").agg(F.count(F.lit(1)).alias("n"))


@query("c15_c16_slug_id", r"""SELECT doc_id, regexp_replace(regexp_replace(lower(text), '[^\p{L}\p{N}_]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug,
  left(sha1(text), 12) AS id, sha256(text) AS content_hash FROM documents""")
def _(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return read(spark, d, "documents").select("doc_id", V.slug(t).alias("slug"), V.stable_id(t).alias("id"), V.content_hash(t).alias("content_hash"))


# --- F: link graph of the pages --------------------------------------------------------------


def _edges(spark: SparkSession, d: str) -> DataFrame:
    pages = read(spark, d, "pages").select(F.concat(F.lit("page"), F.col("page_id").cast("string")).alias("src"), "html")
    return graph.html_links(pages, "src", "html")


def _names(spark: SparkSession, d: str) -> DataFrame:
    """Pages for the link graph: every link target with an even length is one, so are the linking pages themselves."""
    edges = _edges(spark, d)
    known = edges.where(F.length("target") % 2 == 0).select(F.col("target").alias("name")).distinct().withColumn("kind", F.lit("concept"))
    return known.unionByName(edges.select(F.col("src").alias("name")).distinct().withColumn("kind", F.lit("source")))


_EDGES_SQL = r"""e AS (
  SELECT src, regexp_extract(regexp_replace(regexp_extract(href, '^([^?#]*)', 1), '/+$', ''), '([^/]*)$', 1) AS target,
         nullif(regexp_extract(href, '#(.*)$', 1), '') AS anchor
  FROM (SELECT 'page' || page_id AS src, unnest(regexp_extract_all(html, '<a\s[^>]*href="([^"]*)"', 1)) AS href FROM pages)
), edges AS (SELECT * FROM e WHERE target <> ''),
names AS (
  SELECT DISTINCT target AS name, 'concept' AS kind FROM edges WHERE length(target) % 2 = 0
  UNION ALL SELECT DISTINCT src, 'source' FROM edges
)"""


@query("f01_dangling_links", f"""WITH {_EDGES_SQL}
SELECT target, count(DISTINCT src) AS n_referrers, array_to_string(list_sort(list(DISTINCT src)), ',') AS referrers
FROM edges WHERE target NOT IN (SELECT name FROM names) GROUP BY target""")
def _(spark: SparkSession, d: str) -> DataFrame:
    lost = graph.dangling(_edges(spark, d), _names(spark, d))
    return lost.select("target", "n_referrers", F.array_join("referrers", ",").alias("referrers"))


@query("f02_orphans", rf"""WITH {_EDGES_SQL}, listed AS (
  SELECT DISTINCT regexp_extract(regexp_replace(regexp_extract(url, '^([^?#]*)', 1), '/+$', ''), '([^/]*)$', 1) AS name FROM pages)
SELECT name FROM listed WHERE name <> '' AND name NOT IN (SELECT target FROM edges WHERE src <> target)""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return graph.orphans(_edges(spark, d), _listed(spark, d))


def _listed(spark: SparkSession, d: str) -> DataFrame:
    """Pages for the orphan test, linked or not: the last path segment of each page's own url."""
    path = F.regexp_extract("url", r"^([^?#]*)", 1)
    own = F.regexp_extract(F.regexp_replace(path, r"/+$", ""), r"([^/]*)$", 1)
    return read(spark, d, "pages").select(own.alias("name")).where("name != ''").distinct().withColumn("kind", F.lit("concept"))


@query("f03_missing", f"""WITH {_EDGES_SQL}, m AS (
  SELECT lower(target) AS key, count(DISTINCT src) AS n_sources, arg_min(target, {{'p': src, 't': target}}) AS concept FROM edges GROUP BY 1)
SELECT concept, n_sources FROM m WHERE n_sources >= 2 AND key NOT IN (SELECT lower(name) FROM names)""")
def _(spark: SparkSession, d: str) -> DataFrame:
    mentions = _edges(spark, d).select("src", F.col("target").alias("concept"), F.col("src").alias("pos"))
    return graph.missing(mentions, _names(spark, d))


_LAYERS_SQL = r"""layers AS (
  SELECT regexp_extract(url, '://[^/?#]*[.]([a-z]+)', 1) AS layer, regexp_extract(url, '^[^?#]*/([a-z]{2}/[0-9]{1,3})', 1) AS name FROM pages)"""


def _layers(spark: SparkSession, d: str) -> DataFrame:
    url = F.col("url")
    return read(spark, d, "pages").select(F.regexp_extract(url, r"://[^/?#]*[.]([a-z]+)", 1).alias("layer"), F.regexp_extract(url, r"^[^?#]*/([a-z]{2}/[0-9]{1,3})", 1).alias("name"))


@query("f05_duplicates", f"""WITH {_LAYERS_SQL}
SELECT name, array_to_string(list_sort(list(DISTINCT layer)), ',') AS layers FROM layers GROUP BY name HAVING count(DISTINCT layer) >= 2""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return graph.duplicates(_layers(spark, d)).select("name", F.array_join("layers", ",").alias("layers"))


@query("f06_invariant", f"""WITH {_LAYERS_SQL}
SELECT name FROM layers WHERE layer = 'net' AND name IN (SELECT name FROM layers WHERE layer <> 'net')""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return graph.shared(_layers(spark, d), "net")


@query("f14_reachable", f"""WITH RECURSIVE {_EDGES_SQL}, links AS (
  SELECT src, target FROM edges UNION ALL SELECT target, src FROM edges WHERE length(target) % 3 = 0
), r AS (SELECT 'page0' AS name UNION SELECT l.target FROM r JOIN links l ON l.src = r.name)
SELECT name FROM r""")
def _(spark: SparkSession, d: str) -> DataFrame:
    edges = _edges(spark, d).select("src", "target")
    back = edges.where(F.length("target") % 3 == 0).select(F.col("target").alias("src"), F.col("src").alias("target"))
    shared_dir(spark)
    return graph.reachable(edges.unionAll(back), spark.range(1).select(F.lit("page0").alias("name")))


# --- E11 to E21, G11: evaluation statistics --------------------------------------------------


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", "source", "lang", "n_chars").join(read(spark, d, "labels"), "doc_id")


@query("e11_run_stats", """SELECT source, count(quality) AS n, round(avg(quality), 4) AS mean, round(coalesce(stddev_samp(quality), 0), 4) AS stddev,
  round(min(quality)::DOUBLE, 4) AS min, round(max(quality)::DOUBLE, 4) AS max FROM documents JOIN labels USING (doc_id) GROUP BY source""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return evalstats.stats(_labelled(spark, d), ["source"], "quality")


@query("e12_delta", """SELECT source, round(avg(quality) FILTER (lang = 'en'), 4) AS treatment, round(avg(quality) FILTER (lang = 'de'), 4) AS baseline,
  round(avg(quality) FILTER (lang = 'en') - avg(quality) FILTER (lang = 'de'), 4) AS delta FROM documents JOIN labels USING (doc_id) GROUP BY source""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return evalstats.delta(_labelled(spark, d), "lang", "quality", "en", "de", ["source"])


@query("e13_percentile", """SELECT lang, round(quantile_cont(n_chars::DOUBLE, 0.05), 4) AS p5, round(quantile_cont(n_chars::DOUBLE, 0.5), 4) AS p50, round(quantile_cont(n_chars::DOUBLE, 0.95), 4) AS p95 FROM documents GROUP BY lang""")
def _(spark: SparkSession, d: str) -> DataFrame:
    out = evalstats.percentiles(read(spark, d, "documents"), ["lang"], "n_chars", [0.05, 0.5, 0.95])
    return out.select("lang", *[F.round(c, 4).alias(c) for c in ("p5", "p50", "p95")])


@query("e14_bootstrap_ci")
def _(spark: SparkSession, d: str) -> DataFrame:
    return evalstats.bootstrap_delta(_labelled(spark, d), "lang", "quality", "en", "de", n=200, key="doc_id")


@query("e15_trigger_rate", """SELECT user_id, count(*) AS runs, round(avg((event_type = 'purchase')::INT), 4) AS rate, bool_and(user_id % 2 = 0) AS expected,
  CASE WHEN bool_and(user_id % 2 = 0) THEN round(avg((event_type = 'purchase')::INT), 4) >= 0.2 ELSE round(avg((event_type = 'purchase')::INT), 4) < 0.2 END AS pass
FROM events GROUP BY user_id""")
def _(spark: SparkSession, d: str) -> DataFrame:
    runs = read(spark, d, "events").select("user_id", (F.col("event_type") == "purchase").alias("hit"), (F.col("user_id") % 2 == 0).alias("want"))
    return evalstats.trigger_rates(runs, "user_id", "hit", "want", 0.2)


_DIVERSITY_SQL = r"""w AS (SELECT item_id, list_filter(string_split_regex(lower(text), '\s+'), lambda x: x <> '') AS ws FROM benchmark),
g AS (SELECT item_id, list_distinct(CASE WHEN len(ws) > 1 THEN list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) ELSE ws END) AS s FROM w),
n AS (SELECT count(*) AS n FROM g),
p AS (
  SELECT a.s AS x, b.s AS y FROM g a JOIN g b ON a.item_id < b.item_id, n WHERE n <= 100
  UNION ALL
  SELECT s, coalesce(lead(s) OVER (ORDER BY item_id), first_value(s) OVER (ORDER BY item_id)) FROM g, n WHERE n > 100),
dv AS (SELECT round(1 - avg(len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y)))), 4) AS diversity FROM p)"""


@query("e17_diversity", f"WITH {_DIVERSITY_SQL} SELECT diversity FROM dv")
def _(spark: SparkSession, d: str) -> DataFrame:
    return evalstats.diversity(read(spark, d, "benchmark"), "item_id", "text")


@query("e16_dataset_quality", f"""WITH {_DIVERSITY_SQL}, q AS (
  SELECT count(*) AS n, round(1.0, 4) AS schema,
         CASE WHEN count(*) FILTER (item_id % 4 = 0) > 0 AND count(*) FILTER (item_id % 4 <> 0) > 0 THEN 1.0 ELSE 0.5 END AS forbidden,
         round(count(DISTINCT lower(trim(text))) / count(*), 4) AS uniqueness, round(least(1.0, count(*) / 5), 4) AS count FROM benchmark)
SELECT n, schema::DOUBLE AS schema, forbidden::DOUBLE AS forbidden, uniqueness::DOUBLE AS uniqueness, count::DOUBLE AS count, diversity,
       round(0.30 * schema + 0.25 * forbidden + 0.20 * uniqueness + 0.15 * diversity + 0.10 * count, 4)::DOUBLE AS score FROM q, dv""")
def _(spark: SparkSession, d: str) -> DataFrame:
    items = read(spark, d, "benchmark").select(
        F.col("item_id").alias("id"), F.col("text").alias("prompt"), (F.col("item_id") % 4 == 0).alias("should_trigger"), F.lit(1).alias("n_expectations"), F.lit(0).alias("n_forbidden")
    )
    return evalstats.dataset_quality(items)


@query("e21_votes", """WITH v AS (SELECT doc_id // 2 AS pair, CASE WHEN quality = 1 THEN 'first' ELSE 'second' END AS winner, doc_id % 2 = 0 AS swapped FROM labels),
c AS (SELECT pair, sum(CASE WHEN swapped THEN (winner = 'first')::INT ELSE (winner = 'second')::INT END)::BIGINT AS candidate_votes, count(*) AS n FROM v GROUP BY pair)
SELECT pair, candidate_votes, n - candidate_votes AS champion_votes,
  CASE WHEN candidate_votes > n - candidate_votes THEN 'candidate' WHEN candidate_votes < n - candidate_votes THEN 'champion' ELSE 'tie' END AS decision FROM c""")
def _(spark: SparkSession, d: str) -> DataFrame:
    own = read(spark, d, "labels").select(F.expr("doc_id div 2").alias("pair"), F.when(F.col("quality") == 1, "first").otherwise("second").alias("winner"), (F.col("doc_id") % 2 == 0).alias("swapped"))
    return evalstats.votes(own, "pair", "winner", "swapped")


@query("g11_stratified_split", """WITH r AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY md5('0:' || doc_id), doc_id) AS k,
  count(*) OVER (PARTITION BY quality) AS n FROM labels)
SELECT doc_id, quality, CASE WHEN k <= greatest(1, floor(n * 0.3)) THEN 'test' ELSE 'train' END AS split FROM r""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return evalstats.stratified_split(read(spark, d, "labels").select("doc_id", "quality"), "doc_id", "quality", 0.3)


@query("e20_h14_differences", """SELECT l_returnflag, l_linestatus, 'left' AS side FROM lineitem WHERE l_quantity > 49
UNION ALL SELECT NULL, NULL, 'left' WHERE false""")
def _(spark: SparkSession, d: str) -> DataFrame:
    items = read(spark, d, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity")
    pruned = items.where(~(F.col("l_quantity") > 49))
    return evalstats.differing(items.drop("l_quantity"), pruned.drop("l_quantity"))


# --- G: sequences ----------------------------------------------------------------------------


@query("g02_overlap_dedup")
def _(spark: SparkSession, d: str) -> DataFrame:
    cues = F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda t: captions.clean_cue(t["text"]))
    own = read(spark, d, "conversations").where("text is not null").groupBy("conv_id").agg(cues.alias("cues"))
    merged = captions.merge_rolling(F.col("cues"))
    return own.select("conv_id", F.size("cues").alias("n_cues"), F.size(merged).alias("n_merged"), captions.paragraphs(merged).alias("text"))


@query("g04_ladder", """SELECT source, lang, doc_id FROM (
  SELECT source, lang, doc_id, row_number() OVER (PARTITION BY source ORDER BY CASE lang WHEN 'fr' THEN 0 WHEN 'de' THEN 1 WHEN 'en' THEN 2 END, doc_id) AS k
  FROM documents WHERE lang IN ('fr', 'de', 'en')) WHERE k = 1""")
def _(spark: SparkSession, d: str) -> DataFrame:
    rank = folds.preference(F.lit("text"), F.col("lang"), ("text",), ("fr", "de", "en"))
    return folds.ladder(read(spark, d, "documents").select("source", "lang", "doc_id"), ["source"], rank, ["doc_id", "lang"]).select("source", "lang", "doc_id")


@query("g05_improvement_loop")
def _(spark: SparkSession, d: str) -> DataFrame:
    runs = read(spark, d, "events").groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "value"))), lambda e: e["value"]).alias("scores"))
    loop = folds.improvement_loop(F.slice("scores", 2, 1_000_000), F.get("scores", F.lit(0)), 5.0, 4, 95.0)
    return runs.select("user_id", loop.alias("s")).select("user_id", "s.*")


@query("g10_first_match_in_budget", """WITH c AS (SELECT user_id, event_type AS call, min({'ts': ts, 'id': event_id}) AS f, min(CASE WHEN event_type = 'purchase' THEN {'ts': ts, 'id': event_id} END) AS h FROM events GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY f) AS k FROM c)
SELECT user_id, count(*) AS distinct_calls, CAST(min(k) FILTER (h IS NOT NULL) AS INT) AS first_match, coalesce(min(k) FILTER (h IS NOT NULL) <= 2, false) AS triggered FROM r GROUP BY user_id""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return folds.first_match_in_budget(read(spark, d, "events"), "user_id", ["ts", "event_id"], F.col("event_type"), F.col("event_type") == "purchase", 2)


# --- D, E01 to E10, G06, G07, H01: the rules engine ------------------------------------------


def _row_query(name: str, table: str, key: str, column: str, check: object, good: str, empty: bool = False, **more: object) -> None:
    """A query of the rows that break one rule, and the SQL of the same."""
    sql_value = f"CAST({column} AS VARCHAR)"
    skip = "" if empty else f"{column} IS NOT NULL AND "
    when = f"({more['when_sql']}) AND " if "when_sql" in more else ""
    sql = f"SELECT {key} AS row, '{column}' AS \"column\", '{name}' AS rule_id FROM {table} WHERE {when}{skip}NOT coalesce({good}, false)"
    del sql_value

    def run(spark: SparkSession, d: str) -> DataFrame:
        rule = Rule(name, column, check, when=more.get("when"))
        return run_rules(read(spark, d, table), [rule], table, F.col(key)).select("row", "column", "rule_id")

    QUERIES[name], ORACLES[name] = run, sql


_row_query("d01_compare", "lineitem", "l_orderkey", "l_quantity", "value <= 45", "l_quantity <= 45 + 0")
_row_query("d01_equals_tolerant", "lineitem", "l_orderkey", "l_discount", "value != 0.05", "abs(l_discount - 0.05) > 1e-9")
_row_query("d02_between", "orders", "o_orderkey", "o_totalprice", "between:1000,300000", "o_totalprice BETWEEN 1000 AND 300000")
_row_query("d03_in", "orders", "o_orderkey", "o_orderpriority", "in ['1-URGENT', '2-HIGH', '3-MEDIUM']", "o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM')")
_row_query("d03_not_in", "customer", "c_custkey", "c_mktsegment", "not in [BUILDING, 'MACHINERY']", "c_mktsegment NOT IN ('BUILDING', 'MACHINERY')")
_row_query("d04_is_number", "customer", "c_custkey", "c_name", "is_number", "false")
_row_query("d05_regex", "customer", "c_custkey", "c_name", "regex:.*[0-4]", "regexp_full_match(c_name, '.*[0-4]')")
_row_query("d07_len", "part", "p_partkey", "p_name", "len <= 10", "length(trim(p_name)) <= 10")
_row_query("d08_starts_with", "part", "p_partkey", "p_type", "starts_with:S", "starts_with(p_type, 'S')")
_row_query("d09_date_in_month", "orders", "o_orderkey", "o_orderdate", "date_in_month:1995-03", "strftime(o_orderdate, '%Y-%m') = '1995-03'")
_row_query("d09_date_in_range", "orders", "o_orderkey", "o_orderdate", "date_in_range:1994-01-01,1996-12-31", "o_orderdate::DATE BETWEEN DATE '1994-01-01' AND DATE '1996-12-31'")
_row_query("d09_date_weekday", "orders", "o_orderkey", "o_orderdate", "date_weekday:0,1,2,3,4", "isodow(o_orderdate) <= 5")
_row_query("d10_composite", "lineitem", "l_orderkey", "l_quantity", {"or": ["value < 10", {"and": ["value > 20", {"not": "value >= 40"}]}]}, "l_quantity < 10 OR (l_quantity > 20 AND NOT l_quantity >= 40)")
_row_query("d11_arithmetic", "lineitem", "l_orderkey", "l_extendedprice", "value * (1 - [l_discount]) <= 60000", "l_extendedprice * (1 - l_discount) <= 60000")
_row_query("d13_when", "lineitem", "l_orderkey", "l_tax", "value < 0.06", "l_tax < 0.06", when={"column": "l_returnflag", "check": "value == R"}, when_sql="l_returnflag = 'R'")

RULES = [
    Rule("quantity", "l_quantity", "between:1,45"),
    Rule("discount", "l_discount", "value <= 0.08", severity="warning"),
    Rule("tax", "l_tax", "value < 0.08", severity="warning", when={"column": "l_returnflag", "check": "value == R"}),
    Rule("flag", "l_returnflag", "in [A, N, R]"),
    Rule("status", "l_linestatus", "regex:[FO]"),
    Rule("date", "l_shipdate", "date_after:1992-06-01", severity="info"),
    Rule("weekday", "l_shipdate", "date_weekday:0,1,2,3,4,5", severity="info"),
    Rule("net", "l_extendedprice", "value * (1 - [l_discount]) < 70000"),
    Rule("mean", "l_quantity", "avg(l_quantity) < 20"),
    Rule("supplier", "l_quantity", "sum_by:l_suppkey <= 16000", severity="warning"),
]

_RULES_SQL = """f AS (
  SELECT l_orderkey AS row, 'quantity' AS rule_id, 'error' AS severity FROM lineitem WHERE l_quantity NOT BETWEEN 1 AND 45
  UNION ALL SELECT l_orderkey, 'discount', 'warning' FROM lineitem WHERE l_discount > 0.08
  UNION ALL SELECT l_orderkey, 'tax', 'warning' FROM lineitem WHERE l_returnflag = 'R' AND NOT l_tax < 0.08
  UNION ALL SELECT l_orderkey, 'flag', 'error' FROM lineitem WHERE l_returnflag NOT IN ('A', 'N', 'R')
  UNION ALL SELECT l_orderkey, 'status', 'error' FROM lineitem WHERE NOT regexp_full_match(l_linestatus, '[FO]')
  UNION ALL SELECT l_orderkey, 'date', 'info' FROM lineitem WHERE NOT l_shipdate::DATE > DATE '1992-06-01'
  UNION ALL SELECT l_orderkey, 'weekday', 'info' FROM lineitem WHERE isodow(l_shipdate) > 6
  UNION ALL SELECT l_orderkey, 'net', 'error' FROM lineitem WHERE NOT l_extendedprice * (1 - l_discount) < 70000
  UNION ALL SELECT NULL, 'mean', 'error' FROM lineitem HAVING NOT avg(l_quantity) < 20
  UNION ALL SELECT NULL, 'supplier', 'warning' FROM lineitem GROUP BY l_suppkey HAVING NOT sum(l_quantity) <= 16000
)"""


def lineitem_findings(spark: SparkSession, d: str) -> DataFrame:
    return run_rules(read(spark, d, "lineitem"), RULES, "lineitem", F.col("l_orderkey"))


@query("g06_summarise", f"WITH {_RULES_SQL} SELECT rule_id, severity, count(*) AS n FROM f GROUP BY ALL")
def _(spark: SparkSession, d: str) -> DataFrame:
    return lineitem_findings(spark, d).groupBy("rule_id", "severity").agg(F.count(F.lit(1)).alias("n"))


@query("g06_collapse", f"""WITH {_RULES_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY rule_id ORDER BY row) AS k FROM f)
SELECT rule_id, CAST(count(*) FILTER (k <= 100) AS BIGINT) AS shown, CAST(nullif(count(*) FILTER (k > 100), 0) AS BIGINT) AS collapsed FROM r GROUP BY rule_id""")
def _(spark: SparkSession, d: str) -> DataFrame:
    out = findings.collapse(lineitem_findings(spark, d), 100)
    return out.groupBy("rule_id").agg(F.count_if(F.col("collapsed").isNull()).alias("shown"), F.max("collapsed").alias("collapsed"))


@query("h01_cap")
def _(spark: SparkSession, d: str) -> DataFrame:
    return findings.ordered(findings.cap(lineitem_findings(spark, d), 1000))


@query("h04_counters", f"""WITH {_RULES_SQL} SELECT count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings,
  count(*) FILTER (severity = 'info') AS infos, count(DISTINCT rule_id) AS rules_broken, count(*) FILTER (severity = 'error') = 0 AS ok, CAST(1 AS INT) AS exit_code FROM f""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return findings.summary(lineitem_findings(spark, d))


@query("e01_table_aggregates", """SELECT sum(l_quantity) AS sum, avg(l_quantity) AS avg, min(l_quantity) AS min, max(l_quantity) AS max, median(l_quantity) AS median,
  round(stddev_samp(l_quantity), 6) AS stdev, count(*)::DOUBLE AS count, count(l_quantity)::DOUBLE AS count_nonempty, count(DISTINCT l_quantity)::DOUBLE AS count_distinct,
  0.0::DOUBLE AS count_errors, 0.0::DOUBLE AS skipped FROM lineitem""")
def _(spark: SparkSession, d: str) -> DataFrame:
    from dqspark.plans.rules import aggregate_columns

    df = read(spark, d, "lineitem")
    out = aggregate_columns(df, "l_quantity")
    out.pop("mean")
    out["stdev"] = F.round(out["stdev"], 6)
    return df.agg(*[c.alias(n) for n, c in out.items()])


@query("e08_skipped", "SELECT count(*)::DOUBLE AS skipped, count(DISTINCT c_mktsegment)::DOUBLE AS count_distinct FROM customer")
def _(spark: SparkSession, d: str) -> DataFrame:
    from dqspark.plans.rules import aggregate_columns

    df = read(spark, d, "customer")
    out = aggregate_columns(df, "c_mktsegment")
    return df.agg(out["skipped"].alias("skipped"), out["count_distinct"].alias("count_distinct"))


@query("e10_group_having", """SELECT CAST(l_suppkey AS VARCHAR) AS "group", 'supplier' AS rule_id FROM lineitem GROUP BY l_suppkey HAVING NOT sum(l_quantity) <= 15000
UNION ALL SELECT CAST(l_suppkey AS VARCHAR), 'rows' FROM lineitem GROUP BY l_suppkey HAVING NOT count(*) >= 600""")
def _(spark: SparkSession, d: str) -> DataFrame:
    own = [Rule("supplier", "l_quantity", "sum_by:l_suppkey <= 15000"), Rule("rows", "l_quantity", "count_by:l_suppkey >= 600")]
    return run_rules(read(spark, d, "lineitem"), own, "lineitem").select("group", "rule_id")


@query("k06_remarks", """SELECT o_orderkey, CASE WHEN o_totalprice > 400000 THEN 'o_totalprice fails value <= 400000' END AS remarks FROM orders""")
def _(spark: SparkSession, d: str) -> DataFrame:
    orders = read(spark, d, "orders").select("o_orderkey", "o_totalprice")
    found = run_rules(orders, [Rule("price", "o_totalprice", "value <= 400000")], "orders", F.col("o_orderkey"))
    return findings.remarks(orders, "o_orderkey", found).select("o_orderkey", "remarks")


# --- B, C: islands and inference -------------------------------------------------------------


@query("b02_islands", """WITH d AS (SELECT DISTINCT l_suppkey, (l_shipdate::DATE - DATE '1970-01-01') AS day FROM lineitem),
n AS (SELECT *, CASE WHEN day - lag(day) OVER (PARTITION BY l_suppkey ORDER BY day) > 3 THEN 1 ELSE 0 END AS b FROM d),
i AS (SELECT *, sum(b) OVER (PARTITION BY l_suppkey ORDER BY day) AS island FROM n)
SELECT l_suppkey, CAST(island AS INT) AS island, CAST(min(day) AS INT) AS first_day, CAST(max(day) AS INT) AS last_day, count(*) AS days FROM i GROUP BY l_suppkey, island""")
def _(spark: SparkSession, d: str) -> DataFrame:
    days = read(spark, d, "lineitem").select("l_suppkey", F.unix_date(F.col("l_shipdate").cast("date")).alias("day"))
    runs = tables.islands(days, ["l_suppkey"], "day", 2)
    return runs.groupBy("l_suppkey", "island").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count(F.lit(1)).alias("days"))


@query("c06_infer_cells", r"""SELECT kind, count(*) AS n FROM (
  SELECT CASE WHEN regexp_full_match(v, '[+-]?0[0-9]+') THEN 'text' WHEN regexp_full_match(v, '[+-]?[0-9]+') THEN 'integer'
              WHEN regexp_full_match(v, '[+-]?([0-9]+([.,][0-9]*)?|[.,][0-9]+)([eE][+-]?[0-9]+)?') THEN 'number'
              WHEN regexp_full_match(v, '[0-9]{4}-[0-9]{2}-[0-9]{2}') THEN 'date' ELSE 'text' END AS kind
  FROM (SELECT CAST(o_orderkey AS VARCHAR) AS v FROM orders UNION ALL SELECT o_orderpriority FROM orders UNION ALL SELECT strftime(o_orderdate, '%Y-%m-%d') FROM orders
        UNION ALL SELECT CAST(o_totalprice AS VARCHAR) FROM orders)) GROUP BY kind""")
def _(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders").select(
        F.explode(F.array(F.col("o_orderkey").cast("string"), "o_orderpriority", F.date_format("o_orderdate", "yyyy-MM-dd"), F.col("o_totalprice").cast("string"))).alias("v")
    )
    return o.select(V.cell_kind(F.col("v")).alias("kind")).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("c05_infer", r"""SELECT 'k' AS name, CASE WHEN bool_and(regexp_full_match(v, '[+-]?[0-9]+')) AND NOT regexp_full_match(min(v), '0[0-9]+') THEN 'long' ELSE 'string' END AS kind
FROM (SELECT regexp_extract(props, '"k": ([0-9]+)', 1) AS v FROM events)
UNION ALL SELECT 'event_type', 'string'""")
def _(spark: SparkSession, d: str) -> DataFrame:
    from dqspark.operators.infer import column_kinds

    df = read(spark, d, "events").select(F.get_json_object("props", "$.k").alias("k"), "event_type")
    return column_kinds(df)


# --- streaming's batch forms -----------------------------------------------------------------


@query("s_window_counts", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def _(spark: SparkSession, d: str) -> DataFrame:
    from dqspark.streaming.events import window_counts

    return window_counts(read(spark, d, "events"), "1 hour").select("start", "event_type", "n", F.round("total", 4).alias("total"))


@query("s_session", """WITH o AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 1 DAY THEN 0 ELSE 1 END AS b FROM events),
s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM o)
SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def _(spark: SparkSession, d: str) -> DataFrame:
    from dqspark.streaming.events import sessions

    return sessions(read(spark, d, "events"), "1 day").select("user_id", "start", "n")


@query("h07_distinct_content", "SELECT sha1(text) AS sha1, min(doc_id) AS doc_id FROM documents GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    return merge.distinct_content(read(spark, d, "documents").select("doc_id", "text"), "text", ["doc_id"]).select("sha1", "doc_id")


@query("h08_suffixes", """SELECT c_custkey, CASE WHEN k > 1 THEN c_mktsegment || '__' || k ELSE c_mktsegment END AS name
FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS k FROM customer)""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return merge.suffixed(read(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("name")), "name", ["c_custkey"])


@query("b18_key_order", """SELECT key, CAST(row_number() OVER (ORDER BY f) - 1 AS INT) AS place FROM (
  SELECT event_type AS key, min({'o': event_id, 'p': 0}) AS f FROM events GROUP BY 1)""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return tables.key_order(read(spark, d, "events").select("event_id", F.array("event_type").alias("keys")), "event_id", "keys")


# --- further operators by their ids ----------------------------------------------------------


@query("f12_k07_findings_per_row", """SELECT o_orderkey AS row, count(*) AS n FROM (
  SELECT o_orderkey FROM orders WHERE NOT o_totalprice <= 300000 UNION ALL SELECT o_orderkey FROM orders WHERE NOT o_orderpriority IN ('1-URGENT', '2-HIGH')) GROUP BY 1""")
def _(spark: SparkSession, d: str) -> DataFrame:
    own = [Rule("price", "o_totalprice", "value <= 300000"), Rule("priority", "o_orderpriority", "in ['1-URGENT', '2-HIGH']")]
    return run_rules(read(spark, d, "orders"), own, "orders", F.col("o_orderkey")).groupBy("row").agg(F.count(F.lit(1)).alias("n"))


@query("h09_union_metadata", """SELECT lang, min(day) AS created, arg_max(source, {'n': length(source), 's': source}) AS description FROM (
  SELECT lang, source, DATE '2024-01-01' + CAST(doc_id % 100 AS INT) AS day FROM documents) GROUP BY lang""")
def _(spark: SparkSession, d: str) -> DataFrame:
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 100).cast("int"))
    own = read(spark, d, "documents").select("lang", day.alias("created"), F.col("source").alias("description"), F.array(F.struct(F.col("source").alias("course"), day.alias("date"))).alias("sources"))
    return merge.union_metadata(own, "lang").select("lang", "created", "description")


@query("h11_upsert", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'changed' ELSE p_brand END AS p_brand FROM part")
def _(spark: SparkSession, d: str) -> DataFrame:
    now = read(spark, d, "part").select("p_partkey", "p_brand")
    return merge.upsert(now, now.where("p_partkey % 3 = 0").withColumn("p_brand", F.lit("changed")), ["p_partkey"])


@query("h12_collisions", """SELECT s_suppkey, CASE WHEN k > 1 THEN n || '-' || k ELSE n END AS name FROM (
  SELECT s_suppkey, CAST(s_nationkey AS VARCHAR) AS n, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS k FROM supplier)""")
def _(spark: SparkSession, d: str) -> DataFrame:
    own = read(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").cast("string").alias("name"))
    return merge.resolve_collisions(own, "name", ["s_suppkey"])


@query("i38_case_collisions", """SELECT lower(w) AS folded, array_to_string(list_sort(list(DISTINCT w)), ',') AS spellings FROM (
  SELECT unnest(list_filter(string_split_regex(text, '[^A-Za-z]+'), lambda x: x <> '')) AS w FROM benchmark) GROUP BY 1 HAVING count(DISTINCT w) > 1""")
def _(spark: SparkSession, d: str) -> DataFrame:
    words = read(spark, d, "benchmark").select(F.explode(F.filter(F.split("text", "[^A-Za-z]+"), lambda w: w != "")).alias("w"))
    return merge.case_collisions(words, "w").select("folded", F.array_join("spellings", ",").alias("spellings"))


@query("k15_pending", "SELECT doc_id FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 2 = 0)")
def _(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").select("doc_id", "text")
    manifest = docs.where("doc_id % 2 = 0").select(F.sha2(F.col("text").cast("binary"), 256).alias("sha256"))
    return merge.pending(docs, manifest, "text").select("doc_id")


@query("c09_serial_dates", "SELECT o_orderkey, CAST(o_orderdate::DATE - DATE '1899-12-30' AS DOUBLE) + epoch(o_orderdate - date_trunc('day', o_orderdate)) / 86400 AS serial FROM orders")
def _(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "orders").select("o_orderkey", V.date_serial(F.col("o_orderdate")).alias("serial"))


@query("c11_formula_escape", """SELECT conv_id, turn, CASE WHEN substr(t, 1, 1) IN ('=', '+', '-', '@') THEN chr(39) || t ELSE t END AS cell
FROM (SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN '=' || text ELSE text END AS t FROM conversations)""")
def _(spark: SparkSession, d: str) -> DataFrame:
    t = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("="), F.col("text"))).otherwise(F.col("text"))
    return read(spark, d, "conversations").select("conv_id", "turn", V.escape_formula(t).alias("cell"))


@query("b04_overlaps", """WITH s AS (SELECT p_partkey AS id, p_size AS top, p_size + 3 AS bottom, p_partkey % 40 AS l FROM part)
SELECT a.id AS left_id, b.id AS right_id FROM s a JOIN s b ON a.id < b.id AND a.top <= b.bottom AND b.top <= a.bottom AND a.l <= b.l + 1 AND b.l <= a.l + 1""")
def _(spark: SparkSession, d: str) -> DataFrame:
    s = read(spark, d, "part").select(
        F.lit("s").alias("sheet"), F.col("p_partkey").alias("id"), F.col("p_size").alias("top"), (F.col("p_size") + 3).alias("bottom"), (F.col("p_partkey") % 40).alias("left"), (F.col("p_partkey") % 40 + 1).alias("right")
    )
    return tables.overlapping(s, cell=8).select("left_id", "right_id")


# the other queries register themselves
from dqspark.plans import catalogue_pages, catalogue_tables, catalogue_text, catalogue_values  # noqa: E402, F401
