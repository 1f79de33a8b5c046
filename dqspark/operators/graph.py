"""Link-graph analytics: dangling, orphaned, missing, duplicated and unreachable pages, ranked search."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dqspark.functions.binding import let


def html_links(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, target, anchor) of the href attributes; the target is the last path segment."""
    href = F.explode(F.regexp_extract_all(F.col(html), F.lit(r'<a\s[^>]*href="([^"]*)"'), F.lit(1)))
    link = pages.select(key, href.alias("href"))
    path = F.regexp_extract("href", r"^([^?#]*)", 1)
    return link.select(
        key,
        F.regexp_extract(F.regexp_replace(path, r"/+$", ""), r"([^/]*)$", 1).alias("target"),
        F.nullif(F.regexp_extract("href", r"#(.*)$", 1), F.lit("")).alias("anchor"),
    ).where("target != ''")


def dangling(edges: DataFrame, pages: DataFrame) -> DataFrame:
    """Targets that are no page: target, referrers (sorted), anchors (sorted). edges: src, target, anchor; pages: name."""
    lost = edges.join(pages.select(F.col("name").alias("target")).distinct(), "target", "left_anti")
    return lost.groupBy("target").agg(
        F.count_distinct("src").alias("n_referrers"), F.array_sort(F.collect_set("src")).alias("referrers"), F.array_sort(F.collect_set("anchor")).alias("anchors")
    )


def layer_dangling(edges: DataFrame, pages: DataFrame) -> DataFrame:
    """(layer, target, n_referrers): targets that no layer has as a page, for each layer that links to them. edges: layer, src, target; pages: name."""
    lost = edges.join(pages.select(F.col("name").alias("target")).distinct(), "target", "left_anti")
    return lost.groupBy("layer", "target").agg(F.count_distinct("src").alias("n_referrers"))


def orphans(edges: DataFrame, pages: DataFrame) -> DataFrame:
    """Pages other than sources that no other page links to. pages: name, kind."""
    inbound = edges.where("src != target").select(F.col("target").alias("name")).distinct()
    return pages.where("kind != 'source'").join(inbound, "name", "left_anti").select("name")


def missing(mentions: DataFrame, pages: DataFrame, least: int = 2) -> DataFrame:
    """Concepts named by at least so many sources without a page; case does not matter, the first spelling is shown.

    mentions: src, concept, pos (an order for "first").
    """
    named = mentions.groupBy(F.lower("concept").alias("key")).agg(F.count_distinct("src").alias("n_sources"), F.min_by("concept", F.struct("pos", "concept")).alias("concept"))
    return named.where(F.col("n_sources") >= least).join(pages.select(F.lower("name").alias("key")).distinct(), "key", "left_anti").select("concept", "n_sources")


def duplicates(pages: DataFrame, least: int = 2) -> DataFrame:
    """Names in several layers: name, layers (sorted). pages: layer, name."""
    return pages.groupBy("name").agg(F.array_sort(F.collect_set("layer")).alias("layers")).where(F.size("layers") >= least)


def shared(pages: DataFrame, root: str) -> DataFrame:
    """Pages of the root layer that another layer has too (which none should)."""
    other = pages.where(F.col("layer") != root).select("name").distinct()
    return pages.where(F.col("layer") == root).join(other, "name", "left_semi").select("name")


def bad_prefixes(footnotes: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Footnotes (name, target) whose target does not start with a known prefix and a slash. prefixes: prefix."""
    # the prefix is looked up by equality among the target's own leading paths
    parts = F.split("target", "/")
    leads = F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/")))
    good = footnotes.where(F.size(parts) > 1).withColumn("prefix", leads).join(prefixes.select("prefix").distinct(), "prefix", "left_semi").select("name", "target").distinct()
    return footnotes.join(good, ["name", "target"], "left_anti")


def reachable(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Names reachable from the roots: a frontier joined with the edges until it is empty."""
    seen = roots.select("name").distinct().checkpoint()
    frontier = seen
    while True:  # ends, as each round but the last adds a name
        step = edges.join(frontier, edges["src"] == frontier["name"]).select(F.col("target").alias("name")).distinct()
        frontier = step.join(seen, "name", "left_anti").checkpoint()
        if frontier.isEmpty():
            return seen
        seen = seen.unionAll(frontier).checkpoint()


def alternation(terms: list[str]) -> str:
    """A pattern of literal terms; the regex engine takes the leftmost, then the first listed."""
    return "|".join(reduce(lambda s, c: s.replace(c, "\\" + c), "\\.^$*+?{}[]()|", t.lower()) for t in terms)


def term_counts(text: Column, terms: list[str]) -> Column:
    """How often each term is the one matched by the leftmost alternation, without overlaps."""
    found = F.regexp_extract_all(F.lower(text), F.lit(f"({alternation(terms)})"), F.lit(1))
    count = lambda fs, term: F.size(F.filter(fs, lambda f: f == term))
    return let(found, lambda fs: F.array(*[count(fs, t.lower()) for t in terms]))


def search(pages: DataFrame, key: str, text: str, terms: list[str], limit: int | None = 20) -> DataFrame:
    """Pages that hold a term: key and score (matches), best first, ties by key."""
    score = F.regexp_count(F.lower(text), F.lit(alternation(terms))).cast("long")
    out = pages.select(key, score.alias("score")).where("score > 0").orderBy(F.desc("score"), key)
    return out if limit is None else out.limit(limit)


def limited(df: DataFrame, order: list[str | Column], n: int) -> DataFrame:
    """The first n rows of a report and, beside each, whether there are more: truncated."""
    first = df.orderBy(*order).limit(n + 1)
    rank = F.row_number().over(Window.orderBy(*order))  # of n + 1 rows
    marked = first.withColumn("_rank", rank).withColumn("truncated", F.max("_rank").over(Window.partitionBy(F.lit(0))) > n)
    return marked.where(F.col("_rank") <= n).drop("_rank")
