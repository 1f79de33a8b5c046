"""URL filters by Bloom filter cascades.

A rule names a host and a path prefix and fits that host, its subdomains and every path
that starts so. A url stands for a few candidate keys (each suffix of its host that has as
many labels as some rule's host, with each prefix of its path that has the length of some
rule's path), and the url's rule is its longest listed candidate. Which candidates are
listed is told by a cascade: level 0 is a Bloom filter of the listed keys, level 1 one of
the keys of the corpus that level 0 takes for listed though they are not, level 2 one of the
listed keys that level 1 holds by mistake, and so on until nothing is mistaken. Over the
corpus's complete key universe the answer is exact, and asking it needs no join.

Level 0 is made so sparse that about as many keys of the universe are mistaken as are
listed; each later level leaves about a quarter. Every filter has the bits that its rate
takes. A list too long for filters of LITERAL_BITS is dealt into parts by hash; each part is
a pass over the stored urls with its own cascades, and the longest match of all passes wins.

Nulls: a null url, or one without "://", has an empty host and path and fits no rule; null
rules and verdicts list nothing. Repeated urls are judged alike; an empty table gives an
empty result; further columns of the input pass through unless they have a result's name,
which is then replaced. A host of very many labels gives as many keys as any other.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dqspark.llm.bloom import Bloom, build
from dqspark.llm.common import ascii_lower, cut, literal_rows, stored

#: False positive rates of the first level at most, and of the others.
FIRST_RATE, NEXT_RATE = 0.01, 0.25
#: Bits of one filter.
LITERAL_BITS = 1 << 26
#: So few keys that are left over after a level are kept as they are.
MAX_LEFT_OVER = 16


@dataclass(frozen=True)
class Cascade:
    levels: tuple[Bloom, ...]
    #: Keys that the last level still takes wrongly, and whether they are listed.
    rest: tuple[str, ...]
    rest_listed: bool

    def contains(self, key: Column) -> Column:
        """Whether a key of the universe is listed."""
        answer = F.lit(len(self.levels) % 2 == 1)
        if self.rest:
            last = key.isin(*self.rest)
            answer = last if self.rest_listed else ~last
        for depth in range(len(self.levels) - 1, -1, -1):
            # outside level d, a key is what the levels above d make of it: not listed at even depth
            answer = F.when(self.levels[depth].contains(key), answer).otherwise(F.lit(depth % 2 == 1))
        return answer


def parts(url: Column) -> tuple[Column, Column]:
    """Host with A-Z lower-cased, and path; both empty for a null url or one without "://"."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)([^?#]*)", 1)
    path = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)([^?#]*)", 2)
    return ascii_lower(found), path


def candidates(host: Column, path: Column, label_counts: list[int], path_lengths: list[int]) -> Column:
    """All keys by which a rule could fit, the longest first. Rules have hosts of so many labels and paths of such lengths."""
    labels = F.split(host, r"\.")
    last = lambda n: F.array_join(F.slice(labels, F.size(labels) - n + 1, F.lit(n)), ".")
    suffixes = F.array_compact(F.array(*[F.when(F.size(labels) >= n, last(n)) for n in sorted(label_counts, reverse=True)]))
    prefixes = [F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in sorted(path_lengths, reverse=True)]
    keys = F.flatten(F.transform(suffixes, lambda s: F.transform(F.array_compact(F.array(*prefixes)), lambda p: F.concat(s, p))))
    keys = F.array_sort(keys, lambda a, b: F.length(b) - F.length(a))
    return F.when(host != "", keys).otherwise(F.array().cast("array<string>"))


def first_rate(listed: int, universe: int) -> float:
    """The rate at which level 0 mistakes about as many of the universe's keys as are listed."""
    return min(FIRST_RATE, max(listed, 1) / max(universe, 1))


def cascade(listed: DataFrame, universe: DataFrame, size: int | None = None) -> Cascade:
    """Of the keys (column key) of listed, exact over those of universe (of so many rows); listed keys outside it are exact too."""
    listed = cut(listed.select("key").where("key is not null").distinct())
    n = listed.count()
    if not n:
        return Cascade((), (), True)
    size = universe.count() if size is None else size
    levels = [build(listed, n, first_rate(n, size), most=LITERAL_BITS)]
    # of the universe only what level 0 lets through is ever looked at again
    passed = universe.select("key").where(levels[0].contains(F.col("key"))).distinct()
    mistaken, others = cut(passed.join(listed, "key", "left_anti")), listed
    n_others = n
    while left := mistaken.count():
        if left <= MAX_LEFT_OVER:
            return Cascade(tuple(levels), tuple(sorted(r["key"] for r in mistaken.collect())), len(levels) % 2 == 0)
        levels.append(build(mistaken, left, NEXT_RATE, seed=len(levels), most=LITERAL_BITS))
        mistaken, others = cut(others.where(levels[-1].contains(F.col("key")))), mistaken
        n_others, before = left, n_others
        if len(levels) > 2 and mistaken.count() >= before > MAX_LEFT_OVER:
            raise ValueError(f"a Bloom filter of {LITERAL_BITS} bits no longer tells {left} keys apart")
    return Cascade(tuple(levels), (), True)


def rule_rows(spark: SparkSession, rules: list[tuple[str, str]] | DataFrame) -> DataFrame:
    """(verdict, key): host in lower case, path from the first slash; rules as pairs or as a table (verdict, rule)."""
    rows = literal_rows(spark, rules, ["verdict", "rule"], ["string", "string"]) if isinstance(rules, list) else rules
    host, path = F.substring_index("rule", "/", 1), F.regexp_extract("rule", r"(?s)^[^/]*(/.*)?$", 1)
    return rows.where("verdict is not null and rule is not null").select(
        "verdict", F.concat(ascii_lower(host), path).alias("key"), (F.size(F.split(host, r"\.")).alias("labels")), F.length(path).alias("chars")
    )


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]] | DataFrame, url: str = "url") -> DataFrame:
    """Adds host, path, rule and verdict. rules: (verdict, rule) with rule like "example.net/en/".

    The longest fitting rule wins, at equal length the one with the longer host, and of a rule
    listed under two verdicts the verdict last in the alphabet; urls that fit none are allowed.
    """
    listed = cut(rule_rows(pages.sparkSession, rules))
    sizes = {r["verdict"]: r["n"] for r in listed.groupBy("verdict").agg(F.count_distinct("key").alias("n")).collect()}
    # of either as many as rules differ in, which hosts and paths of lists bound at some dozens
    shapes = listed.agg(F.sort_array(F.collect_set("labels")).alias("labels"), F.sort_array(F.collect_set("chars")).alias("chars")).first()
    host, path = parts(F.col(url))
    kept = [c for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    framed = pages.select(*[F.col(f"`{c}`") for c in kept], host.alias("host"), path.alias("path"))
    keys = candidates(F.col("host"), F.col("path"), shapes["labels"], shapes["chars"])
    universe = framed.select(F.explode(keys).alias("key"))
    total = universe.count() if sizes else 0
    part_of = lambda key: F.pmod(F.xxhash64(F.lit("part"), key), F.lit(n_parts))
    bits = lambda n: n * -math.log(first_rate(n, total)) / math.log(2) ** 2
    n_parts = max([1, *(math.ceil(bits(n) / LITERAL_BITS * 1.1) for n in sizes.values())])
    now = framed.withColumn("_fit", F.lit(None).cast("struct<rule:string,verdict:string>"))
    for part in range(n_parts):
        cascades = {
            verdict: cascade(listed.where((F.col("verdict") == verdict) & (part_of(F.col("key")) == part)), universe.where(part_of(F.col("key")) == part) if n_parts > 1 else universe, total // n_parts)
            for verdict in sorted(sizes)
        }
        now = now.withColumn("_fit", _longer(F.col("_fit"), _fit(keys, cascades, part_of, part if n_parts > 1 else None)))
        now = stored(now) if part + 1 < n_parts else now  # so that no plan holds the filters of two parts
    return now.select(*[F.col(f"`{c}`") for c in kept], "host", "path", F.col("_fit.rule").alias("rule"), F.coalesce("_fit.verdict", F.lit("allow")).alias("verdict"))


def _fit(keys: Column, cascades: dict[str, Cascade], part_of, part: int | None) -> Column:
    """(rule, verdict) of the first key that a cascade lists; part: only keys of that part are asked for."""

    def named(key: Column) -> Column:
        verdict = F.lit(None).cast("string")
        for name, one in cascades.items():
            verdict = F.when(one.contains(key), F.lit(name)).otherwise(verdict)
        own = verdict if part is None else F.when(part_of(key) == part, verdict)
        return F.struct(key.alias("rule"), own.alias("verdict"))

    return F.get(F.filter(F.transform(keys, named), lambda k: k["verdict"].isNotNull()), F.lit(0))


def _longer(a: Column, b: Column) -> Column:
    """Of two fits the one of the longer rule, at equal length of the longer host."""
    host = lambda x: F.length(F.substring_index(x["rule"], "/", 1))
    size = lambda x: F.length(x["rule"])
    return F.when(a["rule"].isNull() | (size(b) > size(a)) | ((size(b) == size(a)) & (host(b) > host(a))), F.coalesce(b, a)).otherwise(a)
