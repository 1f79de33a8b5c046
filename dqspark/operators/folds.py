"""Ordered and stateful operators: ladders, improvement loop, budgets, fences."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def ladder(df: DataFrame, by: list[str], rank: Column, columns: list[str]) -> DataFrame:
    """Of each group the row of least rank, ties by the columns; a combinable aggregate, not a sort."""
    best = F.min(F.struct(rank.alias("_rank"), *columns)).alias("_best")
    return df.where(rank.isNotNull()).groupBy(*by).agg(best).select(*by, *[F.col(f"_best.{c}").alias(c) for c in columns if c not in by])


def preference(kind: Column, language: Column, kinds: tuple[str, ...], languages: tuple[str, ...]) -> Column:
    """Rank of a track: kinds first, then languages in their order; null for what is not wanted."""
    rank = F.lit(None).cast("int")
    ladder_ = [(k, lang) for k in kinds for lang in languages]
    for place, (k, lang) in reversed(list(enumerate(ladder_))):
        rank = F.when((kind == k) & (language == lang), place).otherwise(rank)
    return rank


def improvement_loop(scores: Column, baseline: Column, noise: float, window: int, threshold: float) -> Column:
    """Fold of candidate scores in order: (best, kept, reverted, streak, iterations, exit_reason).

    A candidate is kept if it beats the best by more than the noise band; inside the band it
    is no signal and, like a worse one, reverted. The loop ends at the threshold, or after
    so many candidates in a row that were not kept.
    """
    state = lambda best, kept, reverted, streak, n, reason: F.struct(
        best.alias("best"), kept.alias("kept"), reverted.alias("reverted"), streak.alias("streak"), n.alias("iterations"), reason.alias("exit_reason")
    )
    zero = F.lit(0)
    none = F.lit(None).cast("string")
    begin = state(baseline.cast("double"), zero, zero, zero, zero, F.when(baseline >= threshold, "already_optimal").otherwise(none))

    def step(s: Column, x: Column) -> Column:
        keep = x > s["best"] + noise
        streak = F.when(keep, 0).otherwise(s["streak"] + 1)
        best = F.when(keep, x).otherwise(s["best"])
        reason = F.when(keep & (x >= threshold), "threshold").when(streak >= window, "stagnation").otherwise(none)
        moved = state(best, s["kept"] + keep.cast("int"), s["reverted"] + (~keep).cast("int"), streak, s["iterations"] + 1, reason)
        return F.when(s["exit_reason"].isNotNull(), s).otherwise(moved)

    return F.aggregate(scores, begin, step, lambda s: state(s["best"], s["kept"], s["reverted"], s["streak"], s["iterations"], F.coalesce(s["exit_reason"], F.lit("max_iterations"))))


def first_match_in_budget(events: DataFrame, by: str, order: list[str], call: Column, matches: Column, budget: int) -> DataFrame:
    """Per group: whether a matching call comes within the first `budget` distinct calls.

    Distinct calls are ranked by their first place; groups stay spread, as only the first
    place of each call and of each matching call is gathered.
    """
    place = F.struct(*order)
    calls = events.where(call.isNotNull()).groupBy(F.col(by), call.alias("_call")).agg(F.min(place).alias("_first"), F.min(F.when(matches, place)).alias("_hit"))
    ranked = calls.withColumn("_rank", F.row_number().over(Window.partitionBy(by).orderBy("_first")))
    return ranked.groupBy(by).agg(
        F.count(F.lit(1)).alias("distinct_calls"),
        F.min(F.when(F.col("_hit").isNotNull(), F.col("_rank"))).alias("first_match"),
    ).withColumn("triggered", F.coalesce(F.col("first_match") <= budget, F.lit(False)))


FENCE = r"^\s{0,3}(```|~~~)"


def outside_fences(lines: Column) -> Column:
    """Lines of a text as (line, code): code is true inside fences and on the fence lines."""
    step = lambda acc, line: F.struct(
        F.concat(acc["out"], F.array(F.struct(line.alias("line"), (acc["open"] | line.rlike(FENCE)).alias("code")))).alias("out"),
        (acc["open"] != line.rlike(FENCE)).alias("open"),
    )
    begin = F.struct(F.array().cast("array<struct<line:string,code:boolean>>").alias("out"), F.lit(False).alias("open"))
    return F.aggregate(lines, begin, step, lambda acc: acc["out"])


def mask_fences(text: Column) -> Column:
    """Fenced code, inline code and comments as blanks of equal length, line breaks kept."""
    out = text
    for pattern in (r"(?ms)^\s{0,3}```.*?^\s{0,3}```[ \t]*$", r"(?s)<!--.*?-->", r"`[^`\n]+`"):
        parts = F.regexp_extract_all(out, F.lit(f"({pattern})"), F.lit(1))
        out = F.aggregate(F.array_distinct(parts), out, lambda acc, p: F.replace(acc, p, F.regexp_replace(p, r"[^\n]", " ")))
    return out


def longest_fence(text: Column) -> Column:
    """Lines of the longest fenced block."""
    blocks = F.regexp_extract_all(text, F.lit(r"(?ms)^\s{0,3}```[^\n]*\n(.*?)^\s{0,3}```[ \t]*$"), F.lit(1))
    return F.coalesce(F.array_max(F.transform(blocks, lambda b: F.length(b) - F.length(F.replace(b, F.lit("\n"), F.lit(""))))), F.lit(0))


#: Our names for the blocks of a Markdown text.
BLOCKS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("line", T.IntegerType()), T.StructField("text", T.StringType())]))


@F.pandas_udf(BLOCKS)
def markdown_blocks(text: pd.Series) -> pd.Series:
    """Headings, pipe tables and HTML tables in their order, with the line where each begins; not those in fenced code, comments, styles or scripts."""
    hidden = re.compile(r"(?ms)^\s{0,3}(```|~~~).*?^\s{0,3}\1[ \t]*$|<!--.*?-->|<(style|script)\b.*?</\2\s*>", re.I)
    blank = lambda m: re.sub(r"[^\n]", " ", m[0])
    mark = re.compile(r"^\s*\|?\s*:?-+:?\s*(?:\|\s*:?-+:?\s*)*\|?\s*$")

    def scan(raw: str | None) -> list[dict]:
        if raw is None:
            return []
        raw = raw.replace("\r\n", "\n")
        lines, masked, out, k = raw.split("\n"), hidden.sub(blank, raw).split("\n"), [], 0
        while k < len(lines):
            line = masked[k]
            if re.match(r"^#{1,6}[ \t]+\S", line):
                out.append({"kind": "heading", "line": k + 1, "text": re.sub(r"[ \t]+#*[ \t]*$", "", line.lstrip("#")).strip()})
                k += 1
            elif "|" in line and k + 1 < len(lines) and "-" in masked[k + 1] and mark.match(masked[k + 1]):
                end = k + 2
                while end < len(lines) and "|" in masked[end]:
                    end += 1
                out.append({"kind": "pipe", "line": k + 1, "text": "\n".join(lines[k:end])})
                k = end
            elif re.search(r"(?i)<table\b", line):
                end = k
                while end + 1 < len(lines) and not re.search(r"(?i)</table\s*>", masked[end]):
                    end += 1
                out.append({"kind": "html", "line": k + 1, "text": "\n".join(lines[k : end + 1]).strip()})
                k = end + 1
            else:
                k += 1
        return out

    return text.map(scan)
