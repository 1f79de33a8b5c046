"""Column types from text: all-or-nothing for CSV, value by value for Markdown, tolerant for JSON."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dqspark.functions import values as V


def _facts(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row with what decides about every column, from a single aggregation."""
    out = []
    for c in columns:
        text = V.strip(F.col(f"`{c}`").cast("string"))
        filled = F.when(text != "", text)
        out += [
            F.count(filled).alias(f"{c}|n"),
            F.bool_and(filled.rlike(V.NUMBER_PATTERN)).alias(f"{c}|number"),
            F.bool_and(filled.rlike(V.INTEGER_PATTERN)).alias(f"{c}|integer"),
            F.bool_or(filled.rlike(V.LEADING_ZERO_PATTERN)).alias(f"{c}|zero"),
        ]
    return df.agg(*out)


def column_kinds(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(name, kind): long or double if every filled value is a number and none has a leading zero, else string."""
    columns = columns or df.columns
    facts = _facts(df, columns)
    kind = lambda c: F.when((F.col(f"`{c}|n`") == 0) | F.col(f"`{c}|zero`"), "string").when(F.col(f"`{c}|integer`"), "long").when(F.col(f"`{c}|number`"), "double").otherwise("string")
    return facts.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), kind(c).alias("kind")) for c in columns])).alias("k")).select("k.*")


def typed(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """The columns cast to their kinds; blanks become null, decimal commas are understood."""
    columns = columns or df.columns
    kinds = {r["name"]: r["kind"] for r in column_kinds(df, columns).collect()}
    blank = lambda c: F.nullif(V.strip(F.col(f"`{c}`").cast("string")), F.lit(""))
    cast = {"long": lambda c: blank(c).try_cast("long"), "double": lambda c: V.parsed_number(blank(c)), "string": blank}
    return df.select(*[cast[kinds[c]](c).alias(c) if c in kinds else F.col(f"`{c}`") for c in df.columns])


def typed_cells(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Each value as a variant of its own kind; a column with a leading zero anywhere stays text."""
    columns = columns or df.columns
    facts = _facts(df, columns)
    joined = df.join(F.broadcast(facts))

    def cell(c: str):
        v, kind = F.col(f"`{c}`"), V.cell_kind(F.col(f"`{c}`"))
        own = F.struct(
            F.when(F.coalesce(F.col(f"`{c}|zero`"), F.lit(False)), F.lit("text")).otherwise(kind).alias("kind"),
            V.parsed_number(v).alias("number"),
            V.text_date(V.strip(v), ("yyyy-MM-dd",)).alias("date"),
            v.alias("text"),
        )
        return own.alias(c)

    return joined.select(*[cell(c) if c in columns else F.col(f"`{c}`") for c in df.columns])


def union_by_name(frames: list[DataFrame]) -> DataFrame:
    """Rows of several tables under all their columns, in first-seen order."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
