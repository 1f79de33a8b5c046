"""Order, collapse, cap and summary of findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dqspark.session import shared_dir

LAST_ROW = 9223372036854775807


def order() -> list[Column]:
    """Table, row, column, rule, group; findings about groups or tables come after those about rows."""
    return [
        F.col("table"), F.coalesce("row", F.lit(LAST_ROW)), F.coalesce("column", F.lit("")), F.col("rule_id"), F.coalesce("group", F.lit("")), F.coalesce("value", F.lit("")),
    ]


def ordered(findings: DataFrame) -> DataFrame:
    return findings.orderBy(*order())


def collapse(findings: DataFrame, n: int, samples: int = 10) -> DataFrame:
    """The first n findings of each rule; the rest of a rule as one row with their number and some rows.

    Ranks are asked for up to n + samples only, which each task cuts off before the shuffle,
    and what is left of that is kept; the numbers come from a combinable count. So the rules
    run twice, once without their messages.
    """
    shared_dir(findings.sparkSession)
    key = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order())])
    ranked = findings.withColumn("_key", key).withColumn("_rank", F.row_number().over(Window.partitionBy("rule_id").orderBy("_key")))
    top = ranked.where(F.col("_rank") <= n + samples).drop("_key").checkpoint()
    first = top.where(F.col("_rank") <= n).drop("_rank").withColumn("collapsed", F.lit(None).cast("long"))
    totals = findings.groupBy("rule_id").agg(
        F.min("table").alias("table"), F.min("column").alias("column"), F.min("severity").alias("severity"), (F.count(F.lit(1)) - n).alias("collapsed")
    ).where("collapsed > 0")
    some = top.where(F.col("_rank") > n).groupBy("rule_id").agg(F.array_sort(F.collect_list("row")).alias("rows"))
    text = F.concat(F.col("collapsed").cast("string"), F.lit(" more, such as rows "), F.array_join(F.col("rows").cast("array<string>"), ", "))
    closing = totals.join(some, "rule_id").select(
        "table", F.lit(None).cast("long").alias("row"), "column", "rule_id", "severity", F.lit(None).cast("string").alias("value"),
        text.alias("message"), F.lit(None).cast("string").alias("group"), "collapsed",
    )
    return first.unionByName(closing)


def cap(findings: DataFrame, n: int) -> DataFrame:
    """The first n - 1 findings and a closing one that says how many were left out; 0 caps nothing."""
    if n == 0:
        return findings
    columns = findings.columns
    first = findings.orderBy(*order()).limit(n)
    total = findings.agg(F.count(F.lit(1)).alias("_total"))
    both = first.withColumn("_rank", F.row_number().over(Window.orderBy(*order()))).join(F.broadcast(total))
    closing = {
        "rule_id": F.lit("truncated"), "severity": F.lit("info"),
        "message": F.concat((F.col("_total") - n + 1).cast("string"), F.lit(" findings left out")),
    }
    last = (F.col("_rank") == n) & (F.col("_total") > n)
    kinds = {f.name: f.dataType for f in findings.schema}
    return both.select(*[F.when(last, closing.get(c, F.lit(None))).otherwise(F.col(c)).cast(kinds[c]).alias(c) for c in columns])


def summary(findings: DataFrame, rows_checked: int | None = None) -> DataFrame:
    """One row of counters over all findings, whatever the output shows."""
    count = lambda s: F.count_if(F.col("severity") == s)
    out = findings.agg(
        count("error").alias("errors"), count("warning").alias("warnings"), count("info").alias("infos"),
        F.count_distinct("rule_id").alias("rules_broken"),
    )
    out = out.withColumn("ok", F.col("errors") == 0).withColumn("exit_code", exit_code(F.col("errors"), F.col("warnings")))
    return out if rows_checked is None else out.withColumn("rows_checked", F.lit(rows_checked))


def exit_code(errors: Column, warnings: Column, strict: bool = False) -> Column:
    """0 if all is well, 1 with errors, 2 with warnings alone (1 if strict)."""
    return F.when(errors > 0, 1).when(warnings > 0, 1 if strict else 2).otherwise(0)


def comments(findings: DataFrame) -> DataFrame:
    """(table, row, column, text): the findings about rows as comments, those of one cell joined; others have no cell to stand at."""
    text = F.concat(F.lit("["), F.col("severity"), F.lit("] "), F.col("rule_id"), F.lit(": "), F.col("message"))
    return findings.where("row is not null").groupBy("table", "row", "column").agg(F.array_join(F.array_sort(F.collect_list(text)), "\n").alias("text"))


def without_cell(findings: DataFrame) -> DataFrame:
    """(dropped): the number of findings that comments() leaves out."""
    return findings.agg(F.count_if(F.col("row").isNull()).alias("dropped"))


def with_severity(findings: DataFrame, *severities: str) -> DataFrame:
    """What the output shows; counters are made before."""
    return findings.where(F.col("severity").isin(*severities))


def remarks(df: DataFrame, key: str, findings: DataFrame, mode: str = "new", column: str = "remarks") -> DataFrame:
    """Adds each row's messages as a column: new (beside an existing one), replace or append."""
    texts = findings.where("row is not null").groupBy("row").agg(F.array_join(F.array_sort(F.collect_list("message")), "; ").alias("_remark"))
    out = df.join(texts, df[key] == texts["row"], "left").drop("row")
    name = column
    if mode == "new":
        k = 2
        while name in df.columns:
            name, k = f"{column}_{k}", k + 1
        return out.withColumnRenamed("_remark", name)
    old = F.col(column) if column in df.columns else F.lit(None).cast("string")
    value = F.coalesce("_remark", old) if mode == "replace" else F.when(F.col("_remark").isNull(), old).otherwise(F.concat_ws("; ", old, "_remark"))
    return out.withColumn(column, value).drop("_remark")
