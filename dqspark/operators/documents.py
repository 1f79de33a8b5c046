"""Page records and edited documents."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def scanned_documents(pages: DataFrame, key: str, most: int = 50) -> DataFrame:
    """Documents with a scanned page and no page of more than so many characters. pages: key, scanned, char_count."""
    return pages.groupBy(key).agg(
        (F.coalesce(F.bool_or("scanned"), F.lit(False)) & F.coalesce(F.bool_and(F.col("char_count") <= most), F.lit(False))).alias("scanned")
    )


def paragraph_diff(original: DataFrame, edited: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """(key, pos, op, before, after): a document's paragraphs aligned in sequence; op is equal, replace, delete or insert.

    One document is aligned at a time, by one task.
    """

    def align(group: pd.DataFrame) -> pd.DataFrame:
        from difflib import SequenceMatcher

        a, b = (group[group["side"] == s].sort_values("place")["t"].tolist() for s in ("a", "b"))
        rows = []
        for op, i, j, k, m in SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
            for n in range(max(j - i, m - k)):
                rows.append((group[key].iloc[0], len(rows), op, a[i + n] if i + n < j else None, b[k + n] if k + n < m else None))
        return pd.DataFrame(rows, columns=[key, "pos", "op", "before", "after"])

    side = lambda df, s: df.select(key, F.lit(s).alias("side"), F.col(order).cast("long").alias("place"), F.coalesce(text, F.lit("")).alias("t"))
    kind = original.schema[key].dataType.simpleString()
    return side(original, "a").unionByName(side(edited, "b")).groupBy(key).applyInPandas(align, f"`{key}` {kind}, pos long, op string, before string, after string")
