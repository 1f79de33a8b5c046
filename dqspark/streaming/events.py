"""Event streams: windows, sessions and the budgeted first match; the same plans serve batches (G10, section 7.5)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def timed(events: DataFrame, late: str | None = None) -> DataFrame:
    """ts as a timestamp, which watermarks need; late: how long late events are waited for."""
    out = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return out.withWatermark("ts", late) if late else out


def window_counts(events: DataFrame, size: str, slide: str | None = None) -> DataFrame:
    """start, event_type, n and total for tumbling or sliding windows."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    out = events.groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str) -> DataFrame:
    """user_id, start, end and n of runs of events with less than the gap between them."""
    out = events.groupBy("user_id", F.session_window("ts", gap).alias("s")).agg(F.count(F.lit(1)).alias("n"))
    return out.select("user_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def first_match(events: DataFrame, call: str, match: str, budget: int) -> DataFrame:
    """Streaming form of the budgeted first match: a row for each user whose matching call comes in time.

    The state of a user is the list of distinct calls so far, of at most `budget` entries.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        calls, done = state.get if state.exists else ([], False)
        calls, out = list(calls), []
        for batch in batches:
            for name in batch.sort_values("ts")[call]:
                if done:
                    break
                if name not in calls:
                    calls.append(name)
                if name == match and calls.index(name) < budget:
                    out.append((key[0], calls.index(name) + 1))
                    done = True
                elif len(calls) >= budget:
                    done = True
        state.update((calls[:budget], done))
        yield pd.DataFrame(out, columns=["user_id", "first_match"])

    return events.groupBy("user_id").applyInPandasWithState(step, "user_id long, first_match int", "calls array<string>, done boolean", "append", GroupStateTimeout.NoTimeout)
