"""Contiguous shards of equal bytes from global prefix sums.

Rows are ranged by doc_id; each range sums its sizes, the few totals are added up to give
every range its base, and the running sum inside a range then is the global one. The cuts
lie at equal targets of the total, so shards are contiguous in doc_id and differ by less
than one row's size from the target.

A null text has no bytes; a row weighs its UTF-8 bytes plus 1. Equal ids lie side by side
in the order of their texts' checksums, a null doc_id comes first. Further columns are
left out; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dqspark.llm.common import cut, small_batches

#: Rows of a range, about, beyond which there are more ranges than shuffle partitions.
RANGE_ROWS = 4_000_000


def shard_by_bytes(documents: DataFrame, shards: int, text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard (0 to shards - 1), slot (place in its shard, from 0)."""
    spark = documents.sparkSession
    raw = F.coalesce(F.col(text), F.lit(""))
    sized = documents.select(
        "doc_id",
        (F.octet_length(raw) + 1).cast("long").alias("size"),
        F.crc32(raw.cast("binary")).alias("text_crc32"),
        F.monotonically_increasing_id().alias("_row"),
    )
    total = sized.count()
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // RANGE_ROWS))
    order = ["doc_id", "text_crc32", "_row"]
    # the ranges are kept, in order, so that totals and rows speak of the same ones
    ranged = cut(sized.repartitionByRange(n, *order).sortWithinPartitions(*order).select("doc_id", "size", "text_crc32", F.spark_partition_id().alias("_range")))
    totals = ranged.groupBy("_range").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(  # a row for each range
        "_range",
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("_bytes"),
        F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("_rows"),
        F.sum("bytes").over(Window.partitionBy(F.lit(0))).alias("_total"),
    )
    small_batches(spark)
    kind = documents.schema["doc_id"].dataType.simpleString()
    placed = ranged.mapInArrow(_running, f"doc_id {kind}, size long, text_crc32 long, _range int, _before long, _place long").join(F.broadcast(bases), "_range").select(
        "doc_id", "size", "text_crc32", (F.col("_bytes") + F.col("_before")).alias("_start"), (F.col("_rows") + F.col("_place")).alias("_index"), "_total",
    )
    # by the middle of a row: no shard is off its target by more than half a row at either end
    cutted = cut(placed.withColumn("shard", F.expr("cast(least((_start * 2 + size) * cast(%d as decimal(20,0)) div (2 * _total), %d) as int)" % (shards, shards - 1))))
    firsts = cutted.groupBy("shard").agg(F.min("_index").alias("_first"))
    return cutted.join(F.broadcast(firsts), "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("_index") - F.col("_first")).alias("slot"))


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds to the rows of one range, in their order, the bytes and the rows before each."""
    size = rows = 0
    for batch in batches:
        own = np.asarray(batch.column(1))
        upto = size + np.cumsum(own)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(upto - own), pa.array(rows + np.arange(len(own)))], [*batch.schema.names, "_before", "_place"])
        size, rows = int(upto[-1]) if len(own) else size, rows + len(own)
