"""Token ids in ORC files: run-length encoded stripes, row indexes and Bloom filters on doc_id.

A file set holds ids/ (a range of doc_ids in each file, rows in ascending order, with the
place of a document's ids in its range) and ranges/ (the number of ids before each range).
Readers take stripes in parallel, and a search for doc_ids reads only the stripes and row
groups whose statistics and Bloom filters admit them.

Texts are encoded as the tokenizers library does without add_special_tokens: nothing is
added, but a special token that stands in a text gets its own id.

A null text has only the end id; equal doc_ids stand side by side; a null doc_id comes
first. Further columns are left out; an empty table gives empty files.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dqspark.llm import bpe
from dqspark.llm.common import give_back, small_batches

#: Bytes of text of a range, which is a file, about.
RANGE_BYTES = 256 << 20

ORC_OPTIONS = {
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
    "orc.create.index": "true",
    "orc.row.index.stride": "2000",
    "orc.stripe.size": str(32 << 20),
    "orc.encoding.strategy": "COMPRESSION",
    "compression": "zstd",
}


def write_tokens(documents: DataFrame, path: str, tokenizer: str, end_id: int = 0, text: str = "text") -> None:
    """Encodes every text, with end_id after it, and writes the file set at path in ascending doc_id order."""
    spark = documents.sparkSession
    small_batches(spark)
    total = documents.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // RANGE_BYTES))
    own = documents.select(F.col("doc_id"), F.col(text).alias("text"), F.monotonically_increasing_id().alias("_row"))
    ranged = own.repartitionByRange(n, "doc_id", "_row").sortWithinPartitions("doc_id", "_row").select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, done = TaskContext.get().partitionId(), 0
        for batch in batches:
            for first, ids, bounds in bpe.encoder(tokenizer, special=True).encode(batch.column(1)):
                rows = len(bounds) - 1
                after = bounds + np.arange(rows + 1)
                flat = np.full(after[-1], end_id, dtype=np.int32)
                flat[np.arange(len(ids)) + np.repeat(np.arange(rows), np.diff(bounds))] = ids
                lists = pa.ListArray.from_arrays(pa.array(after.astype(np.int32)), pa.array(flat))
                part = batch.slice(first, rows)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(np.full(rows, where, dtype=np.int32)), pa.array(done + after[:-1]), pa.array(np.diff(after)), lists],
                    ["doc_id", "range", "place", "n_tokens", "ids"],
                )
                done += int(after[-1])
            give_back()

    kind = documents.schema["doc_id"].dataType.simpleString()
    rows = ranged.mapInArrow(run, f"doc_id {kind}, range int, place long, n_tokens long, ids array<int>")
    rows.write.options(**ORC_OPTIONS).orc(f"{path}/ids")
    # of the files only two narrow columns are read for this
    sizes = spark.read.schema(rows.schema).orc(f"{path}/ids").groupBy("range").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sizes.select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")).coalesce(1).write.orc(f"{path}/ranges")


def read_tokens(spark: SparkSession, path: str, kind: str = "bigint") -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids of every document."""
    rows = spark.read.schema(f"doc_id {kind}, range int, place long, n_tokens long, ids array<int>").orc(f"{path}/ids")
    ranges = spark.read.schema("range int, base long").orc(f"{path}/ranges")  # a row for each file of ids/
    return rows.join(F.broadcast(ranges), "range").select("doc_id", (F.col("base") + F.col("place")).alias("start"), "n_tokens", "ids")


def find_tokens(spark: SparkSession, path: str, doc_ids: list, kind: str = "bigint") -> DataFrame:
    """The same for a few documents: only stripes and row groups that may hold their ids are read."""
    return read_tokens(spark, path, kind).where(F.col("doc_id").isin(*doc_ids))


def with_checksum(rows: DataFrame) -> DataFrame:
    """Instead of ids, ids_crc32: the unsigned crc32 of the ids as little-endian unsigned 32-bit integers."""
    kept = [c for c in rows.columns if c != "ids"]
    small_batches(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(batch.num_columns - 1)
            flat = np.ascontiguousarray(lists.flatten().to_numpy(zero_copy_only=False), dtype="<u4")
            bounds = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))])
            raw = memoryview(flat).cast("B")
            out = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, pa.int64())], [*kept, "ids_crc32"])

    own = rows.select(*kept, "ids")
    from pyspark.sql.types import LongType, StructField, StructType

    return own.mapInArrow(run, StructType([*own.schema.fields[:-1], StructField("ids_crc32", LongType())]))
