"""Tables, lineage cuts and broadcast bounds shared by the operators."""

from __future__ import annotations

import ctypes

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dqspark.session import scratch, shared_dir

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: Most rows and bytes of an Arrow batch between Spark and a Python worker.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 2000, "spark.sql.execution.arrow.maxBytesPerBatch": 8 << 20}


def small_batches(spark: SparkSession) -> None:
    """Bounds the session's Arrow batches by BATCH; smaller bounds that are set stay."""
    for key, most in BATCH.items():
        now = spark.conf.get(key)
        size = int(now) if now.lstrip("-").isdigit() else 0
        if not 0 < size <= most:
            spark.conf.set(key, str(most))


def give_back() -> None:
    """Lets the system have the memory that this Python worker has freed, where the C library can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def batch_text(batch: pa.RecordBatch, path: list[str]) -> pa.Array:
    """A column of a batch, or a field of a struct column that is never null, by names."""
    found = batch.column(batch.schema.names.index(path[0]))
    for name in path[1:]:
        found = found.field(name)
    return found


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(col: Column) -> Column:
    """A-Z in lower case, every other character as it is."""
    return F.translate(col, UPPER, LOWER)


def cut(df: DataFrame) -> DataFrame:
    """The rows, computed now and kept in the shared folder, without lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """Like cut(), but as Parquet, for wide rows of which later steps read some columns.

    The files lie under dqspark/<application id> in the shared folder.
    """
    spark, path = df.sparkSession, scratch(df.sparkSession)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def literal_rows(spark: SparkSession, rows: list[tuple], names: list[str], types: list[str]) -> DataFrame:
    """A small table of constants as a plan of expressions."""
    cols = [F.lit(None).cast(t).alias(n) for n, t in zip(names, types, strict=True)]
    if not rows:
        return spark.range(0).select(*cols)
    structs = [
        F.struct(*[F.lit(v).cast(t).alias(n) for v, n, t in zip(row, names, types, strict=True)]) for row in rows
    ]
    return spark.range(1).select(F.inline(F.array(*structs)))
