"""Byte-level BPE encoding and decoding of table columns with the tokenizers library.

Nulls and empty texts have no ids. Every text is encoded whole, ties and repeated rows
alike; further columns pass through, those named like a result are replaced; an empty table
gives an empty result. The file's path must be readable on every executor.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, IntegerType, StructField, StructType

from dqspark.llm import bpe
from dqspark.llm.common import give_back, small_batches


def _lists(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values.astype(np.int32), pa.int32()))


def _framed(df: DataFrame, source: str, results: list[str], keep: list[str] | None) -> tuple[DataFrame, int, int]:
    """The columns to pass through, then the source unless it is one of them; its place, and the number of those."""
    kept = [c for c in (df.columns if keep is None else keep) if c.lower() not in results]
    own = [F.col(f"`{c}`") for c in kept]
    if source in kept:
        return df.select(*own), kept.index(source), len(kept)
    return df.select(*own, F.col(f"`{source}`").alias("_source")), len(kept), len(kept)


def encode(df: DataFrame, path: str, text: str = "text", offsets: bool = False, decoded: bool = False, round_trip: bool = False, keep: list[str] | None = None) -> DataFrame:
    """Adds ids, without special tokens; with offsets also starts and ends, in code points of the text.

    decoded: adds the bytes that the ids stand for, as decode() does, in the same pass.
    round_trip: adds whether those are the text's. keep: the columns to pass through, else all.
    """
    results = ["ids", *(["starts", "ends"] if offsets else []), *(["decoded"] if decoded else []), *(["round_trip"] if round_trip else [])]
    own, at, n_kept = _framed(df, text, results, keep)
    small_batches(df.sparkSession)
    names = own.columns[:n_kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        back = bpe.decoder(path)
        for batch in batches:
            texts = batch.column(at)
            for first, ids, bounds in bpe.encoder(path).encode(texts):
                rows, out = len(bounds) - 1, [_lists(ids, bounds)]
                if offsets:
                    out += [_lists(x, bounds) for x in back.offsets(ids, bounds)]
                if decoded or round_trip:
                    raw = [back.decode(ids[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                if decoded:
                    out.append(pa.array(raw, pa.binary()))
                if round_trip:
                    source = texts.slice(first, rows).cast(pa.binary()).fill_null(b"")
                    out.append(pc.equal(pa.array(raw, source.type), source))
                yield pa.RecordBatch.from_arrays([*batch.slice(first, rows).columns[:n_kept], *out], [*names, *results])
            give_back()

    kinds = {"decoded": BinaryType(), "round_trip": BooleanType()}
    fields = [StructField(n, kinds.get(n, ArrayType(IntegerType()))) for n in results]
    return own.mapInArrow(run, StructType([*own.schema.fields[:n_kept], *fields]))


def decode(df: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """Adds decoded, the bytes that the ids stand for, and drops nothing; null ids give no bytes."""
    own, at, n_kept = _framed(df, ids, ["decoded"], None)
    small_batches(df.sparkSession)
    names = own.columns[:n_kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = bpe.decoder(path)
        for batch in batches:
            lists = batch.column(at)
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            bounds = np.concatenate([[0], np.cumsum(np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64))])
            out = [decoder.decode(flat[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n_kept], pa.array(out, pa.binary())], [*names, "decoded"])

    return own.mapInArrow(run, StructType([*own.schema.fields[:n_kept], StructField("decoded", BinaryType())]))
