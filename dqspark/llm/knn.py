"""A quality classifier by nearest-neighbour voting on latent-semantic vectors.

A text becomes counts of hashed byte n-grams of several lengths and a few counts of
character and line kinds, damped, weighted and projected on the leading singular vectors
of the labelled sample. The sample's vectors are broadcast; for every document exact cosines
with all of them come from blocked matrix products, and the labels of the nearest ones,
weighted by similarity, give the score.

Bounds: the classifier is fitted on at most SAMPLE labelled texts of each label, those
with the least hash of their id; so at most 2 * SAMPLE vectors of RANK numbers are broadcast.
All documents are scored, each over its whole text.

Nulls and empty texts have no n-grams; their score is that of the nearest neighbours of an
empty text. Labels without doc_id or value are not used, repeated ones only if they agree;
without any label the score is 0.5. Of several rows of a labelled doc_id the one of the least
text trains. Ties among neighbours share the vote. Repeated rows get
equal scores; further columns are left out; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from dqspark.llm.common import batch_text, give_back, small_batches
from dqspark.llm.textbuf import Words, slices

SAMPLE, RANK, NEIGHBOURS, POWER = 1500, 64, 25, 8
#: Buckets of hashed n-grams, and the n-gram lengths in bytes.
BUCKETS, GRAMS = 1 << 11, (1, 2, 3)
THRESHOLD = 0.7
#: Documents and sample vectors in one matrix product.
BLOCK = 512

EXTRAS = 8
#: What the extra features weigh beside the n-grams.
EXTRA_WEIGHT = 0.35

_U = np.uint64


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of BUCKETS + EXTRAS numbers for each text of a slice."""
    rows, n = len(offsets) - 1, len(data)
    out = np.zeros((rows, BUCKETS + EXTRAS), dtype=np.float32)
    wide = data.astype(np.uint32)
    doc_ends = offsets[1:]
    for size in GRAMS:
        code = np.zeros(max(0, n - size + 1), dtype=np.uint32)
        for k in range(size):
            code = code * np.uint32(257) + wide[k : k + len(code)] + np.uint32(1)
        slot = (code * np.uint32(2654435761)) >> np.uint32(32 - 11)
        slot ^= np.uint32(size * 677)
        slot &= np.uint32(BUCKETS - 1)
        for r in range(rows):
            a, b = offsets[r], doc_ends[r] - size + 1
            if b > a:
                out[r, :BUCKETS] += np.bincount(slot[a:b], minlength=BUCKETS)
    np.log1p(out[:, :BUCKETS], out=out[:, :BUCKETS])
    norm = np.sqrt((out[:, :BUCKETS] ** 2).sum(axis=1, keepdims=True))
    out[:, :BUCKETS] /= np.maximum(norm, 1e-9)
    w = Words(data, offsets)
    n_words = np.diff(w.first)
    size = np.diff(offsets)
    sums = lambda mark: np.concatenate([[0], np.cumsum(mark)])
    share = lambda mark: np.diff(sums(mark)[offsets]) / np.maximum(size, 1)
    lower = (data >= 97) & (data < 123)
    upper = (data >= 65) & (data < 91)
    digit = (data >= 48) & (data < 58)
    distinct = np.array([len(np.unique(w.hash[a:b])) for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True)]) if rows else np.zeros(0)
    out[:, BUCKETS:] = EXTRA_WEIGHT * np.stack(
        [
            np.minimum(np.log1p(n_words) / 8, 1.2),
            distinct / np.maximum(n_words, 1),
            share(upper) * 4,
            share(digit) * 4,
            share(~lower & ~upper & ~digit & ~w.space & (data < 128)) * 4,
            np.minimum(size / np.maximum(n_words, 1) / 16, 2),
            share(data == 10) * 8,
            share(data >= 128) * 2,
        ],
        axis=1,
    )
    return out


@dataclass(frozen=True)
class Model:
    centre: np.ndarray
    project: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    def embed(self, x: np.ndarray) -> np.ndarray:
        y = (x - self.centre) @ self.project
        return y / np.maximum(np.sqrt((y * y).sum(axis=1, keepdims=True)), 1e-9)

    def score(self, x: np.ndarray) -> np.ndarray:
        """The share of label 1 in the votes of the nearest vectors, each of the POWER of its cosine."""
        if not len(self.vectors):
            return np.full(len(x), 0.5)
        y = self.embed(x)
        k = min(NEIGHBOURS, len(self.vectors))
        out = np.empty(len(y))
        for a in range(0, len(y), BLOCK):
            near = np.concatenate([y[a : a + BLOCK] @ self.vectors[b : b + BLOCK].T for b in range(0, len(self.vectors), BLOCK)], axis=1)
            top = np.argpartition(-near, k - 1, axis=1)[:, :k]
            vote = np.maximum(np.take_along_axis(near, top, axis=1).astype(np.float64), 0) ** POWER + 1e-9
            good = self.labels[top]
            out[a : a + BLOCK] = (vote * good).sum(axis=1) / vote.sum(axis=1)
        return np.clip(np.round(out, 6), 0, 1)


def fit(x: np.ndarray, labels: np.ndarray) -> Model:
    """From the features and labels (0 or 1) of the sample."""
    if not len(x):
        return Model(np.zeros(0, np.float32), np.zeros((0, 0), np.float32), np.zeros((0, 0), np.float32), labels)
    centre = x.mean(axis=0)
    moved = x - centre
    values, vectors = np.linalg.eigh((moved.T @ moved).astype(np.float64))
    project = vectors[:, ::-1][:, :RANK].astype(np.float32)
    blank = Model(centre, project, np.zeros((0, RANK), np.float32), labels)
    return Model(centre, project, blank.embed(x).astype(np.float32), labels.astype(np.float64))


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learnt from."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2


def _feature_rows(documents: DataFrame, kept: str) -> DataFrame:
    small_batches(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, offsets in slices(batch.column(1), BLOCK):
                x = features(data, offsets)
                part = batch.slice(first, len(offsets) - 1)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([r.tobytes() for r in x], pa.binary())], [kept, "x"])

    return documents.select(kept, "text").mapInArrow(run, f"{kept} double, x binary")


def train(documents: DataFrame, labels: DataFrame, label: str = "quality") -> Model:
    """From documents with a label of 0 or 1 that are not held out."""
    agreed = (
        labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.min(label).cast("double").alias("y"), F.max(label).cast("double").alias("_max"))
        .where("y = _max")
    )
    least = F.xxhash64(F.lit("sample"), "doc_id")
    sample = None
    for value in (0, 1):
        own = agreed.where(F.col("y") == value).orderBy(least, "doc_id").limit(SAMPLE).select("doc_id", "y")
        sample = own if sample is None else sample.unionAll(own)
    ids = sample.collect()  # 2 * SAMPLE rows at most
    if not ids:
        return fit(np.zeros((0, BUCKETS + EXTRAS), np.float32), np.zeros(0))
    spark = documents.sparkSession
    chosen = F.broadcast(spark.createDataFrame(pd.DataFrame({"doc_id": [r["doc_id"] for r in ids], "y": [r["y"] for r in ids]})))
    rows = documents.select("doc_id", "text").join(chosen, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y"))
    found = _feature_rows(rows, "y").toPandas()
    x = np.frombuffer(b"".join(found["x"]), dtype=np.float32).reshape(len(found), BUCKETS + EXTRAS)
    y = found["y"].to_numpy(dtype=np.float64)
    order = np.lexsort((*x.T[:8], x[:, BUCKETS + 1], y))  # the same whatever order the rows came in
    return fit(x[order], y[order])


def score(documents: DataFrame, model: Model, within: str | None = None) -> DataFrame:
    """doc_id with score and predicted for each document; or, instead of doc_id, a struct column that has the text."""
    spark = documents.sparkSession
    small_batches(spark)
    held = spark.sparkContext.broadcast(model)
    path, kept = ([within, "text"], within) if within else (["text"], "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for batch in batches:
            for first, data, offsets in slices(batch_text(batch, path), BLOCK):
                scores = model.score(features(data, offsets))
                part = batch.slice(first, len(offsets) - 1)
                mark = pa.array((scores >= THRESHOLD).astype(np.int32), pa.int32())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores, pa.float64()), mark], [kept, "score", "predicted"])
            give_back()

    own = documents.select(within) if within else documents.select("doc_id", "text")
    return own.mapInArrow(run, StructType([own.schema.fields[0], StructField("score", DoubleType()), StructField("predicted", IntegerType())]))
