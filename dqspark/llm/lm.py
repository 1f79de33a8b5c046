"""Language-model scoring by cross-entropy difference.

Two bigram models of words, of a target part of the corpus and of the whole corpus as
background, share one vocabulary and one list of word pairs and are smoothed alike (pairs
fall back on single words, these on an even chance). Each token costs some loss under
either; a document's score is the mean of the differences, low for texts like the target.

Both models hold every word and every pair counted LEAST times or more in all documents,
however many there are: the counts are never gathered. Documents are dealt into blocks of
some megabytes; a block asks each range of keys for the counts of its own words, then of
its own pairs, and gets them back. Words counted less are one unknown word, such pairs fall
back. Only a few sums reach the driver.

Nulls, empty texts and texts without words have no tokens, losses of 0 and a score of 0.
Repeated rows are counted and scored each; further columns are left out; an empty table
gives an empty result, and without target documents the target model is an even chance.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from dqspark.llm.common import cut, stored
from dqspark.llm.counting import REQUEST, answer_keys, answers, requests
from dqspark.llm.textbuf import Words, mix, slices

#: Bytes of text of a block; a longer text is a block alone.
BLOCK_BYTES = 1 << 23
#: Least count of a word and of a pair, and the weight of the fallback in counts.
LEAST, PRIOR = 2, 50.0
#: Target ids that may be broadcast; more are joined by a shuffle.
MAX_BROADCAST_IDS = 1_000_000

_U = np.uint64
#: In place of a word's hash: a word counted less than LEAST times, the start of a text.
UNKNOWN, BEGIN = _U(0), _U(1)


class Block:
    """The words of a block's texts: hash, row (doc), words a row (n), target (by word), and first words of their texts."""

    def __init__(self, data: bytes):
        self.rows = rows = pa.ipc.open_stream(data).read_all()
        held = [(Words(data, offsets), first) for first, data, offsets in slices(rows["text"])]
        join = lambda parts, kind: np.concatenate([np.zeros(0, dtype=kind), *parts])
        self.hash = join([w.hash for w, _ in held], _U)
        self.doc = join([w.doc + first for w, first in held], np.int64)
        self.n = np.bincount(self.doc, minlength=len(rows))
        self.target = np.asarray(rows["target"].combine_chunks()).astype(np.uint32)[self.doc]
        self.first = np.diff(self.doc, prepend=-1) > 0

    def before(self, values: np.ndarray, begin: float | np.uint64) -> np.ndarray:
        """The value of the word before each word, begin for the first of a text."""
        out = np.empty_like(values)
        out[1:] = values[:-1]
        out[self.first] = begin
        return out

    def counts(self, found: pa.Table) -> tuple[list[np.ndarray], np.ndarray]:
        """Of each word the counts in the target and in all documents, and whether it is known."""
        place = np.searchsorted(np.unique(self.hash), self.hash)
        counts = [a[place] for a in answers(found, 2)]
        return counts, counts[1] > 0

    def pairs(self, known: np.ndarray) -> np.ndarray:
        """Of each word the key of it and the one before it."""
        own = np.where(known, self.hash, UNKNOWN)
        return mix(mix(self.before(own, BEGIN)) + own)

    def asks(self, number: int, bits: int, keys: np.ndarray) -> pa.Table:
        return requests(number, bits, keys, [self.target, np.ones(len(keys), dtype=np.uint32)])


@dataclass(frozen=True)
class Model:
    """The sums of one model: known words (n_words distinct) and unknown ones, and texts."""

    total: float
    unknown: float
    begins: float
    n_words: int

    def loss(self, block: Block, known: np.ndarray, counts: np.ndarray, pairs: np.ndarray) -> np.ndarray:
        own = np.where(known, counts, self.unknown)
        single = (own + 0.5) / (self.total + self.unknown + 0.5 * (self.n_words + 1))
        return -np.log((pairs + PRIOR * single) / (block.before(own, self.begins) + PRIOR))


def _blocks(marked: DataFrame) -> DataFrame:
    """A row for each block, a run of rows of one partition: its number, its rows and target rows, and the rows packed."""

    def packed(number: int, held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows, sink = pa.Table.from_batches(held), pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_table(rows.combine_chunks())
        n_target = pc.sum(rows["target"]).as_py() or 0
        return pa.record_batch([pa.array([x]) for x in (number, len(rows), n_target)] + [pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["block", "n_rows", "n_target", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, size = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(2)), 0).to_numpy(zero_copy_only=False)
            first = 0
            for k, own in enumerate(sizes.tolist()):
                if size and size + own > BLOCK_BYTES:
                    yield packed(number, [*held, batch.slice(first, k - first)])
                    number, held, size, first = number + 1, [], 0, k
                size += own
            held.append(batch.slice(first))
        if held:
            yield packed(number, held)

    return marked.mapInArrow(run, "block long, n_rows long, n_target long, data binary")


def _sums(found: DataFrame) -> list[int]:
    """The number of keys that pass, their two sums and the two sums of all."""
    row = found.where("block is null").agg(*[F.coalesce(F.sum(F.col("sums")[k]), F.lit(0)) for k in range(5)]).first()
    return list(row)


def score(documents: DataFrame, target_ids: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss (mean nats a token) and score, their difference.

    target_ids: doc_id of the documents that the target model is counted from.
    """
    ids = target_ids.where("doc_id is not null").select("doc_id", F.lit(True).alias("_t")).distinct()
    ids = F.broadcast(ids) if ids.count() <= MAX_BROADCAST_IDS else ids
    own = documents.select("doc_id", F.col(text).alias("text"))
    marked = own.join(ids, "doc_id", "left").select("doc_id", F.coalesce("_t", F.lit(False)).alias("target"), "text")
    # kept, as a block must have the same rows whenever it is read
    blocks = stored(_blocks(marked))
    sizes = blocks.agg(F.count(F.lit(1)), F.sum("n_target"), F.sum("n_rows")).first()
    bits, begins = min(24, max(4, sizes[0].bit_length())), (float(sizes[1] or 0), float(sizes[2] or 0))
    often = lambda w: w[1] >= LEAST

    def ask_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                block = Block(data.as_py())
                yield from block.asks(number, bits, block.hash).to_batches()

    def ask_pairs(rows: pa.Table, found: pa.Table) -> pa.Table:
        block = Block(rows["data"][0].as_py())
        return block.asks(rows["block"][0].as_py(), bits, block.pairs(block.counts(found)[1]))

    held = blocks.select("block", "data")
    by_block = held.groupBy("block")
    words = cut(answer_keys(held.mapInArrow(ask_words, REQUEST), 2, often))
    n_words, *sums = _sums(words)
    models = [Model(float(sums[k]), float(sums[2 + k] - sums[k]), begins[k], n_words) for k in range(2)]
    of_words = words.where("block is not null").select("block", "r", "n", "blob")
    pairs = answer_keys(by_block.cogroup(of_words.groupBy("block")).applyInArrow(ask_pairs, REQUEST), 2, often)
    of_pairs = pairs.where("block is not null").select("block", "r", "n", "blob")
    both = of_words.withColumn("pair", F.lit(False)).unionAll(of_pairs.withColumn("pair", F.lit(True)))

    def scored(rows: pa.Table, found: pa.Table) -> pa.Table:
        block = Block(rows["data"][0].as_py())
        counts, known = block.counts(found.filter(pc.invert(found["pair"])))
        keys = block.pairs(known)
        place = np.searchsorted(np.unique(keys), keys)
        in_pairs = [a[place] for a in answers(found.filter(found["pair"]), 2)]
        target, background = (
            np.bincount(block.doc, weights=m.loss(block, known, c, p), minlength=len(block.n)) / np.maximum(block.n, 1) for m, c, p in zip(models, counts, in_pairs, strict=True)
        )
        return pa.table(
            [block.rows["doc_id"], pa.array(block.n), pa.array(np.round(target, 6)), pa.array(np.round(background, 6)), pa.array(np.round(target - background, 6))],
            ["doc_id", "n_tokens", "target_loss", "background_loss", "score"],
        )

    kind = own.schema["doc_id"].dataType.simpleString()
    return by_block.cogroup(both.groupBy("block")).applyInArrow(scored, f"doc_id {kind}, n_tokens long, target_loss double, background_loss double, score double")
