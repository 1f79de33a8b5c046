"""Exact counts of 64-bit keys over a whole corpus, with little to shuffle.

A map task sorts the keys of its input, sums their weights, and packs each range of keys
as byte planes of differences, compressed: three to four bytes for a key instead of some
twenty for a row. A reduce group is one range of keys; hot keys arrive once from each
task, so no key makes a group large. The number of ranges grows with the input. A task's
keys can be cut well into so many ranges only; where more are needed, tasks that each have
a part of a few wide ranges merge what they get and cut it again.

Keys are never null (their makers leave out null and empty texts); an empty table has no
keys and gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dqspark.llm.common import cut, give_back, small_batches

#: Keys that a map task sorts at once, and leading bits of the ranges that it cuts them into at most.
FLUSH_KEYS, COARSE_BITS = 1 << 21, 12

_U = np.uint64


def planes(values: np.ndarray) -> bytes:
    """The bytes of an integer array, all first bytes before all second bytes and so on."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes()


def from_planes(raw: bytes, dtype: type, n: int) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, dtype=np.uint8).reshape(size, n).T).view(dtype).reshape(n)


def pack(keys: np.ndarray, arrays: list[np.ndarray]) -> bytes:
    """Ascending uint64 keys and arrays of integers beside them as one compressed value."""
    raw = planes(np.diff(keys, prepend=_U(0))) + b"".join(map(planes, arrays))
    return zstandard.ZstdCompressor(level=1).compress(raw)


def unpack(blob: bytes, n: int, dtypes: list[type]) -> tuple[np.ndarray, list[np.ndarray]]:
    sizes = [8, *[np.dtype(d).itemsize for d in dtypes]]
    raw = zstandard.ZstdDecompressor().decompress(blob, max_output_size=n * sum(sizes) + 1)
    at = np.cumsum([0, *sizes]) * n
    keys = np.cumsum(from_planes(raw[: at[1]], _U, n), dtype=_U)
    return keys, [from_planes(raw[a:b], d, n) for a, b, d in zip(at[1:], at[2:], dtypes, strict=False)]


def summed(keys: np.ndarray, weights: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Distinct keys in ascending order and the sums of their weights."""
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, dtype=np.int64)
    return keys[first], [np.add.reduceat(w[order].astype(np.int64), first) if len(first) else w[:0] for w in weights]


def tallied(keys: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Distinct keys in ascending order and how often each is there; sorts in place."""
    keys.sort()
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, dtype=np.int64)
    return keys[first], [np.diff(np.append(first, len(keys)))]


def range_bits(df: DataFrame) -> int:
    """So many leading bits of a key name its range that a range holds less than a map task's keys."""
    return min(24, max(4, (4 * df.rdd.getNumPartitions() - 1).bit_length()))


def spread(keys: np.ndarray, arrays: list[np.ndarray], bits: int) -> pa.RecordBatch:
    """A row (r, n, blob) for each range of the ascending keys, named by their leading bits."""
    ranges = (keys >> _U(64 - bits)).astype(np.int64)
    edges = np.flatnonzero(np.concatenate([[True], ranges[1:] != ranges[:-1], [True]])) if len(keys) else np.zeros(1, int)
    out = [(int(ranges[a]), int(b - a), pack(keys[a:b], [x[a:b] for x in arrays])) for a, b in zip(edges, edges[1:], strict=False)]
    cols = list(zip(*out, strict=True)) or [(), (), ()]
    return pa.record_batch([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.binary())], ["r", "n", "blob"])


RANGE = "r int, n long, blob binary"

#: Arrays beside keys from several parts, brought together.
Merge = Callable[[list[tuple[np.ndarray, list[np.ndarray]]]], tuple[np.ndarray, list[np.ndarray]]]


def first_bits(bits: int) -> int:
    """Leading bits that name the ranges which map tasks cut their keys into."""
    return min(bits, COARSE_BITS)


def cut_again(packed: DataFrame, bits: int, parts: int, dtypes: list[type], merge: Merge) -> DataFrame:
    """The rows of spread(..., first_bits(bits)) as such of all bits; of as many tasks as there are parts of the input."""
    coarse = first_bits(bits)
    if coarse == bits:
        return packed

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for size, blob in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                held.append(unpack(blob, size, dtypes))
                n += size
                if n >= FLUSH_KEYS:
                    yield spread(*merge(held), bits)
                    held, n = [], 0
        if n:
            yield spread(*merge(held), bits)
        give_back()

    salt = F.pmod(F.xxhash64("blob"), F.lit(-(-parts >> coarse) + 1))
    return packed.repartition(max(parts, 1), "r", salt).mapInArrow(run, RANGE)


def count_keys(
    df: DataFrame,
    keys_of: Callable[[pa.RecordBatch], Iterator[tuple[np.ndarray, list[np.ndarray]]]],
    n_weights: int,
    least: Callable[[list[np.ndarray]], np.ndarray],
) -> DataFrame:
    """(key long, w0 long, w1 long, ...) for the keys whose sums pass least, a vectorised test.

    keys_of gives uint64 keys and their weights for a batch; without weights each counts one
    and w0 is their number. The signed long holds the same bits.
    """
    small_batches(df.sparkSession)
    parts, bits = df.rdd.getNumPartitions(), range_bits(df)
    columns = max(n_weights, 1)
    names, dtypes = [f"w{k}" for k in range(columns)], [np.uint32] * columns

    def merge(held: list[tuple[np.ndarray, list[np.ndarray]]]) -> tuple[np.ndarray, list[np.ndarray]]:
        keys, sums = summed(np.concatenate([k for k, _ in held]), [np.concatenate([w[i] for _, w in held]) for i in range(columns)])
        return keys, [w.astype(np.uint32) for w in sums]

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def flush() -> pa.RecordBatch:
            keys, sums = merge(held) if n_weights else tallied(np.concatenate([k for k, _ in held]))
            held.clear()
            return spread(keys, [w.astype(np.uint32) for w in sums], first_bits(bits))

        for batch in batches:
            for part in keys_of(batch):
                held.append(part)
                n += len(part[0])
                if n >= FLUSH_KEYS:
                    yield flush()
                    n = 0
                    give_back()
        if n:
            yield flush()
        give_back()

    def reduced(group: pa.Table) -> pa.Table:
        held = [unpack(blob, n, dtypes) for blob, n in zip(group["blob"].to_pylist(), group["n"].to_pylist(), strict=True)]
        keys, sums = summed(np.concatenate([k for k, _ in held]), [np.concatenate([w[i] for _, w in held]) for i in range(columns)])
        keep = least(sums)
        found = pa.table([pa.array(keys[keep].view(np.int64)), *[pa.array(w[keep]) for w in sums]], ["key", *names])
        del held, keys, sums
        give_back()
        return found

    packed = cut_again(df.mapInArrow(mapped, RANGE), bits, parts, dtypes, merge)
    return packed.groupBy("r").applyInArrow(reduced, ", ".join(["key long", *(f"{c} long" for c in names)]))


def requests(block: int, bits: int, keys: np.ndarray, weights: list[np.ndarray]) -> pa.Table:
    """What a block asks answer_keys() for: its distinct keys with its own sums of weights, packed by ranges of 2**(64 - bits) keys."""
    keys, weights = summed(keys, weights)
    ranges = (keys >> _U(64 - bits)).astype(np.int64)
    edges = np.flatnonzero(np.concatenate([[True], ranges[1:] != ranges[:-1], [True]])) if len(keys) else np.zeros(1, int)
    spans = list(zip(edges.tolist(), edges[1:].tolist(), strict=False))
    return pa.table(
        {
            "block": pa.array([block] * len(spans), pa.int64()),
            "r": pa.array([int(ranges[a]) for a, _ in spans], pa.int32()),
            "n": pa.array([b - a for a, b in spans], pa.int64()),
            "blob": pa.array([pack(keys[a:b], [w[a:b].astype(np.uint32) for w in weights]) for a, b in spans], pa.binary()),
        }
    )


REQUEST = "block long, r int, n long, blob binary"


def answer_keys(asked: DataFrame, n_weights: int, least: Callable[[list[np.ndarray]], np.ndarray]) -> DataFrame:
    """(block, r, n, blob) as asked, blob with the sums over all blocks of each of the block's keys, 0 where they don't pass least.

    Each range adds a row without a block that has in sums: the number of its keys that pass, their sums and the sums of all.
    A block may ask once for a range. No table of all keys is gathered anywhere: a range and a block are the largest pieces.
    """

    def answered(group: pa.Table) -> pa.Table:
        sizes = group["n"].to_pylist()
        parts = [unpack(blob, n, [np.uint32] * n_weights) for blob, n in zip(group["blob"].to_pylist(), sizes, strict=True)]
        keys, weights = summed(np.concatenate([k for k, _ in parts]), [np.concatenate([w[i] for _, w in parts]) for i in range(n_weights)])
        keep = least(weights)
        found = [np.where(keep, w, 0).astype(_U) for w in weights]
        packer = zstandard.ZstdCompressor(level=1)
        blobs = []
        for own, _ in parts:
            at = np.searchsorted(keys, own)
            blobs.append(packer.compress(b"".join(planes(f[at]) for f in found)))
        sums = [int(keep.sum()), *[int(f.sum()) for f in found], *[int(w.sum()) for w in weights]]
        r = group["r"][0].as_py()
        return pa.table(
            {
                "block": pa.array([*group["block"].to_pylist(), None], pa.int64()),
                "r": pa.array([r] * (len(sizes) + 1), pa.int32()),
                "n": pa.array([*sizes, None], pa.int64()),
                "blob": pa.array([*blobs, None], pa.binary()),
                "sums": pa.array([*[None] * len(sizes), sums], pa.list_(pa.int64())),
            }
        )

    return asked.groupBy("r").applyInArrow(answered, f"{REQUEST}, sums array<long>")


def answers(rows: pa.Table, n_weights: int) -> list[np.ndarray]:
    """The sums for a block's distinct keys in ascending order, from its rows of answer_keys()."""
    rows = rows.sort_by("r")
    found = [[np.zeros(0, dtype=_U)] for _ in range(n_weights)]
    for blob, n in zip(rows["blob"].to_pylist(), rows["n"].to_pylist(), strict=True):
        raw = zstandard.ZstdDecompressor().decompress(blob, max_output_size=8 * n * n_weights + 1)
        for i in range(n_weights):
            found[i].append(from_planes(raw[8 * n * i : 8 * n * (i + 1)], _U, n))
    return [np.concatenate(f).astype(np.float64) for f in found]


def heaviest(counts: DataFrame, weight: str, least: int, most: int) -> tuple[pd.DataFrame, int]:
    """The counted keys of at least a limit, and that limit: least, or the power of two above it from which at most `most` are left."""
    counts = cut(counts)
    sizes = counts.groupBy(F.floor(F.log2(weight)).cast("int").alias("k")).agg(F.count(F.lit(1)).alias("n")).collect()
    limit, total = least, 0
    for row in sorted(sizes, key=lambda r: -r["k"]):
        total += row["n"]
        if total > most:
            limit = max(least, 1 << (row["k"] + 1))
            break
    found = counts.where(F.col(weight) >= limit).toPandas()
    return found.iloc[np.argsort(found["key"].to_numpy(dtype=np.int64).view(_U))], limit
