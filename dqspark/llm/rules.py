"""Quality rules with compression bands.

After a few counted base rules, zstandard ratios (bytes over compressed bytes) of the
whole text and of fixed chunks of it are held against limits for its length: text that
shrinks too well repeats itself, text that hardly shrinks is noise.

A null text counts as empty; an empty one has no words and fails the base rules. Texts are
judged one by one, so ties and repeated rows get equal verdicts; further columns pass
through, those named like a result are replaced; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from dqspark.llm.common import batch_text, give_back, small_batches
from dqspark.llm.textbuf import Spans, Words, slices, windows

MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
LEVEL, CHUNK_BYTES = 3, 4096
#: (texts of at least so many bytes, least ratio, greatest ratio) of whole texts, by length.
WHOLE_BANDS = ((0, 0.4, 2.6), (256, 1.1, 2.7), (1024, 1.3, 3.0), (4096, 1.45, 3.3), (16384, 1.5, 3.6), (65536, 1.5, 4.0))
#: Least and greatest ratio of a chunk, and the share of chunks that may lie outside. Chunks of base64 have up to 1.34, of prose over 2.
CHUNK_BAND, MAX_ODD_CHUNKS = (1.45, 4.0), 0.1

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_SPACES = re.compile(rb"[\x20\x09-\x0D]+")

FIELDS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, ratio double, odd_chunks double, kept boolean"


def ratios(raw: memoryview | bytes, packer: zstandard.ZstdCompressor) -> tuple[float, float]:
    """Ratio of the whole text, and the share of its chunks outside CHUNK_BAND: the full ones, and one that ends with the text.

    A text shorter than a chunk has none, its whole ratio tells.
    """
    if not len(raw):
        return 1.0, 0.0
    whole = len(raw) / len(packer.compress(raw))
    starts = list(range(0, len(raw) - CHUNK_BYTES + 1, CHUNK_BYTES))
    if starts and len(raw) % CHUNK_BYTES:
        starts.append(len(raw) - CHUNK_BYTES)
    odd = 0
    for at in starts:
        own = CHUNK_BYTES / len(packer.compress(raw[at : at + CHUNK_BYTES]))
        odd += not CHUNK_BAND[0] <= own <= CHUNK_BAND[1]
    return whole, odd / len(starts) if starts else 0.0


def in_bands(size: int, whole: float, odd: float) -> bool:
    low, high = next((a, b) for least, a, b in reversed(WHOLE_BANDS) if size >= least)
    return low <= whole <= high and odd <= MAX_ODD_CHUNKS


def _plain_repeats(words: list[bytes], lines: list[bytes]) -> tuple[int, int]:
    """Words in windows of three that occur twice or more, and lines equal to an earlier one."""
    grams = list(zip(words, words[1:], words[2:], strict=False))
    often = Counter(grams)
    inside = {k + j for k, g in enumerate(grams) if often[g] > 1 for j in range(3)}
    return len(inside), len(lines) - len(set(lines))


def base_counts(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The counted values for the rows of a slice.

    Windows and lines are brought together by their hashes and then compared; a row in which
    two of one hash differ is counted once more without hashes.
    """
    rows = len(offsets) - 1
    w = Words(data, offsets, lower=False)
    n_words = np.diff(w.first)
    sums = lambda mark: np.concatenate([[0], np.cumsum(mark)])
    chars = sums((data & 0xC0) != 0x80)
    word_chars = np.bincount(w.doc, weights=chars[w.end] - chars[w.start], minlength=rows).astype(np.int64)
    n_symbols = np.diff(sums(_SYMBOL[data])[offsets])
    clashing = np.zeros(rows, dtype=bool)
    # words in windows of three that occur twice or more in their text
    repeat = np.zeros(rows, dtype=np.int64)
    if len(w.start) >= 3:
        grams, doc = windows(w, 3), w.doc[: len(w.start) - 2]
        at = np.flatnonzero(doc == w.doc[2:])
        order = at[np.lexsort((grams[at], doc[at]))]
        same = (grams[order][1:] == grams[order][:-1]) & (doc[order][1:] == doc[order][:-1])
        a, b = order[:-1][same], order[1:][same]
        for k in range(3):
            clashing[doc[a[~w.same(a + k, b + k)]]] = True
        twice = np.zeros(len(order), dtype=bool)
        twice[1:] |= same
        twice[:-1] |= same
        inside = np.zeros(len(w.start), dtype=bool)
        for k in range(3):
            inside[order[twice] + k] = True
        repeat = np.bincount(w.doc[inside], minlength=rows)
    # lines with a word, equal to an earlier line of their text
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets[1:]] = True
    edge[:-1] |= data == 0x0A
    end = np.flatnonzero(edge)
    start = np.concatenate([[0], np.minimum(end[:-1] + (data[np.minimum(end[:-1], len(data) - 1)] == 0x0A), len(data))]) if len(end) else end
    worded = np.searchsorted(w.start, start) < np.searchsorted(w.start, end) if len(end) else np.zeros(0, dtype=bool)
    start, end = start[worded], end[worded]
    doc = np.searchsorted(offsets, start, "right") - 1
    lines = Spans(data)
    keys = lines.hash(start, end)
    order = np.lexsort((keys, doc))
    again = (keys[order][1:] == keys[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    a, b = order[:-1][again], order[1:][again]
    size = end - start
    equal = size[a] == size[b]
    equal[equal] = lines.same(start[a[equal]], size[a[equal]], lines, start[b[equal]])
    clashing[doc[a[~equal]]] = True
    n_dup = np.bincount(doc[b], minlength=rows)
    for r in np.flatnonzero(clashing).tolist():
        raw = data[offsets[r] : offsets[r + 1]].tobytes()
        own = slice(*np.searchsorted(doc, [r, r + 1]).tolist())
        texts = [data[x:y].tobytes() for x, y in zip(start[own].tolist(), end[own].tolist(), strict=True)]
        repeat[r], n_dup[r] = _plain_repeats([x for x in _SPACES.split(raw) if x], texts)
    return {"n_words": n_words, "word_chars": word_chars, "n_symbols": n_symbols, "n_dup_lines": n_dup, "n_repeat_words": repeat}


def judge(documents: DataFrame, text: str = "text", within: str | None = None) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, ratio, odd_chunks and kept.

    n_repeat_words: words in windows of three words found twice or more in the text, the first
    included. base_failed: under MIN_WORDS words, or over MAX_REPEAT_PERCENT of them repeated.
    kept: not base_failed, and every ratio in its band. within: a struct column that has the text.
    """
    small_batches(documents.sparkSession)
    fields = [f.split() for f in FIELDS.split(", ")]
    results = [n for n, _ in fields]
    path = [within, text] if within else ["_text" if text.lower() in results else text]
    source = [] if within or path == [text] else [F.col(f"`{text}`").alias("_text")]
    kept = [f for f in documents.schema if f.name.lower() not in results]
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False)
        for batch in batches:
            for first, data, offsets in slices(batch_text(batch, path)):
                rows = len(offsets) - 1
                c = base_counts(data, offsets)
                failed = (c["n_words"] < MIN_WORDS) | (100 * c["n_repeat_words"] > MAX_REPEAT_PERCENT * c["n_words"])
                raw = memoryview(np.ascontiguousarray(data))
                pairs = [ratios(raw[a:b], packer) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                whole, odd = np.array([x[0] for x in pairs]), np.array([x[1] for x in pairs])
                sizes = np.diff(offsets).tolist()
                fits = np.array([in_bands(n, *x) for n, x in zip(sizes, pairs, strict=True)], dtype=bool)
                own = [*c.values(), failed, whole, odd, ~failed & fits]
                types = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.float64(), pa.bool_()]
                part = batch.slice(first, rows)
                yield pa.RecordBatch.from_arrays([*part.columns[: len(names)], *[pa.array(x, t) for x, t in zip(own, types, strict=True)]], [*names, *results])
            give_back()

    schema = StructType([*kept, *StructType.fromDDL(FIELDS).fields])
    return documents.select(*[F.col(f"`{n}`") for n in names], *source).mapInArrow(run, schema)
