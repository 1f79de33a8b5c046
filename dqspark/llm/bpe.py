"""Byte-level BPE over Arrow batches with the tokenizers library.

The merges never cross a match of the pre-tokenization pattern, so a text is cut into
those matches once (vectorised over bytes), each distinct match is handed to the library
once and its ids are kept in a bounded cache, and the ids of a text are gathered from it.
Matches of up to seven bytes are their own keys in the cache; longer ones go by a hash, and
their bytes are kept and compared. A text goes through the library whole if it has code
points that this Python does not know, if two of its matches share a hash, or if it holds a
special token that the library is to recognise.
"""

from __future__ import annotations

import os
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa

from dqspark.llm.textbuf import Spans, slices

#: Distinct matches kept by a Python worker; beyond that the cache starts anew.
CACHE_ENTRIES = 1 << 19

_LETTER, _NUMBER, _WHITE, _OTHER, _UNKNOWN = range(5)
_SUFFIXES = (b"s", b"t", b"re", b"ve", b"m", b"ll", b"d")


def _class_of(code: int) -> int:
    char = chr(code)
    kind = unicodedata.category(char)
    if kind[0] == "L":
        return _LETTER
    if kind[0] == "N":
        return _NUMBER
    if code in (0x20, 0x85, *range(0x09, 0x0E)) or kind in ("Zs", "Zl", "Zp"):
        return _WHITE
    return _UNKNOWN if kind == "Cn" else _OTHER


_classes: np.ndarray | None = None


def classes() -> np.ndarray:
    """Class of each code point as the pattern sees it: letter, number, white space, other, not known."""
    global _classes
    if _classes is None:
        _classes = np.fromiter(map(_class_of, range(0x110000)), dtype=np.uint8, count=0x110000)
    return _classes


def byte_to_char() -> dict[int, str]:
    """The reversible byte-to-character table of byte-level vocabularies, from its rule.

    Printable bytes stand for themselves; the others take the code points from 256 upwards.
    """
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    table, spare = {}, 256
    for b in range(256):
        if b in printable:
            table[b] = chr(b)
        else:
            table[b], spare = chr(spare), spare + 1
    return table


def match_starts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte positions where a match of the pattern starts, and which rows hold unknown code points."""
    n = len(data)
    kind = classes()[data.astype(np.int64)]
    lead = (data & 0xC0) != 0x80
    if (high := np.flatnonzero(data >= 0xC0)).size:
        b = np.zeros((4, len(high)), dtype=np.int64)
        size = 2 + (data[high] >= 0xE0) + (data[high] >= 0xF0)
        for k in range(4):
            b[k] = data[np.minimum(high + k, n - 1)]
        code = np.select(
            [size == 2, size == 3],
            [(b[0] & 31) << 6 | b[1] & 63, (b[0] & 15) << 12 | (b[1] & 63) << 6 | b[2] & 63],
            (b[0] & 7) << 18 | (b[1] & 63) << 12 | (b[2] & 63) << 6 | b[3] & 63,
        )
        kind[high] = classes()[np.minimum(code, 0x10FFFF)]
        for k in (1, 2, 3):
            more = high[size > k]
            kind[more + k] = kind[more]
    unknown = np.zeros(len(offsets) - 1, dtype=bool)
    if (odd := np.flatnonzero((kind == _UNKNOWN) & lead)).size:
        unknown[np.searchsorted(offsets, odd, "right") - 1] = True
    starts = np.zeros(n + 1, dtype=bool)
    starts[offsets] = True
    starts[1:n] |= kind[1:] != kind[:-1]
    run = np.flatnonzero(starts[:n])
    if not run.size:
        return run, unknown
    after = np.append(run[1:], n)
    run_kind = kind[run]
    joined = np.zeros(n + 1, dtype=bool)
    joined[offsets] = True
    followed = (run_kind == _WHITE) & ~joined[after]
    # white space before another run: its last character stands apart, and a blank joins what follows
    where, end = run[followed], after[followed]
    last = end - 1
    for _ in range(3):
        last = np.where(lead[last], last, last - 1)
    blank = data[last] == 0x20
    starts[last] = True
    starts[end[blank]] = False
    # an apostrophe with one of the fixed suffixes
    k = np.flatnonzero((run_kind == _OTHER) & (data[run] == 0x27) & (after == run + 1) & starts[run] & ~joined[after])
    k = k[run_kind[np.minimum(k + 1, len(run) - 1)] == _LETTER]
    for suffix in _SUFFIXES:
        at, stop = after[k], after[np.minimum(k + 1, len(run) - 1)]
        fits = at + len(suffix) <= stop
        for j, byte in enumerate(suffix):
            fits &= data[np.minimum(at + j, n - 1)] == byte
        starts[at[fits]] = False
        starts[at[fits] + len(suffix)] = True
        k = k[~fits]
    return np.flatnonzero(starts[:n]), unknown


class Encoder:
    """Ids of whole texts, by a tokenizer file of the tokenizers library.

    special: a special token that stands in a text gets its own id, as the library gives it
    unless told otherwise; else it is encoded like any other characters.
    """

    def __init__(self, path: str, special: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not special
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()] if special else []
        self.token_bytes = decoder(path).length
        self._forget()

    @staticmethod
    def is_letter(data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Whether an ASCII letter stands there."""
        return ((data[np.minimum(at, len(data) - 1)] | 0x20) - 97).astype(np.uint8) < 26

    def _forget(self) -> None:
        self.keys = np.zeros(0, dtype=np.uint64)
        self.at = np.zeros(0, dtype=np.int64)
        self.size = np.zeros(0, dtype=np.int64)
        self.flat = np.zeros(0, dtype=np.int32)
        #: Of each key where its match starts in text, and its length.
        self.text_at = np.zeros(0, dtype=np.int64)
        self.text_size = np.zeros(0, dtype=np.int64)
        self.text = Spans(np.zeros(0, dtype=np.uint8))

    def _ids_of(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of matches, each encoded for itself, and their number for each."""
        found = [e.ids for e in self.tokenizer.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)]
        size = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        return np.fromiter(chain.from_iterable(found), dtype=np.int32, count=int(size.sum())), size

    def _ids_of_joined(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The same for matches of a blank and letters: side by side they are cut apart again."""
        texts = [b"".join(words[k : k + 500]).decode() for k in range(0, len(words), 500)]
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        flat = np.fromiter(chain.from_iterable(e.ids for e in found), dtype=np.int32)
        ends = np.cumsum(self.token_bytes[flat])
        word_ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)))
        return flat, np.diff(np.searchsorted(ends, word_ends), prepend=-1)

    def _learn(self, keys: np.ndarray, words: list[bytes], plain: np.ndarray) -> None:
        flat, at, size = [self.flat], np.zeros(len(keys), dtype=np.int64), np.zeros(len(keys), dtype=np.int64)
        base = len(self.flat)
        for which, ids_of in ((np.flatnonzero(plain), self._ids_of_joined), (np.flatnonzero(~plain), self._ids_of)):
            if which.size:
                ids, n = ids_of([words[k] for k in which.tolist()])
                size[which], at[which] = n, base + np.cumsum(n) - n
                flat.append(ids)
                base += len(ids)
        # only of matches that go by a hash are the bytes needed
        hashed = [w if key >> 63 else b"" for w, key in zip(words, keys.tolist(), strict=True)]
        lengths = np.fromiter(map(len, hashed), dtype=np.int64, count=len(hashed))
        place = np.searchsorted(self.keys, keys)
        self.keys = np.insert(self.keys, place, keys)
        self.at = np.insert(self.at, place, at)
        self.size = np.insert(self.size, place, size)
        self.text_at = np.insert(self.text_at, place, len(self.text.data) + np.cumsum(lengths) - lengths)
        self.text_size = np.insert(self.text_size, place, lengths)
        self.text = Spans(np.concatenate([self.text.data, np.frombuffer(b"".join(hashed), dtype=np.uint8)]))
        self.flat = np.concatenate(flat)

    def _clashing(self, spans: Spans, starts: np.ndarray, ends: np.ndarray, place: np.ndarray) -> np.ndarray:
        """The matches (by index) that are not those whose ids the cache holds at place."""
        own = np.flatnonzero(self.keys[place] >> np.uint64(63))
        size, where = ends[own] - starts[own], place[own]
        same = size == self.text_size[where]
        same[same] = spans.same(starts[own[same]], size[same], self.text, self.text_at[where[same]])
        return own[~same]

    @staticmethod
    def _keys(spans: Spans, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A match of up to seven bytes as a number with its length; of longer ones a hash, with the highest bit set."""
        size = ends - starts
        keys = spans.eight(starts, size) | size.astype(np.uint64) << np.uint64(56)
        long = np.flatnonzero(size > 7)
        keys[long] = spans.hash(starts[long], ends[long]) | np.uint64(1 << 63)
        return keys

    def _whole(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Rows that hold a special token."""
        found = np.zeros(len(offsets) - 1, dtype=bool)
        raw = data.tobytes() if self.special else b""
        for token in self.special:
            at = raw.find(token)
            while at >= 0:
                found[np.searchsorted(offsets, at, "right") - 1] = True
                at = raw.find(token, at + 1)
        return found

    def _slice(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts, unknown = match_starts(data, offsets)
        ends = np.append(starts[1:], len(data))
        spans = Spans(data)
        unknown |= self._whole(data, offsets)
        keys, first, inverse = np.unique(self._keys(spans, starts, ends), return_index=True, return_inverse=True)
        if len(self.keys) + len(keys) > CACHE_ENTRIES:
            self._forget()
        place = np.searchsorted(self.keys, keys)
        new = np.ones(len(keys), dtype=bool)
        inside = place < len(self.keys)
        new[inside] = self.keys[place[inside]] != keys[inside]
        if new.any():
            view = data.tobytes()
            pairs = zip(starts[first[new]].tolist(), ends[first[new]].tolist(), strict=True)
            plain = (data[starts[first[new]]] == 0x20) & self.is_letter(data, starts[first[new]] + 1)
            self._learn(keys[new], [view[a:b] for a, b in pairs], plain)
            place = np.searchsorted(self.keys, keys)
        unknown[np.searchsorted(offsets, starts[self._clashing(spans, starts, ends, place[inverse])], "right") - 1] = True
        at, size = self.at[place][inverse], self.size[place][inverse]
        total = np.concatenate([[0], np.cumsum(size)])
        ids = self.flat[np.arange(total[-1]) + np.repeat(at - total[:-1], size)] if total[-1] else self.flat[:0]
        bounds = total[np.searchsorted(starts, offsets)]
        if unknown.any():
            view = data.tobytes()
            parts = []
            for k in range(len(offsets) - 1):
                own = ids[bounds[k] : bounds[k + 1]]
                if unknown[k]:
                    text = view[offsets[k] : offsets[k + 1]].decode()
                    own = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=np.int32)
                parts.append(own)
            ids = np.concatenate(parts)
            bounds = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        return ids, bounds

    def encode(self, col: pa.Array | pa.ChunkedArray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(index of the first row, ids, row bounds in them) for slices of the column, in order."""
        for row, data, offsets in slices(col):
            yield row, *self._slice(data, offsets)


class Decoder:
    """The bytes of ids: vocabulary strings mapped back by the byte table."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        back = {c: b for b, c in byte_to_char().items()}
        words = sorted(tokenizer.get_vocab(with_added_tokens=True).items(), key=lambda x: x[1])
        special = {i: t.content for i, t in tokenizer.get_added_tokens_decoder().items()}
        self.bytes = [b""] * (words[-1][1] + 1)
        for word, i in words:
            self.bytes[i] = special[i].encode() if i in special else bytes(back[c] for c in word)
        self.length = np.fromiter(map(len, self.bytes), dtype=np.int64, count=len(self.bytes))
        self.digits = [str(i).encode() for i in range(len(self.bytes))]

    def decode(self, ids: np.ndarray) -> bytes:
        """Tokens may end inside a character; only their whole sequence is UTF-8."""
        return b"".join(map(self.bytes.__getitem__, ids.tolist()))

    def offsets(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of each token in code points of its row's decoded text; bounds: the rows' places in ids.

        A token that starts or ends inside a character covers that whole character, so
        neighbours can share one.
        """
        data = np.frombuffer(self.decode(ids), dtype=np.uint8)
        ends = np.cumsum(self.length[ids])
        starts = ends - self.length[ids]
        leads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        inside = np.zeros(len(data) + 1, dtype=np.int64)
        inside[:-1] = (data & 0xC0) == 0x80
        base = np.repeat(leads[np.concatenate([[0], ends])[bounds[:-1]]], np.diff(bounds))
        return leads[starts] - inside[starts] - base, leads[ends] - base


_encoders: dict[tuple[str, bool], Encoder] = {}
_decoders: dict[str, Decoder] = {}


def encoder(path: str, special: bool = False) -> Encoder:
    """One for each worker process and file, so that its cache serves all its tasks."""
    if (path, special) not in _encoders:
        _encoders[path, special] = Encoder(path, special)
    return _encoders[path, special]


def decoder(path: str) -> Decoder:
    if path not in _decoders:
        _decoders[path] = Decoder(path)
    return _decoders[path]
