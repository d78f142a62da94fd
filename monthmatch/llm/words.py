"""Words of many texts at once, as arrays.

A word is a run of ASCII letters and digits and of any characters beyond ASCII;
A to Z are lower-cased, nothing else is. All bytes of a character beyond ASCII
are 128 or more, so texts are read as bytes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

#: What each byte becomes: itself, its lower-case letter, or 0 between words.
_BYTES = np.zeros(256, dtype=np.uint8)
_BYTES[128:] = np.arange(128, 256)
for _c in b"0123456789abcdefghijklmnopqrstuvwxyz":
    _BYTES[_c] = _c
    if _c >= ord("a"):
        _BYTES[_c - 32] = _c

_VALUES = np.random.default_rng(11).integers(1, np.iinfo(np.uint64).max, 256, dtype=np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Longer words are hashed one by one.
_LONG = 48


def mixed(values: np.ndarray) -> np.ndarray:
    """64-bit numbers of which every bit depends on all bits of those given."""
    values = values ^ (values >> np.uint64(32))
    values = values * np.uint64(0xD6E8FEB86659FD93)
    values = values ^ (values >> np.uint64(29))
    values = values * np.uint64(0xA0761D6478BD642F)
    return values ^ (values >> np.uint64(32))


class Words:
    """The words of a column of texts; null is a text without words.

    ``first`` and ``last`` say where a word stands in ``data``, ``text`` in
    which text. Words of one text are consecutive and in order.
    """

    def __init__(self, texts: pa.Array):
        texts = texts.cast(pa.large_binary()).fill_null(b"")
        _, offsets, data = texts.buffers()
        ends = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = np.frombuffer(data, dtype=np.uint8)[ends[0] : ends[-1]] if data is not None else _BYTES[:0]
        #: Where each text begins in ``data``; one more for the end.
        self.ends = ends = ends - ends[0]
        self.texts = len(texts)
        self.data = _BYTES[raw]
        inside = np.zeros(len(raw) + 2, dtype=bool)
        inside[1:-1] = self.data != 0
        begins = inside[1:] & ~inside[:-1]
        stops = inside[:-1] & ~inside[1:]
        # A text that begins right behind another one begins a word of its own.
        joints = ends[1:-1]
        joints = joints[inside[joints] & inside[joints + 1]]
        begins[joints] = stops[joints] = True
        self.first = np.flatnonzero(begins)
        self.last = np.flatnonzero(stops)
        self.text = np.searchsorted(ends, self.first, side="right") - 1
        #: Where each text's words begin; one more for the end.
        self.starts = np.searchsorted(self.text, np.arange(self.texts + 1))

    def __len__(self) -> int:
        return len(self.first)

    def counts(self) -> np.ndarray:
        """The number of words of each text."""
        return np.diff(self.starts)

    def word(self, i: int) -> bytes:
        return self.data[self.first[i] : self.last[i]].tobytes()

    def joined(self, start: int, length: int) -> bytes:
        """Words separated by one space."""
        return b" ".join([self.word(i) for i in range(start, start + length)])

    def hashes(self) -> np.ndarray:
        """A number of 64 bits for each word, the same on every machine."""
        lengths = self.last - self.first
        order = np.argsort(-np.minimum(lengths, _LONG), kind="stable")
        first = self.first[order]
        falling = -lengths[order]
        out = np.zeros(len(order), dtype=np.uint64)
        for at in range(min(int(lengths.max(initial=0)), _LONG)):
            k = np.searchsorted(falling, -at, side="left")
            out[:k] = out[:k] * _STEP + _VALUES[self.data[first[:k] + at]]
        hashed = np.empty_like(out)
        hashed[order] = out
        for i in np.flatnonzero(lengths > _LONG):
            hashed[i] = int.from_bytes(hashlib.blake2b(self.word(i), digest_size=8).digest(), "little")
        return mixed(hashed + lengths.astype(np.uint64))


def runs(hashes: np.ndarray, length: int) -> np.ndarray:
    """A number for each run of so many consecutive words, at the place of its first word."""
    n = max(len(hashes) - length + 1, 0)
    out = np.full(n, length, dtype=np.uint64)
    for k in range(length):
        out = out * _STEP + hashes[k : k + n]
    return mixed(out)
