"""Words of whole text columns as flat NumPy arrays, for Arrow functions inside tasks.

A batch is cut into slices of about ``SLICE_BYTES`` of text, so the arrays made for a
slice stay small; one longer document is a slice of its own.  Words are found on UTF-8
bytes: every separator of the classes below is ASCII, so byte and code point
boundaries agree.  A null text has no words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

SLICE_BYTES = 1 << 18
ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # on lower-cased text
SPACED = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ALNUM = np.ones(256, dtype=bool)
_ALNUM[:128] = False
_ALNUM[48:58] = _ALNUM[97:123] = True
_SPACED = np.ones(256, dtype=bool)
_SPACED[[32, 9, 10, 11, 12, 13]] = False
CLASSES = {ALNUM: _ALNUM, SPACED: _SPACED}

_STEP = 0x9E3779B97F4A7C15
_BASE = 0xD6E8FEB86659FD93
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit integers that spreads every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def numbered(count: int, seed: int = 0) -> np.ndarray:
    """``count`` fixed 64-bit values made by rule."""
    return mix((np.arange(1, count + 1, dtype=np.uint64) + np.uint64(seed << 20)) * np.uint64(_STEP))


_BYTE_VALUES = numbered(256)
_powers = np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)


def _powers_to(count: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) <= count:
        size = max(count + 1, SLICE_BYTES + 1)
        made = []
        for base in (_BASE, _INVERSE):
            factors = np.full(size, base, dtype=np.uint64)
            factors[0] = 1
            made.append(np.multiply.accumulate(factors))
        _powers = made[0], made[1]
    return _powers


@dataclass
class Words:
    """The words of some rows: byte spans, and where each row's words begin."""

    flat: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    rows: np.ndarray  # row i has words rows[i]..rows[i+1]
    offsets: np.ndarray  # row i's text is flat[offsets[i]: offsets[i + 1]]

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word; equal words have equal hashes in every batch."""
        return mix(self.spans(self.prefix_sums(), self.starts, self.ends))

    def prefix_sums(self) -> np.ndarray:
        """Sums over the bytes before each place, from which ``spans`` makes the value of any span."""
        up, _ = _powers_to(len(self.flat))
        sums = np.zeros(len(self.flat) + 1, dtype=np.uint64)
        np.cumsum(_BYTE_VALUES[self.flat] * up[: len(self.flat)], out=sums[1:])
        return sums

    def spans(self, sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A 64-bit value of the bytes of each span, not yet mixed; equal bytes give equal values wherever they stand."""
        return (sums[ends] - sums[starts]) * _powers_to(len(self.flat))[1][starts]

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.rows) - 1), np.diff(self.rows))

    def text(self, i: int) -> bytes:
        return self.flat[self.starts[i]: self.ends[i]].tobytes()


def find(flat: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> Words:
    """Maximal runs of bytes of ``kind`` inside each row ``offsets[i]..offsets[i+1]``."""
    inside = kind[flat]
    before, after = np.zeros_like(inside), np.zeros_like(inside)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    cuts = offsets[(offsets > 0) & (offsets < len(flat))]
    before[cuts], after[cuts - 1] = False, False
    starts = np.flatnonzero(inside & ~before)
    return Words(flat, starts, np.flatnonzero(inside & ~after) + 1, np.searchsorted(starts, offsets), offsets)


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Bytes and row offsets of consecutive rows, ``most`` bytes or one row at a time."""
    if texts.null_count:
        texts = texts.fill_null("")
    if not len(texts):
        return
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, place, data = texts.buffers()
    offsets = np.frombuffer(place, dtype=np.int64 if wide else np.int32)[texts.offset: texts.offset + len(texts) + 1]
    offsets = offsets.astype(np.int64)
    flat = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    first = 0
    while first < len(texts):
        last = int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1
        last = min(max(last, first + 1), len(texts))
        yield flat[offsets[first]: offsets[last]], offsets[first: last + 1] - offsets[first]
        first = last


def word_slices(texts: pa.Array, pattern: str, *, lower: bool = True, most: int = SLICE_BYTES) -> Iterator[Words]:
    """``Words`` of consecutive rows of a text column."""
    for flat, offsets in slices(texts, most):
        yield find(_LOWER[flat] if lower else flat, offsets, CLASSES[pattern])


def runs(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` consecutive words; rows are not looked at."""
    count = len(hashes) - width + 1
    if count <= 0:
        return np.zeros(0, dtype=np.uint64)
    total = np.zeros(count, dtype=np.uint64)
    for k, factor in enumerate(numbered(width, seed=7)):
        total += hashes[k: k + count] * (factor | np.uint64(1))
    return mix(total + np.uint64(width))


def run_starts(rows: np.ndarray, width: int) -> np.ndarray:
    """Indexes of the words at which a run of ``width`` words of one row starts."""
    left = np.repeat(rows[1:], np.diff(rows)) - np.arange(rows[-1])
    return np.flatnonzero(left >= width)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def word_array(text: Column, pattern: str) -> Column:
    """The words as an array, by Spark's own functions; none for a null text."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.array().cast("array<string>"))
