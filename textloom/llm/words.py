"""Words of whole texts as numpy arrays: UTF-8 bytes are classed, cut into words and hashed without a Python loop a word.

Word hashes are 64 bits; equal words have equal hashes, different ones (of any length) collide with a chance of about
2**-64 a pair.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Bytes worked on at once. A longer text is a chunk of its own and is cut at separators.
CHUNK = 1 << 19
try:
    _trim = ctypes.CDLL("libc.so.6").malloc_trim
except (OSError, AttributeError):  # no such C library here
    _trim = None
_MULTIPLIER = U64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = np.asarray(x, dtype=U64)
    x = (x ^ (x >> U64(33))) * U64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> U64(33))) * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


def _places(at: np.ndarray) -> np.ndarray:
    """An odd factor for each place in a word; no two places have a common pattern, however far apart."""
    return mix((at.astype(U64) + U64(1)) * U64(0xD1B54A32D192ED03)) | U64(1)


_BYTE = mix(np.arange(1, 257, dtype=U64) * _MULTIPLIER)
_PLACE = _places(np.arange(1 << 16))

#: Separators x20, x09-x0D.
SPACE = np.ones(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
#: Letters a-z (after lower-casing), digits, and all that is not ASCII.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
SAME = np.arange(256, dtype=np.uint8)
NEWLINE = np.ones(256, dtype=bool)
NEWLINE[0x0A] = False


def buffer_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and where each begins (and the last ends); null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, "")
    wide = pa.types.is_large_string(texts.type)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    body = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return body, at - at[0]


@dataclass
class Words:
    """Words of some texts: hash, first byte, end, and number of the text; at: where each text begins in data."""

    data: np.ndarray
    at: np.ndarray
    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray

    @property
    def texts(self) -> int:
        return len(self.at) - 1

    def counts(self) -> np.ndarray:
        return np.bincount(self.doc, minlength=self.texts)

    def firsts(self) -> np.ndarray:
        """Where each text's words begin in the arrays (and the last's end)."""
        return np.concatenate([[0], np.cumsum(self.counts())])


def _segment(body: np.ndarray, edges: np.ndarray, keep: np.ndarray, base: int, hashed: bool):
    inside = keep[body]
    before = np.empty(len(body), dtype=bool)
    before[0], before[1:] = False, inside[:-1]
    before[edges] = False
    first = inside & ~before
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, U64), starts, starts
    after = np.empty(len(body), dtype=bool)
    after[-1], after[:-1] = False, inside[1:] & ~first[1:]
    ends = np.flatnonzero(inside & ~after) + 1
    if not hashed:
        return np.zeros(0, U64), starts + base, ends + base
    run = np.diff(np.append(starts, len(body)))
    place = np.concatenate([np.zeros(starts[0], np.int64), np.arange(starts[0], len(body)) - np.repeat(starts, run)])
    value = _BYTE[body] * (_PLACE[place] if place.max() < len(_PLACE) else _places(place))
    value[~inside] = 0
    return mix(np.add.reduceat(value, starts) + (ends - starts).astype(U64)), starts + base, ends + base


def split(data: np.ndarray, at: np.ndarray, keep: np.ndarray = SPACE, to: np.ndarray = SAME, hashed: bool = True) -> Words:
    """Maximal runs of bytes with keep (after mapping by to). No run crosses a text's edge."""
    if to is not SAME:
        data = to[data]
    parts, low = [], 0
    while low < len(data):
        high = min(len(data), low + CHUNK)
        while high < len(data) and keep[data[high]]:  # a word stays whole
            step = np.flatnonzero(~keep[data[high : high + 65536]])
            high = high + int(step[0]) if len(step) else min(len(data), high + 65536)
        inner = at[np.searchsorted(at, low) : np.searchsorted(at, high)] - low
        parts.append(_segment(data[low:high], inner, keep, low, hashed))
        low = high
    if not parts:
        none = np.zeros(0, np.int64)
        return Words(data, at, np.zeros(0, U64), none, none, none)
    hashes, starts, ends = (np.concatenate(x) for x in zip(*parts, strict=True))
    return Words(data, at, hashes, starts, ends, np.searchsorted(at, starts, side="right") - 1)


def chunks(texts: pa.Array, most: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of texts with about most bytes; a longer text comes alone."""
    data, at = buffer_of(texts)
    low, n = 0, len(at) - 1
    while low < n:
        high = max(low + 1, int(np.searchsorted(at, at[low] + most, side="right")) - 1)
        yield low, high, data[at[low] : at[high]], at[low : high + 1] - at[low]
        low = high
    trim()


def trim() -> None:
    """Gives memory that a Python worker no longer uses back to the system, as workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


_powers: list[np.ndarray] = []


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 16)
        odd = 0x9E3779B97F4A7C15
        for x in (odd, pow(odd, -1, 1 << 64)):
            run = np.full(size, x, dtype=U64)
            run[0] = 1
            _powers.append(np.multiply.accumulate(run))
        _powers[:] = _powers[-2:]
    return _powers[0][:n], _powers[1][:n]


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash for each run of k neighbouring word hashes (across texts too: mask with same_text)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    up, down = _power(len(hashes))
    total = np.concatenate([np.zeros(1, U64), np.cumsum(hashes * up, dtype=U64)])
    return mix((total[k:] - total[:-k]) * down[:n] + U64(k))


def same_text(doc: np.ndarray, k: int) -> np.ndarray:
    """Whether each run of k words lies in one text."""
    return doc[: max(0, len(doc) - k + 1)] == doc[k - 1 :]
