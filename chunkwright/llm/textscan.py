"""Words and their hashes of many texts at once, in numpy.

A word is a longest run of ASCII letters and digits and of characters beyond ASCII, after lower-casing; the ranges
U+0080-00BF, U+2000-207F and U+3000-303F (signs and spaces) separate words as other ASCII does. A null text has no words.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: The same definition as a regular expression over lower-cased text (RE2 and Java).
WORD_RE = r"[0-9a-z\x{c0}-\x{1fff}\x{2080}-\x{2fff}\x{3040}-\x{10ffff}]+"

_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)
_A, _B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_SEED = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * _A
    x = (x ^ (x >> np.uint64(27))) * _B
    return x ^ (x >> np.uint64(31))


@dataclass
class Words:
    hashes: np.ndarray  # uint64, one a word
    starts: np.ndarray  # byte positions in data
    ends: np.ndarray
    ptr: np.ndarray  # words of text k: ptr[k] .. ptr[k + 1]
    data: np.ndarray  # lower-cased bytes


def text_bytes(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Bytes with 8 zeros after them, and where each text begins and ends."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    if lower:
        texts = pc.utf8_lower(texts)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    out = np.zeros(int(at[-1] - at[0]) + 8, np.uint8)
    out[:-8] = raw[at[0] : at[-1]]
    return out, at - at[0]


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes; data ends in 8 spare bytes."""
    length = ends - starts
    h = mix(length.astype(np.uint64) + _SEED)
    if not len(starts):
        return h
    view = np.ndarray((len(data) - 7,), "<u8", buffer=data, strides=(1,))
    h = mix(h ^ (view[starts] & _MASK[np.minimum(length, 8)]))
    more = np.flatnonzero(length > 8)
    step = 8
    while len(more):
        left = length[more] - step
        h[more] = mix((h[more] + _SEED) ^ (view[starts[more] + step] & _MASK[np.minimum(left, 8)]))
        step += 8
        more = more[left > 8]
    return h


def equal_spans(data: np.ndarray, a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Whether the spans that begin at a and at b have the same bytes; data ends in 8 spare bytes."""
    same = size_a == size_b
    if not len(a):
        return same
    view = np.ndarray((len(data) - 7,), "<u8", buffer=data, strides=(1,))
    more, step = np.flatnonzero(same & (size_a > 0) & (a != b)), 0
    while len(more):
        left = size_a[more] - step
        same[more] &= (view[a[more] + step] ^ view[b[more] + step]) & _MASK[np.minimum(left, 8)] == 0
        step += 8
        more = more[(left > 8) & same[more]]
    return same


def scan_words(texts: pa.Array) -> Words:
    data, at = text_bytes(texts, lower=True)
    b = data[:-8]
    is_word = _WORD[b]
    for lead, seconds, width in ((0xC2, None, 2), (0xE2, (0x80, 0x81), 3), (0xE3, (0x80,), 3)):
        k = np.flatnonzero(b == lead)
        if len(k):
            if seconds is not None:
                k = k[np.isin(data[k + 1], seconds)]
            for i in range(width):
                is_word[k + i] = False
    n = len(b)
    before = np.zeros(n, bool)
    before[1:] = is_word[:-1]
    first = at[:-1][at[:-1] < n]
    before[first] = False
    starts = np.flatnonzero(is_word & ~before)
    after = np.zeros(n, bool)
    after[:-1] = is_word[1:]
    last = at[1:] - 1
    after[last[last >= 0]] = False
    ends = np.flatnonzero(is_word & ~after) + 1
    return Words(hash_spans(data, starts, ends), starts, ends, np.searchsorted(starts, at), data)


_MULT = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9), np.uint64(0x27D4EB2F165667C5), np.uint64(0x85EBCA77C2B2AE63)]


def ngrams(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of the n words that begin at each word (of those left, near the end)."""
    out = h * _MULT[0]
    for k in range(1, n):
        out[: len(h) - k] += h[k:] * _MULT[k % 5] + np.uint64(k)
        out[: len(h) - k] ^= out[: len(h) - k] >> np.uint64(29)
    return mix(out)
