"""Word shingles of whole texts as sets of 64-bit hashes, a slice of a batch at a time.

Words are runs of bytes other than white space, A-Z lowered. A word's hash is a polynomial over random byte
values, taken from prefix sums; a shingle's is one over the hashes of its words.
"""

from __future__ import annotations

import functools
from typing import NamedTuple

import numpy as np
import pyarrow as pa

from vigilmesh.llm.common import mix, slices, text_bytes

WORDS = 5
#: Bytes of text that are hashed at once; bounds the work arrays.
SLICE = 400_000
_P, _Q = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95)

SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True


@functools.lru_cache(maxsize=1)
def _byte_values() -> np.ndarray:
    values = np.random.default_rng(20).integers(1, 2**63, 256, dtype=np.uint64)
    values[65:91] = values[97:123]
    return values


@functools.lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = np.uint64(pow(int(_P), -1, 2**64))
    up, down = np.full(n, _P, np.uint64), np.full(n, inverse, np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


class Words(NamedTuple):
    doc: np.ndarray  # row of the slice
    start: np.ndarray  # first byte, within the slice
    end: np.ndarray
    hash: np.ndarray


class Places(NamedTuple):
    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    total: np.ndarray
    down: np.ndarray

    def of(self, end: np.ndarray) -> np.ndarray:
        """Hash of the bytes from each word's start to the given ends, yet to be mixed. An end past the text counts as its end."""
        return (self.total[np.minimum(end, len(self.total) - 1)] - self.total[self.start]) * self.down[self.start]


#: Bytes outside words of letters and digits.
MARKS = np.zeros(256, bool)
MARKS[[*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True


def word_places(flat: np.ndarray, offsets: np.ndarray, letters_only: bool = False) -> Places:
    """Where the words of a slice of texts are: runs of other bytes than white space, or of letters, digits and non-ASCII."""
    n = len(flat)
    if not n:
        empty = np.zeros(0, np.int64)
        return Places(empty, empty, empty, np.zeros(1, np.uint64), np.ones(1, np.uint64))
    inside = ~(MARKS if letters_only else SPACES)[flat]
    border = np.zeros(n + 1, bool)
    border[offsets] = True
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    start = np.flatnonzero(inside & (~before | border[:-1]))
    end = np.flatnonzero(inside & (~after | border[1:])) + 1
    up, down = _powers(1 << int(n).bit_length())
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_byte_values()[flat] * up[:n], out=total[1:])
    return Places(np.searchsorted(offsets, start, "right") - 1, start, end, total, down)


def words(flat: np.ndarray, offsets: np.ndarray) -> Words:
    """All words of a slice of texts laid end to end."""
    places = word_places(flat, offsets)
    return Words(places.doc, places.start, places.end, mix(places.of(places.end)))


class Sets(NamedTuple):
    doc: np.ndarray  # row of the slice, ascending
    hash: np.ndarray  # distinct within a row, ascending


def shingle_sets(flat: np.ndarray, offsets: np.ndarray, size: int = WORDS) -> Sets:
    """Distinct shingles per row; a row with fewer words has its whole sequence as one, a row without words none."""
    w = words(flat, offsets)
    rows = len(offsets) - 1
    count = np.bincount(w.doc, minlength=rows)
    n = len(w.hash)
    docs, hashes = [], []
    if n >= size:
        value = np.zeros(n - size + 1, np.uint64)
        for k in range(size):
            value = value * _Q + w.hash[k : n - size + 1 + k]
        whole = w.doc[: n - size + 1] == w.doc[size - 1 :]
        docs.append(w.doc[: n - size + 1][whole])
        hashes.append(mix(value[whole]))
    first = np.concatenate([[0], np.cumsum(count)])
    for row in np.flatnonzero((count > 0) & (count < size)):
        value = np.uint64(count[row])
        for h in w.hash[first[row] : first[row + 1]]:
            value = mix(np.array([value * _Q + h]))[0]
        docs.append(np.array([row]))
        hashes.append(np.array([value]))
    doc = np.concatenate(docs) if docs else np.zeros(0, np.int64)
    value = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    fresh = np.ones(len(doc), bool)
    fresh[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    return Sets(doc[fresh], value[fresh])


def by_slice(column: pa.Array):
    """(first row, last row, sets) for runs of rows of a text column."""
    flat, offsets = text_bytes(column)
    for start, end in slices(np.diff(offsets), SLICE):
        part = offsets[start : end + 1]
        with np.errstate(over="ignore"):
            yield start, end, shingle_sets(flat[part[0] : part[-1]], part - part[0])
