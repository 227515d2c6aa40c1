"""Byte-level helpers shared by the text operators; they run inside tasks on slices of an Arrow batch.

Words are maximal runs of bytes other than space, tab, LF, VT, FF and CR. In UTF-8 those six bytes never
occur inside a character, so splitting bytes and splitting characters give the same words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACES = b" \t\n\x0b\x0c\r"
U64 = np.uint64
_STEP = U64(0x9E3779B97F4A7C15)


def is_space() -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(SPACES)] = True
    return table


@lru_cache(maxsize=4)
def byte_codes(lower: bool = False, seed: int = 1) -> np.ndarray:
    """A random odd 64-bit code for each byte; with lower, A-Z get the codes of a-z."""
    codes = np.random.default_rng(seed).integers(0, 2**63, 256, dtype=U64) * U64(2) + U64(1)
    if lower:
        codes[65:91] = codes[97:123]
    return codes


@lru_cache(maxsize=1)
def _grown(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = U64(pow(int(_STEP), -1, 2**64))
    return np.cumprod(np.full(n, _STEP)), np.cumprod(np.full(n, inverse))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd step modulo 2**64, and of its inverse, for n positions."""
    size = 1 << max(20, int(n).bit_length())
    up, down = _grown(size)
    return up[:n], down[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every input bit over the whole 64-bit word (a bijection)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def slices(batch: pa.RecordBatch, column: str, max_bytes: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """Consecutive rows whose texts hold at most max_bytes together (or one longer text): memory stays bounded."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends, start = np.cumsum(sizes, dtype=np.int64), 0
    while start < len(sizes):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + max_bytes, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts in a row, and where each text begins and ends; null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


@dataclass
class Segments:
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray

    def per_doc(self, n_docs: int) -> np.ndarray:
        """Index of each text's first segment; one more entry ends the last."""
        return np.searchsorted(self.doc, np.arange(n_docs + 1))


def segments(data: np.ndarray, at: np.ndarray, separator: np.ndarray) -> Segments:
    """Maximal runs of bytes that are not separators; a run never passes from one text into the next."""
    n = len(data)
    if not n:
        empty = np.zeros(0, np.int64)
        return Segments(empty, empty, empty)
    inside = ~separator[data]
    opens = np.empty(n, bool)
    opens[0], opens[1:] = True, ~inside[:-1]
    opens[at[:-1][at[:-1] < n]] = True
    closes = np.empty(n, bool)
    closes[-1], closes[:-1] = True, ~inside[1:]
    closes[at[1:][at[1:] > 0] - 1] = True
    start = np.flatnonzero(inside & opens)
    end = np.flatnonzero(inside & closes) + 1
    return Segments(start, end, np.searchsorted(at, start, side="right") - 1)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes, from one running sum: equal bytes give equal hashes anywhere."""
    up, down = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, U64)
    np.cumsum(codes[data] * up[: len(data)], out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(U64))


def window_hashes(word: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words that lie in one text, and the index of each run's first word."""
    n = len(word) - k + 1
    if n <= 0:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    out = word[:n].copy()
    for i in range(1, k):
        out *= _STEP
        out += word[i : i + n]
    first = np.flatnonzero(doc[:n] == doc[k - 1 :])
    return mix(out[first]), first


def repeated(key: np.ndarray) -> np.ndarray:
    """True where a key occurs more than once."""
    if not len(key):
        return np.zeros(0, bool)
    order = np.argsort(key)
    ranked = key[order]
    same = ranked[1:] == ranked[:-1]
    hit = np.zeros(len(key), bool)
    hit[1:] |= same
    hit[:-1] |= same
    out = np.empty(len(key), bool)
    out[order] = hit
    return out


def covered(first: np.ndarray, k: int, n_words: int) -> np.ndarray:
    """True for each word that lies in one of the runs of k words starting at first."""
    delta = np.bincount(first, minlength=n_words + 1) - np.bincount(first + k, minlength=n_words + 1)
    return np.cumsum(delta[:n_words]) > 0


def sums_per_doc(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sum of values (one per byte or word) between consecutive offsets."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[at[1:]] - total[at[:-1]]
