"""Vectorised word and word n-gram hashes over Arrow string columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_P = np.uint64(0x9E3779B97F4A7C15)
_P_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_Q = 0xD6E8FEB86659FD93
#: Bytes of text that one round of array operations takes; a longer text is one round of its own.
ROUND_BYTES = (1 << 20) - 64

_pow = np.ones(1, np.uint64)
_inv = np.ones(1, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _pow, _inv
    if len(_pow) < n:
        size = 1 << (n - 1).bit_length()
        _pow, _inv = (np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(size - 1, x, np.uint64)))) for x in (_P, _P_INVERSE))
    return _pow, _inv


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose output bits all depend on all input bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def byte_table() -> np.ndarray:
    """A random 64-bit value for each byte; A-Z have those of a-z."""
    table = mixed(np.arange(1, 257, dtype=np.uint64) * _P)
    table[ord("A") : ord("Z") + 1] = table[ord("a") : ord("z") + 1]
    return table


def alphanumeric_mask() -> np.ndarray:
    """Bytes of words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after A-Z are lower-cased."""
    mask = np.zeros(256, bool)
    mask[0x30:0x3A] = mask[0x41:0x5B] = mask[0x61:0x7B] = mask[0x80:] = True
    return mask


def nonspace_mask() -> np.ndarray:
    """Bytes of words ``[^\\x20\\x09-\\x0D]+``."""
    mask = np.ones(256, bool)
    mask[0x20] = False
    mask[0x09:0x0E] = False
    return mask


_TABLE = byte_table()


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null has no bytes."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), at


def word_rounds(texts: pa.Array, mask: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, word offsets of these rows, word hashes), a bounded number of bytes at a time."""
    data, at = text_bytes(texts)
    low, rows = 0, len(texts)
    while low < rows:
        high = max(low + 1, int(np.searchsorted(at, at[low] + ROUND_BYTES, side="right")) - 1)
        yield (low, high, *_words(data[at[low] : at[high]], at[low : high + 1] - at[low], mask))
        low = high


def _words(data: np.ndarray, at: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(data)
    if not n:
        return np.zeros(len(at), np.int64), np.zeros(0, np.uint64)
    inside = mask[data]
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    edge[n] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    start = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    power, inverse = _powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_TABLE[data] * power[:n], out=total[1:])
    hashes = mixed((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64) * _P)
    return np.searchsorted(start, at), hashes


def ngrams(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` words, across rows too: the caller keeps those within a row."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.full(n, np.uint64(k))
    factor = 1
    for j in range(k):
        total += words[j : j + n] * np.uint64(factor)
        factor = factor * _Q % (1 << 64)
    return mixed(total)
