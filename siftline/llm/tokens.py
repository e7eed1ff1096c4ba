"""Words of Arrow text columns as arrays of hashes, in numpy: whole batches at once, bounded memory."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Texts are tokenised in pieces of about this many bytes; a longer text is a piece of its own.
PIECE = 1 << 20
U = np.uint64
_P = 0x9E3779B97F4A7C15 | 1
_PINV = pow(_P, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, 2 * len(_powers[0]))
        for k, base in enumerate((_P, _PINV)):
            t = np.full(size, base, U)
            t[0] = 1
            _powers[k] = np.multiply.accumulate(t)
    return _powers[0][:n], _powers[1][:n]


def mix(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads them evenly."""
    h = h + U((0x9E3779B97F4A7C15 * (salt + 1)) & (2**64 - 1))
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def text_pieces(column: pa.Array, size: int = PIECE) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of consecutive rows of about `size` bytes; null is empty."""
    column = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    a = 0
    while a < len(column):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + size, "right")) - 1)
        yield a, raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


def word_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end) of each word in bytes, and the index of each row's first word."""
    word = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    before = np.concatenate(([False], word[:-1]))
    starts = np.flatnonzero(word & (~before | edge[:-1]))
    after = np.concatenate((word[1:], [False])) if len(raw) else word
    ends = np.flatnonzero(word & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def lower(raw: np.ndarray) -> np.ndarray:
    return raw + ((raw >= 65) & (raw <= 90)).astype(np.uint8) * np.uint8(32)


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span, by running sums of a polynomial."""
    up, down = _power_tables(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, U)
    np.cumsum((raw.astype(U) + U(1)) * up[: len(raw)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U))


def word_hashes(raw: np.ndarray, offsets: np.ndarray, fold: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, starts, ends, first word of each row); fold lower-cases A-Z."""
    starts, ends, rows = word_spans(raw, offsets)
    return span_hashes(lower(raw) if fold else raw, starts, ends), starts, ends, rows


_COMBINE = [U(pow(0xD6E8FEB86659FD93, k + 1, 1 << 64) | 1) for k in range(64)]


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive words of one row; the whole sequence as one, if it is shorter."""
    n = len(words)
    if n == 0:
        return words
    if n < k:
        return mix(np.array([sum(int(w) * int(c) for w, c in zip(words, _COMBINE, strict=False)) & (2**64 - 1)], U), n)
    return window_hashes(words, k)


def window_hashes(words: np.ndarray, k: int) -> np.ndarray:
    m = len(words) - k + 1
    if m <= 0:
        return words[:0]
    h = np.zeros(m, U)
    for j in range(k):
        h += words[j : j + m] * _COMBINE[j]
    return mix(h)
