"""Word shingles of whole texts as 64-bit hashes, many texts at a time with numpy.

Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z. The separators and the letters are
ASCII, so the work is done on UTF-8 bytes: a word's hash is a polynomial in its bytes, read off
one running sum over the buffer, and a shingle's hash mixes the hashes of its words in order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

WORDS = 5

_RNG = np.random.default_rng(20240229)
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_PLACE = _RNG.integers(0, 1 << 63, 2 * WORDS, dtype=np.uint64) | np.uint64(1)

_LETTER = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64)
_LETTER[ord("A") : ord("Z") + 1] = _LETTER[ord("a") : ord("z") + 1]
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LETTER[_SPACE] = 0

_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """``base**i`` modulo 2**64 for i < n, kept per process."""
    if base not in _powers or len(_powers[base]) < n:
        steps = np.full(max(n, 1 << 16), base, np.uint64)
        steps[0] = 1
        _powers[base] = np.multiply.accumulate(steps)
    return _powers[base][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts one after the other, and where each begins; null counts as empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if data is None or at[-1] == at[0]:
        return np.empty(0, np.uint8), at - at[0]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word, and the index of each text's first word (one more at the end)."""
    data, at = text_bytes(texts)
    n = len(data)
    if not n:
        return np.empty(0, np.uint64), np.zeros(len(at), np.int64)
    word = ~_SPACE[data]
    cut = np.zeros(n + 1, bool)
    cut[at] = True
    first = word & cut[:n]
    first[1:] |= word[1:] & ~word[:-1]
    last = word & cut[1:]
    last[:-1] |= word[:-1] & ~word[1:]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    np.cumsum(_LETTER[data] * _power(_BASE, n), out=total[1:])
    hashes = (total[end] - total[start]) * _power(_BASE_INVERSE, n)[start]
    return mix(hashes), np.searchsorted(start, at)


def shingle_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """Per text the ascending distinct hashes of its shingles.

    A text with fewer than ``WORDS`` words has its whole word sequence as the one shingle; a
    text without words has none.
    """
    words, at = word_hashes(texts)
    n = max(len(words) - WORDS + 1, 0)
    full = np.full(n, WORDS, np.uint64)
    for k in range(WORDS):
        full += words[k : k + n] * _PLACE[k]
    full = mix(full)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= WORDS:
            own = np.sort(full[a : b - WORDS + 1])
            fresh = np.empty(len(own), bool)
            fresh[0] = True
            np.not_equal(own[1:], own[:-1], out=fresh[1:])
            yield own[fresh]
        elif b > a:
            short = np.full(1, b - a, np.uint64)
            for k in range(b - a):
                short += words[a + k : a + k + 1] * _PLACE[WORDS + k]
            yield mix(short)
        else:
            yield np.empty(0, np.uint64)
