"""Vectorised word splitting and hashing of whole texts in numpy.

A batch of texts is laid out as one byte buffer in which every separator byte
is a space.  Word limits come from one comparison of neighbouring bytes; word
hashes come from one running sum, so no Python loop runs over words or
characters.  The hash of a word is the polynomial ``sum(byte[j] * B**j)``
modulo 2**64, mixed by a finaliser; it depends on the word alone, so all
executors and all reruns agree.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_LOWER = {c: c + 32 for c in range(65, 91)}

#: Word characters of the contamination and shingle rules: ASCII letters and
#: digits and everything outside ASCII.
ALNUM = bytes(
    _LOWER.get(c, c) if (48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 or c >= 128) else 32
    for c in range(256)
)
#: Words are what stands between ASCII white space; A-Z are lower-cased.
SPACED = bytes(32 if (9 <= c <= 13 or c == 32) else _LOWER.get(c, c) for c in range(256))

_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverses
    if len(_powers) < n:
        size = 1 << (n - 1).bit_length()
        for name, base in (("_powers", _BASE), ("_inverses", _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            globals()[name] = np.multiply.accumulate(steps)
    return _powers[:n], _inverses[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: neighbouring inputs give unrelated outputs."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def as_bytes(text: str | None) -> bytes:
    """UTF-8 of a text; null counts as empty."""
    return (text or "").encode("utf-8", "surrogatepass")


def word_hashes(texts: Iterable[str | None], table: bytes = ALNUM) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets): the words of text i are ``hashes[offsets[i]:offsets[i + 1]]``."""
    parts = [as_bytes(t) for t in texts]
    lengths = np.fromiter((len(p) + 1 for p in parts), np.int64, len(parts))
    buffer = np.frombuffer((b" ".join(parts) + b" ").translate(table), np.uint8)
    if not len(parts):
        return np.empty(0, np.uint64), np.zeros(1, np.int64)
    inside = np.empty(len(buffer) + 1, bool)
    inside[0] = False
    np.not_equal(buffer, 32, out=inside[1:])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    powers, inverses = _power_tables(len(buffer))
    sums = np.empty(len(buffer) + 1, np.uint64)
    sums[0] = 0
    np.cumsum((buffer.astype(np.uint64) + np.uint64(1)) * powers, out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * inverses[starts])
    text_ends = np.cumsum(lengths)
    offsets = np.concatenate([[0], np.searchsorted(starts, text_ends, "left")])
    return hashes, offsets


def chunks(texts: list[str | None], most: int = 1 << 20) -> Iterator[slice]:
    """Slices of a batch with about ``most`` characters each; a longer text stands alone."""
    begin = size = 0
    for i, t in enumerate(texts):
        n = len(t or "") + 1
        if i > begin and size + n > most:
            yield slice(begin, i)
            begin, size = i, 0
        size += n
    if begin < len(texts):
        yield slice(begin, len(texts))


def shingle_hashes(words: np.ndarray, size: int = 5) -> np.ndarray:
    """Distinct hashes of the runs of ``size`` words, sorted; a shorter text that
    has a word gives one shingle of all its words, no words give none."""
    n = len(words)
    if not n:
        return words
    width = min(size, n)
    total = np.zeros(n - width + 1, np.uint64)
    for j in range(width):
        total = total * _BASE + words[j : n - width + 1 + j]
    return np.unique(mix(total + np.uint64(width)))
