"""Word shingles of whole texts as sorted 64-bit hashes.

Words are runs of anything but ASCII white space with A-Z lowered. A text's set is its distinct runs of ``width``
words; a text of fewer words is one run; without words the set is empty.
"""

from __future__ import annotations

import numpy as np

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Bytes hashed at a time; bounds the memory that a text of any length takes.
CHUNK = 1 << 19


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def series(seed: int, n: int) -> np.ndarray:
    """``n`` mixed 64-bit numbers, the same under every version of the libraries: those of the steps of a counter."""
    return _mix(np.uint64(seed) + np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


_PLACE, _ORDER = series(77, 4096) | np.uint64(1), series(78, 16) | np.uint64(1)


def _hash_words(data: bytes) -> np.ndarray:
    a = np.frombuffer(data, np.uint8)
    word = ~_SPACE[a]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], word, [False]]).view(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    if not starts.size:
        return np.empty(0, np.uint64)
    place = np.arange(a.size) - np.repeat(starts, np.diff(np.concatenate([[0], starts[1:], [a.size]])))
    value = (a.astype(np.uint64) + np.uint64(1)) * _PLACE[place & 4095] * (np.uint64(1) + (place >> 12).astype(np.uint64) * np.uint64(2)) * word
    return _mix(np.add.reduceat(value, starts) + (ends - starts).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def word_hashes(text: str) -> np.ndarray:
    data = text.encode("utf-8", "surrogatepass").translate(_LOWER)
    if len(data) <= CHUNK:
        return _hash_words(data)
    out, at = [], 0
    while at < len(data):
        to = min(len(data), at + CHUNK)
        while to < len(data) and data[to] not in b" \t\n\v\f\r":
            to += 1
        out.append(_hash_words(data[at:to]))
        at = to
    return np.concatenate(out)


def shingles(text: str | None, width: int = 5) -> np.ndarray:
    """Sorted distinct hashes."""
    w = word_hashes(text) if text else np.empty(0, np.uint64)
    if not w.size:
        return w
    n = min(width, w.size)
    h = np.zeros(w.size - n + 1, np.uint64)
    for j in range(n):
        h += w[j : j + h.size] * _ORDER[j]
    return np.unique(_mix(h + np.uint64(n)))
