"""Sets of word shingles as sorted 64-bit hashes, by array operations on bytes."""

from __future__ import annotations

import numpy as np

_M = (1 << 64) - 1


def _stream(n: int, seed: int) -> np.ndarray:
    """Fixed pseudo-random 64-bit numbers, by the splitmix64 rule."""
    out, x = [], seed
    for _ in range(n):
        x = (x + 0x9E3779B97F4A7C15) & _M
        z = x
        z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & _M
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & _M
        out.append(z ^ (z >> 31))
    return np.array(out, np.uint64)


_BYTE = _stream(256, 1)
for _c in range(65, 91):  # A-Z count as a-z
    _BYTE[_c] = _BYTE[_c + 32]
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BASE = int(_stream(1, 2)[0]) | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_PLACE = _stream(16, 3) | np.uint64(1)
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least n."""
    while len(_POWERS[0]) < n:
        for i, b in enumerate((_BASE, _INVERSE)):
            p = _POWERS[i]
            _POWERS[i] = np.concatenate([p, p * np.uint64(pow(b, len(p), 1 << 64))])
    return _POWERS[0], _POWERS[1]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def word_hashes(text: bytes | memoryview) -> np.ndarray:
    """A hash of each word, A-Z lower-cased: words are runs without white space."""
    raw = np.frombuffer(text, np.uint8)
    if not len(raw):
        return np.zeros(0, np.uint64)
    edge = np.diff(np.concatenate([[True], _SPACE[raw], [True]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    up, down = _powers(len(raw))
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[raw] * up[: len(raw)], out=sums[1:])
    # The sum over a word, brought to the same place whatever its start.
    return _mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def shingle_set(text: bytes | memoryview | None, width: int = 5) -> np.ndarray:
    """Distinct shingles, ascending.  With fewer words than ``width``, all of
    them are one shingle; without words there is none."""
    words = word_hashes(text) if text is not None else np.zeros(0, np.uint64)
    n = len(words)
    if n == 0:
        return words
    w = min(n, width)
    out = np.full(n - w + 1, w, np.uint64)
    for i in range(w):
        out += words[i : n - w + 1 + i] * _PLACE[i]
    return np.unique(_mix(out))


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Elements that two ascending sets share."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())
