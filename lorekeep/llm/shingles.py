"""Sets of hashed word shingles, a batch of texts at a time."""

from __future__ import annotations

import numpy as np

_P, _MIX1, _MIX2 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
_BYTES = np.random.default_rng(20240817).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_power = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def mix(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """Scrambles 64-bit numbers, each salt in a way of its own."""
    h = h + np.uint64((salt * _P + 0x1234567) % 2**64)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(_MIX1)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(_MIX2)
    return h ^ (h >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_power["up"]) < n:
        size = 1 << (n - 1).bit_length()
        for name, base in (("up", _P), ("down", pow(_P, -1, 2**64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _power[name] = np.cumprod(steps, dtype=np.uint64)
    return _power["up"][:n], _power["down"][:n]


def word_hashes(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words that stand in a buffer of bytes."""
    up, down = _powers(len(buffer))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(_BYTES[buffer] * up, dtype=np.uint64)])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64), 1)


class Stretches:
    """64-bit hashes of any stretches of a line of word hashes; each salt gives hashes of its own."""

    def __init__(self, words: np.ndarray, salt: int):
        up, self.down = _powers(max(1, len(words)))
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(words, 100 + salt) * up[: len(words)], dtype=np.uint64)])
        self.salt = salt

    def of(self, first: np.ndarray, after: np.ndarray) -> np.ndarray:
        return mix((self.sums[after] - self.sums[first]) * self.down[first] + (after - first).astype(np.uint64), 200 + self.salt)


def _joined(texts: list[bytes], k: int) -> list[np.ndarray]:
    buffer = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    space = _SPACE[buffer]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space]).view(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    words = word_hashes(buffer, starts, ends)
    begin = np.cumsum([0, *(len(t) + 1 for t in texts)])
    first = np.searchsorted(starts, begin)
    n = len(words)
    rolled = np.zeros(max(0, n - k + 1), np.uint64)
    for j in range(k):
        rolled = mix(rolled + words[j : n - k + 1 + j], 2 + j)
    out = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= k:
            out.append(np.unique(rolled[a : b - k + 1]))
        elif b > a:
            whole = np.array([b - a], np.uint64)
            for j in range(a, b):
                whole = mix(whole + words[j : j + 1], 99)
            out.append(whole)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def hashed_sets(texts: list[bytes | None], k: int, block: int = 1 << 18) -> list[np.ndarray]:
    """Per UTF-8 text the sorted distinct 64-bit hashes of its k-word shingles, A-Z lower-cased.

    Words are runs of other bytes than blanks (0x20, 0x09-0x0D).  A text of fewer words is one
    shingle; without words, or null, the set is empty.
    """
    out: list[np.ndarray] = []
    part: list[bytes] = []
    size = 0
    for t in texts:
        t = (t or b"").lower()
        if part and size + len(t) > block:
            out += _joined(part, k)
            part, size = [], 0
        part.append(t)
        size += len(t) + 1
    return out + (_joined(part, k) if part else [])
