"""Words of many texts at once, as numpy arrays of 64-bit hashes.

Texts are laid end to end as bytes. A word's hash is a polynomial over its bytes modulo 2**64, taken
from prefix sums, so a batch costs a few vector passes and no Python work per word. Hashes depend on
constants only: every task, attempt and run gives the same ones.
"""

from __future__ import annotations

import numpy as np

_rng = np.random.default_rng(20240917)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = _BYTE.copy()
_LOWER[65:91] = _BYTE[97:123]
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_STEP = 0xD6E8FEB86659FD93 | 1
_KEPT = 1 << 20
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; the longest array so far is kept, up to a million numbers."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16) if n > _KEPT else 1 << (max(n, 1 << 16) - 1).bit_length(), base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if len(have) <= _KEPT:
            _powers[base] = have
    return have[:n]


def _inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (a bijection)."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Words:
    """The words of a list of texts.

    ``hashes`` has a hash for each word, ``starts``/``ends`` its byte range in ``data``, and the words
    of text i are ``first[i]:first[i + 1]``. With ``lower``, A-Z count as a-z. ``gaps`` tells the bytes between words, of which
    the space is one.
    """

    def __init__(self, texts: list[str], lower: bool = False, gaps: np.ndarray = _IS_SPACE):
        parts = [t.encode("utf-8", "surrogatepass") for t in texts]
        self.data = b" ".join(parts) + b" "
        sizes = np.fromiter((len(p) + 1 for p in parts), np.int64, len(parts))
        self.offsets = np.concatenate([[0], np.cumsum(sizes)])
        raw = np.frombuffer(self.data, np.uint8)
        self.raw = raw
        space = gaps[raw]
        edge = np.diff(space.view(np.int8), prepend=np.int8(1))
        self.starts = np.flatnonzero(edge == -1)
        self.ends = np.flatnonzero(edge == 1)
        if len(self.ends) and len(self.starts) and self.ends[0] < self.starts[0]:
            self.ends = self.ends[1:]
        self.first = np.searchsorted(self.starts, self.offsets)
        table = _LOWER if lower else _BYTE
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(table[raw] * powers(_BASE, len(raw)), out=sums[1:])
        body = (sums[self.ends] - sums[self.starts]) * powers(_inverse(_BASE), len(raw) + 1)[self.starts]
        self.hashes = mix(body ^ (self.ends - self.starts).astype(np.uint64))

    def doc_of_word(self) -> np.ndarray:
        """The text's index for each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of each run of ``size`` words that begins at a word, and whether the run stays in its text."""
        return windows(self.hashes, size), self.inside(size)

    def inside(self, size: int) -> np.ndarray:
        """Whether the run of ``size`` words beginning at each word stays in its text."""
        n = len(self.hashes)
        last = np.repeat(self.first[1:], np.diff(self.first))
        return np.arange(n) + size <= last


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` hashes from each position on (those past the end count as absent)."""
    n = len(hashes)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(hashes * powers(_STEP, n), out=sums[1:])
    ends = np.minimum(np.arange(n) + size, n)
    return mix((sums[ends] - sums[:n]) * powers(_inverse(_STEP), n)[:n] ^ np.uint64(size * 0x9E3779B1))
