"""Words of texts and hashes of word runs, for choosing candidates; nothing is decided by these hashes.

Words are the runs of bytes that are not ASCII white space. Each different word is hashed once by XXH3; a run's hash is a
polynomial over its words' hashes, as a difference of running sums (modulo 2**64, with an odd base, which has an inverse
there). Equal runs have equal hashes; runs of equal hashes must be told apart by their words."""

from __future__ import annotations

import numpy as np
import xxhash

#: Bytes of texts that are worked on at once, and different words that a worker keeps hashes of before it starts anew.
SLICE, CACHE_WORDS = 1 << 20, 100_000
#: Longer words are hashed each time.
CACHE_BYTES = 64
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_BASE = 0x9E3779B97F4A7C15
_powers: list[tuple[np.ndarray, np.ndarray]] = []


class WordHashes(dict):
    """word -> its hash, bounded."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word, 20)
        if len(word) <= CACHE_BYTES:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = value
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * _M1
    h = (h ^ (h >> np.uint64(33))) * _M2
    return h ^ (h >> np.uint64(33))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n - 1 of the base and of its inverse."""
    if not _powers or len(_powers[0][0]) < n:
        size = 1 << max(12, int(n - 1).bit_length())
        out = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            out.append(np.multiply.accumulate(steps))
        if size > 4 * SLICE:  # for one very long text only
            return out[0], out[1]
        _powers[:] = [(out[0], out[1])]
    return _powers[0]


def run_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of words[i : i + size] for each i; the runs of one flat array may reach over the ends of texts."""
    if len(words) < size:
        return np.zeros(0, np.uint64)
    up, down = _power(len(words))
    sums, k = np.zeros(len(words) + 1, np.uint64), len(words) - size + 1
    np.cumsum(words * up[: len(words)], out=sums[1:])
    return mix((sums[size:] - sums[:k]) * down[:k])


def slices(at: np.ndarray, most: int = SLICE) -> list[tuple[int, int]]:
    """Ranges of texts of about ``most`` bytes together; at: where each text starts, and the end."""
    out, k, n = [], 0, len(at) - 1
    while k < n:
        to = max(k + 1, int(np.searchsorted(at, at[k] + most, side="right")) - 1)
        out.append((k, min(to, n)))
        k = out[-1][1]
    return out
