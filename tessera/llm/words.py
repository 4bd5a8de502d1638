"""Words and word shingles as 64-bit hashes, one numpy array a document."""

from __future__ import annotations

import numpy as np
import xxhash

U64 = np.uint64
_MUL = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


class WordHashes(dict):
    """word (bytes) -> 64-bit hash; emptied when it holds `most` words, so memory stays bounded on any corpus."""

    def __init__(self, most: int = 400_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), U64, len(words))


def words_of(text: str | None) -> list[bytes]:
    """Maximal runs of [^\\x20\\x09-\\x0D] with A-Z lower-cased; bytes.split() and bytes.lower() know ASCII only."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that sums of word hashes become uniform again."""
    h = h ^ (h >> U64(30))
    h *= U64(_MUL[1])
    h ^= h >> U64(27)
    h *= U64(_MUL[2])
    h ^= h >> U64(31)
    return h


def shingles(hashes: np.ndarray, k: int = 5) -> np.ndarray:
    """Hash of each window of k words in order; of the whole sequence where it has fewer; none where it has none."""
    n = len(hashes)
    if n == 0:
        return hashes
    m = n - k + 1
    if m < 1:
        k, m = n, 1
    h = np.full(m, k, U64)
    for j in range(k):
        h *= U64(_MUL[0])
        h += hashes[j : j + m]
    return mixed(h)


def shingle_set(hashes: np.ndarray, k: int = 5) -> np.ndarray:
    """Sorted distinct shingles."""
    h = np.sort(shingles(hashes, k))
    return h[np.concatenate([[True], h[1:] != h[:-1]])] if len(h) else h


def signature(shingle_set_: np.ndarray) -> int:
    """A signed 64-bit name of a set of shingles: equal sets have equal names, whatever the order of their words."""
    return xxhash.xxh3_64_intdigest(shingle_set_.tobytes()) - (1 << 63)
