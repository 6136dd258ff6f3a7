"""Features that the classifiers read from bytes, batch by batch."""

from __future__ import annotations

import zlib

import numpy as np

#: Upper-case letters to lower case and ASCII characters outside letters and digits to spaces.
_PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Entries of a worker's memo of word hashes; it starts anew beyond them.
MEMO = 500_000


def _hash(word: bytes) -> int:
    return (zlib.crc32(word) << 32) | zlib.crc32(word, 0x9E3779B9)


class WordHashes(dict):
    """Numbers the words that a worker meets and keeps the hashes of each: of the word, and of its first 4 and first 6 bytes."""

    def __init__(self):
        self.table = np.zeros((MEMO, 3), np.uint64)

    def __missing__(self, word: bytes) -> int:
        i = self[word] = len(self)
        self.table[i] = _hash(word), _hash(word[:4] + b"*"), _hash(word[:6] + b"*")
        return i

    def of(self, text: str) -> np.ndarray:
        """Rows of hashes of the lower-cased words of letters and digits."""
        ws = text.encode().translate(_PLAIN).split()
        if len(self) + len(ws) > MEMO:
            self.clear()
            if len(ws) > MEMO:
                return np.array([(_hash(w), _hash(w[:4] + b"*"), _hash(w[:6] + b"*")) for w in ws], np.uint64)
        return self.table[np.fromiter(map(self.__getitem__, ws), np.int64, len(ws))]


def mix(h: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finaliser, so that the low bits of sums of hashes may be used."""
    h = h + np.uint64((seed * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def sigmoid(z: float) -> float:
    return float(1.0 / (1.0 + np.exp(-np.clip(z, -35.0, 35.0))))
