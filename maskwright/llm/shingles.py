"""Hashes of words and word shingles, and compact byte forms of integer arrays."""

from __future__ import annotations

from array import array
from functools import lru_cache

import numpy as np

from .common import keeps

#: Words whose hashes a Python worker keeps.
MEMO = 200_000
#: Odd multipliers of the shingle hash, one for each place.
PLACES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)


class WordHashes(dict):
    """word (bytes) to its 64-bit XXH3 hash."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < MEMO:
            self[word] = h
        return h


@lru_cache(1)
def word_hashes() -> WordHashes:
    return WordHashes()


keeps("shingles", word_hashes.cache_clear)


def words_of(text: str | None) -> list[bytes]:
    """Runs of anything but space and the characters 9 to 13, A-Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def hashes_of(words: list[bytes]) -> np.ndarray:
    return np.frombuffer(array("Q", map(word_hashes().__getitem__, words)), np.uint64) if words else np.zeros(0, np.uint64)


def mix(a: np.ndarray) -> np.ndarray:
    a = (a ^ (a >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    a = (a ^ (a >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return a ^ (a >> np.uint64(33))


def window_hash(h: np.ndarray, width: int, hop: int = 1) -> np.ndarray:
    """A hash of each `width` consecutive values of h."""
    if len(h) < width:
        return np.zeros(0, np.uint64)
    n = len(h) - width + 1
    out = np.full(n, width, np.uint64)
    for k in range(width):
        out = (out ^ h[k : k + n]) * np.uint64(PLACES[k % len(PLACES)])
        out ^= out >> np.uint64(31)
    return mix(out)


def shingle_set(text: str | None, width: int = 5) -> np.ndarray:
    """The sorted distinct hashes of the text's shingles. Fewer words than `width`: the whole sequence is one. No words: none."""
    words = words_of(text)
    if not words:
        return np.zeros(0, np.uint64)
    h = hashes_of(words)
    return np.unique(window_hash(h, min(width, len(h))))


def pack(values: np.ndarray) -> bytes:
    """Non-negative integers; small for small ones."""
    import zstandard

    width = 1 if not len(values) else max(1, (int(values.max()).bit_length() + 7) // 8)
    planes = np.ascontiguousarray(values.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :width].T
    return bytes([width]) + zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpack(data: bytes) -> np.ndarray:
    import zstandard

    width = data[0]
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), np.uint8).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :width] = planes.T
    return out.view("<u8").reshape(-1).astype(np.uint64)


def pack_sorted(values: np.ndarray) -> bytes:
    return pack(np.diff(values.astype(np.uint64), prepend=np.uint64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data), dtype=np.uint64)
