"""Words and their hashes: small helpers that run inside tasks.

``bytes.split()`` splits on exactly 0x20 and 0x09-0x0D, and ``bytes.lower()`` changes A-Z only,
so both work on the UTF-8 form without touching other characters.
"""

from __future__ import annotations

import numpy as np
import xxhash

M1 = np.uint64(0x9E3779B97F4A7C15)  # odd multipliers of the two window polynomials
M2 = np.uint64(0xC2B2AE3D27D4EB4F)

# A-Z folded to a-z; every byte outside 0-9, a-z and 0x80-0xFF becomes a blank
ALNUM = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128
              else 32 for b in range(256))


def utf8(text) -> bytes:
    return text.encode("utf-8", "surrogatepass") if isinstance(text, str) else b""


def space_words(text, fold: bool = False) -> list[bytes]:
    """Words between ASCII white space; null has none."""
    raw = utf8(text)
    return (raw.lower() if fold else raw).split()


def alnum_words(text) -> list[bytes]:
    """Lower-cased words of ASCII letters, digits and all other non-ASCII characters."""
    return utf8(text).translate(ALNUM).split()


def hash_words(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def mix(h: np.ndarray) -> np.ndarray:
    """Spread all bits of a 64-bit value (so that its high and low bits are both usable)."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def rolling(wh: np.ndarray, k: int, mult: np.uint64 = M1) -> np.ndarray:
    """Hash of every window of k consecutive word hashes (position i covers i .. i+k-1)."""
    n = len(wh) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = wh[:n].copy()
    for j in range(1, k):
        out *= mult
        out += wh[j:j + n]
    return mix(out)


def distinct(h: np.ndarray) -> np.ndarray:
    """Distinct values, sorted (``np.unique`` without its overhead, which counts for a short text)."""
    h = np.sort(h)
    return h[np.r_[True, h[1:] != h[:-1]]] if len(h) else h


class Stream:
    """The words of many texts laid end to end, with each word's text and place in it."""

    def __init__(self, words_per_text: list[list[bytes]]):
        self.lens = np.fromiter(map(len, words_per_text), np.int64, len(words_per_text))
        self.starts = np.cumsum(self.lens) - self.lens
        self.total = int(self.lens.sum())
        self.hashes = (np.concatenate([hash_words(w) for w in words_per_text])
                       if words_per_text else np.empty(0, np.uint64))
        self.owner = np.repeat(np.arange(len(self.lens)), self.lens)
        self.place = np.arange(self.total) - self.starts[self.owner]
        self.left = self.lens[self.owner] - self.place  # words from here to the text's end


def in_bucket_order(h: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of each 64-bit hash; grows with the hash, so sorted hashes have sorted buckets."""
    return (((h >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


def runs(sorted_values: np.ndarray) -> np.ndarray:
    """Start of each run of equal values."""
    if not len(sorted_values):
        return np.empty(0, np.int64)
    return np.flatnonzero(np.r_[True, sorted_values[1:] != sorted_values[:-1]])


def pair_runs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Start of each run of equal pairs."""
    if not len(a):
        return np.empty(0, np.int64)
    return np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])])


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def unsigned(a) -> np.ndarray:
    return np.ascontiguousarray(a, np.int64).view(np.uint64)
