"""Hashed word shingles of whole texts (numpy, inside Arrow batches)."""
from __future__ import annotations

import numpy as np
import xxhash

WORDS = 5


class _WordHashes(dict):
    """64-bit hashes of words; a worker's table of bounded size."""

    LIMIT = 300_000

    def __missing__(self, word: str) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_HASHES = _WordHashes()


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit mixing (xor-shift and odd multipliers)."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def word_hashes(text: str) -> np.ndarray:
    """Hashes of the words (what white space separates) in order."""
    words = text.split()
    return np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))


def shingle_hashes(words: np.ndarray, k: int = WORDS) -> np.ndarray:
    """Hashes of all runs of ``k`` words, in order.  Fewer words than ``k``: one shingle of all
    of them; no word: no shingle."""
    n = len(words)
    if not n:
        return words
    if n < k:
        k = n
    h = np.full(n - k + 1, k, np.uint64)
    for j in range(k):
        h = h * np.uint64(0x9E3779B97F4A7C15) + words[j:n - k + 1 + j]
    return mix(h)


def counted(text: str, k: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles (ascending) and how often each occurs."""
    h, n = np.unique(shingle_hashes(word_hashes(text), k), return_counts=True)
    return h, n.astype(np.float64)


def probability_jaccard(a: tuple, b: tuple) -> float:
    """Probability Jaccard similarity of two weighted sets (ascending keys, weights):
    the sum over common i of 1 / sum over j of max(a_j / a_i, b_j / b_i).  For sets without
    repeated shingles it is the Jaccard similarity.  0 if either is empty."""
    (ka, wa), (kb, wb) = a, b
    if not len(ka) or not len(kb):
        return 0.0
    at = np.minimum(np.searchsorted(kb, ka), len(kb) - 1)
    both = kb[at] == ka
    if not both.any():
        return 0.0
    x, y = wa[both], wb[at[both]]
    only_a, only_b = wa.sum() - x.sum(), wb.sum() - y.sum()
    order = np.argsort(-(x / y), kind="stable")
    x, y = x[order], y[order]
    # among the common ones max() takes a's side exactly for the ratios up to i's own
    up_to_a = np.cumsum(x)
    after_b = y.sum() - np.cumsum(y)
    total = (only_a + up_to_a) / x + (only_b + after_b) / y
    return float((1.0 / total).sum())
