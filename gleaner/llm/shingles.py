"""Word shingles of texts as 64-bit hashes, in numpy."""

from __future__ import annotations

import numpy as np

UPPER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
BLANK = np.zeros(256, bool)
BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_rng = np.random.default_rng(0x5EED)
_BYTE = _rng.integers(1, 2**63, 256, np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so powers have inverses mod 2**64
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_STEP = [np.uint64(x) for x in (0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads each bit over all."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def powers(base: np.uint64, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(max(0, n - 1), base)]))[:n]


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hash, start) of each run of bytes that aren't blank, A-Z lower-cased."""
    b = np.frombuffer(raw.translate(UPPER), np.uint8)
    solid = np.concatenate([[False], ~BLANK[b], [False]])
    edge = np.flatnonzero(solid[1:] != solid[:-1])
    start, end = edge[::2], edge[1::2]
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[b] * powers(_INVERSE, len(b)))])
    value = (total[end] - total[start]) * powers(_BASE, len(b) + 1)[start]
    return mix(value + (end - start).astype(np.uint64)), start


def shingle_sets(texts: list[str | None], words: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle hashes of all texts, ascending in each; offsets: text i has [o[i], o[i+1])).

    A text with fewer words has its whole sequence as one shingle; one without words has none.
    """
    raws = [(t or "").encode() for t in texts]
    size = np.array([len(r) + 1 for r in raws], np.int64)
    at = np.concatenate([[0], np.cumsum(size)])
    hashes, start = word_hashes(b"\n".join(raws) + b"\n")
    bounds = np.searchsorted(start, at)
    n = np.diff(bounds)
    doc = np.repeat(np.arange(len(texts)), n)
    own = np.full(len(hashes), np.uint64(0x2545F4914F6CDD1D))
    left = bounds[1:][doc] - np.arange(len(hashes))  # words from here to the text's end
    for k in range(words):
        here = np.zeros(len(hashes), np.uint64)
        here[: max(0, len(hashes) - k)] = hashes[k:]
        own = np.where(k < left, mix(own ^ (here * _STEP[k % 5])) + np.uint64(k), own)
    first = np.arange(len(hashes)) == bounds[:-1][doc]
    keep = (left >= words) | (first & (n[doc] < words))
    own, doc = own[keep], doc[keep]
    order = np.lexsort((own, doc))
    own, doc = own[order], doc[order]
    fresh = np.ones(len(own), bool)
    fresh[1:] = (own[1:] != own[:-1]) | (doc[1:] != doc[:-1])
    own, doc = own[fresh], doc[fresh]
    return own, np.searchsorted(doc, np.arange(len(texts) + 1))
