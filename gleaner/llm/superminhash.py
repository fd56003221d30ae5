"""SuperMinHash signatures (Ertl, 2017), level by level over many sets at once.

Every element draws its own random permutation of the slots; its j-th slot may be lowered to
j + r, with r uniform in [0, 1). Because an element visits each slot once, the ranks of one element
are correlated across slots, which makes the estimate's variance smaller than MinHash's. Levels
j = 0, 1, ... are run for all elements of a set together, and a set is done as soon as no slot holds
j + 1 or more: later levels couldn't lower any slot. For sets much larger than the number of
slots that is after a level or two.

A slot's value is the integer (level << 40 | 40 random bits), so equal values mean equal draws.
"""

from __future__ import annotations

import numpy as np

from gleaner.llm.shingles import mix

EMPTY = np.uint64(2**63)


def _draw(elements: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """(40 random bits for the value, 24 for the permutation) of each element at a level."""
    x = mix(elements + np.uint64((level + 1) * 0x9E3779B97F4A7C15 % 2**64))
    return x >> np.uint64(24), x & np.uint64(0xFFFFFF)


def signatures(elements: np.ndarray, offsets: np.ndarray, slots: int, most: int = 20_000) -> np.ndarray:
    """A row of ``slots`` values for each set; EMPTY in all for an empty set."""
    n = len(offsets) - 1
    out = np.full((n, slots), EMPTY)
    size = np.diff(offsets)
    flat = out.reshape(-1)
    doc = np.repeat(np.arange(n), size)
    bits, pick = _draw(elements, 0)
    first = (pick % np.uint64(slots)).astype(np.int64)
    np.minimum.at(flat, doc * slots + first, bits)
    open_ = np.flatnonzero((size > 0) & (out.max(1) >= np.uint64(1 << 40)))
    at = 0
    while at < len(open_):  # sets that need more levels, some elements at a time
        upto = at + max(1, int(np.searchsorted(np.cumsum(size[open_[at:]]), most, "right")))
        _levels(elements, offsets, open_[at:upto], first, out)
        at = upto
    return out


def _levels(elements: np.ndarray, offsets: np.ndarray, sets: np.ndarray, first: np.ndarray, out: np.ndarray) -> None:
    slots = out.shape[1]
    size = offsets[sets + 1] - offsets[sets]
    row = np.repeat(np.arange(len(sets)), size)
    where = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size) + offsets[sets][row]
    own, sig = elements[where], out[sets]
    perm = np.tile(np.arange(slots, dtype=np.uint16), (len(own), 1))
    line = np.arange(len(own))
    perm[line, 0], perm[line, first[where]] = first[where], 0
    for level in range(1, slots):
        bits, pick = _draw(own, level)
        k = level + (pick % np.uint64(slots - level)).astype(np.int64)
        slot = perm[line, k]
        perm[line, k] = perm[line, level]  # places before the next level aren't read again
        np.minimum.at(sig.reshape(-1), row * slots + slot, bits | np.uint64(level << 40))
        done = sig.max(1) < np.uint64((level + 1) << 40)
        if done.any():
            left = ~done[row]
            if not left.any():
                break
            own, perm, row = own[left], perm[left], row[left]
            line = np.arange(len(own))
    out[sets] = sig


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity of signature rows."""
    return ((a == b) & (a != EMPTY)).mean(-1)
