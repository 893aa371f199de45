"""Sets of distinct word shingles, as sorted arrays of 64-bit hashes."""

from __future__ import annotations

import numpy as np

from steplake.llm.words import NOT_SPACE, mix, word_hashes

_U = np.uint64


def shingle_sets(raw: np.ndarray, starts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every distinct shingle of ``size`` words, sorted by row and hash.

    Words are runs without blanks, A-Z as a-z. A row with fewer words has one shingle, its
    whole sequence; a row without words has none.
    """
    hashes, row = word_hashes(raw, starts, NOT_SPACE)
    total = np.zeros(max(0, len(hashes) - size + 1), _U)
    for i in range(size):
        total += hashes[i:i + len(total)] * _U(2 * (0x9E3779B97F4A7C15 >> 3 * i) + 1 & (1 << 64) - 1)
    whole = row[:len(total)] == row[size - 1:]
    found, owner = mix(total[whole]), row[:len(total)][whole]
    counts = np.bincount(row, minlength=len(starts) - 1)
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        first = np.cumsum(counts) - counts
        extra = np.array([int(mix(np.array([sum(int(h) * (2 * i + 3) for i, h in enumerate(hashes[first[r]:first[r] + counts[r]]))
                                            + 0xA5A5 * int(counts[r]) & (1 << 64) - 1], _U))[0]) for r in short], _U)
        found, owner = np.concatenate([found, extra]), np.concatenate([owner, short])
    order = np.lexsort((found, owner))
    found, owner = found[order], owner[order]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:] != found[:-1]) | (owner[1:] != owner[:-1])
    return found[new], owner[new]
