"""Distinct word shingles of whole texts, as sorted 64-bit hashes."""

from __future__ import annotations

import numpy as np

from .quality import _LOWER as LOWER
from .textblock import TextBlock, mix


def shingle_sets(block: TextBlock, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(bounds, hashes): text k's distinct shingles are hashes[bounds[k]:bounds[k + 1]], sorted.

    A text of fewer words than ``width`` has its whole word sequence as one shingle; one without words has none.
    """
    first, last, doc = block.words()
    low = TextBlock(LOWER[block.buf], block.starts)
    words = low.substring_hash(low.sums(), first, last)
    n, count = len(words), np.bincount(doc, minlength=block.n)
    begin = np.cumsum(count) - count
    grams, owner = [], []
    with np.errstate(over="ignore"):
        if n >= width:
            g = np.full(n - width + 1, np.uint64(width))
            for i in range(width):
                g = mix(g + words[i : n - width + 1 + i])
            at = np.flatnonzero(doc[: n - width + 1] == doc[width - 1 :])
            grams.append(g[at])
            owner.append(doc[at])
        for size in range(1, width):
            short = np.flatnonzero(count == size)
            g = np.full(len(short), np.uint64(size))
            for i in range(size):
                g = mix(g + words[begin[short] + i])
            grams.append(g)
            owner.append(short)
    grams, owner = np.concatenate(grams), np.concatenate(owner)
    order = np.lexsort((grams, owner))
    grams, owner = grams[order], owner[order]
    new = np.r_[True, (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])] if len(grams) else np.zeros(0, bool)
    grams, owner = grams[new], owner[new]
    return np.searchsorted(owner, np.arange(block.n + 1)), grams
