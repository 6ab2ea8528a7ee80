"""Word shingles of a batch of texts as 64-bit hashes, computed for all texts at once."""

from __future__ import annotations

import numpy as np

_BLANK = np.zeros(256, bool)
_BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def _scrambled(n: int, seed: int) -> np.ndarray:
    """Fixed odd 64-bit numbers."""
    return np.random.default_rng(seed).integers(0, 2**63, n, dtype=np.uint64) * 2 + 1


# blanks count nothing, capitals like small letters
_OF_BYTE = np.where(_BLANK, np.uint64(0), _scrambled(256, 11)[_LOWER])
_STEP = np.uint64(0x9E3779B97F4A7C15)
_PLACE = _scrambled(64, 12)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers; one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers = np.ones(1, np.uint64)


def _powers_of_step(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        with np.errstate(over="ignore"):
            _powers = np.cumprod(np.full(2 * n, _STEP)) * _INVERSE
    return _powers[:n]


_INVERSE = np.uint64(pow(int(_STEP), -1, 2**64))


def word_hashes(offsets: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every lower-cased word and the index of its text.

    ``raw`` holds the texts one after the other, text i from ``offsets[i]`` to ``offsets[i + 1]``.
    The hash of a word depends on its bytes only.
    """
    n = len(raw)
    if n == 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    inside = ~_BLANK[raw]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    # a word also begins where a text begins
    begins = offsets[:-1][offsets[:-1] < n]
    first[begins] |= inside[begins]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    with np.errstate(over="ignore"):
        # polynomial of the bytes by their place after the word's start
        used = n - starts[0]
        at = np.arange(starts[0], n) - np.repeat(starts, np.diff(np.append(starts, n)))
        values = _OF_BYTE[raw[n - used :]] * _powers_of_step(int(at.max()) + 1)[at]
        hashes = mixed(np.add.reduceat(values, starts - starts[0]))
    text = np.searchsorted(offsets, starts, side="right") - 1
    return hashes, text


def shingle_hashes(
    words: np.ndarray, text: np.ndarray, n_texts: int, size: int
) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all word shingles and the index of their text.

    A text with fewer words than ``size``, but not none, has one shingle of all its words.
    """
    count = np.bincount(text, minlength=n_texts)
    with np.errstate(over="ignore"):
        m = len(words) - size + 1
        if m > 0:
            whole = text[:m] == text[size - 1 :]
            sums = words[:m] * _PLACE[0]
            for k in range(1, size):
                sums += words[k : k + m] * _PLACE[k]
            hashes, of = mixed(sums[whole]), text[:m][whole]
        else:
            hashes, of = np.empty(0, np.uint64), np.empty(0, np.int64)
        short = np.flatnonzero((count > 0) & (count < size))
        if len(short):
            first = np.cumsum(count)[short] - count[short]
            sums = np.zeros(len(short), np.uint64)
            for k in range(size - 1):
                has = count[short] > k
                sums[has] += words[first[has] + k] * _PLACE[k]
            hashes = np.concatenate([hashes, mixed(sums + np.uint64(1) + count[short].astype(np.uint64))])
            of = np.concatenate([of, short])
    return hashes, of


def distinct_sets(
    hashes: np.ndarray, of: np.ndarray, n_texts: int
) -> tuple[np.ndarray, np.ndarray]:
    """Ascending distinct hashes text by text, and the offsets of the texts (n_texts + 1)."""
    if len(of) and (of[1:] < of[:-1]).any():
        order = np.argsort(of, kind="stable")
        hashes, of = hashes[order], of[order]
    else:
        hashes = hashes.copy()
    bounds = np.searchsorted(of, np.arange(n_texts + 1))
    for first, end in zip(bounds[:-1], bounds[1:], strict=True):
        hashes[first:end].sort()
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (of[1:] != of[:-1])
    hashes, of = hashes[new], of[new]
    return hashes, np.searchsorted(of, np.arange(n_texts + 1))
