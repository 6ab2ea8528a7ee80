"""A run-length index over many short pieces of text, in numpy.

The pieces are joined with separators, each a symbol of its own, and sorted by suffix.  The
Burrows-Wheeler transform of repetitive text has few runs, and only what belongs to run ends is
kept of the suffix order: for the text positions in front of a run's first row, the suffix sorted
just above and how many bytes the two share.  Every other position follows from the next such
sample to its right: going one byte left within a run moves both suffixes one byte left and
lengthens what they share by one.
"""

from __future__ import annotations

import numpy as np

PACKED, WORD = 7, 8


class RunLengthIndex:
    """``samples`` are text positions, ``above`` and ``shared`` what belongs to them."""

    def __init__(self, pieces: list[bytes]) -> None:
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        raw = np.frombuffer(b"".join(p + b"\0" for p in pieces), np.uint8)
        self.ends = np.cumsum(lengths + 1) - 1
        self.starts = self.ends - lengths
        self.piece = np.repeat(np.arange(len(pieces)), lengths + 1)
        # bytes up to the separator of the piece
        self.left = np.repeat(self.ends, lengths + 1) - np.arange(len(raw))
        symbols = raw.astype(np.int64)
        symbols[self.ends] = -1 - np.arange(len(pieces))
        order = self._suffix_order(raw, int(lengths.max(initial=0)))
        before = symbols[order - 1]
        run_starts = np.flatnonzero(np.append(True, before[1:] != before[:-1]))
        self.runs = len(run_starts)
        row = np.empty_like(order)
        row[order] = np.arange(len(order))
        samples = np.sort((order[run_starts] - 1) % len(order))
        rows = row[samples]
        self.samples = samples
        self.above = np.where(rows > 0, order[rows - 1], -1)
        self.shared = self._common(raw, samples, self.above)

    def _suffix_order(self, raw: np.ndarray, longest: int) -> np.ndarray:
        """Order of all suffixes: ranks by 7 bytes, then by three times as many in each step."""
        rank, width = self._packed_ranks(raw), PACKED
        # three ranks fit into 63 bits, or else two
        terms = 3 if 3 * len(raw).bit_length() <= 63 else 2
        bits = len(raw).bit_length()
        while width <= longest:
            both = rank
            for k in range(1, terms):
                both = both << bits
                # shorter suffixes are told apart by their separators already
                far = np.flatnonzero(self.left >= k * width)
                both[far] += rank[far + k * width]
            width *= terms
            if width > longest:
                return np.argsort(both)
            rank = np.unique(both, return_inverse=True)[1].astype(np.int64)
        return np.argsort(rank)

    def _packed_ranks(self, raw: np.ndarray) -> np.ndarray:
        """Ranks by the first bytes; suffixes that end within these are told apart by their piece."""
        n = len(raw)
        packed = np.zeros(n, np.int64)
        for k in range(PACKED):
            shifted = np.zeros(n, np.int64)
            shifted[: n - k] = raw[k:].astype(np.int64) + 1
            shifted[self.left <= k] = 0
            packed = (packed << 9) | shifted
        rank = np.unique(packed, return_inverse=True)[1].astype(np.int64)
        ended = np.flatnonzero(self.left < PACKED)
        ended = ended[np.lexsort((self.piece[ended], rank[ended]))]
        among = rank[ended]
        # equal ones take consecutive ranks and move up what comes after them
        sizes = np.bincount(among, minlength=rank.max(initial=-1) + 1)
        first = np.cumsum(np.maximum(sizes, 1)) - np.maximum(sizes, 1)
        rank = first[rank]
        rank[ended] += np.arange(len(ended)) - np.searchsorted(among, among)
        return rank

    def _common(self, raw: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Bytes that the suffixes at ``a`` and ``b`` share within their pieces."""
        most = np.where(b >= 0, np.minimum(self.left[a], self.left[b]), 0)
        shared = np.zeros(len(a), np.int64)
        # eight bytes at a time, then those of the first eight that differ
        words = np.lib.stride_tricks.sliding_window_view(np.append(raw, np.zeros(WORD, np.uint8)), WORD)
        live = np.flatnonzero(most > 0)
        while len(live):
            at = shared[live]
            x, y = words[a[live] + at], words[b[live] + at]
            differ = x != y
            equal = np.where(differ.any(axis=1), differ.argmax(axis=1), WORD)
            shared[live] = at + equal
            live = live[(equal == WORD) & (shared[live] < most[live])]
        return np.minimum(shared, most)

    def matching_statistics(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For text positions: the suffix above, and the bytes shared with it."""
        k = np.searchsorted(self.samples, at)
        away = self.samples[k] - at
        shared = self.shared[k] + away
        above = np.where(self.above[k] >= 0, self.above[k] - away, -1)
        return above, np.where(above >= 0, shared, 0)


def repeated_windows(pieces: list[bytes], order: np.ndarray, length: int) -> list[np.ndarray]:
    """Per piece: starts of windows of ``length`` bytes that also occur at a smaller order.

    ``order`` gives the order of each piece's first byte; a window's is that plus its start.
    """
    index = RunLengthIndex(pieces)
    windows = np.flatnonzero(index.left >= length)
    above, shared = index.matching_statistics(windows)
    slot = np.full(len(index.left), -1)
    slot[windows] = np.arange(len(windows))
    # equal windows are neighbours in suffix order: follow the matches up to the first one
    top = np.where(shared >= length, slot[above], np.arange(len(windows)))
    while True:
        higher = top[top]
        if np.array_equal(higher, top):
            break
        top = higher
    mine = order[index.piece[windows]] + windows - index.starts[index.piece[windows]]
    least = np.full(len(windows), np.iinfo(np.int64).max)
    np.minimum.at(least, top, mine)
    later = windows[mine > least[top]]
    owner = index.piece[later]
    cuts = np.searchsorted(owner, np.arange(len(pieces) + 1))
    return [
        later[a:b] - index.starts[k] for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))
    ]
