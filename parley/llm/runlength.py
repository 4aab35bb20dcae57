"""A run-length index of byte strings: run-compressed Burrows-Wheeler transform with sampled run ends.

The strings are laid out one after the other, each closed by a terminator of
its own. Their suffixes are ordered by prefix doubling (only suffixes that
still tie are sorted again); the symbols before them, in that order, are the
transform, kept as runs. At both ends of every run the suffix's place and its
common prefix with the suffix across the run's border are sampled. Inside a run
neighbouring suffixes are preceded by the same symbol, so the common prefix
of a suffix with its neighbour is one less than that of the suffix before it in
the text: ``matching_statistics`` streams over the text from sample to sample
and needs nothing else.
"""

from __future__ import annotations

import numpy as np

_WIDTH, _BITS = 7, 9  # symbols packed into one number: bytes + 1, terminators 0


class RunLengthIndex:
    """``strings`` as (data, bounds): string i is data[bounds[i]:bounds[i + 1]]."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray):
        count = len(bounds) - 1
        length = np.diff(bounds)
        #: first place of each string in the text with terminators
        self.first = bounds[:-1] + np.arange(count)
        self.text = np.zeros(len(data) + count, np.int64)
        inside = np.ones(len(self.text), bool)
        inside[self.first + length] = False
        self.text[inside] = data.astype(np.int64) + 1
        self._pack()
        order = self._suffix_order()
        before = np.where(order > 0, self.text[order - 1], 0)
        before = np.where(before > 0, before, -1 - order)  # terminators differ from one another
        border = np.flatnonzero(before[1:] != before[:-1]) + 1
        starts = np.concatenate([[0], border]).astype(np.int64)
        ends = np.append(border - 1, len(order) - 1)
        self.run_symbol, self.run_length = before[starts], ends - starts + 1
        self.run_first, self.run_last = order[starts], order[ends]  # sampled places at the run ends
        across = self._common_prefix(order[border - 1], order[border])
        self.common_first = np.concatenate([[0], across])  # with the suffix before the run
        self.common_last = np.append(across, 0)  # with the suffix after the run

    def _pack(self) -> None:
        """Each place's next symbols up to a terminator as one number, and how many they are."""
        n = len(self.text)
        padded = np.concatenate([self.text, np.zeros(_WIDTH, np.int64)])
        key, alive, size = np.zeros(n, np.int64), np.ones(n, bool), np.zeros(n, np.int64)
        for i in range(_WIDTH):
            symbol = padded[i : i + n]
            alive = alive & (symbol > 0)
            key = (key << _BITS) | np.where(alive, symbol, 0)
            size += alive
        self._key, self._size = key, size

    def _suffix_order(self) -> np.ndarray:
        order = np.argsort(self._key, kind="stable")
        key, short = self._key[order], self._size[order] < _WIDTH
        new = np.concatenate([[True], (key[1:] != key[:-1]) | short[1:]])
        head = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
        rank = np.empty(len(order), np.int64)
        rank[order] = head
        alone = new & np.append(new[1:], True)
        left = np.flatnonzero(~alone)  # places in the order whose suffixes still tie
        step, n = _WIDTH, len(order)
        while len(left):
            suffix = order[left]
            value = rank[suffix] * n + rank[suffix + step]
            by = np.argsort(value, kind="stable")
            suffix, value = suffix[by], value[by]
            order[left] = suffix
            new = np.concatenate([[True], value[1:] != value[:-1]])
            rank[suffix] = np.maximum.accumulate(np.where(new, left, 0))
            left = left[~(new & np.append(new[1:], True))]
            step *= 2
        return order

    def _common_prefix(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Lengths of the common prefixes of the suffixes at ``a`` and ``b``; terminators match nothing."""
        out, open_ = np.zeros(len(a), np.int64), np.arange(len(a))
        a, b = a.copy(), b.copy()
        while len(open_):
            x, y = self._key[a[open_]], self._key[b[open_]]
            size = np.minimum(self._size[a[open_]], self._size[b[open_]])
            differ = x ^ y
            # symbols before the first differing bit
            top = np.frexp(np.maximum(differ >> 32, 1).astype(float))[1] + 31
            top = np.where(differ >> 32, top, np.frexp(np.maximum(differ, 1).astype(float))[1] - 1)
            equal = np.where(differ == 0, _WIDTH, _WIDTH - 1 - top // _BITS)
            out[open_] += np.minimum(equal, size)
            open_ = open_[(differ == 0) & (size == _WIDTH)]
            a[open_] += _WIDTH
            b[open_] += _WIDTH
        return out

    def matching_statistics(self) -> np.ndarray:
        """For every place of the text the length of the longest string there that also starts at another place."""
        n = len(self.text)
        best = np.zeros(n, np.int64)
        for place, common in ((self.run_first, self.common_first), (self.run_last, self.common_last)):
            sample = np.full(n, -1, np.int64)
            sample[place] = common
            at = np.maximum.accumulate(np.where(sample >= 0, np.arange(n), 0))
            best = np.maximum(best, sample[at] - (np.arange(n) - at))
        return best

    def repeated(self, length: int) -> list[np.ndarray]:
        """For each string the starts of its substrings of ``length`` that also start elsewhere."""
        hit = np.flatnonzero(self.matching_statistics() >= length)
        of = np.searchsorted(self.first, hit, side="right") - 1
        cut = np.searchsorted(of, np.arange(len(self.first) + 1))
        return [hit[a:b] - self.first[i] for i, (a, b) in enumerate(zip(cut, cut[1:]))]


def ranges(starts: np.ndarray) -> list[tuple[int, int]]:
    """Rising numbers as (first, last) of their runs."""
    if not len(starts):
        return []
    gap = np.flatnonzero(np.diff(starts) != 1)
    return list(zip(starts[np.concatenate([[0], gap + 1])].tolist(), starts[np.append(gap, len(starts) - 1)].tolist()))
