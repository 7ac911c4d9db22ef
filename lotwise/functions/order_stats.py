"""Weighted order statistics of many two-dimensional ranges at once, as arrays.

Items are kept in one order (group and mileage, say), so that a range of it is a pair of
positions; their values are ranks.  The bits of the ranks are laid out level by level, highest
first, each level with its zeros before its ones and in the old order within both.  A range
keeps its two positions from level to level, so the weight below a rank and the k-th value of
any range take one step per bit, for all ranges together, whatever their size.
"""
import numpy as np


class Levels:
    """``ranks`` (integers from 0), ``weights`` and ``sums`` of the items in their order."""

    def __init__(self, ranks: np.ndarray, weights: np.ndarray, sums: np.ndarray):
        self.bits = max(1, int(ranks.max(initial=0)).bit_length())
        start = lambda x: np.concatenate([[0], np.cumsum(x)])
        self.total = start(weights), start(sums)
        self.levels = []
        for bit in range(self.bits - 1, -1, -1):
            low = (ranks >> bit & 1) == 0
            self.levels.append((start(low), int(low.sum()), start(np.where(low, weights, 0)), start(np.where(low, sums, 0))))
            order = np.concatenate([np.flatnonzero(low), np.flatnonzero(~low)])
            ranks, weights, sums = ranks[order], weights[order], sums[order]

    def below(self, a: np.ndarray, b: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Weight and sum of the items from a to b with a lower rank."""
        whole = rank >= 1 << self.bits
        everything = [t[b] - t[a] for t in self.total]
        weight, total = np.zeros(len(a), dtype=np.int64), np.zeros(len(a), dtype=np.int64)
        for level, (zeros, n_zeros, w, s) in enumerate(self.levels):
            one = (rank >> (self.bits - 1 - level) & 1) == 1
            weight += np.where(one, w[b] - w[a], 0)
            total += np.where(one, s[b] - s[a], 0)
            a, b = np.where(one, n_zeros + a - zeros[a], zeros[a]), np.where(one, n_zeros + b - zeros[b], zeros[b])
        return np.where(whole, everything[0], weight), np.where(whole, everything[1], total)

    def kth(self, a: np.ndarray, b: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The rank that holds the k-th unit of weight (from 0) of the items from a to b; k is below their weight."""
        rank = np.zeros(len(a), dtype=np.int64)
        for zeros, n_zeros, w, _ in self.levels:
            here = w[b] - w[a]
            one = k >= here
            rank = 2 * rank + one
            k = np.where(one, k - here, k)
            a, b = np.where(one, n_zeros + a - zeros[a], zeros[a]), np.where(one, n_zeros + b - zeros[b], zeros[b])
        return rank
