"""FM-index over a sequence of word numbers: wavelet tree, backward search, sampled suffix positions.

All operations take arrays, so that many phrases or occurrences advance together.
"""

from __future__ import annotations

import numpy as np

#: Every so many positions of the text keep their place.
SAMPLE = 16
#: Occurrences located at once.
_AT_ONCE = 1 << 18


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Positions in the order of their suffixes; zeros are separators, each smaller than all numbers and than the separators after it.

    The text ends with a separator. Prefix doubling: a round doubles the length by which suffixes are ordered; as separators differ from each
    other, repeats end at them and the rounds are the logarithm of the longest repeat within a run.
    """
    n = len(text)
    separators = text == 0
    _, rank = np.unique(np.where(separators, np.cumsum(separators), text.astype(np.int64) + n + 1), return_inverse=True)
    length = 1
    while True:
        after = np.zeros(n, np.int64)
        after[: max(0, n - length)] = rank[length:] + 1
        key = rank * np.int64(n + 1) + after
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate([np.zeros(min(n, 1), np.int64), np.cumsum(ordered[1:] != ordered[:-1])])
        length *= 2
        if length >= n or rank[order[-1]] == n - 1:
            return order


class WaveletTree:
    """Ranks of symbols in a sequence. One level per bit, the highest first; a level keeps the running count of ones, and
    the next level holds the symbols with a zero before those with a one, so that a node of the tree is a range of its level."""

    def __init__(self, symbols: np.ndarray, bits: int) -> None:
        self.levels: list[tuple[int, np.ndarray, int]] = []
        for shift in range(bits - 1, -1, -1):
            bit = (symbols >> shift & 1).astype(bool)
            ones = np.zeros(len(symbols) + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.levels.append((shift, ones, len(symbols) - int(ones[-1])))
            symbols = np.concatenate([symbols[~bit], symbols[bit]])

    def rank(self, symbol: np.ndarray, position: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each position."""
        start = np.zeros_like(position)
        for shift, ones, zeros in self.levels:
            right = (symbol >> shift & 1).astype(bool)
            a, b = ones[start], ones[position]
            start, position = np.where(right, zeros + a, start - a), np.where(right, zeros + b, position - b)
        return position - start

    def at(self, position: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each position, and how often it occurs before."""
        start, symbol = np.zeros_like(position), np.zeros_like(position)
        for _, ones, zeros in self.levels:
            b = ones[position]
            right = ones[position + 1] > b
            a = ones[start]
            start, position = np.where(right, zeros + a, start - a), np.where(right, zeros + b, position - b)
            symbol = 2 * symbol + right
        return symbol, position - start


class FMIndex:
    """Index of a text of numbers below `alphabet` whose runs each end with a zero."""

    def __init__(self, text: np.ndarray, alphabet: int, sample: int = SAMPLE) -> None:
        order = suffix_array(text)
        before = text[order - 1]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=alphabet))])
        self.tree = WaveletTree(before, max(1, int(alphabet - 1).bit_length()))
        # The beginning of a run is always kept, so that no walk leaves its run.
        self.kept = (order % sample == 0) | (before == 0)
        self.kept_before = np.cumsum(self.kept) - 1
        self.places = order[self.kept]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows (from, to) of the phrases that occur, and which phrases these are; `phrases` has one phrase of numbers above zero per line."""
        last = phrases[:, -1]
        found, low, high = np.arange(len(phrases)), self.first[last], self.first[last + 1]
        for column in range(phrases.shape[1] - 1, -1, -1):
            if column < phrases.shape[1] - 1:
                symbol = phrases[found, column]
                low = self.first[symbol] + self.tree.rank(symbol, low)
                high = self.first[symbol] + self.tree.rank(symbol, high)
            some = low < high
            found, low, high = found[some], low[some], high[some]
        return low, high, found

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Position in the text of each row: walk left to a kept position."""
        out = np.empty(len(rows), np.int64)
        for begin in range(0, len(rows), _AT_ONCE):
            here = rows[begin : begin + _AT_ONCE]
            waiting, steps = np.arange(begin, begin + len(here)), 0
            while len(here):
                kept = self.kept[here]
                out[waiting[kept]] = self.places[self.kept_before[here[kept]]] + steps
                waiting, here = waiting[~kept], here[~kept]
                symbol, before = self.tree.at(here)
                here, steps = self.first[symbol] + before, steps + 1
        return out
