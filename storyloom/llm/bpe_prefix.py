"""Exact byte-pair segmentation by dynamic programming over prefixes.

A sequence of tokens is what byte-pair merging makes of their concatenation exactly if each adjacent pair of tokens
is. So every prefix of a piece has one valid last token: the one that forms a valid pair with the last token of the
prefix before it. The table of those last tokens is filled left to right and gives each prefix its token count.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import ahocorasick

_SHIFT = 21


class PrefixTable:
    """Last valid token and token count of each prefix of a string over a known alphabet.

    merge_rank(left, right): the rank of a merge, lower first, or None. Each symbol of a string must be a token.
    """

    #: Pair verdicts kept per process before the memory is cleared.
    MOST_PAIRS = 1_000_000

    def __init__(self, tokens: Iterable[str], merge_rank: Callable) -> None:
        self.merge_rank = merge_rank
        self.tokens: list = [None, *tokens]  # by number; 0: none
        self.ends = ahocorasick.Automaton()
        for number, token in enumerate(self.tokens[1:], 1):
            self.ends.add_word(token, (len(token), number))
        self.ends.make_automaton()
        self.longest = max(map(len, self.tokens[1:]), default=1)
        self._pairs: dict[int, bool] = {}

    def merged(self, piece: str) -> list[str]:
        """Plain merging: the best-ranked adjacent pair first, the leftmost of equals. For pairs of tokens only."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            ranks = [(r, i) for i in range(len(parts) - 1) if (r := self.merge_rank(parts[i], parts[i + 1])) is not None]
            if not ranks:
                break
            i = min(ranks)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def _valid(self, key: int) -> bool:
        """Whether merging gives just this pair; with no left token, whether it gives the right one alone."""
        left, right = self.tokens[key >> _SHIFT], self.tokens[key & ((1 << _SHIFT) - 1)]
        if len(self._pairs) >= self.MOST_PAIRS:
            self._pairs.clear()
        known = self._pairs[key] = self.merged(right if left is None else left + right) == (
            [right] if left is None else [left, right]
        )
        return known

    def boundaries(self, text: str, last) -> Iterator[int]:
        """Goes over the boundaries of a text, from 1 on; last (boundary to number of its token, 0: 0) is filled before
        each is given out. Only entries within the longest token's length of the boundary are read again."""
        pairs = self._pairs
        reached = 0
        for at, (size, token) in self.ends.iter(text):
            if at + 1 == reached:
                continue
            key = last[at + 1 - size] << _SHIFT | token
            ok = pairs.get(key)
            if self._valid(key) if ok is None else ok:
                reached = at + 1
                last[reached] = token
                yield reached

    def counts(self, piece: str) -> list[int]:
        """Token counts of the prefixes of length 0 to len(piece)."""
        pairs, last, count = self._pairs, [0] * (len(piece) + 1), [0] * (len(piece) + 1)
        for at, (size, token) in self.ends.iter(piece):
            end, start = at + 1, at + 1 - size
            if not count[end]:
                key = last[start] << _SHIFT | token
                ok = pairs.get(key)
                if self._valid(key) if ok is None else ok:
                    last[end] = token
                    count[end] = count[start] + 1
        return count

    def total(self, piece: str) -> int:
        return self.counts(piece)[-1]


class Remembered(dict):
    """Results of a function by its argument, in two generations of bounded size; long arguments aren't kept."""

    MOST, LONGEST = 200_000, 64

    def __init__(self, function: Callable) -> None:
        super().__init__()
        self.function = function
        self.older: dict = {}

    def __missing__(self, key: str):
        value = self.older.get(key)
        if value is None:
            value = self.function(key)
        if len(key) <= self.LONGEST:
            if len(self) >= self.MOST:
                self.older = dict(self)
                self.clear()
            self[key] = value
        return value
