"""FM-index over a sequence of small integers: wavelet matrix ranks, sampled suffix positions, many patterns at once."""

from __future__ import annotations

import numpy as np


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Order of the suffixes by prefix doubling; after each round only suffixes that still tie are sorted again."""
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    ranks = np.empty(n, dtype=np.int64)

    def renumber(rows: np.ndarray, keys: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Suffixes ``rows`` now stand at ``at`` of the order in order of ``keys``; a group's rank is its first place."""
        new = np.ones(len(rows), dtype=bool)
        new[1:] = keys[1:] != keys[:-1]
        ranks[rows] = at[np.maximum.accumulate(np.where(new, np.arange(len(rows)), 0))]
        single = new.copy()
        single[:-1] &= new[1:]
        return ~single

    places = np.arange(n)
    tied = renumber(order, symbols[order], places)
    h = 1
    while tied.any():
        places = places[tied]
        rows = order[places]
        follow = rows + h
        second = np.where(follow < n, ranks[np.minimum(follow, n - 1)] + 1, 0)
        key = ranks[rows] * (n + 1) + second
        sort = np.argsort(key, kind="stable")
        rows, key = rows[sort], key[sort]
        order[places] = rows
        tied = renumber(rows, key, places)
        h *= 2
    return order


class _Bits:
    """A bit vector with rank."""

    def __init__(self, bits: np.ndarray) -> None:
        size = -(-(len(bits) + 1) // 64) * 64
        full = np.zeros(size, dtype=np.uint8)
        full[: len(bits)] = bits
        self.words = np.packbits(full, bitorder="little").view("<u8")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)

    def get(self, at: np.ndarray) -> np.ndarray:
        return ((self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)


class _Wavelet:
    """A wavelet matrix: one bit vector for each binary digit of the symbols, from the highest."""

    def __init__(self, symbols: np.ndarray, digits: int) -> None:
        self.digits, self.levels, self.zeros = digits, [], []
        now = symbols
        for d in range(digits - 1, -1, -1):
            bit = (now >> d) & 1 == 1
            self.levels.append(_Bits(bit))
            self.zeros.append(int(len(now) - np.count_nonzero(bit)))
            now = np.concatenate([now[~bit], now[bit]])
        counts = np.bincount(symbols, minlength=1 << digits)
        self.smaller = np.concatenate([[0], np.cumsum(counts)])  # rows of smaller symbols
        # Where each symbol's run begins on the last level: symbols in order of their reversed digits.
        reverse = np.zeros(1 << digits, dtype=np.int64)
        for d in range(digits):
            reverse |= ((np.arange(1 << digits) >> d) & 1) << (digits - 1 - d)
        by = np.argsort(reverse, kind="stable")
        self.run = np.empty(1 << digits, dtype=np.int64)
        self.run[by] = np.concatenate([[0], np.cumsum(counts[by])])[:-1]

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before each position."""
        for d, (level, zeros) in enumerate(zip(self.levels, self.zeros, strict=True)):
            ones = level.rank(at)
            at = np.where((symbol >> (self.digits - 1 - d)) & 1 == 1, zeros + ones, at - ones)
        return at - self.run[symbol]

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each position and its occurrences before it."""
        symbol = np.zeros(len(at), dtype=np.int64)
        for level, zeros in zip(self.levels, self.zeros, strict=True):
            ones, bit = level.rank(at), level.get(at)
            at = np.where(bit, zeros + ones, at - ones)
            symbol = symbol * 2 + bit
        return symbol, at - self.run[symbol]


class FMIndex:
    """Index of ``symbols``, all 0 or greater; 0 is a break that no pattern contains."""

    SAMPLE = 16

    def __init__(self, symbols: np.ndarray) -> None:
        text = np.append(symbols.astype(np.int64), 0)
        text[:-1] += 1  # the end sorts first
        order = suffix_array(text)
        self.size = len(text)
        last = text[order - 1]
        self.wavelet = _Wavelet(last, max(1, int(text.max()).bit_length()))
        kept = order % self.SAMPLE == 0
        self.sampled, self.positions = _Bits(kept), order[kept]

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [low, high) of the suffixes that begin with each pattern (symbols left-aligned in a 2-D array)."""
        n = len(lengths)
        low, high = np.zeros(n, dtype=np.int64), np.full(n, self.size, dtype=np.int64)
        most = len(self.wavelet.smaller) - 1
        for step in range(int(lengths.max(initial=0))):
            live = np.flatnonzero((lengths > step) & (low < high))
            if not len(live):
                break
            symbol = patterns[live, lengths[live] - 1 - step].astype(np.int64) + 1
            known = symbol < most
            high[live[~known]] = low[live[~known]]
            live, symbol = live[known], symbol[known]
            begin = self.wavelet.smaller[symbol]
            low[live] = begin + self.wavelet.rank(symbol, low[live])
            high[live] = begin + self.wavelet.rank(symbol, high[live])
        high = np.maximum(low, high)
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of the suffixes in these rows: walk back to the nearest sampled one."""
        out, at, steps = np.full(len(rows), -1, dtype=np.int64), rows.copy(), 0
        open_ = np.arange(len(rows))
        while len(open_):
            here = self.sampled.get(at)
            done = open_[here]
            out[done] = self.positions[self.sampled.rank(at[here])] + steps
            open_, at = open_[~here], at[~here]
            symbol, before = self.wavelet.access(at)
            at = self.wavelet.smaller[symbol] + before
            steps += 1
        return out
