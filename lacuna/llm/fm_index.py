"""An FM-index over a sequence of symbols: suffix sorting, a wavelet matrix, backward search and location.

All work is on NumPy arrays; queries run for many patterns at once.
"""

from __future__ import annotations

import numpy as np

from lacuna.llm.textbytes import ragged


def dense_ranks(keys: np.ndarray) -> tuple[np.ndarray, int]:
    """Ranks from 0 of non-negative integer keys, equal for equal keys, and the number of ranks."""
    return ordered_ranks(keys)[:2]


def ordered_ranks(keys: np.ndarray) -> tuple[np.ndarray, int, np.ndarray]:
    """:func:`dense_ranks`, and the places of the keys in rising order, of equal ones too."""
    n = len(keys)
    if not n:
        return np.zeros(0, np.int64), 0, np.zeros(0, np.int64)
    order, ordered = _sorted(keys)
    ordinal = np.zeros(n, np.int64)
    np.cumsum(ordered[1:] != ordered[:-1], out=ordinal[1:])
    ranks = np.empty(n, np.int64)
    ranks[order] = ordinal
    return ranks, int(ordinal[-1]) + 1, order


def _sorted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order that sorts non-negative keys, equal ones as they stand, and the keys in it.

    Values are sorted, which is much faster than sorting positions: some bits of the keys with places in the others, the lowest bits first.
    """
    keys = keys.astype(np.int64, copy=False)
    place = max(1, (len(keys) - 1).bit_length())
    left, bits, at = int(keys.max()).bit_length(), 63 - place, np.arange(len(keys))
    order = None
    for low in range(0, max(1, left), bits):
        part = (keys >> low if low else keys) if left - low <= bits else (keys >> low) & ((1 << bits) - 1)
        packed = (part if order is None else part[order]) << place
        packed |= at
        packed.sort()
        if left <= bits:
            return packed & ((1 << place) - 1), packed >> place
        packed &= (1 << place) - 1
        order = packed if order is None else order[packed]
    return order, keys[order]


def _first_symbols(text: np.ndarray, depth: int | None) -> tuple[np.ndarray, int]:
    """Keys of the first symbols of each suffix, of as many, by powers of two, as are sorted by value, and how many those are."""
    n = len(text)
    bits, place, span = (int(text.max()) + 1).bit_length(), max(1, (n - 1).bit_length()), 1
    keys = text.astype(np.int64) + 1
    while 2 * span * bits + place <= 63 and (depth is None or 2 * span <= depth) and span < n:
        longer = keys << (span * bits)
        longer[: n - span] |= keys[span:]
        keys, span = longer, 2 * span
    return keys, span


def suffix_ranks(text: np.ndarray, depth: int | None = None) -> np.ndarray:
    """Rank of each suffix by its first ``depth`` symbols (ties have equal ranks), or by all; a shorter suffix precedes those it begins."""
    if not len(text):
        return np.zeros(0, np.int64)
    keys, span = _first_symbols(text, depth)
    ranks, distinct = dense_ranks(keys)
    while distinct < len(text) and (depth is None or span < depth):
        ranks, distinct, _ = further_ranks(ranks, distinct, span)
        span *= 2
    return ranks


def further_ranks(ranks: np.ndarray, distinct: int, span: int) -> tuple[np.ndarray, int, np.ndarray]:
    """Ranks by the first 2 ``span`` symbols from those by the first ``span``, how many there are, and the suffixes in that order."""
    after = np.zeros(len(ranks), np.int64)
    after[: max(0, len(ranks) - span)] = ranks[span:] + 1
    return ordered_ranks(ranks * (distinct + 1) + after)


def suffix_classes(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """For each suffix where the class of its first ``depth`` symbols (a power of two) begins in the order of suffixes, and the suffixes in order by 2 ``depth`` symbols, of equal ones too.

    A suffix that is a class by itself isn't sorted again.
    """
    n = len(text)
    keys, span = _first_symbols(text, depth)
    ranks, distinct, order = ordered_ranks(keys)
    size = np.bincount(ranks, minlength=distinct)
    begin = np.cumsum(size) - size
    left = np.flatnonzero(np.repeat(size > 1, size))
    ranks = begin[ranks].astype(np.int32 if n < 1 << 31 else np.int64)  # places: half the memory to gather from
    while True:
        classes = ranks.copy() if span == depth else None
        if len(left):
            suffix = order[left]
            own, after = ranks[suffix], np.zeros(len(left), np.int64)
            inside = np.flatnonzero(suffix < n - span)
            after[inside] = ranks[suffix[inside] + span]
            after[inside] += 1
            group = np.zeros(len(left), np.int64)
            np.cumsum(own[1:] != own[:-1], out=group[1:])
            by, ordered = _sorted(group * (n + 1) + after)
            suffix = suffix[by]
            order[left] = suffix
            new = np.concatenate(([True], ordered[1:] != ordered[:-1]))
            first = np.flatnonzero(new)
            ranks[suffix] = np.repeat(left[first].astype(ranks.dtype), np.diff(np.append(first, len(left))))
            left = left[~(new & np.append(new[1:], True))]
        if classes is not None:
            return classes, order
        span *= 2


class WaveletMatrix:
    """Rank queries over integers of ``bits`` bits."""

    def __init__(self, values: np.ndarray, bits: int):
        self.levels = []
        for level in reversed(range(bits)):
            ones = (values >> level) & 1
            before = np.concatenate(([0], np.cumsum(ones))).astype(np.int32)
            zeros = len(values) - int(before[-1])
            self.levels.append((level, before, zeros))
            values = np.concatenate((values[ones == 0], values[ones == 1]))

    def rank(self, symbols: np.ndarray, *places: np.ndarray) -> list[np.ndarray]:
        """How often each symbol occurs before each of its places."""
        low, out = np.zeros(len(symbols), np.int64), [np.asarray(p, np.int64) for p in places]
        for level, before, zeros in self.levels:
            bit = ((symbols >> level) & 1).astype(bool)
            low, *out = [np.where(bit, zeros + before[p], p - before[p]) for p in (low, *out)]
        return [p - low for p in out]


class FMIndex:
    """Over runs of symbols from 1 up; 0 ends each run, so no occurrence crosses runs."""

    def __init__(self, runs: np.ndarray, starts: np.ndarray, sample: int = 8):
        """``runs``: the runs, concatenated, each ended by 0; ``starts``: where they start."""
        self.n = len(runs)
        stops = runs == 0
        unique = runs + int(stops.sum())
        unique[stops] = np.arange(int(stops.sum()))  # each end is a symbol of its own: suffixes are all distinct
        ranks = suffix_ranks(unique)
        order = np.empty(self.n, np.int64)
        order[ranks] = np.arange(self.n)
        self.bwt = runs[order - 1]
        self.bits = max(1, int(runs.max()).bit_length()) if self.n else 1
        self.matrix = WaveletMatrix(self.bwt, self.bits)
        self.first = np.concatenate(([0], np.cumsum(np.bincount(runs, minlength=(1 << self.bits)))))
        kept = np.zeros(self.n, bool)
        kept[::sample] = kept[starts] = True  # no walk passes a run's start
        self.sampled = kept[order]
        self.position = np.where(self.sampled, order, -1)[self.sampled]
        self.sample_rank = np.concatenate(([0], np.cumsum(self.sampled)))

    def search(self, symbols: np.ndarray, ends: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges [low, high) of the patterns, each the ``lens`` symbols of ``symbols`` before its end."""
        low, high = np.zeros(len(lens), np.int64), np.full(len(lens), self.n, np.int64)
        act, k = np.flatnonzero(lens > 0), 0
        while len(act):
            symbol = symbols[ends[act] - 1 - k].astype(np.int64)
            known = symbol < (1 << self.bits)
            high[act[~known]] = low[act[~known]]
            act, symbol = act[known], symbol[known]
            a, b = self.matrix.rank(symbol, low[act], high[act])
            low[act], high[act] = self.first[symbol] + a, self.first[symbol] + b
            k += 1
            act = act[(lens[act] > k) & (high[act] > low[act])]
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions in the text of the suffixes of these rows, by steps back to a sampled one."""
        out = np.zeros(len(rows), np.int64)
        rows, steps, left = rows.copy(), 0, np.arange(len(rows))
        while len(left):
            at = rows[left]
            done = self.sampled[at]
            out[left[done]] = self.position[self.sample_rank[at[done]]] + steps
            left, at = left[~done], at[~done]
            symbol = self.bwt[at]
            rows[left] = self.first[symbol] + self.matrix.rank(symbol, at)[0]
            steps += 1
        return out

    def occurrences(self, symbols: np.ndarray, ends: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(pattern, position) of all occurrences of the patterns (see :meth:`search`)."""
        low, high = self.search(symbols, ends, lens)
        count = np.maximum(high - low, 0)
        rows = ragged(np.arange(self.n), low, count)
        return np.repeat(np.arange(len(lens)), count), self.locate(rows)
