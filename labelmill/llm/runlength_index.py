"""A run-length index of many short strings: suffix order, run-compressed Burrows-Wheeler transform, sampled run ends.

The transform of a repetitive collection has few runs of equal characters. Within a run the step to the character before
(LF) is linear, so that one start and one target for each run are the whole index; text positions are kept at run ends only and
are found elsewhere by walking to the next sample. Matching statistics are streamed from right to left, all strings at once.
"""

from __future__ import annotations

import numpy as np

_PACK = 7


def _sorted_keys(high: np.ndarray, low: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of pairs of numbers of ``bits`` bits, and their keys in it; if key and place fit into one number, plain numbers are sorted."""
    if 3 * bits > 64:
        key = (high << bits) + low
        order = np.argsort(key, kind="stable")
        return order, key[order]
    key = (high.astype(np.uint64) << np.uint64(2 * bits)) | (low.astype(np.uint64) << np.uint64(bits)) | np.arange(len(high), dtype=np.uint64)
    key.sort()
    return (key & np.uint64((1 << bits) - 1)).astype(np.int64), (key >> np.uint64(bits)).astype(np.int64)


def _firsts(values: np.ndarray) -> np.ndarray:
    """For each place in a sorted array the first place with the same value."""
    starts = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)
    return np.repeat(starts, np.diff(np.append(starts, len(values))))


class RunLengthIndex:
    """Index of ``strings``; ``span`` is the length from which a match counts as long."""

    def __init__(self, strings: list[bytes], span: int):
        self.span, self.count = span, len(strings)
        lengths = np.array([len(s) for s in strings], np.int64)
        self.ends = np.cumsum(lengths + 1) - 1  # where each string's separator stands
        self.lengths = lengths
        text = np.zeros(int(self.ends[-1]) + 1, np.int64)
        inside = np.ones(len(text), bool)
        inside[self.ends] = False
        text[inside] = np.frombuffer(b"".join(strings), np.uint8).astype(np.int64) + 1
        self.owner = np.repeat(np.arange(self.count), lengths + 1)
        order, same = self._suffix_order(text)
        self.rank_of_end = np.arange(self.count)
        self._compress(text, order)
        starts = np.flatnonzero(~same)
        self.class_starts = starts  # rows that share ``span`` characters stand together
        self.first_row = order
        self.size = len(text)

    def _suffix_order(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows in suffix order, and whether a row shares ``span`` characters with the one above; separators differ by place.

        A rank is the first row of all suffixes that are still equal; each round doubles the depth and sorts only those.
        """
        n = len(text)
        padded = np.concatenate([text, np.zeros(_PACK, np.int64)])
        key, alive = np.zeros(n, np.int64), np.ones(n, bool)
        for i in range(_PACK):
            symbol = padded[i : n + i] * alive
            alive &= padded[i : n + i] > 0
            key = key * 257 + symbol
        order = np.argsort(key)
        first = _firsts(key[order])
        rank = np.empty(n, np.int64)
        rank[order] = first
        cut = np.flatnonzero(~alive)  # these hold a separator: equal ones are told apart by their place
        by_place = cut[np.lexsort([cut, rank[cut]])]
        rank[by_place] += np.arange(len(cut)) - _firsts(rank[by_place])
        open_ = np.flatnonzero(alive)
        open_ = open_[np.bincount(rank, minlength=n)[rank[open_]] > 1]
        depth, half, shift = _PACK, None, 0
        while True:
            if half is None and 2 * depth >= self.span:
                # Two ranks of ``depth`` characters, laid over each other, say whether ``span`` characters are equal.
                half, shift = rank.copy(), self.span - depth
            if not len(open_):
                break
            by_key, key = _sorted_keys(rank[open_], rank[open_ + depth], n.bit_length())  # open suffixes are longer than ``depth``
            open_ = open_[by_key]
            old = rank[open_]
            first = _firsts(key)
            rank[open_] = old + first - _firsts(old)
            open_ = open_[np.bincount(first, minlength=len(first))[first] > 1]
            depth *= 2
        order = np.empty(n, np.int64)
        order[rank] = np.arange(n)
        if half is None:  # all suffixes differ within fewer characters
            return order, np.zeros(n, bool)
        half = np.concatenate([half, np.full(max(shift, 1), -1)])
        equal = np.zeros(n, bool)
        a, b = order[1:], order[:-1]
        equal[1:] = (half[a] == half[b]) & (half[a + shift] == half[b + shift]) & (half[a + shift] >= 0)
        return order, equal

    def _compress(self, text: np.ndarray, order: np.ndarray) -> None:
        last = text[order - 1]  # separators count as one character: no stream goes beyond them
        heads = np.flatnonzero(np.concatenate([[True], last[1:] != last[:-1]]))
        lengths = np.diff(np.append(heads, len(last)))
        chars = last[heads]
        by_char = np.argsort(chars, kind="stable")
        before = np.empty(len(heads), np.int64)
        before[by_char] = np.cumsum(lengths[by_char]) - lengths[by_char]
        self.heads, self.targets, self.chars = heads, before, chars
        self.run = np.repeat(np.arange(len(heads)), lengths)  # a chunk is small enough to know each row's run without a search
        self.samples = order[heads + lengths - 1]  # text positions at run ends

    def step(self, rows: np.ndarray) -> np.ndarray:
        """Rows of the suffixes that begin one character earlier."""
        run = self.run[rows]
        return self.targets[run] + rows - self.heads[run]

    def locate(self, row: int) -> int:
        """Text position of a row, from the nearest sampled run end."""
        walked, ends = 0, np.append(self.heads[1:], self.size) - 1
        while True:
            run = int(self.run[row])
            if row == ends[run]:
                return int(self.samples[run]) + walked
            if self.chars[run] == 0:
                return int(self.first_row[row]) + walked
            row, walked = int(self.targets[run] + row - self.heads[run]), walked + 1

    def long_matches(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(string, start)`` of all windows of ``span`` characters that also stand at an earlier place.

        ``places`` orders the text positions (separators included). All strings are streamed together from their ends.
        """
        earliest = np.minimum.reduceat(places[self.first_row], self.class_starts)
        earliest = np.repeat(earliest, np.diff(np.append(self.class_starts, self.size)))
        rows, live = self.rank_of_end.copy(), np.arange(self.count)
        found_string, found_start = [], []
        shortest = int(self.lengths.min())
        for walked in range(1, int(self.lengths.max()) + 1):
            if walked > shortest:
                longer = self.lengths[live] >= walked
                rows, live = rows[longer], live[longer]
            rows = self.step(rows)
            if walked >= self.span:
                at = self.ends[live] - walked
                known = earliest[rows] < places[at]
                found_string.append(live[known])
                found_start.append(self.lengths[live[known]] - walked)
        none = np.zeros(0, np.int64)
        return (np.concatenate(found_string), np.concatenate(found_start)) if found_string else (none, none)
