"""A run-length index of anchored byte segments: Burrows-Wheeler columns in runs, samples at the ends of runs, matching statistics.

Segments have an anchor of ``GRAM`` bytes and up to ``side`` bytes on each side of it. Only the suffixes that start at the anchor or at
most ``side`` bytes before it matter, since every string of ``GRAM + side`` bytes that holds the anchor starts there. They are sorted
by columns: column d holds the suffixes that start d bytes before the anchor, in lexicographic order, and its transform is the byte before
each. A stable partition of column d by these bytes is column d + 1, so the transform maps rows as the whole one does (LF mapping), no suffix is
ever compared byte by byte, and strings of one column alone can be equal.

Kept of a column are its runs of equal bytes: where each starts, where its first row lies in the next column, and the segments in its first and
last row (the samples). So repetitive segments cost few runs. Next to them stands the least document of the rows that share their first
``width`` bytes, by runs too.

Matching statistics are streamed: a pattern starts at the row of column 0 that shares most with its anchor and what follows, and goes left byte by byte.
Where the row's byte is the pattern's, both go on; else the nearest ends of runs of that byte, above and below, are compared with the pattern, and
the better one goes on. The length is that of the longest match with any segment, so ``width`` or more means that the string occurs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

GRAM = 20


def words_of(rows: np.ndarray) -> np.ndarray:
    """Rows of bytes as big-endian words, filled with zeros; they sort as the bytes do."""
    n = -(-rows.shape[1] // 8) * 8
    out = np.zeros((len(rows), n), np.uint8)
    out[:, : rows.shape[1]] = rows
    return out.view(">u8").astype(np.uint64)


def shared_length(a: np.ndarray, b: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """How many first bytes two matrices share row by row, at most ``limit``."""
    if not len(a):
        return np.zeros(0, np.int64)
    differ = a != b
    first = np.where(differ.any(1), differ.argmax(1), a.shape[1])
    return np.minimum(first, limit)


def starts_of(*keys: np.ndarray) -> np.ndarray:
    """Where rows start another value of any key."""
    out = np.zeros(len(keys[0]), bool)
    out[:1] = True
    for k in keys:
        out[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(out)


class Column:
    """Runs of one column. ``char`` is -1 where a segment starts; ``first`` and ``last`` are the samples."""

    def __init__(self, order: np.ndarray, char: np.ndarray, target: np.ndarray):
        self.start = starts_of(char)
        self.char = char[self.start]
        self.target = target[self.start]
        self.size = np.diff(np.append(self.start, len(order)))
        self.first, self.last = order[self.start], order[self.start + self.size - 1]
        self.by_char = np.argsort(self.char, kind="stable")
        self.keys = (self.char[self.by_char].astype(np.int64) + 1) * len(self.start) + self.by_char

    def near(self, run: np.ndarray, char: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The last run of ``char`` before each run and the first one after it; -1 where there is none."""
        n = len(self.start)
        at = np.searchsorted(self.keys, (char.astype(np.int64) + 1) * n + run)
        above, below = self.by_char[np.maximum(at - 1, 0)], self.by_char[np.minimum(at, n - 1)]
        return np.where((at > 0) & (self.char[above] == char), above, -1), np.where((at < n) & (self.char[below] == char), below, -1)


class RunIndex:
    """Of segments ``rows`` (anchors at byte ``side``, zeros outside), with ``left`` and ``right`` bytes around the anchor, and their documents."""

    def __init__(self, rows: np.ndarray, left: np.ndarray, right: np.ndarray, docs: np.ndarray, side: int):
        self.rows, self.right, self.side = rows, right.astype(np.int64), side
        tail = words_of(rows[:, side:])
        base = np.lexsort((self.right, *tail.T[::-1]))
        self.base, self.tail = base, tail[base]
        limit = GRAM + np.minimum(self.right[base[1:]], self.right[base[:-1]])
        common = np.concatenate([[-1], shared_length(rows[base[1:], side:], rows[base[:-1], side:], limit)])
        self.columns: list[Column] = []
        self.least: list[tuple[np.ndarray, np.ndarray]] = []
        order, before, after = base, np.zeros(len(rows), np.int64), np.empty(len(rows), np.int64)
        for d in range(side + 1):
            after[base] = np.cumsum(common < GRAM + side - d)
            whole = np.flatnonzero(self.right[order] >= side - d)
            own = order[whole]
            if len(own):
                first = starts_of(before[own], after[own])
                least = np.minimum.reduceat(docs[own], first)
                change = starts_of(least)
                self.least.append((whole[first[change]], least[change]))
            else:
                self.least.append((np.zeros(0, np.int64), np.zeros(0, np.int64)))
            if d == side:
                break
            char = np.where(left[order] > d, rows[order, side - 1 - d].astype(np.int16), np.int16(-1))
            go = np.flatnonzero(char >= 0)
            go = go[np.argsort(char[go].astype(np.uint8), kind="stable")]
            target = np.full(len(order), -1)
            target[go] = np.arange(len(go))
            self.columns.append(Column(order, char, target))
            if not len(go):
                break
            group = np.zeros(len(go), np.int64)
            group[starts_of(char[go], before[order[go]])[1:]] = 1
            order = order[go]
            before[order] = np.cumsum(group)

    def runs(self) -> int:
        return sum(len(c.start) for c in self.columns)

    def _lengths(self, rows: np.ndarray, right: np.ndarray, of: np.ndarray, d: int) -> np.ndarray:
        a = self.side - d
        return shared_length(rows[:, a:], self.rows[of, a:], d + GRAM + np.minimum(right, self.right[of]))

    def _anchors(self, rows: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row of column 0, its segment, and the length shared with it, best for each pattern."""
        words, n = words_of(rows[:, self.side :]), len(self.base)
        low, high = np.zeros(len(rows), np.int64), np.full(len(rows), n)
        while (open_ := np.flatnonzero(low < high)).size:
            middle = (low[open_] + high[open_]) // 2
            a, b = self.tail[middle], words[open_]
            differ = a != b
            at = differ.argmax(1)
            pick = np.arange(len(at))
            shorter = ~differ[pick, at] & (self.right[self.base[middle]] < right[open_])
            less = shorter | (differ[pick, at] & (a[pick, at] < b[pick, at]))
            low[open_[less]] = middle[less] + 1
            high[open_[~less]] = middle[~less]
        above, below = np.maximum(low - 1, 0), np.minimum(low, n - 1)
        lengths = [self._lengths(rows, right, self.base[x], 0) for x in (above, below)]
        row = np.where(lengths[0] > lengths[1], above, below)
        return row, self.base[row], np.maximum(*lengths)

    def stream(self, rows: np.ndarray, left: np.ndarray, right: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(d, pattern, length of the longest match, row) of each column: the matching statistics."""
        right = right.astype(np.int64)
        live = np.arange(len(rows))
        if not len(live) or not len(self.rows):
            return
        row, of, length = self._anchors(rows, right)
        for d in range(self.side + 1):
            yield d, live, length, row
            if d >= len(self.columns):
                return
            go = np.flatnonzero(left[live] > d)
            if not len(go):
                return
            live, row, of, length = live[go], row[go], of[go], length[go]
            column = self.columns[d]
            char = rows[live, self.side - 1 - d].astype(np.int16)
            run = np.searchsorted(column.start, row, side="right") - 1
            next_row, next_length = column.target[run] + row - column.start[run], length + 1
            jump = np.flatnonzero(column.char[run] != char)
            if len(jump):
                who = live[jump]
                above, below = column.near(run[jump], char[jump])
                far = [np.where(x >= 0, self._lengths(rows[who], right[who], s[x], d), -1) for x, s in ((above, column.last), (below, column.first))]
                up = far[0] > far[1]
                there = np.where(up, above, below)
                next_row[jump] = column.target[there] + np.where(up, column.size[there] - 1, 0)
                of[jump] = np.where(up, column.last[there], column.first[there])
                next_length[jump] = np.maximum(*far) + 1
                lost = jump[np.maximum(*far) < 0]  # no segment has this byte here: any row, nothing shared
                if len(lost):
                    if d + 1 >= len(self.columns):
                        keep = np.ones(len(live), bool)
                        keep[lost] = False
                        live, next_row, of, next_length = live[keep], next_row[keep], of[keep], next_length[keep]
                    else:
                        next_row[lost], of[lost], next_length[lost] = 0, self.columns[d + 1].first[0], 0
            row, length = next_row, next_length

    def long_matches(self, rows: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pattern, d, least document) of every whole string of ``GRAM + side`` bytes of the patterns that a segment has."""
        width, found = GRAM + self.side, []
        for d, who, length, row in self.stream(rows, left, right):
            hit = np.flatnonzero(length >= width)
            if len(hit):
                start, least = self.least[d]
                found.append((who[hit], np.full(len(hit), d), least[np.searchsorted(start, row[hit], side="right") - 1]))
        if not found:
            return (np.zeros(0, np.int64),) * 3
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))
