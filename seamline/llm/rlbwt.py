"""A run-length Burrows-Wheeler index over some texts, and matching statistics streamed through it.

Only runs are kept: their first rows, where the last-to-first mapping takes them, and the suffixes
at both of their ends. Going leftwards through a text, its row moves by the mapping; the neighbours
above and below it move along while they stay in its run, and otherwise come from the sampled end
of the nearest run of the same character. The longer of the two common extensions is the length
of the longest match that starts elsewhere.
"""

from __future__ import annotations

import numpy as np

#: Steps of one lane; lanes run side by side.
LANE = 128


class RunIndex:
    """Index over ``pieces``; matches never run over a piece's end."""

    def __init__(self, pieces: list[bytes], most: int):
        count, self.most = len(pieces), most
        size = np.array([len(p) + 1 for p in pieces], np.int64)
        self.last = np.cumsum(size) - 1
        n = self.n = int(size.sum())
        text = np.frombuffer(b"\0".join([*pieces, b""]), np.uint8)
        sym = text.astype(np.int64) + count
        sym[self.last] = np.arange(count)
        self.left_over = (np.repeat(self.last, size) - np.arange(n)).astype(np.int32)
        self.words = np.lib.stride_tricks.as_strided(np.frombuffer(text.tobytes() + b"\0" * 16, np.uint64, 1), (n + 8,), (1,))
        sa, isa = self._suffixes(sym, count + 256)
        before = sym[sa - 1]
        starts = self.starts = np.flatnonzero(np.r_[True, before[1:] != before[:-1]])
        lengths = np.diff(np.r_[starts, n])
        self.ends = starts + lengths - 1
        self.first_suffix, self.last_suffix = sa[starts], sa[self.ends]
        heads = before[starts]
        order = np.argsort(heads, kind="stable")
        self.to = np.empty(len(starts), np.int64)
        self.to[order] = np.cumsum(lengths[order]) - lengths[order]
        same = heads[order][1:] == heads[order][:-1]
        self.previous, self.following = np.full(len(starts), -1), np.full(len(starts), -1)
        self.previous[order[1:][same]] = order[:-1][same]
        self.following[order[:-1][same]] = order[1:][same]
        begin = np.unique(np.r_[self.last, np.arange(LANE, n, LANE)])
        row = isa[begin]
        self.lanes = begin, row, np.where(row > 0, sa[row - 1], -1), np.where(row < n - 1, sa[np.minimum(row + 1, n - 1)], -1)

    @staticmethod
    def _suffixes(sym: np.ndarray, symbols: int) -> tuple[np.ndarray, np.ndarray]:
        """Suffix array and its inverse by prefix doubling."""
        n, bits = len(sym), int(symbols).bit_length()
        depth = 62 // bits
        key, padded = np.zeros(n, np.int64), np.r_[sym, np.zeros(depth, np.int64)]
        for i in range(depth):
            key = key << bits | padded[i : i + n]
        sa = np.argsort(key)
        s, rank = key[sa], np.empty(n, np.int64)
        del key, padded
        p = np.arange(n)
        while True:  # a rank is the row of its group's head; only groups of several rows are sorted again
            head = np.r_[True, s[1:] != s[:-1]]
            rank[sa[p]] = p[np.maximum.accumulate(np.where(head, np.arange(len(p)), 0))]
            p = p[~(head & np.r_[head[1:], True])]
            if not len(p):
                return sa, rank
            at = sa[p]
            key = rank[at] * (n + 1)
            inside = at + depth < n
            key[inside] += rank[at[inside] + depth] + 1
            order = np.argsort(key)
            sa[p], s = at[order], key[order]
            depth *= 2

    def extension(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common prefix of the suffixes at a and b, up to ``most``; 0 where b is -1."""
        room = np.where(b < 0, 0, np.minimum(np.minimum(self.left_over[a], self.left_over[b]), self.most))
        out = np.zeros(len(a), np.int64)
        at = np.flatnonzero(room > 0)
        while len(at):
            x = self.words[a[at] + out[at]] ^ self.words[b[at] + out[at]]
            with np.errstate(over="ignore"):
                low = x & (~x + np.uint64(1))
                same = np.where(x == 0, 8, (np.frexp(low.astype(np.float64))[1] - 1) // 8)
            out[at] += same
            at = at[(same == 8) & (out[at] < room[at])]
        return np.minimum(out, room)

    def longest_elsewhere(self) -> np.ndarray:
        """For each position of the joined pieces, the longest match with another start, up to ``most`` or more."""
        begin, row, above, below = (x.copy() for x in self.lanes)
        out = np.zeros(self.n, np.int32)
        stop = np.r_[-1, begin[:-1]]
        steps = begin - stop
        order = np.argsort(-steps, kind="stable")
        i, row, above, below, steps = begin[order], row[order], above[order], below[order], steps[order]
        up, down = self.extension(i, above), self.extension(i, below)
        out[i] = np.maximum(up, down)
        active = np.searchsorted(-steps, -np.arange(1, steps[0] + 1), "right") if len(steps) else []
        for step in range(1, len(active)):
            m = active[step]
            if not m:
                break
            r = np.searchsorted(self.starts, row[:m], "right") - 1
            edge = np.flatnonzero(row[:m] == self.starts[r])
            foot = np.flatnonzero(row[:m] == self.ends[r])
            for where, suffix, match, other, sample in ((edge, above, up, self.previous, self.last_suffix), (foot, below, down, self.following, self.first_suffix)):
                near = other[r[where]]
                new = np.where(near < 0, -1, sample[near])
                match[where] = self.extension(i[where], new)
                suffix[where] = new
                lost = where[near < 0]
                match[:m] += 1
                suffix[:m] -= 1
                match[lost] = 0
                suffix[lost] = -1
            row[:m] = self.to[r] + row[:m] - self.starts[r]
            i[:m] -= 1
            out[i[:m]] = np.maximum(up[:m], down[:m])
        return out
