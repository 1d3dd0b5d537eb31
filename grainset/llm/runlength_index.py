"""A run-compressed Burrows-Wheeler index of a set of byte texts, and its matching statistics.

The transform is kept as runs; for each run only the text positions of its first and last
suffix are kept. The first suffix of run j follows the last one of run j-1 in suffix order,
and their common prefix is the only one that has to be compared: along a text, both the
neighbour and the common length of all other positions follow by stepping on from the
nearest sampled position before them.
"""

from __future__ import annotations

import numpy as np


def suffix_ranks(data: np.ndarray, ends: np.ndarray, longest: int) -> list[np.ndarray]:
    """Ranks of all suffixes by their first 8, 16, 32, ... bytes, the last level complete.

    Texts end at ``ends`` (exclusive) and each end is a distinct smallest symbol, so suffixes
    that reach an end within the compared length never tie.
    """
    n = len(data)
    text = np.repeat(np.arange(len(ends)), np.diff(np.concatenate([[0], ends])))
    left = ends[text] - np.arange(n)
    key = np.zeros(n, dtype=np.uint64)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    for i in range(8):
        byte = np.where(left > i, padded[i : i + n], 0).astype(np.uint64)
        key |= byte << np.uint64(56 - 8 * i)
    short = np.where(left < 8, left, 8).astype(np.int64)
    # Same eight bytes: a suffix that ends earlier is smaller; ends tell texts apart.
    order = np.lexsort((np.where(left < 8, text, 0), short, key))
    k, s, t = key[order], short[order], text[order]
    new = np.ones(n, dtype=bool)
    new[1:] = (k[1:] != k[:-1]) | (s[1:] != s[:-1]) | ((s[1:] < 8) & (t[1:] != t[:-1]))
    ranks = [np.empty(n, dtype=np.int32)]
    ranks[0][order] = np.cumsum(new) - 1
    h, texts = 8, len(ends)
    while h < longest:
        rank = ranks[-1].astype(np.int64)
        after = np.arange(n) + h
        inside = left > h
        second = np.where(inside, rank[np.minimum(after, n - 1)] + texts, text)
        both = rank * (n + texts + 1) + second
        order = np.argsort(both, kind="stable")
        b = both[order]
        new = np.ones(n, dtype=bool)
        new[1:] = b[1:] != b[:-1]
        nxt = np.empty(n, dtype=np.int32)
        nxt[order] = np.cumsum(new) - 1
        ranks.append(nxt)
        h *= 2
    return ranks


class RunLengthIndex:
    """Runs of the transform with sampled run ends; ``links`` streams the texts through it."""

    def __init__(self, data: np.ndarray, ends: np.ndarray):
        self.data, self.ends, self.n = data, ends, len(data)
        longest = int(np.diff(np.concatenate([[0], ends])).max()) if len(ends) else 0
        ranks = suffix_ranks(data, ends, longest)
        order = np.empty(self.n, dtype=np.int64)
        order[ranks[-1]] = np.arange(self.n)
        begins = np.zeros(self.n, dtype=bool)
        begins[np.concatenate([[0], ends[:-1]])] = True
        # The symbol before a text's first byte is that of an end: a run of its own.
        symbol = np.where(begins[order], -1, data[order - 1].astype(np.int16))
        head = np.ones(self.n, dtype=bool)
        head[1:] = (symbol[1:] != symbol[:-1]) | (symbol[1:] < 0)
        start = np.flatnonzero(head)
        self.run_symbol = symbol[start]
        self.run_start = start
        self.first_sample = order[start]
        self.last_sample = order[np.concatenate([start[1:], [self.n]]) - 1]
        pos = self.first_sample[1:]
        other = self.last_sample[:-1]
        common = self._common(pos, other, ranks)
        by = np.argsort(pos)
        # The smallest suffix has no neighbour before it: it links to itself with length 0.
        self.sample_pos = np.concatenate([[-1], pos[by]])
        self.sample_other = np.concatenate([[-1], other[by]])
        self.sample_len = np.concatenate([[0], common[by]])
        lone = int(order[0])
        at = int(np.searchsorted(self.sample_pos, lone))
        self.sample_pos = np.insert(self.sample_pos, at, lone)
        self.sample_other = np.insert(self.sample_other, at, lone)
        self.sample_len = np.insert(self.sample_len, at, 0)

    def _common(self, a: np.ndarray, b: np.ndarray, ranks: list[np.ndarray]) -> np.ndarray:
        """Common prefix lengths of suffix pairs, compared blockwise then bytewise."""
        size = np.zeros(len(a), dtype=np.int64)
        stop = np.minimum(self._left(a), self._left(b))
        for level in range(len(ranks) - 1, -1, -1):
            step = 8 << level
            while True:
                ok = size + step <= stop
                x, y = np.where(ok, a + size, 0), np.where(ok, b + size, 0)
                ok &= ranks[level][x] == ranks[level][y]
                if not ok.any():
                    break
                size[ok] += step
        for _ in range(8):
            ok = size < stop
            x, y = np.where(ok, a + size, 0), np.where(ok, b + size, 0)
            ok &= self.data[x] == self.data[y]
            if not ok.any():
                break
            size[ok] += 1
        return size

    def _left(self, pos: np.ndarray) -> np.ndarray:
        return self.ends[np.searchsorted(self.ends, pos, "right")] - pos

    @property
    def runs(self) -> int:
        return len(self.run_start)

    def matching(self, pos: np.ndarray):
        """(length, place) of the match of each suffix with its neighbour in suffix order."""
        j = np.searchsorted(self.sample_pos, pos, "right") - 1
        step = pos - self.sample_pos[j]
        return np.maximum(self.sample_len[j] - step, 0), self.sample_other[j] + step

    def classes(self, pos: np.ndarray, length: int) -> np.ndarray:
        """A label for each position, equal where the next ``length`` bytes are equal."""
        size, place = self.matching(pos)
        parent = np.arange(self.n, dtype=np.int64)
        on = size >= length
        parent[pos[on]] = place[on]
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                return parent[pos]
            parent = up
