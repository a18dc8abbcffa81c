"""Apply ranked merges to the distinct words of a batch, all words together.

Symbols are numbers and the merges a sorted array of pairs. In every round each word's pair of
best rank is merged wherever it occurs, from left to right, until no word has a pair with a rank.
Words of more than ``LONG`` symbols are merged one by one, over the places of each rank.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa

from molcorpus.operators.matcher import code_points

LONG = 512
NONE = np.int64(1) << 40


class Merges:
    """``pairs`` by rank (of equal ones the first counts); characters outside ``letters`` are
    dropped."""

    def __init__(self, pairs: list[tuple[str, str]], letters: list[str]):
        names = dict.fromkeys([*letters, *(s for a, b in pairs for s in (a, b, a + b))])
        number = {s: i for i, s in enumerate(names)}
        self.names = pa.array(list(names), pa.string())
        self.width = max(len(names), 1)
        keys = np.array([number[a] * self.width + number[b] for a, b in pairs], np.int64)
        self.keys, self.rank = np.unique(keys, return_index=True)
        self.merged = np.array([number[a + b] for a, b in pairs], np.int64)
        points = sorted((ord(c), number[c]) for c in set(letters) if len(c) == 1)
        self.points, self.letters = (np.array([p[i] for p in points], np.int64) for i in (0, 1))

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(left), NONE)
        keys = left * self.width + right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.rank[at], NONE)

    def spelled(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The symbols of all words, and the word of each."""
        points, at = code_points(words)
        word = np.repeat(np.arange(len(words)), np.diff(at))
        if not len(self.points):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        found = np.minimum(np.searchsorted(self.points, points), len(self.points) - 1)
        known = self.points[found] == points
        return self.letters[found[known]], word[known]

    def fold(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The symbols of all words after merging, and the first place of each word."""
        ids, word = self.spelled(words)
        size = np.bincount(word, minlength=len(words))
        done: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, np.int64), np.empty(0, np.int64))]
        first = np.concatenate([[0], np.cumsum(size)])
        for i in np.flatnonzero(size > LONG).tolist():
            one = self.fold_long(ids[first[i] : first[i + 1]])
            done.append((np.full(len(one), i), one))
        short = size[word] <= LONG
        done.append(self.fold_short(ids[short], word[short]))
        word, ids = (np.concatenate(p) for p in zip(*done))
        order = np.argsort(word, kind="stable")
        return ids[order], np.concatenate([[0], np.cumsum(np.bincount(word, minlength=len(words)))])

    def fold_short(self, ids: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        words, symbols = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        rank = np.full(len(ids), NONE)
        rank[:-1] = np.where(word[:-1] == word[1:], self.ranks(ids[:-1], ids[1:]), NONE)
        while len(ids):
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            best = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.append(first, len(ids))))
            over = best == NONE
            if over.any():
                words.append(word[over])
                symbols.append(ids[over])
                ids, word, rank, best = ids[~over], word[~over], rank[~over], best[~over]
                if not len(ids):
                    break
            at = np.flatnonzero(rank == best)
            # a doubled symbol overlaps itself: of places in a row every other one
            begins = np.append(True, at[1:] != at[:-1] + 1)
            inside = np.arange(len(at)) - np.maximum.accumulate(np.where(begins, np.arange(len(at)), 0))
            at = at[inside % 2 == 0]
            ids[at] = self.merged[rank[at]]
            stays = np.ones(len(ids), bool)
            stays[at + 1] = False
            at = (np.cumsum(stays) - 1)[at]
            ids, word, rank = ids[stays], word[stays], rank[stays]
            near = np.union1d(at, at[at > 0] - 1)
            rank[near] = NONE
            near = near[near < len(ids) - 1]
            near = near[word[near] == word[near + 1]]
            rank[near] = self.ranks(ids[near], ids[near + 1])
        return np.concatenate(words), np.concatenate(symbols)

    def fold_long(self, ids: np.ndarray) -> np.ndarray:
        """One word: ranks from a queue, each with the places where its pair was seen."""
        if not hasattr(self, "table"):
            self.table = dict(zip(self.keys.tolist(), self.rank.tolist()))
        width, table, merged = self.width, self.table, self.merged.tolist()
        found = self.ranks(ids[:-1], ids[1:])
        at = np.flatnonzero(found != NONE)
        order = np.argsort(found[at], kind="stable")
        each, begins = np.unique(found[at][order], return_index=True)
        places = dict(zip(each.tolist(), (p.tolist() for p in np.split(at[order], begins[1:]))))
        queue = each.tolist()
        pairs = self.pairs_by_rank
        own = ids.tolist()
        after, before = [*range(1, len(own)), -1], list(range(-1, len(own) - 1))

        def see(i: int) -> None:
            j = after[i] if i >= 0 else -1
            if j >= 0 and (r := table.get(own[i] * width + own[j])) is not None:
                if r not in places:
                    places[r] = []
                    heapq.heappush(queue, r)
                places[r].append(i)

        while queue:
            r = heapq.heappop(queue)
            left, right = pairs[r]
            fresh = []
            for i in sorted(set(places.pop(r))):
                j = after[i]
                if own[i] != left or j < 0 or own[j] != right:
                    continue
                own[i], own[j], after[i] = merged[r], -1, after[j]
                if after[i] >= 0:
                    before[after[i]] = i
                fresh.append(i)
            for i in fresh:
                see(before[i])
                see(i)
        return np.array([x for x in own if x >= 0], np.int64)

    @property
    def pairs_by_rank(self) -> dict[int, tuple[int, int]]:
        if not hasattr(self, "_pairs"):
            self._pairs = {r: divmod(k, self.width) for k, r in zip(self.keys.tolist(), self.rank.tolist())}
        return self._pairs
