"""Longest matches of a vocabulary, by a double-array trie of flat integers.

The tokens are a trie over their characters; its nodes lie in slots of two arrays, so that the
child of a node by a character is at ``base[node] + code`` if ``check`` there names the node. The
arrays are built once, shipped once, and walked by Arrow functions over the distinct strings of a
batch: short strings all together, one character a step, long ones one after another. Neither
the number nor the length of the tokens shows in the plan, and nothing recurses.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# Strings of more characters are cut one by one.
LONG = 1024
# Strings that are walked together.
TOGETHER = 8192
# Places that are tried for the children of a node before the free end is taken.
TRIES = 64


def code_points(strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The characters of all strings as numbers, and the first place of each string."""
    sizes = np.fromiter(map(len, strings), np.int64, len(strings))
    raw = "".join(strings).encode("utf-32-le", "surrogatepass")
    return np.frombuffer(raw, np.uint32).astype(np.int64), np.concatenate([[0], np.cumsum(sizes)])


@dataclass
class Trie:
    """Slots ``base``, ``check`` and ``value`` (the number of the token that ends there, or -1);
    the first ``roots`` slots after the margin are roots. ``letters`` are the characters in use."""

    base: np.ndarray
    check: np.ndarray
    value: np.ndarray
    letters: np.ndarray
    first: int

    @classmethod
    def build(cls, groups: list[list[str]]) -> Trie:
        """One root per group of tokens; tokens are numbered through all groups. Of a token that
        is there twice the first counts; empty tokens match nothing."""
        tokens = [t for group in groups for t in group]
        root = np.repeat(np.arange(len(groups)), [len(g) for g in groups])
        points, at = code_points(tokens)
        letters = np.unique(points)
        codes = np.searchsorted(letters, points) + 1
        width = len(letters) + 1
        # level by level: a node is a parent and a code; longer tokens come first
        order = np.argsort(-(at[1:] - at[:-1]), kind="stable")
        size = (at[1:] - at[:-1])[order]
        start, node, number = at[:-1][order], root[order].copy(), order
        n, parents, labels, ends = len(groups), [], [], []
        for depth in range(int(size[0]) if len(size) else 0):
            here = int(np.searchsorted(-size, -depth, "left"))  # tokens longer than the depth
            key = node[:here] * width + codes[start[:here] + depth]
            made, which = np.unique(key, return_inverse=True)
            parents.append(made // width)
            labels.append(made % width)
            node[:here] = n + which
            n += len(made)
            done = np.flatnonzero(size[:here] == depth + 1)
            ends.append((node[done], number[done]))
        parent = np.concatenate([np.full(len(groups), -1), *parents]).astype(np.int64)
        label = np.concatenate([np.zeros(len(groups)), *labels]).astype(np.int64)
        value = np.full(n, -1, np.int64)
        for nodes, numbers in reversed(ends):
            turn = np.argsort(-numbers, kind="stable")
            value[nodes[turn]] = numbers[turn]
        return cls.placed(parent, label, value, letters, len(groups))

    @classmethod
    def placed(cls, parent: np.ndarray, label: np.ndarray, value: np.ndarray, letters: np.ndarray, roots: int) -> Trie:
        """Slots for the nodes. Children of one parent follow each other, by rising label."""
        n, margin = len(parent), len(letters) + 1
        count = np.bincount(parent[roots:], minlength=n)
        child = np.zeros(n, np.int64)
        child[parent[roots:][::-1]] = np.arange(roots, n)[::-1]
        taken = bytearray(b"\1" * roots + bytes(n + margin))
        base = np.zeros(n, np.int64)
        many = np.flatnonzero(count > 1)
        many = many[np.argsort(-count[many], kind="stable")]
        cursor, end = roots, roots
        for p in many.tolist():
            own = label[child[p] : child[p] + count[p]].tolist()
            head, rest = own[0], [x - own[0] for x in own[1:]]
            cursor = taken.find(0, cursor)
            place = cursor
            for _ in range(TRIES):
                if place < 0 or place + rest[-1] >= len(taken):
                    place = -1
                    break
                if not any(taken[place + r] for r in rest):
                    break
                place = taken.find(0, place + 1)
            else:
                place = -1
                cursor = min(cursor + 1, end)
            if place < 0:
                place = end
            if place + rest[-1] >= len(taken):
                taken.extend(bytes(len(taken) + rest[-1]))
            taken[place] = 1
            for r in rest:
                taken[place + r] = 1
            end = max(end, place + rest[-1] + 1)
            base[p] = place - head
        single = np.flatnonzero(count == 1)
        free = np.flatnonzero(np.frombuffer(bytes(taken), np.uint8) == 0)
        if len(free) < len(single):
            free = np.concatenate([free, len(taken) + np.arange(len(single) - len(free))])
        base[single] = free[: len(single)] - label[child[single]]
        # a margin on both sides, so that no step leaves the arrays
        base += margin
        slot = np.empty(n, np.int64)
        slot[:roots] = margin + np.arange(roots)
        slot[roots:] = base[parent[roots:]] + label[roots:]
        total = int(max(slot.max(), base.max())) + margin + 1
        out = cls(np.zeros(total, np.int32), np.full(total, -1, np.int32), np.full(total, -1, np.int32), letters, margin)
        out.base[slot], out.value[slot] = base, value
        out.check[slot[roots:]] = slot[parent[roots:]]
        return out

    def codes(self, points: np.ndarray) -> np.ndarray:
        """Codes of characters; 0 for those no token has."""
        if not len(self.letters):
            return np.zeros(len(points), np.int64)
        at = np.minimum(np.searchsorted(self.letters, points), len(self.letters) - 1)
        return np.where(self.letters[at] == points, at + 1, 0)

    def cut(self, strings: list[str], going_on: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of the longest tokens from the left, -1 for a character that starts none,
        of all strings laid end to end, and the first place of each string. After the first token
        of a string the root ``going_on`` is used."""
        points, at = code_points(strings)
        codes = self.codes(points)
        size = at[1:] - at[:-1]
        order = np.argsort(size, kind="stable")
        short = order[: int(np.searchsorted(size[order], LONG, "right"))]
        found = [self._together(codes, at, part, going_on) for part in np.array_split(short, len(short) // TOGETHER + 1)]
        for i in order[len(short) :].tolist():
            one = self._alone(codes[at[i] : at[i + 1]], going_on)
            found.append((np.full(len(one), i), one))
        who, what = (np.concatenate(p) for p in zip(*found))
        sort = np.argsort(who, kind="stable")
        return what[sort], np.concatenate([[0], np.cumsum(np.bincount(who, minlength=len(strings)))])

    def _together(self, codes: np.ndarray, at: np.ndarray, rows: np.ndarray, going_on: int) -> tuple[np.ndarray, np.ndarray]:
        who, what = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        codes = np.append(codes, 0)
        rows = rows[at[rows + 1] > at[rows]]
        place, end = at[rows].copy(), at[rows + 1]
        now, state = place.copy(), np.full(len(rows), self.first)
        best, upto = np.full(len(rows), -1), place.copy()
        while len(rows):
            to = self.base[state] + codes[now]
            hit = (now < end) & (self.check[to] == state)
            state, now = np.where(hit, to, state), now + hit
            ends = hit & (self.value[to] >= 0)
            best, upto = np.where(ends, self.value[to], best), np.where(ends, now, upto)
            if hit.all():
                continue
            miss = np.flatnonzero(~hit)
            who.append(rows[miss])
            what.append(best[miss])
            place[miss] = np.where(best[miss] >= 0, upto[miss], place[miss] + 1)
            now[miss], state[miss], best[miss] = place[miss], self.first + going_on, -1
            over = miss[place[miss] >= end[miss]]
            if len(over):
                stays = np.ones(len(rows), bool)
                stays[over] = False
                rows, place, end, now, state, best, upto = (x[stays] for x in (rows, place, end, now, state, best, upto))
        return np.concatenate(who), np.concatenate(what)

    def _alone(self, codes: np.ndarray, going_on: int) -> np.ndarray:
        base, check, value = memoryview(self.base), memoryview(self.check), memoryview(self.value)
        listed, out, place, root = codes.tolist(), [], 0, self.first
        while place < len(listed):
            state, best, upto = root, -1, place + 1
            for now in range(place, len(listed)):
                to = base[state] + listed[now]
                if check[to] != state:
                    break
                state = to
                if value[to] >= 0:
                    best, upto = value[to], now + 1
            out.append(best)
            place, root = upto, self.first + going_on
        return np.array(out, np.int64)


def offsets(lists: pa.Array) -> pa.Array:
    """Where each list begins in all entries laid end to end; null lists are empty."""
    ends = pc.cumulative_sum(pc.fill_null(pc.list_value_length(lists), 0).cast(pa.int32()))
    return pa.concat_arrays([pa.array([0], pa.int32()), ends])


def listed(flat: np.ndarray, places: np.ndarray, names: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(places.astype(np.int32)), names.take(pa.array(flat)))


def over_distinct(batch: pa.Array, work: Callable[[list[str]], pa.ListArray]) -> pa.Array:
    """A list for every string of an array of lists of strings, each distinct string once; null
    strings and lists stay null."""
    flat = batch.flatten()
    coded = flat.dictionary_encode()
    found = work(coded.dictionary.to_pylist()).take(coded.indices)
    return pa.ListArray.from_arrays(offsets(batch), found, mask=batch.is_null())


def longest_match(tokens: list[str], unknown: str) -> Callable[[Column], Column]:
    """From arrays of texts to arrays of token lists: from each place the longest token; a
    character that starts none becomes ``unknown``."""
    shared = SparkSession.active().sparkContext.broadcast((Trie.build([tokens]), pa.array([*tokens, unknown], pa.string())))

    def match(batch: pa.Array) -> pa.Array:
        trie, names = shared.value

        def work(strings: list[str]) -> pa.ListArray:
            flat, places = trie.cut(strings)
            return listed(np.where(flat < 0, len(names) - 1, flat), places, names)

        return over_distinct(batch, work)

    return F.arrow_udf(match, "array<array<string>>")


def wordpiece(tokens: list[str], mark: str, unknown: str, longest_word: int) -> Callable[[Column], Column]:
    """From arrays of word lists to arrays of token lists: each word as its longest first piece
    and its longest pieces going on (named with ``mark``); a word that does not come out even, is
    null or empty, or has more characters than ``longest_word``, is ``unknown``."""
    first = [t for t in tokens if not t.startswith(mark)]
    going_on = [t[len(mark) :] for t in tokens if t.startswith(mark)]
    names = pa.array([*first, *(mark + t for t in going_on), unknown], pa.string())
    shared = SparkSession.active().sparkContext.broadcast((Trie.build([first, going_on]), names))

    def cut(batch: pa.Array) -> pa.Array:
        trie, names = shared.value
        texts = batch.flatten()

        def work(strings: list[str]) -> pa.ListArray:
            kept = [s if len(s) <= longest_word else "" for s in strings]
            flat, places = trie.cut(kept, going_on=1)
            count = np.diff(places)
            word = np.repeat(np.arange(len(kept)), count)
            bad = count == 0
            bad[word[flat < 0]] = True
            count[bad] = 1
            starts = np.concatenate([[0], np.cumsum(count)])
            out = np.empty(starts[-1], np.int64)
            out[np.repeat(bad, count)] = len(names) - 1
            out[~np.repeat(bad, count)] = flat[~bad[word]]
            return listed(out, starts, names)

        words = pc.fill_null(texts.flatten(), "").dictionary_encode()
        pieces = work(words.dictionary.to_pylist()).take(words.indices)
        upto = offsets(pieces).to_numpy()
        of_texts = pa.array(upto[offsets(texts).to_numpy()], pa.int32())
        found = pa.ListArray.from_arrays(of_texts, pieces.flatten(), mask=texts.is_null())
        return pa.ListArray.from_arrays(offsets(batch), found, mask=batch.is_null())

    return F.arrow_udf(cut, "array<array<string>>")
