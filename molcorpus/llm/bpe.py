"""Byte-level BPE: encoding by ranked merges over distinct words, decoding by concatenation.

A text is cut by the vocabulary's pattern; the distinct words of a chunk of texts are encoded
once. A word that is itself a token is that token; else its bytes are merged, at each step the
leftmost pair of lowest rank, until no pair has a rank. All words of one length are folded
together, as rows of a matrix of ids, one merge per word and step. Words of more than
``LONG_WORD`` bytes are merged one by one over a queue of pairs. Decoding looks up the bytes of
every id and concatenates them.

``fold_column`` states the same fold as Spark higher-order functions over a literal rank map; it
gives the same ids but needs some 300 microseconds a word, so ``encode`` does not use it (see
README).

Null and empty texts have no token and the digest of nothing. Every row gives a row, repeated or
without a key as well; other columns than those named are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from molcorpus.llm.text import M1, chunks, list_column

LONG_WORD = 64
SLOTS = 1 << 20
NONE = np.int32(2**31 - 1)


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a public vocabulary file; an error if it lacks a byte."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, lines)}
    if any(bytes([b]) not in ranks for b in range(256)):
        raise ValueError("the vocabulary lacks single bytes")
    return ranks


class Merges:
    """The rank map, as a hash table of pairs of ids."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.width = max(ranks.values()) + 1
        self.pieces = [b""] * self.width
        for piece, rank in ranks.items():
            self.pieces[rank] = piece
        self.bytes = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = [
            (ranks[piece[:i]] * self.width + ranks[piece[i:]], rank)
            for piece, rank in ranks.items()
            for i in range(1, len(piece))
            if piece[:i] in ranks and piece[i:] in ranks
        ]
        keys = np.array([k for k, _ in pairs], np.int64)
        values = np.array([v for _, v in pairs], np.int32)
        self.slots = max(SLOTS, 1 << (4 * len(pairs)).bit_length())
        self.keys = np.full(self.slots, -1, np.int64)
        self.values = np.full(self.slots, NONE, np.int32)
        place, self.probes = self.slot(keys), 0
        rest = np.arange(len(keys))
        while len(rest):
            # of those that want a free slot one gets it, the others try the next
            self.probes += 1
            at = place[rest]
            free = self.keys[at] == -1
            got = rest[free]
            first = np.unique(at[free], return_index=True)[1]
            won = got[first]
            self.keys[place[won]], self.values[place[won]] = keys[won], values[won]
            lost = np.ones(len(keys), bool)
            lost[won] = False
            rest = rest[lost[rest]]
            place[rest] = (place[rest] + 1) % self.slots

    def slot(self, keys: np.ndarray) -> np.ndarray:
        shift = np.uint64(64 - self.slots.bit_length() + 1)
        return ((keys.astype(np.uint64) * M1) >> shift).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, which is the id it merges to."""
        keys = left * self.width + right
        at = self.slot(keys)
        found = np.where(self.keys[at] == keys, self.values[at], NONE)
        todo = np.flatnonzero((found == NONE) & (self.keys[at] != -1))
        for _ in range(self.probes):
            if not len(todo):
                break
            at[todo] = (at[todo] + 1) % self.slots
            same = self.keys[at[todo]] == keys[todo]
            found[todo[same]] = self.values[at[todo[same]]]
            todo = todo[~same & (self.keys[at[todo]] != -1)]
        return found

    def fold(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their number for a matrix of words of one length in bytes."""
        ids = self.bytes[words]
        n, width = ids.shape
        size = np.full(n, width)
        if width == 1:
            return ids, size
        ranks = self.rank(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(n, width - 1)
        rows = np.arange(n)
        done_ids, done_size = ids.copy(), size.copy()
        while len(rows):
            at = ranks.argmin(1)
            best = ranks[np.arange(len(rows)), at]
            over = best == NONE
            if over.any():
                done_ids[rows[over], : ids.shape[1]], done_size[rows[over]] = ids[over], size[over]
                keep = ~over
                rows, ids, ranks, size, at, best = (x[keep] for x in (rows, ids, ranks, size, at, best))
                if not len(rows):
                    break
            each = np.arange(len(rows))
            last = ids.shape[1] - 1
            # one id less: what follows the pair moves up
            ids[each, at] = best
            order = np.arange(last)[None, :] + (np.arange(last)[None, :] > at[:, None])
            ids = np.take_along_axis(ids, order, 1)
            size -= 1
            order = np.arange(max(last - 1, 0))[None, :] + (np.arange(max(last - 1, 0))[None, :] > at[:, None])
            ranks = np.take_along_axis(ranks, order, 1) if last > 1 else np.full((len(rows), 1), NONE)
            for place, there in ((at - 1, at > 0), (at, at < size - 1)):
                r = np.flatnonzero(there)
                p = place[r]
                ranks[r, p] = self.rank(ids[r, p], ids[r, p + 1])
            if last == 1:
                done_ids[rows, :1], done_size[rows] = ids, size
                break
        return done_ids, done_size

    def one(self, word: bytes) -> list[int]:
        """The ids of one long word: a queue of pairs over linked neighbours."""
        ids = self.bytes[np.frombuffer(word, np.uint8)].tolist()
        after = list(range(1, len(ids))) + [-1]
        before = list(range(-1, len(ids) - 1))
        pieces = [word[i : i + 1] for i in range(len(ids))]
        queue: list[tuple[int, int, bytes, bytes]] = []

        def push(i: int) -> None:
            if i >= 0 and after[i] >= 0:
                rank = self.ranks.get(pieces[i] + pieces[after[i]])
                if rank is not None:
                    heapq.heappush(queue, (rank, i, pieces[i], pieces[after[i]]))

        for i in range(len(ids)):
            push(i)
        while queue:
            rank, i, left, right = heapq.heappop(queue)
            j = after[i]
            if j < 0 or pieces[i] is not left or pieces[j] is not right:
                continue
            ids[i], pieces[i], pieces[j] = rank, left + right, b""
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
            push(i)
            push(before[i])
        out, i = [], 0
        while i >= 0:
            out.append(ids[i])
            i = after[i]
        return out

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after another, and the first place of each."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        count = np.zeros(len(words), np.int64)
        parts: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        single: dict[int, list[int]] = {}
        whole = np.fromiter((self.ranks.get(w, -1) for w in words), np.int64, len(words))
        count[whole >= 0] = 1
        for size in np.unique(sizes[whole < 0]).tolist():
            rows = np.flatnonzero((sizes == size) & (whole < 0))
            if size > LONG_WORD:
                for r in rows.tolist():
                    single[r] = self.one(words[r])
                    count[r] = len(single[r])
                continue
            matrix = np.frombuffer(b"".join(words[r] for r in rows.tolist()), np.uint8).reshape(-1, size)
            ids, n = self.fold(matrix)
            count[rows] = n
            parts[size] = rows, ids, n
        places = np.concatenate([[0], np.cumsum(count)])
        flat = np.empty(places[-1], np.int64)
        flat[places[:-1][whole >= 0]] = whole[whole >= 0]
        for rows, ids, n in parts.values():
            for i in range(ids.shape[1]):
                has = n > i
                flat[places[rows[has]] + i] = ids[has, i]
        for r, ids in single.items():
            flat[places[r] : places[r + 1]] = ids
        return flat, places

    def decode(self, ids: list[int]) -> bytes:
        pieces = self.pieces
        return b"".join([pieces[i] for i in ids])


# The rank maps of this Python worker, by digest.
_loaded: dict[str, Merges] = {}


def gather(flat: np.ndarray, places: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lists ``which`` of lists laid end to end, laid end to end."""
    sizes = (places[1:] - places[:-1])[which]
    total = np.concatenate([[0], np.cumsum(sizes)])
    index = np.arange(total[-1]) + np.repeat(places[:-1][which] - total[:-1], sizes)
    return flat[index], total


def encode(
    docs: DataFrame, ranks: dict[bytes, int], pattern: str, key: str = "doc_id", text: str = "text",
    keep_ids: bool = True, keep: list[str] | None = None,
) -> DataFrame:
    """key, the columns ``keep``, n_tokens, ids (if kept), the digest of the ids joined by
    commas, the digest of the bytes that the ids decode to."""
    keep = keep or []
    shared = docs.sparkSession.sparkContext.broadcast(ranks)
    name = hashlib.sha256(repr(sorted(ranks.items())).encode()).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _loaded:
            _loaded[name] = Merges(shared.value)
        merges = _loaded[name]
        find = regex.compile(pattern).findall
        for part in chunks(batches, "_text"):
            found = [find(t) if t else [] for t in part.column("_text").to_pylist()]
            sizes = np.array([len(f) for f in found], np.int64)
            coded = pa.array([w for f in found for w in f], pa.string()).dictionary_encode()
            which = coded.indices.to_numpy().astype(np.int64)
            del found
            words = coded.dictionary.cast(pa.binary()).to_pylist()
            flat, places = merges.encode_words(words)
            ids_list = flat.tolist()
            bounds = places.tolist()
            spans = list(zip(bounds[:-1], bounds[1:]))
            texts = [",".join(map(str, ids_list[a:b])) for a, b in spans]
            back = [merges.decode(ids_list[a:b]) for a, b in spans]
            counts = places[1:] - places[:-1]
            places_of = np.concatenate([[0], np.cumsum(sizes)])
            n_tokens, hashed, decoded = [], [], []
            for a, b in zip(places_of[:-1], places_of[1:]):
                own = which[a:b]
                listed = own.tolist()
                n_tokens.append(int(counts[own].sum()))
                hashed.append(hashlib.sha256(",".join([texts[w] for w in listed]).encode()).hexdigest())
                decoded.append(hashlib.sha256(b"".join([back[w] for w in listed])).hexdigest())
            columns = [part.column(c) for c in (key, *keep)]
            names = [key, *keep, "n_tokens"]
            columns.append(pa.array(n_tokens, pa.int64()))
            if keep_ids:
                ids, _ = gather(flat, places, which)
                starts = np.concatenate([[0], np.cumsum(n_tokens)])
                columns.append(list_column(ids.astype(np.int32), starts, pa.int32()))
                names.append("ids")
            columns += [pa.array(hashed, pa.string()), pa.array(decoded, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [*names, "ids_sha256", "decoded_sha256"])

    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in (key, *keep))
    ids = "ids array<int>, " if keep_ids else ""
    schema = f"{fields}, n_tokens bigint, {ids}ids_sha256 string, decoded_sha256 string"
    return docs.select(key, *keep, F.col(text).alias("_text")).mapInArrow(run, schema)


def fold_column(word: Column, ranks: dict[bytes, int], slots: int = 1 << 16) -> Column:
    """The ids of a word by higher-order functions. Words are strings with one character per
    byte; the literal rank map is cut by crc32, since a map is searched from end to end."""
    table: list[dict[str, int]] = [{} for _ in range(slots)]
    for piece, rank in ranks.items():
        name = piece.decode("latin-1")
        table[zlib.crc32(name.encode()) % slots][name] = rank
    maps = F.from_json(F.lit(json.dumps(table)), "array<map<string,int>>")

    def rank_of(piece: Column) -> Column:
        return F.get(maps, F.crc32(F.encode(piece, "UTF-8")).bitwiseAND(F.lit(slots - 1)).cast("int")).getItem(piece)

    def step(state: Column, _: Column) -> Column:
        parts = state["parts"]
        n = F.size(parts)
        pairs = F.transform(
            F.slice(parts, 2, n), lambda x, i: F.struct(rank_of(F.concat(F.get(parts, i), x)).alias("r"), i.alias("i"))
        )
        best = F.array_min(F.filter(pairs, lambda e: e["r"].isNotNull()))

        def merge(old: Column, b: Column) -> Column:
            joined = F.array(F.concat(F.get(parts, b["i"]), F.get(parts, b["i"] + 1)))
            merged = F.concat(F.slice(parts, 1, b["i"]), joined, F.slice(parts, b["i"] + 3, n))
            return F.when(b.isNull(), old).otherwise(F.struct(merged.alias("parts"), F.lit(False).alias("done")))

        start = F.struct(parts.alias("parts"), F.lit(True).alias("done"))
        return F.when(state["done"], state).otherwise(F.aggregate(F.array(best), start, merge))

    start = F.struct(F.split(word, "").alias("parts"), F.lit(False).alias("done"))
    folded = F.aggregate(F.sequence(F.lit(1), F.length(word)), start, step)["parts"]
    whole = rank_of(word)
    return F.when(whole.isNotNull(), F.array(whole)).otherwise(F.transform(folded, rank_of))
