"""BPE over words with ends, encoded through a minimal acyclic transducer of frequent words.

A text is cut at the special tokens, normalised (canonical composition, lower case) and split into
words by the vocabulary's pattern; a word is the bytes of its characters, the last one marked as
the end. The most frequent words of the whole corpus (``size`` of them, of at most ``LONGEST``
bytes) are compiled, in sorted order, into a transducer with the fewest states: equal endings are
shared, and every word's token ids are pushed as far to its beginning as its neighbours allow.
The transducer is one file of flat arrays in the folder that ``spark.checkpoint.dir`` names; Spark
brings it to every executor, where all Python workers map the same pages. All distinct words of a
chunk walk through it together, one byte a step. Words it does not hold are merged exactly: in
each the leftmost pair of lowest rank, all words at once; words of more than ``LONGEST`` bytes one
by one over a queue of pairs. What is in the lexicon changes the speed only, never an id.

Decoding joins the strings of the ids by a space, as a tokenizer without a decoder does.

Null and empty texts, and those of white space only, have no token and the digest of nothing.
Every row gives a row, repeated or without a key as well; other columns, whatever their names,
are left out of the result. An empty table compiles an empty lexicon and gives an empty result.
Characters that Unicode 15.1 does not know yet count as neither letters nor digits.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from molcorpus.llm.text import chunks, list_column
from molcorpus.session import scratch_folder

LONGEST = 64
SIZE = 1 << 16
END = "</w>"
NONE = np.int64(1) << 40


def byte_characters() -> list[str]:
    """The printable character that stands for each byte: itself where it is printable in
    Latin-1, else the next free one from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = (b for b in range(256) if b not in printable)
    stands = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return [stands[b] for b in range(256)]


class Rules:
    """Tokens, merges, words and special tokens of a vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as lines:
            told = json.load(lines)
        model = told["model"]
        if model["type"] != "BPE" or model["end_of_word_suffix"] != END:
            raise ValueError("not a BPE vocabulary with word ends")
        ids = model["vocab"]
        self.special = {t["content"]: t["id"] for t in told["added_tokens"]}
        self.tokens = [""] * (max([*ids.values(), *self.special.values()]) + 1)
        for token, i in [*ids.items(), *self.special.items()]:
            self.tokens[i] = token
        letters = byte_characters()
        self.inside = np.array([ids[c] for c in letters], np.int64)
        self.last = np.array([ids[c + END] for c in letters], np.int64)
        self.width = len(self.tokens)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        merged = [ids[a + b] for a, b in pairs]
        if merged != sorted(set(merged)):
            raise ValueError("merges are expected in the order of their ids")
        keys = np.array([ids[a] * self.width + ids[b] for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.keys, self.merged = keys[order], np.array(merged, np.int64)[order]
        self.pattern = told["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.digest = hashlib.sha256(json.dumps([model["merges"], ids, self.special, self.pattern]).encode()).hexdigest()

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("find", "cut")}

    def words(self, text: str | None) -> list[str]:
        """The words of a text; a special token is a word of its own."""
        if not hasattr(self, "find"):
            self.find = regex.compile(self.pattern).findall
            self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, reverse=True))) + ")").split
        if not text:
            return []
        parts = self.cut(text) if self.special and any(s in text for s in self.special) else [text]
        found: list[str] = []
        for i, part in enumerate(parts):
            if i % 2:
                found.append(part)
            elif part:
                # the capital sigma has one small form, also where a word ends
                found += self.find(unicodedata.normalize("NFC", part).replace("Σ", "σ").lower())
        return found

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The id that each pair merges to, which is its rank; ``NONE`` if it does not."""
        if not len(self.keys):
            return np.full(len(left), NONE)
        keys = left * self.width + right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.merged[at], NONE)

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words one after another, and the first place of each."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        own = np.flatnonzero((sizes <= LONGEST) & (sizes > 0))
        flat = np.frombuffer(b"".join(words[i] for i in own.tolist()), np.uint8)
        ends = np.cumsum(sizes[own]) - 1
        ids = self.inside[flat]
        ids[ends] = self.last[flat[ends]]
        word = np.repeat(own, sizes[own])
        done: list[tuple[np.ndarray, np.ndarray]] = []
        rank = np.full(len(ids), NONE)
        rank[:-1] = np.where(word[:-1] == word[1:], self.rank(ids[:-1], ids[1:]), NONE)
        while len(ids):
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            best = np.minimum.reduceat(rank, first)
            each = np.repeat(best, np.diff(np.append(first, len(ids))))
            over = each == NONE
            if over.any():
                done.append((word[over], ids[over]))
                ids, word, rank, each = ids[~over], word[~over], rank[~over], each[~over]
                if not len(ids):
                    break
            at = np.flatnonzero(rank == each)
            at = at[np.append(True, word[at[1:]] != word[at[:-1]])]
            ids[at] = rank[at]
            stays = np.ones(len(ids), bool)
            stays[at + 1] = False
            at = (np.cumsum(stays) - 1)[at]
            ids, word, rank = ids[stays], word[stays], rank[stays]
            near = np.concatenate([at, at[at > 0] - 1])
            inner = near[near < len(ids) - 1]
            rank[near] = NONE
            inner = inner[word[inner] == word[inner + 1]]
            rank[inner] = self.rank(ids[inner], ids[inner + 1])
        for i in np.flatnonzero(sizes > LONGEST).tolist():
            got = np.array(self.merge_long(words[i]), np.int64)
            done.append((np.full(len(got), i), got))
        if not done:
            return np.empty(0, np.int64), np.zeros(len(words) + 1, np.int64)
        word, ids = (np.concatenate(p) for p in zip(*done))
        order = np.argsort(word, kind="stable")
        return ids[order], np.concatenate([[0], np.cumsum(np.bincount(word, minlength=len(words)))])

    def merge_long(self, word: bytes) -> list[int]:
        """The ids of one long word: a queue of pairs over linked neighbours."""
        if not hasattr(self, "pairs"):
            self.pairs = dict(zip(self.keys.tolist(), self.merged.tolist()))
        raw = np.frombuffer(word, np.uint8)
        ids = [*self.inside[raw[:-1]].tolist(), int(self.last[raw[-1]])]
        after, before = [*range(1, len(ids)), -1], list(range(-1, len(ids) - 1))
        queue: list[tuple[int, int, int, int]] = []

        def push(i: int) -> None:
            if i >= 0 and after[i] >= 0:
                left, right = ids[i], ids[after[i]]
                to = self.pairs.get(left * self.width + right)
                if to is not None:
                    heapq.heappush(queue, (to, i, left, right))

        for i in range(len(ids)):
            push(i)
        while queue:
            to, i, left, right = heapq.heappop(queue)
            j = after[i]
            if j < 0 or ids[i] != left or ids[j] != right:
                continue
            ids[i], ids[j], after[i] = to, -1, after[j]
            if after[i] >= 0:
                before[after[i]] = i
            after[j] = -1
            push(i)
            push(before[i])
        return [i for i in ids if i >= 0]


# --- The transducer ---------------------------------------------------------------


class _State:
    __slots__ = ("last", "next", "out", "tail")

    def __init__(self):
        self.next: dict[int, int] = {}  # byte -> number of a finished state
        self.out: dict[int, tuple[int, ...]] = {}
        self.last, self.tail = False, ()


@dataclass
class Transducer:
    """Flat arrays: transitions by ``state * 256 + byte``, their targets and outputs (a stretch of
    ``pool``), and for each state whether a word ends there and what it puts out then."""

    keys: np.ndarray
    target: np.ndarray
    out_at: np.ndarray
    out_size: np.ndarray
    last: np.ndarray
    tail_at: np.ndarray
    tail_size: np.ndarray
    pool: np.ndarray
    root: np.ndarray

    NAMES = ("keys", "target", "out_at", "out_size", "last", "tail_at", "tail_size", "pool", "root")

    def to_bytes(self) -> bytes:
        """A line that names the arrays, padded to their alignment, then the arrays."""
        arrays = [np.ascontiguousarray(getattr(self, n)) for n in self.NAMES]
        head = json.dumps([[n, a.dtype.str, len(a)] for n, a in zip(self.NAMES, arrays)]).encode()
        out = [head + b" " * (-(len(head) + 1) % 64) + b"\n"]
        for a in arrays:
            raw = a.tobytes()
            out.append(raw + bytes(-len(raw) % 64))
        return b"".join(out)

    @classmethod
    def open(cls, path: str) -> Transducer:
        """The arrays of a file, mapped into memory and not read before they are needed."""
        pages = np.memmap(path, np.uint8, "r")
        with open(path, "rb") as file:
            head = file.readline()
        at, found = len(head), {}
        for name, kind, size in json.loads(head):
            n = np.dtype(kind).itemsize * size
            found[name] = pages[at : at + n].view(kind)
            at += n + -n % 64
        return cls(**found)

    def walk(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whether each word is held; the ids of those that are, one after another; their sizes
        (0 for the others)."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        flat = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        starts = np.cumsum(sizes) - sizes
        state = np.full(len(words), self.root[0], np.int64)
        count = np.zeros(len(words), np.int64)
        steps: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        rows = np.flatnonzero((sizes <= LONGEST) & (sizes > 0)) if len(self.keys) else np.empty(0, np.int64)
        held = np.zeros(len(words), bool)
        for i in range(LONGEST + 1):
            ends = rows[sizes[rows] == i]
            ends = ends[self.last[state[ends]] != 0]
            held[ends] = True
            steps.append((ends, self.tail_at[state[ends]], self.tail_size[state[ends]]))
            rows = rows[sizes[rows] > i]
            if not len(rows):
                break
            key = state[rows] * 256 + flat[starts[rows] + i]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            there = self.keys[at] == key
            rows, at = rows[there], at[there]
            state[rows] = self.target[at]
            steps.append((rows, self.out_at[at], self.out_size[at]))
        steps = [(r[k], a[k], n[k]) for r, a, n in steps if len(k := np.flatnonzero(held[r] & (n > 0)))]
        for r, _, n in steps:
            count[r] += n
        places = np.cumsum(count) - count
        ids = np.empty(int(count.sum()), np.int64)
        for r, a, n in steps:
            for j in range(int(n.max())):
                has = n > j
                ids[places[r[has]] + j] = self.pool[a[has] + j]
            places[r] += n
        return held, ids, count


def _shared(a: tuple, b: tuple) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def compile_words(entries: list[tuple[bytes, tuple[int, ...]]]) -> Transducer:
    """The minimal transducer of distinct words with their ids. The states of the last word are
    open; those that the next word does not share are finished, and equal ones are one state."""
    register: dict[tuple, int] = {}
    finished: list[_State] = []

    def finish(state: _State) -> int:
        name = (state.last, state.tail, tuple(sorted((b, t, state.out[b]) for b, t in state.next.items())))
        if name not in register:
            register[name] = len(finished)
            finished.append(state)
        return register[name]

    open_states, before = [_State()], b""

    def close(upto: int) -> None:
        while len(open_states) > upto + 1:
            state = open_states.pop()
            open_states[-1].next[before[len(open_states) - 1]] = finish(state)

    for word, ids in sorted(entries):
        same = _shared(word, before)
        close(same)
        rest = ids
        for i in range(same):
            here, there, byte = open_states[i], open_states[i + 1], word[i]
            n = _shared(here.out[byte], rest)
            moved, here.out[byte], rest = here.out[byte][n:], here.out[byte][:n], rest[n:]
            if moved:
                there.out = {b: moved + o for b, o in there.out.items()}
                if there.last:
                    there.tail = moved + there.tail
        for i in range(same, len(word)):
            open_states[-1].out[word[i]] = rest
            rest = ()
            open_states.append(_State())
        open_states[-1].last = True
        before = word
    close(0)
    root = finish(open_states[0])

    pool: list[int] = []
    known: dict[tuple[int, ...], int] = {}

    def place(ids: tuple[int, ...]) -> int:
        if ids not in known:
            known[ids] = len(pool)
            pool.extend(ids)
        return known[ids]

    moves = sorted((s * 256 + b, t, state.out[b]) for s, state in enumerate(finished) for b, t in state.next.items())
    column = lambda values, kind=np.int32: np.array(list(values), kind)
    return Transducer(
        column((k for k, _, _ in moves), np.int64), column(t for _, t, _ in moves),
        column(place(o) for _, _, o in moves), column(len(o) for _, _, o in moves),
        column(s.last for s in finished), column(place(s.tail) for s in finished),
        column(len(s.tail) for s in finished), column(pool), column([root]),
    )


# --- On Spark -----------------------------------------------------------------------

# Of this Python worker: rules by digest, mapped lexicons by file name.
_rules: dict[str, Rules] = {}
_mapped: dict[str, Transducer] = {}


def _words_of(rules: Rules, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Number of words of each text; each word's place among the distinct words; these."""
    found = [rules.words(t) for t in texts.to_pylist()]
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    coded = pa.array([w for f in found for w in f], pa.string()).dictionary_encode()
    return sizes, coded.indices.to_numpy().astype(np.int64), coded.dictionary


def word_counts(docs: DataFrame, rules: Rules, text: str = "text") -> DataFrame:
    """(word, n): how often each word of at most ``LONGEST`` bytes occurs in all texts."""
    shared, special = docs.sparkSession.sparkContext.broadcast(rules), list(rules.special)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _rules.setdefault(shared.value.digest, shared.value)
        for part in chunks(batches, "_text"):
            _, which, distinct = _words_of(own, part.column("_text"))
            n = np.bincount(which, minlength=len(distinct))
            keep = pc.less_equal(pc.binary_length(distinct), LONGEST)
            keep = pc.and_(keep, pc.invert(pc.is_in(distinct, pa.array(special, pa.string()))))
            yield pa.RecordBatch.from_arrays([distinct, pa.array(n)], ["word", "n"]).filter(keep)

    counted = docs.select(F.col(text).alias("_text")).mapInArrow(count, "word string, n bigint")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


def build(docs: DataFrame, rules: Rules, text: str = "text", size: int = SIZE) -> str:
    """Compile the ``size`` most frequent words of all texts (ties: the smaller word) into a file
    that every executor gets, and return the file's name. The driver holds these words only."""
    spark = docs.sparkSession
    frequent = word_counts(docs, rules, text).orderBy(F.desc("n"), "word").limit(size).select("word").toArrow()
    words = frequent.column("word").combine_chunks().cast(pa.binary()).to_pylist()
    ids, places = rules.merge(words)
    flat, bounds = ids.tolist(), places.tolist()
    entries = [(w, tuple(flat[a:b])) for w, a, b in zip(words, bounds[:-1], bounds[1:])]
    return publish(spark, compile_words(entries).to_bytes())


def publish(spark: SparkSession, raw: bytes) -> str:
    """Write a file to the shared folder and have Spark bring it to every executor."""
    name = f"lexicon-{hashlib.sha256(raw).hexdigest()[:32]}"
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{scratch_folder(spark)}/{name}")
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    stream = files.create(path, True)
    stream.write(bytearray(raw))
    stream.close()
    spark.sparkContext.addFile(files.makeQualified(path).toString())
    return name


def encode_words(rules: Rules, lexicon: Transducer, distinct: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids of distinct words one after another, and the first place of each."""
    words = distinct.cast(pa.binary()).to_pylist()
    held, ids, count = lexicon.walk(words)
    special = {s.encode(): i for s, i in rules.special.items()}
    named = [i for i, w in enumerate(words) if w in special]
    rest = np.setdiff1d(np.flatnonzero(~held), np.array(named, np.int64))
    other, places = rules.merge([words[i] for i in rest.tolist()])
    count[rest], count[named] = np.diff(places), 1
    starts = np.concatenate([[0], np.cumsum(count)])
    flat = np.empty(starts[-1], np.int64)
    flat[np.repeat(held, count)] = ids
    takes = np.zeros(len(words), bool)
    takes[rest] = True
    flat[np.repeat(takes, count)] = other
    flat[starts[named]] = [special[words[i]] for i in named]
    return flat, starts


def encode(
    docs: DataFrame, rules: Rules, lexicon: str, key: str = "doc_id", text: str = "text",
    keep_ids: bool = True, keep: list[str] | None = None,
) -> DataFrame:
    """key, the columns ``keep``, n_tokens, ids (if kept), the digest of the ids as little-endian
    unsigned 32-bit integers, the digest of the decoded text."""
    keep = keep or []
    shared = docs.sparkSession.sparkContext.broadcast(rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _rules.setdefault(shared.value.digest, shared.value)
        if lexicon not in _mapped:
            _mapped[lexicon] = Transducer.open(SparkFiles.get(lexicon))
        for part in chunks(batches, "_text"):
            sizes, which, distinct = _words_of(own, part.column("_text"))
            flat, places = encode_words(own, _mapped[lexicon], distinct)
            bounds, listed = places.tolist(), flat.tolist()
            strings = [own.tokens[i] for i in listed]
            back = [" ".join(strings[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]
            size = (places[1:] - places[:-1])[which]
            upto = np.concatenate([[0], np.cumsum(size)])
            ids = flat[np.arange(upto[-1]) + np.repeat(places[:-1][which] - upto[:-1], size)].astype("<u4")
            words = np.concatenate([[0], np.cumsum(sizes)])
            starts = upto[words]
            spans = list(zip(starts[:-1].tolist(), starts[1:].tolist()))
            hashed = [hashlib.sha256(ids[a:b]).hexdigest() for a, b in spans]
            named = which.tolist()
            decoded = [
                hashlib.sha256(" ".join([back[w] for w in named[a:b]]).encode()).hexdigest()
                for a, b in zip(words[:-1].tolist(), words[1:].tolist())
            ]
            columns = [part.column(f"_{i}") for i in range(len(keep) + 1)]
            columns.append(pa.array([b - a for a, b in spans], pa.int64()))
            if keep_ids:
                columns.append(list_column(ids.astype(np.int32), starts, pa.int32()))
            columns += [pa.array(hashed, pa.string()), pa.array(decoded, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names)

    names = [key, *keep, "n_tokens", *(["ids"] if keep_ids else []), "ids_sha256", "decoded_sha256"]
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in (key, *keep))
    schema = f"{fields}, n_tokens bigint, {'ids array<int>, ' if keep_ids else ''}ids_sha256 string, decoded_sha256 string"
    columns = [F.col(c).alias(f"_{i}") for i, c in enumerate([key, *keep])]
    return docs.select(*columns, F.col(text).alias("_text")).mapInArrow(run, schema)


def decode(rules: Rules, ids: list[int]) -> str:
    return " ".join(rules.tokens[i] for i in ids)
