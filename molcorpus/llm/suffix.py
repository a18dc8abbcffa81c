"""Removal of repeated byte strings by suffix sorting.

A byte goes if a string of ``length`` bytes that covers it starts at another place as well, in
the same or another text. Equal strings are brought together first: every window of ``length``
bytes has an anchor, its sub-string of ``GRAM`` bytes with the smallest hash, and equal windows
have equal anchors at equal places. Neighbouring windows with one anchor are a region. Regions
whose anchor occurs once hold no repeated window and go no further. Equal regions are counted by
hash, and one of each is sorted.

Sorting has two stages. Suffixes whose first byte is not above their second, those that are
smaller than their successors or begin a run, are sorted directly; all others are induced: the
buckets of first bytes are scanned in order, and each suffix met puts the one before it, if that
is larger, next in its own bucket. Then the common prefixes of neighbours are computed; a window
is repeated if a neighbour shares ``length`` bytes, or if its region was there more than once.
Anchors with more than ``HOT`` different regions are dealt out by window instead.

Texts are UTF-8 bytes, strings never cross texts. Null, empty and short texts lose nothing. Ids
that are no whole numbers, null or repeated are given a new one inside; every row keeps its row. Empty tables give
an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from molcorpus.llm.text import chunks, list_column, mix, fresh, row_numbers, whole_numbers
from molcorpus.session import materialize

GRAM = 32
BLOCK = 1 << 18
PLACE_BITS = np.uint64(20)
HOT = 4_000
# Suffixes that are sorted together.
SORT_ROWS = 400_000

_draw = np.random.default_rng(77)
_TABLE = _draw.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    if n > 1:
        out[1:] = np.uint64(base)
    return np.multiply.accumulate(out)


_cache: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    if n not in _cache:
        _cache.clear()
        _cache[n] = _powers(_BASE, n), _powers(pow(_BASE, -1, 1 << 64), n)
    return _cache[n]


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    reach = 1
    while reach * 2 <= width:
        x = np.minimum(x[:-reach], x[reach:])
        reach *= 2
    rest = width - reach
    return np.minimum(x[:-rest], x[rest:]) if rest else x


def regions(flat: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """First and last window, place of the anchor, hash of the anchor and of the bytes of each
    region of texts laid end to end, which end at ``ends``."""
    found = []
    width = length - GRAM + 1
    forward, inverse = powers(BLOCK + length)
    for begin in range(0, len(flat) - length + 1, BLOCK):
        part = flat[begin : begin + BLOCK + length - 1]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_TABLE[part] * forward[: len(part)], out=sums[1:])
        n = len(part) - GRAM + 1
        gram = mix((sums[GRAM:] - sums[:-GRAM]) * inverse[:n])
        packed = (gram >> PLACE_BITS << PLACE_BITS) | np.arange(n, dtype=np.uint64)
        place = (sliding_min(packed, width) & ((np.uint64(1) << PLACE_BITS) - np.uint64(1))).astype(np.int64)
        start = np.arange(begin, begin + len(place))
        end_of = ends[np.searchsorted(ends, start, side="right")]
        at = np.flatnonzero(start + length <= end_of)
        if not len(at):
            continue
        own = place[at]
        new = np.ones(len(at), bool)
        new[1:] = (own[1:] != own[:-1]) | (at[1:] != at[:-1] + 1)
        first = np.flatnonzero(new)
        last = np.concatenate([first[1:], [len(at)]]) - 1
        a, b, p = at[first], at[last], own[first]
        whole = mix(mix((sums[b + length] - sums[a]) * inverse[a]) + (b - a).astype(np.uint64))
        found.append((a + begin, b + begin, p + begin, gram[p], whole))
    if not found:
        empty = np.empty(0, np.int64)
        return empty, empty, empty, empty.view(np.uint64), empty.view(np.uint64)
    return tuple(np.concatenate(x) for x in zip(*found))


def joined_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts end to end, and where each begins and the last ends."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, "" if pa.types.is_string(texts.type) else b"")
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    whole = pc.binary_join(
        pa.ListArray.from_arrays(pa.array([0, len(sizes)], pa.int32()), texts.cast(pa.binary())), pa.scalar(b"")
    )
    return np.frombuffer(whole[0].as_buffer(), np.uint8), np.concatenate([[0], np.cumsum(sizes)])


def suffix_order(text: np.ndarray, wanted: np.ndarray, length: int) -> np.ndarray:
    """The places ``wanted`` of a text, sorted by their first ``length`` bytes at least, in two
    stages. ``length`` bytes and one more must follow each of them."""
    needed = np.zeros(len(text), bool)
    needed[wanted] = True
    larger = np.zeros(len(text), bool)
    larger[:-1] = text[:-1] > text[1:]
    # what a wanted suffix is induced from is needed as well; falling bytes end soon
    edge = wanted[larger[wanted]]
    while len(edge):
        edge = edge + 1
        edge = edge[~needed[edge]]
        needed[edge] = True
        edge = edge[larger[edge]]
    places = np.flatnonzero(needed)
    direct = places[~larger[places]]
    padded = np.concatenate([text, np.zeros(length, np.uint8)])
    views = np.lib.stride_tricks.sliding_window_view(padded, length)
    keys = np.ascontiguousarray(views[direct]).view(f"S{length}").ravel()
    direct = direct[np.argsort(keys, kind="stable")]
    del keys
    first = text[direct]
    bounds = np.searchsorted(first, np.arange(257))
    induced: list[list[np.ndarray]] = [[] for _ in range(256)]
    order = []
    for c in range(256):
        bucket = np.concatenate([*induced[c], direct[bounds[c] : bounds[c + 1]]])
        if not len(bucket):
            continue
        order.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[needed[before] & (text[before] > c)]
        heads = text[before]
        for head in np.unique(heads).tolist():
            induced[head].append(before[heads == head])
    found = np.concatenate(order) if order else np.empty(0, np.int64)
    keep = np.zeros(len(text), bool)
    keep[wanted] = True
    return found[keep[found]]


def common_prefixes(text: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """Bytes that each place shares with the one before it in the order, up to ``length``."""
    padded = np.concatenate([text, np.zeros(length + 8, np.uint8)])
    shared = np.zeros(len(order), np.int64)
    alive = np.arange(1, len(order))
    for depth in range(0, length, 8):
        if not len(alive):
            break
        size = min(8, length - depth)
        p, q = order[alive - 1] + depth, order[alive] + depth
        equal = np.ones(len(alive), bool)
        for i in range(size):
            equal &= padded[p + i] == padded[q + i]
            shared[alive] += equal
        alive = alive[equal]
    return shared


def repeated_windows(texts: list[bytes], counts: list[int], length: int) -> list[np.ndarray]:
    """For each region's bytes the windows that are repeated within these regions."""
    text = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts], np.int64)
    begin = np.cumsum(sizes) - sizes
    windows = sizes - length + 1
    total = np.concatenate([[0], np.cumsum(windows)])
    wanted = np.arange(total[-1]) + np.repeat(begin - total[:-1], windows)
    order = suffix_order(text, wanted, length)
    same = common_prefixes(text, order, length) >= length
    twice = np.zeros(len(text), bool)
    twice[order[same]] = True
    twice[order[:-1][same[1:]]] = True
    return [
        np.arange(n) if count > 1 else np.flatnonzero(twice[b : b + n])
        for b, n, count in zip(begin.tolist(), windows.tolist(), counts)
    ]


def runs(places: np.ndarray) -> list[tuple[int, int]]:
    """First and last of each run of neighbouring places."""
    if not len(places):
        return []
    cuts = np.flatnonzero(np.diff(places) != 1)
    first = np.concatenate([[0], cuts + 1])
    last = np.concatenate([cuts, [len(places) - 1]])
    return list(zip(places[first].tolist(), places[last].tolist()))


def repeated(docs: DataFrame, key: str, text: str, length: int) -> DataFrame:
    """(id, low, high): windows of the documents, by their unique id, that are repeated."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, text):
            flat, starts = joined_bytes(part.column(text))
            a, b, p, anchor, whole = regions(flat, starts[1:], length)
            if not len(a):
                continue
            row = np.searchsorted(starts, a, side="right") - 1
            place = ((p - starts[row]) << 16) | ((p - a) << 8) | (p - b)
            rows, first = np.unique(row, return_index=True)
            bounds = np.concatenate([first, [len(row)]])
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(key).take(pa.array(rows)).cast(pa.int64()),
                    list_column(anchor.view(np.int64), bounds, pa.int64()),
                    list_column(whole.view(np.int64), bounds, pa.int64()),
                    list_column(place, bounds, pa.int64()),
                ],
                ["id", "anchors", "wholes", "places"],
            )

    cut_docs = materialize(
        docs.select(key, text).mapInArrow(cut, "id bigint, anchors array<bigint>, wholes array<bigint>, places array<bigint>")
    )
    # written, so that the join's hot anchors can be split: an aggregate below it could not
    often = materialize(
        cut_docs.select(F.explode("anchors").alias("anchor")).groupBy("anchor").count().filter("count > 1").select("anchor")
    )
    one_row = F.explode(F.arrays_zip("anchors", "wholes", "places")).alias("r")
    met = materialize(
        cut_docs.select("id", one_row)
        .select("id", F.col("r.anchors").alias("anchor"), F.col("r.wholes").alias("whole"), F.col("r.places").alias("place"))
        .join(often, "anchor")
    )
    classes = materialize(
        met.groupBy("anchor", "whole").agg(F.count("*").alias("n"), F.min(F.struct("id", "place")).alias("one"))
    )
    # whole regions that are there more than once
    many = met.join(classes.filter("n > 1").select("anchor", "whole"), ["anchor", "whole"]).select(
        "id", (F.shiftright("place", 16) - F.shiftright("place", 8).bitwiseAND(255)).alias("low"),
        (F.shiftright("place", 16) - F.col("place").bitwiseAND(255)).alias("high"),
    )
    kinds = classes.groupBy("anchor").agg(F.count("*").alias("kinds")).filter("kinds > 1")
    sorted_ = classes.join(kinds, "anchor").select("anchor", "n", "kinds", "one.id", "one.place")
    wanted = sorted_.groupBy("id").agg(F.collect_list(F.struct("anchor", "n", "kinds", "place")).alias("wanted"))
    texts = docs.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("_text")).join(wanted, "id")

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "_text"):
            ids, out = [], []
            for row, own, regions_ in zip(*(part.column(c).to_pylist() for c in ("id", "_text", "wanted"))):
                raw = own.encode()
                for r in regions_:
                    p = r["place"] >> 16
                    low, high = p - (r["place"] >> 8 & 255), p - (r["place"] & 255)
                    ids.append(row)
                    out.append((r["anchor"], r["n"], r["kinds"], low, raw[low : high + length]))
            names = ["anchor", "n", "kinds", "low", "bytes"]
            kinds_ = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            columns = [pa.array([o[i] for o in out], t) for i, t in enumerate(kinds_)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *columns], ["id", *names])

    fetched = materialize(
        texts.mapInArrow(fetch, "id bigint, anchor bigint, n bigint, kinds bigint, low bigint, bytes binary")
    )

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Repeated windows of regions, sorted by groups of whole anchors."""
        held: list[tuple[int, int, int, bytes]] = []
        size, last = 0, None

        def flush() -> pa.RecordBatch:
            found = repeated_windows([h[3] for h in held], [h[1] for h in held], length)
            # regions there more than once are known by their counts
            rows = [(h[0], h[2] + a, h[2] + b) for h, f in zip(held, found) if h[1] == 1 for a, b in runs(f)]
            return pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], pa.int64()) for i in range(3)], ["id", "low", "high"]
            )

        for batch in batches:
            for i, anchor, n, low, raw in zip(*(batch.column(c).to_pylist() for c in ("id", "anchor", "n", "low", "bytes"))):
                if anchor != last and size > SORT_ROWS:
                    yield flush()
                    held, size = [], 0
                last = anchor
                held.append((i, n, low, raw))
                size += len(raw) - length + 1
        if held:
            yield flush()

    by_sorting = (
        fetched.filter(F.col("kinds") <= HOT).select("id", "anchor", "n", "low", "bytes")
        .repartition("anchor").sortWithinPartitions("anchor")
        .mapInArrow(sort, "id bigint, low bigint, high bigint")
    )
    found = many.unionByName(by_sorting)
    hot = fetched.filter(F.col("kinds") > HOT)
    if not hot.isEmpty():

        def apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i, n, low, raw in zip(*(batch.column(c).to_pylist() for c in ("id", "n", "low", "bytes"))):
                    digests = [hashlib.blake2b(raw[j : j + length], digest_size=16).digest() for j in range(len(raw) - length + 1)]
                    size = len(digests)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([i] * size, pa.int64()), pa.array([n] * size, pa.int64()),
                         pa.array(np.arange(low, low + size)), pa.array(digests, pa.binary())],
                        ["id", "n", "low", "digest"],
                    )

        single = materialize(hot.mapInArrow(apart, "id bigint, n bigint, low bigint, digest binary"))
        twice = single.groupBy("digest").agg(F.sum("n").alias("all")).filter("all > 1").select("digest")
        by_window = single.filter("n = 1").join(twice, "digest").select("id", "low", F.col("low").alias("high"))
        found = found.unionByName(by_window)
    return found


def remove_repeated(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = 200) -> DataFrame:
    """One row per row of ``docs``: key, n_bytes, n_removed, n_spans, kept_sha256, and the removed
    spans as arrays of first bytes and ends."""
    if not GRAM < length < 256:
        raise ValueError(f"strings of more than {GRAM} and fewer than 256 bytes")
    rows = docs.select(F.col(key), F.col(text))
    number = fresh(rows, "_row")
    doubtful = rows.groupBy(key).agg(F.count("*").alias("n")).filter(F.col(key).isNull() | (F.col("n") > 1))
    if whole_numbers(docs, key) and doubtful.isEmpty():
        rows = rows.withColumn(number, F.col(key).cast("bigint"))
    else:
        rows = row_numbers(rows, number)
    found = repeated(rows, number, text, length)
    spans = found.groupBy(F.col("id").alias(number)).agg(F.collect_list(F.struct("low", "high")).alias("_spans"))
    kind = docs.schema[key].dataType.simpleString()

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, text):
            n_bytes, n_removed, digests, first, last = [], [], [], [], []
            for own, spans_ in zip(part.column(text), part.column("_spans")):
                raw = (own.as_py() or "").encode()
                low, high = np.empty(0, np.int64), np.empty(0, np.int64)
                if spans_.is_valid:
                    low = spans_.values.field("low").to_numpy()
                    high = spans_.values.field("high").to_numpy() + length
                    order = np.argsort(low, kind="stable")
                    low, high = low[order], np.maximum.accumulate(high[order])
                    new = np.ones(len(low), bool)
                    new[1:] = low[1:] > high[:-1]
                    at = np.flatnonzero(new)
                    low, high = low[at], high[np.concatenate([at[1:], [len(high)]]) - 1]
                cuts = [0, *(x for pair in zip(low.tolist(), high.tolist()) for x in pair), len(raw)]
                kept = b"".join([raw[a:b] for a, b in zip(cuts[::2], cuts[1::2])])
                n_bytes.append(len(raw))
                n_removed.append(len(raw) - len(kept))
                digests.append(hashlib.sha256(kept).hexdigest())
                first.append(low.tolist())
                last.append(high.tolist())
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(key), pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()),
                    pa.array([len(f) for f in first], pa.int64()), pa.array(digests, pa.string()),
                    pa.array(first, pa.list_(pa.int64())), pa.array(last, pa.list_(pa.int64())),
                ],
                [key, "n_bytes", "n_removed", "n_spans", "kept_sha256", "starts", "ends"],
            )

    schema = (
        f"`{key}` {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, "
        "starts array<bigint>, ends array<bigint>"
    )
    return rows.join(spans, number, "left").select(key, text, "_spans").mapInArrow(remove, schema)
