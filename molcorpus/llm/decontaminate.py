"""Benchmark decontamination by spaced seeds.

Words are lower-cased and lose the punctuation around them. A seed hashes the words of a window
of ``SPAN`` at the positions a fixed mask selects; the others may differ. The seeds of benchmark
items and of documents are joined on their hash. A bitmap of the benchmark's seeds, of fixed
size, goes to all tasks first, so that only document windows that can match, with the words
around them, are shuffled; it lets some others through, and the join decides. Every hit lays an
item along a document. The document holds a passage of the item if any stretch there has at least
``least`` agreeing words (three in four of a shorter item's) and at least three in four of the
stretch agree; the stretch with the most agreeing words is told. ``least`` is ten or more.

No such stretch is without a seed: of 20 agreeing words or more one half is a stretch of its own,
and each of the 289,095 ways to place 10 to 19 agreeing words holds one of ``MASKS``, as each way in
a shorter item holds one of ``SHORT_MASKS``; the tests go through them all. Seeds of the
latter are made of items with fewer than ``LONG`` words only.

Characters of scripts that put no space between words are one word each. Items of fewer than
``SHORTEST`` words are no evidence and match nothing, nor do null and empty texts. Documents
without an id cannot be named and are left out; ids may be numbers or text; rows of one id are one document, rows of one
item id several items under one name. Empty tables give an empty result; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from molcorpus.llm.text import M2, chunks, hash_strings, list_column, mix, split_words, row_numbers, whole_numbers
from molcorpus.session import materialize

# Fixed masks of weight 6 (4 in items of fewer than LONG words), found greedily to cover all stretches.
MASKS = ("11010111", "11100010011", "11101101", "10100001111", "1101100101", "111000111", "1111101", "111111")
SHORT_MASKS = ("10111", "111001", "1001011", "1111", "11011", "11101")
SPAN = 11
SHORTEST, LONG = 5, 13
LEAST = 10
BITS = 24
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~«»“”‘’„…–—、。〈〉《》「」『』【】（），．：；？！"
UNSPACED = r"([\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}])"


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The first word's place of each text, and the hash of every word."""
    texts = pc.fill_null(texts, "")
    unspaced = pc.match_substring_regex(texts, UNSPACED)
    if pc.any(unspaced).as_py():
        texts = pc.replace_with_mask(texts, unspaced, pc.replace_substring_regex(texts.filter(unspaced), UNSPACED, r" \1 "))
    offsets, ids, distinct = split_words(pc.utf8_lower(texts))
    bare = pc.utf8_trim(distinct, PUNCTUATION)
    full = pc.greater(pc.binary_length(bare), 0).to_numpy(zero_copy_only=False)
    kept = full[ids] if len(ids) else np.empty(0, bool)
    before = np.concatenate([[0], np.cumsum(kept)])
    return before[offsets], mix(hash_strings(bare))[ids][kept]


def seeds(word: np.ndarray, mask: str, salt: int) -> np.ndarray:
    """The hash at each place that has a whole window after it."""
    n = len(word) - len(mask) + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    found = np.full(n, salt, np.uint64)
    for i, bit in enumerate(mask):
        if bit == "1":
            found = found * M2 + word[i : i + n]
    return mix(found)


def needed(n_words: int, least: int = LEAST) -> int:
    """The agreeing words that an item of so many words must have in a stretch."""
    return min(least, -(-3 * n_words // 4))


def bit_places(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64((1 << BITS) - 1)
    return (hashes & mask).astype(np.int64), (hashes >> np.uint64(32) & mask).astype(np.int64)


def best_stretch(agree: np.ndarray) -> tuple[int, int]:
    """Start and end of the stretch with the most agreeing words among those where at least three
    in four agree; of several the first that ends, without differing words at its ends."""
    total = np.concatenate([[0], np.cumsum(np.where(agree, 1, -3))])
    count = np.concatenate([[0], np.cumsum(agree)])
    # the first start from which the sum to each end is not negative
    lowest = np.minimum.accumulate(total)
    start = np.searchsorted(-lowest, -total, side="left")
    end = int((count - count[start]).argmax())
    own = np.flatnonzero(agree[start[end] : end]) + start[end]
    return (int(own[0]), int(own[-1]) + 1) if len(own) else (0, 0)


def passages(
    docs: DataFrame, items: DataFrame, key: str = "doc_id", item_key: str = "item_id", text: str = "text", least: int = LEAST
) -> DataFrame:
    """One row per document and item that it holds a passage of: key, item key, first_word and
    n_words of the longest stretch in the document, n_agree, item_words."""
    best = F.max(F.struct("n_agree", -F.col("first_word"), "n_words", "item_words")).alias("b")
    shown = (-F.col("b.col2")).alias("first_word"), "b.n_words", "b.n_agree", "b.item_words"
    if not whole_numbers(docs, key):
        rows = row_numbers(docs.filter(F.col(key).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("t")), "row")
        named = items.select(F.col(item_key).alias("item"), F.col(text).alias("t"))
        found = passages(rows.select("row", "t"), named, "row", "item", "t", least).join(rows.select("row", "k"), "row")
        return found.groupBy(F.col("k").alias(key), F.col("item").alias(item_key)).agg(best).select(key, item_key, *shown)
    spark = docs.sparkSession
    item_kind = items.schema[item_key].dataType.simpleString()

    def read_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, text):
            offsets, word = words(part.column(text))
            yield pa.RecordBatch.from_arrays(
                [part.column(item_key), list_column(word.view(np.int64), offsets, pa.int64())], ["item", "words"]
            )

    known = items.select(item_key, text).mapInArrow(read_items, f"item {item_kind}, words array<bigint>")
    known = materialize(
        known.filter(F.size("words") >= SHORTEST).withColumn("item_row", F.monotonically_increasing_id())
    )
    shortest, longest = known.agg(F.min(F.size("words")), F.max(F.size("words"))).first()
    longest = longest or 0
    used = [(mask, i + 1) for i, mask in enumerate(MASKS)]
    if shortest is not None and shortest < LONG:
        used += [(mask, i + 101) for i, mask in enumerate(SHORT_MASKS)]

    def item_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, places, hashes = [], [], []
            for row, own in zip(batch.column("item_row").to_pylist(), batch.column("words")):
                own = own.values.to_numpy().view(np.uint64)
                for mask, salt in used:
                    if (salt > 100) == (len(own) < LONG):
                        found = seeds(own, mask, salt)
                        rows.append(np.full(len(found), row))
                        places.append(np.arange(len(found)))
                        hashes.append(found)
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate(hashes).view(np.int64)),
                        pa.array(np.concatenate(rows).astype(np.int64)),
                        pa.array(np.concatenate(places).astype(np.int64)),
                    ],
                    ["seed", "item_row", "item_place"],
                )

    wanted = materialize(
        known.select("item_row", "words").mapInArrow(item_seeds, "seed bigint, item_row bigint, item_place bigint")
    )

    def bitmap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << BITS, bool)
        for batch in batches:
            for place in bit_places(batch.column("seed").to_numpy().view(np.uint64)):
                bits[place] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(bits).tobytes()], pa.binary())], ["bits"])

    # of fixed size, 2 MB, whatever the benchmark's size; few tasks make one each
    maps = wanted.select("seed").coalesce(8).mapInArrow(bitmap, "bits binary").toArrow().column("bits")
    bits = np.zeros((1 << BITS) // 8, np.uint8)
    for raw in maps:
        bits |= np.frombuffer(raw.as_buffer(), np.uint8)
    shared = spark.sparkContext.broadcast(bits)

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(shared.value).astype(bool)
        for part in chunks(batches, text):
            offsets, word = words(part.column(text))
            all_places, all_seeds = [], []
            for mask, salt in used:
                found = seeds(word, mask, salt)
                first, second = bit_places(found)
                place = np.flatnonzero(bits[first])
                place = place[bits[second[place]]]
                # a window within one document
                row = np.searchsorted(offsets, place, side="right") - 1
                place = place[place + len(mask) <= offsets[row + 1]]
                all_places.append(place)
                all_seeds.append(found[place])
            places, found = np.concatenate(all_places), np.concatenate(all_seeds)
            if not len(places):
                continue
            order = np.argsort(places, kind="stable")
            places, found = places[order], found[order]
            row = np.searchsorted(offsets, places, side="right") - 1
            # hits whose surroundings overlap share one segment
            new = np.ones(len(places), bool)
            new[1:] = (row[1:] != row[:-1]) | (places[1:] - places[:-1] > 2 * longest + SPAN)
            group = np.cumsum(new) - 1
            first = np.flatnonzero(new)
            last = np.concatenate([first[1:], [len(places)]]) - 1
            start = np.maximum(places[first] - longest, offsets[row[first]])
            end = np.minimum(places[last] + longest + SPAN, offsets[row[first] + 1])
            sizes = end - start
            total = np.concatenate([[0], np.cumsum(sizes)])
            index = np.arange(total[-1]) + np.repeat(start - total[:-1], sizes)
            counts = np.concatenate([[0], np.cumsum(np.bincount(group, minlength=len(first)))])
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(key).take(pa.array(row[first])).cast(pa.int64()),
                    pa.array(start - offsets[row[first]]),
                    list_column(word[index].view(np.int64), total, pa.int64()),
                    list_column(places - offsets[row], counts, pa.int64()),
                    list_column(found.view(np.int64), counts, pa.int64()),
                ],
                ["id", "start", "words", "places", "seeds"],
            )

    segments = materialize(
        docs.filter(F.col(key).isNotNull()).select(key, text)
        .mapInArrow(hits, "id bigint, start bigint, words array<bigint>, places array<bigint>, seeds array<bigint>")
        .withColumn("segment", F.monotonically_increasing_id())
    )
    met = (
        segments.select("segment", F.explode(F.arrays_zip("places", "seeds")).alias("hit"))
        .select("segment", F.col("hit.places").alias("place"), F.col("hit.seeds").alias("seed"))
        .join(wanted, "seed")
        .select("segment", "item_row", (F.col("place") - F.col("item_place")).alias("shift")).distinct()
    )
    laid = met.join(known.select("item_row", "item", F.col("words").alias("item_words")), "item_row").join(
        segments.select("segment", "id", "start", "words"), "segment"
    )

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, first, size, same = [], [], [], []
            rows = zip(*(batch.column(c) for c in ("words", "start", "item_words", "shift")))
            for i, (own, start, item, shift) in enumerate(rows):
                own, item = own.values.to_numpy(), item.values.to_numpy()
                begin = shift.as_py() - start.as_py()  # place of the item's first word in the segment
                low, high = max(0, -begin), min(len(item), len(own) - begin)
                agree = own[begin + low : begin + high] == item[low:high]
                if int(agree.sum()) < needed(len(item), least):
                    continue
                a, b = best_stretch(agree)
                n = int(agree[a:b].sum())
                if n >= needed(len(item), least):
                    keep.append(i)
                    first.append(shift.as_py() + low + a)
                    size.append(b - a)
                    same.append(n)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id").take(pa.array(keep, pa.int64())),
                    batch.column("item").take(pa.array(keep, pa.int64())),
                    pa.array(first, pa.int64()), pa.array(size, pa.int64()), pa.array(same, pa.int64()),
                    pa.array([len(batch.column("item_words")[i]) for i in keep], pa.int64()),
                ],
                ["id", "item", "first_word", "n_words", "n_agree", "item_words"],
            )

    schema = f"id bigint, item {item_kind}, first_word bigint, n_words bigint, n_agree bigint, item_words bigint"
    found = laid.select("id", "item", "start", "words", "item_words", "shift").mapInArrow(verify, schema)
    return found.groupBy(F.col("id").alias(key), F.col("item").alias(item_key)).agg(best).select(key, item_key, *shown)
