"""Language identification by bit-sliced Bloom filters of byte n-grams.

The n-grams most frequent in a language, counted over a bounded sample of its learned documents,
go into the language's Bloom filter. The filters are stored by position: each position holds a
bitmask with one bit per language, in words of 64 bits. One lookup takes the masks at the
positions of an n-gram and returns by AND all languages that contain it. Per document and
language the set bits are counted; from each count the hits expected by false positives, from
the filter's fill, are taken off. The language with most hits is returned, its share of all
hits is the score.

Null texts and texts without a letter are ``und`` with score 0; texts whose n-grams are all
unknown get the language with most learned documents, with score 0; ties go to the language
that sorts first. If nothing was learned every row is ``und``. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from molcorpus.llm.text import M1, M2, chunks

SIZES = (2, 4)
HASHES = 3
# Bytes of text at once: each needs some fifty bytes of arrays.
CHUNK = 2 << 20


def grams(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each n, the n-grams of lower-cased texts as integers, and each text's first place.
    A text is framed by spaces; an n-gram never spans two texts."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    lower = pc.binary_join_element_wise(" ", pc.utf8_lower(pc.fill_null(texts, "")), " ", "")
    sizes = pc.binary_length(lower).to_numpy(zero_copy_only=False).astype(np.int64)
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(sizes)], pa.int32()), lower), "")
    flat = np.frombuffer(joined[0].as_buffer(), np.uint8).astype(np.uint32)
    # white space is one kind of space
    flat[(flat >= 9) & (flat <= 13)] = 32
    start = np.concatenate([[0], np.cumsum(sizes)])
    for n in SIZES:
        gram = flat.copy()
        for i in range(1, n):
            gram[:-i] |= flat[i:] << np.uint32(8 * i)
        keep = np.ones(len(flat), bool)
        for i in range(1, n):
            last = start[1:] - i
            keep[last[last >= start[:-1]]] = False
        places = np.concatenate([[0], np.cumsum(keep)])
        yield gram[keep], places[start]


def positions(gram: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    """The positions of n-grams in a filter of ``2 ** bits`` positions."""
    h = gram.astype(np.uint64) * M1
    h ^= h >> np.uint64(29)
    h *= M2
    for i in range(HASHES):
        yield ((h >> np.uint64(i * 20)) & np.uint64((1 << bits) - 1)).astype(np.int64)


def identify(
    docs: DataFrame,
    learn_from: Column,
    key: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    sample: int = 4000,
    top: int = 3000,
    bits: int = 18,
) -> DataFrame:
    """Every row's key and text column's verdict: ``lang_pred`` and ``score``. Learns from rows
    that ``learn_from`` marks and that have a language, about ``sample`` of each."""
    spark = docs.sparkSession
    known = docs.filter(learn_from & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(lang).alias("l"), F.col(text).alias("t"), F.col(key).alias("k")
    )
    sizes = known.groupBy("l").count().orderBy("l").collect()  # one row per language
    names = [r["l"] for r in sizes]
    rate = F.create_map(*[F.lit(x) for r in sizes for x in (r["l"], min(1.0, sample / r["count"]))]) if sizes else None
    masks, filled = np.zeros((1, 1), np.uint64), np.zeros(0)
    words = max(1, -(-len(names) // 64))
    if names:
        draw = F.pmod(F.xxhash64("k", F.lit("language")), F.lit(1 << 20)) / float(1 << 20)

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in chunks(batches, "t", CHUNK):
                code = part.column("l").dictionary_encode()
                which = code.indices.to_numpy()
                for gram, start in grams(part.column("t")):
                    lang_of = np.repeat(which, np.diff(start)).astype(np.uint64)
                    both, n = np.unique((lang_of << np.uint64(32)) | gram.astype(np.uint64), return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [
                            code.dictionary.take(pa.array((both >> np.uint64(32)).astype(np.int64))),
                            pa.array((both & np.uint64(0xFFFFFFFF)).astype(np.int64)),
                            pa.array(n.astype(np.int64)),
                        ],
                        ["l", "gram", "n"],
                    )

        counted = (
            known.filter(draw < rate[F.col("l")]).mapInArrow(count, "l string, gram bigint, n bigint")
            .groupBy("l", "gram").agg(F.sum("n").alias("n"))
        )
        order = Window.partitionBy("l").orderBy(F.desc("n"), "gram")
        kept = counted.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= top)
        table = kept.select("l", "gram").toArrow()  # languages x top rows
        at = pc.index_in(table.column("l"), pa.array(names)).to_numpy()
        gram = table.column("gram").to_numpy().astype(np.uint32)
        masks = np.zeros((words, 1 << bits), np.uint64)
        for place in positions(gram, bits):
            np.bitwise_or.at(masks, (at // 64, place), np.uint64(1) << (at % 64).astype(np.uint64))
        fill = [((masks[i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean() for i in range(len(names))]
        filled = np.array(fill) ** HASHES
    shared = spark.sparkContext.broadcast((masks, filled))
    fallback = max(sizes, key=lambda r: r["count"])["l"] if sizes else "und"

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks, filled = shared.value
        narrow = masks[0].astype(np.uint8) if len(names) <= 8 else None
        for part in chunks(batches, text, CHUNK):
            n = part.num_rows
            hits, total = np.zeros((n, len(names))), np.zeros(n)
            for gram, start in grams(part.column(text)):
                total += np.diff(start)
                for word in range(words if names else 0):
                    held = None
                    for place in positions(gram, bits):
                        got = (masks[word] if narrow is None else narrow)[place]
                        held = got if held is None else held & got
                    for i in range(word * 64, min(len(names), word * 64 + 64)):
                        bit = (held >> held.dtype.type(i % 64)) & held.dtype.type(1)
                        before = np.concatenate([[0], np.cumsum(bit, dtype=np.int64)])
                        hits[:, i] += before[start[1:]] - before[start[:-1]]
            real = np.maximum((hits - total[:, None] * filled) / (1 - np.minimum(filled, 0.99)), 0)
            sums = real.sum(1)
            if names:
                best = real.argmax(1)
                score = np.where(sums > 0, real[np.arange(n), best] / np.where(sums > 0, sums, 1), 0)
                found = [names[b] if s > 0 else fallback for b, s in zip(best, sums)]
            else:
                found, score = ["und"] * n, np.zeros(n)
            has = part.column("_letter").to_numpy(zero_copy_only=False)
            found = [f if h else "und" for f, h in zip(found, has)]
            yield pa.RecordBatch.from_arrays(
                [part.column(key), pa.array(found, pa.string()), pa.array(np.where(has, score, 0.0))],
                [key, "lang_pred", "score"],
            )

    letter = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias("_letter")
    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text, letter).mapInArrow(predict, f"`{key}` {kind}, lang_pred string, score double")
