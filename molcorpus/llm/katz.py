"""Katz backoff language model over words: training and scoring of a table of texts.

The model has two orders. Counts up to ``K`` are discounted by Good and Turing's estimate; what
that frees goes, for a word, to the one unknown word, and, for a pair, to the words not seen
after the context, in proportion to their probability without context. The backoff weight of a
context is computed from exactly the words seen after it, so that every distribution sums to one
over the known words and the unknown one. A token is evaluated by recursion: the pair if it was
seen, else the context's weight times the probability of the word alone. Where the counts of
counts are too uneven for the estimate (a discount outside 0 to 1), as groups of copies make
them, they are smoothed by a line through their logarithms; where that fails as well, half a
count is taken off. Frequent contexts, and those without a discounted word, keep one count for
unseen words.

Work is done in chunks of texts, known by a digest of their contents:

1. every chunk counts its distinct words; the counts meet by hash of the word, in a table of
   words by bucket, and every chunk gets the total counts of its words back;
2. every chunk sends its distinct pairs with the documents they occur in to the bucket of their
   context (a frequent context is dealt out by the second word, and its sums are put together
   afterwards); each bucket writes its part of the table of pairs, and what scoring needs;
3. with the counts of counts of all buckets the discounts are known, each bucket evaluates its
   tokens, and the sums meet by chunk.

Columns of numbers travel as compressed binaries. Null and empty texts have the end token only.
Rows without an id are learned from and keep their row; repeated rows count each time. Ids that
are no whole numbers go by numbers of their rows. With no
text to learn from every word is unknown, with probability one. Empty tables give empty results;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from molcorpus.llm.text import M2, chunks, hash_strings, mix, split_words, row_numbers, whole_numbers
from molcorpus.session import materialize

K = 5
CHUNK = 8 << 20
CHUNK_ROWS = 30_000
BUCKET_TOKENS = 1_250_000
# Contexts of more occurrences keep one count for unseen words; fewer are never dealt out.
FREQUENT = 1_000
MOST_SPLIT = 100_000
END = np.uint64(0x656E64)


def pack(values: np.ndarray) -> bytes:
    """An array of numbers as bytes: equal bytes of all numbers together, compressed."""
    raw = np.ascontiguousarray(values)
    planes = raw.view(np.uint8).reshape(len(raw), raw.itemsize).T.tobytes()
    return len(planes).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def unpack(data: bytes, kind: type) -> np.ndarray:
    size = int.from_bytes(data[:8], "little")
    planes = np.frombuffer(pa.decompress(data[8:], size, codec="zstd", asbytes=True), np.uint8)
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(planes.reshape(width, -1).T).view(kind).ravel()


def packed(rows: list[dict], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_pylist(rows, schema=schema) if rows else schema.empty_table()


class Chunk:
    """The tokens of a chunk of texts. Learned texts are numbered before the others."""

    def __init__(self, part: pa.RecordBatch):
        offsets, ids, distinct = split_words(part.column("t"))
        sizes = np.diff(offsets) + 1
        self.words = np.concatenate([hash_strings(distinct), [END]]).astype(np.uint64)
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        self.tokens = np.full(bounds[-1], len(distinct), np.int64)
        inner = np.ones(bounds[-1], bool)
        inner[bounds[1:] - 1] = False
        self.tokens[inner] = ids
        self.held = part.column("held").to_numpy(zero_copy_only=False)
        self.sizes, self.part = sizes, part
        order = np.argsort(self.held, kind="stable")
        self.rank = np.empty(len(order), np.int64)
        self.rank[order] = np.arange(len(order))
        self.order = order
        digest = xxhash.xxh64(self.words.tobytes())
        for piece in (self.tokens, sizes, self.held):
            digest.update(np.ascontiguousarray(piece).tobytes())
        self.name = int(np.uint64(digest.intdigest()).view(np.int64))

    def learned(self) -> np.ndarray:
        """How often the learned texts have each word."""
        return np.bincount(self.tokens[~np.repeat(self.held, self.sizes)], minlength=len(self.words))


def read(batches: Iterator[pa.RecordBatch]) -> Iterator[Chunk]:
    for part in chunks(batches, "t", CHUNK, CHUNK_ROWS):
        yield Chunk(part)


def word_bucket(words: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(words) % np.uint64(buckets)).astype(np.int64)


def discounts(counts: list[int]) -> np.ndarray:
    """The factor of counts 1 to K, from how many things were seen 1 to K + 1 times."""
    n = np.array(counts, float)
    r = np.arange(1, K + 1)
    tries = [n] if (n > 0).all() else []
    if (n > 0).sum() > 1:
        every = np.arange(1, K + 2)
        slope, level = np.polyfit(np.log(every[n > 0]), np.log(n[n > 0]), 1)
        tries.append(np.exp(level + slope * np.log(every)))
    for n in tries:
        common = (K + 1) * n[K] / n[0]
        factor = ((r + 1) * n[1:] / n[:-1] / r - common) / (1 - common) if common < 1 else np.zeros(K)
        if ((factor > 0) & (factor < 1)).all():
            return factor
    return (r - 0.5) / r


class Words:
    """The model of single words."""

    def __init__(self, total: int, kinds: int, counts: list[int]):
        self.total, self.kinds = total, kinds
        self.factor = np.concatenate([[1.0], discounts(counts), [1.0]])
        r = np.arange(1, K + 1)
        freed = float((np.array(counts[:K]) * r * (1 - self.factor[1 : K + 1])).sum())
        self.unknown = 1 - (total - freed) / (total + 1)

    def probability(self, count: np.ndarray) -> np.ndarray:
        seen = self.factor[np.minimum(count, K + 1)] * count / (self.total + 1)
        return np.where(count > 0, seen, self.unknown)

    def base(self, count: np.ndarray) -> np.ndarray:
        return np.log10((count + 0.5) / (self.total + 0.5 * (self.kinds + 1)))


COUNTED = pa.schema([("bucket", pa.int64()), ("chunk", pa.int64()), ("data", pa.list_(pa.binary()))])
TOTALS = pa.schema([("bucket", pa.int64()), ("chunk", pa.int64()), ("data", pa.list_(pa.binary())), ("sums", pa.list_(pa.int64()))])
TOTALS_SQL = "bucket bigint, chunk bigint, data array<binary>, sums array<bigint>"


def total_words(buckets: int):
    """Counts of one bucket's words over all chunks: a row of the table of words, and for each
    chunk the total counts and numbers of its words, in its order."""

    def run(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        names = table.column("chunk").to_pylist()
        data = table.column("data").to_pylist()
        words = [unpack(d[0], np.uint64) for d in data]
        counts = [unpack(d[1], np.int64) for d in data]
        distinct, place = np.unique(np.concatenate(words), return_inverse=True)
        total = np.bincount(place, np.concatenate(counts), len(distinct)).astype(np.int64)
        rank = np.empty(len(distinct), np.int64)
        rank[np.lexsort((distinct, -total))] = np.arange(len(distinct))
        number = rank * buckets + bucket
        by_count = [int((total == r).sum()) for r in range(1, K + 2)]
        sums = [int(total.sum()), int((total > 0).sum()), *by_count]
        rows = [{"bucket": bucket, "chunk": None, "data": [pack(distinct), pack(total)], "sums": sums}]
        start = 0
        seen: set[int] = set()
        for name, own in zip(names, words):
            part = place[start : start + len(own)]
            start += len(own)
            if name not in seen:  # equal chunks need one answer
                seen.add(name)
                rows.append({"bucket": bucket, "chunk": name, "data": [pack(total[part]), pack(number[part])], "sums": None})
        return packed(rows, TOTALS)

    return run


PAIRS = pa.schema([("bucket", pa.int64()), ("chunk", pa.int64()), ("learned", pa.int64()), ("n", pa.int64()), ("data", pa.list_(pa.binary())), ("docs", pa.list_(pa.binary()))])
PAIRS_SQL = "bucket bigint, chunk bigint, learned bigint, n bigint, data array<binary>, docs array<binary>"


def chunk_pairs(model: Words, word_buckets: int, buckets: int, split_from: int):
    """The pairs of a chunk, by bucket of their context, and its documents' sums over words."""

    def one(chunk: dict, count: np.ndarray, number: np.ndarray) -> list[dict]:
        sizes, held, rank = (unpack(chunk["data"][i], np.int64) for i in (2, 3, 4))
        tokens = unpack(chunk["data"][1], np.int32).astype(np.int64)
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        of = count[tokens]
        base = np.add.reduceat(model.base(of), bounds[:-1])
        known = np.add.reduceat((of > 0).astype(np.int64), bounds[:-1])
        back = np.argsort(rank)
        docs = [chunk["data"][5], chunk["data"][6], *map(pack, (held[back], sizes[back], known[back], base[back]))]
        end = len(count) - 1
        # contexts by local number; the start of a text is numbered after the words
        context = np.empty(len(tokens), np.int64)
        context[1:] = tokens[:-1]
        context[bounds[:-1]] = end + 1
        doc = np.repeat(rank, sizes)
        bits, doc_bits = int(end + 1).bit_length(), int(len(sizes)).bit_length()
        key = np.sort(((context << bits | tokens) << doc_bits | doc).view(np.uint64)).view(np.int64)
        doc, pair = key & ((1 << doc_bits) - 1), key >> doc_bits
        new = np.ones(len(pair), bool)
        new[1:] = pair[1:] != pair[:-1]
        context, word = pair[new] >> bits, pair[new] & ((1 << bits) - 1)
        context_number = np.concatenate([number + 1, [0]])[context]
        context_count = np.concatenate([count, [count[end]]])[context]
        word_number = number[word]
        h = mix(context_number.astype(np.uint64))
        h = np.where(context_count > split_from, mix(h ^ word_number.astype(np.uint64) * M2), h)
        bucket = (h % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        sizes_of_pair = np.diff(np.concatenate([np.flatnonzero(new), [len(pair)]]))
        first = np.concatenate([[0], np.cumsum(sizes_of_pair)])[:-1]
        moved = sizes_of_pair[order]
        total = np.concatenate([[0], np.cumsum(moved)])
        doc = doc[np.arange(len(doc)) + np.repeat(first[order] - total[:-1], moved)]
        mark = np.zeros(len(doc), bool)
        mark[total[:-1]] = True
        doc = np.where(mark, -1 - doc, doc).astype(np.int16)
        bucket = bucket[order]
        columns = [x[order] for x in (context_number, context_count, word_number, count[word])]
        cuts = np.searchsorted(bucket, np.arange(buckets + 1))
        name, learned = chunk["chunk"], int((held == 0).sum())
        rows = []
        for b in np.unique(bucket).tolist():
            i, j = cuts[b], cuts[b + 1]
            numbers, counts, words, word_counts = (x[i:j] for x in columns)
            fresh = np.ones(j - i, bool)
            fresh[1:] = numbers[1:] != numbers[:-1]
            at = np.flatnonzero(fresh)
            data = [
                pack(numbers[at]), pack(counts[at]), pack(np.diff(np.concatenate([at, [j - i]])).astype(np.int32)),
                pack(words), pack(word_counts), pack(doc[total[i] : total[j]]),
            ]
            rows.append({"bucket": b, "chunk": name, "learned": learned, "n": len(sizes), "data": data, "docs": None})
        rows.append({"bucket": name % buckets, "chunk": name, "learned": learned, "n": len(sizes), "data": None, "docs": docs})
        return rows

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return PAIRS.empty_table()
        answers = right.to_pylist()
        out = []
        for chunk in left.to_pylist():
            words = unpack(chunk["data"][0], np.uint64)
            bucket = word_bucket(words, word_buckets)
            count, number = np.empty(len(words), np.int64), np.empty(len(words), np.int64)
            filled = 0
            for answer in answers:
                at = np.flatnonzero(bucket == answer["bucket"])
                count[at], number[at] = (unpack(d, np.int64) for d in answer["data"])
                filled += len(at)
            if filled != len(words):
                raise RuntimeError("a chunk was read otherwise than before; write the input first")
            out += one(chunk, count, number)
        return packed(out, PAIRS)

    return run


SCORED = pa.schema([
    ("bucket", pa.int64()), ("chunks", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("by_count", pa.list_(pa.int64())),
    ("pairs", pa.list_(pa.binary())), ("docs", pa.list_(pa.binary())), ("contexts", pa.list_(pa.binary())),
    ("open", pa.list_(pa.binary())), ("split", pa.list_(pa.binary())), ("chunk", pa.int64()), ("info", pa.list_(pa.binary())),
])
SCORED_SQL = (
    "bucket bigint, chunks array<bigint>, sizes array<bigint>, by_count array<bigint>, pairs array<binary>, docs array<binary>, "
    "contexts array<binary>, open array<binary>, split array<binary>, chunk bigint, info array<binary>"
)


def total_pairs(model: Words, split_from: int):
    """One bucket's part of the table of pairs, and of every document in it the sum over seen
    pairs without their discounts, how many of them have which count, and the unseen ones."""

    def run(table: pa.Table) -> pa.Table:
        out = []
        rows = []
        for r in table.to_pylist():
            if r["docs"] is not None:
                out.append({"chunk": r["chunk"], "info": r["docs"]})
            else:
                rows.append(r)
        if not rows:
            return packed(out, SCORED)
        bucket = rows[0]["bucket"]
        numbers, counts, words, word_counts, docs, learned, starts = [], [], [], [], [], [], []
        n_docs = 0
        for r in rows:
            d = r["data"]
            n = unpack(d[2], np.int32)
            numbers.append(np.repeat(unpack(d[0], np.int64), n))
            counts.append(np.repeat(unpack(d[1], np.int64), n))
            words.append(unpack(d[3], np.int64))
            word_counts.append(unpack(d[4], np.int64))
            own = unpack(d[5], np.int16).astype(np.int64)
            first = own < 0
            own = np.where(first, -1 - own, own)
            starts.append(first)
            learned.append(own < r["learned"])
            docs.append(own + n_docs)
            n_docs += r["n"]
        numbers, counts, words, word_counts = map(np.concatenate, (numbers, counts, words, word_counts))
        docs, learned, starts = map(np.concatenate, (docs, learned, starts))
        context_ids, at, context = np.unique(numbers, return_index=True, return_inverse=True)
        context_count = counts[at]
        word_ids, at, word = np.unique(words, return_index=True, return_inverse=True)
        word_probability = model.probability(word_counts[at])
        key, pair = np.unique(context * len(word_ids) + word, return_inverse=True)
        pair = pair[np.cumsum(starts) - 1]
        seen = np.bincount(pair, learned, len(key)).astype(np.int64)
        context, word = key // len(word_ids), key % len(word_ids)
        by_count = [int((seen == r).sum()) for r in range(1, K + 2)]
        # per context: pairs by small count, tokens of larger counts, probability of what was seen
        n = len(context_ids)
        small = np.stack([np.bincount(context[seen == r], minlength=n) for r in range(1, K + 1)], 1)
        large = np.bincount(context, np.where(seen > K, seen, 0), n)
        lower = np.bincount(context, np.where(seen > 0, word_probability[word], 0), n)
        keeps = (context_count > FREQUENT) | (small.sum(1) == 0)
        whole = context_count + keeps
        value = np.where(seen > 0, np.log10(np.maximum(seen, 1)) - np.log10(np.maximum(whole, 1))[context], np.log10(word_probability)[word])
        sums = np.bincount(docs, value[pair], n_docs)
        of = seen[pair]
        tallies = [np.bincount(docs[of == r], minlength=n_docs).astype(np.int32) for r in range(1, K + 1)]
        # unseen pairs after a known context wait for its weight
        wait = (of == 0) & (context_count[context[pair]] > 0)
        waiting, waiting_docs = context[pair[wait]], docs[wait]
        order = np.argsort(waiting, kind="stable")
        used, slot = np.unique(waiting[order], return_inverse=True)
        split = np.flatnonzero(context_count > split_from)

        def stats(which: np.ndarray) -> list[bytes]:
            return [pack(x) for x in (context_ids[which], context_count[which], large[which], lower[which], keeps[which].astype(np.int8), *small[which].T)]

        kept = np.flatnonzero(seen > 0)
        out.append({
            "bucket": bucket, "chunks": [r["chunk"] for r in rows], "sizes": [r["n"] for r in rows], "by_count": by_count,
            "pairs": [pack(context[kept].astype(np.int32)), pack(context_ids), pack(word_ids[word[kept]]), pack(seen[kept])],
            "docs": [pack(sums), *map(pack, tallies)], "contexts": stats(used),
            "open": [pack(slot.astype(np.int32)), pack(waiting_docs[order].astype(np.int32))], "split": stats(split),
        })
        return packed(out, SCORED)

    return run


def read_stats(data: list[bytes]) -> tuple[np.ndarray, ...]:
    kinds = [np.int64, np.int64, np.float64, np.float64, np.int8, *[np.int64] * K]
    numbers, count, large, lower, keeps, *small = (unpack(d, k) for d, k in zip(data, kinds))
    return numbers, count, large, lower, keeps, np.stack(small, 1)


def log_weight(count, large, lower, keeps, small, factor) -> np.ndarray:
    """The logarithm of the backoff weight: what the seen words leave, over what they would have
    without context."""
    used = (small * factor * np.arange(1, K + 1)).sum(1) + large
    return np.log10(1 - used / (count + keeps)) - np.log10(1 - lower)


def score(docs: DataFrame, held_out: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: key, held_out, n_tokens, n_known, train_tokens, base_score and
    score (log10). Learns from the rows that ``held_out`` does not mark."""
    if not whole_numbers(docs, key):
        rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"), held_out.alias("h"))
        rows = row_numbers(rows, "row")
        found = score(rows.select("row", "t", "h"), F.col("h"), "row", "t")
        others = [c for c in found.columns if c != "row"]
        return rows.select("row", "k").join(found, "row").select(F.col("k").alias(key), *others)
    spark = docs.sparkSession
    sc = spark.sparkContext
    rows = docs.select(F.col(key).cast("bigint").alias("k"), F.col(text).alias("t"), F.coalesce(held_out, F.lit(False)).alias("held"))
    word_buckets = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in read(batches):
            n = chunk.learned()
            bucket = word_bucket(chunk.words, word_buckets)
            order = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[order], np.arange(word_buckets + 1))
            out = []
            for b in np.unique(bucket).tolist():
                at = order[cuts[b] : cuts[b + 1]]
                out.append({"bucket": b, "chunk": chunk.name, "data": [pack(chunk.words[at]), pack(n[at])]})
            yield from packed(out, COUNTED).to_batches()

    counted = rows.mapInArrow(count, "bucket bigint, chunk bigint, data array<binary>")
    totals = materialize(counted.groupBy("bucket").applyInArrow(total_words(word_buckets), TOTALS_SQL))
    sums = totals.filter("chunk IS NULL").select(*[F.sum(F.col("sums")[i]) for i in range(K + 3)]).first()
    total, kinds, *by_count = (int(x or 0) for x in sums)
    model = Words(total, kinds, by_count)
    buckets = max(word_buckets, total // BUCKET_TOKENS)
    split_from = max(FREQUENT, total // min(2 * buckets, MOST_SPLIT))

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.schema([("chunk", pa.int64()), ("data", pa.list_(pa.binary()))])
        for chunk in read(batches):
            ids = chunk.part.column("k").take(pa.array(chunk.order))
            data = [
                chunk.words, chunk.tokens.astype(np.int32), chunk.sizes, chunk.held.astype(np.int64), chunk.rank,
                ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), ids.is_null().to_numpy(zero_copy_only=False).astype(np.int8),
            ]
            yield from packed([{"chunk": chunk.name, "data": [pack(d) for d in data]}], kind).to_batches()

    answers = totals.filter("chunk IS NOT NULL").select("chunk", "bucket", "data")
    pairs = (
        rows.mapInArrow(tokens, "chunk bigint, data array<binary>").groupBy("chunk")
        .cogroup(answers.groupBy("chunk"))
        .applyInArrow(chunk_pairs(model, word_buckets, buckets, split_from), PAIRS_SQL)
    )
    scored = materialize(
        pairs.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(total_pairs(model, split_from), SCORED_SQL)
    )
    parts = scored.filter("bucket IS NOT NULL")
    sums = parts.select(*[F.sum(F.col("by_count")[i]) for i in range(K + 1)]).first()
    factor = discounts([int(x or 0) for x in sums])
    logs = np.log10(factor)

    # weights of contexts that were dealt out: at most MOST_SPLIT, from sums over buckets
    def split_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("split").to_pylist():
                numbers, count, large, lower, keeps, small = read_stats(data)
                columns = [numbers, count, large, lower, *small.T]
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.float64) if i > 1 else c) for i, c in enumerate(columns)], split_names)

    split_names = ["number", "count", "large", "lower", *[f"s{r}" for r in range(1, K + 1)]]
    kinds_sql = ", ".join(f"{n} {'bigint' if i < 2 else 'double'}" for i, n in enumerate(split_names))
    together = (
        parts.select("split").mapInArrow(split_rows, kinds_sql).groupBy("number")
        .agg(F.first("count").alias("count"), *[F.sum(n).alias(n) for n in split_names[2:]]).orderBy("number").toArrow()
    )
    cols = [together.column(n).to_numpy() for n in split_names]
    weight = log_weight(cols[1], cols[2], cols[3], 1, np.stack(cols[4:], 1), factor) if len(cols[0]) else np.empty(0)
    shared = sc.broadcast((cols[0], weight))

    def evaluate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split_numbers, split_weights = shared.value
        for batch in batches:
            for r in batch.to_pylist():
                values, *tallies = (unpack(d, np.float64 if i == 0 else np.int32) for i, d in enumerate(r["docs"]))
                for n, log in zip(tallies, logs):
                    values = values + n * log
                numbers, count, large, lower, keeps, small = read_stats(r["contexts"])
                weight = log_weight(count, large, lower, keeps, small, factor) if len(numbers) else np.empty(0)
                if len(split_numbers):
                    at = np.minimum(np.searchsorted(split_numbers, numbers), len(split_numbers) - 1)
                    weight = np.where(split_numbers[at] == numbers, split_weights[at], weight)
                slot, doc = (unpack(d, np.int32) for d in r["open"])
                values = values + np.bincount(doc, weight[slot], len(values))
                starts = np.concatenate([[0], np.cumsum(r["sizes"])])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(r["chunks"], pa.int64()), pa.array([pack(values[a:b]) for a, b in zip(starts[:-1], starts[1:])], pa.binary())],
                    ["chunk", "sums"],
                )

    by_chunk = parts.select("chunks", "sizes", "docs", "contexts", "open").mapInArrow(evaluate, "chunk bigint, sums binary")
    infos = scored.filter("chunk IS NOT NULL").select("chunk", "info")
    result = pa.schema([
        ("k", pa.int64()), ("held", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("score", pa.float64()),
    ])

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        copies = left.num_rows  # equal chunks have equal scores, and their sums came together
        if not copies:
            return result.empty_table()
        own = [unpack(d, np.float64) for d in right.column("sums").to_pylist()]
        values = np.sum(np.sort(np.stack(own), 0), 0) / copies
        tables = []
        for info in left.column("info").to_pylist():
            kinds = [np.int64, np.int8, np.int64, np.int64, np.int64, np.float64]
            ids, null, held, sizes, known, base = (unpack(d, k) for d, k in zip(info, kinds))
            tables.append(pa.Table.from_arrays(
                [pa.array(ids, mask=null.astype(bool)), pa.array(held == 1), pa.array(sizes), pa.array(known), pa.array(base), pa.array(values)],
                schema=result,
            ))
        return pa.concat_tables(tables)

    done = infos.groupBy("chunk").cogroup(by_chunk.groupBy("chunk")).applyInArrow(
        finish, "k bigint, held boolean, n_tokens bigint, n_known bigint, base double, score double"
    )
    return done.select(
        F.col("k").alias(key), F.col("held").alias("held_out"), "n_tokens", "n_known",
        F.lit(total).cast("bigint").alias("train_tokens"), F.col("base").alias("base_score"), "score",
    )
