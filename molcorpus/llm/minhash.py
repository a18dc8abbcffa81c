"""Near-duplicates by one-permutation MinHash.

A document's set are its distinct shingles of ``shingle`` words (all words as one shingle, if it
has fewer). One hash per shingle is cut into a bin and a value; each bin keeps its smallest
value, and an empty bin takes over that of the first filled bin on a walk of its own, the same
for all documents (optimal densification). Bands of bins are buckets.

Documents of equal sets are one class from the start, known by a 128-bit digest. Candidate edges
are stars: every class is first compared with the smallest class of all its buckets only, which
joins most copies. Buckets whose classes are one component by then are done. In the others every
class meets all classes of its buckets once: hubs are held in blocks, a class goes once to every
block that has a hub from one of its buckets, and an index from shingles to hubs gives all its
intersections at once, on the full sets. A task reports only links that join components, so
neither pairs nor links of a large group are written out. No link between two classes that share
a bucket is lost. With 40 bands of 6 bins two sets of similarity 0.85 share no bucket with a
chance of 6e-9.

Null, empty and blank texts have an empty set and are linked with nothing. Rows of one id and
one text are one document, and each gets its result; rows of one id and several texts are judged
by their texts. Rows without an id have no component and link nothing. Ids may be numbers or
text, and a component has the type of the ids. Empty tables give empty
results; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from molcorpus.llm.text import M1, M2, chunks, hash_strings, list_column, mix, split_words, row_numbers, whole_numbers
from molcorpus.session import materialize

BINS, ROWS = 240, 6
SHINGLE = 5
# Hubs that are held in memory together, and members that meet them in one task.
BLOCK_HUBS, BLOCK_MEMBERS = 256, 500
# The walk of every bin over all bins: one random order each.
WALKS = np.argsort(np.random.default_rng(2024).random((BINS, BINS)), axis=1).astype(np.int32)
BAND_SEEDS = mix(np.arange(BINS, dtype=np.uint64))


def shingle_sets(texts: pa.Array, shingle: int = SHINGLE) -> list[np.ndarray]:
    """Each text's sorted distinct shingle hashes."""
    offsets, ids, distinct = split_words(texts)
    word = mix(hash_strings(distinct))[ids]
    if len(word) >= shingle:
        last = len(word) - shingle + 1
        rolled = np.zeros(last, np.uint64)
        for i in range(shingle):
            rolled = mix(rolled * M2 + word[i : i + last])
    sets = []
    for a, b in zip(offsets[:-1], offsets[1:]):
        n = b - a
        if n >= shingle:
            sets.append(np.unique(rolled[a : b - shingle + 1]))
        elif n:
            whole = np.array([n], np.uint64)
            for i in range(a, b):
                whole = mix(whole * M1 + word[i : i + 1])
            sets.append(whole)
        else:
            sets.append(np.empty(0, np.uint64))
    return sets


def signature(hashes: np.ndarray) -> np.ndarray:
    """The densified smallest value of each bin of a sorted, filled set of hashes."""
    bins = ((hashes >> np.uint64(32)) * np.uint64(BINS) >> np.uint64(32)).astype(np.int64)
    filled, first = np.unique(bins, return_index=True)
    values = np.zeros(BINS, np.uint64)
    values[filled] = hashes[first]
    if len(filled) < BINS:
        has = np.zeros(BINS, bool)
        has[filled] = True
        empty = np.flatnonzero(~has)
        walks = WALKS[empty]
        donor = walks[np.arange(len(empty)), has[walks].argmax(1)]
        values[empty] = values[donor]
    return values


def bands(values: np.ndarray) -> np.ndarray:
    mixed = mix(values ^ BAND_SEEDS).reshape(-1, ROWS)
    with np.errstate(over="ignore"):
        return mix(mixed.sum(1) + BAND_SEEDS[: len(mixed)])


def digest(hashes: np.ndarray) -> bytes | None:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest() if len(hashes) else None


def sketch(docs: DataFrame, key: str, text: str, shingle: int) -> DataFrame:
    """id, number of shingles, digest of the set (null if empty), hashes of its bands."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, text):
            sets = shingle_sets(part.column(text), shingle)
            rows = [bands(signature(s)) if len(s) else np.empty(0, np.uint64) for s in sets]
            places = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(key).cast(pa.int64()),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([digest(s) for s in sets], pa.binary()),
                    list_column(np.concatenate(rows).view(np.int64), places, pa.int64()),
                ],
                ["id", "n", "digest", "bands"],
            )

    return docs.select(key, text).mapInArrow(build, "id bigint, n bigint, digest binary, bands array<bigint>")


def blocks(hubs: DataFrame) -> DataFrame:
    """(class, block) of hubs (class, group): a large group is cut into several blocks."""
    parts = hubs.groupBy("group").agg(F.ceil(F.count("*") / BLOCK_HUBS).alias("parts"))
    block = F.xxhash64("group", F.pmod(F.xxhash64("class"), F.col("parts"))).alias("block")
    return materialize(hubs.join(parts, "group").select("class", block))


class Index:
    """Which of some sets hold a shingle."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets], np.int64)
        flat = np.concatenate(sets)
        order = np.argsort(flat, kind="stable")
        self.owner = np.repeat(np.arange(len(sets)), self.sizes)[order]
        self.shingles, first = np.unique(flat[order], return_index=True)
        self.bounds = np.append(first, len(flat))

    def similar(self, own: np.ndarray, percent: int) -> np.ndarray:
        """The sets that have 100 * intersection >= percent * union with this one."""
        at = np.searchsorted(self.shingles, own)
        at = at[self.shingles[np.minimum(at, len(self.shingles) - 1)] == own]
        low, sizes = self.bounds[at], self.bounds[at + 1] - self.bounds[at]
        before = np.cumsum(sizes) - sizes
        hits = self.owner[np.arange(sizes.sum()) + np.repeat(low - before, sizes)]
        common = np.bincount(hits, minlength=len(self.sizes))
        return np.flatnonzero((common > 0) & (100 * common >= percent * (self.sizes + len(own) - common)))


def confirm(hubs: DataFrame, visits: DataFrame, held: DataFrame, percent: int, shingle: int) -> DataFrame:
    """Links (a, b) that join all similar classes where ``visits`` (class, block) meet smaller
    ``hubs`` (class, block). ``held`` (class, digest, text) has the texts."""
    sizes = visits.groupBy("block").agg(F.ceil(F.count("*") / BLOCK_MEMBERS).cast("int").alias("salts"))
    members = visits.join(sizes, "block").select(
        "class", "block", F.pmod(F.xxhash64("class"), F.col("salts")).cast("int").alias("salt"), F.lit(True).alias("member")
    )
    centres = hubs.join(sizes, "block").select(
        "class", "block", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(False).alias("member")
    )
    texts = (
        held.join(members.unionByName(centres), "class")
        .repartition("block", "salt").sortWithinPartitions("block", "salt", "member")
        .select("block", "salt", "class", "member", "digest", "text")
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, names, sets, index, root = None, [], [], None, {}

        def find(x: int) -> int:
            while root.get(x, x) != x:
                root[x] = root.get(root[x], root[x])
                x = root[x]
            return x

        for part in chunks(batches):
            rows = zip(*(part.column(c).to_pylist() for c in ("block", "salt", "class", "member", "digest")))
            links: list[tuple[int, int]] = []
            for (block, salt, own, member, name), shingles in zip(rows, shingle_sets(part.column("text"), shingle)):
                if digest(shingles) != name:
                    continue  # another text of a repeated id
                if (block, salt) != at:
                    at, names, sets, index, root = (block, salt), [], [], None, {}
                if not member:
                    names.append(own)
                    sets.append(shingles)
                    continue
                if not sets:
                    continue
                index = index or Index(sets)
                for i in index.similar(shingles, percent).tolist():
                    if names[i] < own and find(names[i]) != find(own):
                        root[find(own)] = find(names[i])
                        links.append((names[i], own))
            yield pa.RecordBatch.from_arrays(
                [pa.array([g[0] for g in links], pa.int64()), pa.array([g[1] for g in links], pa.int64())], ["a", "b"]
            )

    return texts.mapInArrow(compare, "a bigint, b bigint")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each node of the edges (a, b) reaches, for all nodes
    but the roots. Neighbours are hung on the smallest neighbour in turns, first the larger and
    then the smaller ones, until all edges are stars; no node's neighbours meet in one row."""
    links = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b")
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        smallest = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(smallest, "a").select(F.col("m").alias("a"), "b").filter("a < b")
        lowest = large.groupBy("b").agg(F.min("a").alias("m"))
        joined = large.join(lowest, "b")
        small = joined.select(F.col("m").alias("a"), F.col("a").alias("b")).unionByName(joined.select(F.col("m").alias("a"), "b"))
        links = materialize(small.filter("a < b").distinct())
        # stars: every node hangs on one other, which hangs on none
        sides = links.select(F.expr("stack(2, a, 0, b, 1) AS (node, hangs)"))
        nodes = sides.groupBy("node").agg(F.sum("hangs").alias("n"), F.min("hangs").alias("least"))
        if nodes.filter("n > 1 OR (n = 1 AND least = 0)").isEmpty():
            return links.select(F.col("b").alias("node"), F.col("a").alias("root"))


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 85, shingle: int = SHINGLE
) -> DataFrame:
    """One row per document: key, n_shingles, component_id."""
    if not whole_numbers(docs, key):
        rows = row_numbers(docs.select(F.col(key).alias("k"), F.col(text).alias("t")), "row")
        numbered = rows.select(F.when(F.col("k").isNotNull(), F.col("row")).alias("row"), "t")
        found = near_duplicates(numbered.filter("row IS NOT NULL"), "row", "t", percent, shingle)
        named = materialize(found.join(rows.select("row", "k"), "row"))
        least = named.groupBy("component_id").agg(F.min("k").alias("least"))
        shown = named.join(least, "component_id").select(F.col("k").alias(key), "n_shingles", F.col("least").alias("component_id"))
        none = near_duplicates(numbered.filter("row IS NULL"), "row", "t", percent, shingle)
        kind = docs.schema[key].dataType
        lost = F.lit(None).cast(kind)
        return shown.unionByName(none.select(lost.alias(key), "n_shingles", lost.alias("component_id")))
    sketched = materialize(sketch(docs, key, text, shingle))
    classes = materialize(
        sketched.filter("digest IS NOT NULL AND id IS NOT NULL")
        .groupBy("digest").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands"))
        .withColumn("class", F.monotonically_increasing_id())
    )
    place = Window.partitionBy("bucket").orderBy("class")
    buckets = materialize(
        classes.select("class", F.explode("bands").alias("bucket"))
        .withColumn("first", F.first("class").over(place))
        .withColumn("next", F.lead("class").over(place))
        .filter("class > first OR next IS NOT NULL").drop("next")
    )
    classes = classes.drop("bands")
    texts = docs.select(F.col(key).cast("bigint").alias("rep"), F.col(text).alias("text"))
    shared = classes.join(buckets.select("class").distinct(), "class").select("rep", "class", "digest")
    held = materialize(texts.join(shared, "rep").select("class", "digest", "text"))

    # one hub for each class
    near = materialize(buckets.groupBy("class").agg(F.min("first").alias("group")))
    hubs = blocks(near.select(F.col("group").alias("class")).distinct().join(near, "class"))
    met = near.filter("class > group").join(hubs.withColumnRenamed("class", "group"), "group").select("class", "block")
    links = materialize(confirm(hubs, met, held, percent, shingle))
    roots = components(links).withColumnRenamed("node", "class")

    # buckets of several components: every class meets all others of its buckets
    rooted = buckets.join(roots, "class", "left").withColumn("root", F.coalesce("root", "class"))
    several = rooted.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high"))
    rest = materialize(buckets.join(several.filter("low <> high").select("bucket"), "bucket", "left_semi"))
    if not rest.isEmpty():
        hubs = blocks(rest.groupBy("class").agg(F.min("first").alias("group")))
        there = rest.join(hubs, "class").groupBy("bucket").agg(F.collect_set("block").alias("blocks"))
        visits = (
            rest.select("bucket", "class").join(there, "bucket").groupBy("class")
            .agg(F.array_distinct(F.flatten(F.collect_set("blocks"))).alias("blocks"))
            .select("class", F.explode("blocks").alias("block"))
        )
        links = links.unionByName(confirm(hubs, materialize(visits), held, percent, shingle))
        roots = components(materialize(links)).withColumnRenamed("node", "class")
    smallest = classes.join(roots, "class", "left").withColumn("root", F.coalesce("root", "class"))
    smallest = materialize(smallest)
    smallest = smallest.join(smallest.groupBy("root").agg(F.min("rep").alias("component_id")), "root")
    member = sketched.select("id", "n", "digest").join(smallest.select("digest", "component_id"), "digest", "left")
    own = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    return member.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), own.alias("component_id"))
