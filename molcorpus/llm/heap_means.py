"""Centroid clustering with heap-ordered bounds, on whole numbers.

Vectors of exactly ``dims`` finite components become ``floor(64 x)``. They are kept in blocks of
at most ``BLOCK`` vectors; a block is one row, and in it every cluster has a heap of its vectors'
gaps. The gap of a vector is its distance to the nearest other centroid less the distance to its own;
when centroids move, it shrinks by at most the way of its own centroid and the longest way of
any other. These drifts are summed up per cluster, so nothing in a heap has to be touched: a gap is
stored with the drift so far added, and has expired once the drift reaches it. Every round pops the
expired vectors from the heaps and only those are compared exactly with all centroids, on whole
numbers (ties: the smaller number), and pushed to the heap of the cluster they then belong to. A
round's new sums come from what joined and left each cluster.

Gaps are doubles, rounded against the vector by ``SLACK``, so that a vector which is not popped
has exactly one nearest centroid, its own. Blocks are written after each round; a lost executor's
blocks are made again from the round before.

Starts are the ``clusters`` kept vectors with the smallest sha256 of ``1:<key>`` (equal hashes: the
smaller vector first); with fewer vectors there are fewer clusters. Rows without a key are
clustered but are no starts; without any start the result is empty. Rows that repeat are rows like
others. Vectors that are null, of another length, or hold null or non-finite components are left
out. Columns of other names are ignored. Components beyond 2**20 are an error, since squared
distances would not fit 64 bits.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from molcorpus.llm.text import list_column
from molcorpus.session import materialize

SCALE = 64
LARGEST = 2.0**20
BLOCK = 4096
SLACK = 1e-9
STATE = "keys array<{kind}>, x array<int>, own array<int>, gaps array<array<double>>, places array<array<int>>, popped bigint"


def usable(vector: Column, dims: int) -> Column:
    inner = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(vector) == dims) & inner, F.lit(False))


def starts(rows: DataFrame, clusters: int) -> np.ndarray:
    """The first centroids; a bounded number of rows."""
    name = F.sha2(F.concat(F.lit("1:"), F.col("k").cast("string")), 256)
    first = rows.filter("k IS NOT NULL").select(name.alias("h"), "v").orderBy("h", "v").limit(clusters).collect()
    return np.array([[whole(x) for x in r["v"]] for r in first], np.int64)


def whole(x: float) -> int:
    if abs(x) > LARGEST:
        raise ValueError("a component is beyond 2**20")
    return int(np.floor(float(x) * SCALE))


def distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances of all rows to all centroids, as whole numbers."""
    if max(np.abs(x).max(initial=0), np.abs(centroids).max(initial=0)) < 1 << 20 and x.shape[1] <= 1 << 10:
        # all sums stay below 2**53: doubles are exact
        a, b = x.astype(np.float64), centroids.astype(np.float64)
        return ((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * (a @ b.T)).astype(np.int64)
    return np.stack([((x - c) ** 2).sum(1) for c in centroids], 1)


def rescan(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each row, and its gap: at most what the next one is further away."""
    d = distances(x, centroids)
    own = d.argmin(1)
    each = np.arange(len(x))
    near = np.sqrt(d[each, own].astype(np.float64))
    d[each, own] = np.iinfo(np.int64).max
    far = np.sqrt(d.min(1).astype(np.float64)) if len(centroids) > 1 else np.full(len(x), np.inf)
    return own, far * (1 - SLACK) - near * (1 + SLACK)


def deltas(x: np.ndarray, before: np.ndarray, after: np.ndarray, clusters: int) -> tuple[np.ndarray, np.ndarray]:
    """What the vectors change in the clusters' counts and sums. Before: -1 for none."""
    count, total = np.zeros(clusters, np.int64), np.zeros((clusters, x.shape[1]), np.int64)
    np.add.at(count, after, 1)
    np.add.at(total, after, x)
    had = before >= 0
    np.subtract.at(count, before[had], 1)
    np.subtract.at(total, before[had], x[had])
    return count, total


def advance(block: dict, centroids: np.ndarray, drift: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One round of a block, in place: pop what has expired, rescan it, push it again. Returns the
    changes of counts and sums. ``drift``: how far gaps of each cluster have shrunk so far."""
    expired: list[int] = []
    for c, heap in enumerate(block["heaps"]):
        while heap and heap[0][0] <= drift[c]:
            expired.append(heapq.heappop(heap)[1])
    at = np.array(expired, np.int64)
    block["popped"] += len(at)
    if not len(at):
        return np.zeros(len(centroids), np.int64), np.zeros_like(centroids)
    x, before = block["x"][at], block["own"][at]
    own, gap = rescan(x, centroids)
    block["own"][at] = own
    for i, c, g in zip(expired, own.tolist(), (gap + drift[own]).tolist()):
        heapq.heappush(block["heaps"][c], (g, i))
    moved = before != own
    return deltas(x[moved], before[moved], own[moved], len(centroids))


def pack(keys: pa.Array, block: dict, kind: pa.DataType) -> list[pa.Array]:
    """A block as a row."""
    one = lambda values, kind: list_column(values, np.array([0, len(values)]), kind)
    heaps = block["heaps"]
    nested = pa.array([[[g for g, _ in h] for h in heaps]], pa.list_(pa.list_(pa.float64())))
    places = pa.array([[[i for _, i in h] for h in heaps]], pa.list_(pa.list_(pa.int32())))
    return [
        pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys), one(block["x"].ravel(), pa.int32()),
        one(block["own"], pa.int32()), nested, places, pa.array([block["popped"]], pa.int64()),
    ]


def unpack(row: pa.RecordBatch, dims: int) -> tuple[pa.Array, dict]:
    keys = row.column("keys").flatten()
    numbers = lambda name: row.column(name).flatten().to_numpy(zero_copy_only=False)
    heaps = [list(zip(g, i)) for g, i in zip(row.column("gaps")[0].as_py(), row.column("places")[0].as_py())]
    return keys, {
        "x": numbers("x").astype(np.int64).reshape(-1, dims), "own": numbers("own").astype(np.int64), "heaps": heaps,
        "popped": row.column("popped")[0].as_py(),
    }


COLUMNS = ["keys", "x", "own", "gaps", "places", "popped"]


def in_blocks(rows: DataFrame, dims: int, clusters: int) -> DataFrame:
    """The vectors in blocks, all of them expired."""
    kind = rows.schema["k"].dataType.simpleString()

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                part = batch.slice(start, BLOCK)
                values = part.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                if np.abs(values).max(initial=0) > LARGEST:
                    raise ValueError("a component is beyond 2**20")
                x = np.floor(values * SCALE).astype(np.int64).reshape(-1, dims)
                heaps = [[(-np.inf, i) for i in range(len(x))], *([] for _ in range(clusters - 1))]
                block = {"x": x, "own": np.full(len(x), -1), "heaps": heaps, "popped": 0}
                keys = part.column("k")
                yield pa.RecordBatch.from_arrays(pack(keys, block, keys.type), COLUMNS)

    return rows.mapInArrow(build, STATE.format(kind=kind))


def assign(state: DataFrame, centroids: np.ndarray, drift: np.ndarray, dims: int) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """A round over all blocks: the written blocks, and the changes of counts and sums."""
    kind = state.schema["keys"].dataType.elementType.simpleString()
    k = len(centroids)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                keys, block = unpack(batch.slice(i, 1), dims)
                count, total = advance(block, centroids, drift)
                change = pa.array([np.concatenate([count, total.ravel()]).tolist()], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([*pack(keys, block, keys.type), change], [*COLUMNS, "change"])

    written = materialize(state.select(*COLUMNS).mapInArrow(step, STATE.format(kind=kind) + ", change array<bigint>"))
    sums = written.select(F.posexplode("change").alias("i", "s")).groupBy("i").agg(F.sum("s").alias("s")).collect()
    found = np.zeros(k * (dims + 1), np.int64)
    for r in sums:
        found[r["i"]] = r["s"]
    return written, found[:k], found[k:].reshape(k, dims)


def cluster(
    vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", dims: int = 64, clusters: int = 16, rounds: int = 3
) -> DataFrame:
    """One row per kept vector: key, cluster, distance, cluster_inertia, inertia,
    centroid_sha256, rescans of its block over all rounds."""
    spark = vectors.sparkSession
    rows = vectors.filter(usable(F.col(vector), dims)).select(F.col(key).alias("k"), F.col(vector).alias("v"))
    kind = rows.schema["k"].dataType.simpleString()
    schema = (
        f"`{key}` {kind}, cluster int, distance bigint, cluster_inertia bigint, inertia bigint,"
        " centroid_sha256 string, rescanned bigint"
    )
    centroids = starts(rows, clusters)
    k = len(centroids)
    if not k:
        return spark.createDataFrame([], schema)
    state = in_blocks(rows, dims, k)
    drift = np.zeros(k)
    count, total = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
    for turn in range(rounds + 1):
        state, joined, added = assign(state, centroids, drift, dims)
        count, total = count + joined, total + added
        if turn == rounds:
            break
        moved = centroids.copy()
        full = count > 0
        moved[full] = total[full] // count[full][:, None]
        way = np.sqrt(((moved - centroids) ** 2).sum(1).astype(np.float64)) * (1 + SLACK)
        others = np.array([np.delete(way, c).max(initial=0) for c in range(k)])
        drift = (drift + way + others) * (1 + SLACK)
        centroids = moved
    return finished(state, centroids, key, schema, dims)


def finished(state: DataFrame, centroids: np.ndarray, key: str, schema: str, dims: int) -> DataFrame:
    k = len(centroids)

    def own_distances(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, dict, np.ndarray]]:
        for batch in batches:
            for i in range(batch.num_rows):
                keys, block = unpack(batch.slice(i, 1), dims)
                yield keys, block, ((block["x"] - centroids[block["own"]]) ** 2).sum(1)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(k, np.int64)
        for _, block, d in own_distances(batches):
            np.add.at(found, block["own"], d)
        yield pa.RecordBatch.from_arrays([pa.array(range(k), pa.int32()), pa.array(found)], ["c", "s"])

    state = state.select(*COLUMNS)
    inertia = np.zeros(k, np.int64)
    for r in state.mapInArrow(sums, "c int, s bigint").groupBy("c").agg(F.sum("s").alias("s")).collect():
        inertia[r["c"]] = r["s"]
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, block, d in own_distances(batches):
            own = block["own"]
            yield pa.RecordBatch.from_arrays(
                [
                    keys, pa.array(own.astype(np.int32)), pa.array(d), pa.array(inertia[own]),
                    pa.array(np.full(len(own), inertia.sum())), pa.array(names).take(pa.array(own)),
                    pa.array(np.full(len(own), block["popped"])),
                ],
                columns,
            )

    columns = [key, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "rescanned"]
    return state.mapInArrow(listed, schema)
