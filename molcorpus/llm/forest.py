"""Nearest neighbours by largest inner product: a forest of random-projection trees.

Vectors get one more component that makes all of them equally long, and queries none, so that the
largest inner product is the smallest angle. Each tree splits by the direction between two centres,
which start at two random rows and move to the means of the rows nearer to them; what the top of a
tree learns from is a bounded sample (``sample`` rows, the documented bound), and it is grown in a
task of its own, to cells of ``capacity`` rows of the sample (0.7 times the root of its size, if
that is not given). Every row of the table is then indexed: it goes to one cell of each tree. A cell
is dealt out in blocks of at most ``BLOCK_ROWS`` rows, and every block goes on splitting its own
rows to leaves of ``leaf`` rows, so that leaves do not grow with the table.

A query searches all trees through one priority queue, ordered by the sum of squared margins on
the wrong side on the way, until the cells opened sum up to ``share`` of one tree. The priority of
the last one, times ``reach`` (a quarter more for every doubling of the table beyond the sample,
twice at most, if not given), is its bound: inside the blocks of an opened cell it opens the leaves
whose priority is within the bound, the nearest one always. What lies in them is reranked exactly,
in double precision on the original vectors. Many queries of one cell are dealt out as well.

Equal vectors are indexed once, with the ``k + 1`` smallest ids that have them: no other id can
be among the nearest, since ties go to the smaller id. Vectors that are null, zero, of another
length than most, or hold null or non-finite components take no part, nor do rows without an id; a
row that is there twice counts once. Ids may be numbers or text, whose order is that of ties. With
fewer candidates than ``k`` all that were found are returned; an empty table gives an empty
result. Columns of other names are ignored.
"""

from __future__ import annotations

import heapq
import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from molcorpus.session import materialize

BLOCK_ROWS, BLOCK_ASKERS = 8_192, 4_096
# Rows that a split looks at, and how often its centres move.
SEEN, MOVES = 256, 5


def usable(vector: Column) -> Column:
    finite = F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    )
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64).reshape(-1, dims)


def lengthened(x: np.ndarray, longest: float) -> np.ndarray:
    rest = np.maximum(longest - (x * x).sum(1), 0)
    return np.concatenate([x, np.sqrt(rest)[:, None]], 1)


def asking(x: np.ndarray, longest: float) -> np.ndarray:
    """Queries of the same length: the component that rows get is 0, so that angles to rows are
    ordered as inner products are."""
    scale = np.sqrt(longest / np.maximum((x * x).sum(1), 1e-300))
    return np.concatenate([x * scale[:, None], np.zeros((len(x), 1))], 1)


def direction(x: np.ndarray, draw: np.random.Generator) -> tuple[np.ndarray, float]:
    """The unit direction from one centre to another, and the place half way."""
    a, b = x[draw.choice(len(x), 2, replace=False)]
    for _ in range(MOVES):
        nearer = ((x - a) ** 2).sum(1) < ((x - b) ** 2).sum(1)
        if nearer.all() or not nearer.any():
            break
        a, b = x[nearer].mean(0), x[~nearer].mean(0)
    normal = b - a
    if not np.abs(normal).max() > 0:
        normal = draw.standard_normal(x.shape[1])
    normal = normal / np.linalg.norm(normal)
    return normal, float((a + b) @ normal / 2)


def grow(x: np.ndarray, capacity: int, seed: int):
    """One tree: directions, thresholds and children by node; a negative child is a leaf. And the
    leaf of each row."""
    draw = np.random.default_rng(seed)
    normals, cuts, children = [], [], []
    leaf = np.zeros(len(x), np.int64)
    leaves = 0
    work = [(np.arange(len(x)), None, 0)]
    while work:
        rows, parent, side = work.pop()
        place = None
        if len(rows) > capacity:
            seen = rows if len(rows) <= SEEN else draw.choice(rows, SEEN, replace=False)
            normal, cut = direction(x[seen], draw)
            along = x[rows] @ normal
            # neither side gets less than a fifth, so that trees stay shallow
            cut = float(np.clip(cut, *np.quantile(along, [0.2, 0.8])))
            left = along < cut
            if left.any() and not left.all():
                place = len(normals)
                normals.append(normal)
                cuts.append(cut)
                children.append([0, 0])
                work += [(rows[left], place, 0), (rows[~left], place, 1)]
        if place is None:
            place = -1 - leaves
            leaf[rows] = leaves
            leaves += 1
        if parent is not None:
            children[parent][side] = place
    shape = (len(normals), x.shape[1])
    tree = (
        np.array(normals, np.float32).reshape(shape),
        np.array(cuts, np.float32),
        np.array(children, np.int32).reshape(len(normals), 2),
    )
    return tree, leaf


def route(tree, x: np.ndarray) -> np.ndarray:
    """The leaf of each row."""
    normals, cuts, children = tree
    node = np.zeros(len(x), np.int64) if len(normals) else np.full(len(x), -1)
    while (inner := np.flatnonzero(node >= 0)).size:
        at = node[inner]
        right = (x[inner] * normals[at]).sum(1) >= cuts[at]
        node[inner] = children[at, right.astype(int)]
    return -1 - node


def search(trees, x: np.ndarray, cells: int) -> tuple[list[tuple[int, int, float]], float]:
    """The (tree, cell, priority) a query opens, best first, from one queue over all trees; and
    the last priority."""
    queue = [(0.0, t, 0 if len(tree[0]) else -1) for t, tree in enumerate(trees)]
    heapq.heapify(queue)
    sides = [tree[0] @ x - tree[1] for tree in trees]
    opened: list[tuple[int, int, float]] = []
    while queue and len(opened) < cells:
        first, t, node = heapq.heappop(queue)
        children, margins = trees[t][2], sides[t]
        while node >= 0:
            margin = float(margins[node])
            near = int(margin >= 0)
            heapq.heappush(queue, (first + margin * margin, t, int(children[node, 1 - near])))
            node = int(children[node, near])
        opened.append((t, -1 - node, first))
    return opened, opened[-1][2] if opened else 0.0


def open_leaves(tree, x: np.ndarray, first: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, leaf) for all rows of ``x`` and all leaves of one tree within the row's bound; the
    nearest leaf of a row always."""
    normals, cuts, children = tree
    if not len(normals):
        return np.arange(len(x)), np.zeros(len(x), np.int64)
    margins = x @ normals.T - cuts
    rows, nodes, priority = np.arange(len(x)), np.zeros(len(x), np.int64), first.copy()
    found: list[tuple[np.ndarray, np.ndarray]] = []
    while len(rows):
        margin = margins[rows, nodes]
        near = (margin >= 0).astype(np.int64)
        far = priority + margin * margin
        both = far <= bound[rows]
        nodes, rows, priority = (
            np.concatenate([children[nodes, near], children[nodes[both], 1 - near[both]]]),
            np.concatenate([rows, rows[both]]),
            np.concatenate([priority, far[both]]),
        )
        ends = nodes < 0
        found.append((rows[ends], -1 - nodes[ends]))
        rows, nodes, priority = rows[~ends], nodes[~ends], priority[~ends]
    return tuple(np.concatenate(p) for p in zip(*found))


def forest_of(points: DataFrame, dims: int, longest: float, trees: int, sample: int, capacity: int) -> list:
    """The tops of the trees, each grown in a task from the same bounded sample."""
    some = materialize(points.orderBy(F.xxhash64("rep"), "rep").limit(sample).select("v", "rep"))
    spark = points.sparkSession
    numbers = spark.range(trees).select(F.col("id").cast("int").alias("tree"))

    def build(key: tuple, rows: pa.Table) -> pa.Table:
        x = lengthened(matrix(rows.sort_by("rep").column("v").combine_chunks(), dims), longest)
        tree, _ = grow(x, capacity, key[0].as_py())
        return pa.table({"tree": pa.array([key[0].as_py()], pa.int32()), "raw": pa.array([pickle.dumps(tree)], pa.binary())})

    # the sample is bounded, and every tree gets all of it
    dealt = some.crossJoin(F.broadcast(numbers)).groupBy("tree").applyInArrow(build, "tree int, raw binary")
    return [pickle.loads(r["raw"]) for r in sorted(dealt.collect())]


def nearest(
    vectors: DataFrame,
    is_query: Column,
    key: str = "vec_id",
    vector: str = "embedding",
    k: int = 20,
    trees: int = 16,
    sample: int = 32_768,
    capacity: int | None = None,
    leaf: int = 32,
    share: float = 0.9,
    reach: float | None = None,
    counts: bool = False,
) -> DataFrame:
    """For each row that ``is_query`` marks its ``k`` nearest other rows: query_id, rank from 1,
    the neighbour's id under the name of the key, score. With ``counts`` instead (asker, scored):
    how many rows were scored in all, for measuring."""
    spark = vectors.sparkSession
    kind = vectors.schema[vector].dataType.simpleString()
    of_ids = vectors.schema[key].dataType
    id_type = "string" if isinstance(of_ids, StringType) else "bigint"
    id_arrow = pa.string() if id_type == "string" else pa.int64()
    rows = (
        vectors.filter(F.col(key).isNotNull() & usable(F.col(vector)))
        .select(F.col(key).cast(id_type).alias("id"), F.col(vector).alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    )
    common = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    dims = common["n"] if common else 1
    rows = rows.filter(F.size("v") == dims)
    order = Window.partitionBy("v").orderBy("id")
    few = rows.select("id", "v").distinct().withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k + 1)
    points = materialize(
        few.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")).withColumn("rep", F.col("ids")[0])
    )
    longest = points.agg(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x))).first()[0] or 0.0
    n_points = points.count()
    known = min(n_points, sample)
    forest = forest_of(points, dims, longest, trees, sample, capacity or max(leaf // 2, int(0.7 * known**0.5)))
    # cells hold more rows the larger the table is beside the sample
    reach = reach or min(2.0, 1 + 0.25 * math.log2(max(n_points, 1) / max(known, 1)))
    # every tree's first cell at least
    cells = max(trees, int(share * max((len(tree[0]) + 1 for tree in forest), default=1)))
    shared = spark.sparkContext.broadcast(forest)
    # neighbouring cells share a group, up to the rows of a block
    together = max(1, BLOCK_ROWS * max((len(tree[0]) + 1 for tree in forest), default=1) // max(n_points, 1))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = lengthened(matrix(batch.column("v"), dims), longest)
            for t, tree in enumerate(shared.value):
                cell = pa.array(route(tree, x).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(x), t, np.int32)), cell, batch.column("v"), batch.column("rep")],
                    ["tree", "cell", "v", "rep"],
                )

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = asking(matrix(batch.column("v"), dims), longest)
            for start in range(0, len(x), 256):
                groups, firsts, bounds, at = [], [], [], []
                for i, y in enumerate(x[start : start + 256]):
                    opened, bound = search(shared.value, y, cells)
                    own: dict[tuple[int, int], list[tuple[int, float]]] = {}
                    for t, cell, first in opened:
                        own.setdefault((t, cell // together), []).append((cell, first))
                    groups += own.keys()
                    firsts += own.values()
                    bounds += [bound * reach] * len(own)
                    at += [start + i] * len(own)
                taken = batch.take(pa.array(at, pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([g[0] for g in groups], pa.int32()), pa.array([g[1] for g in groups], pa.int32()),
                        pa.array([[c for c, _ in f] for f in firsts], pa.list_(pa.int32())),
                        pa.array([[p for _, p in f] for f in firsts], pa.list_(pa.float64())),
                        pa.array(bounds, pa.float64()), taken.column("v"), taken.column("asker"),
                    ],
                    ["tree", "part", "cells", "first", "bound", "v", "asker"],
                )

    members = points.select("v", "rep").mapInArrow(index, f"tree int, cell int, v {kind}, rep {id_type}")
    members = materialize(members.withColumn("part", F.floor(F.col("cell") / together).cast("int")))
    # equal queries search once
    asked = rows.filter("q").groupBy("v").agg(F.min("id").alias("asker"))
    opened = materialize(
        asked.repartition(spark.sparkContext.defaultParallelism, "asker")
        .mapInArrow(ask, f"tree int, part int, cells array<int>, first array<double>, bound double, v {kind}, asker {id_type}")
    )
    # at most one row per cell of the trees: bounded by the sample
    parts = lambda n: F.ceil(F.count("*") / n).cast("int")
    blocks = members.groupBy("tree", "part").agg(parts(BLOCK_ROWS).alias("blocks"))
    salts = opened.groupBy("tree", "part").agg(parts(BLOCK_ASKERS).alias("salts"))
    dealt_out = F.broadcast(materialize(blocks.join(salts, ["tree", "part"])))
    place = F.struct("tree", "part", "block", "salt").alias("place")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    dealt = (
        members.join(dealt_out, ["tree", "part"])
        .withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
        .withColumn("salt", each("salts")).select(place, "cell", "v", "rep")
    )
    visits = (
        opened.join(dealt_out, ["tree", "part"])
        .withColumn("salt", F.pmod(F.xxhash64("asker"), F.col("salts")).cast("int"))
        .withColumn("block", each("blocks")).select(place, "v", "asker", "cells", "first", "bound")
    )
    out_type = pa.schema([("asker", id_arrow), ("rep", id_arrow), ("score", pa.float64())])

    def rerank(left: pa.Table, right: pa.Table) -> pa.Table:
        """Of the leaves that each query opens in one block its best; enough that none of the
        nearest is lost."""
        if not left.num_rows or not right.num_rows:
            return out_type.empty_table()
        left = left.sort_by("rep")  # the same leaves in every attempt
        base, asks = (matrix(side.column("v").combine_chunks(), dims) for side in (left, right))
        lengths, bound = lengthened(base, longest), right.column("bound").to_numpy()
        ways = asking(asks, longest)
        # every query's cells, by cell
        lists = right.column("cells").combine_chunks()
        asker = np.repeat(np.arange(len(asks)), lists.value_lengths().to_numpy())
        cell, first = lists.flatten().to_numpy(), right.column("first").combine_chunks().flatten().to_numpy()
        turn = np.argsort(cell, kind="stable")
        asker, cell, first = asker[turn], cell[turn], first[turn]
        of_row = left.column("cell").to_numpy()
        by_cell = np.argsort(of_row, kind="stable")
        none = np.empty(0, np.int64)
        out_who, out_row, out_score = [none], [none], [np.empty(0)]
        for c in np.unique(cell):
            rows = by_cell[np.searchsorted(of_row[by_cell], c) : np.searchsorted(of_row[by_cell], c, "right")]
            here = slice(np.searchsorted(cell, c), np.searchsorted(cell, c, "right"))
            if not len(rows):
                continue
            tree, where = grow(lengths[rows], leaf, len(rows))
            who, leaves = open_leaves(tree, ways[asker[here]], first[here], bound[asker[here]])
            for i in np.unique(leaves):
                own, askers = rows[where == i], asker[here][who[leaves == i]]
                if not len(own):
                    continue
                if counts:
                    out_who.append(askers)
                    out_row.append(np.full(len(askers), own[0]))
                    out_score.append(np.full(len(askers), float(len(own))))
                    continue
                scores = asks[askers] @ base[own].T
                keep = np.ones(scores.shape, bool)
                if len(own) > k + 1:
                    least = np.partition(scores, -k - 1, 1)[:, -k - 1]
                    # a margin keeps what rounding could have put behind
                    keep = scores >= least[:, None] - 1e-9
                a, b = np.nonzero(keep)
                out_who.append(askers[a])
                out_row.append(own[b])
                out_score.append((asks[askers[a]] * base[own[b]]).sum(1))
        found_who, found_row, score = (np.concatenate(p) for p in (out_who, out_row, out_score))
        if not counts:
            # over all leaves that were opened here
            best = np.lexsort((found_row, -score, found_who))
            begins = np.searchsorted(found_who[best], found_who[best])
            best = best[np.arange(len(best)) - begins <= k]
            found_who, found_row, score = found_who[best], found_row[best], score[best]
        return pa.Table.from_arrays(
            [right.column("asker").take(pa.array(found_who)), left.column("rep").take(pa.array(found_row)), pa.array(score)],
            schema=out_type,
        )

    found = (
        dealt.groupBy("place").cogroup(visits.groupBy("place"))
        .applyInArrow(rerank, f"asker {id_type}, rep {id_type}, score double")
    )
    if counts:
        return found.groupBy("asker").agg(F.sum("score").cast("bigint").alias("scored"))
    found = found.dropDuplicates(["asker", "rep"])
    # vectors of one score can share places, so that their ids are merged before the cut
    per = Window.partitionBy("asker").orderBy(F.desc("score"), "rep")
    best = found.withColumn("n", F.row_number().over(per)).filter(F.col("n") <= k + 1)
    listed = best.join(points.select("rep", "ids"), "rep").withColumn("id", F.explode("ids")).withColumn(
        "n", F.row_number().over(Window.partitionBy("asker").orderBy(F.desc("score"), "id"))
    ).filter(F.col("n") <= k + 1).groupBy("asker").agg(
        F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "id"))).alias("near")
    )
    askers = rows.filter("q").select(F.col("id").alias("query_id"), "v").distinct()
    askers = askers.join(asked, "v").select("query_id", "asker")
    return (
        askers.join(listed, "asker")
        .select("query_id", F.posexplode(F.slice(F.filter("near", lambda e: e["id"] != F.col("query_id")), 1, k)).alias("p", "e"))
        .select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("e.id").alias(key), (-F.col("e.s")).alias("score"))
    )
