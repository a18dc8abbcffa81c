"""Nearest neighbours against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from molcorpus.llm import forest


def exact(ids, x, queries, k):
    out = {}
    for q in queries:
        scores = [(-float((x[i].astype(float) * x[q].astype(float)).sum()), ids[i]) for i in range(len(ids)) if i != q]
        out[ids[q]] = [i for _, i in sorted(scores)[:k]]
    return out


def table(spark, ids, x, kind="float"):
    rows = [(int(i), None if v is None else [float(a) if a is not None else None for a in v]) for i, v in zip(ids, x)]
    return spark.createDataFrame(rows, f"vec_id bigint, embedding array<{kind}>")


def found(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append(r["vec_id"])
    return out


def test_recall(spark):
    draw = np.random.default_rng(3)
    centres = draw.standard_normal((10, 24))
    x = (centres[draw.integers(0, 10, 3000)] + draw.standard_normal((3000, 24))).astype(np.float32)
    x[::7] *= 3  # lengths differ
    ids = np.arange(3000)
    rows = forest.nearest(table(spark, ids, x), F.col("vec_id") % 50 == 0, capacity=64).collect()
    got, want = found(rows), exact(ids, x, range(0, 3000, 50), 20)
    assert set(got) == set(want)
    assert np.mean([len(set(got[q]) & set(want[q])) / 20 for q in want]) >= 0.9
    for r in rows[::40]:
        assert r["score"] == pytest.approx(float((x[r["vec_id"]].astype(float) * x[r["query_id"]].astype(float)).sum()), abs=1e-12)


def test_copies_and_ties(spark):
    """Many equal vectors: ties go to the smaller id, and a query is not its own neighbour."""
    x = [[1.0, 0.0]] * 60 + [[0.0, 1.0]] * 10 + [[1.0, 1.0]] * 2
    rows = forest.nearest(table(spark, range(72), x), F.col("vec_id") % 20 == 0, k=20, capacity=4).collect()
    got = found(rows)
    assert got == exact(range(72), np.array(x), [0, 20, 40, 60], 20)
    assert all(len(v) == 20 for v in got.values())


def test_rows_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    x = [[1, 2], None, [0, 0], [nan, 1], [inf, 1], [None, 1], [1, 1, 1], [2, 1], [-1, 0], [1, 2]]
    base = table(spark, range(10), x, "double")
    rows = base.unionByName(table(spark, [0], [[1, 2]], "double")).unionByName(
        spark.createDataFrame([(None, [5.0, 5.0])], base.schema)
    )
    got = found(forest.nearest(rows.withColumn("score", F.lit(1)), F.lit(True)).collect())
    assert got == {0: [9, 7, 8], 9: [0, 7, 8], 7: [0, 9, 8], 8: [0, 9, 7]}


def test_few_and_no_rows(spark):
    one = table(spark, [1], [[1.0]])
    assert forest.nearest(one, F.lit(True)).collect() == []
    assert forest.nearest(one.limit(0), F.lit(True)).collect() == []
    assert forest.nearest(table(spark, [1, 2], [[1.0], [2.0]]), F.col("vec_id") == 7).collect() == []


def test_few_rows_are_scored(spark):
    """Unit vectors without structure, the hardest case: recall of 0.9 from less than half of the
    rows, and from a smaller share of a larger table."""
    draw = np.random.default_rng(6)
    shares = []
    for n in (6_000, 24_000):
        x = draw.standard_normal((n, 16))
        x = (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32)
        df = table(spark, range(n), x)
        is_query, named = F.col("vec_id") % (n // 50) == 0, {"sample": 4_000, "leaf": 16, "trees": 8, "share": 0.6}
        got, want = found(forest.nearest(df, is_query, **named).collect()), exact(range(n), x, range(0, n, n // 50), 20)
        assert np.mean([len(set(got[q]) & set(want[q])) / 20 for q in want]) >= 0.9
        scored = forest.nearest(df, is_query, counts=True, **named).collect()
        shares.append(np.mean([r["scored"] / n for r in scored]))
    assert 0.5 > shares[0] > shares[1]


def test_text_ids(spark):
    x = np.random.default_rng(4).standard_normal((60, 4)).astype(np.float32)
    named = table(spark, range(60), x).withColumn("vec_id", F.format_string("v%03d", "vec_id")).withColumn("rep", F.lit(1))
    got = found(forest.nearest(named, F.col("vec_id") < "v005", share=50).collect())
    want = exact(range(60), x, range(5), 20)
    assert got == {f"v{q:03d}": [f"v{i:03d}" for i in near] for q, near in want.items()}


def test_bound_and_nearest_leaf():
    """All leaves within the bound, as a plain walk finds them."""
    x = np.random.default_rng(2).standard_normal((500, 5))
    tree, leaf = forest.grow(x, 10, 1)
    assert (forest.route(tree, x) == leaf).mean() > 0.99  # directions are stored as floats
    asks = np.random.default_rng(3).standard_normal((20, 5))
    first, bound = np.full(20, 0.1), np.linspace(0, 2, 20)
    rows, leaves = forest.open_leaves(tree, asks, first, bound)

    def walk(node, y, priority, limit):
        if node < 0:
            return {-1 - node}
        margin = float(y @ tree[0][node].astype(float) - tree[1][node])
        near = int(margin >= 0)
        out = walk(int(tree[2][node, near]), y, priority, limit)
        if priority + margin**2 <= limit:
            out |= walk(int(tree[2][node, 1 - near]), y, priority + margin**2, limit)
        return out

    for i in range(20):
        assert set(leaves[rows == i].tolist()) == walk(0, asks[i], 0.1, bound[i])


def test_cells_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(forest, "BLOCK_ROWS", 16)
    monkeypatch.setattr(forest, "BLOCK_ASKERS", 2)
    x = np.random.default_rng(1).standard_normal((200, 6))
    got = found(forest.nearest(table(spark, range(200), x), F.col("vec_id") < 5, trees=2, capacity=500, leaf=500).collect())
    assert got == exact(range(200), x.astype(np.float32), range(5), 20)
