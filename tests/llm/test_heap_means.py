"""Clusters against a plain version that compares every vector with every centroid."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from molcorpus.llm import heap_means


def plain(rows, dims, clusters=16, rounds=3):
    """(key, cluster, distance, cluster_inertia, inertia, digest) of each (key, vector)."""
    kept = [(k, [int(np.floor(float(x) * 64)) for x in v]) for k, v in rows]
    named = sorted((hashlib.sha256(f"1:{k}".encode()).hexdigest(), v) for k, v in kept if k is not None)
    centroids = [v for _, v in named[:clusters]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), i) for i, c in enumerate(centroids))

    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in kept]
        for i in range(len(centroids)):
            members = [v for (_, v), c in zip(kept, own) if c == i]
            if members:
                centroids[i] = [sum(col) // len(members) for col in zip(*members)]
    found = [nearest(v) for _, v in kept]
    inertia = [sum(d for d, c in found if c == i) for i in range(len(centroids))]
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return [(k, c, d, inertia[c], sum(inertia), digests[c]) for (k, _), (d, c) in zip(kept, found)]


def run(df, **named):
    rows = heap_means.cluster(df, **named).collect()
    return sorted((tuple(r)[:6] for r in rows), key=str)


def table(spark, rows, kind="double", key="bigint"):
    rows = [(k, None if v is None else [None if x is None else float(x) for x in v]) for k, v in rows]
    return spark.createDataFrame(rows, f"vec_id {key}, embedding array<{kind}>").repartition(3)


@pytest.mark.parametrize("shape", ["spread", "groups", "coarse"])
def test_against_a_plain_version(spark, monkeypatch, shape):
    monkeypatch.setattr(heap_means, "BLOCK", 50)
    draw = np.random.default_rng(8)
    x = draw.standard_normal((400, 6))
    if shape == "groups":
        x = draw.standard_normal((12, 6))[draw.integers(0, 12, 400)] * 3 + x * 0.1
    if shape == "coarse":
        x = draw.integers(-1, 2, (400, 6)) / 64  # many ties and copies
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    assert run(table(spark, rows), dims=6) == sorted(plain(rows, 6), key=str)


def test_only_expired_vectors_are_rescanned(spark):
    draw = np.random.default_rng(8)
    x = draw.standard_normal((8, 6))[draw.integers(0, 8, 600)] * 20 + draw.standard_normal((600, 6)) * 0.1
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    found = heap_means.cluster(table(spark, rows).coalesce(1), dims=6, clusters=4).collect()
    assert 600 < found[0]["rescanned"] < 4 * 600
    assert sorted((tuple(r)[:6] for r in found), key=str) == sorted(plain(rows, 6, 4), key=str)


def test_rows_that_are_left_out(spark):
    nan, inf = float("nan"), float("inf")
    kept = [(0, [1, 2]), (7, [2, 1]), (9, [1, 2]), (9, [1, 2]), (9, [5, 5]), (12, [0, 0]), (None, [3, 3])]
    gone = [(1, None), (2, [nan, 1]), (3, [inf, 1]), (4, [None, 1]), (5, [1]), (6, []), (None, None)]
    df = table(spark, kept + gone).withColumn("cluster", F.lit("x")).withColumn("k", F.lit(1)).withColumn("own", F.lit(1))
    assert run(df, dims=2, clusters=3) == sorted(plain(kept, 2, 3), key=str)


def test_few_and_no_rows(spark):
    assert run(table(spark, []), dims=2) == []
    assert run(table(spark, [(None, [1, 2])]), dims=2) == []
    assert run(table(spark, [(5, [1, 2])]), dims=2) == sorted(plain([(5, [1, 2])], 2), key=str)
    with pytest.raises(Exception, match="beyond"):
        run(table(spark, [(1, [2.0**30, 0])]), dims=2)


def test_text_keys(spark):
    rows = [(f"v{i}", [i % 5, i % 3]) for i in range(40)]
    assert run(table(spark, rows, key="string"), dims=2, clusters=4) == sorted(plain(rows, 2, 4), key=str)


def test_large_components_are_exact():
    x = np.array([[2**25, -(2**25)], [2**25 - 1, 3]], np.int64)
    c = np.array([[0, 0], [-(2**25), 2**25 + 1]], np.int64)
    want = [[sum((int(a) - int(b)) ** 2 for a, b in zip(u, v)) for v in c] for u in x]
    assert heap_means.distances(x, c).tolist() == want
