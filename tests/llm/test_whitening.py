"""Whitening against plain fractions and a floating-point decomposition."""

from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from molcorpus.llm import whitening


def table(spark, rows, kind="float"):
    return spark.createDataFrame(rows, f"vec_id bigint, embedding array<{kind}>").repartition(3)


def plain(x, most=32):
    """Projections over standard deviations up to sign, shares of the trace, deviations."""
    whole = np.floor(np.asarray(x, float) * 64).astype(int) + 1_000_000
    n, d = whole.shape
    total = [sum(map(int, whole[:, j])) for j in range(d)]
    dev = [sum((n * int(r[j]) - total[j]) ** 2 for j in range(d)) for r in whole]
    centred = np.array([[float(Fraction(n * int(v) - t, n)) for v, t in zip(r, total)] for r in whole])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)
    return n, dev, centred @ vectors[:, order] / np.sqrt(np.maximum(values[order], 1e-300)), values[order] / values.sum()


def collected(df):
    return sorted(df.collect(), key=lambda r: (r["vec_id"], r["component"]))


@pytest.mark.parametrize(("n", "d"), [(300, 5), (150, 40)])
def test_against_a_plain_version(spark, n, d):
    draw = np.random.default_rng(d)
    x = (draw.standard_normal((n, d)) @ draw.standard_normal((d, d)) * 0.3 + draw.standard_normal(d)).astype(np.float32)
    rows = collected(whitening.whiten(table(spark, [(i, v.tolist()) for i, v in enumerate(x)])))
    k = min(d, 32)
    assert len(rows) == n * k
    count, dev, white, share = plain(x)
    for r in rows:
        c = r["component"] - 1
        assert r["n"] == count and r["deviation"] == dev[r["vec_id"]]
        assert r["explained"] == pytest.approx(share[c], rel=1e-9)
        assert abs(r["whitened"]) == pytest.approx(abs(white[r["vec_id"], c]), rel=1e-6, abs=1e-8)
        assert r["identity_error"] < 1e-9
    # one sign for all rows
    got = np.array([r["whitened"] for r in rows]).reshape(n, k)
    assert np.allclose(np.abs((got * white[:, :k]).sum(0)), n, rtol=1e-6)
    assert np.allclose(got.T @ got / n, np.eye(k), atol=1e-8)


def test_equal_eigenvalues(spark):
    """Vectors and their opposites along the axes: two double eigenvalues, one of them zero."""
    axes = [[1, 0, 0, 0, 0], [-1, 0, 0, 0, 0], [0, 1, 0, 0, 0], [0, -1, 0, 0, 0], [0, 0, 2, 0, 0], [0, 0, -2, 0, 0]]
    rows = collected(whitening.whiten(table(spark, [(i, [float(x) for x in v]) for i, v in enumerate(axes)])))
    assert len(rows) == 6 * 3
    assert [r["explained"] for r in rows[:3]] == pytest.approx([4 / 6, 1 / 6, 1 / 6], rel=1e-12)
    got = np.array([r["whitened"] for r in rows]).reshape(6, 3)
    assert np.allclose(got.T @ got / 6, np.eye(3), atol=1e-12)
    assert np.allclose((got[:, 1:] ** 2).sum(1), [3, 3, 3, 3, 0, 0], atol=1e-12)


def test_rows_that_are_left_out(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, None), (2, [nan, 1.0]), (3, [inf, 1.0]), (4, [None, 1.0]), (5, [0.0, 2.0]), (6, [1.0]),
            (7, []), (None, [3.0, 1.0]), (5, [0.0, 2.0])]
    found = whitening.whiten(table(spark, rows, "double").withColumn("whitened", F.lit("x")).withColumn("k", F.lit(1)))
    ids = [r["vec_id"] for r in found.collect() if r["component"] == 1]
    assert sorted(ids, key=str) == [0, 5, 5, None]
    n, dev, _, _ = plain([[1, 0], [0, 2], [3, 1], [0, 2]])
    assert {(r["n"], r["deviation"]) for r in found.collect()} == {(4, v) for v in dev}


def test_no_spread_and_no_rows(spark):
    assert whitening.whiten(table(spark, [])).collect() == []
    assert whitening.whiten(table(spark, [(1, [1.0, 2.0])])).collect() == []
    assert whitening.whiten(table(spark, [(i, [1.0, 2.0]) for i in range(9)])).collect() == []
    line = collected(whitening.whiten(table(spark, [(i, [float(i), 2.0 * i]) for i in range(4)])))
    assert [r["component"] for r in line] == [1] * 4 and line[0]["explained"] == 1.0


def test_text_ids(spark):
    df = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", [2.0, 5.0])], "name string, embedding array<double>")
    found = whitening.whiten(df, key="name").collect()
    assert {r["name"] for r in found} == {"a", "b", "c"} and len(found) == 6


def test_large_entries(spark):
    rows = [(0, [2.0**22, 1.0]), (1, [-(2.0**20), 3.0]), (2, [5.0, 2.0**21])]
    found = collected(whitening.whiten(table(spark, rows, "double"), most=1))
    assert len(found) == 3 and found[0]["identity_error"] < 1e-9
    with pytest.raises(Exception, match="beyond"):
        whitening.whiten(table(spark, [(0, [2.0**60]), (1, [0.0])], "double")).collect()


def test_polynomial_of_a_known_matrix(spark):
    # (x - 1) (x - 3) (x - 10)
    assert whitening.polynomial(spark, [[2, 1, 0], [1, 2, 0], [0, 0, 10]]) == [-30, 43, -14, 1]
    c = whitening.polynomial(spark, [[2, 1, 0], [1, 2, 0], [0, 0, 10]])
    bits = whitening.scale(c)
    assert [(r / 2**bits, n) for r, n in whitening.roots(c, 3)] == [(10.0, 1), (3.0, 1), (1.0, 1)]


def test_exact_products_of_large_numbers():
    y = np.array([[2**50 + 1, -(2**51) + 3], [-(2**49), 7], [5, -5]], np.int64)
    want = y.astype(object).T @ y.astype(object)
    assert whitening.exact_products(y) == [want[0, 0], want[0, 1], want[1, 1]]
    assert whitening.exact_products(y[2:]) == [25, -25, 25]


def test_close_eigenvalues_stay_apart(spark):
    """A gap of one part in 10**14 of the scatter, which doubles could not resolve."""
    big = 10**14
    found, values = whitening.components(spark, [[big + 1, 0, 0], [0, big, 1], [0, 1, big // 2]], 3)
    assert [a > b for (a, _), (b, _) in zip(values, values[1:])] == [True, True]
    assert np.abs(found[0]) == pytest.approx([1, 0, 0], abs=1e-15)
    assert np.abs(found[1]) == pytest.approx([0, 1, 2 / big], abs=1e-15)
