"""The language model against plain counting."""

import random

import pytest
from brute import katz as plain
from pyspark.sql import functions as F

from molcorpus.llm import katz


def texts(n, seed=1):
    draw = random.Random(seed)
    names = [f"w{min(int(draw.paretovariate(0.7)), 400)}" for _ in range(4000)]
    return [" ".join(draw.choices(names, k=draw.randint(0, 40))) for _ in range(n)]


def by_count(counter):
    return [sum(1 for n in counter.values() if n == r) for r in range(1, katz.K + 2)]


def test_scores_equal_plain_counting(spark, documents, monkeypatch):
    from collections import Counter

    from brute import words

    monkeypatch.setattr(katz, "CHUNK_ROWS", 30)
    monkeypatch.setattr(katz, "FREQUENT", 20)  # many contexts are dealt out
    own = texts(300)
    docs = documents(own)
    train = [t for i, t in enumerate(own) if i % 3]
    one = Counter(w for t in train for w in [*words(t), None])
    two = Counter(p for t in train for p in zip(["", *words(t)], [*words(t), None]))
    factor1, factor2 = list(katz.discounts(by_count(one))), list(katz.discounts(by_count(two)))
    want, sums = plain(train, own, factor1, factor2, frequent=20)
    rows = {r["doc_id"]: r for r in katz.score(docs, F.col("doc_id") % 3 == 0).collect()}
    assert len(rows) == len(own)
    for i, (score, base) in enumerate(want):
        assert rows[i]["held_out"] == (i % 3 == 0)
        assert rows[i]["score"] == pytest.approx(score, abs=1e-8)
        assert rows[i]["base_score"] == pytest.approx(base, abs=1e-8)
        assert rows[i]["train_tokens"] == sum(one.values())
        assert rows[i]["n_known"] == sum(one[w] > 0 for w in [*words(own[i]), None])
    assert all(s == pytest.approx(1, abs=1e-9) for s in sums.values())


def test_discounts_are_between_zero_and_one():
    for counts in ([100, 30, 12, 6, 4, 2], [100, 30, 12, 6, 40, 2], [0] * 6, [3, 0, 0, 0, 0, 0], [1, 2, 3, 4, 5, 6]):
        factor = katz.discounts(counts)
        assert ((factor > 0) & (factor < 1)).all()


def test_good_turing_by_hand():
    n = [100, 30, 12, 6, 4, 2]
    common = 6 * 2 / 100
    want = [((r + 1) * n[r] / n[r - 1] / r - common) / (1 - common) for r in range(1, 6)]
    assert list(katz.discounts(n)) == pytest.approx(want)


def test_awkward_rows(awkward):
    rows = katz.score(awkward, F.col("doc_id") == 7).collect()
    assert len(rows) == 12
    by_id = {r["doc_id"]: r for r in rows}
    assert by_id[3]["n_tokens"] == by_id[4]["n_tokens"] == by_id[5]["n_tokens"] == 1
    assert by_id[1]["score"] == by_id[2]["score"] == by_id[11]["score"]
    assert by_id[7]["held_out"] and by_id[7]["n_known"] < by_id[7]["n_tokens"]
    assert None in by_id and not by_id[None]["held_out"]


def test_nothing_to_learn_from(documents, no_rows):
    assert katz.score(no_rows, F.lit(False)).collect() == []
    (row,) = katz.score(documents(["a b"]), F.lit(True)).collect()
    assert (row["score"], row["base_score"], row["n_known"], row["train_tokens"]) == (0, 0, 0, 0)


def test_numbers_survive_packing():
    import numpy as np

    for values in (np.array([], np.int64), np.array([1, -2, 3], np.int16), np.array([0.5, float("inf")])):
        assert (katz.unpack(katz.pack(values), values.dtype.type) == values).all()
