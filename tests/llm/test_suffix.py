"""Repeated strings against plain counting, and the sort against Python's."""

import random

import numpy as np
import pytest
from brute import without_repeats

from molcorpus.llm import suffix


def texts(seed):
    draw = random.Random(seed)
    base = ["".join(draw.choices("ab cd\né", k=draw.randint(0, 700))) for _ in range(12)]
    passage = "".join(draw.choices("xyz ", k=150))
    out = base + [base[0], base[3][:300] + base[5][100:], base[2][40:] + "!" + base[2], None, "", "a" * 1500, "ab" * 400]
    for i in range(30):
        out.append("".join(draw.choices("pqrst", k=draw.randint(0, 90))) + passage + "".join(draw.choices("uvw", k=60)))
    return out


@pytest.mark.parametrize("hot", [4000, 3])
def test_equals_plain_counting(documents, monkeypatch, hot):
    monkeypatch.setattr(suffix, "HOT", hot)
    monkeypatch.setattr(suffix, "BLOCK", 512)
    monkeypatch.setattr(suffix, "SORT_ROWS", 300)
    own = texts(3)
    rows = {r["doc_id"]: r for r in suffix.remove_repeated(documents(own), length=100).collect()}
    for i, want in enumerate(without_repeats(own, 100)):
        r = rows[i]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == want, i


def test_two_stages_sort_suffixes():
    draw = np.random.default_rng(4)
    for letters in (2, 5, 200):
        text = draw.integers(0, letters, 3000).astype(np.uint8)
        text[500:800] = text[1500:1800]
        wanted = np.arange(len(text) - 150)
        order = suffix.suffix_order(text, wanted, 100)
        assert sorted(order.tolist()) == wanted.tolist()
        keys = [text[p : p + 100].tobytes() for p in order]
        assert keys == sorted(keys)
        shared = suffix.common_prefixes(text, order, 100)
        for i in range(1, len(order), 37):
            a, b = keys[i - 1], keys[i]
            assert shared[i] == next((j for j in range(100) if a[j] != b[j]), 100)


def test_ids_that_are_null_or_repeated(spark):
    text = "".join(random.Random(5).choices("abcdefgh ", k=400))
    rows = [(1, text), (1, text), (None, text), (2, text[:150]), (3, None)]
    got = suffix.remove_repeated(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["n_removed"], r["n_spans"]) for r in got) == [
        (0, 400, 1), (1, 400, 1), (1, 400, 1), (2, 0, 0), (3, 0, 0),
    ]


def test_awkward_rows(awkward, no_rows):
    rows = suffix.remove_repeated(awkward).collect()
    assert len(rows) == 12
    by_id = {r["doc_id"]: r for r in rows}
    assert by_id[6]["n_removed"] == by_id[6]["n_bytes"] and by_id[6]["n_spans"] == 1
    assert by_id[9]["n_removed"] == 3000
    assert by_id[1]["n_removed"] == by_id[3]["n_bytes"] == 0
    assert suffix.remove_repeated(no_rows).collect() == []


def test_length_must_leave_room(no_rows):
    with pytest.raises(ValueError):
        suffix.remove_repeated(no_rows, length=20)
