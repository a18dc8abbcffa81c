"""Near-duplicates against all pairs."""

import random

import numpy as np
import pytest
from brute import components, shingles

from molcorpus.llm import minhash


def texts(seed, n=25):
    draw = random.Random(seed)
    names = [f"w{i}" for i in range(500)]
    out = []
    for _ in range(n):
        base = draw.choices(names, k=draw.randint(3, 120))
        out.append(" ".join(base))
        for _ in range(draw.randint(0, 6)):
            other = list(base)
            for _ in range(draw.randint(0, 3)):
                other[draw.randrange(len(other))] = draw.choice(names)
            out.append(("\n" if draw.random() < 0.5 else " ").join(other).upper())
    shared = draw.choices(names, k=60)
    out += [" ".join(shared + draw.choices(names, k=12)) for _ in range(20)]
    return out + [None, "", " \t ", "one two", "ONE  two", "one two three"]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_all_pairs(documents, seed, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK_HUBS", 3)
    monkeypatch.setattr(minhash, "BLOCK_MEMBERS", 2)
    own = texts(seed)
    want = components(list(enumerate(own)))
    rows = minhash.near_duplicates(documents(own)).collect()
    assert {r["doc_id"]: r["component_id"] for r in rows} == want
    assert {r["doc_id"]: r["n_shingles"] for r in rows} == {i: len(shingles(t)) for i, t in enumerate(own)}


def test_a_chain_is_one_component(documents):
    """Neighbours are similar, the ends are not."""
    words = [f"v{i}" for i in range(300)]
    own = [" ".join(words[i * 6 : i * 6 + 150]) for i in range(12)]
    assert components(list(enumerate(own)))[11] == 0
    assert {r["component_id"] for r in minhash.near_duplicates(documents(own)).collect()} == {0}


def test_empty_bins_walk_alike():
    """A bin that is empty in both sets takes the same value if its donor is shared."""
    draw = np.random.default_rng(6)
    base = np.unique(draw.integers(0, 2**63, 40, dtype=np.uint64) * np.uint64(2))
    agree = [
        (minhash.signature(base) == minhash.signature(np.sort(np.append(base, draw.integers(0, 2**63, 1, dtype=np.uint64) * np.uint64(2))))).mean()
        for _ in range(200)
    ]
    assert abs(np.mean(agree) - 40 / 41) < 0.01


def test_components(spark):
    draw = random.Random(3)
    edges = [(draw.randrange(60), draw.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(40)] + [(5, 5)]
    root = list(range(200))
    for _ in range(200):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = {r["node"]: r["root"] for r in minhash.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {i: root[i] for i in range(200) if root[i] != i}


def test_awkward_rows(awkward, no_rows):
    rows = minhash.near_duplicates(awkward).collect()
    assert len(rows) == 12
    by_id = {r["doc_id"]: r["component_id"] for r in rows}
    assert by_id[1] == by_id[2] == by_id[11] == 1
    assert all(by_id[i] == i for i in (3, 4, 5, 6, 7, 8, 9, 10))
    assert by_id[None] is None
    assert minhash.near_duplicates(no_rows).collect() == []


def test_repeated_rows(spark):
    rows = [(4, "a b c d e f"), (4, "a b c d e f"), (2, "A B C D E F"), (4, "another text under one id altogether")]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in got) == [(2, 2), (4, 2), (4, 2), (4, 4)]
