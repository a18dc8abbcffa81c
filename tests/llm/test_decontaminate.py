"""Passages with and without substitutions, and clean documents."""

import itertools
import random

import numpy as np
import pytest

from molcorpus.llm import decontaminate

NAMES = [f"word{i}" for i in range(3000)]


@pytest.fixture(scope="module")
def case(spark):
    draw = random.Random(12)

    def prose(n):
        return draw.choices(NAMES, k=n)

    items = [prose(draw.randint(20, 60)) for _ in range(30)] + [prose(7), prose(3), [], prose(400)]
    docs, want = [], set()
    for i in range(200):
        text = prose(draw.randint(0, 300))
        if i % 4 == 0:
            j = draw.choice([*range(31), 33])
            passage = [w.upper() + draw.choice([",", ".", ""]) for w in items[j]]
            if i % 8 == 0 and len(passage) >= 20:  # one word in nine differs
                passage = ["other" if k % 9 == 4 else w for k, w in enumerate(passage)]
            at = draw.randint(0, len(text))
            text[at:at] = passage
            want.add((i, j))
        docs.append((i, " ".join(text)))
    docs.append((500, " ".join(items[32 - 1])))  # an item of three words is no evidence
    make = spark.createDataFrame
    bench = [(j, " ".join(w)) for j, w in enumerate(items)] + [(99, None), (None, "an item that has no name at all")]
    return make(docs, "doc_id bigint, text string"), make(bench, "item_id bigint, text string"), want


def test_all_passages_and_no_other(case):
    docs, items, want = case
    rows = decontaminate.passages(docs.repartition(5), items).collect()
    assert {(r["doc_id"], r["item_id"]) for r in rows} == want


def test_a_full_bitmap_changes_nothing(case, monkeypatch):
    """The bitmap only spares work: the join decides."""
    monkeypatch.setattr(decontaminate, "BITS", 6)
    docs, items, want = case
    rows = decontaminate.passages(docs.filter("doc_id < 40"), items).collect()
    assert {(r["doc_id"], r["item_id"]) for r in rows} == {w for w in want if w[0] < 40}


def test_awkward_rows(spark, awkward, no_rows):
    items = spark.createDataFrame([(1, "quick brown fox jumps over the lazy dog near the old river"), (2, None), (2, "")], "item_id bigint, text string")
    rows = decontaminate.passages(awkward, items).collect()
    assert sorted((r["doc_id"], r["item_id"], r["first_word"], r["n_agree"]) for r in rows) == [(1, 1, 1, 12), (2, 1, 1, 12), (11, 1, 1, 12)]
    assert decontaminate.passages(no_rows, items).collect() == []
    assert decontaminate.passages(awkward, items.limit(0)).collect() == []


def stretches(longest):
    """All ways to place agreeing words in a stretch, as bits, from the first to the last of them."""
    for n in range(1, longest + 1):
        for length in range(n, 4 * n // 3 + 1):
            if n > 1 or length == 1:
                for gaps in itertools.combinations(range(1, length - 1), length - n):
                    yield n, length, (1 << length) - 1 - sum(1 << g for g in gaps)


def without_seed(ways, masks):
    left = np.array(sorted(set(ways)), np.int64)
    for mask in masks:
        bits = int(mask[::-1], 2)
        hit = np.zeros(len(left), bool)
        for shift in range(25):
            hit |= (left >> shift) & bits == bits
        left = left[~hit]
    return len(left)


def test_every_stretch_holds_a_seed():
    """From 20 agreeing words one half is a stretch of its own, so these are all ways there are."""
    assert without_seed((w for n, _, w in stretches(19) if n >= 10), decontaminate.MASKS) == 0


def held_by_brute_force(doc, item, need):
    """Over all shifts and all stretches of each."""
    for shift in range(-len(item) + 1, len(doc)):
        low, high = max(0, -shift), min(len(item), len(doc) - shift)
        agree = np.array([doc[shift + i] == item[i] for i in range(low, high)])
        if agree.sum() >= need:
            count = np.concatenate([[0], np.cumsum(agree)])
            n = count[None, :] - count[:, None]
            length = np.arange(len(count))[None, :] - np.arange(len(count))[:, None]
            if ((n >= need) & (4 * n >= 3 * length) & (length > 0)).any():
                return True
    return False


def check_against_brute_force(spark, sizes, seed, substitutions, need):
    draw = random.Random(seed)
    names = NAMES[:200]
    items = [draw.choices(names, k=n) for n in sizes for _ in range(4)]
    docs = []
    for j, item in enumerate(items):
        for changed in [substitutions(len(item), draw) for _ in range(3)]:
            passage = ["other" if k in changed else w for k, w in enumerate(item)]
            text = draw.choices(names, k=draw.randint(0, 12))
            at = draw.randint(0, len(text))
            docs.append(text[:at] + passage + text[at:])
    make = spark.createDataFrame
    rows = decontaminate.passages(
        make([(i, " ".join(d)) for i, d in enumerate(docs)], "doc_id bigint, text string").repartition(4),
        make([(j, " ".join(w)) for j, w in enumerate(items)], "item_id bigint, text string"),
    ).collect()
    want = {(i, j) for i, d in enumerate(docs) for j, item in enumerate(items) if held_by_brute_force(d, item, need(len(item)))}
    assert {(r["doc_id"], r["item_id"]) for r in rows} == want
    assert all(4 * r["n_agree"] >= 3 * r["n_words"] for r in rows)
    return want, len(docs)


def test_substitutions_against_brute_force(spark):
    def some(n, draw):
        return draw.sample(range(n), n // 4) if draw.random() < 0.7 else range(3, n, 4)

    want, n = check_against_brute_force(spark, range(14, 26), 3, some, lambda size: 10)
    assert len(want) > n // 2


def test_every_stretch_of_a_short_item_holds_a_seed():
    for size in range(decontaminate.SHORTEST, decontaminate.LONG):
        ways = (w for n, length, w in stretches(size) if n >= decontaminate.needed(size) and length <= size)
        assert without_seed(ways, decontaminate.SHORT_MASKS) == 0


def test_short_items_against_brute_force(spark):
    def some(n, draw):
        return draw.sample(range(n), n // 4)

    want, n = check_against_brute_force(spark, range(5, 14), 4, some, lambda size: min(10, -(-3 * size // 4)))
    assert len(want) >= n


def test_more_evidence_is_no_less():
    """Twelve agreeing words, then blocks of five differing and eleven agreeing."""
    for k in range(8):
        agree = np.array([True] * 12 + ([False] * 5 + [True] * 11) * k)
        a, b = decontaminate.best_stretch(agree)
        assert agree[a:b].sum() >= 12 and 4 * agree[a:b].sum() >= 3 * (b - a)


def test_scripts_without_spaces(spark):
    passage = "水分子由两个氢原子和一个氧原子组成。"
    make = spark.createDataFrame
    docs = make([(1, "前言:" + passage + "结束"), (2, "今天天气很好我们去公园散步吧"), (3, "plain words")], "doc_id bigint, text string")
    rows = decontaminate.passages(docs, make([(1, passage), (2, "短句")], "item_id bigint, text string")).collect()
    assert [(r["doc_id"], r["item_id"], r["n_agree"]) for r in rows] == [(1, 1, 17)]
