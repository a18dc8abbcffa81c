"""The vocabulary matcher and the array fold against plain loops, at real sizes."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from molcorpus.functions import patterns as P
from molcorpus.operators import learned as L
from molcorpus.operators import matcher
from molcorpus.operators.merging import Merges


def greedy(text, tokens, longest):
    out, i = [], 0
    while i < len(text):
        hit = next((text[i:j] for j in range(min(len(text), i + longest), i, -1) if text[i:j] in tokens), None)
        out.append(hit)
        i += len(hit or "x")
    return out


def cut(trie, names, strings, going_on=0):
    flat, places = trie.cut(strings, going_on)
    return [[names[v] if v >= 0 else None for v in flat[a:b]] for a, b in zip(places[:-1], places[1:])]


@pytest.mark.parametrize("n,letters", [(5, "ab"), (300, "abc"), (3000, "CNO()=[]123é中\U0001f600")])
def test_cut_against_a_loop(n, letters, monkeypatch):
    draw = random.Random(n)
    tokens = ["".join(draw.choices(letters, k=draw.randint(1, 9))) for _ in range(n)] + [letters[0] * 40]
    tokens += tokens[:5]  # repeated tokens are one
    strings = ["".join(draw.choices(letters + "x", k=draw.randint(0, 80))) for _ in range(400)] + [letters[0] * 500]
    trie = matcher.Trie.build([tokens])
    want = [greedy(s, set(tokens), 40) for s in strings]
    assert cut(trie, tokens, strings) == want
    monkeypatch.setattr(matcher, "LONG", 10)
    assert cut(trie, tokens, strings) == want
    monkeypatch.setattr(matcher, "TOGETHER", 7)
    assert cut(trie, tokens, strings) == want


def test_no_tokens_and_no_strings():
    empty = matcher.Trie.build([[]])
    assert cut(empty, [], ["ab", ""]) == [[None, None], []]
    assert cut(empty, [], []) == []
    assert cut(matcher.Trie.build([["", "a"]]), ["", "a"], ["ab"]) == [["a", None]]


@pytest.mark.parametrize("n", [20_000, 200_000])
def test_many_tokens(n):
    """Real sizes: built and walked in seconds, with the same matches as the loop."""
    draw = random.Random(n)
    tokens = list({"".join(draw.choices("CNOScnos()=#123456[]@H+-", k=draw.randint(2, 12))) for _ in range(n)})
    strings = ["".join(draw.choices(tokens, k=draw.randint(1, 8))) + "Z" for _ in range(2000)]
    started = time.perf_counter()
    trie = matcher.Trie.build([tokens])
    built = time.perf_counter()
    got = cut(trie, tokens, strings)
    walked = time.perf_counter()
    known = set(tokens)
    assert got == [greedy(s, known, 12) for s in strings]
    assert built - started < 60 and walked - built < 10


def test_long_tokens(spark):
    """Tokens of 10,000 characters, which a nested pattern cannot hold."""
    long = "CN" * 5000
    tokens = ["C", long, long + "O", "N" * 10_000]
    strings = [long + "O" + long, "N" * 10_000 + "C", "CN" * 4999, long[1:] + "S"]
    df = spark.createDataFrame(list(enumerate(strings)), "i int, s string")
    found = {r["i"]: r["t"] for r in df.select("i", L.longest_match(F.col("s"), tokens).alias("t")).collect()}
    unknown = P.SPECIAL_TOKENS[0]
    assert found[0] == [long + "O", long] and found[1] == ["N" * 10_000, "C"]
    assert found[2] == ["C", unknown] * 4999
    assert found[3] == [unknown] + ["C", unknown] * 4999 + [unknown]


def test_nulls_stay(spark):
    df = spark.createDataFrame([(0, None), (1, ""), (2, "CX")], "i int, s string")
    rows = df.select("i", L.longest_match(F.col("s"), ["C"]).alias("t")).collect()
    assert {r["i"]: r["t"] for r in rows} == {0: None, 1: [], 2: ["C", P.SPECIAL_TOKENS[0]]}
    words = spark.createDataFrame([(0, None), (1, []), (2, ["CX", "", "CC", "X"])], "i int, s array<string>")
    rows = words.select("i", L.wordpiece(F.col("s"), ["C", "##C", "##X"]).alias("t")).collect()
    unknown = P.SPECIAL_TOKENS[0]
    assert {r["i"]: r["t"] for r in rows} == {0: None, 1: [], 2: ["C", "##X", unknown, "C", "##C", unknown]}


def test_the_plan_does_not_hold_the_vocabulary(spark):
    tokens = [f"token{i}" for i in range(5000)]
    df = spark.createDataFrame([(0, "token17")], "i int, s string").select(L.longest_match(F.col("s"), tokens).alias("t"))
    assert len(df._jdf.queryExecution().toString()) < 5000


def merged(symbols, rank):
    """Merge the best-ranked neighbours, everywhere from the left, until none is left."""
    symbols = list(symbols)
    while len(symbols) > 1:
        best = min(zip(symbols, symbols[1:]), key=lambda p: rank.get(p, 1 << 40))
        if best not in rank:
            break
        out, i = [], 0
        while i < len(symbols):
            if tuple(symbols[i : i + 2]) == best:
                out.append(best[0] + best[1])
                i += 2
            else:
                out.append(symbols[i])
                i += 1
        symbols = out
    return symbols


@pytest.mark.parametrize("letters", ["ab", "abcdef"])
@pytest.mark.parametrize("long", [512, 3])
def test_fold_against_a_loop(letters, long, monkeypatch):
    monkeypatch.setattr("molcorpus.operators.merging.LONG", long)
    draw = random.Random(len(letters))
    known, pairs = list(letters), []
    for _ in range(60):  # in any order, some tokens made in several ways
        pairs.append((draw.choice(known), draw.choice(known)))
        known.append("".join(pairs[-1]))
    draw.shuffle(pairs)
    rank = {}
    for i, p in enumerate(pairs):
        rank.setdefault(p, i)
    merges = Merges(pairs, list(letters))
    words = ["".join(draw.choices(letters + "z", k=draw.randint(0, 40))) for _ in range(300)] + [letters[0] * 99, ""]
    flat, places = merges.fold(words)
    names = merges.names.to_pylist()
    got = [[names[v] for v in flat[a:b]] for a, b in zip(places[:-1], places[1:])]
    assert got == [merged([c for c in w if c in letters], rank) for w in words]


def test_a_very_long_word_takes_less_than_a_second():
    draw = np.random.default_rng(3)
    word = "".join(np.array(list("abcdefgh"))[draw.integers(0, 8, 100_000)])
    known, pairs = list("abcdefgh"), []
    for _ in range(2000):
        pairs.append((known[draw.integers(0, len(known))], known[draw.integers(0, 8)]))
        known.append("".join(pairs[-1]))
    merges = Merges(pairs, list("abcdefgh"))
    started = time.perf_counter()
    flat, _ = merges.fold([word])
    assert time.perf_counter() - started < 1
    assert "".join(merges.names.take(flat).to_pylist()) == word
