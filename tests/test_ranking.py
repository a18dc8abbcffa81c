"""Ranks, prefixes, samples and splits against plain Python."""

import math
from hashlib import md5

import pytest
from pyspark.sql import functions as F

from molcorpus.operators import lookup, mix, ranking, vocab


@pytest.fixture
def rows(spark):
    """One key holds a third of the rows."""
    pairs = [(7, s) for s in range(100)] + [(d, s) for d in range(50) for s in range(4) if d != 7]
    return spark.createDataFrame(pairs, "doc_id bigint, seg bigint"), sorted(pairs)


@pytest.mark.parametrize("one_task", [10, 1_000_000])
@pytest.mark.parametrize("n", [0, 1, 31, 90, 131, 296])
def test_first_rows(rows, n, one_task, monkeypatch):
    monkeypatch.setattr(ranking, "ONE_TASK_ROWS", one_task)
    df, pairs = rows
    got = ranking.first_rows(df, ["doc_id", "seg"], n).collect()
    assert sorted(map(tuple, got)) == pairs[:n]


def test_nth_smallest_with_many_equal_values(spark, monkeypatch):
    monkeypatch.setattr(ranking, "ONE_TASK_ROWS", 5)
    values = sorted([3] * 40 + [5] * 60 + list(range(10, 30)))
    df = spark.createDataFrame([(v,) for v in values], "v bigint")
    for n in (1, 40, 41, 100, 101, 110, 120):
        assert ranking.nth_smallest(df, "v", n) == values[n - 1]


def test_portion_and_cap(rows):
    df, pairs = rows
    assert ranking.portion(df, ["doc_id", "seg"], 0.37).count() == int(len(pairs) * 0.37)
    assert ranking.cap(df, ["doc_id", "seg"], 10_000).count() == len(pairs)
    assert ranking.cap(df, ["doc_id", "seg"], 5).count() == 5


def test_rank_rows(rows):
    df, pairs = rows
    ranked = ranking.rank_rows(df, ["doc_id", "seg"]).collect()
    assert sorted((r["doc_id"], r["seg"]) for r in ranked) == pairs
    assert all(pairs[r["rank"]] == (r["doc_id"], r["seg"]) for r in ranked)
    within = ranking.rank_rows(df, ["seg"], ["doc_id"]).collect()
    assert all(r["rank"] == r["seg"] for r in within)


@pytest.mark.parametrize("one_task", [3, 1_000_000])
def test_number_rows(spark, one_task, monkeypatch):
    monkeypatch.setattr(ranking, "ONE_TASK_ROWS", one_task)
    df = spark.createDataFrame([(f"t{i}", 100 - i) for i in range(20)], "token string, freq bigint")
    got = ranking.number_rows(df, [F.desc("freq"), F.col("token")], start=4).collect()
    assert {r["token"]: r["id"] for r in got} == {f"t{i}": 4 + i for i in range(20)}


def _hash(key, seed=42):
    return md5(f"{seed}:{key}".encode()).hexdigest()


@pytest.mark.parametrize("one_task", [0, 1_000_000])
def test_sample_and_split(rows, one_task, monkeypatch):
    monkeypatch.setattr(ranking, "ONE_TASK_ROWS", one_task)
    df, pairs = rows
    order = sorted(pairs, key=lambda p: _hash(f"{p[0]}:{p[1]}"))
    got = ranking.sample_n(df, ["doc_id", "seg"], 57).collect()
    assert sorted(map(tuple, got)) == sorted(order[:57])
    assert ranking.sample_n(df, ["doc_id", "seg"], 10_000).count() == len(pairs)
    parts = ranking.split(df, ["doc_id", "seg"], 0.05).collect()
    test = sorted((r["doc_id"], r["seg"]) for r in parts if r["part"] == "test")
    assert test == sorted(order[: math.ceil(len(pairs) * 0.05)])


def test_split_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id bigint")
    assert ranking.split(empty, ["doc_id"], 0.5).count() == 0


def test_place_keeps_the_order(spark):
    keys = [(-3, 0, 5), (-3, 1, 0), (0, 0, 0), (0, 0, 1), (0, 2, 0), (9_000_000_000_000_000_000, 0, 0)]
    df = spark.createDataFrame(keys, "doc_id bigint, seg int, pos int")
    got = df.select("*", ranking.place(df, ["doc_id", "seg", "pos"]).alias("p")).orderBy("p")
    assert [tuple(r)[:3] for r in got.collect()] == keys


def test_interleave(spark):
    sizes = {"a": 300, "b": 40, "c": 500}
    rows = [(s, i) for s, n in sizes.items() for i in range(n)]
    df = spark.createDataFrame(rows, "source string, k bigint")
    got = mix.interleave(df, "source", ["k"], {"a": 0.5, "b": 0.2, "c": 0.3}).orderBy("idx").collect()
    taken = dict.fromkeys(sizes, 0)
    for i, row in enumerate(got):
        assert row["idx"] == i and row["k"] == taken[row["source"]]
        taken[row["source"]] += 1
        used_up = [s for s in sizes if taken[s] == sizes[s]]
        assert bool(used_up) == (i == len(got) - 1)


def test_interleave_without_rows_of_a_source(spark):
    df = spark.createDataFrame([("a", 1)], "source string, k bigint")
    assert mix.interleave(df, "source", ["k"], {"a": 0.5, "b": 0.5}).count() == 0


@pytest.mark.parametrize("literal,broadcast", [(256, 10_000), (1, 10_000), (1, 2)])
def test_lookup_ways_agree(spark, literal, broadcast, monkeypatch):
    monkeypatch.setattr(lookup, "LITERAL_ROWS", literal)
    monkeypatch.setattr(lookup, "BROADCAST_ROWS", broadcast)
    v = spark.createDataFrame([("[UNK]", 0), ("C", 4), ("N", 5), ("O", 6)], "token string, id bigint")
    df = spark.createDataFrame(
        [(1, ["C", "Q", "N", "C"]), (2, []), (3, ["O"]), (4, ["Q"]), (5, None), (6, [None, "C"])],
        "doc_id bigint, tokens array<string>",
    )
    coded = vocab.encode(df, "tokens", v, ["doc_id"])
    got = {r["doc_id"]: r["ids"] for r in coded.collect()}
    assert got == {1: [4, 0, 5, 4], 2: [], 3: [6], 4: [0], 5: None, 6: [0, 4]}
    text = {r["doc_id"]: r["text"] for r in vocab.decode(coded, "ids", v, ["doc_id"]).collect()}
    assert text == {1: "C[UNK]NC", 2: "", 3: "O", 4: "[UNK]", 5: None, 6: "[UNK]C"}
    nulls = lookup.replace_entries(df, "tokens", v, None, ["doc_id"], "ids").collect()
    assert {r["doc_id"]: r["ids"] for r in nulls}[1] == [4, None, 5, 4]
    twice = v.unionByName(spark.createDataFrame([("C", 9), ("N", 2), (None, 1)], v.schema))
    found = lookup.replace_entries(df, "tokens", twice, 0, ["doc_id"], "ids").collect()
    assert {r["doc_id"]: r["ids"] for r in found} == {1: [4, 0, 2, 4], 2: [], 3: [6], 4: [0], 5: None, 6: [0, 4]}


@pytest.mark.parametrize("literal,broadcast", [(256, 10_000), (1, 10_000), (1, 2)])
def test_lookup_of_unknown_entries_by_their_start(spark, literal, broadcast, monkeypatch):
    monkeypatch.setattr(lookup, "LITERAL_ROWS", literal)
    monkeypatch.setattr(lookup, "BROADCAST_ROWS", broadcast)
    monkeypatch.setattr(lookup, "TOGETHER", 2)  # lists lie across stretches
    v = spark.createDataFrame([("bC", 4), ("cC", 5), ("cO", 6)], "token string, id bigint")
    df = spark.createDataFrame([(1, ["bC", "cQ", "bQ", "cC", None]), (2, []), (3, None), (4, ["cO"])], "k int, tokens array<string>")
    got = lookup.replace_entries(df, "tokens", v, {"c": 9, "": 0}, ["k"], "ids").collect()
    assert {r["k"]: r["ids"] for r in got} == {1: [4, 9, 0, 5, 0], 2: [], 3: None, 4: [6]}


def test_lookup_takes_a_batch_in_stretches(spark, monkeypatch):
    """However many entries a batch has, only some are looked up at once."""
    sizes = []
    index_in = lookup.pc.index_in
    monkeypatch.setattr(lookup.pc, "index_in", lambda entries, **k: sizes.append(len(entries)) or index_in(entries, **k))
    monkeypatch.setattr(lookup, "TOGETHER", 4)
    monkeypatch.setattr(lookup.F, "arrow_udf", lambda f, kind: f)
    replace = lookup._arrow_lookup(spark, [("a", 1), ("b", 2)], lookup.pa.int64(), 0)
    got = replace(lookup.pa.array([["a", "x", "b"], None, ["b"] * 7]))
    assert got.to_pylist() == [[1, 0, 2], None, [2] * 7] and sizes == [4, 4, 2]


def test_a_large_table_in_bytes_is_joined(spark, monkeypatch):
    monkeypatch.setattr(lookup, "BROADCAST_BYTES", 100)
    monkeypatch.setattr(lookup, "LITERAL_ROWS", 0)
    monkeypatch.setattr(lookup, "_arrow_lookup", None)
    v = spark.createDataFrame([("C" * 50, 4), ("N", 5)], "token string, id bigint")
    df = spark.createDataFrame([(1, ["N", "x"])], "doc_id bigint, tokens array<string>")
    assert lookup.replace_entries(df, "tokens", v, 0, ["doc_id"], "ids").first()["ids"] == [5, 0]


@pytest.mark.parametrize("share", [1e-3, 0.3, 2.0])
def test_join_by_frequency(spark, share, monkeypatch):
    monkeypatch.setattr(lookup, "FREQUENT_SHARE", share)
    left = spark.createDataFrame([(i, "ab"[i % 2] if i < 80 else None if i > 95 else f"c{i}") for i in range(100)], "i int, k string")
    right = spark.createDataFrame([("a", 1), ("c85", 2), ("zz", 3)], "k string, v int")
    got = {r["i"]: r["v"] for r in lookup.join_by_frequency(left, right, "k").collect()}
    assert got == {i: 1 if i < 80 and i % 2 == 0 else 2 if i == 85 else None for i in range(100)}


def text_key(n):
    return f"<urn:{(n * 7919) % 1000:04}>"


@pytest.fixture
def keyed(spark):
    """The same rows by a whole number and by a text in the same order."""
    order = sorted(range(200), key=text_key)
    rows = [(i, text_key(n), [f"t{(n * k) % 17}" for k in range(n % 6)]) for i, n in enumerate(order)]
    return spark.createDataFrame(rows, "n bigint, id string, tokens array<string>").repartition(5)


def test_text_keys_give_the_same_prefix(keyed, monkeypatch):
    monkeypatch.setattr(ranking, "ONE_TASK_ROWS", 5)
    for share in (0.0, 0.31, 1.0):
        by_number = {r["n"] for r in ranking.portion(keyed, ["n"], share).collect()}
        assert {r["n"] for r in ranking.portion(keyed, ["id"], share).collect()} == by_number
    assert {r["n"] for r in ranking.cap(keyed, ["id", "n"], 37).collect()} == set(range(37))
    assert ranking.cap(keyed, ["id"], 500).count() == 200


def test_text_keys_give_the_same_vocabulary(keyed, monkeypatch):
    monkeypatch.setattr(ranking, "ONE_TASK_ROWS", 5)

    def ids(key):
        rows = vocab.token_rows(keyed, [key], "tokens")
        return {r["token"]: r["id"] for r in vocab.first_seen_vocab(rows, [key, "pos"]).collect()}

    assert ids("id") == ids("n")
    rows = vocab.token_rows(keyed, ["id"], "tokens")
    plan = vocab._first_seen(rows, ["id", "pos"])._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan


def test_invert_refuses_shared_ids(spark):
    v = spark.createDataFrame([("C", 4), ("N", 4)], "token string, id bigint")
    with pytest.raises(Exception, match="several tokens"):
        vocab.invert_vocab(v).collect()


def test_first_places_of_any_numbers(spark):
    """Most places are compared as one bigint; those that do not fit come out right as well."""
    keys = [-5, 0, 3, 2**33 - 1, 2**33, 2**62]
    for some in (keys, keys[1:], keys[4:], keys[2:4]):
        rows = [(t, k, s, p) for t in "ab" for k in some for s in (1, 1500) for p in (7, 2**21)]
        df = spark.createDataFrame(rows, "t string, k bigint, s int, p int")
        for order in (["k"], ["k", "p"], ["k", "s", "p"]):
            found = ranking.first_places(df, "t", order, F.count(F.lit(1)), "n")
            want = df.groupBy("t").agg(F.min(ranking.place(df, order)).alias("first"), F.count(F.lit(1)).alias("n"))
            assert found.schema == want.schema and sorted(found.collect()) == sorted(want.collect())
            assert "least(" in found._jdf.queryExecution().optimizedPlan().toString()
