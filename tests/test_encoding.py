"""Hybrid encoding, windows, padding and packing."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from molcorpus.functions import patterns as P
from molcorpus.operators import hybrid as H
from molcorpus.operators import vocab as V
from molcorpus.operators import windows as W
from molcorpus.plans import QUERIES

S = F.col("s")


@pytest.fixture(scope="module")
def vocabularies(spark):
    base = [*P.SPECIAL_TOKENS, "is", "C", ".", P.START_TAG, P.END_TAG]
    chem = [*P.SPECIAL_TOKENS, "C", "O", "is"]
    make = lambda tokens: spark.createDataFrame(
        [(t, i) for i, t in enumerate(tokens)], "token string, id bigint"
    )
    return make(base), make(chem)


def test_pieces(column):
    texts = [
        "a [START_SMILES]C[END_SMILES] b",
        "[START_SMILES]C[END_SMILES][START_SMILES]O[END_SMILES]",
        "[START_SMILES]C\n[END_SMILES] x",
        "",
        "[END_SMILES][START_SMILES]",
    ]
    assert column(texts, H.pieces_of(S)) == [
        ["a ", "[START_SMILES]C[END_SMILES]", " b"],
        ["[START_SMILES]C[END_SMILES]", "[START_SMILES]O[END_SMILES]"],
        ["[START_SMILES]C\n[END_SMILES] x"],
        [],
        ["[END_SMILES][START_SMILES]"],
    ]


def test_hybrid_encode(strings, vocabularies):
    base, chem = vocabularies  # base ids 0-8, chemical ids 9-15
    texts = [
        "C is. [START_SMILES]CON[END_SMILES] what",
        "[START_SMILES]C\nO[END_SMILES]",  # whole piece begins and ends with tags
        "x [START_SMILES]C\n[END_SMILES].",  # tags lines apart are words of the text
        "",
    ]
    rows = H.hybrid_encode(strings(texts), "s", base, chem, ["doc_id"]).collect()
    assert {r["doc_id"]: r["ids"] for r in rows} == {
        0: [5, 4, 6, 7, 13, 14, 9, 8, 0],
        1: [7, 13, 14, 8],
        2: [0, 7, 5, 8, 6],
        3: [],
    }


def test_hybrid_tokens_and_ids(spark, vocabularies):
    base, chem = vocabularies
    words = spark.createDataFrame([(t,) for t in ("C", "O", "is", P.END_TAG, "zz", "[UNK]")], "token string")
    got = {r["token"]: r["id"] for r in V.hybrid_encode_token(words, base, chem).collect()}
    assert got == {"C": 5, "O": 14, "is": 4, P.END_TAG: 8, "zz": 9, "[UNK]": 9}
    ids = spark.createDataFrame([(i,) for i in (5, 7, 13, 15)], "id bigint")
    plain = {r["id"]: r["token"] for r in V.hybrid_decode_token(ids, base, chem).collect()}
    assert plain == {5: "C", 7: P.START_TAG, 13: "C", 15: "is"}
    bare = {r["id"]: r["token"] for r in V.hybrid_decode_token(ids, base, chem, True).collect()}
    assert bare == {5: "C", 7: "", 13: "C", 15: "is"}


def test_unknown_mode(strings, vocabularies):
    with pytest.raises(ValueError, match="unknown mode"):
        H.encode_mode(strings(["C"]), "s", "other", *vocabularies, ["doc_id"])


def test_leading_bos(spark):
    df = spark.createDataFrame([(0, [2, 7]), (1, [2, 7]), (2, [7, 2]), (3, [])], "seg int, ids array<int>")
    rows = df.select("seg", H.strip_leading_bos(F.col("ids"), F.col("seg"), 2).alias("ids")).collect()
    assert {r["seg"]: r["ids"] for r in rows} == {0: [2, 7], 1: [7], 2: [7, 2], 3: []}


def test_only_the_first_piece_keeps_its_bos(strings, vocabularies):
    base, chem = vocabularies
    bos = P.SPECIAL_TOKENS[2]
    started = lambda t: F.concat(F.array(F.lit(bos)), H.base_tokens(t))
    texts = [f"is {P.START_TAG}C{P.END_TAG} is", f"{P.START_TAG}C{P.END_TAG} is", ""]
    rows = H.hybrid_encode(strings(texts), "s", base, chem, ["doc_id"], base_tokenizer=started, bos=bos).collect()
    plain = H.hybrid_encode(strings(texts), "s", base, chem, ["doc_id"]).collect()
    known = {r["token"]: r["id"] for r in base.collect()}.get(bos, 0)
    want = {r["doc_id"]: r["ids"] for r in plain}
    assert {r["doc_id"]: r["ids"] for r in rows} == {0: [known, *want[0]], 1: want[1], 2: want[2]}


def loop_windows(ids, max_length, stride):
    if len(ids) <= max_length:
        return [ids]
    out = []
    for i in range(0, len(ids), max_length - stride):
        out.append(ids[i : i + max_length])
        if i + max_length >= len(ids):
            break
    return out


@settings(max_examples=15, deadline=None)
@given(lengths=st.lists(st.integers(0, 60), min_size=1, max_size=6), m=st.integers(1, 20), data=st.data())
def test_windows(spark, lengths, m, data):
    stride = data.draw(st.integers(0, m - 1))
    rows = [(i, list(range(n))) for i, n in enumerate(lengths)]
    df = spark.createDataFrame(rows, "doc_id int, ids array<int>")
    got = W.token_windows(df, "ids", m, stride).orderBy("doc_id", "win").collect()
    for key, ids in rows:
        assert [r["ids"] for r in got if r["doc_id"] == key] == loop_windows(ids, m, stride)


def test_stride_must_leave_a_step(spark):
    with pytest.raises(ValueError):
        W.token_windows(spark.range(1).withColumn("ids", F.array(F.lit(1))), "ids", 4, 4)


def test_effective_length():
    assert W.effective_length(4096) == 4096
    assert W.effective_length(10**30) == 2048


def test_pad_and_mask(spark):
    rows = [(i, list(range(2, 2 + n))) for i, n in enumerate([3, 1, 0, 5, 2])]
    df = spark.createDataFrame(rows, "doc_id bigint, ids array<bigint>")
    got = {r["doc_id"]: r for r in W.pad_batch(df, ["doc_id"], "ids", 2, 1).collect()}
    assert {k: r["ids"] for k, r in got.items()} == {
        0: [2, 3, 4], 1: [2, 1, 1], 2: [1] * 5, 3: [2, 3, 4, 5, 6], 4: [2, 3],
    }
    assert {k: r["batch"] for k, r in got.items()} == {0: 0, 1: 0, 2: 1, 3: 1, 4: 2}
    mask = df.select("doc_id", W.attention_mask(F.col("ids"), 3).alias("m")).collect()
    assert {r["doc_id"]: r["m"] for r in mask}[0] == [1, 0, 1]


def test_packing_loses_nothing(spark):
    rows = [(i, [i] * n) for i, n in enumerate([16, 1, 9, 7, 7, 2, 16, 0, 5, 12, 3, 3])]
    df = spark.createDataFrame(rows, "doc_id bigint, ids array<bigint>")
    placed = W.pack_blocks(df, ["doc_id"], "ids", 16)
    assert {r["doc_id"] for r in placed.collect()} == {k for k, ids in rows if ids}
    blocks = W.assemble_blocks(df, placed, ["doc_id"], "ids").collect()
    assert all(0 < len(b["ids"]) <= 16 for b in blocks)
    assert sorted(x for b in blocks for x in b["ids"]) == sorted(x for _, ids in rows for x in ids)
    for row in placed.collect():
        block = next(b for b in blocks if (b["block_part"], b["block"]) == (row["block_part"], row["block"]))
        n = len(rows[row["doc_id"]][1])
        assert block["ids"][row["offset"] : row["offset"] + n] == [row["doc_id"]] * n


def test_packing_fills_blocks(spark):
    rows = [(i, [0] * n) for i, n in enumerate([8, 8, 4, 4, 4, 4] * 5)]
    df = spark.createDataFrame(rows, "doc_id bigint, ids array<bigint>")
    for parts in (1, 7):  # however the rows are spread
        placed = W.pack_blocks(df.repartition(parts), ["doc_id"], "ids", 16).collect()
        assert len({(r["block_part"], r["block"]) for r in placed}) == 10
        assert {(r["doc_id"], r["block"], r["offset"]) for r in placed} == {
            (r["doc_id"], r["block"], r["offset"]) for r in W.pack_blocks(df, ["doc_id"], "ids", 16).collect()
        }


def test_packing_by_parts(spark, monkeypatch):
    monkeypatch.setattr(W, "BUCKET_ROWS", 8)
    df = spark.createDataFrame([(i, [0] * (i % 9 + 1)) for i in range(40)], "doc_id bigint, ids array<bigint>")
    placed = W.pack_blocks(df, ["doc_id"], "ids", 16)
    assert placed.count() == 40 and placed.select("block_part").distinct().count() > 3
    assert all(len(b["ids"]) <= 16 for b in W.assemble_blocks(df, placed, ["doc_id"], "ids").collect())


@pytest.mark.parametrize("name", ["pad_batch", "attention_mask"])
def test_batches_encode_texts_once(spark, sf_dir, name):
    """Ranks, lengths and ids are read from what was encoded, not encoded again."""
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan and "documents.parquet" not in plan


def test_hybrid_ids_come_out_of_the_lookup(strings, vocabularies):
    """No second pass over tokens and ids for those that are unknown."""
    base, chem = vocabularies
    coded = H.hybrid_encode(strings(["C is zz [START_SMILES]CN[END_SMILES]"]), "s", base, chem, ["doc_id"])
    assert "zip_with" not in coded._jdf.queryExecution().optimizedPlan().toString()
    assert coded.first()["ids"] == [5, 4, 0, 7, 13, 9, 8]
