"""Instruction data, evaluation and embeddings on small tables."""

import math

import pytest
from pyspark.sql import functions as F

from molcorpus.functions import patterns as P
from molcorpus.functions.tokenizers import tok_character
from molcorpus.operators import embed as B
from molcorpus.operators import evaluate as E
from molcorpus.operators import instruct as I
from molcorpus.operators import mix as M


def test_mcq_letter_is_of_the_last_equal_option(spark):
    rows = [(i, "Q", "x", "x", "y", "z") for i in range(20)]
    df = spark.createDataFrame(rows, "k bigint, q string, a string, d1 string, d2 string, d3 string")
    for row in I.mcq_chat(df, "k", "q", "a", ["d1", "d2", "d3"]).collect():
        user, assistant = row["messages"]
        options = user["content"].split("\n")[2:6]
        letters = [o[0] for o in options if o.endswith(" x")]
        assert [o[:3] for o in options] == ["A. ", "B. ", "C. ", "D. "] and len(letters) == 2
        assert assistant["content"] == f"[ANSWER]{letters[-1]}[/ANSWER]"
        assert user["content"].startswith("Q\nOptions:\nA. ")
        assert user["content"].endswith("\n\nAnswer with the correct letter inside [ANSWER] tags.")


def test_math_chat(spark):
    responses = [
        "So. The answer is: 7.",
        "The answer is: 3.5",
        "The answer is 12",
        "no value",
        "The answer is: .",
        "The answer is: 4\n",
        "The answer is: two\nlines. The answer is: 9",
    ]
    df = spark.createDataFrame(list(enumerate(["q"] * 7)), "k bigint, q string").join(
        spark.createDataFrame(list(enumerate(responses)), "k bigint, r string"), "k"
    )
    got = {r["k"]: r["messages"][1]["content"] for r in I.math_chat(df, "k", "q", "r").collect()}
    assert got == {
        0: "So. The answer is: [ANSWER]7[/ANSWER].",
        1: "The answer is: [ANSWER]3[/ANSWER].5",
        2: "The answer is 12\n[ANSWER]12[/ANSWER]",
        4: "The answer is: [ANSWER][/ANSWER].",
        5: "The answer is: [ANSWER]4[/ANSWER]\n",
        6: "The answer is: two\nlines. The answer is: [ANSWER]9[/ANSWER]",
    }


def test_chat(spark, monkeypatch):
    turns = [("system", " be kind "), ("user", "hi\n"), ("tool", "?"), ("assistant", "yo"), ("model", "ok")]
    body = (
        "<bos><start_of_turn>user\nbe kind<end_of_turn>\n<start_of_turn>user\nhi<end_of_turn>\n"
        "<start_of_turn>model\nyo<end_of_turn>\n<start_of_turn>model\nok<end_of_turn>\n"
    )
    df = spark.createDataFrame(
        [(1, i, r, t) for i, (r, t) in enumerate(turns)], "c bigint, n bigint, role string, text string"
    )
    monkeypatch.setattr(I, "TURNS_PER_PART", 2)
    assert I.render_chat(df, "c", "n", "role", "text").first()["prompt"] == body + "<eos>"
    opened = I.render_chat(df, "c", "n", "role", "text", generation_prompt=True).first()
    assert opened["prompt"] == body + "<start_of_turn>model\n"
    nested = spark.createDataFrame([([{"role": r, "content": t} for r, t in turns],)],
                                   "messages array<struct<role: string, content: string>>")
    assert nested.select(I.render_messages(F.col("messages"))).first()[0] == body + "<eos>"


def test_fertility_quantiles(spark):
    sizes = [2, 3, 5, 5, 7, 8, 9, 1]
    df = spark.createDataFrame([(n,) for n in sizes], "n int")
    row = E.fertility(df, {"t": F.col("n")}).first()
    ordered = sorted(sizes)
    assert (row["percentile_25"], row["median_tokens"], row["percentile_75"]) == (
        ordered[2], ordered[4], ordered[6],
    )
    mean = sum(sizes) / 8
    assert row["average_tokens"] == mean and row["total_tokens"] == 40
    assert row["std_tokens"] == round(math.sqrt(sum((n - mean) ** 2 for n in sizes) / 8), 6)


def test_fertility_strict(spark):
    df = spark.createDataFrame([(0,), (2,)], "n int")
    assert E.fertility(df, {"t": F.col("n")}).first()["n_empty"] == 1
    with pytest.raises(Exception, match="finds no token"):
        E.fertility(df, {"t": F.col("n")}, strict=True).collect()


def test_candidates_skip_what_cannot_be_used(spark):
    examples = [
        ("q1", '{"b": 1, "a": 0}'), ("", '{"a": 1}'), (None, '{"a": 1}'), ("q2", None),
        ("q3", '{"a": '), ("q4", "{}"),
    ]
    df = spark.createDataFrame(
        [(1, [{"input": i, "target_scores": s} for i, s in examples]), (2, None), (3, [])],
        "k int, examples array<struct<input: string, target_scores: string>>",
    )
    rows = E.mcq_candidates(df, ["k"]).collect()
    assert [(r["question"], r["cand_pos"], r["candidate"], r["target"]) for r in rows] == [
        ("q1", 0, "b", 1.0), ("q1", 1, "a", 0.0),
    ]
    as_map = spark.createDataFrame(
        [(1, [{"input": "q", "target_scores": {"x": 1.0}}])],
        "k int, examples array<struct<input: string, target_scores: map<string, double>>>",
    )
    assert E.mcq_candidates(as_map, ["k"]).first()["candidate"] == "x"


def test_scores_and_pick(spark):
    tokens = [
        ("m", "t", 0, "a", 1.0, 0, 3, -9.0), ("m", "t", 0, "a", 1.0, 2, 3, -1.0),
        ("m", "t", 1, "b", 0.0, 2, 3, -1.0), ("m", "t", 2, "c", 0.0, 1, 3, -0.1),
    ]
    df = spark.createDataFrame(
        tokens, "model string, topic string, cand_pos int, candidate string, target double, "
        "tok_pos int, prompt_len int, logprob double",
    )
    scored = E.candidate_score(df, ["model", "topic", "cand_pos", "candidate", "target"])
    scores = {r["candidate"]: r["score"] for r in scored.collect()}
    assert scores == {"a": -1.0, "b": -1.0, "c": float("-inf")}
    picked = E.mcq_pick(scored, ["model", "topic"])
    row = picked.first()
    assert (row["predicted"], row["cand_pos"], row["correct"]) == ("a", 0, 1)


def test_accuracy_tables(spark):
    topic = P.TOPICS[2]
    picked = spark.createDataFrame(
        [("m1", topic, 1), ("m1", topic, 0), ("m2", topic, 1)], "model string, topic string, correct bigint"
    )
    models = spark.createDataFrame([("m0",), ("m1",), ("m2",)], "model string")
    topics = E.topic_accuracy(picked, models)
    assert topics.count() == 27
    board = {r["model"]: r for r in E.leaderboard(topics).collect()}
    assert board["m1"][topic] == 0.5 and board["m1"][P.TOPICS[0]] == 0.0
    assert board["m0"]["overall_accuracy"] == 0.0
    assert E.best_model(E.overall_accuracy(topics)).first()["model"] == "m2"


def test_perplexity_overflows_to_infinity(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 1000.0)], "k string, loss double")
    got = {r["k"]: r["perplexity"] for r in E.perplexity(df, "loss", ["k"]).collect()}
    assert got["b"] == float("inf") and got["a"] == pytest.approx(math.exp(2))


def test_mix_report(spark):
    df = spark.createDataFrame([("a", 3), ("a", 1), ("b", 4)], "s string, n int")
    rows = {r["s"]: r for r in M.mix_report(df, "s", "n").collect()}
    assert (rows["a"]["n_rows"], rows["a"]["token_share"]) == (2, 0.5)


@pytest.fixture(scope="module")
def matrix(spark):
    rows = [(i, [float(i), float(i * i)]) for i in range(12)]
    return spark.createDataFrame(rows, "token_id bigint, embedding array<float>")


def test_strategies(spark, matrix):
    letters = ["[UNK]", *"Carbonyx1"]  # ids 0-9
    base_vocab = spark.createDataFrame([(t, i) for i, t in enumerate(letters)], "token string, id bigint")
    tokens = spark.createDataFrame([("CC", 20), ("x1", 21), ("", 22)], "token string, token_id bigint")
    average = B.init_embeddings(matrix, tokens, "average").collect()
    assert {tuple(r["embedding"]) for r in average} == {(5.5, sum(i * i for i in range(12)) / 12)}

    got = {r["token_id"]: r["embedding"] for r in B.init_embeddings(
        matrix, tokens, "elementwise", base_vocab=base_vocab, base_tokenizer=tok_character).collect()}
    carbon = [letters.index(c) for c in "Carbon"]
    assert got[20] == pytest.approx([sum(carbon) / 6, sum(i * i for i in carbon) / 6])
    assert got[21] == pytest.approx([8.5, (64 + 81) / 2])
    default = {r["token_id"]: r["embedding"] for r in B.init_embeddings(matrix, tokens).collect()}
    assert got[22] == default[22] and len(default[22]) == 2


def test_mean_pool(spark, matrix):
    df = spark.createDataFrame(
        [(1, [2, 4, 1], [1, 1, 0]), (2, [1], [0]), (3, [], [])], "k int, ids array<bigint>, m array<int>"
    )
    got = {r["k"]: r["embedding"] for r in B.mean_pool(df, ["k"], "ids", "m", matrix, 2).collect()}
    assert got == {1: [3.0, 10.0], 2: [0.0, 0.0], 3: [0.0, 0.0]}


def test_projection_is_the_widest_plane(spark):
    rows = [(i, [float(i), float(2 * i), 0.1 * (-1) ** i]) for i in range(20)]
    df = spark.createDataFrame(rows, "k int, embedding array<float>")
    points = {r["k"]: r["x"] for r in B.project_2d(df, "k").collect()}
    steps = [points[i + 1] - points[i] for i in range(19)]
    assert all(s == pytest.approx(math.sqrt(5), rel=1e-2) for s in steps)
