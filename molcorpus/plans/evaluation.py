"""Queries on multiple-choice evaluation and perplexity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from molcorpus.functions import patterns as P
from molcorpus.functions.text import draw
from molcorpus.operators import evaluate as E
from molcorpus.operators import extract as X
from molcorpus.operators.annotate import annotate
from molcorpus.plans.detection import TAGGED_WORDS_CTE, words_cte
from molcorpus.plans.mixing import draw_sql
from molcorpus.plans.registry import query
from molcorpus.session import small_table
from molcorpus.sources.samples import ANNOTATED_SQL, annotated, table

MODELS = ["run/checkpoint-100", "run/checkpoint-200", "run/checkpoint-300"]
PROMPT_LENGTH = 4
QUESTION = ["topic", "question_id", "example_pos"]

# --- Questions derived from the benchmark table; eight of nine topics are used,
# --- some rows have another metric, no examples, or broken scores.


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("item_id")
    topics = F.array(*[F.lit(t) for t in P.TOPICS])

    def scores(correct) -> F.Column:
        parts = [
            F.concat(F.lit(f'"opt {c} '), F.substring("text", 1, 1), F.lit('": '),
                     F.when(correct == c, "1").otherwise("0"))
            for c in (2, 0, 3, 1)
        ]
        return F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))

    def example(text, correct):
        return F.struct(text.alias("input"), correct.alias("target_scores"))

    good = scores(i % 4)
    first = F.when(i % 11 == 3, F.lit('{"broken": ')).when(i % 17 == 4, F.lit("{}")).otherwise(good)
    second = F.when(i % 5 == 2, F.lit(None).cast("string")).otherwise(scores((i + 1) % 4))
    examples = F.array(
        example(F.col("text"), first), example(F.when(i % 7 == 6, F.lit("")).otherwise(F.col("text")), second)
    )
    return table(spark, sf_dir, "benchmark").select(
        i.alias("question_id"),
        F.element_at(topics, (i % 8 + 1).cast("int")).alias("topic"),
        F.when(i % 6 == 5, F.array(F.lit("exact_match")))
        .when(i % 9 == 8, F.array(F.lit("multiple_choice_grade"), F.lit("exact_match")))
        .otherwise(F.array(F.lit("multiple_choice_grade"))).alias("metrics"),
        F.when(i % 13 != 5, examples).alias("examples"),
    )


_TOPIC_LIST = "[" + ", ".join(f"'{t}'" for t in P.TOPICS) + "]"


def _scores_sql(correct: str) -> str:
    parts = ", ', ', ".join(
        f"""'"opt {c} ', text[1], '": ', CASE WHEN {correct} = {c} THEN '1' ELSE '0' END"""
        for c in (2, 0, 3, 1)
    )
    return f"concat('{{', {parts}, '}}')"


QUESTIONS_CTE = f"""questions AS (SELECT item_id AS question_id, {_TOPIC_LIST}[item_id % 8 + 1] AS topic,
    CASE WHEN item_id % 6 = 5 THEN ['exact_match']
      WHEN item_id % 9 = 8 THEN ['multiple_choice_grade', 'exact_match']
      ELSE ['multiple_choice_grade'] END AS metrics, item_id, text,
    item_id % 13 <> 5 AS has_examples FROM benchmark),
examples AS (
  SELECT question_id, topic, metrics, 0::BIGINT AS example_pos, text AS input,
    CASE WHEN item_id % 11 = 3 THEN '{{"broken": ' WHEN item_id % 17 = 4 THEN '{{}}'
      ELSE {_scores_sql('item_id % 4')} END AS scores FROM questions WHERE has_examples
  UNION ALL
  SELECT question_id, topic, metrics, 1, CASE WHEN item_id % 7 = 6 THEN '' ELSE text END,
    CASE WHEN item_id % 5 = 2 THEN NULL ELSE {_scores_sql('(item_id + 1) % 4')} END
  FROM questions WHERE has_examples),
usable AS (SELECT *, json_keys(scores::JSON) AS names FROM examples
  WHERE metrics = ['multiple_choice_grade'] AND input <> '' AND scores IS NOT NULL AND json_valid(scores)),
candidates AS (
  SELECT topic, question_id, example_pos, question, cand_pos, candidate,
    json_extract_string(scores, '$."' || candidate || '"')::DOUBLE AS target
  FROM (SELECT topic, question_id, example_pos, input AS question, scores,
          unnest(range(len(names))) AS cand_pos, unnest(names) AS candidate FROM usable))"""


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = X.mcq_only(questions(spark, sf_dir))
    return E.mcq_candidates(kept, ["topic", "question_id"])


# --- Token scores, which stand in for a model's output: by hash, with candidates
# --- that tie and candidates without answer tokens.


def token_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    n_tokens = F.when(
        (F.col("question_id") + F.col("cand_pos")) % 19 == 7, PROMPT_LENGTH - 1
    ).otherwise(PROMPT_LENGTH + 1 + F.col("cand_pos"))
    # On every third question the first two candidates have the same scores.
    seen = F.when((F.col("question_id") % 3 == 0) & (F.col("cand_pos") < 2), 0).otherwise(F.col("cand_pos") + 1)
    exploded = (
        candidates(spark, sf_dir)
        .withColumn("model", F.explode(F.array(*[F.lit(m) for m in MODELS])))
        .withColumn("tok_pos", F.explode(F.sequence(F.lit(0), n_tokens - 1)))
        .withColumn("prompt_len", F.lit(PROMPT_LENGTH))
    )
    same_tail = F.when(seen == 0, F.lit(0)).otherwise(F.col("tok_pos"))
    key = F.concat_ws(":", "model", "question_id", "example_pos", seen, same_tail)
    return exploded.withColumn("logprob", -draw(key, 7))


_CANDIDATE = ["model", *QUESTION, "cand_pos", "candidate", "target"]
SCORED_CTE = f"""{QUESTIONS_CTE},
models AS (SELECT unnest({MODELS}) AS model),
tokens AS (
  SELECT model, topic, question_id, example_pos, cand_pos, candidate, target, unnest(range(
      CASE WHEN (question_id + cand_pos) % 19 = 7 THEN {PROMPT_LENGTH - 1}
      ELSE {PROMPT_LENGTH + 1} + cand_pos END)) AS tok_pos,
    CASE WHEN question_id % 3 = 0 AND cand_pos < 2 THEN 0 ELSE cand_pos + 1 END AS seen
  FROM candidates, models),
scored_tokens AS (SELECT *, -{draw_sql("concat_ws(':', model, question_id, example_pos, seen, CASE WHEN seen = 0 THEN 0 ELSE tok_pos END)", 7)} AS logprob FROM tokens),
scored AS (SELECT {', '.join(_CANDIDATE)},
    coalesce(avg(logprob) FILTER (WHERE tok_pos >= {PROMPT_LENGTH - 1}), '-inf'::DOUBLE) AS score
  FROM scored_tokens GROUP BY ALL),
ordered AS (SELECT *, row_number() OVER (PARTITION BY model, topic, question_id, example_pos
    ORDER BY score DESC, cand_pos) AS r FROM scored),
picked AS (SELECT model, topic, question_id, example_pos, candidate AS predicted, cand_pos,
    score, (target = 1)::BIGINT AS correct FROM ordered WHERE r = 1),
topics AS (SELECT unnest({_TOPIC_LIST}) AS topic),
by_topic AS (SELECT m.model, t.topic, coalesce(sum(correct), 0)::BIGINT AS correct,
    count(correct) AS total FROM models m, topics t
  LEFT JOIN picked p ON p.model = m.model AND p.topic = t.topic GROUP BY m.model, t.topic),
accuracies AS (SELECT *, CASE WHEN total > 0 THEN correct / total ELSE 0 END AS accuracy FROM by_topic),
overall AS (SELECT model, sum(correct)::BIGINT AS correct, sum(total)::BIGINT AS total,
    CASE WHEN sum(total) > 0 THEN sum(correct) / sum(total) ELSE 0 END AS overall_accuracy
  FROM by_topic GROUP BY model)"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.candidate_score(token_scores(spark, sf_dir), _CANDIDATE)


def picked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.mcq_pick(scored(spark, sf_dir), ["model", *QUESTION])


def accuracies(spark: SparkSession, sf_dir: str) -> DataFrame:
    models = small_table(spark, "model string", [(m,) for m in MODELS])
    return E.topic_accuracy(picked(spark, sf_dir), models)


def _bigint(*names: str) -> list:
    return [F.col(n).cast("bigint").alias(n) for n in names]


@query(
    f"""WITH {QUESTIONS_CTE} SELECT question_id, topic, has_examples FROM questions
    WHERE metrics = ['multiple_choice_grade']"""
)
def mcq_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.mcq_only(questions(spark, sf_dir)).select(
        "question_id", "topic", F.col("examples").isNotNull().alias("has_examples")
    )


@query(
    f"""WITH {ANNOTATED_SQL}, {words_cte('annotated', 'text_raw')}, {TAGGED_WORDS_CTE}
    SELECT doc_id, concat('Question: ', text_raw, chr(10), 'Answer:') AS prompt,
      concat('Question: ', text_reannotated, chr(10), 'Answer:') AS annotated_prompt
    FROM annotated JOIN reannotated USING (doc_id)"""
)
def mcq_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Question prompts plain and with their SMILES tagged."""
    return annotate(annotated(spark, sf_dir), "text_raw").select(
        "doc_id",
        E.mcq_prompt(F.col("text_raw")).alias("prompt"),
        E.mcq_prompt(F.col("text_reannotated")).alias("annotated_prompt"),
    )


@query(f"WITH {QUESTIONS_CTE} SELECT * FROM candidates")
def mcq_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates(spark, sf_dir).select(
        "topic", "question_id", "question", "candidate", "target", *_bigint("example_pos", "cand_pos")
    )


@query(
    f"""WITH {QUESTIONS_CTE} SELECT topic, question_id, example_pos, cand_pos,
      concat('Question: ', question, chr(10), 'Answer: ', candidate) AS full_text FROM candidates"""
)
def mcq_full_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates(spark, sf_dir).select(
        "topic", "question_id", *_bigint("example_pos", "cand_pos"),
        E.mcq_full_text(F.col("question"), F.col("candidate")).alias("full_text"),
    )


@query(
    f"""WITH {ANNOTATED_SQL}, {words_cte('annotated', 'text_raw')}, {TAGGED_WORDS_CTE}
    SELECT doc_id, concat('Question: ', text_reannotated, chr(10), 'Answer: ', text_reannotated) AS full_text
    FROM annotated JOIN reannotated USING (doc_id)"""
)
def mcq_full_text_annotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The full text with the SMILES of question and answer tagged; each text asks for itself."""
    rows = annotated(spark, sf_dir).withColumn("answer", F.col("text_raw"))
    return E.annotated_full_text(rows, "text_raw", "answer").select("doc_id", "full_text")


_KEYS = "model, topic, question_id, example_pos, cand_pos"


@query(f"WITH {SCORED_CTE} SELECT {_KEYS}, round(score, 9) AS score FROM scored")
def candidate_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).select(
        "model", "topic", "question_id", *_bigint("example_pos", "cand_pos"),
        F.when(F.col("score") > float("-inf"), F.round("score", 9)).otherwise(F.col("score")).alias("score"),
    )


@query(f"WITH {SCORED_CTE} SELECT {_KEYS}, predicted, correct FROM picked")
def mcq_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    return picked(spark, sf_dir).select(
        "model", "topic", "question_id", "predicted", "correct", *_bigint("example_pos", "cand_pos")
    )


@query(f"WITH {SCORED_CTE} SELECT model, topic, correct, total, round(accuracy, 9) AS accuracy FROM accuracies")
def topic_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return accuracies(spark, sf_dir).withColumn("accuracy", F.round("accuracy", 9))


@query(
    f"WITH {SCORED_CTE} SELECT model, correct, total, round(overall_accuracy, 9) AS overall_accuracy FROM overall"
)
def overall_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.overall_accuracy(accuracies(spark, sf_dir)).withColumn(
        "overall_accuracy", F.round("overall_accuracy", 9)
    )


_WIDE = ", ".join(f"round(max(accuracy) FILTER (WHERE topic = '{t}'), 9) AS {t}" for t in P.TOPICS)


@query(
    f"""WITH {SCORED_CTE} SELECT model, string_split(model, '/')[-1] AS name, {_WIDE}, round(any_value(overall_accuracy), 9) AS overall_accuracy
    FROM accuracies JOIN overall USING (model) GROUP BY model"""
)
def leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    board = E.leaderboard(accuracies(spark, sf_dir))
    numbers = [c for c in board.columns if c not in ("model", "name")]
    return board.select("model", "name", *[F.round(c, 9).alias(c) for c in numbers])


@query(
    f"""WITH {SCORED_CTE} SELECT model, correct, total, round(overall_accuracy, 9) AS overall_accuracy
    FROM overall ORDER BY overall.overall_accuracy DESC, model LIMIT 1"""
)
def best_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    overall = E.overall_accuracy(accuracies(spark, sf_dir))
    return E.best_model(overall).withColumn("overall_accuracy", F.round("overall_accuracy", 9))


@query(
    f"""SELECT source, round(exp(avg(loss)), 6) AS perplexity FROM (
      SELECT source, n_chars / 1000.0 + {draw_sql('doc_id', 3)} AS loss FROM documents) GROUP BY source"""
)
def perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    losses = table(spark, sf_dir, "documents").select(
        "source", (F.col("n_chars") / 1000.0 + draw(F.col("doc_id"), 3)).alias("loss")
    )
    return E.perplexity(losses, "loss", ["source"]).withColumn("perplexity", F.round("perplexity", 6))
