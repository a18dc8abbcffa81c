"""Queries on instruction data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from molcorpus.functions import patterns as P
from molcorpus.operators import instruct as I
from molcorpus.operators import mix as M
from molcorpus.operators import ranking as R
from molcorpus.plans.mixing import interleave_sql
from molcorpus.plans.registry import literal, query
from molcorpus.session import materialize
from molcorpus.sources.samples import table

SEED = 42
CAP = 15_000
MIXTURE = {"chat": 0.4, "science": 0.3, "math": 0.3}
RATIO = 0.05

# --- SQL side ------------------------------------------------------------------

SCIENCE_CTE = f"""questions AS (SELECT p_partkey AS key, p_name AS question, p_brand AS answer,
    'Brand#1' AS d1, 'Brand#2' AS d2, 'Brand#3' AS d3 FROM part),
options AS (
  SELECT key, unnest([0, 1, 2, 3]) AS i, unnest([answer, d1, d2, d3]) AS opt, question, answer
  FROM questions),
placed AS (SELECT *, row_number() OVER (PARTITION BY key
    ORDER BY md5(concat('{SEED}:', key, ':', i))) AS r FROM options),
science AS (
  SELECT key, concat(any_value(question), chr(10), 'Options:', chr(10),
      string_agg(concat(substr('ABCD', r, 1), '. ', opt, chr(10)), '' ORDER BY r),
      chr(10), {literal(I.MCQ_REQUEST)}) AS user_text,
    concat('[ANSWER]', max(CASE WHEN opt = answer THEN substr('ABCD', r, 1) END), '[/ANSWER]')
      AS assistant_text
  FROM placed GROUP BY key)"""



def _strip(sql: str) -> str:
    return f"regexp_replace({sql}, {literal(P.STRIP)}, '', 'g')"


MATH_CTE = f"""responses AS (SELECT doc_id AS key, text AS question,
    CASE doc_id % 3 WHEN 0 THEN concat(text, ' The answer is: ', n_chars, '.')
      WHEN 1 THEN concat(text, ' The answer is 3.5') ELSE text END AS response FROM documents),
stated AS (SELECT *, {_strip(f"regexp_extract(response, {literal(I.ANSWER_PATTERN)}, 1)")} AS v
  FROM responses WHERE regexp_matches(response, {literal(I.ANSWER_PATTERN)})),
math AS (
  SELECT key, concat(question, chr(10), {literal(I.MATH_REQUEST)}) AS user_text,
    CASE WHEN contains(replaced, '[ANSWER]') THEN replaced
      ELSE concat(response, chr(10), '[ANSWER]', v, '[/ANSWER]') END AS assistant_text
  FROM (SELECT *, replace(response, concat('The answer is: ', v),
      concat('The answer is: [ANSWER]', v, '[/ANSWER]')) AS replaced FROM stated))"""

_ROLE_CASE = "CASE role " + " ".join(f"WHEN '{g}' THEN '{s}'" for g, s in I.ROLES.items()) + " END"
CHAT_CTE = f"""turns AS (SELECT conv_id, turn, {_ROLE_CASE} AS name, {_strip('text')} AS body
  FROM conversations),
chats AS (SELECT conv_id AS key, coalesce(string_agg(concat('<start_of_turn>', name, chr(10), body,
    '<end_of_turn>', chr(10)), '' ORDER BY turn) FILTER (WHERE name IS NOT NULL), '') AS body
  FROM turns GROUP BY conv_id)"""

# --- Spark side ------------------------------------------------------------------


def _pair(df: DataFrame) -> DataFrame:
    content = lambda i: F.col("messages")[i]["content"]
    return df.select("key", content(0).alias("user_text"), content(1).alias("assistant_text"))


def science(spark: SparkSession, sf_dir: str) -> DataFrame:
    questions = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("key"),
        F.col("p_name").alias("question"),
        F.col("p_brand").alias("answer"),
        *[F.lit(f"Brand#{i}").alias(f"d{i}") for i in (1, 2, 3)],
    )
    return I.mcq_chat(questions, "key", "question", "answer", ["d1", "d2", "d3"], SEED)


def math(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind: Column = F.col("doc_id") % 3
    response = (
        F.when(kind == 0, F.concat("text", F.lit(" The answer is: "), "n_chars", F.lit(".")))
        .when(kind == 1, F.concat("text", F.lit(" The answer is 3.5")))
        .otherwise(F.col("text"))
    )
    rows = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("key"), F.col("text").alias("question"), response.alias("response")
    )
    return I.math_chat(rows, "key", "question", "response")


@query(f"WITH {SCIENCE_CTE} SELECT key, user_text, assistant_text FROM science")
def mcq_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pair(science(spark, sf_dir))


@query(f"WITH {MATH_CTE} SELECT key, user_text, assistant_text FROM math")
def math_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pair(math(spark, sf_dir))


@query(f"WITH {MATH_CTE} SELECT key, user_text, assistant_text FROM math ORDER BY key LIMIT {CAP}")
def capped_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pair(R.cap(math(spark, sf_dir), ["key"], CAP))


@query(
    f"""WITH {CHAT_CTE} SELECT key AS conv_id, concat('<bos>', body, '<eos>') AS prompt,
      concat('<bos>', body, '<start_of_turn>model', chr(10)) AS generation_prompt FROM chats"""
)
def chat_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Template over the turns of each conversation, closed and open."""
    turns = table(spark, sf_dir, "conversations")
    closed = I.render_chat(turns, "conv_id", "turn", "role", "text")
    opened = F.concat(
        F.substr("prompt", F.lit(1), F.length("prompt") - len(I.EOS)), F.lit(f"{I.TURN_START}model\n")
    )
    return closed.withColumn("generation_prompt", opened)


@query(
    f"""WITH {SCIENCE_CTE}, {MATH_CTE}, {CHAT_CTE},
    examples AS (SELECT 'chat' AS source, key, concat('<bos>', body, '<eos>') AS prompt FROM chats
      UNION ALL SELECT 'science', key, concat('<bos><start_of_turn>user', chr(10),
        {_strip('user_text')}, '<end_of_turn>', chr(10), '<start_of_turn>model', chr(10),
        {_strip('assistant_text')}, '<end_of_turn>', chr(10), '<eos>') FROM science
      UNION ALL SELECT 'math', key, concat('<bos><start_of_turn>user', chr(10),
        {_strip('user_text')}, '<end_of_turn>', chr(10), '<start_of_turn>model', chr(10),
        {_strip('assistant_text')}, '<end_of_turn>', chr(10), '<eos>') FROM math),
    {interleave_sql(MIXTURE, 'examples')},
    numbered AS (SELECT *, row_number() OVER (ORDER BY md5(concat('{SEED}:', idx))) AS r,
      count(*) OVER () AS n FROM mixed)
    SELECT idx, source, key, e.prompt, CASE WHEN r <= ceil(n * {RATIO}::DOUBLE) THEN 'test' ELSE 'train' END AS part
    FROM numbered JOIN examples e USING (source, key)"""
)
def instruction_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chats, science and math questions mixed 0.4 / 0.3 / 0.3 and split."""
    chats = I.render_chat(
        table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text"
    ).select(F.lit("chat").alias("source"), F.col("conv_id").alias("key"), "prompt")
    rendered = [
        df.select(F.lit(name).alias("source"), "key", I.render_messages(F.col("messages")).alias("prompt"))
        for name, df in (("science", science(spark, sf_dir)), ("math", math(spark, sf_dir)))
    ]
    # Prepared once, as files, then counted, ranked and joined.
    examples = materialize(chats.unionByName(rendered[0]).unionByName(rendered[1]))
    mixed = materialize(M.interleave(examples, "source", ["key"], MIXTURE, SEED))
    return R.split(mixed, ["idx"], RATIO, SEED)
