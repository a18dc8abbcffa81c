"""Question-answer and chat data in the instruction format."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from molcorpus.functions.text import strip

# --- Fixed values: prompt texts, answer marks, chat template. -----------------

LETTERS = ["A", "B", "C", "D"]
MCQ_REQUEST = "Answer with the correct letter inside [ANSWER] tags."
MATH_REQUEST = "Answer with the numerical value wrapped in [ANSWER] tags."
ANSWER_PATTERN = r"The answer is:? ([^\n]*?)(?:\.|\n?\z)"
TURN_START, TURN_END = "<start_of_turn>", "<end_of_turn>\n"
ROLES = {"user": "user", "assistant": "model", "model": "model", "system": "user"}
BOS, EOS = "<bos>", "<eos>"
# ------------------------------------------------------------------------------

# Turns of one conversation put together per task before the whole of it is.
TURNS_PER_PART = 64


def messages(user: Column, assistant: Column) -> Column:
    def message(role: str, content: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    return F.array(message("user", user), message("assistant", assistant))


def mcq_chat(
    df: DataFrame, key: str, question: str, answer: str, distractors: list[str], seed: int = 42
) -> DataFrame:
    """Four-option questions as chats. Options are ordered by a seeded hash; the
    letter is that of the last option equal to the answer."""
    shuffled = F.array_sort(
        F.array(
            *[
                F.struct(
                    F.md5(F.concat_ws(":", F.lit(seed), F.col(key), F.lit(i))).alias("h"),
                    F.col(option).alias("text"),
                )
                for i, option in enumerate([answer, *distractors])
            ]
        )
    )
    letters = F.array(*[F.lit(x) for x in LETTERS])
    lines = F.transform("_options", lambda o, i: F.concat(F.get(letters, i), F.lit(". "), o["text"], F.lit("\n")))
    equal = F.transform("_options", lambda o, i: F.when(o["text"] == F.col(answer), F.get(letters, i)))
    user = F.concat(
        F.col(question), F.lit("\nOptions:\n"), F.array_join(lines, ""), F.lit("\n" + MCQ_REQUEST)
    )
    letter = F.coalesce(F.array_max(equal), F.lit(""))
    assistant = F.concat(F.lit("[ANSWER]"), letter, F.lit("[/ANSWER]"))
    return df.withColumn("_options", shuffled).select(key, messages(user, assistant).alias("messages"))


def math_chat(df: DataFrame, key: str, question: str, response: str) -> DataFrame:
    """Worked answers as chats, the final value marked. Rows that state no answer
    are left out."""
    text = F.col(response)
    value = F.col("_value")
    stated = F.concat(F.lit("The answer is: "), value)
    marked = F.concat(F.lit("The answer is: [ANSWER]"), value, F.lit("[/ANSWER]"))
    replaced = F.replace(text, stated, marked)
    appended = F.concat(text, F.lit("\n[ANSWER]"), value, F.lit("[/ANSWER]"))
    user = F.concat(F.col(question), F.lit("\n" + MATH_REQUEST))
    assistant = F.when(replaced.contains("[ANSWER]"), replaced).otherwise(appended)
    # An empty answer is an answer, so the match is tested apart from the capture.
    return (
        df.filter(text.rlike(ANSWER_PATTERN))
        .withColumn("_value", strip(F.regexp_extract(text, ANSWER_PATTERN, 1)))
        .select(key, messages(user, assistant).alias("messages"))
    )


def _turn(role: Column, content: Column) -> Column:
    name = F.lit(None).cast("string")
    for given, shown in ROLES.items():
        name = F.when(role == given, shown).otherwise(name)
    body = F.concat(F.lit(TURN_START), name, F.lit("\n"), strip(content), F.lit(TURN_END))
    return F.coalesce(body, F.lit(""))  # unknown roles are skipped


def _closed(body: Column, generation_prompt: bool) -> Column:
    end = f"{TURN_START}model\n" if generation_prompt else EOS
    return F.concat(F.lit(BOS), body, F.lit(end))


def render_messages(messages_col: Column, generation_prompt: bool = False) -> Column:
    """The chat template over an array of messages."""
    turns = F.transform(messages_col, lambda m: _turn(m["role"], m["content"]))
    return _closed(F.array_join(turns, ""), generation_prompt)


def render_chat(
    df: DataFrame, conv: str, turn: str, role: str, text: str, generation_prompt: bool = False
) -> DataFrame:
    """The chat template over one row per turn. Neighbouring turns are joined
    first, so a very long conversation is put together from parts."""
    part = F.floor(F.col(turn) / TURNS_PER_PART).alias("_part")
    joined = lambda order, body: F.array_join(
        F.array_sort(F.collect_list(F.struct(F.col(order), body.alias("body"))))["body"], ""
    )
    parts = df.groupBy(conv, part).agg(joined(turn, _turn(F.col(role), F.col(text))).alias("_body"))
    whole = parts.groupBy(conv).agg(joined("_part", F.col("_body")).alias("_body"))
    return whole.select(conv, _closed(F.col("_body"), generation_prompt).alias("prompt"))
