"""The rules as temporary SQL functions, for users who write queries as text.

Each function's body is the SQL text of the Column that the operators use, so that both give the
same plan: no Python where the Column has none.

    is_smiles(token, previous)      annotate(text)          smiles_segments(text) -> array
    tokens_<rule>(smiles) -> array  for every rule tokenizer
    segments(text) -> TABLE(seg, smiles)
    windows(ids, max_length, stride) -> TABLE(win, part)
"""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from molcorpus.functions.smiles import is_smiles
from molcorpus.functions.tokenizers import TOKENIZERS
from molcorpus.operators.annotate import annotated_text
from molcorpus.operators.extract import segments_of

LAMBDA = "lambdafunction("


def closing(text: str, at: int) -> tuple[int, list[int]]:
    """Of what begins after an opening bracket: where it closes, and the commas between."""
    depth, commas, quote = 0, [], ""
    while True:
        ch = text[at]
        if quote:
            if ch == "\\" and quote == "'":
                at += 1
            elif ch == quote:
                quote = ""
        elif ch in "'`":
            quote = ch
        elif ch in "([":
            depth += 1
        elif ch in ")]":
            if not depth:
                return at, commas
            depth -= 1
        elif ch == "," and not depth:
            commas.append(at)
        at += 1


def with_arrows(text: str) -> str:
    """Lambdas as they are written: variables, an arrow, the body."""
    at, quote = 0, ""
    while at < len(text):
        ch = text[at]
        if quote:
            if ch == "\\" and quote == "'":
                at += 1
            elif ch == quote:
                quote = ""
        elif ch in "'`":
            quote = ch
        elif text.startswith(LAMBDA, at):
            start = at + len(LAMBDA)
            end, commas = closing(text, start)
            parts = [text[a:b].strip() for a, b in zip([start, *(c + 1 for c in commas)], [*commas, end])]
            body, variables = parts[0], parts[1:]
            head = variables[0] if len(variables) == 1 else f"({', '.join(variables)})"
            text = f"{text[:at]}{head} -> {body}{text[end + 1:]}"
            at += len(f"{head} -> ") - 1
        at += 1
    return text


def to_sql(spark: SparkSession, column: Column) -> str:
    """A Column over named parameters as SQL text."""
    return with_arrows(spark._jsparkSession.expression(column._jc).sql())


def register(spark: SparkSession) -> list[str]:
    """Create all functions in this session and return their names."""
    scalar = {
        "is_smiles(token STRING, previous STRING)": ("BOOLEAN", is_smiles(F.col("token"), F.col("previous"))),
        "annotate(text STRING)": ("STRING", annotated_text(F.col("text"))),
        "smiles_segments(text STRING)": ("ARRAY<STRING>", segments_of(F.col("text"))),
    }
    for name, tokenizer in TOKENIZERS.items():
        scalar[f"tokens_{name}(smiles STRING)"] = ("ARRAY<STRING>", tokenizer(F.col("smiles")))
    for head, (kind, column) in scalar.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS {kind} RETURN {to_sql(spark, column)}")
    spark.sql(
        f"""CREATE OR REPLACE TEMPORARY FUNCTION segments(text STRING) RETURNS TABLE(seg INT, smiles STRING)
        RETURN SELECT seg, smiles FROM (SELECT posexplode({to_sql(spark, segments_of(F.col("text")))}) AS (seg, smiles))"""
    )
    spark.sql(
        """CREATE OR REPLACE TEMPORARY FUNCTION windows(ids ARRAY<BIGINT>, max_length INT, stride INT)
        RETURNS TABLE(win INT, part ARRAY<BIGINT>)
        RETURN SELECT win, part FROM (SELECT posexplode(transform(
          sequence(0, CASE WHEN size(ids) <= max_length THEN 0
            ELSE CAST(ceil((size(ids) - max_length) / (max_length - stride)) AS INT) * (max_length - stride) END, max_length - stride),
          i -> slice(ids, i + 1, max_length))) AS (win, part))"""
    )
    return [head.split("(")[0] for head in scalar] + ["segments", "windows"]
