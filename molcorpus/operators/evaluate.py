"""Fertility, multiple-choice accuracy and perplexity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from molcorpus.functions import patterns as P
from molcorpus.operators.annotate import annotate


def fertility(df: DataFrame, sizes: dict[str, Column], strict: bool = False) -> DataFrame:
    """Tokens per SMILES for each named size Column, one result row each.

    All tokenizers share one scan. Rows are first counted per (tokenizer, size);
    everything after that works on this small histogram. In strict mode a SMILES
    without tokens is an error.
    """
    named = F.array(*[F.struct(F.lit(n).alias("tokenizer"), s.alias("n")) for n, s in sizes.items()])
    histogram = (
        df.select(F.explode(named).alias("e")).select("e.tokenizer", F.col("e.n").cast("bigint").alias("n"))
        .groupBy("tokenizer", "n")
        .agg(F.count(F.lit(1)).alias("c"))
    )
    by_size = Window.partitionBy("tokenizer").orderBy("n")
    placed = histogram.withColumns(
        {
            "upto": F.sum("c").over(by_size),
            "total": F.sum("c").over(Window.partitionBy("tokenizer")),
            "mean": F.sum(F.col("c") * F.col("n")).over(Window.partitionBy("tokenizer"))
            / F.sum("c").over(Window.partitionBy("tokenizer")),
        }
    )

    def quantile(q: float) -> Column:
        reached = F.col("upto") > F.floor(F.lit(q) * F.col("total"))
        return F.min(F.when(reached, F.col("n")))

    total, tokens = F.sum("c"), F.sum(F.col("c") * F.col("n"))
    mean = tokens / total
    variance = F.sum(F.col("c") * F.pow(F.col("n") - F.col("mean"), 2)) / total
    empty = F.coalesce(F.sum(F.when(F.col("n") == 0, F.col("c"))), F.lit(0))
    if strict:
        message = F.concat(F.first("tokenizer"), F.lit(" finds no token in some SMILES"))
        empty = F.when(empty > 0, F.raise_error(message)).otherwise(empty)
    return placed.groupBy("tokenizer").agg(
        total.alias("total_smiles"),
        tokens.alias("total_tokens"),
        F.round(mean, 9).alias("average_tokens"),
        F.round(F.sqrt(variance), 6).alias("std_tokens"),
        quantile(0.5).alias("median_tokens"),
        quantile(0.25).alias("percentile_25"),
        quantile(0.75).alias("percentile_75"),
        F.max("n").alias("max_tokens"),
        F.min("n").alias("min_tokens"),
        empty.alias("n_empty"),
    )


def mcq_prompt(question: Column) -> Column:
    return F.concat(F.lit("Question: "), question, F.lit("\nAnswer:"))


def mcq_full_text(question: Column, candidate: Column) -> Column:
    return F.concat(mcq_prompt(question), F.lit(" "), candidate)


def annotated_full_text(df: DataFrame, question: str, candidate: str, out: str = "full_text") -> DataFrame:
    """Add the full text of question and answer, both with their SMILES tagged."""
    tagged = annotate(annotate(df, question, "_question", "_n_question"), candidate, "_candidate", "_n_candidate")
    text = mcq_full_text(F.col("_question"), F.col("_candidate"))
    return tagged.withColumn(out, text).drop("_question", "_n_question", "_candidate", "_n_candidate")


def mcq_candidates(df: DataFrame, keys: list[str], col: str = "examples") -> DataFrame:
    """One row per candidate answer, in key order of the scores object. Examples
    without input, with missing or broken scores or no candidate are left out.

    ``target_scores`` is a JSON string or already a map.
    """
    scores = F.col("example.target_scores")
    element = dict(df.dtypes)[col]
    if "target_scores:map" not in element:
        scores = F.from_json(scores, "map<string,double>")
    entries = F.map_entries(scores)
    return (
        df.select(*keys, F.posexplode(col).alias("example_pos", "example"))
        .filter(F.coalesce(F.col("example.input"), F.lit("")) != "")
        .select(
            *keys,
            "example_pos",
            F.col("example.input").alias("question"),
            F.posexplode(entries).alias("cand_pos", "entry"),
        )
        .select(
            *keys,
            "example_pos",
            "question",
            "cand_pos",
            F.col("entry.key").alias("candidate"),
            F.col("entry.value").alias("target"),
        )
    )


def candidate_score(scores: DataFrame, keys: list[str]) -> DataFrame:
    """Mean log-probability of the answer tokens, those from ``prompt_len - 1``
    on; minus infinity where there are none."""
    answer = F.when(F.col("tok_pos") >= F.col("prompt_len") - 1, F.col("logprob"))
    return scores.groupBy(*keys).agg(
        F.coalesce(F.avg(answer), F.lit(float("-inf"))).alias("score")
    )


def mcq_pick(scored: DataFrame, keys: list[str]) -> DataFrame:
    """Best candidate per question, the first one on ties, and its correctness.
    The maximum is taken before the shuffle."""
    best = F.max(
        F.struct("score", (-F.col("cand_pos")).alias("rank"), "candidate", "target")
    )
    return scored.groupBy(*keys).agg(best.alias("best")).select(
        *keys,
        F.col("best.candidate").alias("predicted"),
        (-F.col("best.rank")).cast("bigint").alias("cand_pos"),
        F.col("best.score").alias("score"),
        F.coalesce(F.col("best.target") == 1, F.lit(False)).cast("bigint").alias("correct"),
    )


def _ratio(correct: Column, total: Column) -> Column:
    return F.when(total > 0, correct / total).otherwise(F.lit(0.0))


def topic_accuracy(picked: DataFrame, models: DataFrame) -> DataFrame:
    """Accuracy per model and topic, for all topics; 0 without questions."""
    topics = models.select("model", F.explode(F.array(*[F.lit(t) for t in P.TOPICS])).alias("topic"))
    counted = picked.groupBy("model", "topic").agg(
        F.sum("correct").alias("correct"), F.count(F.lit(1)).alias("total")
    )
    joined = topics.join(counted, ["model", "topic"], "left").fillna(0, ["correct", "total"])
    return joined.withColumn("accuracy", _ratio(F.col("correct"), F.col("total")))


def overall_accuracy(topics: DataFrame) -> DataFrame:
    return (
        topics.groupBy("model")
        .agg(F.sum("correct").alias("correct"), F.sum("total").alias("total"))
        .withColumn("overall_accuracy", _ratio(F.col("correct"), F.col("total")))
    )


def leaderboard(topics: DataFrame) -> DataFrame:
    """One row per model: its last path part as ``name``, accuracy of every topic
    and overall."""
    wide = topics.groupBy("model").pivot("topic", P.TOPICS).agg(F.first("accuracy"))
    overall = overall_accuracy(topics).select("model", "overall_accuracy")
    name = F.regexp_extract("model", "([^/]*)/*$", 1)
    return wide.fillna(0.0).join(overall, "model").withColumn("name", name)


def best_model(overall: DataFrame) -> DataFrame:
    return overall.orderBy(F.desc("overall_accuracy"), "model").limit(1)


def perplexity(df: DataFrame, loss: str, keys: list[str]) -> DataFrame:
    """exp of the mean loss; infinite where that overflows."""
    return df.groupBy(*keys).agg(F.exp(F.avg(loss)).alias("perplexity"))
