"""Finding SMILES in plain text and checking tags against existing ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from molcorpus.functions import patterns as P
from molcorpus.functions import smiles as S
from molcorpus.functions.text import bind, entries, words
from molcorpus.operators.extract import segment_set

_TAGS_LENGTH = len(P.START_TAG) + len(P.END_TAG)


def split_words(df: DataFrame, key: str, col: str) -> DataFrame:
    """One row per whitespace-separated word: ``(key, pos, word)``."""
    return df.select(key, F.posexplode(words(F.col(col))).alias("pos", "word"))


def core_of(word: Column) -> Column:
    """The word without the punctuation around it."""
    return F.regexp_replace(word, P.PEEL_ENDS, "")


def peel(word: Column) -> dict[str, Column]:
    prefix = F.regexp_extract(word, P.PEEL_START, 0)
    core = core_of(word)
    suffix = F.substr(word, F.length(prefix) + F.length(core) + 1)
    return {"prefix": prefix, "core": core, "suffix": suffix}


def with_context(df: DataFrame, key: str, col: str, before: int = 7, after: int = 2) -> DataFrame:
    """Each word with the word before it and the words around it. The window is
    cut from the word array of the row, so nothing is shuffled."""
    split = df.select(key, words(F.col(col)).alias("_words"))
    return entries(split, [key, "_words"], "_words", "pos", "word").select(
        key,
        "pos",
        "word",
        F.get("_words", F.col("pos") - 1).alias("prev"),
        _around("_words", F.col("pos"), before, after).alias("context"),
    )


def _around(words_col: str, pos: Column, before: int, after: int) -> Column:
    first = F.greatest(pos - before, F.lit(0))
    return F.array_join(F.slice(F.col(words_col), first + 1, pos + after + 1 - first), " ")


def _tag_word(word: Column, prev: Column, element_names: bool) -> Column:
    def tagged(core: Column) -> Column:
        prefix = F.regexp_extract(word, P.PEEL_START, 0)
        suffix = F.substr(word, F.length(prefix) + F.length(core) + 1)
        # A peeled core has no punctuation left at its ends: it is clean.
        return F.when(
            S.is_clean_smiles(core, prev, element_names),
            F.concat(prefix, F.lit(P.START_TAG), core, F.lit(P.END_TAG), suffix),
        ).otherwise(word)

    already = word.contains(P.START_TAG) & word.contains(P.END_TAG)
    # Two regular expressions reject nearly all prose before any rule is run.
    return (
        F.when(~word.rlike(P.CAPITAL_OR_DIGIT), word)
        .when(~word.rlike(P.CANDIDATE_WORD_JAVA) | already, word)
        .otherwise(bind(core_of(word), tagged))
    )


def annotated_text(text: Column, element_names: bool = True) -> Column:
    """The text with SMILES tagged, as one expression."""

    def tag(found: Column) -> Column:
        tagged = F.transform(found, lambda w, i: _tag_word(w, F.get(found, i - 1), element_names))
        return F.array_join(tagged, " ")

    return bind(words(F.coalesce(text, F.lit(""))), tag)


def annotate(
    df: DataFrame,
    col: str,
    text_out: str = "text_reannotated",
    count_out: str = "reannotated_smiles_count",
    element_names: bool = True,
) -> DataFrame:
    """Add the text with SMILES tagged and their number, keeping all columns.

    A projection without a shuffle, so it also runs on a stream. Words that carry
    tags stay as they are; words come back joined by single spaces.
    """
    split = df.withColumn("_words", words(F.coalesce(F.col(col), F.lit(""))))
    tagged = split.withColumn(
        "_tagged",
        F.transform(
            "_words",
            lambda w, i: _tag_word(w, F.get("_words", i - 1), element_names),
        ),
    )
    # Every tagged word is longer by exactly the two tags.
    grown = F.length(F.array_join("_tagged", "")) - F.length(F.array_join("_words", ""))
    return tagged.withColumns(
        {
            text_out: F.array_join("_tagged", " "),
            count_out: (grown / _TAGS_LENGTH).cast("bigint"),
        }
    ).drop("_words", "_tagged")


def ambiguous_candidates(df: DataFrame, key: str, col: str, max_length: int = 6) -> DataFrame:
    """Short tokens that pass the rules placed before an outside review, with
    their context, for that review."""
    split = df.select(key, words(F.col(col)).alias("_words"))
    untagged = lambda w: ~(w.contains(P.START_TAG) & w.contains(P.END_TAG))
    found = F.filter(
        F.transform(
            "_words",
            lambda w, i: F.struct(
                i.alias("pos"),
                # Only words that can pass are peeled.
                F.when(w.rlike(P.CAPITAL_OR_DIGIT) & untagged(w), S.clean(core_of(w))).alias("token"),
            ),
        ),
        lambda s: (F.length(s["token"]) <= max_length) & S.passes_to_review(s["token"]),
    )
    return (
        split.select(key, "_words", F.explode(found).alias("_hit"))
        .select(
            key,
            F.col("_hit.pos").alias("pos"),
            F.col("_hit.token").alias("token"),
            F.get("_words", F.col("_hit.pos") - 1).alias("prev"),
            _around("_words", F.col("_hit.pos"), 7, 2).alias("context"),
        )
    )


def apply_verdicts(candidates: DataFrame, verdicts: DataFrame, element_names: bool = True) -> DataFrame:
    """Merge reviewer answers ``(token, context, answer)``: an answer with YES in
    it accepts, else one with NO in it rejects; without a clear answer the
    remaining rules decide."""
    said = F.upper("answer")
    answers = verdicts.groupBy("token", "context").agg(
        F.bool_or(said.contains("YES")).alias("yes"), F.bool_or(said.contains("NO")).alias("no")
    )
    rules = S.passes_after_review(F.col("token"), F.col("prev"), element_names)
    return (
        candidates.join(answers, ["token", "context"], "left")
        .withColumn("is_smiles", F.when(F.col("yes"), True).when(F.col("no"), False).otherwise(rules))
        .drop("yes", "no")
    )


def confusion(df: DataFrame, key: str, predicted: str, truth: str) -> DataFrame:
    """Per row: tag sets of both texts compared."""
    sets = df.select(
        key,
        segment_set(F.col(predicted)).alias("_p"),
        segment_set(F.col(truth)).alias("_t"),
    )
    return sets.select(
        key,
        F.size(F.array_intersect("_p", "_t")).cast("bigint").alias("tp"),
        F.array_except("_p", "_t").alias("fp_set"),
        F.array_except("_t", "_p").alias("fn_set"),
    ).select(
        key,
        "tp",
        F.size("fp_set").cast("bigint").alias("fp"),
        F.size("fn_set").cast("bigint").alias("fn"),
        "fp_set",
        "fn_set",
    )


def confusion_totals(rows: DataFrame) -> DataFrame:
    return rows.agg(*[F.sum(c).alias(f"total_{c}") for c in ("tp", "fp", "fn")])


def top_errors(rows: DataFrame, side: str, n: int = 1000) -> DataFrame:
    """Most frequent false positives (``fp``) or negatives (``fn``); ties by string."""
    return (
        rows.select(F.explode(f"{side}_set").alias("smiles"))
        .groupBy("smiles")
        .agg(F.count(F.lit(1)).alias("freq"))
        .orderBy(F.desc("freq"), "smiles")
        .limit(n)
    )


def count_check(df: DataFrame, key: str, stored: str, recomputed: str) -> DataFrame:
    return df.select(
        key,
        F.col(stored).cast("bigint").alias("stored"),
        F.col(recomputed).cast("bigint").alias("recomputed"),
        (F.col(recomputed) - F.col(stored)).cast("bigint").alias("difference"),
    )
