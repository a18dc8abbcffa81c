"""Vocabulary tables ``(token, id)``: building, merging, encoding, decoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from molcorpus.functions import patterns as P
from molcorpus.functions.text import entries
from molcorpus.operators.lookup import replace_entries
from molcorpus.operators.ranking import first_places, number_rows
from molcorpus.session import small_table

UNK = P.SPECIAL_TOKENS[0]


def special_vocab(spark) -> DataFrame:
    rows = [(token, i) for i, token in enumerate(P.SPECIAL_TOKENS)]
    return small_table(spark, "token string, id bigint", rows)


def token_rows(df: DataFrame, keys: list[str], col: str) -> DataFrame:
    """One row per token: the keys, ``pos`` and ``token``."""
    return entries(df, keys, col, "pos", "token")


def _first_seen(tokens: DataFrame, order: list[str]) -> DataFrame:
    # The minimum is taken before the shuffle, so a frequent token costs nothing.
    return first_places(tokens, "token", order, F.count(F.lit(1)), "freq")


def first_seen_vocab(tokens: DataFrame, order: list[str]) -> DataFrame:
    """Special tokens 0-3, then the others by first appearance in ``order``."""
    return extend_vocab(special_vocab(tokens.sparkSession), tokens, order)


def extend_vocab(vocab: DataFrame, tokens: DataFrame, order: list[str]) -> DataFrame:
    """Keep all ids, append unseen tokens after the largest in order of appearance."""
    start = vocab.agg(F.max("id")).first()[0] + 1
    unseen = _first_seen(tokens, order).join(vocab, "token", "left_anti")
    return vocab.select("token", "id").unionByName(
        number_rows(unseen, ["first"], start).select("token", "id")
    )


def topk_vocab(tokens: DataFrame, order: list[str], max_size: int | None) -> DataFrame:
    """Special tokens, then the most frequent ones; ties by first appearance."""
    specials = special_vocab(tokens.sparkSession)
    ranked = _first_seen(tokens, order)
    if max_size:
        ranked = ranked.orderBy(F.desc("freq"), "first").limit(max_size - len(P.SPECIAL_TOKENS))
    fresh = ranked.filter(~F.col("token").isin(P.SPECIAL_TOKENS))
    numbered = number_rows(fresh, [F.desc("freq"), F.col("first")], len(P.SPECIAL_TOKENS))
    return specials.unionByName(numbered.select("token", "id"))


def normalise_vocab(vocab: DataFrame) -> DataFrame:
    """Make sure ``[UNK]`` has id 0, moving the other ids up by one if needed."""
    unk_id, zero_taken = vocab.agg(
        F.max(F.when(F.col("token") == UNK, F.col("id"))), F.max(F.col("id") == 0)
    ).first()
    shift = int(unk_id != 0) if unk_id is not None else int(bool(zero_taken))
    others = vocab.filter(F.col("token") != UNK).select("token", (F.col("id") + shift).alias("id"))
    unk = small_table(vocab.sparkSession, "token string, id bigint", [(UNK, 0)])
    return unk.unionByName(others)


def merge_vocab(loaded: DataFrame, own: DataFrame) -> DataFrame:
    """Both vocabularies; the loaded one wins. ``id_collision`` marks ids that
    ended up with more than one token."""
    both = loaded.select("token", "id").unionByName(
        own.select("token", "id").join(loaded, "token", "left_anti")
    )
    shared = F.count(F.lit(1)).over(Window.partitionBy("id")) > 1
    return both.withColumn("id_collision", shared)


def invert_vocab(vocab: DataFrame) -> DataFrame:
    """``(id, token)``; fails when two tokens share an id."""
    doubled = F.raise_error(F.concat(F.lit("id with several tokens: "), F.col("id").cast("string")))
    counted = vocab.groupBy("id").agg(F.min("token").alias("token"), F.count(F.lit(1)).alias("n"))
    return counted.select("id", F.when(F.col("n") > 1, doubled).otherwise(F.col("token")).alias("token"))


def unk_id(vocab: DataFrame) -> int:
    return vocab.filter(F.col("token") == UNK).first()["id"]


def encode(df: DataFrame, col: str, vocab: DataFrame, row_keys: list[str], out: str = "ids") -> DataFrame:
    """Token array to id array, unknown tokens to the id of ``[UNK]``."""
    return replace_entries(df, col, vocab.select("token", "id"), unk_id(vocab), row_keys, out)


def decode(df: DataFrame, col: str, vocab: DataFrame, row_keys: list[str], out: str = "text") -> DataFrame:
    """Id array to concatenated text, unknown ids to ``[UNK]``."""
    tokens = replace_entries(df, col, vocab.select("id", "token"), UNK, row_keys, out)
    return tokens.withColumn(out, F.array_join(out, ""))


def hybrid_ids(base: DataFrame, chem: DataFrame) -> DataFrame:
    """``(token, chem_id, hybrid_id)``: chemical ids placed after the base ids."""
    start = base.agg(F.max("id")).first()[0] + 1
    renamed = chem.select("token", F.col("id").alias("chem_id"))
    return number_rows(renamed, ["chem_id"], start, "hybrid_id")


def hybrid_vocab(base: DataFrame, chem: DataFrame) -> DataFrame:
    """Base tokens and the chemical tokens whose string is not among them."""
    fresh = hybrid_ids(base, chem).join(base, "token", "left_anti")
    return base.select("token", "id").unionByName(
        fresh.select("token", F.col("hybrid_id").alias("id"))
    )


def hybrid_encode_token(tokens: DataFrame, base: DataFrame, chem: DataFrame) -> DataFrame:
    """Add ``id``: of the base vocabulary (its tags among them), else of the
    chemical one. A token neither knows gets the chemical unknown id, or the base
    one when the chemical vocabulary has none."""
    unk = unk_id(base)
    from_base = base.select("token", F.when(F.col("id") != unk, F.col("id")).alias("base_id"))
    from_chem = hybrid_ids(base, chem).select("token", "hybrid_id")
    chem_unk = from_chem.filter(F.col("token") == UNK).first()
    fallback = chem_unk["hybrid_id"] if chem_unk else unk
    return (
        tokens.join(from_base, "token", "left")
        .join(from_chem, "token", "left")
        .withColumn("id", F.coalesce("base_id", "hybrid_id", F.lit(fallback)))
        .drop("base_id", "hybrid_id")
    )


def hybrid_decode_token(ids: DataFrame, base: DataFrame, chem: DataFrame, skip_special: bool = False) -> DataFrame:
    """Add ``token`` for each ``id``; the two tags become empty when skipped."""
    from_chem = hybrid_ids(base, chem).select(F.col("hybrid_id").alias("id"), F.col("token").alias("_c"))
    from_base = base.select("id", F.col("token").alias("_b"))
    joined = ids.join(from_chem, "id", "left").join(from_base, "id", "left")
    token = F.coalesce("_c", "_b")
    if skip_special:
        token = F.when(F.col("_b").isin(P.START_TAG, P.END_TAG), "").otherwise(token)
    return joined.withColumn("token", token).drop("_b", "_c")


def roundtrip_report(df: DataFrame, text: str, tokens: str, vocab: DataFrame, reloaded: DataFrame, row_keys: list[str]) -> DataFrame:
    """Share of texts that survive encoding and decoding, and whether the
    vocabulary survived saving and loading."""
    decoded = decode(encode(df, tokens, vocab, row_keys, "_ids"), "_ids", vocab, row_keys, "_text")
    texts = decoded.agg(
        F.count(F.lit(1)).alias("n_texts"),
        F.count_if(F.col("_text") == F.col(text)).alias("n_equal"),
    )
    other = reloaded.select("token", F.col("id").alias("_id"))
    changed = vocab.join(other, "token", "full_outer").agg(
        F.count_if(~F.col("id").eqNullSafe(F.col("_id"))).alias("n_vocab_changed")
    )
    return texts.select(
        "n_texts",
        "n_equal",
        F.round(F.col("n_equal") / F.col("n_texts"), 9).alias("rate"),
        changed.scalar().alias("n_vocab_changed"),
    )
