"""Texts with tagged SMILES to token ids of two vocabularies at once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from molcorpus.functions import patterns as P
from molcorpus.functions.text import bind, find_all
from molcorpus.functions.tokenizers import tok_whitespace
from molcorpus.operators import vocab as V
from molcorpus.operators.lookup import replace_entries
from molcorpus.operators.tokenizer import Tokenizer, rule

MODES = ("base", "base_special", "chem_only", "hybrid")


def pieces_of(text: Column) -> Column:
    """Text split at segments whose tags stand on one line; the segments stay as
    pieces of their own, empty pieces are dropped."""
    found = F.struct(
        find_all(text, P.TAGGED_SPLIT).alias("tagged"),
        F.split(text, P.TAGGED_SPLIT, -1).alias("between"),
    )

    def alternating(f: Column) -> Column:
        pairs = F.transform(f["between"], lambda b, i: F.array(b, F.get(f["tagged"], i)))
        return F.filter(F.flatten(pairs), lambda p: F.coalesce(p != "", F.lit(False)))

    return bind(found, alternating)


def hybrid_segments(df: DataFrame, key: str, col: str) -> DataFrame:
    """One row per piece: ``(key, seg, piece, is_chem)``."""
    return df.select(key, F.posexplode(pieces_of(F.col(col))).alias("seg", "piece")).withColumn(
        "is_chem", _is_chem(F.col("piece"))
    )


def _is_chem(piece: Column) -> Column:
    return piece.startswith(P.START_TAG) & piece.endswith(P.END_TAG)


def _content(piece: Column) -> Column:
    tags = len(P.START_TAG) + len(P.END_TAG)
    return F.substr(piece, F.lit(len(P.START_TAG) + 1), F.length(piece) - tags)


def base_tokens(text: Column, tags: bool = True) -> Column:
    """Words and symbol runs; the two tags are tokens wherever they stand."""
    if not tags:
        return tok_whitespace(text)
    for tag in (P.START_TAG, P.END_TAG):
        text = F.replace(text, F.lit(tag), F.lit(f" {tag} "))
    either = "|".join(tag.replace("[", r"\[").replace("]", r"\]") for tag in (P.START_TAG, P.END_TAG))
    return find_all(text, f"{either}|{P.WORD_TOKEN_JAVA}")


def hybrid_tokens(
    df: DataFrame, col: str, chem: Tokenizer, out: str, base: Callable[[Column], Column] = base_tokens, bos: str | None = None
) -> DataFrame:
    """Add the token array over both vocabularies: tokens start with ``c`` where
    they belong to the chemical one and with ``b`` where to the base. A base
    tokenizer that starts every text with ``bos`` does so for every piece; only that
    of the first piece stays."""
    cut = df.withColumn("_pieces", pieces_of(F.col(col)))
    contents = F.transform("_pieces", lambda p: F.when(_is_chem(p), _content(p)).otherwise(F.lit("")))
    listed = cut.withColumn("_chem", chem.many(contents))

    def piece_tokens(piece: Column, place: Column) -> Column:
        inside = F.transform(F.get("_chem", place), lambda t: F.concat(F.lit("c"), t))
        plain = base(piece) if bos is None else bind(base(piece), lambda t: strip_leading_bos(t, place, bos))
        outside = F.transform(plain, lambda t: F.concat(F.lit("b"), t))
        start, end = F.array(F.lit("b" + P.START_TAG)), F.array(F.lit("b" + P.END_TAG))
        return F.when(_is_chem(piece), F.concat(start, inside, end)).otherwise(outside)

    tokens = F.flatten(F.transform("_pieces", piece_tokens))
    return listed.withColumn(out, tokens).drop("_pieces", "_chem")


def hybrid_encode(
    df: DataFrame,
    col: str,
    base: DataFrame,
    chem: DataFrame,
    row_keys: list[str],
    chem_tokenizer: Tokenizer | None = None,
    out: str = "ids",
    base_tokenizer: Callable[[Column], Column] = base_tokens,
    bos: str | None = None,
) -> DataFrame:
    """Plain text through the base vocabulary, tagged SMILES through the chemical
    one (element tokens if no tokenizer is given) with its ids moved behind the
    base ids, tags as ids around them. ``bos`` names the token that the base
    tokenizer starts a text with, if it does."""
    ids = V.hybrid_ids(base, chem)
    both = base.select(F.concat(F.lit("b"), "token").alias("token"), "id").unionByName(
        ids.select(F.concat(F.lit("c"), "token").alias("token"), F.col("hybrid_id").alias("id"))
    )
    base_unk = V.unk_id(base)
    chem_unk = ids.filter(F.col("token") == V.UNK).first()
    unknown = {"c": chem_unk["hybrid_id"] if chem_unk else base_unk, "": base_unk}
    tokens = hybrid_tokens(df, col, chem_tokenizer or rule("element"), "_tokens", base_tokenizer, bos)
    found = replace_entries(tokens, "_tokens", both, unknown, row_keys, "_ids")
    # The tokens are asked for twice, so that they stay a column: moved into the call of the
    # lookup, Spark could not evaluate a variable bound within another lambda.
    return found.withColumn(out, F.when(F.size("_tokens") >= 0, F.col("_ids"))).drop("_tokens", "_ids")


def strip_leading_bos(tokens: Column, piece: Column, bos: int | str) -> Column:
    """Ids or tokens of one piece; all but the first piece lose a leading
    start-of-text one, which base tokenizers that add one put before every piece."""
    ids, leading = tokens, (piece > 0) & (F.get(tokens, F.lit(0)) == bos)
    return F.when(leading, F.slice(ids, 2, F.greatest(F.size(ids) - 1, F.lit(0)))).otherwise(ids)


def encode_mode(
    df: DataFrame,
    col: str,
    mode: str,
    base: DataFrame,
    chem: DataFrame,
    row_keys: list[str],
    chem_tokenizer: Tokenizer | None = None,
    out: str = "ids",
) -> DataFrame:
    """Encode in one of the four modes."""
    chem_tokenizer = chem_tokenizer or rule("element")
    if mode == "hybrid":
        return hybrid_encode(df, col, base, chem, row_keys, chem_tokenizer, out)
    if mode == "chem_only":
        tokens, vocab = chem_tokenizer(F.col(col)), chem
    elif mode in ("base", "base_special"):
        tags = mode == "base_special"
        tokens = base_tokens(F.col(col), tags)
        vocab = base if tags else base.filter(~F.col("token").isin(P.START_TAG, P.END_TAG))
    else:
        raise ValueError(f"unknown mode {mode}")
    coded = V.encode(df.withColumn("_tokens", tokens), "_tokens", vocab, row_keys, out)
    return coded.drop("_tokens")
