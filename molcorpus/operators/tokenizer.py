"""Tokenizers under one face, whether they are rules or learned.

A tokenizer maps an array of texts to an array of token lists: a learned one may
be an Arrow function, which cannot be called for single entries inside a lambda.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from molcorpus.functions import patterns as P
from molcorpus.functions.molecule import parsed_multiplier
from molcorpus.functions.tokenizers import TOKENIZERS, tok_whitespace
from molcorpus.operators import learned as L
from molcorpus.operators import matcher
from molcorpus.operators import vocab as V


@dataclass
class Tokenizer:
    many: Callable[[Column], Column]

    def __call__(self, text: Column) -> Column:
        return F.get(self.many(F.array(text)), F.lit(0))


def each(one: Callable[[Column], Column]) -> Tokenizer:
    return Tokenizer(lambda texts: F.transform(texts, lambda t: one(t)))


def rule(name: str) -> Tokenizer:
    return each(TOKENIZERS[name])


def pair_merges(trained: L.Trained, pretokens: Callable[[Column], Column] | None) -> Tokenizer:
    letters = [t for t in L.vocabulary_list(trained.vocab) if len(t) == 1]
    encode = L.bpe(trained.merges, letters)
    words = pretokens or F.array
    return Tokenizer(lambda texts: encode(F.transform(texts, lambda t: words(t))))


def pieces(vocab: DataFrame, pretokens: Callable[[Column], Column] | None) -> Tokenizer:
    cut = matcher.wordpiece(L.vocabulary_list(vocab), L.CONTINUES, P.SPECIAL_TOKENS[0], L.LONGEST_WORD)
    words = pretokens or F.array
    return Tokenizer(lambda texts: cut(F.transform(texts, lambda t: words(t))))


def longest(vocab: DataFrame) -> Tokenizer:
    return Tokenizer(matcher.longest_match(L.vocabulary_list(vocab), P.SPECIAL_TOKENS[0]))


def build(
    name: str,
    segments: DataFrame,
    col: str,
    order: list[str],
    max_size: int = 20_000,
    min_freq: int = 2,
    multiplier: Callable[[Column], Column] | None = None,
    multipliers: tuple[float, float] = (1.0, 1.2),
) -> tuple[Tokenizer, DataFrame]:
    """The tokenizer of that name and its vocabulary, learned from SMILES segments
    keyed by ``order`` (a key and at most one counter)."""
    if name in ("bpe", "spe"):
        pretokens = tok_whitespace if name == "bpe" else None
        trained = L.train_bpe(segments, col, max_size, min_freq, pretokens)
        return pair_merges(trained, pretokens), trained.vocab
    if name in ("wordpiece", "swp"):
        pretokens = tok_whitespace if name == "wordpiece" else None
        trained = L.train_wordpiece(segments, col, max_size, min_freq, pretokens)
        return pieces(trained.vocab, pretokens), trained.vocab
    if name == "manual_spe":
        trained = L.train_spe(segments, col, order, max_size, min_freq)
        return longest(trained.vocab), trained.vocab
    if name == "scored_spe":
        trained = L.train_spe(
            segments, col, order, max_size, min_freq,
            multiplier=multiplier or parsed_multiplier, multipliers=multipliers,
        )
        return longest(trained.vocab), trained.vocab
    if name not in TOKENIZERS:
        raise ValueError(f"unknown tokenizer {name}")
    tokenizer = rule(name)
    rows = V.token_rows(segments.select(*order, tokenizer(F.col(col)).alias("tokens")), order, "tokens")
    if name == "kmer":
        return tokenizer, V.topk_vocab(rows, [*order, "pos"], max_size)
    return tokenizer, V.first_seen_vocab(rows, [*order, "pos"])
