"""Learned tokenizers: pair-merge training as Spark jobs, and their encoders.

While merging, every symbol is one character of a private alphabet whose order is
the id order. A word is then a plain string, a merge is a native ``replace`` of
two characters by one (left to right, without overlap), and a pair is a substring
of length two.
"""

from __future__ import annotations

import heapq
import json
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import islice, pairwise

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from molcorpus.functions import patterns as P
from molcorpus.functions.text import bind, find_all
from molcorpus.functions.tokenizers import tok_atomwise, tok_whitespace
from molcorpus.operators import matcher
from molcorpus.operators.lookup import BROADCAST_ROWS, replace_entries
from molcorpus.operators.merging import Merges
from molcorpus.operators.pair_index import PairIndex
from molcorpus.operators.ranking import first_places
from molcorpus.session import materialize, small_table

CONTINUES = "##"
# Words of more characters are one unknown piece.
LONGEST_WORD = 100
# Best pairs of a round from whose runs the next merges are worked out, and the
# number of distinct runs that may reach the driver for it.
PAIRS_PER_ROUND = 2_048
RUNS_PER_ROUND = 100_000
# Leading pairs whose next tokens are weighed along with those needed now, and the
# number of tokens weighed ahead at most.
PAIRS_AHEAD, TOKENS_AHEAD = 32, 2_000
# The same where an index finds the words of the pairs.
INDEX_PAIRS, INDEX_RUNS = 2_048, 20_000
# Pairs ranked per round where tokens have multipliers.
SCORED_PAIRS = 1024
# Merges replayed on the stored words before they are stored again.
MERGES_PER_STORE = 64


@dataclass
class Trained:
    """``vocab (token, id)``, ``merges (rank, left, right, token, freq)`` and
    ``frequencies (token, freq)``."""

    vocab: DataFrame
    merges: DataFrame
    frequencies: DataFrame


# --- How a word is spelled in symbols -------------------------------------------


def characters(word: Column) -> Column:
    return find_all(word, "(?s).")


def continued_characters(word: Column) -> Column:
    """Characters, all but the first marked as going on."""
    return F.transform(characters(word), lambda c, i: F.when(i > 0, F.concat(F.lit(CONTINUES), c)).otherwise(c))


def _private(i: int) -> str:
    """The i-th private character; UTF-8 order is id order (surrogates left out)."""
    point = 0x800 + i
    return chr(point if point < 0xD800 else point + 0x800)


# --- Training ------------------------------------------------------------------


def word_counts(df: DataFrame, words: Column, order: list[str] | None = None) -> DataFrame:
    """Distinct entries of an array of words with their count and, where ``order``
    is given (a key, of numbers or text, and at most one counter), the first place of
    a text that is one word. This is the only pass over the corpus, and it is combined
    before the shuffle."""
    count = F.count(F.lit(1))
    if order is None:
        return df.select(F.explode(words).alias("word")).groupBy("word").agg(count.alias("c"))
    if len(order) > 2:
        raise ValueError("the order is a key and at most one counter")
    counted = df.select(F.explode(words).alias("word"), *order)
    # the last of the three packed numbers is left free, for places within a word
    counted = counted.withColumn("_none", F.lit(0))
    return first_places(counted, "word", [*order, "_none"], count, "c")


def _met(at: Column) -> Column:
    """Place of a symbol or pair: that of its word, and its position there."""
    return F.min(F.col("first") + at).alias("met")


@dataclass
class Scoring:
    """Multipliers of merged tokens, between two bounds; ``tokens`` names the
    symbols and grows with the merges."""

    spark: SparkSession
    tokens: list[str]
    multiplier: Callable[[Column], Column]
    lowest: float
    highest: float

    def __post_init__(self) -> None:
        self.weight = self.multiplier(F.col("token"))
        self.known: dict[str, float] = {}

    def name(self, symbols: str) -> str:
        return "".join(self.tokens[_place(c)] for c in symbols)

    def weigh(self, pairs: list[str], ahead: Iterable[str] = ()) -> dict[str, float]:
        """Multipliers of a few pairs; where one is not known yet, also those of other
        stretches of symbols that may be asked for next are found out."""
        names = {p: self.name(p) for p in pairs}
        asked = set(names.values()) - self.known.keys()
        if asked:
            asked.update(n for n in islice(map(self.name, ahead), TOKENS_AHEAD) if n not in self.known)
            rows = small_table(self.spark, "token string", [(t,) for t in asked])
            self.known |= dict(rows.select("token", self.weight).collect())
        return {p: self.known[n] for p, n in names.items()}


def _merge_words(merges: list[tuple[str, str]]) -> Callable[[Column], Column]:
    """The merges one after another, as ``str.replace`` makes them. The next one that changes a
    word is the first, after the last one made, whose pair the word holds by then."""
    turns: defaultdict[str, list[int]] = defaultdict(list)
    for turn, (pair, _) in enumerate(merges):
        turns[pair].append(turn)

    def after(word: str) -> str:
        if len(word) > LONGEST_WORD:
            for pair, fused in merges:
                word = word.replace(pair, fused)
            return word
        last = -1
        while True:
            held = (t for p in map("".join, pairwise(word)) if p in turns for t in turns[p] if t > last)
            last = min(held, default=-1)
            if last < 0:
                return word
            word = word.replace(*merges[last])

    return F.arrow_udf(lambda batch: pa.array([after(w) for w in batch.to_pylist()], pa.string()), "string")


def _merged(words: DataFrame, merges: list[tuple[str, str]]) -> DataFrame:
    """Words after some merges. A few merges are one constant, so that every round
    runs the same compiled code; of many, a word is only asked for those it holds."""
    if not merges:
        return words
    if len(merges) > MERGES_PER_STORE:
        return words.withColumn("w", _merge_words(merges)(F.col("w")))
    steps = F.from_json(F.lit(json.dumps(merges)), "array<array<string>>")
    return words.withColumn(
        "w", F.aggregate(steps, F.col("w"), lambda w, m: F.replace(w, F.get(m, F.lit(0)), F.get(m, F.lit(1))))
    )


def _pairs(words: DataFrame) -> DataFrame:
    places = F.sequence(F.lit(1), F.length("w") - 1)
    pairs = F.transform(places, lambda i: F.substr("w", i, F.lit(2)))
    found = words.filter(F.length("w") > 1).select(
        *[c for c in words.columns if c != "w"], F.posexplode(pairs).alias("at", "pair")
    )
    met = [_met(F.col("at"))] if "first" in words.columns else []
    return found.groupBy("pair").agg(F.sum("c").alias("n"), *met)


def _runs(words: DataFrame, pairs: list[str]) -> DataFrame:
    """Distinct stretches of words all of whose neighbours are among the pairs,
    with their count (and first place). Stretches share no symbol."""
    following: dict[str, str] = {}
    for left, right in pairs:
        following[left] = following.get(left, "") + right
    steps = "|".join(f"{left}(?=[{rights}])" for left, rights in following.items())
    run = f"(?s)(?:{steps})++."
    total = F.sum("c").alias("n")
    if "first" not in words.columns:
        return words.select("c", F.explode(find_all(F.col("w"), run)).alias("run")).groupBy("run").agg(total)

    def placed(pieces: Column) -> Column:
        before = lambda i: F.length(F.array_join(F.slice(pieces, 1, i), ""))
        return F.transform(pieces, lambda p, i: F.struct(p.alias("run"), before(i).alias("at")))

    pieces = bind(find_all(F.col("w"), f"{run}|."), placed)
    stretches = words.select("c", "first", F.explode(pieces).alias("p")).filter(F.length("p.run") > 1)
    return stretches.groupBy("p.run").agg(total, _met(F.col("p.at")))


def _greedy(runs: list, bound, ties: str, scoring: Scoring | None) -> Iterator[tuple[str, int]]:
    """The next merges, one at a time, as single counting would find them.

    The runs hold every place of the best pairs and of all pairs that grow from
    them alone. Any other pair is at most as frequent as ``bound``, the first pair
    of the ranking beyond: it only loses places, or grew from such a pair and comes
    after it. So the best pair of the runs is the best of all as long as it ranks
    before ``bound``; with multipliers, as long as its score is above what the
    largest multiplier makes of that count. The caller sends the symbol that takes
    the pair's place.
    """
    texts, ns, width = [r["run"] for r in runs], [r["n"] for r in runs], {}
    counts: Counter[str] = Counter()
    where: defaultdict[str, set[int]] = defaultdict(set)
    weights: dict[str, float] = {}
    places: dict = {}  # first places of pairs, as long as no place of theirs changes
    for i, text in enumerate(texts):
        for pair in map("".join, pairwise(text)):
            counts[pair] += ns[i]
            where[pair].add(i)

    def met(pair: str):
        if pair not in places:
            inside = [i for i in where[pair] if pair in texts[i]]
            before = lambda t: sum(width.get(c, 1) for c in t[: t.index(pair)])
            places[pair] = min(runs[i]["met"] + before(texts[i]) for i in inside)
        return places[pair]

    def ahead() -> Iterator[str]:
        """What merges of the leading pairs would make neighbours."""
        scores = {p: n * weights.get(p, scoring.highest) for p, n in counts.items()}
        for pair in heapq.nlargest(PAIRS_AHEAD, scores, scores.get):
            beside = {t[max(at - 1, 0) : at + 3] for i in where[pair] if (at := (t := texts[i]).find(pair)) >= 0}
            yield from {s[k : k + 3] for s in beside for k in range(len(s) - 2)}

    place_of = met if ties == "first" else str
    while counts:
        scores = counts
        if scoring:
            best = max((n * weights[p] for p, n in counts.items() if p in weights), default=0)
            if any(n * scoring.highest >= best for p, n in counts.items() if p not in weights):
                weights |= scoring.weigh([p for p in counts if p not in weights], ahead())
            scores = {p: n * weights[p] for p, n in counts.items() if p in weights}
        most = max(scores.values())
        pair = min((p for p, score in scores.items() if score == most), key=place_of)
        if bound and scoring and most <= bound["n"] * scoring.highest:
            return
        if bound and not scoring and (-most, place_of(pair)) > (-bound["n"], bound["tie"]):
            return
        fused = yield pair, counts[pair]
        width[fused] = sum(width.get(c, 1) for c in pair)
        for i in where.pop(pair):
            before = texts[i]
            texts[i] = after = before.replace(pair, fused)
            if after == before:
                continue
            for text, n in ((before, -ns[i]), (after, ns[i])):
                for p in map("".join, pairwise(text)):
                    counts[p] += n
                    places.pop(p, None)
                    if not counts[p]:
                        del counts[p]  # occurs no more, or not yet again
            for p in map("".join, pairwise(after)):
                where[p].add(i)


def _best_pairs(
    words: DataFrame, ties: str, scoring: Scoring | None, used: int
) -> tuple[Iterator[tuple[str, int]], int]:
    """Merges of one round, from two jobs: the best pairs, then their runs. With
    too many distinct runs fewer pairs are used; where one pair alone has too many
    (a doubled symbol's differ by length), its merge is made from its count, which
    all words were read for. Also returns how many pairs were used."""
    tie = "pair" if ties == "id" else "met"
    ranked = _pairs(words).select("pair", "n", F.col(tie).alias("tie")).orderBy(F.desc("n"), "tie")
    top = ranked.limit(PAIRS_PER_ROUND + 1).collect()
    while top:
        runs = _runs(words, [r["pair"] for r in top[:used]]).limit(RUNS_PER_ROUND + 1).collect()
        if len(runs) <= RUNS_PER_ROUND:
            return _greedy(runs, top[used] if len(top) > used else None, ties, scoring), used
        if used == 1:
            return _single(top[0], scoring), used
        used //= 2
    return iter(()), used


def _single(best, scoring: Scoring | None) -> Iterator[tuple[str, int]]:
    """The best pair of all, and then a new round. With multipliers the ranking of
    all pairs decides."""
    if scoring is None:
        yield best["pair"], best["n"]


def _scored_pairs(words: DataFrame, ties: str, scoring: Scoring) -> Iterator[tuple[str, int]]:
    """Merges of one round from all pairs, ranked by count times multiplier."""
    # One row per vocabulary entry.
    names = small_table(
        words.sparkSession, "ch string, token string", [(_private(i), t) for i, t in enumerate(scoring.tokens)]
    )
    side = lambda name: F.broadcast(names.toDF(f"{name}_ch", name))
    ranked = (
        _pairs(words)
        .join(side("l"), F.substring("pair", 1, 1) == F.col("l_ch"))
        .join(side("r"), F.substring("pair", 2, 1) == F.col("r_ch"))
        .withColumn("score", F.col("n") * scoring.multiplier(F.concat("l", "r")))
        .orderBy(F.desc("score"), "pair" if ties == "id" else "met")
    )
    top = ranked.select("pair", "n", "score").limit(SCORED_PAIRS).collect()
    yield from _independent(top, len(top) < SCORED_PAIRS, scoring)


def _independent(pairs: list, complete: bool, scoring: Scoring) -> Iterator[tuple[str, int]]:
    """The head of a scored ranking that single merges would take in the same order.

    A pair without a symbol in common with the merged ones keeps its count and
    place. A new pair occurs at most as often as the one it grew from, which touches
    a merged symbol (out of ``aa``: half as often as itself), and has at most the
    largest multiplier: the head ends where such a pair could come first.
    """
    used, own = set(), 0
    unseen = 0 if complete else pairs[-1]["score"] / scoring.lowest
    for i, pair in enumerate(pairs):
        symbols = set(pair["pair"])
        if used:
            grown = max((q["n"] for q in pairs[i:] if used & set(q["pair"])), default=0)
            if used & symbols or max(grown, unseen, own) * scoring.highest >= pair["score"]:
                return
        yield pair["pair"], pair["n"]
        used |= symbols
        if len(symbols) == 1:
            own = max(own, pair["n"] // 2)


def train_merges(
    words: DataFrame,
    spell: Callable[[Column], Column],
    max_size: int,
    min_freq: int,
    specials: list[str],
    ties: str = "id",
    multiplier: Callable[[Column], Column] | None = None,
    multipliers: tuple[float, float] = (1.0, 1.0),
    count_specials: bool = True,
    as_run: bool = False,
) -> Trained:
    """Merge the best pair of neighbouring symbols until the vocabulary is full or
    no pair is frequent enough.

    ``words`` comes from ``word_counts``. Ties go to the smaller ids (``id``; the
    alphabet is sorted) or, for whole strings, to the pair met first in the corpus
    (``first``; so is the alphabet). With ``multiplier`` the ranking is by count
    times multiplier of the merged token (between the two ``multipliers``), while
    the frequency limit stays on the count. A round makes as many merges as are
    certain to be those of single merging. With ``as_run`` the vocabulary may
    exceed its size by one token.
    """
    spark = words.sparkSession
    kept = ["c", "first"] if ties == "first" else ["c"]
    # Few bytes but much work per row: spread over all cores.
    spelled = materialize(
        words.select(spell(F.col("word")).alias("symbols"), *kept).repartition(
            spark.sparkContext.defaultParallelism
        )
    )
    met = [_met(F.col("at"))] if ties == "first" else []
    alphabet = (
        spelled.select(*kept, F.posexplode("symbols").alias("at", "symbol"))
        .groupBy("symbol")
        .agg(F.sum("c").alias("freq"), *met)
        .orderBy("met" if met else "symbol")
        .limit(BROADCAST_ROWS + 1)
        .collect()
    )
    if len(alphabet) > BROADCAST_ROWS:
        raise ValueError("the alphabet is too large")
    tokens = [row["symbol"] for row in alphabet]
    freq = {row["symbol"]: row["freq"] for row in alphabet}
    continuing = any(t.startswith(CONTINUES) for t in tokens)
    if continuing:
        # Every character is a token of its own as well; plain ones come first.
        plain = sorted({t.removeprefix(CONTINUES) for t in tokens})
        tokens = plain + sorted(t for t in tokens if t.startswith(CONTINUES))
    ids = {t: i for i, t in enumerate(tokens)}

    private = small_table(
        spark, "symbol string, ch string", [(t, _private(i)) for t, i in ids.items()]
    )
    # The table is small enough to be shipped, so rows need no key to be joined by.
    coded = replace_entries(spelled, "symbols", private, None, [])
    stored = materialize(coded.select(F.array_join("symbols", "").alias("w"), *kept))
    merges: list[tuple] = []
    pending: list[tuple[str, str]] = []
    extra = len(specials) if count_specials else 0

    def full() -> bool:
        size = len(tokens) + extra
        return size > max_size if as_run else size >= max_size

    scoring = Scoring(spark, tokens, multiplier, *multipliers) if multiplier else None
    done, used = False, PAIRS_PER_ROUND
    # Places cannot be kept up to date by differences; scores need all pairs now and then.
    index = None
    if ties == "id" and not scoring and not full():
        index = PairIndex(stored, _merged, _runs, INDEX_PAIRS, INDEX_RUNS)
    while not done:
        if index:
            found = index.round()
        else:
            words = _merged(stored, pending)
            found, used = _best_pairs(words, ties, scoring, min(2 * used, PAIRS_PER_ROUND))
        step, made = next(found, None), 0
        if step is None and scoring:  # counts too close for the bound
            found = _scored_pairs(words, ties, scoring)
            step = next(found, None)
        while step is not None:
            pair, n = step
            if full() or n < max(min_freq, 1):
                done = True
                break
            left, right = (tokens[_place(c)] for c in pair)
            token = left + (right.removeprefix(CONTINUES) if continuing else right)
            known = token in ids
            if not known:
                ids[token] = len(tokens)
                tokens.append(token)
            merges.append((len(merges), left, right, token, n))
            freq[token] = freq.get(token, 0) + n
            pending.append((pair, _private(ids[token])))
            made += 1
            # A token made before gains places from elsewhere: count again first.
            step = None if known else _following(found, pending[-1][1])
        done = done or not made
        if index:
            if not done:
                index.apply(pending)
            pending = []
        elif len(pending) >= MERGES_PER_STORE:
            stored, pending = materialize(_merged(stored, pending).filter(F.length("w") > 1)), []

    vocab = [(t, i) for i, t in enumerate([*specials, *(t for t in tokens if t not in specials)])]
    return Trained(
        small_table(spark, "token string, id bigint", vocab),
        small_table(spark, "rank bigint, left string, right string, token string, freq bigint", merges),
        small_table(spark, "token string, freq bigint", list(freq.items())),
    )


def _place(ch: str) -> int:
    point = ord(ch)
    return (point if point < 0xD800 else point - 0x800) - 0x800


def _following(found: Iterator, fused: str):
    """The next merge after the last one was made; a plain list of merges needs no answer."""
    try:
        return found.send(fused) if hasattr(found, "send") else next(found)
    except StopIteration:
        return None


def train_bpe(df, col, max_size=20_000, min_freq=2, pretokens=tok_whitespace) -> Trained:
    """Byte-pair encoding over characters of pre-tokens; without pre-tokens over
    whole strings, as the fast SMILES pair encoder does."""
    specials = [*P.SPECIAL_TOKENS, P.START_TAG, P.END_TAG] if pretokens else P.SPECIAL_TOKENS
    words = word_counts(df, (pretokens or F.array)(F.col(col)))
    return train_merges(words, characters, max_size, min_freq, specials)


def train_wordpiece(df, col, max_size=20_000, min_freq=2, pretokens=tok_whitespace) -> Trained:
    """The same loop over characters marked as first or going on."""
    specials = [*P.SPECIAL_TOKENS, P.START_TAG, P.END_TAG] if pretokens else P.SPECIAL_TOKENS
    words = word_counts(df, (pretokens or F.array)(F.col(col)))
    return train_merges(words, continued_characters, max_size, min_freq, specials)


def train_spe(
    df, col, order, max_size=20_000, min_freq=0, multiplier=None, multipliers=(1.0, 1.0), as_run=False
) -> Trained:
    """SMILES pair encoding over atoms, ranked by count or by scored count. Pairs
    are counted within a SMILES; ties go to the pair met first."""
    words = word_counts(df, F.array(col), order)
    return train_merges(
        words, tok_atomwise, max_size, min_freq, P.SPECIAL_TOKENS, "first",
        multiplier, multipliers, count_specials=False, as_run=as_run,
    )


# --- Scoring of merged tokens ----------------------------------------------------


def structural_multiplier(token: Column, base: float = 1.0, pattern: float = 1.1, valid: float = 1.2) -> Column:
    """Bonus for merged tokens that look like a molecule or like part of one.

    A structural check, not a chemistry toolkit's parser: tokens must be known
    throughout, branches balanced and not empty, ring numbers paired, and no bond
    may dangle. A molecule moreover has no bare hydrogen or unusual bare element,
    and aromatic atoms only in a ring.
    """
    outside = F.regexp_replace(token, P.BRACKET, "")
    rings = F.array_sort(find_all(outside, f"{P.RING_NUMBER}|[0-9]"))
    marked = F.array_join(F.transform(rings, lambda r: F.concat(F.lit("<"), r, F.lit(">"))), "")
    paired = F.regexp_replace(marked, r"(<[^>]*>)\1", "") == ""
    depths = F.aggregate(
        find_all(outside, r"[()]"),
        F.struct(F.lit(0).alias("d"), F.lit(0).alias("low")),
        lambda s, ch: F.struct(
            (s["d"] + F.when(ch == "(", 1).otherwise(-1)).alias("d"),
            F.least(s["low"], s["d"] + F.when(ch == "(", 1).otherwise(-1)).alias("low"),
        ),
    )
    balanced = (depths["d"] == 0) & (depths["low"] == 0)
    known = token.rlike(f"^(?:{P.BRACKET_ATOM_TOKEN})++$")
    dangling = token.rlike(r"^[=#\-+.:~@/)(0-9%]|[=#\-+.:~@/(]$|\(\)|\(\(")
    part = known & balanced & paired & ~dangling
    organic = token.rlike(f"^(?:{P.ATOM_TOKEN})++$")
    ringless_aromatic = outside.rlike("[bcnops]") & ~outside.rlike("[0-9]")
    # "Cl" and "Br" hold no aromatic letter.
    return (
        F.when(part & organic & ~ringless_aromatic, valid).when(part, pattern).otherwise(base)
    )


# --- Encoding ------------------------------------------------------------------


def vocabulary_list(vocab: DataFrame) -> list[str]:
    """Tokens of a learned vocabulary, after a check that they are few enough."""
    rows = vocab.select("token").limit(BROADCAST_ROWS + 1).collect()
    if len(rows) > BROADCAST_ROWS:
        raise ValueError("the vocabulary is too large to be shipped to the executors")
    return [row["token"] for row in rows]


def longest_match(col: Column, tokens: list[str]) -> Column:
    """From each place the longest vocabulary token; a character that starts none
    becomes ``[UNK]``."""
    return F.get(matcher.longest_match(tokens, P.SPECIAL_TOKENS[0])(F.array(col)), F.lit(0))


def wordpiece(words: Column, tokens: list[str], longest_word: int = LONGEST_WORD) -> Column:
    """Each word as its longest first piece and longest continuing pieces; a word
    that does not come out even, or is too long, is one ``[UNK]``."""
    return F.get(matcher.wordpiece(tokens, CONTINUES, P.SPECIAL_TOKENS[0], longest_word)(F.array(words)), F.lit(0))


def bpe(merges: DataFrame, alphabet: list[str]) -> Callable[[Column], Column]:
    """An encoder from lists of words (one list per text) to lists of tokens:
    merges are applied by rank, characters outside the alphabet are dropped. Each
    distinct word of a batch is merged once."""
    rows = merges.orderBy("rank").select("left", "right").limit(BROADCAST_ROWS + 1).collect()
    if len(rows) > BROADCAST_ROWS:
        raise ValueError("the merges are too many to be shipped to the executors")
    folded = Merges([(row["left"], row["right"]) for row in rows], alphabet)
    shipped = merges.sparkSession.sparkContext.broadcast(folded)

    def encode(batch: pa.Array) -> pa.Array:
        merge = shipped.value
        texts = batch.flatten()
        coded = texts.flatten().dictionary_encode()
        flat, places = merge.fold([word or "" for word in coded.dictionary.to_pylist()])
        found = matcher.listed(flat, places, merge.names).take(coded.indices)
        upto = matcher.offsets(found).to_numpy()
        of_texts = pa.array(upto[matcher.offsets(texts).to_numpy()], pa.int32())
        return pa.ListArray.from_arrays(matcher.offsets(batch), pa.ListArray.from_arrays(of_texts, found.flatten()))

    return F.arrow_udf(encode, "array<array<string>>")
