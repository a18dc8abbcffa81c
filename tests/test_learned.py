"""Pair-merge training against plain loops and, where installed, a library."""

import json
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from molcorpus.functions import patterns as P
from molcorpus.functions.molecule import kind, parsed_multiplier
from molcorpus.functions.tokenizers import tok_whitespace
from molcorpus.operators import learned as L
from molcorpus.operators import vocab as V
from molcorpus.operators.pair_index import PairIndex
from molcorpus.operators.tokenizer import build, pair_merges


def corpus(seed, n=150):
    rng = random.Random(seed)
    parts = ["C", "c1ccccc1", "(=O)", "N", "O", "Cl", "Br", "[Na+]", "CC"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(1, 8))) for _ in range(n)]


def loop(words, max_size, min_freq, taken, multiplier=None):
    """One merge at a time. Ties: smaller ids, or the pair met first."""
    words = [list(w) for w in words]
    freq = Counter(s for w in words for s in w)
    if multiplier is None and taken == "id":
        ids = {s: i for i, s in enumerate(sorted(freq))}
    else:
        ids = {s: i for i, s in enumerate(dict.fromkeys(s for w in words for s in w))}
    merges = []
    while len(ids) < max_size:
        pairs = Counter(p for w in words for p in zip(w, w[1:]))
        if not pairs:
            break
        met = {p: i for i, p in reversed(list(enumerate(pairs)))}
        score = {p: n * (multiplier("".join(p)) if multiplier else 1) for p, n in pairs.items()}
        tie = (lambda p: (ids[p[0]], ids[p[1]])) if taken == "id" else met.get
        best = min(pairs, key=lambda p: (-score[p], tie(p)))
        if pairs[best] < max(min_freq, 1):
            break
        token = "".join(best)
        merges.append((*best, token, pairs[best]))
        ids.setdefault(token, len(ids))
        freq[token] += pairs[best]
        for w in words:
            i = 0
            while i < len(w) - 1:
                if (w[i], w[i + 1]) == best:
                    w[i : i + 2] = [token]
                i += 1
    return merges, dict(freq), list(ids)


def atoms(smi):
    return re.findall(P.ATOM_TOKEN, smi)


def table(spark, strings):
    return spark.createDataFrame(list(enumerate(strings)), "doc_id bigint, smi string")


def merges_of(trained):
    return [tuple(r)[1:] for r in trained.merges.orderBy("rank").collect()]


@pytest.mark.parametrize("seed,pairs", [(0, 64), (0, 4), (1, 64), (1, 9)])
def test_atom_pairs(spark, seed, pairs, monkeypatch):
    monkeypatch.setattr(L, "PAIRS_PER_ROUND", pairs)
    strings = corpus(seed)
    got = L.train_spe(table(spark, strings), "smi", ["doc_id"], 60, 2)
    merges, freq, tokens = loop([atoms(s) for s in strings], 60, 2, "first")
    assert merges_of(got) == merges
    assert {r["token"]: r["freq"] for r in got.frequencies.collect()} == freq
    vocab = {r["token"]: r["id"] for r in got.vocab.collect()}
    assert vocab == {t: i for i, t in enumerate(P.SPECIAL_TOKENS + tokens)}


def test_as_run_allows_one_token_more(spark):
    df = table(spark, corpus(0))
    size = lambda t: t.frequencies.count()
    assert size(L.train_spe(df, "smi", ["doc_id"], 20, 2)) == 20
    assert size(L.train_spe(df, "smi", ["doc_id"], 20, 2, as_run=True)) == 21


def multiplier_of(token):
    return 1.5 if "=" in token else 1.2 if token.endswith("C") else 1.0


@pytest.mark.parametrize("seed,pairs", [(2, 64), (2, 2), (3, 64), (3, 5)])
def test_scored_pairs(spark, seed, pairs, monkeypatch):
    monkeypatch.setattr(L, "PAIRS_PER_ROUND", pairs)
    strings = corpus(seed)
    column = lambda t: F.when(t.contains("="), 1.5).when(t.endswith("C"), 1.2).otherwise(1.0)
    got = L.train_spe(
        table(spark, strings), "smi", ["doc_id"], 60, 2, multiplier=column, multipliers=(1.0, 1.5)
    )
    assert merges_of(got) == loop([atoms(s) for s in strings], 60, 2, "first", multiplier_of)[0]


def test_few_rounds_for_many_scored_pairs(spark, monkeypatch):
    """Thousands of distinct strings with close scores: few passes, and multipliers not asked for merge by merge."""
    strings = [s.replace("N", f"[{13 + i % 40}N]") for i, s in enumerate(corpus(7, 6_000))]
    rounds, asked = [], []
    best_pairs, table_of = L._best_pairs, L.small_table
    monkeypatch.setattr(L, "_best_pairs", lambda *a: rounds.append(1) or best_pairs(*a))
    monkeypatch.setattr(L, "small_table", lambda s, schema, rows: asked.append(schema) or table_of(s, schema, rows))
    column = lambda t: F.when(t.contains("="), 1.5).when(t.endswith("C"), 1.2).otherwise(1.0)
    got = L.train_spe(table(spark, strings), "smi", ["doc_id"], 150, 2, multiplier=column, multipliers=(1.0, 1.5))
    expected = loop([atoms(s) for s in strings], 150, 2, "first", multiplier_of)[0]
    assert merges_of(got) == expected
    assert len(rounds) <= 3 and asked.count("token string") <= len(expected) // 3


def test_pairs_scored_as_molecules(spark):
    strings = corpus(2)
    got = L.train_spe(
        table(spark, strings), "smi", ["doc_id"], 60, 2, multiplier=parsed_multiplier, multipliers=(1.0, 1.2)
    )
    scores = {"molecule": 1.2, "part": 1.1, "neither": 1.0}
    assert merges_of(got) == loop([atoms(s) for s in strings], 60, 2, "first", lambda t: scores[kind(t)])[0]


@pytest.mark.parametrize("pairs,runs", [(64, 4_000), (3, 4_000), (64, 40), (1, 4_000)])
@pytest.mark.parametrize("letters", ["ab", "abcdefgh"])
def test_runs_and_ties(spark, letters, pairs, runs, monkeypatch):
    """Repeated letters overlap themselves, few letters tie often. However few
    pairs a round looks at, the merges are the same."""
    monkeypatch.setattr(L, "MERGES_PER_STORE", 7)
    monkeypatch.setattr(L, "PAIRS_PER_ROUND", pairs)
    monkeypatch.setattr(L, "RUNS_PER_ROUND", runs)
    monkeypatch.setattr(L, "INDEX_PAIRS", max(pairs, 8))
    monkeypatch.setattr(L, "INDEX_RUNS", runs)
    monkeypatch.setattr("molcorpus.operators.pair_index.CHANGED_SHARE", 0.9 if pairs == 64 else 0.25)
    rng = random.Random(len(letters))
    strings = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 12))) for _ in range(120)]
    got = L.train_bpe(table(spark, strings), "smi", 60, 1, None)
    expected = loop([list(s) for s in strings], 60 - len(P.SPECIAL_TOKENS), 1, "id")[0]
    assert merges_of(got) == expected


def test_the_index_reads_touched_words_only(spark):
    """Counts stay those of counting again, and later rounds read a part of the words."""
    rng = random.Random(12)
    weights = [1 / (i + 1) for i in range(26)]
    strings = ["".join(rng.choices("etaoinshrdlcumwfgypbvkjxqz", weights, k=rng.randint(3, 9))) for _ in range(1500)]
    words = spark.createDataFrame([(w, n) for w, n in Counter(strings).items()], "w string, c bigint")
    index = PairIndex(words, L._merged, L._runs, 8, 4_000)
    current, made = [list(w) for w in strings], 0
    before = index.size
    for _ in range(12):
        pending, found = [], index.round()
        step = next(found, None)
        while step is not None:
            pair, n = step
            counted = Counter(p for w in current for p in zip(w, w[1:]))
            best = min(counted, key=lambda p: (-counted[p], p))
            assert (tuple(pair), n) == (best, counted[best])
            fused = chr(0x800 + made)
            made += 1
            pending.append((pair, fused))
            for w in current:
                i = 0
                while i < len(w) - 1:
                    if (w[i], w[i + 1]) == best:
                        w[i : i + 2] = [fused]
                    i += 1
            step = L._following(found, fused)
        index.apply(pending)
    assert made > 12 and index.read < 12 * before


def greedy(text, tokens):
    out, i = [], 0
    while i < len(text):
        hit = next((text[i:j] for j in range(len(text), i, -1) if text[i:j] in tokens), None)
        out.append(hit or "[UNK]")
        i += len(hit or "x")
    return out


def test_learned_tokens_are_matched(spark):
    """Text cut by learned tokens; ``CCl`` may well lose its ``l`` to ``CC``."""
    strings = corpus(4)
    tokens = L.vocabulary_list(L.train_spe(table(spark, strings), "smi", ["doc_id"], 60, 2).vocab)
    rows = table(spark, strings).select("smi", L.longest_match(F.col("smi"), tokens).alias("t"))
    assert all(r["t"] == greedy(r["smi"], set(tokens)) for r in rows.collect())


@pytest.mark.parametrize("pretokens", [tok_whitespace, None])
def test_bpe_against_a_library(spark, pretokens):
    tokenizers = pytest.importorskip("tokenizers")
    strings = corpus(5)
    specials = P.SPECIAL_TOKENS + ([P.START_TAG, P.END_TAG] if pretokens else [])
    theirs = tokenizers.Tokenizer(tokenizers.models.BPE())
    if pretokens:
        theirs.pre_tokenizer = tokenizers.pre_tokenizers.Whitespace()
    theirs.train_from_iterator(
        strings,
        tokenizers.trainers.BpeTrainer(
            vocab_size=90, min_frequency=2, special_tokens=specials, show_progress=False
        ),
    )
    model = json.loads(theirs.to_str())["model"]
    ours = L.train_bpe(table(spark, strings), "smi", 90, 2, pretokens)
    assert [list(m[:2]) for m in merges_of(ours)] == [list(m) for m in model["merges"]]
    assert {r["token"]: r["id"] for r in ours.vocab.collect()} == model["vocab"]
    fresh = [*corpus(6), "CCZZO", "", "ZZ"]  # Z is no letter of the training corpus
    coded = table(spark, fresh).select("doc_id", pair_merges(ours, pretokens)(F.col("smi")).alias("t"))
    got = {r["doc_id"]: r["t"] for r in coded.collect()}
    assert [got[i] for i in range(len(fresh))] == [theirs.encode(s).tokens for s in fresh]


def test_wordpiece_against_a_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    strings = ["CCO", "CCO", "CCN", "CC", "CCO", "CCNC", "CCN"]
    theirs = tokenizers.Tokenizer(tokenizers.models.WordPiece(unk_token="[UNK]"))
    theirs.pre_tokenizer = tokenizers.pre_tokenizers.Whitespace()
    theirs.train_from_iterator(
        strings,
        tokenizers.trainers.WordPieceTrainer(
            vocab_size=16, min_frequency=2, special_tokens=P.SPECIAL_TOKENS, show_progress=False
        ),
    )
    ours = L.train_wordpiece(table(spark, strings), "smi", 18, 2)
    tokens = set(L.vocabulary_list(ours.vocab)) - {P.START_TAG, P.END_TAG}
    assert tokens == set(theirs.get_vocab())
    fresh = [*strings, "CCOCCN CCX", "C" * 100, "C" * 101, "", "OCCO"]
    coded = table(spark, fresh).select(
        "doc_id", L.wordpiece(tok_whitespace(F.col("smi")), list(theirs.get_vocab())).alias("t")
    )
    got = {r["doc_id"]: r["t"] for r in coded.collect()}
    assert [got[i] for i in range(len(fresh))] == [theirs.encode(s).tokens for s in fresh]


def test_longest_match_against_a_loop(column):
    rng = random.Random(7)
    tokens = ["C", "CC", "CCO", "O", "(=", "=O)", "[Na+]", "[UNK]", ".", "c1ccc"]
    strings = ["".join(rng.choice(["C", "O", "(", "=", ")", "[Na+]", "x", ".", "c1"]) for _ in range(12)) for _ in range(60)]

    assert column(strings, L.longest_match(F.col("s"), tokens)) == [greedy(s, tokens) for s in strings]


def test_structural_multiplier(column):
    scores = {
        "C(=O)O": 1.2, "c1ccccc1": 1.2, "OH": 1.1, "cc": 1.1, ")O": 1.0, "c1ccccc": 1.0, "C((": 1.0,
        "CCl": 1.2, "[Na+]": 1.2, "C=": 1.0, "C%12CC%12": 1.2, "C%12CC%13": 1.0, "C()C": 1.0, "SiC": 1.1,
    }
    assert column(list(scores), L.structural_multiplier(F.col("s"))) == list(scores.values())


@pytest.mark.parametrize(
    "name", ["bpe", "character", "element", "kmer", "manual_spe", "scored_spe", "spe", "swp", "wordpiece"]
)
def test_build(spark, name):
    """Each tokenizer knows all it was built from."""
    df = table(spark, corpus(8, 60))
    tokenizer, vocab = build(name, df, "smi", ["doc_id"], 60)
    coded = df.select("doc_id", "smi", tokenizer(F.col("smi")).alias("tokens"))
    ids = V.encode(coded, "tokens", vocab, ["doc_id"]).collect()
    known = {r["token"] for r in vocab.collect()}
    assert known >= set(P.SPECIAL_TOKENS) and len(known) == vocab.count()
    for row in ids:
        assert row["tokens"] and len(row["ids"]) == len(row["tokens"])
        if name not in ("kmer", "manual_spe", "scored_spe"):
            assert set(row["tokens"]) <= known
        if name in ("bpe", "character", "spe"):
            assert "".join(row["tokens"]) == row["smi"]


def test_build_of_an_unknown_name(spark):
    with pytest.raises(ValueError, match="unknown tokenizer"):
        build("other", table(spark, ["C"]), "smi", ["doc_id"])


def test_a_doubled_symbol_with_many_runs(spark, monkeypatch):
    """One pair alone can have more stretches than may reach the driver."""
    strings = ["a" * n for n in range(2, 40)]
    expected = loop([list(s) for s in strings], 60 - len(P.SPECIAL_TOKENS), 1, "id")[0]
    assert expected[0][3] == 741
    monkeypatch.setattr(L, "RUNS_PER_ROUND", 5)
    monkeypatch.setattr(L, "INDEX_RUNS", 5)
    assert merges_of(L.train_bpe(table(spark, strings), "smi", 60, 1, None)) == expected
    first = L.train_spe(table(spark, [s.upper().replace("A", "C") for s in strings]), "smi", ["doc_id"], 60, 1)
    assert merges_of(first)[0][:2] == ("C", "C") and merges_of(first)[0][3] == 741
    bonus = L.train_spe(
        table(spark, [s.upper().replace("A", "C") for s in strings]), "smi", ["doc_id"], 20, 1,
        multiplier=lambda t: F.lit(1.0), multipliers=(1.0, 1.0),
    )
    assert merges_of(bonus)[:3] == merges_of(first)[:3]


def test_text_keys(spark):
    strings = corpus(5)
    numbered = table(spark, strings)
    texts = numbered.withColumn("id", F.format_string("<urn:%06d>", "doc_id"))
    by_number = L.train_spe(numbered, "smi", ["doc_id"], 60, 2)
    by_text = L.train_spe(texts, "smi", ["id"], 60, 2)
    assert merges_of(by_text) == merges_of(by_number)
    assert {tuple(r) for r in by_text.frequencies.collect()} == {tuple(r) for r in by_number.frequencies.collect()}


@pytest.mark.parametrize("longest", [100, 5])
def test_many_merges_are_made_in_turn(spark, longest, monkeypatch):
    """Also where a pair is made again, comes from an earlier token, or overlaps itself."""
    monkeypatch.setattr(L, "LONGEST_WORD", longest)
    rng = random.Random(3)
    letters = [L._private(i) for i in range(6)]
    merges = [(rng.choice(letters) + rng.choice(letters), rng.choice([L._private(6 + i), *letters])) for i in range(200)]
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 30))) for _ in range(200)] + [letters[0] * 40]
    want = []
    for word in words:
        for pair, fused in merges:
            word = word.replace(pair, fused)
        want.append(word)
    df = spark.createDataFrame(list(enumerate(words)), "i int, w string")
    done = L._merged(df, merges)
    assert "aggregate(" not in done._jdf.queryExecution().optimizedPlan().toString()
    assert [r["w"] for r in done.orderBy("i").collect()] == want
