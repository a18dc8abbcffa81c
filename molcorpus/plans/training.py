"""Queries on learned tokenizers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from molcorpus.functions import patterns as P
from molcorpus.functions.molecule import parsed_multiplier
from molcorpus.functions.text import entries
from molcorpus.functions.tokenizers import tok_atomwise, tok_whitespace
from molcorpus.operators import evaluate as E
from molcorpus.operators import hybrid as H
from molcorpus.operators import learned as L
from molcorpus.operators.tokenizer import build, longest, pair_merges, pieces
from molcorpus.plans import training_sql as Q
from molcorpus.plans.detection import SEGMENTS_CTE, segments
from molcorpus.plans.encoding import PIECES_CTE, base_list
from molcorpus.plans.registry import query
from molcorpus.plans.tokenization import SIMPLE_SQL, stats_sql
from molcorpus.plans.vocabulary import BASE_CTE, base_vocab
from molcorpus.sources.samples import ANNOTATED_SQL, annotated

# Sizes that the minimum frequency ends long before.
SIZE, SCORED_SIZE = 20_000, 2_000
MIN_FREQ = 2
# Multipliers of the scored pair encoder.
BASE, PATTERN, VALID = 1.0, 1.2, 1.5
ORDER = ["doc_id", "seg"]

# --- SQL side ------------------------------------------------------------------

_WORD_SPECIALS = [*P.SPECIAL_TOKENS, P.START_TAG, P.END_TAG]
_WORDS = f"WITH RECURSIVE {ANNOTATED_SQL}, {SEGMENTS_CTE}, {Q.SEGMENT_TOKENS}"
_SMILES = f"WITH RECURSIVE {ANNOTATED_SQL}, {SEGMENTS_CTE}, {Q.SEGMENT_WORDS}"
_BPE = Q.training_cte("bpe", "characters", SIZE, MIN_FREQ, _WORD_SPECIALS)
_PIECES = Q.training_cte("wp", "continued", SIZE, MIN_FREQ, _WORD_SPECIALS)
_SPE = Q.training_cte("spe", "characters", SIZE, MIN_FREQ)
_SWP = Q.training_cte("swp", "continued", SIZE, MIN_FREQ)
_ATOMS = Q.training_cte(
    "atoms", "atoms", SIZE, MIN_FREQ, count_specials=False, first_ties=True
)
_SCORED = Q.training_cte(
    "scored", "atoms", SCORED_SIZE, MIN_FREQ, count_specials=False, first_ties=True,
    multiplier=Q.multiplier_sql("tok", BASE, PATTERN, VALID),
)


def _merges_sql(name: str) -> str:
    return f'SELECT rank, "left", "right", token, freq FROM {name}_merges'


def _texts_sql(pieces: str) -> str:
    return f"""SELECT s.doc_id, s.seg, coalesce(tokens, '') AS tokens FROM segments s LEFT JOIN (
      SELECT doc_id, seg, string_agg(p.token, ' ' ORDER BY t.pos, p.pos) AS tokens
      FROM segment_tokens t JOIN {pieces} p USING (word) GROUP BY doc_id, seg) USING (doc_id, seg)"""


# --- Spark side ------------------------------------------------------------------


def word_bpe(spark: SparkSession, sf_dir: str) -> L.Trained:
    return L.train_bpe(segments(spark, sf_dir), "smi", SIZE, MIN_FREQ)


def word_pieces(spark: SparkSession, sf_dir: str) -> L.Trained:
    return L.train_wordpiece(segments(spark, sf_dir), "smi", SIZE, MIN_FREQ)


def _coded(spark: SparkSession, sf_dir: str, tokenize) -> DataFrame:
    return segments(spark, sf_dir).select(
        "doc_id",
        F.col("seg").cast("bigint").alias("seg"),
        F.array_join(tokenize(F.col("smi")), " ").alias("tokens"),
    )


def smiles_bpe(spark: SparkSession, sf_dir: str) -> L.Trained:
    return L.train_bpe(segments(spark, sf_dir), "smi", SIZE, MIN_FREQ, None)


def smiles_pieces(spark: SparkSession, sf_dir: str) -> L.Trained:
    return L.train_wordpiece(segments(spark, sf_dir), "smi", SIZE, MIN_FREQ, None)


def atom_pairs(spark: SparkSession, sf_dir: str) -> L.Trained:
    return L.train_spe(segments(spark, sf_dir), "smi", ORDER, SIZE, MIN_FREQ)


def scored_pairs(spark: SparkSession, sf_dir: str) -> L.Trained:
    return L.train_spe(
        segments(spark, sf_dir), "smi", ORDER, SCORED_SIZE, MIN_FREQ,
        multiplier=_multiplier, multipliers=(BASE, VALID),
    )


def _multiplier(token: Column) -> Column:
    return L.structural_multiplier(token, BASE, PATTERN, VALID)


@query(f"{_WORDS}, {_BPE} {_merges_sql('bpe')}")
def bpe_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_bpe(spark, sf_dir).merges


@query(f"{_WORDS}, {_BPE}, {Q.merged_cte('bpe')} {_texts_sql('bpe_pieces')}")
def bpe_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _coded(spark, sf_dir, pair_merges(word_bpe(spark, sf_dir), tok_whitespace))


@query(f"{_WORDS}, {_PIECES} SELECT token, id FROM wp_vocab")
def wordpiece_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_pieces(spark, sf_dir).vocab


@query(f"{_WORDS}, {_PIECES}, {Q.wordpiece_cte('cut', 'wp_vocab')} {_texts_sql('cut_pieces')}")
def wordpiece_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _coded(spark, sf_dir, pieces(word_pieces(spark, sf_dir).vocab, tok_whitespace))


@query(f"{_SMILES}, {_SPE} {_merges_sql('spe')}")
def spe_char_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return smiles_bpe(spark, sf_dir).merges


@query(f"{_SMILES}, {_SWP} SELECT token, id FROM swp_vocab")
def swp_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return smiles_pieces(spark, sf_dir).vocab


@query(f"{_SMILES}, {_ATOMS} {_merges_sql('atoms')}")
def spe_atom_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return atom_pairs(spark, sf_dir).merges


@query(f"{_SMILES}, {_SCORED} {_merges_sql('scored')}")
def spe_scored_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored_pairs(spark, sf_dir).merges


@query(f"{_SMILES}, {_ATOMS} SELECT token, freq FROM atoms_frequencies")
def spe_token_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return atom_pairs(spark, sf_dir).frequencies


@query(
    f"""{_SMILES}, {_ATOMS}, {Q.longest_match_cte('cut', 'atoms_vocab')}
    SELECT doc_id, segments.seg, string_agg(token, ' ' ORDER BY pos) AS tokens
    FROM segments JOIN cut_pieces ON word = smi GROUP BY doc_id, segments.seg"""
)
def tok_longest_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments through the learned atom-pair vocabulary."""
    return _coded(spark, sf_dir, longest(atom_pairs(spark, sf_dir).vocab))


@query(
    f"""{_SMILES}, {_SPE}, {_SWP}, {_ATOMS}, {_SCORED}, {Q.merged_cte('spe')},
    {Q.wordpiece_cte('swp_cut', 'swp_vocab')}, {Q.longest_match_cte('atoms_cut', 'atoms_vocab')},
    {Q.longest_match_cte('scored_cut', 'scored_vocab')},
    sizes AS (
      SELECT 'spe' AS tokenizer, word, count(*) AS n FROM spe_pieces GROUP BY word
      UNION ALL SELECT 'swp', word, count(*) FROM swp_cut_pieces GROUP BY word
      UNION ALL SELECT 'manual_spe', word, count(*) FROM atoms_cut_pieces GROUP BY word
      UNION ALL SELECT 'scored_spe', word, count(*) FROM scored_cut_pieces GROUP BY word),
    counts AS (SELECT tokenizer, n FROM segments JOIN sizes ON word = smi) {stats_sql('tokenizer')}"""
)
def fertility_learned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All learned tokenizers on the SMILES they were trained on."""
    tokenizers = {
        "spe": pair_merges(smiles_bpe(spark, sf_dir), None),
        "swp": pieces(smiles_pieces(spark, sf_dir).vocab, None),
        "manual_spe": longest(atom_pairs(spark, sf_dir).vocab),
        "scored_spe": longest(scored_pairs(spark, sf_dir).vocab),
    }
    coded = segments(spark, sf_dir).select(
        *[tokenize(F.col("smi")).alias(name) for name, tokenize in tokenizers.items()]
    )
    return E.fertility(coded, {name: F.size(name) for name in tokenizers})


# The tokenizers of a comparison, by name and kind; the base one cuts words.
REGISTRY = [
    ("Base", "whitespace"), ("Character", "character"), ("Element", "element"), ("BPE", "bpe"),
    ("WordPiece", "wordpiece"), ("SMILES Pair Encoding", "spe"), ("Scored SPE", "scored_spe"),
    ("4-mer", "kmer"), ("SMILES WordPiece", "swp"),
]
_WORD_TABLES = Q.SEGMENT_TOKENS.replace("words AS", "cut_words AS")
_BY_WORDS = "SELECT '{}' AS tokenizer, (SELECT count(*) FROM segment_tokens t JOIN {} p ON p.word = t.word WHERE t.doc_id = s.doc_id AND t.seg = s.seg) AS n FROM segments s"
_NAMED = " UNION ALL ".join(
    _BY_WORDS.format(name, {"bpe": "bpe_pieces", "wordpiece": "wp_cut_pieces"}[kind]) if kind in ("bpe", "wordpiece")
    else f"SELECT '{name}' AS tokenizer, len({SIMPLE_SQL[kind]}) AS n FROM segments" if kind in SIMPLE_SQL
    else f"SELECT '{name}' AS tokenizer, n FROM segments JOIN (SELECT word, count(*) AS n FROM {table} GROUP BY word) ON word = smi"
    for name, kind in REGISTRY
    for table in [{"spe": "spe_pieces", "swp": "swp_cut_pieces", "scored_spe": "scored_cut_pieces"}.get(kind)]
)


def _over(cte: str) -> str:
    """The same CTEs over the words inside the SMILES."""
    return cte.replace("FROM words", "FROM cut_words")


@query(
    f"""{_SMILES}, {_WORD_TABLES}, {_over(_BPE)}, {_over(_PIECES)}, {_SPE}, {_SWP}, {_SCORED},
    {Q.merged_cte('bpe')}, {_over(Q.wordpiece_cte('wp_cut', 'wp_vocab'))}, {Q.merged_cte('spe')},
    {Q.wordpiece_cte('swp_cut', 'swp_vocab')}, {Q.longest_match_cte('scored_cut', 'scored_vocab')},
    counts AS ({_NAMED}) {stats_sql('tokenizer')}"""
)
def fertility_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tokenizer of the registry, learned ones trained on the segments."""
    rows = segments(spark, sf_dir)
    tokenizers = {
        name: build(kind, rows, "smi", ORDER, SCORED_SIZE if kind == "scored_spe" else SIZE, MIN_FREQ, _multiplier, (BASE, VALID))[0]
        for name, kind in REGISTRY
    }
    coded = rows.select(*[tokenize(F.col("smi")).alias(name) for name, tokenize in tokenizers.items()])
    return E.fertility(coded, {name: F.size(F.col(f"`{name}`")) for name in tokenizers})


_MULTIPLIER = Q.multiplier_sql("tok", BASE, PATTERN, VALID)


@query(
    f"""WITH {ANNOTATED_SQL}, {SEGMENTS_CTE},
    atoms AS (SELECT smi, {Q.SPELLINGS['atoms'].replace('word', 'smi')} AS a FROM segments),
    toks AS (SELECT smi AS tok FROM segments
      UNION ALL SELECT unnest(list_transform(range(1, len(a)), lambda i: concat(a[i], a[i + 1]))) FROM atoms)
    SELECT tok AS token, count(*) AS n, any_value({_MULTIPLIER}) AS multiplier FROM toks GROUP BY tok"""
)
def merge_multiplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structural bonus of every SMILES and of every pair of neighbouring atoms."""
    rows = segments(spark, sf_dir).withColumn("a", tok_atomwise(F.col("smi")))
    placed = entries(rows, ["a"], "a", "pos", "atom")
    following = F.get("a", F.col("pos") + 1)
    pairs = placed.select(F.concat("atom", following).alias("token")).filter("token IS NOT NULL")
    tokens = rows.select(F.col("smi").alias("token")).unionByName(pairs)
    distinct = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    return distinct.withColumn("multiplier", _multiplier(F.col("token")))


@query()
def merge_multiplier_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same tokens read as molecules, with valences and Kekulé forms."""
    tokens = merge_multiplier(spark, sf_dir).select("token", "n")
    return tokens.withColumn("multiplier", parsed_multiplier(F.col("token"), BASE, PATTERN, VALID))


@query()
def spe_parsed_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored pair encoding whose merged tokens are read as molecules."""
    trained = L.train_spe(
        segments(spark, sf_dir), "smi", ORDER, SCORED_SIZE, MIN_FREQ,
        multiplier=lambda token: parsed_multiplier(token, BASE, PATTERN, VALID), multipliers=(BASE, VALID),
    )
    return trained.merges


@query(
    f"""{_SMILES}, {_SPE}, {Q.merged_cte('spe')}, {BASE_CTE}, {PIECES_CTE},
    chem_ids AS (SELECT token, (SELECT max(id) FROM base) + row_number() OVER (ORDER BY id) AS id FROM spe_vocab),
    chem_words AS (SELECT doc_id, seg, trim(substr(piece, 15, length(piece) - 26)) AS word
      FROM kinds WHERE is_chem),
    flat AS (
      SELECT doc_id, seg, 1 + pos AS pos, c.id FROM chem_words JOIN spe_pieces USING (word)
        JOIN chem_ids c USING (token)
      UNION ALL SELECT doc_id, seg, 0, b.id FROM chem_words, base b WHERE b.token = '[START_SMILES]'
      UNION ALL SELECT doc_id, seg, 1000000, b.id FROM chem_words, base b WHERE b.token = '[END_SMILES]'
      UNION ALL SELECT doc_id, seg, pos, coalesce(b.id, 0) FROM (
        SELECT doc_id, seg, unnest(range(len(t))) AS pos, unnest(t) AS token FROM (
          SELECT doc_id, seg, {base_list('piece')} AS t FROM kinds WHERE NOT is_chem)) LEFT JOIN base b USING (token))
    SELECT doc_id, string_agg(id::VARCHAR, ' ' ORDER BY seg, pos) AS ids FROM flat GROUP BY doc_id"""
)
def hybrid_encode_learned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tagged SMILES through a learned chemical tokenizer."""
    trained = smiles_bpe(spark, sf_dir)
    texts = annotated(spark, sf_dir).select("doc_id", "text_tags")
    coded = H.hybrid_encode(
        texts, "text_tags", base_vocab(spark, sf_dir), trained.vocab, ["doc_id"], pair_merges(trained, None)
    )
    return coded.select("doc_id", F.array_join("ids", " ").alias("ids"))
