"""Queries on vocabularies: building, merging, encoding and decoding."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from molcorpus.functions import patterns as P
from molcorpus.functions.tokenizers import TOKENIZERS, tok_whitespace
from molcorpus.operators import vocab as V
from molcorpus.operators.annotate import split_words
from molcorpus.plans.detection import SEGMENTS_CTE, segments, words_cte
from molcorpus.plans.registry import literal, query
from molcorpus.plans.tokenization import SIMPLE_SQL
from molcorpus.session import scratch_folder, small_table, stored
from molcorpus.sources.files import load_vocab, save_vocab
from molcorpus.sources.samples import ANNOTATED_SQL, annotated, prose, table

BASE_SIZE = 2000
KMER_SIZE = 20_000
KEYS = ["doc_id", "seg"]
ORDER = ["doc_id", "seg", "pos"]

# --- SQL side ------------------------------------------------------------------

SPECIALS_SQL = " UNION ALL ".join(
    f"SELECT '{t}' AS token, {i}::BIGINT AS id" for i, t in enumerate(P.SPECIAL_TOKENS)
)


def tokens_cte(name: str, expression: str, relation: str = "segments", keys: str = "doc_id, seg") -> str:
    return f"""{name} AS (SELECT {keys}, unnest(range(len(t))) AS pos, unnest(t) AS token
      FROM (SELECT {keys}, {expression} AS t FROM {relation}))"""


def first_seen_cte(name: str, tokens: str, where: str = "true") -> str:
    return f"""{name}_first AS (SELECT token, min((doc_id, seg, pos)) AS first FROM {tokens}
      WHERE {where} GROUP BY token),
    {name} AS ({SPECIALS_SQL} UNION ALL
      SELECT token, row_number() OVER (ORDER BY first) + 3 AS id FROM {name}_first)"""


def topk_cte(name: str, tokens: str, order: str, size: int) -> str:
    return f"""{name}_top AS (SELECT token, count(*) AS freq, min({order}) AS first FROM {tokens}
      GROUP BY token ORDER BY freq DESC, first LIMIT {size - 4}),
    {name} AS ({SPECIALS_SQL} UNION ALL
      SELECT token, row_number() OVER (ORDER BY freq DESC, first) + 3 AS id FROM {name}_top)"""


ELEMENT_TOKENS = f"WITH {ANNOTATED_SQL}, {SEGMENTS_CTE}, {tokens_cte('tokens', SIMPLE_SQL['element'])}"
_FIRST_SOURCE = "doc_id IN (SELECT doc_id FROM documents WHERE source = 'src0')"
_SMALL = first_seen_cte("small", "tokens", _FIRST_SOURCE)
_CHEM = first_seen_cte("chem", "tokens")

# Base vocabulary: the most frequent words of the whole prose, then the two tags.
BASE_CTE = f"""base_words AS (SELECT doc_id, unnest(range(len(t))) AS pos, unnest(t) AS token
  FROM (SELECT doc_id, regexp_extract_all(text, {literal(P.WORD_TOKEN_RE2)}) AS t FROM documents)),
{topk_cte('plain_base', 'base_words', '(doc_id, pos)', BASE_SIZE)},
base AS (SELECT token, id FROM plain_base
  UNION ALL SELECT '[START_SMILES]', (SELECT max(id) + 1 FROM plain_base)
  UNION ALL SELECT '[END_SMILES]', (SELECT max(id) + 2 FROM plain_base))"""

HYBRID_CTE = f"""{_CHEM},
hybrid_ids AS (SELECT token, id AS chem_id,
    (SELECT max(id) FROM base) + row_number() OVER (ORDER BY id) AS hybrid_id FROM chem),
hybrid AS (SELECT token, id FROM base UNION ALL
  SELECT token, hybrid_id FROM hybrid_ids WHERE token NOT IN (SELECT token FROM base))"""

_HYBRID = f"{ELEMENT_TOKENS}, {BASE_CTE}, {HYBRID_CTE}"

# --- Spark side ------------------------------------------------------------------


def segment_tokens(spark: SparkSession, sf_dir: str, tokenizer: str) -> DataFrame:
    tokens = TOKENIZERS[tokenizer](F.col("smi"))
    return segments(spark, sf_dir).select("doc_id", "seg", "smi", tokens.alias("tokens"))


def token_rows(spark: SparkSession, sf_dir: str, tokenizer: str) -> DataFrame:
    return V.token_rows(segment_tokens(spark, sf_dir, tokenizer), KEYS, "tokens")


@stored
def chem_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.first_seen_vocab(token_rows(spark, sf_dir, "element"), ORDER)


def small_vocab(spark: SparkSession, sf_dir: str, tokenizer: str = "element") -> DataFrame:
    """Vocabulary of one source only, so that other sources hold unknown tokens."""
    one = table(spark, sf_dir, "documents").filter("source = 'src0'").select("doc_id")
    tokens = token_rows(spark, sf_dir, tokenizer).join(one, "doc_id", "left_semi")
    return V.first_seen_vocab(tokens, ORDER)


@stored
def base_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = prose(spark, sf_dir).select(
        "doc_id", F.posexplode(tok_whitespace(F.col("text"))).alias("pos", "token")
    )
    plain = V.topk_vocab(words, ["doc_id", "pos"], BASE_SIZE)
    size = plain.agg(F.max("id")).first()[0]
    tags = [(P.START_TAG, size + 1), (P.END_TAG, size + 2)]
    return plain.unionByName(small_table(spark, "token string, id bigint", tags))


@query(f"{ELEMENT_TOKENS}, {_CHEM} SELECT token, id FROM chem")
def vocab_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chem_vocab(spark, sf_dir)


@query(
    f"""{ELEMENT_TOKENS}, {_SMALL},
    unseen AS (SELECT token, min((doc_id, seg, pos)) AS first FROM tokens
      WHERE token NOT IN (SELECT token FROM small) GROUP BY token)
    SELECT token, id FROM small UNION ALL
    SELECT token, (SELECT max(id) FROM small) + row_number() OVER (ORDER BY first) FROM unseen"""
)
def vocab_extend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.extend_vocab(
        small_vocab(spark, sf_dir), token_rows(spark, sf_dir, "element"), ORDER
    )


@query(
    f"""WITH {ANNOTATED_SQL}, {SEGMENTS_CTE}, {tokens_cte('tokens', SIMPLE_SQL['kmer'])},
    {topk_cte('kmers', 'tokens', '(doc_id, seg, pos)', KMER_SIZE)} SELECT token, id FROM kmers"""
)
def vocab_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.topk_vocab(token_rows(spark, sf_dir, "kmer"), ORDER, KMER_SIZE)


_SHAPES = {
    "unk_absent_zero_taken": ("token <> '[UNK]'", "id - 1"),
    "unk_absent_zero_free": ("token <> '[UNK]'", "id"),
    "unk_elsewhere": ("true", "CASE WHEN token = '[UNK]' THEN 7 WHEN id <= 7 THEN id - 1 ELSE id END"),
    "unk_at_zero": ("true", "id"),
}
_NORMALISED_SQL = " UNION ALL ".join(
    f"SELECT '{name}' AS shape, token, CASE WHEN token = '[UNK]' THEN 0 ELSE id + {shift} END AS id "
    f"FROM (SELECT token, {ids} AS id FROM chem WHERE {where} "
    f"{'' if where == 'true' else chr(10) + 'UNION ALL SELECT ' + chr(39) + '[UNK]' + chr(39) + ', 0'})"
    for (name, (where, ids)), shift in zip(_SHAPES.items(), (1, 0, 1, 0))
)


@query(f"{ELEMENT_TOKENS}, {_CHEM} {_NORMALISED_SQL}")
def vocab_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The element vocabulary with its unknown token missing or misplaced."""
    vocab = chem_vocab(spark, sf_dir)
    parts = [
        V.normalise_vocab(
            vocab.filter(where).select("token", F.expr(ids).cast("bigint").alias("id"))
        ).withColumn("shape", F.lit(name))
        for name, (where, ids) in _SHAPES.items()
    ]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


@query(
    f"""{ELEMENT_TOKENS}, {_CHEM},
    {tokens_cte('letters', SIMPLE_SQL['character'])}, {first_seen_cte('own', 'letters')},
    merged AS (SELECT token, id FROM chem UNION ALL
      SELECT token, id FROM own WHERE token NOT IN (SELECT token FROM chem))
    SELECT token, id, count(*) OVER (PARTITION BY id) > 1 AS id_collision FROM merged"""
)
def vocab_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = V.first_seen_vocab(token_rows(spark, sf_dir, "character"), ORDER)
    return V.merge_vocab(chem_vocab(spark, sf_dir), own)


@query(f"{ELEMENT_TOKENS}, {_CHEM} SELECT id, token FROM chem")
def vocab_invert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.invert_vocab(chem_vocab(spark, sf_dir))


@query(f"{_HYBRID} SELECT token, id FROM hybrid")
def hybrid_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.hybrid_vocab(base_vocab(spark, sf_dir), chem_vocab(spark, sf_dir))


# A row after all others, with tokens that the vocabulary of the segments lacks.
UNKNOWN = (-1, 0, "[Xe]CC[Rn]")
_ELEMENT_SQL = SIMPLE_SQL["element"]
_ENCODED = f"""{ELEMENT_TOKENS}, {_CHEM},
texts AS (SELECT doc_id, seg, smi FROM segments UNION ALL SELECT {UNKNOWN[0]}, {UNKNOWN[1]}, '{UNKNOWN[2]}'),
{tokens_cte('every_token', _ELEMENT_SQL, 'texts')},
coded AS (SELECT t.doc_id, t.seg, t.pos, coalesce(v.id, 0) AS id
  FROM every_token t LEFT JOIN chem v USING (token))"""


def _encoded(spark: SparkSession, sf_dir: str, vocab: DataFrame) -> DataFrame:
    rows = segments(spark, sf_dir).select("doc_id", "seg", "smi")
    fixture = small_table(spark, "doc_id bigint, seg bigint, smi string", [UNKNOWN])
    texts = rows.unionByName(fixture.withColumn("seg", F.col("seg").cast(rows.schema["seg"].dataType)))
    tokens = texts.select("doc_id", "seg", TOKENIZERS["element"](F.col("smi")).alias("tokens"))
    return V.encode(tokens, "tokens", vocab, KEYS)


def _shown(df: DataFrame, ids: Column) -> DataFrame:
    return df.select("doc_id", F.col("seg").cast("bigint").alias("seg"), ids)


@query(
    f"""{_ENCODED} SELECT s.doc_id, s.seg, coalesce(ids, '') AS ids FROM texts s LEFT JOIN (
      SELECT doc_id, seg, string_agg(id::VARCHAR, ' ' ORDER BY pos) AS ids FROM coded GROUP BY ALL)
    USING (doc_id, seg)"""
)
def encode_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = _encoded(spark, sf_dir, chem_vocab(spark, sf_dir))
    return _shown(encoded, F.array_join("ids", " ").alias("ids"))


@query(
    f"""{_ENCODED} SELECT s.doc_id, s.seg, coalesce(text, '') AS text FROM texts s LEFT JOIN (
      SELECT doc_id, seg, string_agg(v.token, '' ORDER BY pos) AS text
      FROM coded JOIN chem v USING (id) GROUP BY ALL)
    USING (doc_id, seg)"""
)
def decode_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocab = chem_vocab(spark, sf_dir)
    decoded = V.decode(_encoded(spark, sf_dir, vocab), "ids", vocab, KEYS)
    return _shown(decoded, F.col("text"))


# Words of the tagged texts, tags and SMILES tokens among them.
_ALL_TOKENS = f"""{_HYBRID}, {words_cte('annotated', 'text_tags')},
every AS (SELECT word AS token FROM words UNION ALL SELECT token FROM tokens
  UNION ALL SELECT unnest(['[START_SMILES]', '[END_SMILES]', '[UNK]'])),
counted AS (SELECT token, count(*) AS n FROM every GROUP BY token)"""


def _all_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = split_words(annotated(spark, sf_dir), "doc_id", "text_tags")
    marks = small_table(spark, "token string", [(P.START_TAG,), (P.END_TAG,), (V.UNK,)])
    every = (
        words.select(F.col("word").alias("token"))
        .unionByName(token_rows(spark, sf_dir, "element").select("token"))
        .unionByName(marks)
    )
    return every.groupBy("token").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""{_ALL_TOKENS} SELECT c.token, c.n, coalesce(b.id, h.hybrid_id,
      (SELECT hybrid_id FROM hybrid_ids WHERE token = '[UNK]')) AS id
    FROM counted c LEFT JOIN (SELECT * FROM base WHERE id <> 0) b USING (token)
    LEFT JOIN hybrid_ids h USING (token)"""
)
def hybrid_encode_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Id of every distinct token of the tagged texts."""
    return V.hybrid_encode_token(
        _all_tokens(spark, sf_dir), base_vocab(spark, sf_dir), chem_vocab(spark, sf_dir)
    )


@query(
    f"""{_HYBRID}, ids AS (SELECT id FROM base UNION SELECT hybrid_id FROM hybrid_ids)
    SELECT id, coalesce(h.token, b.token) AS token,
      CASE WHEN b.token IN ('[START_SMILES]', '[END_SMILES]') THEN ''
           ELSE coalesce(h.token, b.token) END AS skipped
    FROM ids LEFT JOIN hybrid_ids h ON id = h.hybrid_id LEFT JOIN base b USING (id)"""
)
def hybrid_decode_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, chem = base_vocab(spark, sf_dir), chem_vocab(spark, sf_dir)
    ids = base.select("id").unionByName(
        V.hybrid_ids(base, chem).select(F.col("hybrid_id").alias("id"))
    )
    plain = V.hybrid_decode_token(ids, base, chem)
    skipped = V.hybrid_decode_token(ids, base, chem, skip_special=True)
    return plain.join(skipped.withColumnRenamed("token", "skipped"), "id")


@query(
    f"""{ELEMENT_TOKENS}, back AS (SELECT doc_id, seg, string_agg(token, '' ORDER BY pos) AS text
      FROM tokens GROUP BY ALL)
    SELECT count(*) AS n_texts, count(*) FILTER (WHERE coalesce(text, '') = smi) AS n_equal,
      round(count(*) FILTER (WHERE coalesce(text, '') = smi) / count(*), 9) AS rate,
      0::BIGINT AS n_vocab_changed
    FROM segments LEFT JOIN back USING (doc_id, seg)"""
)
def roundtrip_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Element tokens lose what their grammar does not know; the report says how
    many SMILES come back whole after saving and loading the vocabulary."""
    vocab = chem_vocab(spark, sf_dir)
    path = f"{scratch_folder(spark)}/vocab-{uuid.uuid4().hex}"
    save_vocab(vocab, path)
    tokens = segment_tokens(spark, sf_dir, "element")
    return V.roundtrip_report(tokens, "smi", "tokens", vocab, load_vocab(spark, path), KEYS)
