"""Queries on mixed text-and-SMILES encoding and token windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from molcorpus.functions import patterns as P
from molcorpus.operators import hybrid as H
from molcorpus.operators import windows as W
from molcorpus.plans.registry import literal, query
from molcorpus.plans.tokenization import SIMPLE_SQL
from molcorpus.plans.vocabulary import ELEMENT_TOKENS, BASE_CTE, HYBRID_CTE, base_vocab, chem_vocab
from molcorpus.session import materialize
from molcorpus.sources.samples import ANNOTATED_SQL, annotated

MAX_LENGTH, STRIDE = 4096, 1024
BATCH, PAD = 32, 1
TRUNCATED = 2048
BLOCK = MAX_LENGTH

# --- SQL side ------------------------------------------------------------------

PIECES_CTE = f"""split_pieces AS (SELECT doc_id, list_filter(string_split(regexp_replace(text_tags,
    {literal(P.TAGGED_SPLIT)}, concat(chr(1), '\\1', chr(1)), 'g'), chr(1)), lambda x: x <> '') AS p
  FROM annotated),
pieces AS (SELECT doc_id, unnest(range(len(p))) AS seg, unnest(p) AS piece FROM split_pieces),
kinds AS (SELECT *, prefix(piece, '[START_SMILES]') AND suffix(piece, '[END_SMILES]') AS is_chem FROM pieces)"""

_TAG_WORDS = rf"\[START_SMILES\]|\[END_SMILES\]|{P.WORD_TOKEN_RE2}"


def base_list(col: str) -> str:
    spaced = (
        f"replace(replace({col}, '[START_SMILES]', ' [START_SMILES] '), "
        "'[END_SMILES]', ' [END_SMILES] ')"
    )
    return f"regexp_extract_all({spaced}, {literal(_TAG_WORDS)})"


_CHEM_LIST = SIMPLE_SQL["element"].replace("smi", "substr(piece, 15, length(piece) - 26)")
IDS_CTE = f"""piece_tokens AS (
  SELECT doc_id, seg, is_chem, CASE WHEN is_chem THEN
    list_concat(['[START_SMILES]'], {_CHEM_LIST}, ['[END_SMILES]']) ELSE {base_list('piece')} END AS t
  FROM kinds),
flat AS (SELECT doc_id, seg, is_chem, len(t) AS n, unnest(range(len(t))) AS pos, unnest(t) AS token
  FROM piece_tokens),
coded AS (SELECT doc_id, seg, pos,
    CASE WHEN is_chem AND pos > 0 AND pos < n - 1
      THEN coalesce(h.hybrid_id, (SELECT hybrid_id FROM hybrid_ids WHERE token = '[UNK]'))
      ELSE coalesce(b.id, 0) END AS id
  FROM flat f LEFT JOIN base b ON b.token = f.token LEFT JOIN hybrid_ids h ON h.token = f.token),
encoded AS (SELECT doc_id, coalesce(ids, []) AS ids FROM annotated LEFT JOIN
  (SELECT doc_id, list(id ORDER BY seg, pos) AS ids FROM coded GROUP BY doc_id) USING (doc_id))"""

_ENCODED = f"{ELEMENT_TOKENS}, {BASE_CTE}, {HYBRID_CTE}, {PIECES_CTE}, {IDS_CTE}"


def _joined(col: str = "ids") -> str:
    return f"array_to_string({col}, ' ')"


WINDOWED = f"""{_ENCODED},
starts AS (SELECT doc_id, ids, unnest(range(CASE WHEN len(ids) <= {MAX_LENGTH} THEN 1 ELSE
    1 + ceil((len(ids) - {MAX_LENGTH}) / {MAX_LENGTH - STRIDE}.0)::BIGINT END)) AS win FROM encoded),
windows AS (SELECT doc_id, win, ids[win * {MAX_LENGTH - STRIDE} + 1 :
    win * {MAX_LENGTH - STRIDE} + {MAX_LENGTH}] AS ids FROM starts)"""

_PADDED = f"""{_ENCODED},
batched AS (SELECT doc_id, ids,
    (row_number() OVER (ORDER BY doc_id) - 1) // {BATCH} AS batch FROM encoded),
longest AS (SELECT *, max(len(ids)) OVER (PARTITION BY batch) AS m FROM batched),
padded AS (SELECT doc_id, batch, list_concat(ids, list_transform(range(m - len(ids)), lambda x: {PAD}::BIGINT))
  AS ids FROM longest)"""

# --- Spark side ------------------------------------------------------------------


def encoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = annotated(spark, sf_dir).select("doc_id", "text_tags")
    base, chem = base_vocab(spark, sf_dir), chem_vocab(spark, sf_dir)
    return H.hybrid_encode(texts, "text_tags", base, chem, ["doc_id"]).select("doc_id", "ids")


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.token_windows(encoded(spark, sf_dir), "ids", MAX_LENGTH, STRIDE).withColumn(
        "win", F.col("win").cast("bigint")
    )


def _ids():
    return F.array_join("ids", " ").alias("ids")


@query(f"WITH {ANNOTATED_SQL}, {PIECES_CTE} SELECT doc_id, seg, piece, is_chem FROM kinds")
def hybrid_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.hybrid_segments(annotated(spark, sf_dir), "doc_id", "text_tags").withColumn(
        "seg", F.col("seg").cast("bigint")
    )


@query(f"{_ENCODED} SELECT doc_id, {_joined()} AS ids FROM encoded")
def hybrid_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(spark, sf_dir).select("doc_id", _ids())


_BOS_SQL = _ENCODED.replace(
    f"ELSE {base_list('piece')} END AS t", f"WHEN seg = 0 THEN list_concat(['{P.SPECIAL_TOKENS[2]}'], {base_list('piece')}) ELSE {base_list('piece')} END AS t"
)


@query(f"{_BOS_SQL} SELECT doc_id, {_joined()} AS ids FROM encoded")
def hybrid_encode_bos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a base tokenizer that starts every text with a token of its own."""
    bos = P.SPECIAL_TOKENS[2]
    started = lambda text: F.concat(F.array(F.lit(bos)), H.base_tokens(text))
    coded = H.hybrid_encode(
        annotated(spark, sf_dir).select("doc_id", "text_tags"), "text_tags", base_vocab(spark, sf_dir),
        chem_vocab(spark, sf_dir), ["doc_id"], base_tokenizer=started, bos=bos,
    )
    return coded.select("doc_id", _ids())


_MODE_SQL = {
    "base": (f"regexp_extract_all(text_tags, {literal(P.WORD_TOKEN_RE2)})",
             "SELECT token, id FROM base WHERE token NOT IN ('[START_SMILES]', '[END_SMILES]')"),
    "base_special": (base_list("text_tags"), "SELECT token, id FROM base"),
    "chem_only": (SIMPLE_SQL["element"].replace("smi", "text_tags"), "SELECT token, id FROM chem"),
}
_MODES = " UNION ALL ".join(
    f"""SELECT '{mode}' AS mode, a.doc_id, coalesce(ids, '') AS ids FROM annotated a LEFT JOIN (
      SELECT doc_id, string_agg(coalesce(v.id, 0)::VARCHAR, ' ' ORDER BY pos) AS ids
      FROM (SELECT doc_id, unnest(range(len(t))) AS pos, unnest(t) AS token
            FROM (SELECT doc_id, {tokens} AS t FROM annotated)) LEFT JOIN ({vocab}) v USING (token)
      GROUP BY doc_id) USING (doc_id)"""
    for mode, (tokens, vocab) in _MODE_SQL.items()
)


@query(f"{_ENCODED} {_MODES} UNION ALL SELECT 'hybrid', doc_id, {_joined()} FROM encoded")
def encode_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = annotated(spark, sf_dir).select("doc_id", "text_tags")
    base, chem = base_vocab(spark, sf_dir), chem_vocab(spark, sf_dir)
    result = None
    for mode in H.MODES:
        coded = H.encode_mode(texts, "text_tags", mode, base, chem, ["doc_id"])
        part = coded.select(F.lit(mode).alias("mode"), "doc_id", _ids())
        result = part if result is None else result.unionByName(part)
    return result


@query(f"{_ENCODED} SELECT doc_id, {_joined(f'ids[1 : {TRUNCATED}]')} AS ids FROM encoded")
def truncate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(spark, sf_dir).select(
        "doc_id", F.array_join(W.truncate(F.col("ids"), TRUNCATED), " ").alias("ids")
    )


@query(f"{WINDOWED} SELECT doc_id, win, len(ids)::BIGINT AS n_ids, {_joined()} AS ids FROM windows")
def token_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows(spark, sf_dir).select(
        "doc_id", "win", F.size("ids").cast("bigint").alias("n_ids"), _ids()
    )


def _padded(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Read for the bounds of the ranks, the ranks and the ids themselves.
    return W.pad_batch(materialize(encoded(spark, sf_dir)), ["doc_id"], "ids", BATCH, PAD)


@query(f"{_PADDED} SELECT doc_id, batch, {_joined()} AS ids FROM padded")
def pad_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _padded(spark, sf_dir).select("doc_id", "batch", _ids())


@query(
    f"""{_PADDED} SELECT doc_id,
      {_joined(f'list_transform(ids, lambda x: CASE WHEN x = {PAD} THEN 0 ELSE 1 END)')} AS mask FROM padded"""
)
def attention_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _padded(spark, sf_dir).select(
        "doc_id", F.array_join(W.attention_mask(F.col("ids"), PAD), " ").alias("mask")
    )


@query(f"{WINDOWED} SELECT count(*) AS n_samples, sum(len(ids))::BIGINT AS n_tokens FROM windows")
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.token_counts(windows(spark, sf_dir), "ids")


# Rows in order, one at a time: the smallest room that is large enough, else a new block.
_PACKED = f"""{WINDOWED},
sized AS (SELECT doc_id, win, len(ids) AS n, ('0x' || substr(md5(concat('42:', doc_id, ':', win)), 1, 8))::UBIGINT
    % ((SELECT count(*) FROM windows WHERE len(ids) > 0) // {W.BUCKET_ROWS} + 1) AS part FROM windows WHERE len(ids) > 0),
lined AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY n DESC, doc_id, win) AS spot FROM sized),
fitted AS (
  SELECT part, 0 AS spot, []::BIGINT[] AS rooms, 0::BIGINT AS block, 0::BIGINT AS offs FROM (SELECT DISTINCT part FROM lined)
  UNION ALL
  SELECT part, spot, CASE WHEN hit IS NULL THEN list_append(rooms, {BLOCK} - n)
      ELSE list_concat(rooms[:hit - 1], [rooms[hit] - n], rooms[hit + 1:]) END,
    coalesce(hit - 1, len(rooms)), coalesce({BLOCK} - rooms[hit], 0)
  FROM (SELECT f.part, l.spot, l.n, f.rooms,
      list_position(f.rooms, list_min(list_filter(f.rooms, lambda r: r >= l.n))) AS hit
    FROM fitted f JOIN lined l ON l.part = f.part AND l.spot = f.spot + 1))""".replace("WITH ", "WITH RECURSIVE ", 1)


@query(
    f"""{_PACKED} SELECT part::INTEGER AS block_part, block, sum(n)::BIGINT AS n_ids,
      string_agg({_joined()}, ' ' ORDER BY offs) AS ids
    FROM fitted JOIN lined USING (part, spot) JOIN windows USING (doc_id, win) GROUP BY part, block"""
)
def pack_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = materialize(windows(spark, sf_dir))
    placed = W.pack_blocks(cut, ["doc_id", "win"], "ids", BLOCK)
    blocks = W.assemble_blocks(cut, placed, ["doc_id", "win"], "ids")
    return blocks.select("block_part", "block", F.size("ids").cast("bigint").alias("n_ids"), _ids())


@query(
    f"""{WINDOWED} SELECT count(*) FILTER (WHERE len(ids) > 0) AS n_windows,
      sum(len(ids))::BIGINT AS n_ids, 0::BIGINT AS n_overfull FROM windows"""
)
def pack_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packing keeps every window and every id and overfills no block."""
    cut = materialize(windows(spark, sf_dir))
    placed = materialize(W.pack_blocks(cut, ["doc_id", "win"], "ids", BLOCK))
    blocks = W.assemble_blocks(cut, placed, ["doc_id", "win"], "ids")
    return blocks.agg(
        placed.agg(F.count(F.lit(1))).scalar().alias("n_windows"),
        F.sum(F.size("ids")).alias("n_ids"),
        F.count_if(F.size("ids") > BLOCK).alias("n_overfull"),
    )
