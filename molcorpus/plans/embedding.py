"""Queries on embedding tables and labelled SMILES."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from molcorpus.functions import patterns as P
from molcorpus.functions.tokenizers import tok_character
from molcorpus.operators import embed as B
from molcorpus.operators import extract as X
from molcorpus.operators import vocab as V
from molcorpus.operators.windows import attention_mask
from molcorpus.plans.detection import SEGMENTS_CTE
from molcorpus.plans.mixing import draw_sql
from molcorpus.plans.registry import literal, query
from molcorpus.plans.tokenization import SIMPLE_SQL
from molcorpus.plans.vocabulary import (
    ELEMENT_TOKENS, KEYS, chem_vocab, first_seen_cte, segment_tokens, tokens_cte,
)
from molcorpus.sources.samples import ANNOTATED_SQL, POOL, pooled, prose, table

DIM = 64
PAD = 5

# --- SQL side ------------------------------------------------------------------

_VECTORS = """vectors AS (SELECT vec_id AS token_id, unnest(range(len(embedding))) AS dim,
  unnest(embedding)::DOUBLE AS x FROM embeddings)"""
_CHEM = f"{ELEMENT_TOKENS}, {first_seen_cte('chem', 'tokens')}"
_NEW = "new_tokens AS (SELECT token, id + (SELECT max(vec_id) + 1 FROM embeddings) AS token_id FROM chem)"
_LETTERS = f"""letters AS (SELECT doc_id, 0 AS seg, unnest(range(len(t))) AS pos, unnest(t) AS token
  FROM (SELECT doc_id, regexp_extract_all(text, '[^\\n]') AS t FROM documents)),
{first_seen_cte('base', 'letters')}"""
_NAMES = "names AS (SELECT * FROM (VALUES " + ", ".join(
    f"('{s}', '{n}')" for s, n in P.ELEMENT_NAMES.items()
) + ") AS t(symbol, name))"

# --- Spark side ------------------------------------------------------------------


def base_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("token_id"), "embedding")


def new_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = base_matrix(spark, sf_dir).agg(F.max("token_id")).first()[0] + 1
    return chem_vocab(spark, sf_dir).select("token", (F.col("id") + start).alias("token_id"))


def letter_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters of the prose as a base vocabulary with several ids per word."""
    letters = prose(spark, sf_dir).select(
        "doc_id", F.posexplode(tok_character(F.col("text"))).alias("pos", "token")
    )
    return V.first_seen_vocab(letters, ["doc_id", "pos"])


def _by_dimension(df: DataFrame, *keys: str, digits: int = 6) -> DataFrame:
    return df.select(*keys, F.posexplode("embedding").alias("dim", "x")).select(
        *keys, F.col("dim").cast("bigint").alias("dim"), F.round(F.col("x").cast("double"), digits).alias("x")
    )


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        pooled(i).alias("smiles"),
        F.when(i % 13 != 0, F.concat_ws(" ", "p_type", (i % 4).cast("string"))).alias("label"),
    )


_POOL_SQL = "[" + ", ".join(literal(s) for s in POOL) + "]"
LABELLED = f"""labelled AS (SELECT p_partkey, {_POOL_SQL}[p_partkey % 20 + 1] AS smiles,
  CASE WHEN p_partkey % 13 <> 0 THEN concat_ws(' ', p_type, (p_partkey % 4)::VARCHAR) END AS label FROM part)"""


@query(f"WITH {LABELLED} SELECT p_partkey, concat('[START_SMILES]', smiles, '[END_SMILES]') AS smiles FROM labelled")
def wrap_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled(spark, sf_dir).select("p_partkey", X.wrap_tags(F.col("smiles")).alias("smiles"))


@query(f"WITH {LABELLED} SELECT p_partkey, smiles, label FROM labelled WHERE label IS NOT NULL")
def drop_null_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.drop_null_labels(labelled(spark, sf_dir), "label")


@query(
    f"WITH {LABELLED} SELECT count(*) FILTER (WHERE label IS NULL) AS n_dropped, count(label) AS n_kept FROM labelled"
)
def null_label_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.null_label_count(labelled(spark, sf_dir), "label")


@query(
    f"""WITH {LABELLED}, top AS (SELECT label FROM labelled WHERE label IS NOT NULL
      GROUP BY label ORDER BY count(*) DESC, label LIMIT 10)
    SELECT p_partkey, smiles, label FROM labelled WHERE label IN (SELECT label FROM top)"""
)
def top_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = X.drop_null_labels(labelled(spark, sf_dir), "label")
    return B.top_classes(kept, "label").select("p_partkey", "smiles", "label")


@query(
    f"""{_CHEM}, {_VECTORS}, {_NEW}, means AS (SELECT dim, round(avg(x), 6) AS x FROM vectors GROUP BY dim)
    SELECT token_id, dim, x FROM new_tokens, means"""
)
def emb_init_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = new_tokens(spark, sf_dir)
    return _by_dimension(B.init_embeddings(base_matrix(spark, sf_dir), new, "average"), "token_id")


@query(
    f"""{_CHEM}, {_VECTORS}, {_NEW}, {_LETTERS}, {_NAMES},
    parts AS (SELECT token_id, token, regexp_extract_all(token, {literal(P.ELEMENT)}) AS found FROM new_tokens),
    occurrences AS (
      SELECT token_id, unnest(range(len(found))) AS occurrence, unnest(found) AS symbol FROM parts),
    spelled AS (
      SELECT token_id, occurrence, name AS word FROM occurrences JOIN names USING (symbol)
      UNION ALL SELECT token_id, 0, token FROM parts WHERE len(found) = 0),
    base_ids AS (SELECT token_id, occurrence, coalesce(b.id, 0) AS base_id FROM (
        SELECT token_id, occurrence, unnest(regexp_extract_all(word, '[^\\n]')) AS token FROM spelled)
      LEFT JOIN base b USING (token)),
    per_word AS (SELECT i.token_id, occurrence, dim, avg(x) AS x FROM base_ids i
      JOIN vectors v ON v.token_id = i.base_id GROUP BY ALL)
    SELECT token_id, dim, round(avg(x), 6) AS x FROM per_word GROUP BY token_id, dim"""
)
def emb_init_elementwise(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = B.init_elementwise(
        base_matrix(spark, sf_dir), new_tokens(spark, sf_dir), letter_vocab(spark, sf_dir), tok_character
    )
    return _by_dimension(known, "token_id")


@query(
    f"""{_CHEM}, {_NEW}, dims AS (SELECT unnest(range({DIM})) AS dim)
    SELECT token_id, dim, round(sqrt(-2 * ln(1 - {draw_sql("concat(token_id, ':', dim)")}))
      * cos({draw_sql("concat(token_id, ':', dim, ':v')")} * {2 * math.pi!r}::DOUBLE) * {B.RANDOM_SCALE}::DOUBLE, 9) AS x
    FROM new_tokens, dims"""
)
def emb_init_random(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = new_tokens(spark, sf_dir)
    vectors = B.init_embeddings(base_matrix(spark, sf_dir), new, "default", DIM)
    return _by_dimension(vectors, "token_id", digits=9)


@query(
    f"""{_CHEM}, {_VECTORS},
    coded AS (SELECT doc_id, seg, id AS token_id FROM tokens JOIN chem USING (token) WHERE id <> {PAD}),
    pooled AS (SELECT doc_id, seg, dim, avg(x) AS x FROM coded JOIN vectors USING (token_id) GROUP BY ALL)
    SELECT s.doc_id, s.seg, d.dim, round(coalesce(p.x, 0), 6) AS x
    FROM segments s CROSS JOIN (SELECT unnest(range({DIM})) AS dim) d
    LEFT JOIN pooled p ON p.doc_id = s.doc_id AND p.seg = s.seg AND p.dim = d.dim"""
)
def mean_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocab = chem_vocab(spark, sf_dir)
    coded = V.encode(segment_tokens(spark, sf_dir, "element"), "tokens", vocab, KEYS)
    masked = coded.withColumn("mask", attention_mask(F.col("ids"), PAD))
    pooled_rows = B.mean_pool(masked, KEYS, "ids", "mask", base_matrix(spark, sf_dir), DIM)
    return _by_dimension(pooled_rows.withColumn("seg", F.col("seg").cast("bigint")), *KEYS)


def _axis_sql(name: str, matrix: str) -> str:
    """The unit eigenvector of the largest eigenvalue of ``matrix (i, j, v)``, its largest
    loading positive: the matrix is squared until one eigenvalue is left."""
    return f"""{name}_power AS (
      SELECT 0 AS step, i, j, v / (SELECT max(abs(v)) FROM {matrix}) AS v FROM {matrix}
      UNION ALL
      SELECT step + 1, i, j, v / max(abs(v)) OVER () FROM (
        SELECT l.step, l.i, r.j, sum(l.v * r.v) AS v FROM {name}_power l JOIN {name}_power r ON l.j = r.i
        WHERE l.step < 32 GROUP BY l.step, l.i, r.j)),
    {name}_last AS (SELECT i, j, v FROM {name}_power WHERE step = 32),
    {name}_column AS (SELECT i, v FROM {name}_last WHERE j = (SELECT arg_max(i, v) FROM {name}_last WHERE i = j)),
    {name} AS (SELECT i, v * (SELECT sign(arg_max(v, abs(v))) / sqrt(sum(v * v)) FROM {name}_column) AS v FROM {name}_column)"""


@query(
    f"""WITH RECURSIVE top AS (SELECT label FROM embeddings GROUP BY label ORDER BY count(*) DESC, label LIMIT 10),
    points AS (SELECT vec_id, unnest(range(len(embedding))) AS i, unnest(embedding)::DOUBLE AS x
      FROM embeddings WHERE label IN (SELECT label FROM top)),
    centred AS (SELECT vec_id, i, x - avg(x) OVER (PARTITION BY i) AS x FROM points),
    spread AS (SELECT l.i, r.i AS j, sum(l.x * r.x) / ((SELECT count(DISTINCT vec_id) FROM points) - 1) AS v
      FROM centred l JOIN centred r USING (vec_id) GROUP BY l.i, r.i),
    {_axis_sql("first_axis", "spread")},
    size AS (SELECT sum(l.v * s.v * r.v) AS s FROM spread s JOIN first_axis l ON l.i = s.i JOIN first_axis r ON r.i = s.j),
    rest AS (SELECT s.i, s.j, s.v - (SELECT s FROM size) * l.v * r.v AS v
      FROM spread s JOIN first_axis l ON l.i = s.i JOIN first_axis r ON r.i = s.j),
    {_axis_sql("second_axis", "rest")}
    SELECT vec_id, round(sum(x * f.v), 6) AS x, round(sum(x * g.v), 6) AS y
    FROM points p JOIN first_axis f USING (i) JOIN second_axis g USING (i) GROUP BY vec_id"""
)
def project_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Principal components of the vectors of the ten largest classes."""
    rows = B.top_classes(table(spark, sf_dir, "embeddings"), "label")
    return B.project_2d(rows, "vec_id").select(
        "vec_id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y")
    )
