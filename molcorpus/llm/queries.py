"""The registered queries of this package and, where SQL can say the same, their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from molcorpus.llm import bpe, bradley_terry, decontaminate, forest, heap_means, katz, language, lexicon, minhash
from molcorpus.llm import secret_scan, suffix, urls, whitening
from molcorpus.llm.text import fold

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORD_VOCABULARY = public_tokenizers.path("word_bpe_49k.json")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(build: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[build.__name__] = build
    return build


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    held = fold(F.col("doc_id"), 1, 3)
    ranked = bradley_terry.rank_quality(docs, labels, ~held)
    return ranked.select(
        "doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


@query
def op5_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"))


@query
def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = fold(F.col("doc_id"), 2, 4)
    found = language.identify(docs, ~held)
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score")


@query
def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    found = forest.nearest(rows, F.col("vec_id") % 20 == 0)
    return found.select("query_id", "rank", "vec_id", "score")


@query
def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = minhash.near_duplicates(docs)
    return found.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


WORDS_SQL = """list_filter(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '')"""

ORACLES["op4_near_duplicates"] = f"""
WITH RECURSIVE w AS (SELECT doc_id, {WORDS_SQL} AS words FROM documents),
shingled AS (
  SELECT DISTINCT doc_id, array_to_string(words[i:i + 4], ' ') AS s
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 4, 1) + 1)) AS i FROM w WHERE len(words) > 0)
),
sizes AS (SELECT doc_id, count(*) AS n FROM shingled GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c
  FROM shingled a JOIN shingled b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL
),
links AS (
  SELECT x, y FROM common JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y
  WHERE 100 * c >= 85 * (p.n + q.n - c)
),
reach AS (
  SELECT doc_id AS node, doc_id AS seen FROM w
  UNION
  SELECT reach.node, links.y FROM reach JOIN links ON links.x = reach.seen
),
component AS (SELECT node, min(seen) AS component_id FROM reach GROUP BY node)
SELECT w.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, w.doc_id = component_id AS kept
FROM w JOIN component ON node = w.doc_id LEFT JOIN sizes ON sizes.doc_id = w.doc_id
"""


@query
def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode(docs, bpe.read_ranks(VOCABULARY), public_tokenizers.PATTERN, keep_ids=False)


@query
def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secret_scan.scan(docs)
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


@query
def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    items = table(spark, sf_dir, "benchmark").select("item_id", "text")
    return decontaminate.passages(docs, items)


@query
def op2_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffix.remove_repeated(docs).drop("starts", "ends")


@query
def op1_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return katz.score(docs, fold(F.col("doc_id"), 1, 5))


@query
def op11_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = lexicon.Rules(WORD_VOCABULARY)
    return lexicon.encode(docs, rules, lexicon.build(docs, rules), keep_ids=False)


@query
def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


@query
def op13_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = heap_means.cluster(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _clusters_sql(rounds: int = 3) -> str:
    """Every round as it is defined: all distances, the smallest, means rounded down."""
    parts = [
        """kept AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE len(embedding) = 64
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND NOT isnan(x) AND NOT isinf(x))) = 64
)""",
        """c0 AS (
  SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id::VARCHAR), v) - 1 AS c, v FROM kept WHERE vec_id IS NOT NULL
  QUALIFY c < 16
)""",
    ]
    for i in range(rounds + 1):
        parts.append(f"""a{i} AS (
  SELECT r, min(d * 16 + c) % 16 AS c, min(d * 16 + c) // 16 AS d FROM (
    SELECT r, c, list_sum(list_transform(list_zip(kept.v, c{i}.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d
    FROM kept, c{i}
  ) GROUP BY r
)""")
        if i < rounds:
            parts.append(f"""c{i + 1} AS (
  SELECT c, coalesce(m.v, c{i}.v) AS v FROM c{i} LEFT JOIN (
    SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY j) AS v FROM (
      SELECT c, j, sum(x)::BIGINT AS s, count(*) AS n
      FROM (SELECT a{i}.c, unnest(v) AS x, unnest(range(64)) AS j FROM a{i} JOIN kept USING (r)) GROUP BY c, j
    ) GROUP BY c
  ) m USING (c)
)""")
    return "WITH " + ",\n".join(parts) + f"""
SELECT vec_id, a.c::INTEGER AS cluster, d::BIGINT AS distance, sum(d) OVER (PARTITION BY a.c)::BIGINT AS cluster_inertia,
  sum(d) OVER ()::BIGINT AS inertia, sha256(array_to_string(m.v, ',')) AS centroid_sha256
FROM a{rounds} a JOIN kept USING (r) JOIN c{rounds} m ON m.c = a.c
"""


ORACLES["op13_clusters"] = _clusters_sql()
