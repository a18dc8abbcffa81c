"""Queries on scanning, sampling, mixing and splitting corpora."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from molcorpus.operators import mix as M
from molcorpus.operators import ranking as R
from molcorpus.plans.detection import SEGMENTS_CTE, segments
from molcorpus.plans.encoding import WINDOWED, windows
from molcorpus.plans.registry import query
from molcorpus.session import materialize
from molcorpus.sources import shards
from molcorpus.sources.files import scan_parquet
from molcorpus.sources.samples import ANNOTATED_SQL, table

SEED = 42
SHARE = 0.37
SAMPLE = 400
SHARD_GB = 1e-5
MIXTURE = {"general": 0.2, "chem": 0.8}
RATIO = 0.05

_SEGMENTS = f"WITH {ANNOTATED_SQL}, {SEGMENTS_CTE}"


def draw_sql(key: str, seed: int = SEED) -> str:
    return f"(('0x' || substr(md5(concat('{seed}:', {key})), 1, 8))::UBIGINT / 4294967296.0::DOUBLE)"


def interleave_sql(probabilities: dict[str, float], rows: str) -> str:
    """CTEs from a relation (source, key) to ``mixed`` (idx, source, key)."""
    upto, cases = 0.0, ""
    names = list(probabilities)
    for name in names[:-1]:
        upto += probabilities[name]
        cases += f"WHEN u < {upto!r}::DOUBLE THEN '{name}' "
    chances = ", ".join(f"('{n}', {p!r})" for n, p in probabilities.items())
    return f"""ranked AS (SELECT source, key,
    row_number() OVER (PARTITION BY source ORDER BY key) - 1 AS rank FROM {rows}),
sizes AS (SELECT source, count(*) AS n FROM ranked GROUP BY source),
chances AS (SELECT * FROM (VALUES {chances}) AS t(source, p)),
enough AS (SELECT ceil(min(n / p) * 2)::BIGINT + 1000 AS n FROM sizes JOIN chances USING (source)),
numbers AS (SELECT unnest(range(n)) AS idx FROM enough),
draws AS (SELECT idx, CASE {cases} ELSE '{names[-1]}' END AS source
  FROM (SELECT idx, {draw_sql('idx')} AS u FROM numbers)),
drawn AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY idx) - 1 AS rank FROM draws),
cut AS (SELECT min(idx) AS idx FROM drawn JOIN sizes USING (source) WHERE rank = n - 1),
mixed AS (SELECT d.idx, source, key FROM drawn d JOIN ranked USING (source, rank)
  WHERE d.idx <= (SELECT idx FROM cut))"""


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("source") == "src0", "chem").otherwise("general")
    return table(spark, sf_dir, "documents").select("doc_id", "text", name.alias("source"))


_MIXED = "WITH named AS (SELECT doc_id AS key, text, CASE source WHEN 'src0' THEN 'chem' ELSE 'general' END AS source FROM documents), " + interleave_sql(MIXTURE, "named")


@query("SELECT text FROM documents")
def scan_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_parquet(spark, [f"{sf_dir}/documents.parquet"])


@query("SELECT coalesce(sum(strlen(text)), 0)::BIGINT AS n_bytes FROM documents")
def corpus_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.size_bytes(table(spark, sf_dir, "documents"), "text")


@query(
    f"""WITH n AS (SELECT round_even(sum(strlen(text))::DOUBLE / 1073741824.0::DOUBLE / {SHARD_GB!r}::DOUBLE
      * 0.2::DOUBLE / 0.8::DOUBLE, 0)::BIGINT AS n FROM documents)
    SELECT shard, format('sample/{{:03d}}_{{:05d}}.parquet', shard // 10, shard % 10) AS file
    FROM (SELECT unnest(range(n)) AS shard FROM n)"""
)
def plan_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    n_bytes = shards.size_bytes(table(spark, sf_dir, "documents"), "text").first()["n_bytes"]
    return shards.plan_shards(spark, n_bytes, (0.2, 0.8), "sample", 10, SHARD_GB)


@query(
    f"""{_SEGMENTS}, numbered AS (SELECT *, row_number() OVER (ORDER BY doc_id, seg) AS r,
      count(*) OVER () AS n FROM segments)
    SELECT doc_id, seg, smi FROM numbered WHERE r <= floor(n * {SHARE}::DOUBLE)"""
)
def portion_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = segments(spark, sf_dir).withColumn("seg", F.col("seg").cast("bigint"))
    return R.portion(rows, ["doc_id", "seg"], SHARE)


@query(
    f"""{_SEGMENTS} SELECT doc_id, seg, smi FROM segments
    ORDER BY md5(concat('{SEED}:', doc_id, ':', seg)) LIMIT {SAMPLE}"""
)
def sample_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = segments(spark, sf_dir).withColumn("seg", F.col("seg").cast("bigint"))
    return R.sample_n(rows, ["doc_id", "seg"], SAMPLE, SEED)


@query(f"{_MIXED} SELECT m.idx, m.source, m.key AS doc_id, n.text FROM mixed m JOIN named n USING (key)")
def interleave_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.interleave(_sources(spark, sf_dir), "source", ["doc_id"], MIXTURE, SEED)


@query(
    f"""WITH numbered AS (SELECT doc_id, row_number() OVER (ORDER BY md5(concat('{SEED}:', doc_id))) AS r,
      count(*) OVER () AS n FROM documents)
    SELECT doc_id, CASE WHEN r <= ceil(n * {RATIO}::DOUBLE) THEN 'test' ELSE 'train' END AS part FROM numbered"""
)
def train_test_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.split(table(spark, sf_dir, "documents").select("doc_id"), ["doc_id"], RATIO, SEED)


@query(
    f"""{_MIXED}, sums AS (SELECT m.source, count(*) AS n_rows,
        sum(len(regexp_extract_all(n.text, '[^ \\n]+')))::BIGINT AS n_tokens
      FROM mixed m JOIN named n USING (key) GROUP BY m.source)
    SELECT source, n_rows, n_tokens, round(n_rows / sum(n_rows) OVER (), 9) AS row_share,
      round(n_tokens / sum(n_tokens) OVER (), 9) AS token_share FROM sums"""
)
def mix_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = M.interleave(_sources(spark, sf_dir), "source", ["doc_id"], MIXTURE, SEED)
    counted = mixed.withColumn("n", F.size(F.regexp_extract_all("text", F.lit(r"[^ \n]+"), F.lit(0))))
    return M.mix_report(counted, "source", "n")


@query(
    f"""{WINDOWED}, cut_windows AS (
      SELECT {{'d': doc_id, 'w': win}} AS key, len(ids) AS n,
        CASE (SELECT source FROM documents d WHERE d.doc_id = windows.doc_id)
          WHEN 'src0' THEN 'chem' ELSE 'general' END AS source FROM windows),
    {interleave_sql(MIXTURE, 'cut_windows')},
    numbered AS (SELECT *, row_number() OVER (ORDER BY md5(concat('{SEED}:', idx))) AS r,
      count(*) OVER () AS n FROM mixed)
    SELECT m.idx, m.source, m.key['d'] AS doc_id, m.key['w'] AS win, w.n::BIGINT AS n_ids,
      CASE WHEN r <= ceil(m.n * {RATIO}::DOUBLE) THEN 'test' ELSE 'train' END AS part
    FROM numbered m JOIN cut_windows w USING (key)"""
)
def mixed_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training data from end to end: texts encoded, cut into windows, mixed by
    source and split. Windows are written once, before they are ranked and joined."""
    named = _sources(spark, sf_dir).select("doc_id", "source")
    cut = materialize(windows(spark, sf_dir).join(named, "doc_id"))
    mixed = materialize(M.interleave(cut, "source", ["doc_id", "win"], MIXTURE, SEED))
    return R.split(mixed, ["idx"], RATIO, SEED).select(
        "idx", "source", "doc_id", "win", F.size("ids").cast("bigint").alias("n_ids"), "part"
    )
