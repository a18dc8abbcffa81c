"""From raw documents to token ids: five stages, each written and read again as Parquet.

Every stage takes the columns of ``documents`` and works on all rows its predecessor kept. Stages
decide by row, also where ids are text, missing or name several rows; columns of any other name
are kept as they are. Exact repetitions of a row are
reduced to one by the near-duplicate stage; blank texts without an id all stay. An empty table passes through all stages.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from molcorpus.llm import bpe, bradley_terry, decontaminate, minhash, secret_scan
from molcorpus.llm.text import fold, fresh, row_numbers, whole_numbers
from molcorpus.session import materialize

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
REDACTED = "[SECRET]"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that score below the threshold. Learns from two thirds of the ids."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    score = fresh(docs, "_quality")
    ranked = bradley_terry.rank_quality(docs, labels, ~fold(F.col("doc_id"), 1, 3), output=score)
    return ranked.filter(F.col(score) >= 0.5).select(docs.columns)


def numbered(docs: DataFrame, row: str) -> tuple[DataFrame, bool]:
    """The rows with a number of their own, and whether that is just the id: where an id is
    no number, missing or repeated, the rows are numbered and written."""
    counted = docs.groupBy("doc_id").agg(F.count("*").alias("n"))
    if whole_numbers(docs, "doc_id") and counted.filter("doc_id IS NULL OR n > 1").isEmpty():
        return docs.withColumn(row, F.col("doc_id")), True
    return row_numbers(docs, row), False


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each group of near-duplicates."""
    row = fresh(docs, "_row")
    rows, unique = numbered(docs, row)
    found = materialize(minhash.near_duplicates(rows, key=row))
    if unique:
        others = found.filter(F.col(row) != F.col("component_id")).select(row)
        return rows.join(others, row, "left_anti").select(docs.columns)
    order = F.struct(F.col("doc_id").isNull(), "doc_id", row)
    first = found.join(rows.select(row, "doc_id"), row).groupBy("component_id").agg(F.min(order)[row].alias("first"))
    others = found.join(first, "component_id").filter(F.col(row) != F.col("first")).select(row)
    kept = rows.join(others, row, "left_anti").select(docs.columns)
    named = kept.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id", "text"])
    return named.unionByName(kept.filter("doc_id IS NULL"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a passage of the benchmark."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    row = fresh(docs, "_row")
    rows, _ = numbered(docs, row)
    held = decontaminate.passages(rows, items, key=row).select(row).distinct()
    return rows.join(held, row, "left_anti").select(docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace every finding in the texts; no document goes."""
    clean = secret_scan.scan(docs, redact=REDACTED)  # has the columns it was given
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return clean.select(docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of every text, with the digests of the ids and of what they decode to."""
    keep = [c for c in ("lang", "source") if c in docs.columns]
    return bpe.encode(docs, bpe.read_ranks(VOCABULARY), public_tokenizers.PATTERN, keep=keep)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("tokens", tokens),
]

# SQL has no equal of the learned stages; the tests hold the operators against plain versions and
# the stages against planted cases.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage for the table ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = materialize(docs)
    return docs
