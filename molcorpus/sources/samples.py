"""Test inputs derived from the given tables.

The given prose holds no SMILES, so they are added here, by document id. The
pool and the sentence shape are test fixtures, not part of the engine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from molcorpus.functions import patterns as P
from molcorpus.session import spread

POOL = [
    "CCO", "c1ccccc1", "CC(=O)O", "CSc1ccccc1", "Cn1cnc2c1c(=O)n(C)c(=O)n2C",
    "[Na+].[Cl-]", "C[C@H](N)C(=O)O", "F/C=C\\F", "BrCCl", "N",
    "O=C=O", "C1CC1", "C%12CCCC%12", "[13CH4]", "Oc1ccc[se]1",
    "CCN(CC)CC", "C#N", "H2SO4", "ISBN", "CCCCCCCC",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents, read by all cores: what is done to their text is long work
    on few bytes."""
    return spread(table(spark, sf_dir, "documents"))


def pooled(index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(s) for s in POOL]), (index % 20 + 1).cast("int"))


def annotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with three tagged SMILES each; every tenth has none. The second
    is padded, in every seventh document by a newline; the third is a molecule
    built from parts, so that distinct SMILES grow with the table."""
    i = F.col("doc_id")
    first, second = pooled(i), pooled(i * 7 + 3)
    chain = F.expr("repeat('C', cast(1 + floor(doc_id / 400) % 50 AS int))")
    third = F.concat(first, F.lit("("), chain, F.lit(")"), pooled(F.floor(i / 20)))
    pad = F.when(i % 7 == 0, "\n").otherwise(" ")
    start, end = F.lit(P.START_TAG), F.lit(P.END_TAG)
    tagged = F.concat(
        "text", F.lit(" "), start, first, end, F.lit(" and "), start, F.lit(" "), second,
        pad, end, F.lit(" then "), start, third, end,
    )
    raw = F.concat("text", F.lit(" "), first, F.lit(" and "), second, F.lit(" then "), third)
    return prose(spark, sf_dir).select(
        "doc_id",
        "source",
        F.when(i % 10 == 9, F.col("text")).otherwise(tagged).alias("text_tags"),
        F.when(i % 10 == 9, F.col("text")).otherwise(raw).alias("text_raw"),
    )


# The same derivation for the SQL check, to be put in a WITH clause.
_POOL_SQL = "[" + ", ".join("'" + s.replace("'", "''") + "'" for s in POOL) + "]"
ANNOTATED_SQL = f"""
pool AS (SELECT {_POOL_SQL} AS p),
molecules AS (
  SELECT doc_id, text, source,
    p[doc_id % 20 + 1] AS a, p[(doc_id * 7 + 3) % 20 + 1] AS b,
    concat(p[doc_id % 20 + 1], '(', repeat('C', 1 + (doc_id // 400) % 50), ')',
           p[(doc_id // 20) % 20 + 1]) AS c,
    CASE WHEN doc_id % 7 = 0 THEN chr(10) ELSE ' ' END AS pad
  FROM documents, pool),
annotated AS (
  SELECT doc_id, source,
    CASE WHEN doc_id % 10 = 9 THEN text ELSE concat(
      text, ' [START_SMILES]', a, '[END_SMILES] and [START_SMILES] ', b, pad,
      '[END_SMILES] then [START_SMILES]', c, '[END_SMILES]') END AS text_tags,
    CASE WHEN doc_id % 10 = 9 THEN text
      ELSE concat(text, ' ', a, ' and ', b, ' then ', c) END AS text_raw
  FROM molecules)"""
