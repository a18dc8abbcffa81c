"""How many external files to read for a wanted mixture."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Size of one external file.
SHARD_GB = 2.15


def size_bytes(df: DataFrame, col: str) -> DataFrame:
    """Bytes of text in a column (the text alone, without array offsets)."""
    return df.agg(F.coalesce(F.sum(F.octet_length(col)), F.lit(0)).alias("n_bytes"))


def plan_shards(
    spark: SparkSession,
    n_bytes: int,
    probabilities: tuple[float, float],
    prefix: str,
    per_index: int = 10,
    shard_gb: float = SHARD_GB,
) -> DataFrame:
    """File names of as many external shards as balance the corpus. The first
    probability is that of the external text. Halves round to even."""
    external, corpus = probabilities
    count = round(n_bytes / 1024**3 / shard_gb * external / corpus)
    number = F.col("id")
    return spark.range(count).select(
        number.alias("shard"),
        F.format_string(
            f"{prefix}/%03d_%05d.parquet", F.floor(number / per_index), number % per_index
        ).alias("file"),
    )
