"""Mixing sources by weight and describing the mixture."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from molcorpus.functions.text import draw
from molcorpus.operators.ranking import rank_rows


def _draws(spark, n: int, probabilities: dict[str, float], seed: int) -> DataFrame:
    """Draw number and the source it falls on."""
    u, upto, source = draw(F.col("idx"), seed), 0.0, None
    names = list(probabilities)
    for name in names[:-1]:
        upto += probabilities[name]
        source = F.when(u < upto, name) if source is None else source.when(u < upto, name)
    source = F.lit(names[-1]) if source is None else source.otherwise(names[-1])
    return spark.range(n).withColumnRenamed("id", "idx").withColumn("source", source)


def interleave(
    df: DataFrame, source: str, keys: list[str], probabilities: dict[str, float], seed: int = 42
) -> DataFrame:
    """Seeded weighted interleave that ends with the row that uses up a source.

    Every draw picks a source; its k-th draw takes the k-th row of that source in
    key order. Adds ``idx``, the place in the mixture. Ranks are worked out on
    keys alone, spread by range, so one source may hold most rows.
    """
    spark = df.sparkSession
    counted = {
        r[source]: r["count"]
        for r in df.filter(F.col(source).isin(list(probabilities))).groupBy(source).count().collect()
    }
    sizes = {name: counted.get(name, 0) for name in probabilities}
    if min(sizes.values()) == 0:
        return df.withColumn("idx", F.lit(0).cast("bigint")).filter(F.lit(False))
    n = math.ceil(min(sizes[s] / p for s, p in probabilities.items()) * 1.2) + 100
    while True:
        drawn = rank_rows(_draws(spark, n, probabilities, seed), ["idx"], ["source"])
        uses_up = F.lit(False)
        for name, size in sizes.items():
            uses_up |= (F.col("source") == name) & (F.col("rank") == size - 1)
        cut = drawn.filter(uses_up).agg(F.min("idx")).first()[0]
        if cut is not None:
            break
        n *= 2
    ranked = rank_rows(
        df.filter(F.col(source).isin(list(probabilities))).select(F.col(source).alias("source"), *keys),
        keys,
        ["source"],
    )
    picks = drawn.filter(F.col("idx") <= cut).join(ranked, ["source", "rank"])
    return df.join(picks.select("idx", *keys, F.col("source").alias(source)), [source, *keys])


def mix_report(df: DataFrame, source: str, tokens: str) -> DataFrame:
    """Rows and tokens per source and their shares."""
    sums = df.groupBy(source).agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum(tokens).cast("bigint").alias("n_tokens")
    )
    whole = Window.partitionBy()  # one row per source
    return sums.withColumns(
        {
            "row_share": F.round(F.col("n_rows") / F.sum("n_rows").over(whole), 9),
            "token_share": F.round(F.col("n_tokens") / F.sum("n_tokens").over(whole), 9),
        }
    )
