"""Embedding tables ``(token_id, embedding)``: new rows, pooling, projection."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from molcorpus.functions import patterns as P
from molcorpus.functions.text import draw, find_all
from molcorpus.operators import vocab as V
from molcorpus.operators.lookup import join_by_frequency

# Spread of a randomly initialised vector.
RANDOM_SCALE = 0.02
STRATEGIES = ("default", "average", "elementwise")


def _doubles(vectors: str) -> Column:
    return F.transform(vectors, lambda x: x.cast("double"))


def _mean(vectors: str) -> Column:
    """Mean of an array column, dimension by dimension, combined before the shuffle."""
    return vector_to_array(Summarizer.mean(array_to_vector(_doubles(vectors))))


def init_average(base: DataFrame, new_ids: DataFrame) -> DataFrame:
    """Every new token gets the mean of all base vectors."""
    return new_ids.select("token_id", base.agg(_mean("embedding")).scalar().alias("embedding"))


def init_elementwise(
    base: DataFrame,
    tokens: DataFrame,
    base_vocab: DataFrame,
    base_tokenizer: Callable[[Column], Column],
) -> DataFrame:
    """New chemical tokens ``(token, token_id)`` get the mean over their elements
    of the mean vector of the element name's base tokens; a repeated element
    weighs repeatedly. Tokens without elements use their own base tokens, tokens
    without any keep their default (they are not in the result)."""
    elements = find_all(F.col("token"), P.ELEMENT)
    names = F.create_map(*[F.lit(x) for pair in P.ELEMENT_NAMES.items() for x in pair])
    words = F.when(
        F.size(elements) > 0, F.transform(elements, lambda e: F.element_at(names, e))
    ).otherwise(F.array("token"))
    parts = tokens.select("token_id", F.posexplode(words).alias("occurrence", "word"))
    split = parts.withColumn("tokens", base_tokenizer(F.col("word")))
    coded = V.encode(split, "tokens", base_vocab, ["token_id", "occurrence"])
    pieces = coded.select("token_id", "occurrence", F.explode("ids").alias("base_id"))
    vectors = pieces.join(base.withColumnRenamed("token_id", "base_id"), "base_id")
    per_word = vectors.groupBy("token_id", "occurrence").agg(_mean("embedding").alias("embedding"))
    return per_word.groupBy("token_id").agg(_mean("embedding").alias("embedding"))


def init_random(new_ids: DataFrame, dim: int, seed: int = 42) -> DataFrame:
    """Normal vectors from seeded hashes of (id, dimension): the same on every run
    and after a lost executor. The distribution is a choice."""

    def normal(d: Column) -> Column:
        key = F.concat_ws(":", F.col("token_id"), d)
        u, v = draw(key, seed), draw(F.concat(key, F.lit(":v")), seed)
        return F.sqrt(-2 * F.log(1 - u)) * F.cos(v * (2 * math.pi)) * RANDOM_SCALE

    return new_ids.select(
        "token_id", F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), normal).alias("embedding")
    )


def init_embeddings(
    base: DataFrame,
    tokens: DataFrame,
    strategy: str = "default",
    dim: int | None = None,
    base_vocab: DataFrame | None = None,
    base_tokenizer: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """Vectors for new tokens ``(token, token_id)``. Without a base vocabulary the
    element strategy is the default one, as is any unknown strategy."""
    if strategy == "average":
        return init_average(base, tokens)
    dim = dim or len(base.first()["embedding"])
    default = init_random(tokens, dim)
    if strategy != "elementwise" or base_vocab is None:
        return default
    known = init_elementwise(base, tokens, base_vocab, base_tokenizer)
    return known.unionByName(default.join(known, "token_id", "left_anti"))


def mean_pool(df: DataFrame, keys: list[str], ids: str, mask: str, base: DataFrame, dim: int) -> DataFrame:
    """Mean vector of the unmasked ids of each row, zeros where there are none; an
    id without a vector counts as zeros. The ids of a row are counted first, so that
    each meets its vector once; frequent ids get theirs shipped."""
    pairs = F.arrays_zip(F.col(ids).alias("id"), F.col(mask).alias("m"))
    counted = (
        df.select(*keys, F.explode(pairs).alias("p"))
        .filter("p.m = 1 AND p.id IS NOT NULL")
        .groupBy(*keys, F.col("p.id").alias("token_id"))
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    zeros = F.array_repeat(F.lit(0.0), dim)
    weighted = F.transform(F.coalesce(_doubles("embedding"), zeros), lambda x: x * F.col("_n"))
    valued = join_by_frequency(counted, base.select("token_id", "embedding"), "token_id").select(
        *keys, "_n", weighted.alias("_v")
    )
    every = valued.unionByName(df.select(*keys, F.lit(0).cast("bigint").alias("_n"), zeros.alias("_v")))
    sums = every.groupBy(*keys).agg(
        vector_to_array(Summarizer.sum(array_to_vector("_v"))).alias("_sum"), F.sum("_n").alias("_n")
    )
    count = F.greatest(F.col("_n").cast("double"), F.lit(1e-9))
    return sums.select(*keys, F.transform("_sum", lambda x: x / count).alias("embedding"))


def top_classes(df: DataFrame, label: str, k: int = 10) -> DataFrame:
    """Rows of the k most frequent labels; ties by label."""
    top = (
        df.groupBy(label)
        .agg(F.count(F.lit(1)).alias("_n"))
        .orderBy(F.desc("_n"), label)
        .limit(k)
    )
    return df.join(F.broadcast(top), label, "left_semi")  # k rows


def project_2d(df: DataFrame, key: str, col: str = "embedding") -> DataFrame:
    """Two principal components, each with its largest loading positive. Linear,
    unlike the neighbour embedding often used for such plots."""
    vectors = df.withColumn("_v", array_to_vector(_doubles(col)))
    model = PCA(k=2, inputCol="_v", outputCol="_p").fit(vectors)
    loadings = model.pc.toArray()
    signs = [1.0 if max(c, key=abs) >= 0 else -1.0 for c in loadings.T]
    points = model.transform(vectors).withColumn("_p", vector_to_array("_p"))
    return points.select(
        key, (F.col("_p")[0] * signs[0]).alias("x"), (F.col("_p")[1] * signs[1]).alias("y")
    )
