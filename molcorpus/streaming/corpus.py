"""The projections of the corpus on a stream of arriving files.

Tagging, extraction, tokenizing and windowing keep no state, so the batch
operators are used as they are; Spark's checkpoint keeps track of the files done.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from molcorpus.operators.annotate import annotate
from molcorpus.operators.extract import extract_segments
from molcorpus.operators.windows import token_windows


def read_files(
    spark: SparkSession, folder: str, schema: StructType | str, files_per_batch: int | None = None
) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def annotated_stream(stream: DataFrame, col: str) -> DataFrame:
    return annotate(stream, col)


def token_stream(stream: DataFrame, key: str, col: str, tokenizer: Callable[[Column], Column]) -> DataFrame:
    """Tokens of every tagged segment of the arriving texts."""
    return extract_segments(stream, key, col).withColumn("tokens", tokenizer(F.col("smi")))


def window_stream(stream: DataFrame, ids: str, max_length: int, stride: int) -> DataFrame:
    return token_windows(stream, ids, max_length, stride)


def write_available(result: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Work off all files there are and stop."""
    return (
        result.writeStream.format("parquet")
        .option("path", folder)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
