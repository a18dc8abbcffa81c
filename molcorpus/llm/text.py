"""Words and hashes of whole Arrow columns of texts, shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, IntegerType, LongType, ShortType

from molcorpus.session import materialize

# Bytes of text that a task holds at once (one longer text is held whole).
CHUNK_BYTES = 8 << 20

M1 = np.uint64(0x9E3779B97F4A7C15)
M2 = np.uint64(0xBF58476D1CE4E5B9)
M3 = np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit over all others."""
    x = x + M1
    x = (x ^ (x >> np.uint64(30))) * M2
    x = (x ^ (x >> np.uint64(27))) * M3
    return x ^ (x >> np.uint64(31))


def fold(column: Column, remainder: int, parts: int) -> Column:
    """Whether crc32 of a key, as text, has this remainder; false for null keys."""
    crc = F.crc32(F.encode(column.cast("string"), "UTF-8"))
    return F.coalesce(crc % parts == remainder, F.lit(False))


def whole_numbers(df: DataFrame, key: str) -> bool:
    """Whether a key is of a type that fits 64-bit integers; other keys go by row numbers."""
    return isinstance(df.schema[key].dataType, (ByteType, ShortType, IntegerType, LongType))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the table does not have."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def row_numbers(df: DataFrame, name: str) -> DataFrame:
    """The table with a number of its own for every row, written once so that it stays."""
    return materialize(df.withColumn(name, F.monotonically_increasing_id()))


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def chunks(
    batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES, rows: int = 1 << 30
) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in order, in chunks of bounded bytes of text and bounded rows."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        total = np.cumsum(sizes.astype(np.int64))
        start = 0
        while start < len(total):
            before = total[start - 1] if start else 0
            end = int(np.searchsorted(total, before + limit, side="right"))
            end = min(max(end, start + 1), start + rows)
            yield batch.slice(start, end - start)
            start = end


def hash_strings(values: pa.Array) -> np.ndarray:
    """64-bit hashes of a column of strings or binaries without nulls."""
    raw = values.cast(pa.binary()).to_pylist()
    return np.fromiter(map(xxhash.xxh64_intdigest, raw), np.uint64, len(raw))


def split_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of texts with A-Z lower-cased: the first word's place of
    each text (one more than texts), each word's place among the distinct words, these.
    A null text has no word."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    offsets = lists.offsets.to_numpy().astype(np.int64)
    flat = lists.flatten()
    offsets = offsets - offsets[0]
    full = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    before = np.concatenate([[0], np.cumsum(full)])
    coded = flat.filter(pa.array(full)).dictionary_encode()
    return before[offsets], coded.indices.to_numpy().astype(np.int64), coded.dictionary


def list_column(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """A list column from flat values and the first place of each list."""
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values, kind))


def spread_small(df: DataFrame, key: str) -> DataFrame:
    """The table dealt out by a key, for inputs that are one small file."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism, key)
