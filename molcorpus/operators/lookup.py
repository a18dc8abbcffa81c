"""Replace the entries of an array column through a (key, value) table."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from molcorpus.functions.text import entries
from molcorpus.session import materialize

# A literal map is searched entry by entry, so it is used for small tables only.
LITERAL_ROWS = 256
# Largest table shipped to the executors, in rows and bytes; larger ones are joined.
BROADCAST_ROWS = 2_000_000
BROADCAST_BYTES = 64 << 20
# A key is frequent from this share of the rows on, so there are no more than its inverse.
FREQUENT_SHARE = 1e-3
# Entries of a batch that are looked up together.
TOGETHER = 1 << 18


def _literal_map(rows: list, default) -> Callable[[Column], Column]:
    known = F.create_map(*[F.lit(x) for row in rows for x in row])
    if default is None:
        return lambda item: F.element_at(known, item)
    return lambda item: F.coalesce(F.element_at(known, item), _unknown(item, default))


def _unknown(item: Column, default) -> Column:
    """The value of an entry that is not in the table."""
    if not isinstance(default, dict):
        return F.lit(default)
    value = F.lit(default[""])
    for start, other in default.items():
        value = F.when(item.startswith(start), F.lit(other)).otherwise(value) if start else value
    return value


def _arrow_lookup(spark, rows: list, value_type: pa.DataType, default):
    """An Arrow function over whole batches of lists, whose entries are looked up by Arrow
    itself, some at a time. Entries that are not in the table are never made Python strings:
    in prose most distinct words are of this kind."""
    table = spark.sparkContext.broadcast((pa.array([row[0] for row in rows]), pa.array([row[1] for row in rows], value_type)))
    starts = dict(default) if isinstance(default, dict) else {"": default}
    plain = pa.scalar(starts.pop(""), value_type)

    def some(entries: pa.Array, keys: pa.Array, values: pa.Array) -> pa.Array:
        found, others = values.take(pc.index_in(entries, value_set=keys)), plain
        if default is None or not found.null_count:
            return found
        for start, value in starts.items():
            begins = pc.fill_null(pc.starts_with(entries, start), False)
            others = pc.if_else(begins, pa.scalar(value, value_type), others)
        return pc.coalesce(found, others)

    def replace(batch: pa.Array) -> pa.Array:
        (keys, values), flat = table.value, batch.flatten()
        keys, step = keys.cast(flat.type), max(TOGETHER, len(keys))
        parts = (some(flat.slice(at, step), keys, values) for at in range(0, len(flat), step))
        if default is not None and not values.null_count and value_type == pa.int64():
            numbers, at = np.empty(len(flat), np.int64), 0  # filled in place: no second copy
            for part in parts:
                numbers[at : at + len(part)], at = part.to_numpy(), at + len(part)
            found = pa.array(numbers)
        else:
            found = pa.concat_arrays([pa.array([], value_type), *parts])
        lengths = pc.fill_null(pc.list_value_length(batch), 0)
        ends = pc.cumulative_sum(lengths.cast(pa.int32()))
        offsets = pa.concat_arrays([pa.array([0], pa.int32()), ends])
        return pa.ListArray.from_arrays(offsets, found, mask=batch.is_null())

    return F.arrow_udf(replace, f"array<{_sql_type(value_type)}>")


def _sql_type(value_type: pa.DataType) -> str:
    return "string" if pa.types.is_string(value_type) else "bigint"


def _arrow_type(sql_type: str) -> pa.DataType:
    return pa.string() if sql_type == "string" else pa.int64()


def replace_entries(
    df: DataFrame, col: str, table: DataFrame, default, row_keys: list[str], out: str | None = None
) -> DataFrame:
    """Map every array entry through ``table`` (first column key, second value),
    unknown and null entries to ``default`` (None gives null). A dict has the defaults of
    entries by what they start with, that of all others under ``""``. Entries keep their
    order, null arrays stay null; of a key that is there twice the smallest value
    counts.

    A table of up to two million rows and 64 MB makes this a projection: a literal
    map for tiny tables, else one Arrow lookup per batch. A larger table is joined
    to the exploded entries, whose rows are then put together again by ``row_keys``.
    """
    key, value = table.columns
    out = out or col
    # Both limits hold before anything reaches the driver.
    first = table.filter(F.col(key).isNotNull()).limit(BROADCAST_ROWS + 1)
    size = F.coalesce(F.length(F.col(key).cast("string")), F.lit(0)) + F.coalesce(F.length(F.col(value).cast("string")), F.lit(0))
    n, total = first.agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0))).first()
    if n > BROADCAST_ROWS or 4 * total > BROADCAST_BYTES:
        return _joined(df, col, table, default, row_keys, out)
    rows = first.groupBy(key).agg(F.min(value)).collect()
    if len(rows) <= LITERAL_ROWS:
        return df.withColumn(out, F.transform(col, _literal_map(rows, default)))
    lookup = _arrow_lookup(df.sparkSession, rows, _arrow_type(dict(table.dtypes)[value]), default)
    return df.withColumn(out, lookup(F.col(col)))


def join_by_frequency(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Left join on one key, of which ``right`` has each value once. Values that hold a
    thousandth of the left rows or more are few, and their right rows are shipped;
    the others are joined by a shuffle in which no value is hot. Null keys meet
    nothing and are not shuffled."""
    left = materialize(left)
    least = max(1, int(left.count() * FREQUENT_SHARE))
    counts = left.filter(F.col(key).isNotNull()).groupBy(key).count().filter(F.col("count") > least)
    frequent = F.broadcast(materialize(counts.select(key)))  # at most 1000 rows
    hot = F.broadcast(materialize(right.join(frequent, key, "left_semi")))
    others = [F.lit(None).cast(t).alias(c) for c, t in right.dtypes if c != key]
    known = left.filter(F.col(key).isNotNull())
    return (
        known.join(frequent, key, "left_semi").join(hot, key, "left")
        .unionByName(known.join(frequent, key, "left_anti").join(right, key, "left"))
        .unionByName(left.filter(F.col(key).isNull()).select("*", *others))
    )


def _joined(df: DataFrame, col: str, table: DataFrame, default, row_keys: list[str], out: str) -> DataFrame:
    key, value = table.columns
    single = table.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(value).alias(value))
    exploded = entries(df, row_keys, col, "_pos", key)
    found = F.col(value) if default is None else F.coalesce(value, _unknown(F.col(key), default))
    valued = join_by_frequency(exploded, single, key).select(
        *row_keys, F.struct("_pos", found.alias("_value")).alias("_e")
    )
    lists = valued.groupBy(*row_keys).agg(
        F.transform(F.sort_array(F.collect_list("_e")), lambda e: e["_value"]).alias("_list")
    )
    empty = F.array().cast(f"array<{dict(table.dtypes)[value]}>")
    joined = df.join(lists, row_keys, "left")
    return joined.withColumn(out, F.when(F.col(col).isNotNull(), F.coalesce("_list", empty))).drop("_list")
