"""Token-id arrays cut, padded, masked, counted and packed."""

from __future__ import annotations

from bisect import bisect_left, insort

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from molcorpus.functions.text import draw_hash
from molcorpus.operators.ranking import rank_rows

# Without a sensible model limit windows get this length.
DEFAULT_LENGTH = 2048


def effective_length(model_limit: int) -> int:
    return DEFAULT_LENGTH if model_limit > 1_000_000 else model_limit


def truncate(ids: Column, max_length: int) -> Column:
    return F.slice(ids, 1, max_length)


def token_windows(df: DataFrame, ids: str, max_length: int, stride: int = 0) -> DataFrame:
    """One row per window: ``win`` counts the windows of a row, neighbours overlap
    by ``stride`` ids, the last one reaches the end. No shuffle."""
    step = max_length - stride
    if step <= 0:
        raise ValueError(f"stride {stride} must be smaller than the window length {max_length}")
    n = F.size(ids)
    last = F.when(n <= max_length, 0).otherwise(F.ceil((n - max_length) / step) * step).cast("int")
    windows = F.transform(
        F.sequence(F.lit(0), last, F.lit(step)), lambda i: F.slice(ids, i + 1, max_length)
    )
    others = [c for c in df.columns if c != ids]
    return df.select(*others, F.posexplode(windows).alias("win", ids))


def pad_batch(df: DataFrame, keys: list[str], ids: str, batch_size: int, pad_id: int) -> DataFrame:
    """Pad right to the longest row of each batch of ``batch_size`` rows in key
    order. Batches are formed on keys and lengths alone; the ids move once."""
    sizes = df.select(*keys, F.size(ids).alias("_n"))
    batch = F.floor(F.col("_rank") / batch_size).cast("bigint")
    placed = rank_rows(sizes, keys, name="_rank").withColumn("batch", batch)
    longest = placed.groupBy("batch").agg(F.max("_n").alias("_longest"))
    target = placed.join(longest, "batch").select(*keys, "batch", "_longest")
    padding = F.array_repeat(F.lit(pad_id).cast("bigint"), F.col("_longest") - F.size(ids))
    return df.join(target, keys).withColumn(ids, F.concat(ids, padding)).drop("_longest")


def attention_mask(ids: Column, pad_id: int) -> Column:
    """1 where an id is not the padding id. When the end-of-text id pads, a real
    end of text is masked too."""
    return F.transform(ids, lambda x: (x != pad_id).cast("int"))


def token_counts(df: DataFrame, ids: str, by: list[str] | None = None) -> DataFrame:
    return df.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("n_samples"), F.sum(F.size(ids)).alias("n_tokens")
    )


# Rows that are packed together.
BUCKET_ROWS = 10_000


def _best_fit(max_length: int, names: list[str]):
    """Place rows, longest first, into the fullest open block they fit in (of equally
    full ones the first)."""

    def place(table: pa.Table) -> pa.Table:
        table = table.sort_by([("_n", "descending"), *((k, "ascending") for k in names)])
        open_blocks: dict[int, list[int]] = {}  # free room -> block numbers, ascending
        rooms: list[int] = []  # the keys of open_blocks, ascending
        numbers, offsets, n_blocks = [], [], 0
        for length in table.column("_n").to_pylist():
            at = bisect_left(rooms, length)
            if at == len(rooms):
                number, room = n_blocks, max_length
                n_blocks += 1
            else:
                room = rooms[at]
                number = open_blocks[room].pop(0)
                if not open_blocks[room]:
                    del open_blocks[room], rooms[at]
            numbers.append(number)
            offsets.append(max_length - room)
            left = room - length
            if left > 0:
                if left not in open_blocks:
                    open_blocks[left] = []
                    insort(rooms, left)
                insort(open_blocks[left], number)
        placed = table.select([*names, "block_part"])
        placed = placed.append_column("block", pa.array(numbers, pa.int64()))
        return placed.append_column("offset", pa.array(offsets, pa.int32()))

    return place


def pack_blocks(df: DataFrame, keys: list[str], ids: str, max_length: int) -> DataFrame:
    """Whole windows packed into blocks of at most ``max_length`` ids:
    ``(keys, block_part, block, offset)``. Only keys and lengths are moved. A hash of
    the keys decides which rows are packed together, some ten thousand each, so the
    result does not depend on the cluster, and no task holds more than one such part."""
    sizes = df.select(*keys, F.size(ids).alias("_n")).filter(F.col("_n") > 0)
    parts = sizes.count() // BUCKET_ROWS + 1
    whole = F.conv(F.substring(draw_hash(F.concat_ws(":", *keys), 42), 1, 8), 16, 10).cast("bigint")
    types = dict(sizes.dtypes)
    schema = ", ".join(f"{k} {types[k]}" for k in keys) + ", block_part int, block bigint, offset int"
    dealt = sizes.withColumn("block_part", (whole % parts).cast("int"))
    return dealt.groupBy("block_part").applyInArrow(_best_fit(max_length, keys), schema)


def assemble_blocks(df: DataFrame, placed: DataFrame, keys: list[str], ids: str) -> DataFrame:
    """The ids of each block, in offset order. A block is bounded by its length."""
    parts = df.join(placed, keys).groupBy("block_part", "block").agg(
        F.array_sort(F.collect_list(F.struct("offset", F.col(ids).alias("ids")))).alias("_p")
    )
    return parts.select("block_part", "block", F.flatten("_p.ids").alias(ids))
