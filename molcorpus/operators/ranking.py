"""Row numbers, prefixes and seeded choices over tables of any size."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from molcorpus.functions.text import draw_hash
from molcorpus.session import materialize

# Up to this many narrow rows are ordered in one task.
ONE_TASK_ROWS = 1_000_000


WHOLE = ("tinyint", "smallint", "int", "bigint")


def place(df: DataFrame, order: list[str]) -> Column:
    """One sortable value for a place in the corpus. Up to three whole-number
    columns (a 64-bit key, then counters below a billion) are packed into a
    decimal, whose minimum is taken by hash aggregation; a struct would be sorted."""
    types = dict(df.dtypes)
    if len(order) > 3 or any(types[c] not in WHOLE for c in order):
        return F.struct(*order)
    return _packed([F.col(c) for c in order])


def _packed(numbers: list[Column]) -> Column:
    digits = F.lit(0).cast("decimal(38,0)")
    for i, number in enumerate(numbers):
        shift = F.lit(str(10 ** (9 * (2 - i)))).cast("decimal(19,0)")
        digits = digits + number.cast("decimal(19,0)") * shift
    return digits.cast("decimal(38,0)")


# Bits of up to three numbers that are packed into one of 63.
BITS = {1: [63], 2: [33, 30], 3: [33, 10, 20]}


def _short(numbers: list[Column]) -> tuple[Column, Column]:
    """Whether numbers fit into one bigint that sorts as they do, and that bigint: decimals of
    this size are slow when every token of a corpus has one."""
    fits, short = F.lit(True), F.lit(0).cast("bigint")
    for number, bits in zip(numbers, BITS[len(numbers)]):
        fits &= number.cast("bigint").between(0, (1 << bits) - 1)
        short = (F.shiftleft(short, bits) if bits < 63 else short).bitwiseOR(number.cast("bigint"))
    return fits, short


def _lengthened(short: Column, n: int) -> list[Column]:
    numbers = []
    for bits in reversed(BITS[n]):
        numbers.insert(0, short.bitwiseAND(F.lit((1 << bits) - 1)))
        short = F.shiftright(short, bits) if bits < 63 else short
    return numbers


def first_places(df: DataFrame, by: str, order: list[str], count: Column, name: str) -> DataFrame:
    """Per value of ``by`` the first place in ``order`` (as ``first``) and a sum or count
    (as ``name``), by hash aggregation throughout. A key that is no whole number, such as
    a text id, is replaced by its rank: entries are combined per key first, and then meet
    the ranks."""
    key, *rest = order
    types = dict(df.dtypes)
    if len(order) <= 3 and all(types[c] in WHOLE for c in order):
        fits, short = _short([F.col(c) for c in order])
        rows = df.groupBy(by).agg(
            F.min(F.when(fits, short)).alias("_short"),
            F.min(F.when(~fits, place(df, order))).alias("_long"),
            count.alias(name),
        )
        first = F.least(_packed(_lengthened(F.col("_short"), len(order))), "_long").alias("first")
        return rows.select(by, first, name)
    if types[key] in WHOLE or len(order) > 3:
        return df.groupBy(by).agg(F.min(place(df, order)).alias("first"), count.alias(name))
    inner = _packed([F.lit(0), *map(F.col, rest)])
    per_key = df.groupBy(by, key).agg(F.min(inner).alias("_inner"), count.alias(name))
    ranks = rank_rows(df.select(key).distinct(), [key], name="_rank")
    first = (_packed([F.col("_rank")]) + F.col("_inner")).cast("decimal(38,0)")
    joined = per_key.join(ranks, key).withColumn("_first", first)
    return joined.groupBy(by).agg(F.min("_first").alias("first"), F.sum(name).alias(name))


def rank_rows(df: DataFrame, order: list, within: list[str] | None = None, name: str = "rank") -> DataFrame:
    """Number rows from 0 in the given order, per value of ``within``.

    Rows are range-partitioned by the order itself, so a value of ``within`` that
    holds a large share of them is spread over many tasks. The range bounds are
    sampled, so the placed rows are written once: counts and row numbers come
    from the same placement. Give narrow rows (keys only) and join the rest back.
    """
    within = within or []
    placed = materialize(
        df.repartitionByRange(*within, *order).withColumn("_part", F.spark_partition_id())
    )
    # One row per task and group.
    counts = placed.groupBy(*within, "_part").agg(F.count(F.lit(1)).alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy(*within).orderBy("_part"))
    before = counts.select(*within, "_part", (upto - F.col("_n")).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(*within, "_part").orderBy(*order)) - 1
    return (
        placed.withColumn("_inside", inside)
        .join(before, [*within, "_part"])
        .withColumn(name, (F.col("_before") + F.col("_inside")).cast("bigint"))
        .drop("_part", "_before", "_inside")
    )


def number_rows(df: DataFrame, order: list, start: int = 0, name: str = "id") -> DataFrame:
    """Consecutive numbers in the given order, for vocabulary-like tables."""
    stored = materialize(df)
    if stored.count() > ONE_TASK_ROWS:
        ranked = rank_rows(stored, order, name="_rank")
        return ranked.withColumn(name, F.col("_rank") + start).drop("_rank")
    number = F.row_number().over(Window.orderBy(*order))
    return stored.withColumn(name, (number + (start - 1)).cast("bigint"))


def nth_smallest(df: DataFrame, col: str, n: int):
    """The exact n-th smallest value (from 1) of a numeric column.

    Approximate percentiles bracket it, one pass counts around the bracket, and
    only the rows strictly inside stay for the next round.
    """
    rows = df.select(col).filter(F.col(col).isNotNull())
    total = rows.count()
    while total > ONE_TASK_ROWS:
        share = n / total
        low, high = rows.agg(
            F.percentile_approx(col, [max(0.0, share - 1e-3), min(1.0, share + 1e-3)], 10_000)
        ).first()[0]
        below, upto, below_high = rows.agg(
            F.count_if(F.col(col) < low), F.count_if(F.col(col) <= low), F.count_if(F.col(col) < high)
        ).first()
        if below < n <= upto:
            return low
        if n > below_high:
            return high
        rows = rows.filter((F.col(col) > low) & (F.col(col) < high))
        n, total = n - upto, below_high - upto
    return rows.orderBy(col).limit(n).agg(F.max(col)).first()[0]


def first_rows(df: DataFrame, keys: list[str], n: int, narrow: DataFrame | None = None) -> DataFrame:
    """The first n rows in key order, as a filter on the key of the n-th row: nothing
    is sorted or moved but keys, and the filter reaches the scan. Keys are, together,
    unique; ``narrow`` holds them alone, where they are costly to compute. Numbers are
    cut by counting, other keys by their ranks."""
    if n <= 0:
        return df.filter(F.lit(False))
    narrow = df.select(*keys) if narrow is None else narrow
    if any(t not in (*WHOLE, "float", "double", "date", "timestamp") and not t.startswith("decimal") for _, t in narrow.dtypes):
        last = rank_rows(narrow, keys, name="_rank").filter(F.col("_rank") == n - 1).select(*keys).first()
        if last is None:
            return df
        reach = F.col(keys[0]) <= last[0]
        return df.filter(reach & (F.struct(*keys) <= F.struct(*[F.lit(v).cast(t) for v, (_, t) in zip(last, narrow.dtypes)])))
    rest, keep, same, reach = narrow, F.lit(False), F.lit(True), F.lit(True)
    for i, key in enumerate(keys):
        cut = nth_smallest(rest, key, n)
        if i == 0:
            reach = F.col(key) <= cut  # implied, but the scan can use it
        last = i == len(keys) - 1
        keep |= same & ((F.col(key) <= cut) if last else (F.col(key) < cut))
        same &= F.col(key) == cut
        if not last:
            n -= rest.filter(F.col(key) < cut).count()
            rest = rest.filter(F.col(key) == cut)
    return df.filter(reach & keep)


def portion(df: DataFrame, keys: list[str], share: float) -> DataFrame:
    """The first ``int(rows * share)`` rows in key order."""
    if share >= 1:
        return df
    narrow = materialize(df.select(*keys))
    return first_rows(df, keys, int(narrow.count() * share), narrow)


def cap(df: DataFrame, keys: list[str], n: int) -> DataFrame:
    """At most the first n rows in key order."""
    narrow = materialize(df.select(*keys))
    return df if narrow.count() <= n else first_rows(df, keys, n, narrow)


def _key(keys: list[str]) -> Column:
    return F.concat_ws(":", *keys)


def hash_cut(df: DataFrame, keys: list[str], seed: int, n_of) -> str | None:
    """The n-th smallest seeded hash, where ``n_of(total)`` gives n; a value after
    all hashes when there are fewer rows, None for n = 0.

    A histogram over four hex digits at a time (at most 65,536 rows) finds the
    bucket of the n-th row, until the bucket is small enough to be ordered.
    """
    hashed = df.select(draw_hash(_key(keys), seed).alias("h"))
    prefix, n = "", None
    while True:
        digits = F.substring("h", len(prefix) + 1, 4).alias("digits")
        histogram = sorted(hashed.groupBy(digits).count().collect())
        n = n_of(sum(row["count"] for row in histogram)) if n is None else n
        if n <= 0:
            return None
        for row in histogram:
            if n <= row["count"]:
                break
            n -= row["count"]
        else:
            return "g"  # follows every hex digit
        prefix += row["digits"]
        hashed = hashed.filter(F.col("h").startswith(prefix))
        if row["count"] <= ONE_TASK_ROWS or len(prefix) == 32:
            return hashed.orderBy("h").limit(n).agg(F.max("h")).first()[0]


def sample_n(df: DataFrame, keys: list[str], n: int, seed: int = 42) -> DataFrame:
    """n reproducible uniform rows (all of them when there are no more than n).
    Keys are, together, unique."""
    cut = hash_cut(df, keys, seed, lambda total: n)
    if cut is None:
        return df.filter(F.lit(False))
    return df.filter(draw_hash(_key(keys), seed) <= cut)


def split(df: DataFrame, keys: list[str], ratio: float, seed: int = 42) -> DataFrame:
    """Add ``part``: 'test' for ``ceil(rows * ratio)`` reproducible rows, else 'train'."""
    cut = hash_cut(df, keys, seed, lambda total: math.ceil(total * ratio))
    is_test = F.lit(False) if cut is None else draw_hash(_key(keys), seed) <= cut
    return df.withColumn("part", F.when(is_test, "test").otherwise("train"))
