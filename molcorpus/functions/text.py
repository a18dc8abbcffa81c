"""Small string Columns shared by the operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from molcorpus.functions import patterns as P


def strip(col: Column) -> Column:
    """Remove whitespace of any script from both ends."""
    return F.regexp_replace(col, P.STRIP, "")


def words(col: Column) -> Column:
    """Whitespace-separated words, as an array without empty entries."""
    return F.array_remove(F.split(col, P.SPACES), "")


def find_all(col: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(col, F.lit(pattern), F.lit(group))


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times inside a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def draw_hash(key: Column, seed: int) -> Column:
    """Reproducible uniform hex string per (seed, key)."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def draw(key: Column, seed: int) -> Column:
    """Reproducible uniform number in [0, 1) per (seed, key)."""
    head = F.conv(F.substring(draw_hash(key, seed), 1, 8), 16, 10)
    return head.cast("bigint") / F.lit(4294967296.0)


def entries(df: DataFrame, keep: list[str], col: str, pos: str, name: str) -> DataFrame:
    """One row per array entry. Rows without entries are dropped after the explode:
    before it, the optimizer would compute the array once more to test it."""
    exploded = df.select(*keep, F.posexplode_outer(col).alias(pos, name))
    return exploded.filter(F.col(pos).isNotNull())
