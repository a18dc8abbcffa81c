"""Tagged segments out of text, and row filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from molcorpus.functions import patterns as P
from molcorpus.functions.text import find_all, strip


def normalise_text(df: DataFrame, col: str) -> DataFrame:
    """Keep one text column and call it ``text``."""
    return df.select(F.col(col).alias("text"))


def segments_of(text: Column) -> Column:
    """Tagged segments of one text, trimmed, blanks dropped; tags may be lines apart."""
    found = F.transform(find_all(text, P.TAGGED, 1), strip)
    return F.array_remove(F.coalesce(found, F.array().cast("array<string>")), "")


def extract_segments(df: DataFrame, key: str, col: str) -> DataFrame:
    """One row per tagged segment: ``(key, seg, smi)``. Null text has none."""
    return df.select(key, F.posexplode(segments_of(F.col(col))).alias("seg", "smi"))


def segment_set(text: Column) -> Column:
    """Distinct trimmed segments whose tags stand on one line."""
    found = F.transform(find_all(text, P.TAGGED_ONE_LINE, 1), strip)
    return F.array_distinct(F.coalesce(found, F.array().cast("array<string>")))


def wrap_tags(smi: Column) -> Column:
    return F.concat(F.lit(P.START_TAG), smi, F.lit(P.END_TAG))


def _present(df: DataFrame, col: str) -> Column:
    present = F.col(col).isNotNull()
    if dict(df.dtypes)[col] in ("float", "double"):
        present &= ~F.isnan(col)
    return present


def drop_null_labels(df: DataFrame, col: str) -> DataFrame:
    return df.filter(_present(df, col))


def null_label_count(df: DataFrame, col: str) -> DataFrame:
    """How many rows ``drop_null_labels`` leaves out and keeps."""
    kept = _present(df, col)
    return df.agg(
        F.count_if(~kept).alias("n_dropped"), F.count_if(kept).alias("n_kept")
    )


def mcq_only(df: DataFrame) -> DataFrame:
    """Questions graded as multiple choice and nothing else."""
    return df.filter(F.col("metrics") == F.array(F.lit("multiple_choice_grade")))
