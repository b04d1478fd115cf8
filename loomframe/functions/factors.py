"""Factors: text columns whose sorted levels have codes from 0."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.frame import with_rows

#: More levels than this and a column is not taken for a factor.
MOST_LEVELS = 1_000_000


def levels(df: DataFrame, column: str) -> DataFrame:
    """One row per level with its code, sorted by level."""
    found = df.where(F.col(column).isNotNull()).select(F.col(column).cast("string").alias("level")).distinct()
    return with_rows(found, ["level"], "code").withColumn("code", F.col("code") - 1)


def domain(df: DataFrame, column: str, most: int = MOST_LEVELS) -> list[str]:
    """The sorted levels, on the driver; more than ``most`` is an error."""
    found = df.where(F.col(column).isNotNull()).select(F.col(column).cast("string").alias("level")).distinct().limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"{column} has more than {most} levels")
    return sorted(r.level for r in found)


def codes(df: DataFrame, column: str, to: str | None = None) -> DataFrame:
    """``column`` (or a new one) as the code of its level; the level table is joined, not collected."""
    known = levels(df, column)
    out = df.join(known, df[column].cast("string") == known["level"], "left").drop("level")
    to = to or column
    return out.select(*(c for c in df.columns if c != to), F.col("code").alias(to)) if to not in df.columns else out.select(*(F.col("code").alias(c) if c == to else c for c in df.columns))


def factor(c: Column) -> Column:
    """A whole number as the level that spells it; other numbers are an error."""
    d = c.cast("double")
    return F.when(d.isNull(), None).when(d == F.floor(d), d.cast("long").cast("string")).otherwise(F.raise_error(F.lit("a factor needs whole numbers")).cast("string"))


def set_level(df: DataFrame, column: str, level: str) -> DataFrame:
    """The column constant at one of its levels."""
    if df.where(F.col(column) == level).limit(1).count() == 0:
        raise ValueError(f"{level} is not a level of {column}")
    return df.withColumn(column, F.lit(level))
