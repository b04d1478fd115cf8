"""Sequences and constant or random columns."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def seq_len(spark: SparkSession, n: int) -> DataFrame:
    if n <= 0:
        raise ValueError("seq_len needs a positive length")
    return spark.range(1, n + 1).select(F.col("id").cast("double").alias("C1"))


def seq(spark: SparkSession, start: float, stop: float, by: float = 1.0) -> DataFrame:
    if by == 0 or (stop - start) * by < 0:
        raise ValueError("wrong sign in 'by'")
    n = math.floor((stop - start) / by + 1e-10) + 1
    return spark.range(n).select((F.col("id") * by + start).alias("C1"))


def span(spark: SparkSession, start: float, stop: float) -> DataFrame | float:
    """start:stop; one value is a scalar."""
    return start if start == stop else seq(spark, start, stop, 1.0 if stop > start else -1.0)


def rep_len(spark: SparkSession, value: float, n: int) -> DataFrame:
    return spark.range(n).select(F.lit(float(value)).alias("C1"))


def unit_hash(seed: int, *cols: Column) -> Column:
    """Uniform in [0, 1) from a seed and key columns: the same at any partitioning."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *cols), 11) / F.lit(float(1 << 53))
