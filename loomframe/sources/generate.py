"""Random frames that are the same at any partitioning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sequences import unit_hash


def create_frame(spark: SparkSession, rows: int, cols: int, seed: int = 1, categorical: float = 0.2, integer: float = 0.2, binary: float = 0.1, missing: float = 0.01, real_range: float = 100.0, integer_range: int = 100, levels: int = 100, response: int = 0) -> DataFrame:
    """``id`` and C1..C<cols>: factors, then whole numbers, then 0/1, then reals, by their shares.

    response: number of levels of a response column (1: a real number, 0: none).
    """
    if categorical + integer + binary > 1:
        raise ValueError("shares add up to more than 1")
    n_cat, n_int, n_bin = round(cols * categorical), round(cols * integer), round(cols * binary)
    out = [F.col("id")]
    for i in range(cols):
        u = unit_hash(seed * 7919 + i, F.col("id"))
        if i < n_cat:
            value = F.concat(F.lit(f"c{i + 1}.l"), F.floor(u * levels).cast("string"))
        elif i < n_cat + n_int:
            value = F.floor(u * (2 * integer_range + 1)) - integer_range
        elif i < n_cat + n_int + n_bin:
            value = (u < 0.5).cast("long")
        else:
            value = (u * 2 - 1) * real_range
        gone = unit_hash(seed * 7919 + i + 1_000_003, F.col("id")) < missing
        out.append(F.when(~gone, value).alias(f"C{i + 1}"))
    if response:
        u = unit_hash(seed * 7919 - 1, F.col("id"))
        out.append((u if response == 1 else F.floor(u * response)).alias("response"))
    return spark.range(rows).select(*out)
