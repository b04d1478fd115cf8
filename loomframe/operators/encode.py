"""One-hot columns, factor interactions, design matrices."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.factors import domain


def one_hot(df: DataFrame, column: str, levels: Sequence[str] | None = None, drop_first: bool = False) -> DataFrame:
    """0/1 columns ``column.level``, then the other columns; missing values have 0 everywhere."""
    levels = list(levels or domain(df, column, 10_000))[1 if drop_first else 0 :]
    hot = [F.coalesce((F.col(column) == v).cast("int"), F.lit(0)).alias(f"{column}.{v}") for v in levels]
    return df.select(*hot, *(F.col(f"`{c}`") for c in df.columns if c != column))


def interaction(df: DataFrame, cols: Sequence[str], max_factors: int = 100, min_occurrence: int = 1, to: str | None = None) -> DataFrame:
    """``a_b`` of the columns' levels; only the most frequent ones are kept, the rest is ``other``.

    At most ``max_factors`` levels are kept, so the kept list is a small table of bounded size.
    """
    to = to or "_".join(cols)
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("NA")) for c in cols]
    made = df.withColumn(to, F.concat_ws("_", *parts))
    kept = made.groupBy(to).count().where(F.col("count") >= min_occurrence).orderBy(F.desc("count"), to).limit(max_factors).select(F.col(to).alias("_level"))
    return made.join(F.broadcast(kept), made[to] == kept["_level"], "left").select(*df.columns, F.coalesce("_level", F.lit("other")).alias(to))


def interactions(df: DataFrame, cols: Sequence[str], max_factors: int = 100, min_occurrence: int = 1) -> DataFrame:
    """All pairs of three or more columns."""
    for a, b in combinations(cols, 2):
        df = interaction(df, [a, b], max_factors, min_occurrence)
    return df


def design(df: DataFrame, cols: Sequence[str], standardize: bool = True, drop_first: bool = True, missing: str = "skip", most_missing: float = 0.2) -> tuple[DataFrame, list[str]]:
    """(frame with ``features`` columns added, their names): factors one-hot, numbers standardised.

    missing: 'skip' drops rows with a missing cell; 'level' gives factors a level of their own and numbers the mean.
    Constant columns and those that miss more than ``most_missing`` are left out.
    """
    types = dict(df.dtypes)
    stats = df.agg(F.count("*").alias("n"), *(x for i, c in enumerate(cols) for x in ((F.count(c)).alias(f"c{i}"), (F.min(c) == F.max(c)).alias(f"k{i}"), *((F.avg(c).alias(f"m{i}"), F.stddev_samp(c).alias(f"s{i}")) if types[c] != "string" else ())))).first()
    used = [(i, c) for i, c in enumerate(cols) if stats["n"] and stats[f"c{i}"] >= (1 - most_missing) * stats["n"] and not stats[f"k{i}"]]
    if missing == "skip":
        df = df.dropna(subset=[c for _, c in used]) if used else df
    out, names = [], []
    for i, c in used:
        if types[c] == "string":
            x = F.coalesce(F.col(c), F.lit("missing"))
            levels = domain(df, c, 10_000)[1 if drop_first else 0 :] + (["missing"] if missing == "level" else [])
            out += [(x == v).cast("double").alias(f"{c}.{v}") for v in levels]
            names += [f"{c}.{v}" for v in levels]
        else:
            x = F.coalesce(F.col(c).cast("double"), F.lit(stats[f"m{i}"]))
            out.append(((x - stats[f"m{i}"]) / stats[f"s{i}"] if standardize and stats[f"s{i}"] else x).alias(f"x.{c}"))
            names.append(f"x.{c}")
    return df.select("*", *out), names


def top_levels(df: DataFrame, column: str, n: int) -> DataFrame:
    """The n most frequent levels with counts and ranks."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).count().orderBy(F.desc("count"), column).limit(n)
    return counts.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("count"), column)))
