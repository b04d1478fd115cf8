"""Splits, folds and samples that do not depend on partitioning: a seed and key columns decide each row's place."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sequences import unit_hash
from .frame import with_rows


def split(df: DataFrame, ratios: Sequence[float], order: Sequence[str]) -> DataFrame:
    """``split`` 0..k for contiguous parts by the order, the last one taking the rest."""
    numbered = with_rows(df, order, "_row")
    n = numbered.count()
    at, edge = F.lit(len(ratios)), 0.0
    edges = []
    for r in ratios:
        edge += r
        edges.append(int(edge * n))
    for i in range(len(ratios) - 1, -1, -1):
        at = F.when(F.col("_row") <= edges[i], F.lit(i)).otherwise(at)
    return numbered.withColumn("split", at).drop("_row")


def split_shuffled(df: DataFrame, ratios: Sequence[float], keys: Sequence[str], seed: int = 1) -> DataFrame:
    """As ``split``, by a hash: no sort, sizes approximate."""
    u, at, edge = unit_hash(seed, *map(F.col, keys)), F.lit(len(ratios)), sum(ratios)
    for i in range(len(ratios) - 1, -1, -1):
        at = F.when(u < edge, F.lit(i)).otherwise(at)
        edge -= ratios[i]
    return df.withColumn("split", at)


def nfold(df: DataFrame, k: int, order: Sequence[str]) -> DataFrame:
    """``fold`` 0..k-1 of contiguous parts by the order."""
    numbered = with_rows(df, order, "_row")
    n = numbered.count()
    return numbered.withColumn("fold", F.floor((F.col("_row") - 1) * k / F.lit(max(1, n))).cast("int")).drop("_row")


def modulo_fold(df: DataFrame, k: int, order: Sequence[str]) -> DataFrame:
    return with_rows(df, order, "_row").withColumn("fold", F.pmod(F.col("_row") - 1, F.lit(k)).cast("int")).drop("_row")


def sample(df: DataFrame, n: int, keys: Sequence[str], seed: int = 1) -> DataFrame:
    """Exactly n rows (or all) without replacement."""
    return df.orderBy(F.xxhash64(F.lit(seed), *keys), *keys).limit(n)


def bernoulli(df: DataFrame, fraction: float, keys: Sequence[str], seed: int = 1) -> DataFrame:
    return df.where(unit_hash(seed, *map(F.col, keys)) < fraction)


def runif(df: DataFrame, keys: Sequence[str], seed: int = 1, low: float = 0.0, high: float = 1.0) -> DataFrame:
    return df.withColumn("rnd", unit_hash(seed, *map(F.col, keys)) * (high - low) + low)


def stratified(df: DataFrame, label: str, keys: Sequence[str], factors: dict, seed: int = 1) -> DataFrame:
    """Each class repeated or thinned by its factor: floor(f) copies and one more with the chance of the rest."""
    f = F.lit(1.0)
    for value, factor in factors.items():
        f = F.when(F.col(label) == value, F.lit(float(factor))).otherwise(f)
    times = (F.floor(f) + (unit_hash(seed, *map(F.col, keys)) < f - F.floor(f)).cast("int")).cast("int")
    return df.withColumn("_times", times).where("_times > 0").select(*df.columns, F.explode(F.sequence(F.lit(1), F.col("_times"))).alias("_copy")).drop("_copy")


def balanced(df: DataFrame, label: str, keys: Sequence[str], max_after: float = 5.0, seed: int = 1) -> DataFrame:
    """Classes brought to the size of the largest, the whole to at most ``max_after`` times the rows."""
    counts = {r[0]: r[1] for r in df.where(F.col(label).isNotNull()).groupBy(label).count().collect()}
    most, n = max(counts.values()), sum(counts.values())
    shrink = min(1.0, max_after * n / (most * len(counts)))
    return stratified(df, label, keys, {k: most / c * shrink for k, c in counts.items()}, seed)


def shuffle_rows(df: DataFrame, keys: Sequence[str], seed: int = 1) -> DataFrame:
    """Rows of each partition in random order."""
    return df.sortWithinPartitions(F.xxhash64(F.lit(seed), *keys))


def rebalance(df: DataFrame, n: int) -> DataFrame:
    return df.repartition(n)


def insert_missing(df: DataFrame, fraction: float, keys: Sequence[str], cols: Sequence[str] | None = None, seed: int = 1) -> DataFrame:
    """Each cell of the columns becomes missing with a chance of ``fraction``."""
    cols = list(cols or [c for c in df.columns if c not in keys])
    return df.select(*(F.when(unit_hash(seed + i, *map(F.col, keys)) >= fraction, F.col(c)).alias(c) if c in cols else F.col(c) for i, c in enumerate(df.columns)))
