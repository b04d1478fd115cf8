"""Split-apply-combine, imputation, distinct rows, top rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import reduce

MOST_KEYS = 1000


def ddply(df: DataFrame, keys: Sequence[str], aggs: dict[str, Column], drop_na: bool = True) -> DataFrame:
    """One row per group from aggregates: partial sums before the shuffle.  Rows with a missing cell go, as keys do."""
    if not 1 <= len(keys) <= MOST_KEYS:
        raise ValueError(f"1 to {MOST_KEYS} keys")
    out = df.groupBy(*keys).agg(*(c.alias(n) for n, c in aggs.items()))
    return out.dropna() if drop_na else out


def ddply_function(df: DataFrame, keys: Sequence[str], fun: Callable, schema: str, drop_na: bool = True) -> DataFrame:
    """One row per group from any function of the group's pandas frame, for bodies that are not aggregates.

    A group is one task's: where a group can be large, state it as aggregates.
    """
    types = dict(df.dtypes)
    head = ", ".join(f"`{k}` {types[k]}" for k in keys)

    def run(key, pdf):
        import pandas as pd

        made = fun(pdf)
        made = list(made) if isinstance(made, (list, tuple)) else [made]
        return pd.DataFrame([[*key, *made]])

    out = df.groupBy(*keys).applyInPandas(run, f"{head}, {schema}")
    return out.dropna() if drop_na else out


def each_row(df: DataFrame, fun: Callable[..., Column | Sequence[Column]], cols: Sequence[str] | None = None) -> DataFrame:
    """A function of a row's cells, given as columns, as C1, C2, ..: expressions, not a call for each row."""
    made = fun(*(F.col(f"`{c}`") for c in cols or df.columns))
    made = list(made) if isinstance(made, (list, tuple)) else [made]
    return df.select("*", *(m.alias(f"C{i + 1}") for i, m in enumerate(made)))


def apply_rows(df: DataFrame, how: str, cols: Sequence[str] | None = None) -> DataFrame:
    """A reducer over each row's cells as column C1: an expression, not a function call per row."""
    cols = list(cols or df.columns)
    xs = [F.col(c).cast("double") for c in cols]
    total = xs[0]
    for x in xs[1:]:
        total = total + x
    some_missing = F.greatest(*(x.isNull().cast("int") for x in xs)) == 1 if len(xs) > 1 else xs[0].isNull()
    made = {"sum": total, "mean": total / len(xs), "min": F.least(*xs) if len(xs) > 1 else xs[0], "max": F.greatest(*xs) if len(xs) > 1 else xs[0]}[how]
    return df.select("*", F.when(~some_missing, made).alias("C1"))


def apply_cols(df: DataFrame, how: Callable[[Column], Column], cols: Sequence[str] | None = None) -> DataFrame:
    """A reducer over each column, as (column, C1) rows, from one pass."""
    cols = list(cols or df.columns)
    one = df.agg(*(how(F.col(c)).cast("double").alias(f"_{i}") for i, c in enumerate(cols)))
    return one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"_{i}").alias("C1")) for i, c in enumerate(cols)))).alias("r")).select("r.*")


def map_rows(df: DataFrame, fun: Callable, schema: str) -> DataFrame:
    """Any function from pandas frames to pandas frames, over Arrow batches."""
    return df.mapInPandas(lambda batches: (fun(b) for b in batches), schema)


def impute(df: DataFrame, column: str, method: str = "mean", by: Sequence[str] = ()) -> DataFrame:
    """Missing cells get the mean, median or mode of the column or of the row's group (keys compared with missing ones).

    Texts always take the mode.  A column or group without values stays missing.
    """
    text = dict(df.dtypes)[column] == "string"
    c, how = F.col(column), "mode" if text else method
    value = F.mode(c, True) if how == "mode" else F.avg(c)
    if not by:
        fill = reduce.quantiles(df, column, [0.5])[0] if how == "median" else df.agg(value.alias("v")).first()[0]
        return df if fill is None else df.withColumn(column, F.coalesce(c, F.lit(fill)))
    found = reduce.grouped_quantile(df, by, column, 0.5, "_fill") if how == "median" else df.groupBy(*by).agg(value.alias("_fill"))
    stats = found.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(by)), "_fill")
    on = None
    for i, k in enumerate(by):
        same = df[k].eqNullSafe(stats[f"_k{i}"])
        on = same if on is None else on & same
    # no hint: the planner broadcasts the statistics where their measured size allows it
    return df.join(stats, on, "left").select(*(F.coalesce(c, F.col("_fill")).alias(n) if n == column else F.col(n) for n in df.columns))


def unique(df: DataFrame) -> DataFrame:
    return df.distinct()


def order(df: DataFrame, column: str, n: int = 10, reverse: bool = False, ties: Sequence[str] = ()) -> DataFrame:
    """The n smallest (reverse: largest) values' rows; missing and NaN values are never taken."""
    if n > 10_000:
        raise ValueError("at most 10000 rows")
    some = df.where(F.col(column).isNotNull() & ~F.isnan(F.col(column).cast("double")))
    return some.orderBy(F.desc(column) if reverse else F.asc(column), *ties).limit(n)


def word_count(df: DataFrame, column: str) -> DataFrame:
    return df.select(F.explode(F.split(F.col(column), r"\s+")).alias("word")).where("word <> ''").groupBy("word").count()


def class_distribution(df: DataFrame, column: str) -> DataFrame:
    return reduce.table(df, column)


def scale(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """(x - mean) / sd of the numeric columns; others pass through.  The statistics are a single row of numbers."""
    numeric = [f.name for f in df.schema.fields if f.dataType.typeName() in ("integer", "long", "double", "float", "short", "byte")]
    cols = [c for c in (cols or numeric) if c in numeric]
    if not cols:
        return df
    stats = df.agg(*(x for i, c in enumerate(cols) for x in (F.avg(c).alias(f"m{i}"), F.stddev_samp(c).alias(f"s{i}")))).first()
    put = {c: ((F.col(c) - F.lit(stats[f"m{i}"])) / F.lit(stats[f"s{i}"]) if stats[f"s{i}"] else F.lit(None).cast("double")).alias(c) for i, c in enumerate(cols)}
    return df.select(*(put.get(c, F.col(c)) for c in df.columns))
