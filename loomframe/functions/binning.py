"""cut and findInterval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _label(a: float, b: float) -> str:
    return f"({a:g},{b:g}]"


def cut_breaks(c: Column, breaks: list[float], labels: list[str] | None = None) -> Column:
    """(a, b] of the sorted distinct breaks; missing outside."""
    at = sorted(set(breaks))
    names = labels or [_label(a, b) for a, b in zip(at, at[1:], strict=False)]
    out = F.lit(None).cast("string")
    for a, b, name in zip(at, at[1:], names, strict=False):
        out = F.when((c > a) & (c <= b), F.lit(name)).otherwise(out)
    return out


def cut_equal(df: DataFrame, column: str, bins: int, to: str = "bin") -> DataFrame:
    """Equal widths from the column's range; the place is floor((x - min) / width), the largest value in the last."""
    low, high = df.agg(F.min(column), F.max(column)).first()
    if low is None or bins < 1:
        return df.withColumn(to, F.lit(None).cast("string"))
    low, high = float(low), float(high)
    width = (high - low) / bins
    edges = [low + i * width for i in range(bins)] + [high]
    first = low - 0.001 * (high - low)
    names = [_label(first if i == 0 else edges[i], edges[i + 1]) for i in range(bins)]
    place = F.lit(0) if width == 0 else F.least(F.floor((F.col(column) - low) / width), F.lit(bins - 1)).cast("int")
    return df.withColumn(to, F.when(F.col(column).isNotNull(), F.element_at(F.array(*map(F.lit, names)), place + 1)))


def find_interval(c: Column, breaks: list[float], rightmost_closed: bool = False) -> Column:
    """How many of the sorted breaks are <= c; rightmost_closed: the last break belongs to the interval before it."""
    at = sorted(breaks)
    total = F.lit(0)
    for b in at:
        total = total + (c >= b).cast("int")
    return F.when(c == at[-1], F.lit(len(at) - 1)).otherwise(total) if rightmost_closed else total
