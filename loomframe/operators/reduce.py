"""Reducers over columns, quantiles, tables, covariance, summaries."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arithmetic import number
from .frame import with_rows


def poisoned(c: Column, how: Column) -> Column:
    """The aggregate, or missing if any value is."""
    return F.when(F.count("*") == F.count(c), how)


def total(c: Column, na_rm: bool = False) -> Column:
    return F.coalesce(F.sum(c), F.lit(0)) if na_rm else poisoned(c, F.coalesce(F.sum(c), F.lit(0)))


def least(c: Column, na_rm: bool = False) -> Column:
    return F.min(c) if na_rm else poisoned(c, F.min(c))


def greatest(c: Column, na_rm: bool = False) -> Column:
    return F.max(c) if na_rm else poisoned(c, F.max(c))


def fold(df: DataFrame, how: str, cols: Sequence[str] | None = None, na_rm: bool = False) -> float | None:
    """sum, min or max over all cells of the columns, in one job."""
    cols = list(cols or df.columns)
    one = {"sum": total, "min": least, "max": greatest}[how]
    row = df.agg(*(one(number(F.col(c)), na_rm).alias(f"_{i}") for i, c in enumerate(cols))).first()
    values = [v for v in row if v is not None]
    if len(values) < len(cols) and not na_rm or not values:
        return None
    return {"sum": sum, "min": min, "max": max}[how](values)


def mean(c: Column) -> Column:
    return F.avg(c)


def sd(c: Column) -> Column:
    return F.stddev_samp(c)


#: So many values are ordered on the driver at the end of a narrowing, whatever the number of rows.
FEW = 20_000


def order_statistics(df: DataFrame, column: str, places: Callable[[int], Sequence[int]], bins: int = 1000) -> dict[int, float]:
    """place -> value of the sorted column (places from 0; missing values go), from ``places(number of values)``.

    Histograms narrow each place's range: a pass counts at most ``bins`` cells for each range, so memory does not follow
    the data.  Ranges of few values are read whole.
    """
    x = df.select(number(F.col(f"`{column}`")).alias("x")).where("x IS NOT NULL")
    n, low, high = x.agg(F.count("*"), F.min("x"), F.max("x")).first()
    wanted = sorted(set(places(n))) if n else []
    out = {w: low for w in wanted} if low == high else {}
    spans = {(low, high): (0, n)}  # range -> values before it, values in it
    while len(out) < len(wanted):
        if any(not 0 < (b - a) / bins < float("inf") for a, b in spans):  # endless or too narrow to be cut: by row numbers
            rows = with_rows(x, ["x"], "row").where((F.col("row") - 1).isin([w for w in wanted if w not in out]))
            return out | {r.row - 1: r.x for r in rows.collect()}
        few = [s for s, (_, size) in spans.items() if size <= FEW]
        if few and sum(spans[s][1] for s in few) <= 4 * FEW:
            held = x.where(_within(few)).collect()
            for a, b in few:
                values, before = sorted(r.x for r in held if a <= r.x <= b), spans[a, b][0]
                out |= {w: values[w - before] for w in wanted if before <= w < before + len(values)}
        many = [s for s in spans if not (few and s in few and sum(spans[f][1] for f in few) <= 4 * FEW)]
        if not many:
            break
        cell = lambda s: F.least(F.floor((F.col("x") - s[0]) / ((s[1] - s[0]) / bins)), F.lit(bins - 1)).cast("int")
        cells = F.explode(F.array_compact(F.array(*(F.when(F.col("x").between(*s), F.struct(F.lit(k).alias("s"), cell(s).alias("k"))) for k, s in enumerate(many)))))
        counts = x.where(_within(many)).select("x", cells.alias("c")).groupBy("c.s", "c.k").agg(F.count("*").alias("n"), F.min("x").alias("a"), F.max("x").alias("b")).orderBy("s", "k").collect()
        then = {}
        for k, span in enumerate(many):
            before = spans[span][0]
            for r in (r for r in counts if r.s == k):
                own = [w for w in wanted if before <= w < before + r.n and w not in out]
                if own and r.a == r.b:
                    out |= dict.fromkeys(own, r.a)
                elif own:
                    then[r.a, r.b] = (before, r.n)
                before += r.n
        spans = then
    return out


def _within(spans: Sequence[tuple[float, float]]) -> Column:
    out = F.lit(False)
    for a, b in spans:
        out = out | F.col("x").between(a, b)
    return out


def quantiles(df: DataFrame, column: str, probs: Sequence[float]) -> list[float | None]:
    """Exact, with linear interpolation between order statistics (type 7)."""
    ends = lambda n: [(p, int(p * (n - 1)), min(n - 1, int(p * (n - 1)) + 1), p * (n - 1) - int(p * (n - 1))) for p in probs]
    size = []
    got = order_statistics(df, column, lambda n: size.append(n) or [w for _, a, b, _ in ends(n) for w in (a, b)])
    return [got[a] + (got[b] - got[a]) * f for _, a, b, f in ends(size[0])] if got else [None] * len(probs)


def grouped_quantile(df: DataFrame, keys: Sequence[str], column: str, prob: float, to: str = "quantile") -> DataFrame:
    """The keys and the exact quantile (type 7) of each group: groups and values are sorted together by ranges, so that a
    group of any size is spread over tasks, and two rows of each group are picked by number."""
    some = df.select(*(F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(keys)), number(F.col(f"`{column}`")).alias("x")).where("x IS NOT NULL")
    names = [f"k{i}" for i in range(len(keys))]
    numbered = with_rows(some, [*names, "x"], "row")
    place = F.lit(prob) * (F.col("n") - 1)
    at = numbered.groupBy(*names).agg(F.min("row").alias("first"), F.count("*").alias("n")).select("first", *(F.col(k).alias(f"g{k}") for k in names), F.floor(place).alias("low"), (place - F.floor(place)).alias("part"), "n")
    ends = at.select("*", F.explode(F.array("low", F.least(F.col("low") + 1, F.col("n") - 1))).alias("w")).withColumn("row", F.col("first") + F.col("w"))
    values = ends.join(numbered.select("row", "x"), "row").groupBy(*(f"g{k}" for k in names), "part").agg(F.min("x").alias("a"), F.max("x").alias("b"))
    return values.select(*(F.col(f"gk{i}").alias(k) for i, k in enumerate(keys)), (F.col("a") + (F.col("b") - F.col("a")) * F.col("part")).alias(to))


def quantile_mean(df: DataFrame, column: str, prob: float) -> float | None:
    """Type 2: the mean of the two order statistics where the place falls between them."""
    ends = lambda n: (max(0, min(n - 1, int(prob * n) - (prob * n == int(prob * n)))), max(0, min(n - 1, int(prob * n))))
    size = []
    got = order_statistics(df, column, lambda n: size.append(n) or ends(n))
    return sum(got[w] for w in ends(size[0])) / 2 if got else None


def multi_pass_quantile(df: DataFrame, column: str, prob: float) -> float | None:
    return quantiles(df, column, [prob])[0]


def mode(c: Column) -> Column:
    """The most frequent level, the first in order of equals; the level NA is skipped."""
    return F.mode(F.when(c != "NA", c), True)


def xorsum(df: DataFrame, column: str) -> float:
    """XOR of the doubles' bits without the top four; partial results of tasks are combined by XOR again."""
    import numpy as np
    import pyarrow as pa

    schema = pa.schema([("b", pa.int64())])

    def run(batches):
        out = np.uint64(0)
        for batch in batches:
            x = np.asarray(batch.column(0).fill_null(0.0), dtype=np.float64).view(np.uint64)
            out ^= np.bitwise_xor.reduce(x) if len(x) else np.uint64(0)
        yield pa.RecordBatch.from_arrays([pa.array([int(out.view(np.int64))], pa.int64())], schema=schema)

    bits = df.select(F.col(column).cast("double")).mapInArrow(run, "b long").agg(F.bit_xor("b")).first()[0] or 0
    return float(np.array(bits & 0x0FFFFFFFFFFFFFFF, dtype=np.int64).view(np.float64))


def covariance(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(i, j, value): sample covariances over complete rows, all in one pass."""
    whole = df.select(*(number(F.col(c)).alias(c) for c in cols)).dropna()
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]
    one = whole.agg(*(F.covar_samp(a, b).alias(f"s{k}") for k, (a, b) in enumerate(pairs)))
    cells = [F.struct(F.lit(x).alias("i"), F.lit(y).alias("j"), F.col(f"s{k}").alias("value")) for k, (a, b) in enumerate(pairs) for x, y in dict.fromkeys([(a, b), (b, a)])]
    return one.select(F.explode(F.array(*cells)).alias("c")).select("c.*")


def rollups(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """One row per numeric column: min, max, mean, sd, missing, is_int; all in one pass."""
    cols = list(cols or [f.name for f in df.schema.fields if f.dataType.typeName() in ("integer", "long", "double", "float", "short", "byte")])
    aggs = []
    for i, c in enumerate(cols):
        x = number(F.col(c))
        whole = F.coalesce(F.bool_and(x == F.floor(x)), F.lit(True))
        aggs.append(F.struct(F.lit(c).alias("column"), F.min(x).alias("min"), F.max(x).alias("max"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"), (F.count("*") - F.count(x)).alias("missing"), whole.alias("is_int")).alias(f"_{i}"))
    return df.agg(*aggs).select(F.explode(F.array(*(f"_{i}" for i in range(len(cols))))).alias("r")).select("r.*")


#: The percentiles of a summary.
PERCENTILES = [0.001, 0.01, 0.1, 0.25, 1 / 3, 0.5, 2 / 3, 0.75, 0.9, 0.99, 0.999]


def extremes(df: DataFrame, column: str, n: int) -> tuple[list[float], list[float]]:
    """The n smallest and the n largest different values; each task sends its own n of both."""
    import numpy as np
    import pyarrow as pa

    def run(batches):
        low = high = np.zeros(0)
        for batch in batches:
            x = np.unique(batch.column(0).to_numpy(zero_copy_only=False))
            low, high = np.unique(np.concatenate([low, x[:n]]))[:n], np.unique(np.concatenate([high, x[-n:]]))[-n:]
        yield pa.RecordBatch.from_pydict({"x": np.concatenate([low, high]), "low": np.repeat([True, False], [len(low), len(high)])})

    ends = df.select(F.col(column).cast("double").alias("x")).where("abs(x) < double('Infinity')").mapInArrow(run, "x double, low boolean").distinct()
    return [r.x for r in ends.where("low").orderBy("x").limit(n).collect()], [r.x for r in ends.where("NOT low").orderBy(F.desc("x")).limit(n).collect()]


def summary(df: DataFrame, column: str, n_extremes: int = 5) -> DataFrame:
    """One row: counts of missing, infinite and zero values, extremes, mean, sd and percentiles of a numeric column."""
    raw, x = F.col(column).cast("double"), number(F.col(column))
    finite = F.when(F.abs(x) < float("inf"), x)
    aggs = df.agg(
        F.count("*").alias("rows"),
        F.count_if(raw.isNull()).alias("na"),
        F.count_if(F.isnan(raw)).alias("nan"),
        F.count_if(raw == float("inf")).alias("pos_inf"),
        F.count_if(raw == float("-inf")).alias("neg_inf"),
        F.count_if(raw == 0).alias("zeros"),
        F.avg(finite).alias("mean"),
        F.stddev_samp(finite).alias("sd"),
    )
    low, high = extremes(df, column, n_extremes)
    row = lambda values: F.array(*map(F.lit, values)).cast("array<double>")
    return aggs.select("*", row(quantiles(df.select(finite.alias("x")), "x", PERCENTILES)).alias("percentiles"), row(low).alias("smallest"), row(high).alias("largest"))


def summary_factor(df: DataFrame, column: str, most: int = 20) -> DataFrame:
    """(level, count, share) of the most frequent levels, by count and name; missing values are a level of their own."""
    counts = df.groupBy(F.coalesce(F.col(f"`{column}`").cast("string"), F.lit("NA")).alias("level")).agg(F.count("*").alias("count"))
    n = df.count()
    return counts.orderBy(F.desc("count"), "level").limit(most).withColumn("share", F.col("count") / F.lit(max(1, n)))


def summary_grouped(df: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """A summary for each group, from partial aggregates: rows, missing, zeros, min, max, mean, sd."""
    x = number(F.col(f"`{column}`"))
    return df.groupBy(*keys).agg(F.count("*").alias("rows"), F.count_if(x.isNull()).alias("na"), F.count_if(x == 0).alias("zeros"), F.min(x).alias("min"), F.max(x).alias("max"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"))


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """(bin from 0, low, count) of equal widths over the column's range; bins without values have count 0."""
    low, high = df.agg(F.min(column), F.max(column)).first()
    if low is None:
        return df.sparkSession.createDataFrame([], "bin int, low double, count long")
    width = (high - low) / bins
    if width == 0:
        return df.where(F.col(column).isNotNull()).groupBy(F.lit(0).alias("bin"), F.lit(float(low)).alias("low")).count()
    k = F.least(F.floor((F.col(column) - low) / width), F.lit(bins - 1)).cast("int")
    counts = df.where(F.col(column).isNotNull()).groupBy(k.alias("bin")).count()
    grid = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return grid.join(counts, "bin", "left").select("bin", (F.lit(float(low)) + F.col("bin") * float(width)).alias("low"), F.coalesce("count", F.lit(0)).cast("long").alias("count"))


def table(df: DataFrame, a: str, b: str | None = None, levels: Sequence[str] | None = None) -> DataFrame:
    """Counts of one column's values, or of two columns' as a grid; missing values are skipped."""
    if b is None:
        return df.where(F.col(a).isNotNull()).groupBy(F.col(a).alias("row.names")).agg(F.count("*").alias("Count"))
    whole = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    return whole.groupBy(a).pivot(b, list(levels) if levels else None).count().na.fill(0)


def checksum(df: DataFrame, order: Sequence[str]) -> int:
    """A hash of contents and order keys that does not depend on partitioning."""
    return df.agg(F.sum(F.xxhash64(*order, *(c for c in df.columns if c not in order)).cast("decimal(38,0)"))).first()[0]


def identical(a: DataFrame, b: DataFrame) -> bool:
    """Equal schemas and equal rows, with repeats."""
    return a.schema == b.schema and a.exceptAll(b).limit(1).count() == 0 and b.exceptAll(a).limit(1).count() == 0


def ignorable(df: DataFrame, most_missing: float = 0.2) -> list[str]:
    """Columns that are constant, miss at least a fifth of their values, or are texts unique in every row."""
    texts = {f.name for f in df.schema.fields if f.dataType.typeName() == "string"}
    row = df.agg(F.count("*").alias("n"), *(F.struct(F.count(c), F.approx_count_distinct(c, 0.01), F.min(c) == F.max(c)).alias(f"_{i}") for i, c in enumerate(df.columns))).first()
    n, out = row["n"], []
    for i, c in enumerate(df.columns):
        have, distinct, constant = row[f"_{i}"]
        unique = c in texts and distinct > 0.95 * n and n > 1 and df.select(c).distinct().count() == n
        if n and (have <= (1 - most_missing) * n or constant or unique):
            out.append(c)
    return out
