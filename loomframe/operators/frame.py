"""Slicing, assignment and binding of frames.

Frames have no order of their own: everything that goes by row position takes order columns, whose combination must
be unique.  ``with_rows`` numbers rows from 1 without a single-task window: ranges of the order are dealt to tasks,
sorted there and stored; each stored range counts its rows, and the offsets (one number each) come back as a small join.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import comb

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed

#: Rows of one window of ``diff``.
DIFF_BLOCK = 1 << 16
#: Row gathers by list are limited, since the list is sent to every task.
MOST_ROWS = 10_000_000


def with_rows(df: DataFrame, order: Sequence[str | Column], to: str = "row") -> DataFrame:
    """``to``: the place of each row from 1, by the order columns."""
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    # stored, since ranges that are computed twice need not be cut alike: their bounds are sampled and adaptively merged
    dealt = checkpointed(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()))
    part, within = F.shiftright("__at", 33), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = dealt.groupBy(part.alias("__part")).count()
    before = sizes.select("__part", (F.sum("count").over(Window.orderBy("__part")) - F.col("count")).alias("__before"))
    return dealt.join(F.broadcast(before), part == before["__part"]).withColumn(to, (within + F.col("__before") + 1).cast("long")).drop("__at", "__part", "__before")


def column(df: DataFrame, name: str) -> DataFrame:
    if name not in df.columns:
        raise KeyError(f"missing column {name}")
    return df.select(name)


def columns(df: DataFrame, wanted: Sequence[int | str]) -> DataFrame:
    """By names, by places from 1 (repeats get new names), or all but the negative places."""
    if wanted and all(isinstance(w, int) and w < 0 for w in wanted):
        gone = {-w for w in wanted}
        return df.select(*(c for i, c in enumerate(df.columns, 1) if i not in gone))
    names = [w if isinstance(w, str) else df.columns[w - 1] for w in wanted if w != 0]
    used: dict[str, int] = {}
    out = []
    for n in names:
        k = used[n] = used.get(n, -1) + 1
        out.append(F.col(f"`{n}`").alias(n if not k else f"{n}{k - 1}"))
    return df.select(*out)


def subframe(df: DataFrame, names: Sequence[str], fill: float | str | None = None) -> DataFrame:
    """Columns by name; those that are missing are constant."""
    return df.select(*(F.col(f"`{n}`") if n in df.columns else F.lit(fill).alias(n) for n in names))


def row_range(df: DataFrame, order: Sequence[str], low: int, high: int) -> DataFrame:
    """Rows low..high (from 1) by the order."""
    return with_rows(df, order, "_row").where(F.col("_row").between(low, high)).drop("_row")


def without_rows(df: DataFrame, order: Sequence[str], rows: Sequence[int]) -> DataFrame:
    return with_rows(df, order, "_row").where(~F.col("_row").isin([abs(r) for r in rows])).drop("_row")


def gather(df: DataFrame, order: Sequence[str], rows: Sequence[int]) -> DataFrame:
    """Rows by a list of places: in its order (``_at``), with repeats; beyond the end a row of missing values; 0 skipped."""
    rows = [r for r in rows if r]
    if len(rows) > MOST_ROWS:
        raise ValueError(f"more than {MOST_ROWS} rows are asked for")
    spark = df.sparkSession
    wanted = spark.createDataFrame([(i, int(r)) for i, r in enumerate(rows)], "_at long, _row long")
    return wanted.join(with_rows(df, order, "_row"), "_row", "left").drop("_row").select("_at", *df.columns)


def head(df: DataFrame, order: Sequence[str], n: int = 6) -> DataFrame:
    """The first n rows; a negative n: all but the last -n."""
    return row_range(df, order, 1, n) if n >= 0 else row_range(df, order, 1, df.count() + n)


def tail(df: DataFrame, order: Sequence[str], n: int = 6) -> DataFrame:
    """The last n rows; a negative n: all but the first -n."""
    rows = df.count()
    return row_range(df, order, rows - n + 1, rows) if n >= 0 else row_range(df, order, 1 - n, rows)


def which(df: DataFrame, test: Column, order: Sequence[str]) -> DataFrame:
    """The places (column ``place``) of the rows where the test is true."""
    return with_rows(df.select(*order, (test.cast("double") == 1).alias("_true")), order, "place").where("_true").select("place")


def filter_rows(df: DataFrame, test: Column, na_rows: str = "drop") -> DataFrame:
    """Rows where the test is true (a number other than 0); na_rows: 'keep' also keeps rows whose test is missing."""
    ok = test.cast("double") != 0
    return df.where(ok | test.isNull() if na_rows == "keep" else ok)


def cell(df: DataFrame, order: Sequence[str], row: int, col: int | str):
    """One value; an error beyond the end."""
    name = col if isinstance(col, str) else df.columns[col - 1]
    found = with_rows(df.select(*dict.fromkeys([*order, name])), order, "_row").where(F.col("_row") == row).select(name).first()
    if found is None:
        raise IndexError(f"there is no row {row}")
    return found[0]


def assign_column(df: DataFrame, col: int | str, value: Column | float | str) -> DataFrame:
    """Replaces a column, or appends one (place ncol + 1 is named C<place>)."""
    value = value if isinstance(value, Column) else F.lit(value)
    if isinstance(col, int):
        if not 1 <= col <= len(df.columns) + 1:
            raise IndexError(f"column {col} of {len(df.columns)}")
        col = df.columns[col - 1] if col <= len(df.columns) else f"C{col}"
    return df.withColumn(col, value)


def assign_rows(df: DataFrame, rows: Sequence[int], order: Sequence[str], value: float, cols: Sequence[str] | None = None) -> DataFrame:
    """A number for some rows' cells; text columns get missing values there."""
    texts = {f.name for f in df.schema.fields if f.dataType.typeName() == "string"}
    numbered = with_rows(df, order, "_row")
    hit = F.col("_row").isin(list(rows))
    put = lambda c: F.when(hit, None if c in texts else F.lit(value)).otherwise(F.col(c)).alias(c)
    return numbered.select(*(put(c) if c in (cols or df.columns) else F.col(c) for c in df.columns))


def rename(df: DataFrame, names: Sequence[str]) -> DataFrame:
    if len(set(names)) != len(names):
        raise ValueError("duplicate column names")
    return df.toDF(*names)


def cbind(*frames: DataFrame | float | int, order: Sequence[Sequence[str]] | None = None) -> DataFrame:
    """Columns side by side, rows matched by place; numbers become constant columns; equal names get numbers.

    order: the order columns of each frame.  Frames with different row counts are an error.
    """
    out, names = None, []
    orders = iter(order or [])
    for f in frames:
        if not isinstance(f, DataFrame):
            continue
        numbered = with_rows(f, next(orders), "_row")
        new = []
        for c in f.columns:
            k, name = 0, c
            while name in names or name in new:
                name = f"{c}{k}"
                k += 1
            new.append(name)
        names += new
        numbered = numbered.select("_row", *(F.col(f"`{c}`").alias(n) for c, n in zip(f.columns, new, strict=True)))
        if out is not None:
            if out.count() != numbered.count():
                raise ValueError("frames have different numbers of rows")
            numbered = out.join(numbered, "_row")
        out = numbered
    for i, f in enumerate(frames):
        if not isinstance(f, DataFrame):
            out = out.withColumn(f"C{i + 1}", F.lit(float(f)))
            names.append(f"C{i + 1}")
    return out.select(*names)


def rbind(*frames: DataFrame) -> DataFrame:
    """Rows one after another, by place; names are those of the last."""
    out = frames[0]
    for f in frames[1:]:
        if len(f.columns) != len(out.columns):
            raise ValueError("frames have different numbers of columns")
        for a, b in zip(out.schema.fields, f.schema.fields, strict=True):
            if (a.dataType.typeName() == "string") != (b.dataType.typeName() == "string"):
                raise ValueError(f"{a.name} and {b.name} have different types")
        out = out.toDF(*(f"_{i}" for i in range(len(out.columns)))).union(f.toDF(*(f"_{i}" for i in range(len(f.columns)))))
    return out.toDF(*frames[-1].columns)


def transpose(df: DataFrame, order: Sequence[str], most: int = 1000) -> DataFrame:
    """Columns become rows (name in ``row.names``) and rows become columns C1.. ; for at most ``most`` rows."""
    names = [c for c in df.columns if c not in order]
    numbered = with_rows(df, order, "_row")
    n = numbered.count()
    if n > most:
        raise ValueError(f"{n} rows would become columns; the limit is {most}")
    long = numbered.select("_row", F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(c).alias("c"), F.col(c).cast("double").alias("v")) for i, c in enumerate(names)))).alias("x"))
    wide = long.groupBy(F.col("x.i").alias("_i"), F.col("x.c").alias("row.names")).pivot("_row", list(range(1, n + 1))).agg(F.first("x.v"))
    return wide.toDF("_i", "row.names", *(f"C{i}" for i in range(1, n + 1))).orderBy("_i").drop("_i")


def gram(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """t(X) %*% X as (i, j, value): all products in one pass of partial sums."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]
    sums = df.agg(*(F.sum(F.col(a).cast("double") * F.col(b).cast("double")).alias(f"s{k}") for k, (a, b) in enumerate(pairs)))
    cells = [F.struct(F.lit(x).alias("i"), F.lit(y).alias("j"), F.col(f"s{k}").alias("value")) for k, (a, b) in enumerate(pairs) for x, y in dict.fromkeys([(a, b), (b, a)])]
    return sums.select(F.explode(F.array(*cells)).alias("c")).select("c.*")


def matmul(a: DataFrame, b: DataFrame) -> DataFrame:
    """Product of matrices held as (i, k, value) and (k, j, value): an equi-join on k and partial sums."""
    left, right = a.toDF("i", "k", "_a"), b.toDF("k", "j", "_b")
    return left.join(right, "k").groupBy("i", "j").agg(F.sum(F.col("_a") * F.col("_b")).alias("value"))


def diff(df: DataFrame, column: str, order: Sequence[str], lag: int = 1, differences: int = 1) -> DataFrame:
    """Repeated lagged differences; the first lag * differences rows go.

    Rows are numbered and windowed in blocks of the order, each with the last rows of the block before it, so no task
    holds the whole column.
    """
    reach = lag * differences
    block = max(DIFF_BLOCK, reach)
    numbered = with_rows(df.select(*dict.fromkeys([*order, column])), order, "_row").withColumn("_x", F.col(f"`{column}`").cast("double"))
    own = F.floor((F.col("_row") - 1) / block)
    last = F.pmod(F.col("_row") - 1, F.lit(block)) >= block - reach
    blocks = numbered.withColumn("_own", own).withColumn("_block", F.explode(F.when(last, F.array("_own", F.col("_own") + 1)).otherwise(F.array("_own"))))
    window = Window.partitionBy("_block").orderBy("_row")
    terms = [F.lit(float((-1) ** i * comb(differences, i))) * (F.lag("_x", i * lag).over(window) if i else F.col("_x")) for i in range(differences + 1)]
    return blocks.withColumn("diff", sum(terms[1:], terms[0])).where(f"_block = _own AND _row > {reach}").select(*(F.col(f"`{c}`") for c in order), "diff")
