import math

import pytest
from pyspark.sql import functions as F

from loomframe.functions import arithmetic as A
from loomframe.functions import binning, dates, factors, sequences, text

NUMBERS = [None, float("nan"), math.inf, -math.inf, 0.0, -0.0, -7.0, 2.5, 2.675, 1e308]


def values(spark, data, kind, expr):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(data)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("x"))).collect()]


def test_division(spark):
    got = values(spark, [1.0, -1.0, 0.0, None], "double", lambda c: A.divide(c, F.lit(0.0)))
    assert got == [math.inf, -math.inf, None, None]
    assert values(spark, [7.0, -7.0], "double", lambda c: A.remainder(c, F.lit(3.0))) == [1.0, -1.0]
    assert values(spark, [7.0, -7.0], "double", lambda c: A.int_divide(c, F.lit(2.0))) == [3.0, -4.0]


def test_nan_is_missing(spark):
    assert values(spark, NUMBERS, "double", A.number)[:2] == [None, None]
    assert values(spark, [-1.0, 0.0, 4.0], "double", A.sqrt) == [None, 0.0, 2.0]
    assert values(spark, [-1.0, 0.0, 1.0], "double", A.log) == [None, -math.inf, 0.0]
    assert values(spark, [2.0, 1.0], "double", A.UNARY["acos"]) == [None, 0.0]


def test_rounding(spark):
    assert values(spark, [2.675, 0.5, 1.5, None, math.inf], "double", lambda c: A.round_exact(c, 2)) == [2.67, 0.5, 1.5, None, math.inf]
    assert values(spark, [0.5, 1.5, 2.5], "double", A.round_exact) == [0.0, 2.0, 2.0]
    assert values(spark, [123456.0, 0.00123456], "double", lambda c: A.signif(c, 3)) == [123000.0, 0.00123]
    assert values(spark, [2.7, -2.7, 1e308], "double", A.trunc) == [2.0, -2.0, 1e308]


def test_logic(spark):
    df = spark.createDataFrame([(0, None), (1, None), (0, 1), (1, 1)], "a int, b int")
    rows = df.select(A.and_(F.col("a"), F.col("b")), A.or_(F.col("a"), F.col("b")), A.not_(F.col("b"))).collect()
    assert [tuple(r) for r in rows] == [(None, None, 0), (None, 1, 0), (0, 1, 0), (1, 1, 0)]


def test_tolerant_comparison(spark):
    x = 0.1 + 0.2
    assert values(spark, [x], "double", lambda c: A.compare(c, "==", F.lit(0.3))) == [0]
    assert values(spark, [x], "double", lambda c: A.compare(c, "==", F.lit(0.3), tolerant=True)) == [1]
    assert values(spark, [x], "double", lambda c: A.compare(c, ">", F.lit(0.3), tolerant=True)) == [0]


def test_text(spark):
    assert values(spark, [" a\t", None, ""], "string", text.trim) == ["a", None, ""]
    assert values(spark, ["aXbX"], "string", lambda c: text.sub("x", "-", c, ignore_case=True)) == ["a-bX"]
    assert values(spark, ["aXbX", "none"], "string", lambda c: text.sub("(X)b", "[$1]", c)) == ["a[X]X", "none"]
    assert values(spark, ["AbAb"], "string", lambda c: text.gsub("A", "x", c, True, True)) == ["xbxb"]
    assert values(spark, ["a,b,,", "", ",a", None], "string", lambda c: text.pieces(c, ",")) == [["a", "b"], [""], ["", "a"], None]
    assert values(spark, ["a", "z"], "string", lambda c: text.revalue(c, "a:b;b:c")) == ["b", "z"]


def test_dates(spark):
    assert dates.pattern_of("%Y-%m-%dT%H:%M") == "yyyy-MM-dd'T'HH:mm"
    assert values(spark, ["02/01/1970", "x", None], "string", lambda c: dates.as_date(c, "%d/%m/%Y")) == [86400000, None, None]
    assert values(spark, ["2024-02-29"], "string", lambda c: dates.part(F.to_timestamp(c), "month")) == [1]
    assert [x is not None for x in values(spark, ["2024-02-29", "2024-02-29 23:59:59.999", "29-Feb-24", "x"], "string", dates.detect)] == [True, True, True, False]


def test_factors(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("b",)], "f string")
    assert [r.code for r in factors.codes(df, "f", "code").orderBy("code").collect()] == [None, 0, 1, 1]
    assert factors.domain(df, "f") == ["a", "b"]
    with pytest.raises(ValueError):
        factors.set_level(df, "f", "z")
    assert values(spark, [3.0, None], "double", factors.factor) == ["3", None]


def test_bins(spark):
    assert values(spark, [0.0, 1.0, 2.0, 5.0, None], "double", lambda c: binning.cut_breaks(c, [0, 2, 1])) == [None, "(0,1]", "(1,2]", None, None]
    df = spark.createDataFrame([(0.0,), (1.0,), (2.0,), (3.0,), (4.0,), (None,)], "x double")
    assert [r.bin for r in binning.cut_equal(df, "x", 2).orderBy(F.col("x").asc_nulls_last()).collect()] == ["(-0.004,2]", "(-0.004,2]", "(2,4]", "(2,4]", "(2,4]", None]
    assert values(spark, [0.0, 1.0, 3.0], "double", lambda c: binning.find_interval(c, [1, 3], True)) == [0, 1, 1]


def test_sequences(spark):
    assert [r.C1 for r in sequences.seq(spark, 3, 1, -1).orderBy("C1").collect()] == [1, 2, 3]
    with pytest.raises(ValueError):
        sequences.seq(spark, 1, 3, -1)
    with pytest.raises(ValueError):
        sequences.seq_len(spark, 0)
