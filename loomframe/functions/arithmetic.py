"""Element-wise arithmetic, comparison and logic with one missing value.

A missing value is NULL; NaN is turned into NULL wherever an expression can make one.  All of these are plain column
expressions that stay inside whole-stage code generation, but ``round_exact`` and ``signif``, which need the exact
binary value and are Arrow-batched.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

INF = float("inf")


def number(c: Column) -> Column:
    """A double; NaN becomes missing."""
    d = c.cast("double")
    return F.when(~F.isnan(d), d)


def divide(a: Column, b: Column) -> Column:
    """IEEE division: x / 0 is infinite by the sign of x, 0 / 0 is missing."""
    a, b = a.cast("double"), b.cast("double")
    return F.when(b != 0, a / b).when(a > 0, F.lit(INF)).when(a < 0, F.lit(-INF))


def ieee_divide(a: Column, b: Column) -> Column:
    """IEEE division as SQL engines have it, NaN and the sign of a zero divisor included: only missing sides make it missing."""
    a, b = a.cast("double"), b.cast("double")
    return F.when(b != 0, a / b).otherwise(a * F.pow(b, F.lit(-1.0)))


def remainder(a: Column, b: Column) -> Column:
    """With the sign of the dividend; missing for a divisor of 0."""
    a, b = a.cast("double"), b.cast("double")
    return F.when(b != 0, a % b)


def int_divide(a: Column, b: Column) -> Column:
    return floor(divide(a, b))


def power(a: Column, b: Column) -> Column:
    return number(F.pow(a.cast("double"), b.cast("double")))


def floor(c: Column) -> Column:
    d = c.cast("double")
    return F.when(F.abs(d) < 2**53, F.floor(d).cast("double")).otherwise(d)


def ceiling(c: Column) -> Column:
    d = c.cast("double")
    return F.when(F.abs(d) < 2**53, F.ceil(d).cast("double")).otherwise(d)


def trunc(c: Column) -> Column:
    return F.when(c >= 0, floor(c)).otherwise(ceiling(c))


def log(c: Column) -> Column:
    """Natural logarithm; log(0) is -Inf, below that missing."""
    d = c.cast("double")
    return F.when(d > 0, F.ln(d)).when(d == 0, F.lit(-INF))


def sqrt(c: Column) -> Column:
    d = c.cast("double")
    return F.when(d >= 0, F.sqrt(d))


def arc(name: str, c: Column) -> Column:
    """acos or asin; missing outside [-1, 1]."""
    d = c.cast("double")
    return F.when(F.abs(d) <= 1, getattr(F, name)(d))


#: One-argument functions by name.
UNARY = {
    "abs": lambda c: F.abs(c.cast("double")),
    "sgn": lambda c: F.signum(c.cast("double")),
    "sqrt": sqrt,
    "log": log,
    "exp": lambda c: F.exp(c.cast("double")),
    "ceil": ceiling,
    "floor": floor,
    "trunc": trunc,
    "acos": lambda c: arc("acos", c),
    "asin": lambda c: arc("asin", c),
    **{n: (lambda n: lambda c: number(getattr(F, n)(c.cast("double"))))(n) for n in ("cos", "sin", "tan", "atan", "cosh", "sinh", "tanh")},
}


def round_even(c: Column, digits: int = 0) -> Column:
    """Half-even on the shortest decimal form; stays in the JVM."""
    return F.bround(c.cast("double"), digits)


@F.arrow_udf(DoubleType())
def _round(values: pa.Array, digits: pa.Array) -> pa.Array:
    return pa.array([None if v is None else v if v in (INF, -INF) else float(round(v, d)) for v, d in zip(values.to_pylist(), digits.to_pylist(), strict=True)], pa.float64())


def round_scaled(c: Column, digits: int = 0) -> Column:
    """Half away from zero on the double c * 10 ** digits, as C's round; what that cannot hold stays."""
    d, scale = c.cast("double"), 10.0**digits
    whole = F.round(d * scale, 0)
    out = F.when(whole == 0, d * 0).otherwise(whole / scale)
    return F.when(F.abs(out) < INF, out).otherwise(d)


def round_exact(c: Column, digits: int = 0) -> Column:
    """Half-even on the exact binary value: 2.675 to two digits is 2.67."""
    return _round(number(c), F.lit(digits))


@F.arrow_udf(DoubleType())
def _signif(values: pa.Array, digits: pa.Array) -> pa.Array:
    return pa.array([None if v is None else v if v in (INF, -INF) else float(f"%.{max(d, 1) - 1}e" % v) for v, d in zip(values.to_pylist(), digits.to_pylist(), strict=True)], pa.float64())


def signif(c: Column, digits: int = 6) -> Column:
    """Half-even to significant digits, on the exact binary value."""
    return _signif(number(c), F.lit(digits))


def ulp(c: Column) -> Column:
    """The gap between doubles at c: 2 to the exponent less 52."""
    return F.when(c == 0, F.lit(5e-324)).otherwise(F.pow(F.lit(2.0), F.floor(F.log2(F.abs(c))) - 52))


def compare(a: Column, op: str, b: Column, tolerant: bool = False) -> Column:
    """1 or 0 (missing where a side is); tolerant: values one ulp apart are equal."""
    if tolerant:
        a, b = a.cast("double"), b.cast("double")
        same = (a == b) | (F.abs(a - b) <= F.greatest(ulp(a), ulp(b)))
        test = {"==": same, "!=": ~same, "<": (a < b) & ~same, ">": (a > b) & ~same, "<=": (a < b) | same, ">=": (a > b) | same}[op]
    else:
        test = {"==": a == b, "!=": a != b, "<": a < b, ">": a > b, "<=": a <= b, ">=": a >= b}[op]
    return test.cast("int")


def truth(c: Column) -> Column:
    """Numbers and booleans as a boolean; missing stays."""
    return c.cast("double") != 0


def and_(a: Column, b: Column) -> Column:
    """Element-wise; missing where either side is, even if the other is 0."""
    return F.when(a.isNotNull() & b.isNotNull(), (truth(a) & truth(b)).cast("int"))


def or_(a: Column, b: Column) -> Column:
    """Element-wise; 1 where either side is true, else missing where either is missing."""
    return (truth(a) | truth(b)).cast("int")


def not_(c: Column) -> Column:
    """1 for 0, else 0; a missing value gives 0."""
    return F.coalesce((c.cast("double") == 0).cast("int"), F.lit(0))


def is_na(c: Column, factor: bool = False) -> Column:
    """1 where missing; of a factor also where its level is the text NA."""
    return (c.isNull() | (c == "NA") if factor else c.isNull()).cast("int")


def if_else(test: Column, yes: Column, no: Column) -> Column:
    """Element-wise; a missing test gives a missing value."""
    return F.when(test.isNull(), None).when(truth(test), yes).otherwise(no)
