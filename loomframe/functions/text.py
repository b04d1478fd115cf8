"""String operations on factor and text columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def lower(c: Column) -> Column:
    return F.lower(c)


def upper(c: Column) -> Column:
    return F.upper(c)


def trim(c: Column) -> Column:
    """Both ends lose characters up to U+0020."""
    return F.regexp_replace(c, r"^[\x00-\x20]+|[\x00-\x20]+$", "")


def gsub(pattern: str, replacement: str, c: Column, ignore_case: bool = False, legacy_case: bool = False) -> Column:
    """Every match replaced.  legacy_case: ignoring case lower-cases the whole value."""
    if ignore_case and legacy_case:
        return F.regexp_replace(F.lower(c), pattern.lower(), replacement)
    return F.regexp_replace(c, f"(?i){pattern}" if ignore_case else pattern, replacement)


def sub(pattern: str, replacement: str, c: Column, ignore_case: bool = False, legacy_case: bool = False) -> Column:
    """The first match replaced: the text before it, the replacement of the match alone, and the rest."""
    if ignore_case and legacy_case:
        c, pattern, ignore_case = F.lower(c), pattern.lower(), False
    flags = "(?i)" if ignore_case else ""
    at = F.length(F.split(c, flags + pattern, 2)[0])
    match = F.regexp_substr(c, F.lit(flags + pattern))
    rest = F.substr(c, at + F.length(match) + 1)
    return F.when(match.isNull(), c).otherwise(F.concat(F.substr(c, F.lit(1), at), F.regexp_replace(match, flags + pattern, replacement), rest))


def pieces(c: Column, pattern: str) -> Column:
    """Split at a pattern; empty pieces at the end are dropped, and an empty text is one empty piece."""
    parts = F.split(c, pattern, -1)
    full = F.transform(parts, lambda x, i: F.when(x != "", i + 1).otherwise(F.lit(0)))
    return F.when(c == "", F.array(F.lit(""))).otherwise(F.slice(parts, F.lit(1), F.greatest(F.array_max(full), F.lit(0))))


def strsplit(df: DataFrame, column: str, pattern: str, width: int | None = None) -> DataFrame:
    """Columns C1..Ck of the pieces; k is the largest number of pieces unless given."""
    parts = df.select("*", pieces(F.col(column), pattern).alias("_pieces"))
    k = width if width is not None else parts.agg(F.max(F.size("_pieces"))).first()[0] or 0
    return parts.select(*df.columns, *(F.get("_pieces", F.lit(i)).alias(f"C{i + 1}") for i in range(k)))


def revalue(c: Column, mapping: dict[str, str] | str) -> Column:
    """Levels renamed; a mapping may be written ``old:new;old:new``."""
    if isinstance(mapping, str):
        mapping = dict(x.split(":", 1) for x in mapping.split(";") if x)
    out = c
    for old, new in mapping.items():
        out = F.when(c == old, F.lit(new)).otherwise(out)
    return out
