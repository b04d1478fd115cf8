"""Dates: parts of a time, strptime patterns, detection of the three written forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: strptime directives and their pattern letters.
DIRECTIVES = {"Y": "yyyy", "y": "yy", "m": "MM", "d": "dd", "e": "d", "H": "HH", "I": "hh", "M": "mm", "S": "ss", "p": "a", "b": "MMM", "h": "MMM", "B": "MMMM", "a": "EEE", "A": "EEEE", "j": "DDD", "z": "xx", "F": "yyyy-MM-dd", "T": "HH:mm:ss", "R": "HH:mm", "D": "MM/dd/yy", "n": "\n", "t": "\t", "%": "%"}


def time(c: Column) -> Column:
    """A zoned timestamp (unzoned ones are read in the session's zone)."""
    return c.cast("timestamp")


def millis(c: Column) -> Column:
    """Milliseconds since 1970."""
    return F.unix_millis(time(c))


PARTS = {
    "year": lambda c: F.year(c),
    "month": lambda c: F.month(c) - 1,  # from 0
    "day": lambda c: F.dayofmonth(c),
    "hour": lambda c: F.hour(c),
    "minute": lambda c: F.minute(c),
    "second": lambda c: F.second(c),
    "millis": lambda c: F.pmod(F.unix_millis(c), F.lit(1000)).cast("int"),
}


def part(c: Column, name: str) -> Column:
    return PARTS[name](time(c)).cast("int")


def year_since_1900(c: Column) -> Column:
    return part(c, "year") - 1900


def pattern_of(strptime: str) -> str:
    """The datetime pattern for a strptime format; other letters are quoted."""
    out, i, literal = [], 0, ""
    while i < len(strptime):
        if strptime[i] == "%" and i + 1 < len(strptime):
            if literal:
                out.append("'" + literal.replace("'", "''") + "'")
                literal = ""
            out.append(DIRECTIVES[strptime[i + 1]])
            i += 2
        else:
            if strptime[i].isalpha() or strptime[i] == "'":
                literal += strptime[i]
            else:
                if literal:
                    out.append("'" + literal.replace("'", "''") + "'")
                    literal = ""
                out.append(strptime[i])
            i += 1
    return "".join(out) + ("'" + literal.replace("'", "''") + "'" if literal else "")


def as_date(c: Column, strptime: str) -> Column:
    """Milliseconds since 1970 of a text; missing where it does not fit."""
    return F.unix_millis(F.try_to_timestamp(c, F.lit(pattern_of(strptime))))


def detect(c: Column) -> Column:
    """A text in one of the forms yyyy-MM-dd, yyyy-MM-dd HH:mm:ss.SSS and dd-MMM-yy as a timestamp, else missing."""
    forms = ("yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm:ss.SSS", "dd-MMM-yy")
    return F.coalesce(*(F.try_to_timestamp(F.trim(c), F.lit(f)) for f in forms))
