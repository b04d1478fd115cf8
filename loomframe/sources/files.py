"""Reading and writing delimited and sparse text, with the set-up guessed from a sample."""

from __future__ import annotations

import gzip
import io
import re
import zipfile
from collections import Counter
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tried in this order.
SEPARATORS = ["\x01", ",", ";", "|", "\t", " "]
NA = {"", "NA", "na", "N/A", "null", "NULL", "?"}
_NUMBER = re.compile(r"[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$|[+-]?(inf|Infinity|NaN|nan)$")
_UUID = re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$")
_TIMES = [(re.compile(r"\d{4}-\d{2}-\d{2}$"), "yyyy-MM-dd"), (re.compile(r"\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}(\.\d{1,3})?$"), "yyyy-MM-dd HH:mm:ss[.SSS]"), (re.compile(r"\d{1,2}-[A-Za-z]{3}-\d{2}$"), "d-MMM-yy")]


@dataclass
class Setup:
    kind: str = "csv"
    sep: str = ","
    header: bool = False
    quote: str = '"'
    names: list[str] = field(default_factory=list)
    types: list[str] = field(default_factory=list)
    formats: dict[str, str] = field(default_factory=dict)


def split_line(line: str, sep: str, quote: str = '"') -> list[str]:
    out, cell, inside, i = [], [], False, 0
    while i < len(line):
        c = line[i]
        if inside and c == quote and line[i + 1 : i + 2] == quote:
            cell.append(c)
            i += 1
        elif c == quote:
            inside = not inside
        elif c == sep and not inside:
            out.append("".join(cell))
            cell = []
        else:
            cell.append(c)
        i += 1
    out.append("".join(cell))
    return [x.strip() for x in out]


def type_of(values: list[str]) -> str:
    """One type for a column: any number beats texts, a UUID beats both, times must share one form."""
    some = [v for v in values if v not in NA]
    if not some:
        return "double"
    if any(_UUID.match(v) for v in some):
        return "uuid"
    if any(_NUMBER.match(v) for v in some):
        return "double"
    for form, _ in _TIMES:
        if all(form.match(v) for v in some):
            return "time"
    return "string"


def guess(lines: list[str], header: bool | None = None, sep: str | None = None, quote: str = '"') -> Setup:
    """Separator, header, names and types from the first lines; # and @ lines are skipped."""
    lines = [x for x in lines if x.strip() and not x.lstrip().startswith(("#", "@"))]
    if not lines:
        return Setup()
    if all(re.match(r"\s*[-+0-9.eE]+(\s+qid:\d+)?(\s+\d+:[-+0-9.eE]+)+\s*$", x) for x in lines):
        return Setup(kind="svmlight")
    if sep is None:
        best = {s: Counter(len(split_line(x, s, quote)) for x in lines).most_common(1)[0] for s in SEPARATORS}
        sep = next((s for s in SEPARATORS if best[s][0] > 1 and best[s][1] >= 0.5 * len(lines)), ",")
    rows = [split_line(x, sep, quote) for x in lines]
    width = Counter(map(len, rows)).most_common(1)[0][0]
    rows = [(r + [""] * width)[:width] for r in rows]
    if header is None:
        texts = lambda r: all(v and not _NUMBER.match(v) for v in r)
        header = len(rows) > 1 and texts(rows[0]) and not texts(rows[1])
    names = rows[0] if header else [f"C{i + 1}" for i in range(width)]
    if len(set(names)) != len(names):
        raise ValueError("duplicate column names")
    body = rows[1:] if header else rows
    types = [type_of([r[i] for r in body]) for i in range(width)]
    formats = {n: next(p for f, p in _TIMES if f.match(next(r[i] for r in body if r[i] not in NA))) for i, (n, t) in enumerate(zip(names, types, strict=True)) if t == "time"}
    return Setup("csv", sep, header, quote, names, types, formats)


def merge(setups: list[Setup]) -> Setup:
    """The set-up of most files; files of another width are an error."""
    widths = Counter((s.kind, len(s.names)) for s in setups)
    if len(widths) > 1:
        raise ValueError("files have different set-ups")
    return Counter(map(repr, setups)).most_common(1)[0][0] and max(setups, key=lambda s: sum(repr(s) == repr(o) for o in setups))


def read(spark: SparkSession, path: str | list[str], header: bool | None = None, sep: str | None = None, quote: str = '"', sample: int = 200, exclude: str | None = None) -> DataFrame:
    """Delimited, svmlight, gzip or zip files by any URI that Hadoop knows.  Only ``sample`` lines are looked at first."""
    paths = [path] if isinstance(path, str) else list(path)
    if all(p.endswith(".zip") for p in paths):
        return read_zip(spark, paths, header, sep, quote)
    text = spark.read.text(paths)
    if exclude:
        text = text.where(~F.col("_metadata.file_path").rlike(exclude))
    lines = [r[0] for r in text.limit(sample).collect()]
    setup = guess(lines, header, sep, quote)
    if setup.kind == "svmlight":
        return read_svmlight(spark, paths)
    return typed(spark.read.csv(paths, sep=setup.sep, header=setup.header, quote=setup.quote, comment="#", ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, schema=", ".join(f"`{n}` string" for n in setup.names), enforceSchema=True, mode="PERMISSIVE"), setup)


def typed(raw: DataFrame, setup: Setup) -> DataFrame:
    """Text columns by the set-up's types; what does not fit is missing."""
    out = []
    for n, t in zip(setup.names, setup.types, strict=True):
        c = F.when(~F.col(f"`{n}`").isin(*NA), F.col(f"`{n}`"))
        if t == "double":
            d = F.expr(f"try_cast(`{n}` AS double)")
            c = F.when(~F.isnan(d), d)
        elif t == "time":
            c = F.try_to_timestamp(c, F.lit(setup.formats[n]))
        out.append(c.alias(n, metadata={"uuid": True}) if t == "uuid" else c.alias(n))
    return raw.select(*out)


def read_zip(spark: SparkSession, paths: list[str], header: bool | None = None, sep: str | None = None, quote: str = '"') -> DataFrame:
    """The first entry of each archive; an archive is read by one task."""

    def lines(batches):
        import pyarrow as pa

        for batch in batches:
            for data in batch.column(0).to_pylist():
                with zipfile.ZipFile(io.BytesIO(data)) as z, z.open(z.namelist()[0]) as f:
                    yield pa.RecordBatch.from_arrays([pa.array(io.TextIOWrapper(f, "utf-8", errors="replace").read().splitlines(), pa.string())], names=["value"])

    text = spark.read.format("binaryFile").load(paths).select("content").mapInArrow(lines, "value string")
    setup = guess([r[0] for r in text.limit(200).collect()], header, sep, quote)
    head = text.where(~F.ltrim("value").rlike("^[#@]") & (F.trim("value") != ""))
    raw = head.select(F.from_csv("value", F.lit(", ".join(f"`{n}` string" for n in setup.names)), {"sep": setup.sep, "quote": setup.quote}).alias("r")).select("r.*")
    if setup.header:
        raw = raw.where(~reduce(lambda a, b: a & b, (F.col(f"`{n}`").eqNullSafe(F.lit(n)) for n in setup.names)))
    return typed(raw, setup)


def read_svmlight(spark: SparkSession, paths: list[str], width: int | None = None) -> DataFrame:
    """``target`` and C1..Ck from ``target [qid:n] col:value ...`` lines; cells that are not named are 0."""
    text = spark.read.text(paths).where("trim(value) <> '' AND NOT trim(value) LIKE '#%'")
    parts = F.split(F.trim(F.split("value", "#")[0]), r"\s+")
    rows = text.select(parts[0].cast("double").alias("target"), F.map_from_entries(F.transform(F.filter(F.slice(parts, F.lit(2), F.size(parts)), lambda p: ~p.startswith("qid:")), lambda p: F.struct(F.split(p, ":")[0].cast("int"), F.split(p, ":")[1].cast("double")))).alias("cells"))
    k = width or rows.agg(F.max(F.array_max(F.map_keys("cells")))).first()[0] or 0
    return rows.select("target", *(F.coalesce(F.try_element_at("cells", F.lit(i)), F.lit(0.0)).alias(f"C{i}") for i in range(1, k + 1)))


def read_text_bytes(data: bytes) -> list[str]:
    """Lines of a small upload, unzipped if need be."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    return data.decode("utf-8", "replace").splitlines()


def upload(spark: SparkSession, data: bytes, **options) -> DataFrame:
    """A frame from bytes on the driver."""
    lines = read_text_bytes(data)
    setup = guess(lines[:200], **options)
    rows = [split_line(x, setup.sep, setup.quote) for x in lines if x.strip() and not x.lstrip().startswith(("#", "@"))][1 if setup.header else 0 :]
    width = len(setup.names)
    raw = spark.createDataFrame([tuple((r + [""] * width)[:width]) for r in rows], ", ".join(f"`{n}` string" for n in setup.names))
    return typed(raw, setup)


def read_excel(spark: SparkSession, path: str, sheet: int = 0) -> DataFrame:
    """A sheet, read by pandas on the driver (needs an engine that is not part of this package's requirements)."""
    import pandas as pd

    return spark.createDataFrame(pd.read_excel(path, sheet_name=sheet))


def export(df: DataFrame, path: str, force: bool = False, sep: str = ",") -> None:
    df.write.mode("overwrite" if force else "errorifexists").csv(path, header=True, sep=sep)


def csv_lines(df: DataFrame, hex_doubles: bool = False):
    """CSV lines one by one, partition after partition; hex_doubles writes doubles without loss."""
    yield ",".join(df.columns)
    for row in df.toLocalIterator():
        yield ",".join("" if v is None else v.hex() if hex_doubles and isinstance(v, float) else '"' + v.replace('"', '""') + '"' if isinstance(v, str) else str(v) for v in row)
