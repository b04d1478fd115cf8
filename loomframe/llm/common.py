"""What several corpus operators share: column selection, word patterns, shared storage."""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpointed

#: Words are runs of anything but these bytes: space, tab, \n, \v, \f, \r.
ASCII_SPACE = b" \t\n\x0b\x0c\r"
#: Upper-case ASCII to lower-case ASCII, nothing else.
LOWER_ASCII = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def id_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id (long) and the text (null becomes empty), as ``_id`` and ``_text``.

    Everything else is pruned here, so other columns of any name cannot clash.
    """
    return df.select(F.col(f"`{id_col}`").cast("long").alias("_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("_text"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint: later stages read it from shared storage, so a lost executor costs no recomputation."""
    return checkpointed(df)


def unique(rows: DataFrame) -> DataFrame:
    """One text for each id: the one that sorts first, where ids repeat."""
    if rows.groupBy("_id").count().where("count > 1").limit(1).count():
        return cut(rows.groupBy("_id").agg(F.min("_text").alias("_text")))
    return rows


def slices(batches, most: int):
    """The same rows in batches of about ``most`` bytes of text (the second column), which bounds what is made from each."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.cumsum(pa.compute.binary_length(batch.column(1)).to_numpy(zero_copy_only=False))
        edges = [0, *(np.flatnonzero(np.diff(size // most)) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:], strict=False):
            if b > a:
                yield batch.slice(a, b - a)


def hand_back() -> None:
    """What Arrow and the C library hold of freed memory goes back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def tidy(run):
    """The same function of batches; when its task ends, the worker, which lives on for other stages, hands memory back."""

    def then(batches):
        yield from run(batches)
        hand_back()

    return then


def shuffle_width(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def few(spark: SparkSession) -> int:
    """Tasks for tables of ids alone, which are small beside the texts: one for 16 of the shuffle's, four at least."""
    return max(4, -(-shuffle_width(spark) // 16))


def salt(n: int, *cols: str) -> Column:
    """A row's place among n, from its own values, so that a task that runs again deals its rows alike."""
    return F.pmod(F.xxhash64(*cols), F.lit(n)).cast("int")
