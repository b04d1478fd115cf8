"""Connected components of a link table, by repeated joins; nothing is collected.

Each task first puts its own links together.  Then every round replaces each link (u, v), u > v, by links to the smallest
neighbours of both ends, which halves the distance to the component's smallest id at least, until no id that is
linked to a smaller one has another link.  Both joins read checkpointed tables, so that adaptive execution can
split a hub's partition, and every round survives the loss of executors.  Links are stored in ``few`` partitions: a task
that sees more of them leaves fewer rounds, and the driver has fewer tasks to keep account of.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, few, tidy

#: Links that a task puts together at a time.
MOST_LINKS = 1 << 20


def _links(df: DataFrame) -> DataFrame:
    """Distinct links (u, v), u > v, put together by task."""

    def run(batches):
        for many in _together(batches):
            node, least = forest(*many)
            yield pa.RecordBatch.from_pydict({"_u": node, "_v": least})

    ordered = df.where("_u <> _v").select(F.greatest("_u", "_v").alias("_u"), F.least("_u", "_v").alias("_v")).distinct()
    return cut(ordered.coalesce(few(df.sparkSession)).mapInArrow(tidy(run), "_u long, _v long"))


def _together(batches):
    """The ends of some links after others: of what was put together, as long as it leaves room, and of the links that follow."""
    held, n = [], 0
    for b in batches:
        held.append((b.column(0).to_numpy(), b.column(1).to_numpy()))
        n += b.num_rows
        if n >= MOST_LINKS:
            held = [forest(*(np.concatenate(x) for x in zip(*held, strict=True)))]
            n = len(held[0][0])
            if n >= MOST_LINKS // 2:
                yield held[0]
                held, n = [], 0
    if n:
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))


def _open(links: DataFrame) -> bool:
    """Whether an id that is linked to a smaller one has another link."""
    ends = links.select(F.col("_u").alias("id"), F.lit(1).alias("up")).union(links.select("_v", F.lit(0)))
    return bool(ends.groupBy("id").agg(F.sum("up").alias("up"), F.count("*").alias("n")).where("up > 0 AND n > 1").coalesce(few(links.sparkSession)).head(1))


def connected(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest id reachable, for every node that is not its component's smallest.

    Nodes without links, and the smallest of each component, are left out: they are their own component.
    Rows with a null end are ignored.
    """
    now = _links(links.select(F.col(a).cast("long").alias("_u"), F.col(b).cast("long").alias("_v")).where("_u IS NOT NULL AND _v IS NOT NULL"))
    while _open(now):
        least = cut(now.groupBy("_u").agg(F.min("_v").alias("_m")).coalesce(few(links.sparkSession)))
        of_u = least.select(F.col("_u"), F.col("_m").alias("_mu"))
        of_v = least.select(F.col("_u").alias("_v"), F.col("_m").alias("_mv"))
        ends = now.join(of_u, "_u").join(of_v, "_v", "left").select("_u", "_mu", F.coalesce("_mv", "_v").alias("_mv"))
        pairs = ends.coalesce(few(links.sparkSession)).select(F.explode(F.array(F.struct(F.col("_u"), F.least("_mu", "_mv").alias("_v")), F.struct(F.col("_mu").alias("_u"), F.col("_mv").alias("_v")))).alias("p"))
        now = _links(pairs.select("p._u", "p._v"))
    return now.select(F.col("_u").alias("node"), F.col("_v").alias("component"))


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of one task, as (node, smallest id of its component) for the nodes that are not the smallest."""
    ids, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = flat[: len(a)], flat[len(a) :]
    label = np.arange(len(ids))
    while True:
        low = np.minimum(label[x], label[y])
        then = label.copy()
        np.minimum.at(then, x, low)
        np.minimum.at(then, y, low)
        np.minimum.at(then, label[x], low)
        np.minimum.at(then, label[y], low)
        then = then[then]
        if (then == label).all():
            break
        label = then
    rest = label != np.arange(len(ids))
    return ids[rest], ids[label[rest]]
