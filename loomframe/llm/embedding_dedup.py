"""Near-duplicate embeddings: inverted lists with product-quantised residuals, then exact cosines.

Vectors are scaled to length 1, so cosine >= t means distance <= r = sqrt(2 - 2 t).  Both filters use that bound and
lose nothing:

* probes: y lies in the list of its nearest centre c_j, so a partner x of y is at most r beyond the plane between c_j
  and any other centre.  x probes every list for which that holds, which is enough probes at any sample.
* table lookups: the code of y gives y' with |y - y'| = e, kept with the code, so |x - y'| <= r + e for partners.
  |x - y'| comes from tables of x against the codebooks (asymmetric distances), one lookup for each subspace.

What passes is compared exactly in double precision.  Centres and codebooks are fitted on at most ``max_train``
vectors; every vector is indexed.  Lists are cut into blocks of at most about ``block`` vectors, so a label, a list or
a group of copies with a third of all rows is spread over many tasks, and identical vectors are one entry with a
weight.  Tasks return counts and a spanning forest of the links they found, never the pairs.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components, and those without a label,
link with nothing; so do vectors of different lengths; rows that repeat an id and vector count once, and an id that
repeats with other vectors is linked as each of them; rows with a null id give no result; an empty table gives no
rows.  Other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .components import connected, forest

#: Slack for rounding in the lossless filters (float32 tables).
SLACK = 1e-4


def kmeans(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Lloyd's rounds from evenly spaced rows; the sample is in hashed order, so these are a random choice."""
    k = max(1, min(k, len(x)))
    centres = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        own = np.argmin((centres**2).sum(1)[None] - 2 * x @ centres.T, axis=1)
        total = np.zeros_like(centres)
        np.add.at(total, own, x)
        n = np.bincount(own, minlength=k)
        centres = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], centres)
    return centres


class Quantiser:
    def __init__(self, sample: np.ndarray, n_lists: int, n_sub: int, n_codes: int):
        self.centres = kmeans(sample, n_lists)
        c = self.centres
        self.between = np.sqrt(np.maximum(((c[:, None] - c[None]) ** 2).sum(2), 1e-30))
        rest = sample - c[self.nearest(sample)]
        self.parts = [p for p in np.array_split(np.arange(sample.shape[1]), n_sub) if len(p)]
        self.books = [kmeans(rest[:, p], n_codes) for p in self.parts]

    def distances(self, x: np.ndarray) -> np.ndarray:
        return np.maximum((x**2).sum(1)[:, None] + (self.centres**2).sum(1)[None] - 2 * x @ self.centres.T, 0)

    def nearest(self, x: np.ndarray) -> np.ndarray:
        return np.argmin(self.distances(x), axis=1)

    def probes(self, x: np.ndarray, r: float) -> list[np.ndarray]:
        """The lists that can hold a vector within r of each row."""
        d = self.distances(x)
        own = d.argmin(1)
        # the plane to the nearest centre rules out most lists, the planes to all others some of the rest
        near = (d - d[np.arange(len(d)), own][:, None]) / (2 * self.between[own])
        near[np.arange(len(d)), own] = -1
        row, at = np.nonzero(near <= r + SLACK)
        keep = np.zeros(len(row), dtype=bool)
        for low in range(0, len(row), 4096):
            i, c = row[low : low + 4096], at[low : low + 4096]
            beyond = (d[i, c][:, None] - d[i]) / (2 * self.between[c])
            beyond[np.arange(len(c)), c] = -1
            keep[low : low + 4096] = beyond.max(1) <= r + SLACK
        return np.split(at[keep], np.cumsum(np.bincount(row[keep], minlength=len(x)))[:-1])

    def encode(self, x: np.ndarray, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes, and the distance between each row and what its code stands for."""
        rest = x - self.centres[lists]
        codes = np.empty((len(x), len(self.parts)), dtype=np.uint8)
        left = np.zeros(len(x))
        for s, (p, book) in enumerate(zip(self.parts, self.books, strict=True)):
            d = ((rest[:, p][:, None] - book[None]) ** 2).sum(2)
            codes[:, s] = d.argmin(1)
            left += d.min(1)
        return codes, np.sqrt(left)

    def lookup(self, x: np.ndarray, list_id: int, codes: np.ndarray) -> np.ndarray:
        """Asymmetric distances of rows x to the coded members of a list."""
        rest = x - self.centres[list_id]
        total = np.zeros((len(x), len(codes)), dtype=np.float32)
        for s, (p, book) in enumerate(zip(self.parts, self.books, strict=True)):
            tables = ((rest[:, p][:, None] - book[None]) ** 2).sum(2).astype(np.float32)
            total += tables[:, codes[:, s]]
        return np.sqrt(total)


def near_duplicates(vectors: DataFrame, *, id_col="vec_id", vec_col="embedding", label_col="label", threshold=0.98, max_train=4096, n_sub=8, n_codes=32, block=1024) -> DataFrame:
    """One row for each distinct id: _id, n_links, component_id, kept."""
    v = F.col(f"`{vec_col}`").cast("array<double>")
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("_id"), F.col(f"`{label_col}`").cast("string").alias("_label"), v.alias("_v")).where("_id IS NOT NULL")
    usable = "_label IS NOT NULL AND _v IS NOT NULL AND size(_v) > 0 AND forall(_v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity')) AND exists(_v, x -> x <> 0)"
    copies = rows.where(usable).select("_label", "_v", "_id").distinct()
    groups = cut(copies.groupBy("_label", "_v").agg(F.min("_id").alias("_rep"), F.count("*").alias("_n")))
    n, dim = groups.agg(F.count("*"), F.max(F.size("_v"))).first()
    ids = rows.select("_id").distinct()
    if not n:
        return ids.select("_id", F.lit(0).cast("long").alias("n_links"), F.col("_id").alias("component_id"), F.lit(True).alias("kept"))
    # tasks choose by hash, so that only about max_train vectors travel, whatever the number of tasks
    place = F.xxhash64("_rep")
    chosen = groups.where(F.lit(n <= max_train) | (F.abs(place % (1 << 40)) < int((1 << 40) * min(1, max_train / n)))).select(place.alias("_at"), "_v").collect()
    sample = np.array([unit(np.array(r["_v"]), dim) for r in sorted(chosen, key=lambda r: r["_at"])]).reshape(-1, dim)
    if not len(sample):
        sample = np.array([unit(np.array(groups.select("_v").first()[0]), dim)])
    quantiser = Quantiser(sample, int(math.sqrt(n) / 12), n_sub, n_codes)
    radius = math.sqrt(max(0.0, 2 - 2 * threshold))

    def place(batches):
        for pdf in batches:
            x = np.array([unit(np.asarray(v), dim) for v in pdf["_v"]]).reshape(len(pdf), dim)
            own = quantiser.nearest(x)
            probes = quantiser.probes(x, radius)
            times = np.array([len(p) for p in probes], dtype=int)
            at = np.repeat(np.arange(len(pdf)), times)
            # members first, then the probes of each row
            take = np.concatenate([np.arange(len(pdf)), at])
            out = pdf.iloc[take].reset_index(drop=True)
            out["_list"] = np.concatenate([own, np.concatenate(probes) if len(probes) else own[:0]]).astype("int32")
            out["_member"] = np.arange(len(take)) < len(pdf)
            yield out[["_label", "_dim", "_rep", "_n", "_v", "_list", "_member"]]

    schema = "_label string, _dim int, _rep long, _n long, _v array<double>, _list int, _member boolean"
    placed = cut(groups.withColumn("_dim", F.size("_v")).select("_label", "_dim", "_rep", "_n", "_v").mapInPandas(place, schema))
    key = ["_label", "_dim", "_list"]
    blocks = placed.where("_member").groupBy(*key).agg(F.ceil(F.count("*") / block).cast("int").alias("_blocks"))
    tasks = placed.join(blocks, key).select(
        *key, "_rep", "_n", "_v", "_member",
        F.explode(F.when(F.col("_member"), F.array(F.pmod(F.xxhash64("_rep"), F.col("_blocks")).cast("int"))).otherwise(F.sequence(F.lit(0), F.col("_blocks") - 1))).alias("_block"),
        F.when(F.col("_member"), F.lit(-1)).otherwise(F.pmod(F.xxhash64("_rep", F.lit(7)), F.col("_blocks"))).cast("int").alias("_part"),
    )
    # a block of members meets the probing rows in parts of about the same size
    tasks = tasks.join(blocks, key).select(*key, "_block", "_rep", "_n", "_v", "_member", F.explode(F.when(F.col("_member"), F.sequence(F.lit(0), F.col("_blocks") - 1)).otherwise(F.array("_part"))).alias("_part"))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        members, asking = pdf[pdf["_member"]], pdf[~pdf["_member"]]
        nothing = pd.DataFrame({"_node": pd.Series(dtype="int64"), "_links": pd.Series(dtype="int64"), "_root": pd.Series(dtype="int64")})
        if not len(members) or not len(asking):
            return nothing
        list_id = int(pdf["_list"].iloc[0])
        raw_y, raw_x = (np.array(f["_v"].tolist(), dtype=np.float64) for f in (members, asking))
        y, x = (r if r.shape[1] == dim else np.pad(r, ((0, 0), (0, dim - r.shape[1]))) for r in (raw_y / norms(raw_y), raw_x / norms(raw_x)))
        codes, error = quantiser.encode(y, np.full(len(y), list_id))
        weight, rep_y, rep_x = members["_n"].to_numpy(), members["_rep"].to_numpy(), asking["_rep"].to_numpy()
        links, ones, twos = np.zeros(len(x), dtype=np.int64), [], []
        for start in range(0, len(x), 256):
            part = slice(start, start + 256)
            i, j = np.nonzero(quantiser.lookup(x[part], list_id, codes) <= radius + error[None] + SLACK)
            for low in range(0, len(i), 1 << 16):
                a, b = i[low : low + (1 << 16)] + start, j[low : low + (1 << 16)]
                good = (np.einsum("ij,ij->i", x[a], y[b]) >= threshold) & (rep_x[a] != rep_y[b])
                np.add.at(links, a[good], weight[b[good]])
                ones.append(rep_x[a[good]])
                twos.append(rep_y[b[good]])
        if not ones:
            return nothing
        node, root = forest(np.concatenate(ones), np.concatenate(twos))
        some = links > 0
        return pd.DataFrame({"_node": np.concatenate([rep_x[some], node]), "_links": np.concatenate([links[some], np.zeros(len(node), dtype=np.int64)]), "_root": np.concatenate([rep_x[some], root])})

    found = cut(tasks.groupBy(*key, "_block", "_part").applyInPandas(compare, "_node long, _links long, _root long"))
    counts = found.groupBy("_node").agg(F.sum("_links").alias("_links"))
    # an id that repeats with several vectors joins their groups
    names = copies.join(groups.select("_label", "_v", "_rep", "_n"), ["_label", "_v"]).select("_id", "_rep", "_n")
    parts = connected(found.select("_node", "_root").union(names.select("_id", "_rep")), "_node", "_root")
    per_id = names.join(counts, names["_rep"] == counts["_node"], "left").groupBy("_id").agg(F.sum(F.coalesce("_links", F.lit(0)) + F.col("_n") - 1).alias("_links"))
    whole = ids.join(per_id, "_id", "left").join(parts.withColumnRenamed("node", "_id"), "_id", "left")
    component = F.coalesce("component", "_id")
    return whole.select("_id", F.coalesce("_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (component == F.col("_id")).alias("kept"))


def norms(x: np.ndarray) -> np.ndarray:
    """Lengths of rows, safe from overflow, as a column."""
    top = np.abs(x).max(axis=1, keepdims=True)
    return np.sqrt(((x / top) ** 2).sum(axis=1, keepdims=True)) * top


def unit(v: np.ndarray, dim: int) -> np.ndarray:
    v = v / norms(v[None])[0]
    return v if len(v) == dim else np.pad(v, (0, dim - len(v)))
