"""Exact repeated substrings by blockwise suffix sorting with difference-cover ranks.

Every string of ``n`` bytes (a suffix cut at n) goes to the bucket of its anchor: of the ``K``-byte grams in it, the one
with the smallest hash, the rightmost of equals.  Equal strings have equal anchors at equal places, so each bucket can
be sorted alone, and a bucket's memory depends on its own size only.  Neighbouring strings share their anchor, so a
bucket holds runs of them: 3 in 100 bytes become a record, packed into one blob for each task and bucket.

* Runs whose whole context is equal (by 128 bits: its hash and that of the anchor) collapse to the smallest (id, start),
  which stands for them in the sort; all others are removed.
* Where an anchor has several contexts, the first run of each is sorted, string by string: by the first V bytes, then,
  where they tie, by ranks of the difference-cover sample, which were computed by doubling before.  Contexts are laid
  out with their anchors at multiples of V, so that tied strings have one offset to the next sample position.  Equal
  neighbours in that order are compared byte by byte.
* Anchors that many records share are dealt string by string instead of run by run (equality by 128 bits of two hashes),
  and each task sends the first of equal ones only: a passage in a third of all documents costs each task one record.

Defined cases: a null text is empty; texts under n bytes lose nothing; rows with a null id give no result; an id that
repeats keeps the text that sorts first; an empty table gives no rows; columns other than the id and the text are not
read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, id_text, shuffle_width, tidy, unique
from .ngram_join import scramble

K = 32
#: Period and residues of a perfect difference cover: any two residues mod 31 are a common shift away from these.
V, COVER = 31, (0, 1, 3, 8, 12, 18)
ROOT = np.uint64(0x9E3779B97F4A7C15)
UNROOT = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: Of the second hash, and its inverse.
ROOTS = (np.uint64(0xD1342543DE82EF95), np.uint64(pow(0xD1342543DE82EF95, -1, 1 << 64)))
VALUES = scramble(np.arange(1, 257, dtype=np.uint64))
#: Bytes of text that are anchored at a time.
CHUNK = 1 << 20
RECORD = np.dtype([("h", "<u8"), ("ctx", "<u8"), ("doc", "<i8"), ("low", "<u4"), ("len", "u1"), ("off", "u1")])
#: To the next sample position from each residue.
SHIFT = np.array([min((c - r) % V for c in COVER) for r in range(V)])


def _powers(n: int, cache: dict = {}) -> tuple[np.ndarray, np.ndarray]:  # noqa: B006
    if cache.get("n", 0) < n:
        up, down = np.full(n, ROOT), np.full(n, UNROOT)
        up[0] = down[0] = 1
        cache.update(n=n, up=np.cumprod(up), down=np.cumprod(down))
    return cache["up"][:n], cache["down"][:n]


def anchored(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, ids: np.ndarray, n: int) -> tuple[np.ndarray, dict]:
    """Records of the runs in texts that lie side by side in data, and the sums for hashes of any stretch."""
    w = n - K + 1
    size = len(data)
    up, down = _powers(size + 1)
    sums = np.zeros(size + 1, dtype=np.uint64)
    np.cumsum(VALUES[data] * up[:size], out=sums[1:])
    stretch = {"sums": sums, "down": down}
    if size < n:
        return np.zeros(0, RECORD), stretch
    grams = scramble((sums[K:] - sums[:-K]) * down[: size - K + 1])
    place = np.arange(len(grams), dtype=np.uint64)
    key = (grams & ~np.uint64(0xFFFFFF)) | (np.uint64(0xFFFFFF) - place)
    least = _sliding_min(key, w)
    anchor = (np.uint64(0xFFFFFF) - (least & np.uint64(0xFFFFFF))).astype(np.int64)
    s = np.arange(len(anchor))
    owner = np.searchsorted(ends, s, side="right")
    fits = (owner < len(ends)) & (s + n <= ends[np.minimum(owner, len(ends) - 1)])
    change = np.ones(len(anchor), dtype=bool)
    change[1:] = (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1]) | ~fits[:-1]
    low = np.flatnonzero(change & fits)
    # a run ends before the next change or the first string that does not fit
    stop = np.flatnonzero(np.concatenate([change | ~fits, [True]]))
    high = stop[np.searchsorted(stop, low, side="right")] - 1
    out = np.zeros(len(low), RECORD)
    at = anchor[low]
    out["h"] = grams[at]
    out["off"], out["len"] = at - low, high - low
    out["ctx"] = _hash(stretch, low, high + n, out["off"], out["len"])
    out["doc"], out["low"] = ids[owner[low]], low - starts[owner[low]]
    return out, stretch


def _hash(stretch: dict, a: np.ndarray, b: np.ndarray, off: np.ndarray, length: np.ndarray) -> np.ndarray:
    whole = (stretch["sums"][b] - stretch["sums"][a]) * stretch["down"][a]
    return scramble(whole + off.astype(np.uint64) * ROOT + (length.astype(np.uint64) << np.uint64(40)))


def _second(data: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Another 64 bits of the strings of n bytes at these places, independent of ``_hash``: with it equality has 128."""
    up, down = np.full(len(data) + 1, ROOTS[0]), np.full(len(data) + 1, ROOTS[1])
    up[0] = down[0] = 1
    np.cumprod(up, out=up)
    np.cumprod(down, out=down)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(scramble(VALUES[data]) * up[:-1], out=sums[1:])
    return scramble((sums[at + n] - sums[at]) * down[at])


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w neighbours: of a block's rest and of the next block's begin."""
    n = len(x) - w + 1
    blocks = -(-len(x) // w)
    padded = np.full(blocks * w, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[: len(x)] = x
    grid = padded.reshape(blocks, w)
    front = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], front[w - 1 : w - 1 + n])


def _texts(batch: pa.RecordBatch):
    """Chunks of whole texts as (bytes, starts, ends, ids)."""
    ids = batch.column(0).to_numpy()
    column = batch.column(1)
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    first = 0
    while first < len(ids):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + CHUNK, side="right")) - 1)
        yield data[offsets[first] : offsets[last]], offsets[first:last] - offsets[first], offsets[first + 1 : last + 1] - offsets[first], ids[first:last]
        first = last


def _pieces(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, ids: np.ndarray, n: int):
    """As ``anchored``; a text beyond the chunk size goes through in overlapping parts, so that memory stays bounded."""
    if len(data) <= 4 * CHUNK:
        yield (*anchored(data, starts, ends, ids, n), 0)
        return
    for low in range(0, len(data), CHUNK):
        part = data[low : low + CHUNK + n - 1]
        records, stretch = anchored(part, np.zeros(1, int), np.array([len(part)]), ids[:1], n)
        records["low"] += low
        yield records, stretch, low
        if low + CHUNK + n - 1 >= len(data):
            break


def _first_of_equal(records: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Records sorted by anchor, context, id and start, and whether each is the first of its (anchor, context)."""
    r = records[np.lexsort((records["low"], records["doc"], records["ctx"], records["h"]))]
    first = np.ones(len(r), dtype=bool)
    first[1:] = (r["h"][1:] != r["h"][:-1]) | (r["ctx"][1:] != r["ctx"][:-1])
    return r, first


def _stretches(gone: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, low, high) of all that these runs cover, where strings that overlap or touch make one."""
    r = gone[np.lexsort((gone["low"], gone["doc"]))]
    doc, low = r["doc"].astype(np.int64), r["low"].astype(np.int64)
    high = low + r["len"] + n
    group = np.cumsum(np.diff(doc, prepend=doc[:1]) != 0)
    reach = np.maximum.accumulate(high + (group << 40)) - (group << 40)
    new = np.ones(len(r), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (low[1:] > reach[:-1])
    first = np.flatnonzero(new)
    return doc[first], low[first], reach[np.append(first[1:], len(r))[: len(first)] - 1]


def _crowded(docs: DataFrame, n: int, least: int, most: int, records: float) -> np.ndarray:
    """Anchors with an equal part (one in ``most``) of all records and ``least`` at least, which bounds their number.

    All texts are looked at; a sixteenth of them, by id, tells the anchors that are frequent over all chunks but not in
    any.  The choice decides the cost, never the result."""
    schema = pa.schema([("_h", pa.int64()), ("_n", pa.int64())])

    def run(batches):
        for batch in batches:
            for chunk in _texts(batch):
                for records, _, _ in _pieces(*chunk, n):
                    h, times = _told(records[_distinct(records)], least)
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(times)], schema=schema)

    found = docs.mapInArrow(tidy(run), "_h long, _n long").groupBy("_h").agg(F.sum("_n").alias("_n")).where(F.col("_n") >= max(records / most, least))
    return np.sort(found.select("_h").toArrow()["_h"].to_numpy().view(np.uint64))


def _told(records: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(anchors, how often) of a chunk: counted where they are frequent in it, else 16 times what the told texts hold.

    Told by text, not by chunk: so their number follows the input, however it is cut into chunks."""
    h, place, times = np.unique(records["h"], return_inverse=True, return_counts=True)
    told = scramble(records["doc"].astype(np.int64).view(np.uint64)) % np.uint64(16) == 0
    times = np.where(times >= max(1, least // 4), times, 16 * np.bincount(place[told], minlength=len(h)))
    return h[times > 0], times[times > 0].astype(np.int64)


def _distinct(records: np.ndarray) -> np.ndarray:
    order = np.lexsort((records["ctx"], records["h"]))
    r = records[order]
    first = np.ones(len(r), dtype=bool)
    first[1:] = (r["h"][1:] != r["h"][:-1]) | (r["ctx"][1:] != r["ctx"][:-1])
    return order[first]


SPAN = "_doc long, _low long, _high long"
BLOB = pa.schema([("_bucket", pa.int32()), ("_blob", pa.binary()), ("_doc", pa.int64()), ("_low", pa.int64()), ("_high", pa.int64())])


def _blobs(docs: DataFrame, n: int, crowded: np.ndarray, buckets: int) -> DataFrame:
    """Records by bucket, and spans that a chunk settles by itself."""

    def string_by_string(records):
        """The runs of crowded anchors as runs of one string each, under the string's own hash."""
        times = records["len"].astype(np.int64) + 1
        out = np.repeat(records, times)
        step = np.arange(len(out)) - np.repeat(np.cumsum(times) - times, times)
        return out, step

    def run(batches):
        for batch in batches:
            for data, starts, ends, ids in _texts(batch):
                of = dict(zip(ids.tolist(), starts.tolist(), strict=True))
                for records, stretch, shift in _pieces(data, starts, ends, ids, n):
                    if len(crowded):
                        hot = np.isin(records["h"], crowded)
                        if hot.any():
                            single, step = string_by_string(records[hot])
                            single["low"] += step.astype(np.uint32)
                            at = single["low"].astype(np.int64) - shift + (np.array([of[d] for d in single["doc"].tolist()]) if not shift and len(ids) > 1 else 0)
                            single["off"] = single["len"] = 0
                            single["h"] = _hash(stretch, at, at + n, single["off"], single["len"])
                            single["ctx"] = _second(data[shift : shift + len(stretch["sums"]) - 1], at, n)
                            records = np.concatenate([records[~hot], single])
                    r, first = _first_of_equal(records)
                    doc, low, high = _stretches(r[~first], n)
                    yield pa.RecordBatch.from_arrays([pa.nulls(len(doc), pa.int32()), pa.nulls(len(doc), pa.binary()), pa.array(doc), pa.array(low), pa.array(high)], schema=BLOB)
                    r = r[first]
                    bucket = (r["h"] % np.uint64(buckets)).astype(np.int32)
                    r = r[np.argsort(bucket, kind="stable")]
                    bucket.sort()
                    cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
                    packed = [_pack(x) for x in np.split(r, cuts[1:])] if len(r) else []
                    none = pa.nulls(len(packed), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(bucket[cuts]), pa.array(packed, pa.binary()), none, none, none], schema=BLOB)

    return docs.mapInArrow(tidy(run), "_bucket int, _blob binary, " + SPAN)


def _pack(r: np.ndarray) -> bytes:
    """Columns side by side: hashes as they are, the rest, which repeats, compressed."""
    order = np.lexsort((r["low"], r["doc"]))
    r = r[order]
    rest = zlib.compress(np.diff(r["doc"], prepend=0).astype("<i8").tobytes() + r["low"].astype("<u4").tobytes() + r["len"].tobytes() + r["off"].tobytes(), 1)
    return len(r).to_bytes(4, "little") + r["h"].tobytes() + r["ctx"].tobytes() + rest


def _unpack(blob: bytes) -> np.ndarray:
    m = int.from_bytes(blob[:4], "little")
    out = np.zeros(m, RECORD)
    out["h"] = np.frombuffer(blob, "<u8", m, 4)
    out["ctx"] = np.frombuffer(blob, "<u8", m, 4 + 8 * m)
    rest = zlib.decompress(blob[4 + 16 * m :])
    out["doc"] = np.cumsum(np.frombuffer(rest, "<i8", m))
    out["low"] = np.frombuffer(rest, "<u4", m, 8 * m)
    out["len"] = np.frombuffer(rest, "u1", m, 12 * m)
    out["off"] = np.frombuffer(rest, "u1", m, 13 * m)
    return out


def _settle(table: pa.Table, n: int) -> pa.Table:
    """One bucket: spans of runs whose context stands earlier; first runs of anchors with several contexts, to compare."""
    records = np.concatenate([_unpack(b) for b in table.column("_blob").to_pylist()])
    r, first = _first_of_equal(records)
    new = np.ones(len(r), dtype=bool)
    new[1:] = r["h"][1:] != r["h"][:-1]
    group = np.cumsum(new) - 1
    classes = np.bincount(group, weights=first)
    open_ = first & (classes[group] > 1)
    gone = ~first
    h = r["h"].view(np.int64)
    take = np.flatnonzero(gone | open_)
    low = r["low"][take].astype(np.int64)
    return pa.table({"_doc": r["doc"][take].astype(np.int64), "_low": low, "_high": low + r["len"][take] + n, "_h": pa.array(h[take], mask=gone[take]), "_off": pa.array(r["off"][take].astype(np.int32))})


def compare_bucket(h: np.ndarray, doc: np.ndarray, low: np.ndarray, off: np.ndarray, texts: list[bytes], n: int) -> list[tuple[int, int, int]]:
    """Spans of the strings of these contexts that stand earlier in another one with the same anchor."""
    size = np.array([len(t) for t in texts], dtype=np.int64)
    # anchors at multiples of V, and room for the sample beyond the last string
    lead = -off % V
    room = -(-(lead + size + n + 2 * V) // V) * V
    base = np.concatenate([[0], np.cumsum(room)[:-1]]) + lead
    x = np.zeros(int(room.sum()) + 4 * V, dtype=np.uint8)
    for b, t in zip(base.tolist(), texts, strict=True):
        x[b : b + len(t)] = np.frombuffer(t, dtype=np.uint8)
    # ranks of the sample by V, 2 V and 4 V bytes: position p + V is in the sample with p
    sample = np.concatenate([np.arange(c, len(x) - 4 * V, V) for c in COVER])
    sample.sort()
    grams = np.lib.stride_tricks.sliding_window_view(x, V)
    rank = np.zeros(len(x), dtype=np.int64)
    rank[sample] = np.unique(np.ascontiguousarray(grams[sample]).view(f"S{V}").ravel(), return_inverse=True)[1] + 1
    width = V
    while width < n:
        key = rank[sample] << 32 | rank[np.minimum(sample + width, len(x) - 1)]
        then = np.zeros_like(rank)
        then[sample] = np.unique(key, return_inverse=True)[1] + 1
        rank, width = then, 2 * width
    times = size - n + 1
    run = np.repeat(np.arange(len(texts)), times)
    step = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    at = base[run] + step
    front = np.unique(np.ascontiguousarray(grams[at]).view(f"S{V}").ravel(), return_inverse=True)[1]
    place = off[run] - step  # of the anchor in the string
    tie = rank[at + SHIFT[at % V]]
    start = low[run] + step
    order = np.lexsort((start, doc[run], tie, front, place, h[run]))
    o, p = order[1:], order[:-1]
    close = np.flatnonzero((h[run[o]] == h[run[p]]) & (place[o] == place[p]) & (front[o] == front[p]))
    equal = np.zeros(len(order), dtype=bool)
    whole = np.lib.stride_tricks.sliding_window_view(x, n)
    for a in range(0, len(close), 1 << 16):
        c = close[a : a + (1 << 16)]
        equal[c + 1] = (whole[at[o[c]]] == whole[at[p[c]]]).all(axis=1)
    # of equal strings all but the smallest (id, start) go
    group = np.cumsum(~equal) - 1
    again = np.lexsort((start[order], doc[run[order]], group))
    rest = np.ones(len(again), dtype=bool)
    rest[0:1] = False
    rest[1:] = group[again][1:] == group[again][:-1]
    gone = np.sort(order[again[rest]])
    if not len(gone):
        return []
    begin = np.ones(len(gone), dtype=bool)
    begin[1:] = (gone[1:] != gone[:-1] + 1) | (run[gone[1:]] != run[gone[:-1]])
    firsts = np.flatnonzero(begin)
    lasts = np.concatenate([firsts[1:] - 1, [len(gone) - 1]])
    return list(zip(doc[run[gone[firsts]]].tolist(), start[gone[firsts]].tolist(), (start[gone[lasts]] + n).tolist(), strict=True))


def repeated_spans(docs: DataFrame, *, n=100, crowd=48, max_crowded=1 << 16, bucket_bytes=8 << 20) -> DataFrame:
    """(_doc, _low, _high): stretches of each text's bytes to remove, which may touch and overlap.

    docs: unique _id and _text.  ``max_crowded`` bounds the list of crowded anchors that is sent to all tasks: each has
    that part of all records.
    """
    total = docs.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    buckets = max(shuffle_width(docs.sparkSession), int(total * 3 / (n - K + 2) * 18 / bucket_bytes))
    made = _blobs(docs, n, _crowded(docs, n, crowd, max_crowded, total * 3 / (n - K + 2)), buckets)
    schema = SPAN + ", _h long, _off int"
    settled = made.select(F.coalesce("_bucket", F.pmod(F.xxhash64("_doc"), F.lit(buckets)).cast("int")).alias("_bucket"), "_blob", "_doc", "_low", "_high")

    def settle(table: pa.Table) -> pa.Table:
        alone = table.filter(pa.compute.is_null(table.column("_blob"))).select(["_doc", "_low", "_high"])
        alone = alone.append_column("_h", pa.nulls(len(alone), pa.int64())).append_column("_off", pa.nulls(len(alone), pa.int32()))
        rest = table.filter(pa.compute.is_valid(table.column("_blob")))
        target = pa.schema([("_doc", pa.int64()), ("_low", pa.int64()), ("_high", pa.int64()), ("_h", pa.int64()), ("_off", pa.int32())])
        return pa.concat_tables([alone.cast(target), *([_settle(rest, n).cast(target)] if len(rest) else [])])

    found = cut(settled.groupBy("_bucket").applyInArrow(settle, schema))
    open_ = found.where("_h IS NOT NULL").groupBy("_doc").agg(F.collect_list(F.struct("_h", "_off", "_low", "_high")).alias("_runs"))
    ctx_schema = pa.schema([("_bucket", pa.int32()), ("_h", pa.int64()), ("_doc", pa.int64()), ("_low", pa.int64()), ("_off", pa.int32()), ("_ctx", pa.binary())])

    def contexts(batches):
        for batch in batches:
            rows = []
            for i, text, runs in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                data = text.encode("utf-8", "surrogatepass")
                rows += [(x["_h"] % buckets, x["_h"], i, x["_low"], x["_off"], data[x["_low"] : x["_high"]]) for x in runs]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(ctx_schema)], schema=ctx_schema)

    cases = docs.join(open_, docs["_id"] == open_["_doc"]).select("_id", "_text", "_runs").mapInArrow(tidy(contexts), "_bucket int, _h long, _doc long, _low long, _off int, _ctx binary")
    span_schema = pa.schema([("_doc", pa.int64()), ("_low", pa.int64()), ("_high", pa.int64())])

    def compare(table: pa.Table) -> pa.Table:
        h, doc, low, off = (table.column(c).to_numpy() for c in ("_h", "_doc", "_low", "_off"))
        order = np.argsort(h, kind="stable")
        texts = table.column("_ctx").to_pylist()
        cuts = np.flatnonzero(np.diff(h[order], prepend=h[order][0] - 1 if len(order) else 0))
        spans, start = [], 0
        cuts = [*cuts.tolist(), len(order)]
        for a, b in zip(cuts, cuts[1:], strict=False):  # some anchors at a time, whole ones
            if b - start >= 4000 or b == len(order):
                take = order[start:b]
                spans += compare_bucket(h[take], doc[take], low[take], off[take].astype(np.int64), [texts[k] for k in take.tolist()], n)
                start = b
        return pa.Table.from_arrays([pa.array([s[k] for s in spans], pa.int64()) for k in range(3)], schema=span_schema)

    return found.where("_h IS NULL").select("_doc", "_low", "_high").union(cases.groupBy("_bucket").applyInArrow(compare, SPAN))


def _merged(spans: list, size: int) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for low, high in sorted(spans):
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], high))
        else:
            out.append((low, high))
    return [(a, min(b, size)) for a, b in out]


def deduplicate(docs: DataFrame, *, id_col="doc_id", text_col="text", n=100, **options) -> DataFrame:
    """_id, n_bytes, spans (removed runs, maximal, of bytes) and kept (the remaining bytes) of each distinct id."""
    rows = unique(id_text(docs, id_col, text_col).where("_id IS NOT NULL"))
    spans = repeated_spans(rows, n=n, **options).groupBy("_doc").agg(F.collect_list(F.struct("_low", "_high")).alias("_spans"))
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
    schema = pa.schema([("_id", pa.int64()), ("n_bytes", pa.int64()), ("spans", pa.list_(span)), ("kept", pa.binary())])

    def run(batches):
        for batch in batches:
            out = []
            for i, text, found in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                data = text.encode("utf-8", "surrogatepass")
                gone = _merged([(x["_low"], x["_high"]) for x in found or ()], len(data))
                out.append((i, len(data), [{"start": a, "end": b} for a, b in gone], _without(data, gone)))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], f.type) for k, f in enumerate(schema)], schema=schema)

    whole = rows.join(spans, rows["_id"] == spans["_doc"], "left").select("_id", "_text", "_spans")
    return whole.mapInArrow(tidy(run), "_id long, n_bytes long, spans array<struct<start: bigint, `end`: bigint>>, kept binary")


def _without(data: bytes, gone: list[tuple[int, int]]) -> bytes:
    at, kept = 0, []
    for a, b in gone:
        kept.append(data[at:a])
        at = b
    return b"".join([*kept, data[at:]])


def remove_repeats(docs: DataFrame, *, id_col="doc_id", text_col="text", n=100, **options) -> DataFrame:
    """The documents, all columns as they were but the text, which loses its removed bytes (and what is left of a cut
    character).  Rows with a null id, a null text, or another text than the first of their id stay as they are."""
    rows = unique(id_text(docs, id_col, text_col).where("_id IS NOT NULL"))
    spans = repeated_spans(rows, n=n, **options).groupBy("_doc").agg(F.collect_list(F.struct("_low", "_high")).alias("_spans"))
    spans = spans.join(rows.select(F.col("_id").alias("_doc"), F.xxhash64("_text").alias("_key")), "_doc")
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), F.col(f"`{id_col}`").cast("long").alias("_id"), F.col(f"`{text_col}`").alias("_text"))
    whole = whole.join(spans, (whole["_id"] == spans["_doc"]) & (F.xxhash64(whole["_text"]) == spans["_key"]), "left")

    @F.arrow_udf("string")
    def cleaned(texts: pa.Array, found: pa.Array) -> pa.Array:
        out = []
        for text, spans_ in zip(texts.to_pylist(), found.to_pylist(), strict=True):
            data = text.encode("utf-8", "surrogatepass")
            out.append(_without(data, _merged([(x["_low"], x["_high"]) for x in spans_], len(data))).decode("utf-8", "ignore"))
        return pa.array(out, pa.string())

    text = F.when(F.col("_spans").isNotNull() & F.col("_text").isNotNull(), cleaned(F.coalesce("_text", F.lit("")), F.coalesce("_spans", F.array().cast("array<struct<_low:bigint,_high:bigint>>")))).otherwise(F.col("_text"))
    done = whole.withColumn("_clean", text)
    return done.select(*(F.col("_clean").alias(c) if c == text_col else F.col("_row")[c].alias(c) for c in docs.columns))
