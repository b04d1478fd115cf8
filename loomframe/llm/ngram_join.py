"""N-gram Jaccard join by T-occurrence search with DivideSkip.

A document is its set of distinct word shingles (three words unless given), as 64-bit hashes; each shingle has an inverted
list of the documents that hold it.  A partner of a set of n shingles shares at least T = ceil(0.9 n) of them (0.9: the
similarity).  DivideSkip sets the L = T - k longest lists of a set aside, merges the n - L short ones, keeps what occurs in
them k times at least, and probes the long ones by binary search until T is met or out of reach.

* Lengths.  Shingles are asked for their documents over the whole corpus: each batch sends its distinct ones by hash
  range, ranges add the counts up and answer on a scale of quarter powers of two.  A share of the shingles, by hash, that
  holds the short lists is enough.  A set whose short lists hold nobody else but k - 1 times at most has no partner and
  drops out here.
* Merge.  Sets that are equal become one representative.  The short lists are merged by a shuffle sorted by shingle; the
  occurrences of each pair are added up, and pairs under their k drop out.
* Skip.  Pairs are probed: one set's shingles are searched in the other's, in steps that end when too many are missing.

No list is expanded into all its pairs.  In one longer than ``small`` each document meets the list's last differing head;
those links are verified and their components found.  Then only documents outside a list's largest component ask the
others, in blocks of ``block``, behind the filters of sizes and sketches (odd bits, whose Hamming distance never exceeds
the number of shingles that differ): a round over a quarter of the lists with a few partners each, then one over all.  So a
group of copies costs about its own size.

Defined cases: a null text is empty; a text without words has no set and links with nothing; a text of one or two
words has its whole sequence as one shingle; repeated rows of an id keep the text that sorts first; rows with a null
id give no result; an empty table gives no rows; columns other than the id and the text are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER_ASCII, cut, few, id_text, shuffle_width, slices, tidy, unique
from .components import connected

#: Odd multipliers of the shingle hash.
MIX = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
#: Words of the sketches that go with long lists, at most: 1024 to 4096 bits, by the document's size.
FOLDS = (16, 32, 64)
#: Pairs whose sketches are compared at a time.
PAIRS = 1 << 14
#: Hashes of words that a task keeps (some 30 MB).
MOST_WORDS = 200_000
#: Bytes of text that are shingled at a time.
SLICE = 3 << 20


def scramble(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * MIX[3]
    h = (h ^ (h >> np.uint64(27))) * MIX[4]
    return h ^ (h >> np.uint64(31))


class _Words(dict):
    """Hashes of words, made at the first look."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


class Shingler:
    """Texts to their sorted distinct shingle hashes; a word is hashed once for many texts."""

    def __init__(self, width: int = 3):
        self.width, self.words = width, _Words()

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.words) > MOST_WORDS:
            self.words.clear()
        words: list[bytes] = []
        ends = []
        for text in texts:
            words += text.encode("utf-8", "surrogatepass").translate(LOWER_ASCII).split()
            ends.append(len(words))
        a = np.fromiter(map(self.words.__getitem__, words), dtype=np.uint64, count=len(words))
        del words
        a *= MIX[0]
        whole = self.mixed(a, self.width)
        out, start = [], 0
        for end in ends:
            n = end - start
            h = np.sort(whole[start : end - self.width + 1] if n >= self.width else self.mixed(a[start:end], max(1, n)))
            new = np.ones(len(h), dtype=bool)
            np.not_equal(h[1:], h[:-1], out=new[1:])
            out.append(h if new.all() else h[new])
            start = end
        return out

    @staticmethod
    def mixed(a: np.ndarray, width: int) -> np.ndarray:
        """Of each ``width`` neighbours."""
        n = max(0, len(a) - width + 1)
        h = np.full(n, MIX[width % 5])
        for k in range(width):
            h = scramble(h + a[k : n + k])
        return h


def sketch(h: np.ndarray) -> bytes:
    """At least twice as many bits as shingles, a power of two: bit b is set where an odd number falls on b."""
    bits = 1 << max(10, (2 * max(1, len(h)) - 1).bit_length())
    odd = np.bincount((h >> np.uint64(7)).astype(np.int64) & (bits - 1), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def fold(data: bytes, words: int) -> np.ndarray:
    """A sketch with fewer bits: its parts of that length, combined by exclusive or."""
    return np.bitwise_xor.reduce(np.frombuffer(data, dtype=np.uint64).reshape(-1, words), axis=0)


def least_overlap(n: np.ndarray | int, t: int) -> np.ndarray | int:
    """T = ceil(t n / 100): what any partner of a set of n shares with it."""
    return (t * n + 99) // 100


def occurrences(n: np.ndarray | int, t: int) -> np.ndarray | int:
    """k: how often a partner occurs in the short lists at least.  A larger set merges more lists and trusts one less."""
    return np.minimum(least_overlap(n, t), 1 + (np.asarray(n) >= 30) + (np.asarray(n) >= 150))


def short_lists(n: np.ndarray | int, t: int) -> np.ndarray | int:
    """n - L."""
    return n - least_overlap(n, t) + occurrences(n, t)


# -- lengths of the lists -----------------------------------------------------------------------------------------

BATCH = pa.schema([("_batch", pa.int64()), ("_ids", pa.binary()), ("_taken", pa.binary()), ("_keys", pa.binary())])
SIGN = np.dtype([("id", "<i8"), ("n", "<i8"), ("f1", "<i8"), ("f2", "<i8")])


def _narrow(keys: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of each key."""
    return np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def _wide(data: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(data) // width, 8), dtype=np.uint8)
    out[:, :width] = np.frombuffer(data, dtype=np.uint8).reshape(-1, width)
    return out.view("<u8").ravel()


def _batches(rows: DataFrame, t: int, width: int, share: int, bits: int) -> DataFrame:
    """A row for each batch: its documents' ids, set sizes and fingerprints, and the leading bits of the shingles that
    may be among their short lists: those whose hash falls under the share (of 256), and others where these are too few."""

    def run(batches):
        shingles, task = Shingler(width), TaskContext.get().partitionId() << 32
        for number, part in enumerate(slices(batches, SLICE)):
            sets = shingles(part.column(1).to_pylist())
            n = np.array([len(h) for h in sets], dtype=np.int64)
            signs = np.zeros(len(sets), dtype=SIGN)
            signs["id"], signs["n"] = part.column(0).to_numpy(), n
            flat, full = np.concatenate(sets), n > 0
            if full.any():
                first = (np.cumsum(n) - n)[full]
                two = scramble(flat * MIX[1])
                signs["f1"][full] = np.add.reduceat(flat, first).view(np.int64)
                signs["f2"][full] = (np.add.reduceat(two, first) ^ np.bitwise_xor.reduceat(two, first)).view(np.int64)
            low = (flat & np.uint64(255)) < np.uint64(share)
            keys = flat >> np.uint64(32 - bits)
            need, sampled = short_lists(n, t), np.add.reduceat(np.append(low, False).astype(np.int64), np.append(np.cumsum(n) - n, len(flat)))[:-1] * full
            taken = np.stack([sampled, np.maximum(0, np.minimum(need - sampled, n - sampled))], axis=1)
            out, at = [], 0
            for m, (_, rest) in zip(n.tolist(), taken.tolist(), strict=True):
                own = low[at : at + m]
                out.append(keys[at : at + m][own])
                if rest:
                    out.append(keys[at : at + m][~own][:rest])
                at += m
            chosen = np.concatenate(out) if out else keys
            yield pa.RecordBatch.from_arrays([pa.array([task | number]), pa.array([signs.tobytes()]), pa.array([taken.astype("<i4").tobytes()]), pa.array([_narrow(chosen, -(-(32 + bits) // 8))])], schema=BATCH)

    return rows.mapInArrow(tidy(run), "_batch long, _ids binary, _taken binary, _keys binary")


def _opened(taken: bytes, keys: bytes, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(numbers taken by document, all keys, whether each is of the share)."""
    counts = np.frombuffer(taken, "<i4").reshape(-1, 2).astype(np.int64)
    flat = _wide(keys, -(-(32 + bits) // 8))
    sampled = np.repeat(np.tile([True, False], len(counts)), counts.ravel())
    return counts, flat, sampled


def _asked(batches: DataFrame, bits: int) -> DataFrame:
    """(range, batch, keys of 32 bits in that range, how many of the batch's documents hold each)."""
    schema = pa.schema([("_range", pa.int32()), ("_batch", pa.int64()), ("_keys", pa.binary()), ("_held", pa.binary())])

    def run(stream):
        for many in stream:
            for batch, taken, keys in zip(*(many.column(k).to_pylist() for k in (0, 2, 3)), strict=True):
                _, flat, sampled = _opened(taken, keys, bits)
                distinct, held = np.unique(flat[sampled], return_counts=True)
                place = (distinct >> np.uint64(32)).astype(np.int32)
                edges = [0, *(np.flatnonzero(np.diff(place)) + 1).tolist(), len(place)] if len(place) else []
                low = distinct.astype("<u4")
                yield pa.RecordBatch.from_arrays([pa.array([int(place[a]) for a in edges[:-1]], pa.int32()), pa.array([batch] * len(edges[:-1]), pa.int64()), pa.array([low[a:b].tobytes() for a, b in zip(edges, edges[1:], strict=False)], pa.binary()), pa.array([zlib.compress(held[a:b].astype("<u4").tobytes(), 1) for a, b in zip(edges, edges[1:], strict=False)], pa.binary())], schema=schema)

    return batches.mapInArrow(tidy(run), "_range int, _batch long, _keys binary, _held binary")


def _lengths(table: pa.Table) -> pa.Table:
    """One range of all batches: how many documents hold each key, as ceil(4 log2) in a byte, in the order it was asked."""
    keys = [np.frombuffer(k, "<u4") for k in table.column("_keys").to_pylist()]
    held = [np.frombuffer(zlib.decompress(h), "<u4") for h in table.column("_held").to_pylist()]
    _, place = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(place, np.concatenate(held))
    level = np.minimum(255, np.ceil(4 * np.log2(total))).astype(np.uint8)[place]
    parts = np.split(level, np.cumsum([len(k) for k in keys])[:-1])
    return pa.table({"_range": table.column("_range").cast(pa.int32()), "_batch": table.column("_batch").cast(pa.int64()), "_levels": pa.array([zlib.compress(p.tobytes(), 1) for p in parts], pa.binary())})


def _signatures(rows: DataFrame, t: int, width: int, range_mb: int) -> DataFrame:
    """_id, _n, two fingerprints of the set, and its short lists' shingles where they can hold k partners, else none."""
    share = min(256, -(-256 * 5 * (100 - t) // 200))
    total = rows.agg(F.coalesce(F.sum(F.octet_length("_text")), F.lit(0))).first()[0]
    bits = max(0, int(max(min(64, shuffle_width(rows.sparkSession)), total * share // 256 // (range_mb << 20)) - 1).bit_length())
    batches = cut(_batches(rows, t, width, share, bits))
    answers = _asked(batches, bits).groupBy("_range").applyInArrow(_lengths, "_range int, _batch long, _levels binary").groupBy("_batch").agg(F.collect_list(F.struct("_range", "_levels")).alias("_answers"))
    schema = pa.schema([("_id", pa.int64()), ("_n", pa.int64()), ("_f1", pa.int64()), ("_f2", pa.int64()), ("_short", pa.list_(pa.int64()))])

    def run(stream):
        for many in stream:
            for ids, taken, data, answers in zip(*many.columns, strict=True):
                signs = np.frombuffer(ids.as_py(), SIGN)
                counts, flat, sampled = _opened(taken.as_py(), data.as_py(), bits)
                distinct = np.unique(flat[sampled])
                said = sorted((x["_range"], x["_levels"]) for x in answers.as_py() or ())
                level = np.full(len(flat), 255, dtype=np.int64)
                if said:
                    level[sampled] = np.frombuffer(b"".join(zlib.decompress(x) for _, x in said), np.uint8)[np.searchsorted(distinct, flat[sampled])]
                # rare ones first, then by key; those outside the share, whose lengths are not known, after them
                level[~sampled] = 256
                owner = np.repeat(np.arange(len(signs)), counts.sum(axis=1))
                order = np.lexsort((flat, level, owner))
                first = np.cumsum(counts.sum(axis=1)) - counts.sum(axis=1)
                keep = np.minimum(short_lists(signs["n"], t), counts.sum(axis=1))
                place = np.arange(len(flat)) - first[owner]
                order = order[place < keep[owner]]
                shared = np.bincount(owner[order], level[order] > 0, len(signs))
                live = shared >= np.maximum(1, occurrences(least_overlap(signs["n"], t), t))  # the smallest partner's k
                order = order[live[owner[order]]]
                ends = np.concatenate([[0], np.cumsum(np.where(live, keep, 0))])
                yield pa.RecordBatch.from_arrays([*(pa.array(signs[c]) for c in SIGN.names), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat[order].view(np.int64)))], schema=schema)

    return batches.join(answers, "_batch", "left").select("_ids", "_taken", "_keys", "_answers").mapInArrow(tidy(run), "_id long, _n long, _f1 long, _f2 long, _short array<long>")


# -- merge --------------------------------------------------------------------------------------------------------


def _tables(stream, keys: int):
    """Whole groups of rows with equal leading key columns, from batches sorted by them."""
    held: list[pa.RecordBatch] = []
    for batch in stream:
        if not batch.num_rows:
            continue
        held.append(batch)
        if sum(b.num_rows for b in held) < 50_000:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        starts = _bounds(table, keys)[1:-1]
        if not len(starts):
            continue
        yield table.slice(0, starts[-1])
        held = table.slice(starts[-1]).to_batches()
    if held:
        yield pa.Table.from_batches(held)


def _bounds(table: pa.Table, keys: int) -> np.ndarray:
    change = np.zeros(table.num_rows + 1, dtype=bool)
    change[[0, -1]] = True
    for k in range(keys):
        column = table.column(k).to_numpy()
        change[1:-1] |= column[1:] != column[:-1]
    return np.flatnonzero(change)


#: Kinds of what the merge gives: a pair of a short list and how often, a document and its list's head, a long list's member.
PAIR, HEAD, MEMBER = 0, 1, 2


def _merged(postings: DataFrame, t: int, small: int) -> DataFrame:
    """(kind, a, b, list, number, least): see above; for members b is null and a is the member."""
    schema = pa.schema([("_kind", pa.int32()), ("_a", pa.int64()), ("_b", pa.int64()), ("_token", pa.int64()), ("_number", pa.int64()), ("_least", pa.int64())])

    def pairs(kind, rep, n, a, b):
        good = (rep[a] != rep[b]) & (100 * np.minimum(n[a], n[b]) >= t * np.maximum(n[a], n[b]))
        a, b = a[good], b[good]
        ends = np.stack([np.minimum(rep[a], rep[b]), np.maximum(rep[a], rep[b]), np.minimum(occurrences(n[a], t), occurrences(n[b], t))], axis=1)
        found, times = np.unique(ends, axis=0, return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(found), kind, np.int32)), pa.array(found[:, 0]), pa.array(found[:, 1]), pa.nulls(len(found), pa.int64()), pa.array(times.astype(np.int64)), pa.array(found[:, 2] if kind == PAIR else np.ones(len(found), np.int64))], schema=schema)

    def run(stream):
        for table in _tables(stream, 1):
            at = _bounds(table, 1)
            token, n, rep = (table.column(k).to_numpy() for k in range(3))
            size = np.diff(at)
            a, b = [], []
            for s in range(2, small + 1):  # all lists of one length together
                first = at[:-1][size == s]
                for i in range(s):
                    for j in range(i + 1, s):
                        a.append(first + i)
                        b.append(first + j)
            if a:
                yield pairs(PAIR, rep, n, np.concatenate(a), np.concatenate(b))
            heads, members = [], np.flatnonzero(np.repeat(size > small, size))
            for start, stop in zip(at[:-1][size > small].tolist(), at[1:][size > small].tolist(), strict=True):
                sizes, head = n[start:stop], 0
                own = np.empty(stop - start, dtype=np.int64)
                while head < len(sizes):  # sorted by size: a head serves those that are not too large for it
                    then = int(np.searchsorted(sizes, 100 * sizes[head] // t, side="right"))
                    own[head:then] = start + head
                    head = then
                heads.append(own)
            if heads:
                yield pairs(HEAD, rep, n, np.concatenate(heads), members)
                m = len(members)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(m, MEMBER, np.int32)), pa.array(rep[members]), pa.nulls(m, pa.int64()), pa.array(token[members]), pa.array(np.ones(m, np.int64)), pa.array(np.ones(m, np.int64))], schema=schema)

    return postings.select("_token", "_n", "_rep").repartition("_token").sortWithinPartitions("_token", "_n", "_rep").mapInArrow(tidy(run), "_kind int, _a long, _b long, _token long, _number long, _least long")


# -- skip ---------------------------------------------------------------------------------------------------------


def _sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(_rep, _n, _sketch, _set) of the wanted ids."""
    schema = pa.schema([("_rep", pa.int64()), ("_n", pa.int64()), ("_sketch", pa.binary()), ("_set", pa.binary())])

    def run(batches):
        shingles = Shingler(width)
        for part in slices(batches, SLICE):
            sets = shingles(part.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(h) for h in sets], pa.int64()), pa.array([sketch(h) for h in sets], pa.binary()), pa.array([h.tobytes() for h in sets], pa.binary())], schema=schema)

    return docs.join(wanted, "_id", "left_semi").select("_id", "_text").mapInArrow(tidy(run), "_rep long, _n long, _sketch binary, _set binary")


def probed(head: np.ndarray, own: np.ndarray, t: int, step: int = 512) -> bool:
    """Whether two sorted sets meet the similarity: one is searched in the other, until too many are missing."""
    least = -(-t * (len(head) + len(own)) // (100 + t))
    may_miss = len(own) - least
    for low in range(0, len(own), step):
        x = own[low : low + step]
        may_miss -= int((head[np.minimum(np.searchsorted(head, x), len(head) - 1)] != x).sum())
        if may_miss < 0:
            return False
    return True


def _verified(pairs: DataFrame, sets: DataFrame, t: int, per_task: int = 256) -> DataFrame:
    """The pairs (a, b) that are links.  A set that many others ask for is sent to several tasks, ``per_task`` partners each."""
    sets = sets.select(F.col("_rep").alias("_id"), "_set")
    degree = pairs.groupBy("_a").agg(F.ceil(F.count("*") / per_task).cast("int").alias("_parts"))
    dealt = pairs.join(degree, "_a").select("_a", "_b", F.pmod(F.xxhash64("_b"), F.col("_parts")).cast("int").alias("_part"))
    heads = degree.join(sets, F.col("_a") == F.col("_id")).select("_a", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part"), F.lit(None).cast("long").alias("_b"), "_set")
    tails = dealt.join(sets, F.col("_b") == F.col("_id")).select("_a", "_part", "_b", "_set")
    schema = pa.schema([("_a", pa.int64()), ("_b", pa.int64())])

    def probe(batches):
        head = None
        for batch in batches:
            links = []
            for a, b, data in zip(*(batch.column(k) for k in (0, 2, 3)), strict=True):
                own = np.frombuffer(data.as_buffer(), dtype=np.uint64)
                if not b.is_valid:
                    head = own
                elif probed(head, own, t):
                    links.append((a.as_py(), b.as_py()))
            yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in links], pa.int64()) for c in (0, 1)], schema=schema)

    rows = heads.union(tails).repartition("_a", "_part").sortWithinPartitions("_a", "_part", F.col("_b").asc_nulls_first())
    return rows.mapInArrow(tidy(probe), "_a long, _b long")


# -- long lists ---------------------------------------------------------------------------------------------------


def _some(p: np.ndarray, q: np.ndarray, rep: np.ndarray, part: np.ndarray) -> np.ndarray:
    """Up to three pairs of each p: with the smallest component, and two by a hash of both, alike in every list."""
    first = lambda order, k: order[np.arange(len(order)) - np.searchsorted(p[order], p[order]) < k]
    mixed = scramble(rep[p].view(np.uint64) * MIX[0] + rep[q].view(np.uint64) * MIX[1])
    return np.unique(np.concatenate([first(np.lexsort((rep[q], part[q], p)), 1), first(np.lexsort((mixed, p)), 2)]))


def alike(p: np.ndarray, q: np.ndarray, n: np.ndarray, wide: np.ndarray, bits: dict[int, np.ndarray], t: int) -> np.ndarray:
    """Which pairs their sizes and sketches do not rule out."""
    apart = np.zeros(len(p), dtype=np.int64)
    for w, b in bits.items():
        own = np.minimum(wide[p], wide[q]) == w
        apart[own] = np.bitwise_count(b[p[own]] ^ b[q[own]]).sum(axis=1, dtype=np.int64)
    return apart * (100 + t) <= (100 - t) * (n[p] + n[q])


def _apart(members: DataFrame, sets: DataFrame, parts: DataFrame, t: int, block: int, some: bool) -> DataFrame:
    """Pairs of different components in long lists that sizes and sketches do not rule out.

    Those outside a list's largest component ask, and all its members are asked; both in blocks.  some: only a few
    for each, which joins most of a large group's components at little cost before all that are still apart are looked at.
    """
    placed = members.join(parts, members["_rep"] == parts["node"], "left").select("_token", "_rep", F.coalesce("component", "_rep").alias("_component"))
    lists = placed.groupBy("_token", "_component").agg(F.count("*").alias("_c")).groupBy("_token").agg(F.max_by("_component", F.struct("_c", "_component")).alias("_main"), F.max("_c").alias("_most"), F.sum("_c").alias("_size")).where("_most < _size")
    open_ = placed.join(lists, "_token").join(sets.select("_rep", "_n", "_sketch"), "_rep").withColumn("_asks", F.col("_component") != F.col("_main"))
    blocks, asking = F.ceil(F.col("_size") / block).cast("int"), F.ceil((F.col("_size") - F.col("_most")) / block).cast("int")
    place = lambda n: F.pmod(F.xxhash64("_rep"), n).cast("int")
    seat = lambda i, j, asker: F.struct(i.alias("_i"), j.alias("_j"), F.lit(asker).alias("_asker"))
    every = lambda n, made: F.transform(F.sequence(F.lit(0), n - 1), made)
    asked = every(asking, lambda i: seat(i, place(blocks), False))
    asks = every(blocks, lambda j: seat(place(asking), j, True))
    seats = open_.withColumn("_seat", F.explode(F.when(F.col("_asks"), F.concat(asked, asks)).otherwise(asked)))
    dealt = seats.select("_token", "_seat._i", "_seat._j", "_seat._asker", "_rep", "_n", "_component", "_asks", "_sketch")
    schema = pa.schema([("_a", pa.int64()), ("_b", pa.int64())])

    def run(batches):
        for table in _tables(batches, 3):
            at = _bounds(table, 3)
            asker, rep, n, part, also = (table.column(c).to_numpy() for c in (3, 4, 5, 6, 7))
            drawn = table.column(8).to_pylist()
            wide = np.array([min(len(x) // 8, FOLDS[-1]) for x in drawn])
            bits = {w: np.array([fold(x, w) if len(x) >= 8 * w else np.zeros(w, np.uint64) for x in drawn], dtype=np.uint64).reshape(-1, w) for w in FOLDS if (wide >= w).any()}
            found = []
            for start, stop in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                asking = start + np.flatnonzero(asker[start:stop])
                others = start + np.flatnonzero(~asker[start:stop])
                for low in range(0, len(asking), 128):
                    x = asking[low : low + 128]
                    good = (part[x][:, None] != part[others][None]) & (100 * np.minimum(n[x][:, None], n[others][None]) >= t * np.maximum(n[x][:, None], n[others][None]))
                    good &= ~also[others][None] | (rep[x][:, None] < rep[others][None])  # where both ask, once
                    p, q = np.nonzero(good)
                    p, q = x[p], others[q]
                    near = np.concatenate([np.zeros(0, bool), *(alike(p[k : k + PAIRS], q[k : k + PAIRS], n, wide, bits, t) for k in range(0, len(p), PAIRS))])
                    p, q = p[near], q[near]
                    if some and len(p):
                        chosen = _some(p, q, rep, part)
                        p, q = p[chosen], q[chosen]
                    found.append(np.stack([np.minimum(rep[p], rep[q]), np.maximum(rep[p], rep[q])], axis=1))
            if found:
                pairs = np.unique(np.concatenate(found), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], schema=schema)

    return dealt.repartition("_token", "_i", "_j").sortWithinPartitions("_token", "_i", "_j").mapInArrow(tidy(run), "_a long, _b long")


def ngram_join(docs: DataFrame, *, id_col="doc_id", text_col="text", percent=90, width=3, small=8, block=1024, range_mb=96) -> DataFrame:
    """One row for each distinct id: _id, n_shingles, component_id (smallest id reachable by links).

    ``percent`` is the similarity, ``width`` the words of a shingle; ``range_mb`` of text go to each range of the count.
    """
    rows = unique(id_text(docs, id_col, text_col).where("_id IS NOT NULL"))
    signs = cut(_signatures(rows, percent, width, range_mb))
    classes = signs.where("_n > 0").groupBy("_n", "_f1", "_f2").agg(F.min(F.struct("_id", "_short")).alias("_first")).select("_n", "_f1", "_f2", F.col("_first._id").alias("_rep"), F.col("_first._short").alias("_short"))
    postings = classes.select(F.explode("_short").alias("_token"), "_rep", "_n")
    found = _merged(postings, percent, small).groupBy("_kind", "_a", "_b", "_token").agg(F.sum("_number").alias("_number"), F.min("_least").alias("_least"))
    found = cut(found.where("_number >= _least").select("_kind", "_a", "_b", "_token"))
    wanted = found.select(F.explode(F.array("_a", "_b")).alias("_id")).where("_id IS NOT NULL").distinct()
    sets = cut(_sets(rows, wanted, width))
    pairs = cut(found.where(F.col("_kind") != MEMBER).select("_a", "_b").distinct().coalesce(few(docs.sparkSession)))
    parts = connected(_verified(pairs, sets, percent), "_a", "_b")
    members = found.where(F.col("_kind") == MEMBER).select("_token", F.col("_a").alias("_rep"))
    if members.head(1):
        for test in ("pmod(_token, 4) = 0", "true"):
            rest = cut(_apart(members.where(test), sets, parts, percent, block, test != "true").distinct().coalesce(few(docs.sparkSession)))
            if rest.head(1):
                links = _verified(rest, sets, percent)
                parts = connected(parts.select(F.col("node").alias("_a"), F.col("component").alias("_b")).union(links), "_a", "_b")
    reps = classes.select("_n", "_f1", "_f2", "_rep").join(parts, F.col("_rep") == parts["node"], "left").select("_n", "_f1", "_f2", F.coalesce("component", "_rep").alias("component_id"))
    return signs.join(reps, ["_n", "_f1", "_f2"], "left").select("_id", F.col("_n").alias("n_shingles"), F.coalesce("component_id", "_id").alias("component_id"))


def keep_one_of_each(docs: DataFrame, *, id_col="doc_id", text_col="text", **options) -> DataFrame:
    """The documents that are their component's smallest id, all columns as they were; rows with a null id stay.

    Rows that repeat an id stay together.
    """
    gone = ngram_join(docs, id_col=id_col, text_col=text_col, **options).where("_id <> component_id").select("_id")
    return docs.join(gone, docs[id_col].cast("long") == gone["_id"], "left_anti")
