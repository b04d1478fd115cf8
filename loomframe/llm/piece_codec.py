"""SentencePiece encoding and decoding by suffix-array matching.

Blanks become U+2581 and one is put before the text, as the model file asks; pieces hold that sign only in front, so a
text falls into units (signs, then other characters) that no merge crosses.  The units that a task has not seen yet
are concatenated; a suffix array of that text is built; every piece of the vocabulary is binary-searched in it, which
gives its range of occurrences; the resulting edges are sorted by their end and relaxed from left to right, all units
at once.

The model is of the merging kind, for which the best path by summed scores is not what its encoder returns.  So the
relaxation keeps, of the edges that end at a place, the one that is *compatible* with the piece before it: the two
stay apart when their concatenation is merged by rank.  That one is unique, and the path is exactly the encoder's.
Characters outside the vocabulary become their UTF-8 bytes' pieces.  Runs of blanks, whose merges all have one rank,
are merged by rank and place with a queue.

Defined cases: a null text is empty and has no ids; null ids of rows stay null; repeated rows are encoded one by one;
an empty table gives no rows; other columns are not read.  Decoding gives the text back but for U+2581 itself, which
becomes a blank.
"""

from __future__ import annotations

import functools
import heapq
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import id_text

SIGN = "▁"
UNIT = re.compile(f"{SIGN}*[^{SIGN}]+|{SIGN}+")
#: Merges of blank runs have this rank; all others come before.
LAST = np.iinfo(np.int32).max - 2
#: Slots for answers on pairs of pieces: 8 MB.
KEPT_BITS = 20
#: Characters of new units that are encoded together.
BLOCK = 250_000


class Vocabulary:
    """Ids, merge ranks and split trees of a model file, read once for each Python worker."""

    def __init__(self, model_file: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = model.get_piece_size()
        self.pieces = [model.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.ids = {self.pieces[i]: i for i in plain}
        self.byte = {int(self.pieces[i][3:5], 16): i for i in range(n) if model.is_byte(i)}
        self.unknown = model.unk_id()
        by_score = sorted(plain, key=lambda i: -model.get_score(i))
        rank, place, before = np.full(n, LAST, dtype=np.int64), -1, None
        for i in by_score:
            if model.get_score(i) != before:
                place, before = place + 1, model.get_score(i)
            rank[i] = LAST - 1 if set(self.pieces[i]) == {SIGN} and len(self.pieces[i]) > 1 else place
        self.rank = rank
        self.left, self.right = np.arange(n), np.arange(n)
        self.valid = np.zeros(n, dtype=bool)
        self.kept = np.full(1 << KEPT_BITS, -1, dtype=np.int64)
        for piece, i in self.ids.items():
            made, last = self.merge(piece)
            self.valid[i] = made == [i]
            if self.valid[i] and last:
                self.left[i], self.right[i] = last
        pairs = [(self.ids[p[:k]], self.ids[p[k:]], i) for p, i in self.ids.items() for k in range(1, len(p)) if p[:k] in self.ids and p[k:] in self.ids]
        self._table(np.array(pairs, dtype=np.int64).reshape(-1, 3))
        letters = sorted({c for p in self.ids for c in p})
        self.letter = {c: k + 1 for k, c in enumerate(letters)}
        self.longest = max(map(len, self.ids))
        searched = [(p, i) for p, i in self.ids.items() if self.valid[i]]
        self.searched = np.array([i for _, i in searched])
        self.length = np.array([len(p) for p in self.pieces])
        wide = np.zeros((len(searched), self.longest), dtype=">u2")
        ends = np.full((len(searched), self.longest), 0xFFFF, dtype=">u2")
        for row, (p, _) in enumerate(searched):
            wide[row, : len(p)] = ends[row, : len(p)] = [self.letter[c] for c in p]
        self.low_keys, self.high_keys = (np.frombuffer(a.tobytes(), dtype=f"S{2 * self.longest}") for a in (wide, ends))
        self.inside = {p[k : k + 2] for p in self.ids for k in range(len(p) - 1)}

    def _table(self, pairs: np.ndarray) -> None:
        """An open hash table (first piece, second piece) -> merged piece."""
        self.bits = max(4, int(len(pairs) * 4).bit_length())
        self.keys, self.merged = np.full(1 << self.bits, -1, dtype=np.int64), np.full(1 << self.bits, -1, dtype=np.int64)
        todo, step = pairs, 0
        while len(todo):
            key = todo[:, 0] << 20 | todo[:, 1]
            at = self._slot(key, step)
            free = self.keys[at] < 0
            self.keys[at[free]] = key[free]
            stored = self.keys[at] == key
            self.merged[at[stored]] = todo[stored, 2]
            todo, step = todo[~stored], step + 1
        self.steps = step

    def _slot(self, key: np.ndarray, step: int) -> np.ndarray:
        mixed = key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return ((mixed >> np.uint64(64 - self.bits)).astype(np.int64) + step) & (len(self.keys) - 1)

    def merge_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The piece that a and b merge into, or -1."""
        key = a.astype(np.int64) << 20 | b
        out = np.full(len(key), -1, dtype=np.int64)
        todo = np.arange(len(key))
        for step in range(self.steps):
            at = self._slot(key[todo], step)
            seen = self.keys[at]
            hit = seen == key[todo]
            out[todo[hit]] = self.merged[at[hit]]
            todo = todo[~hit & (seen >= 0)]
            if not len(todo):
                break
        return out

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging by rank leaves the pieces a, b (each already merged) apart; answers are kept, one for each slot."""
        key = a << 20 | b
        slot = (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - KEPT_BITS)).astype(np.intp)
        kept = np.take(self.kept, slot)
        out = kept & 1 == 1
        new = np.flatnonzero(kept >> 1 != key)
        if len(new):
            out[new] = self.walked(a[new], b[new])
            self.kept[slot[new]] = key[new] << 1 | out[new]
        return out

    def walked(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """As ``compatible``, by the pieces' split trees.

        Walks down the two split trees along the boundary, the later-made piece first; a merge over the boundary that
        would have come earlier than the pieces around it joins them.
        """
        out = np.ones(len(a), dtype=bool)
        todo = np.arange(len(a))
        a, b = a.copy(), b.copy()
        limit = np.full(len(a), np.iinfo(np.int64).max)
        while len(todo):
            joined = self.merge_of(a, b)
            early = (joined >= 0) & (self.rank[joined] * 2 < limit)
            out[todo[early]] = False
            ra, rb = np.where(self.left[a] != a, self.rank[a], -1), np.where(self.left[b] != b, self.rank[b], -1)
            ends = (ra < 0) & (rb < 0)
            go = ~early & ~ends
            todo, a, b, ra, rb = todo[go], a[go], b[go], ra[go], rb[go]
            first = ra > rb
            # at one rank the left place merges first: a merge as late as b's own still comes before it
            limit = np.where(first, ra * 2, rb * 2 + 1)
            a, b = np.where(first, self.right[a], a), np.where(first, b, self.left[b])
        return out

    def merge(self, text: str) -> tuple[list[int], tuple[int, int] | None]:
        """Merging by rank, leftmost first, with a queue: ids and the last merge's parts."""
        symbols: list[int | None] = [self.ids.get(c, -1 - ord(c)) for c in text]
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        spelled = list(text)
        queue: list[tuple[int, int, str]] = []

        def offer(i: int) -> None:
            j = after[i]
            if i >= 0 and j < n and (whole := self.ids.get(spelled[i] + spelled[j])) is not None:
                heapq.heappush(queue, (int(self.rank[whole]), i, spelled[i] + spelled[j]))

        for i in range(n - 1):
            offer(i)
        last = None
        while queue:
            _, i, whole = heapq.heappop(queue)
            j = after[i] if symbols[i] is not None else n
            if j >= n or symbols[i] is None or spelled[i] + spelled[j] != whole:
                continue
            last = (symbols[i], symbols[j])
            symbols[i], spelled[i], symbols[j] = self.ids[whole], whole, None
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            if before[i] >= 0:
                offer(before[i])
            offer(i)
        return [s for s in symbols if s is not None], last

    def fallback(self, code: int) -> list[int]:
        out = [self.byte.get(b, self.unknown) for b in chr(code).encode("utf-8", "surrogatepass")]
        return out if self.byte else [self.unknown]


@functools.lru_cache(maxsize=2)
def vocabulary(model_file: str | None = None) -> Vocabulary:
    import public_tokenizers

    return Vocabulary(model_file or public_tokenizers.path("piece_bpe_32k.model"))


def suffix_array(codes: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of codes (not negative; 0 past the end) sorted by their first ``depth`` codes, by doubling ranks.

    The first ranks are of as many codes as fit a key, which are many where a text has few different ones.
    """
    n = len(codes)
    seen = np.unique(codes)
    bits = max(1, len(seen).bit_length())
    width = min(depth, 62 // bits)
    padded = np.concatenate([np.searchsorted(seen, codes) + (seen[:1] > 0), np.zeros(width, dtype=np.int64)])
    key = np.zeros(n, dtype=np.int64)
    for k in range(width):
        key = key << bits | padded[k : k + n]
    while width < depth:
        _, rank = np.unique(key, return_inverse=True)
        rank = rank.astype(np.int64) + 1
        key = rank << 31 | np.concatenate([rank[width:], np.zeros(min(width, n), dtype=np.int64)])[:n]
        width *= 2
    return np.argsort(key, kind="stable")


def encode_units(units: list[str], v: Vocabulary) -> list[bytes]:
    """The ids of each unit as little-endian int32 bytes: suffix array, ranges, edges by end, relaxation."""
    spread = [len(u) for u in units]
    text = "\0".join(units) + "\0"
    codes = np.array([v.letter.get(c, 0) for c in text] if len(text) < 64 else _letters(text, v), dtype=np.int64)
    order = suffix_array(codes, v.longest)
    wide = np.zeros(len(codes) + v.longest, dtype=">u2")
    wide[: len(codes)] = codes
    view = np.lib.stride_tricks.sliding_window_view(wide, v.longest)[: len(codes)]
    keys = np.frombuffer(np.ascontiguousarray(view[order]).tobytes(), dtype=f"S{2 * v.longest}")
    low, high = np.searchsorted(keys, v.low_keys), np.searchsorted(keys, v.high_keys)
    times = high - low
    piece = np.repeat(v.searched, times)
    start = order[np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(low, times)]
    end = start + v.length[piece]
    # by end, the longest first
    by = np.argsort(end * 64 - v.length[piece])
    piece, start, end = piece[by], start[by], end[by]
    edge = np.searchsorted(end, np.arange(len(codes) + 1), side="left")
    size = np.array(spread, dtype=np.int64)
    first = np.concatenate([[0], np.cumsum(size + 1)[:-1]]).astype(np.int64)
    #: The piece that ends before each place; -1 unknown character, -2 not reached, -3 a unit's begin.
    last = np.full(len(codes) + 1, -2, dtype=np.int64)
    back = np.zeros(len(codes) + 1, dtype=np.int64)
    last[first] = -3
    alive = np.argsort(-size, kind="stable")
    begin, size = first[alive], size[alive]
    level = 0
    while len(begin):
        level += 1
        begin = begin[: np.searchsorted(-size, -level, side="right")]
        size = size[: len(begin)]
        at = begin + level
        todo = at[codes[at - 1] > 0]
        none = at[codes[at - 1] == 0]
        last[none], back[none] = -1, none - 1
        e = edge[todo]
        while len(todo):
            before = last[start[e]]
            good = before < 0
            some = np.flatnonzero(~good)
            good[some] = v.compatible(before[some], piece[e[some]])
            good &= before != -2
            last[todo[good]], back[todo[good]] = piece[e[good]], start[e[good]]
            todo, e = todo[~good], e[~good] + 1
    # back along all paths together: a place is on its unit's path or not
    on = np.zeros(len(last), dtype=bool)
    at, unit_begin = first + np.array(spread, dtype=np.int64), first
    while len(at):
        on[at] = True
        at = back[at]
        going = at > unit_begin
        at, unit_begin = at[going], unit_begin[going]
    places = np.flatnonzero(on)
    ids = last[places]
    unit = np.searchsorted(first, places, side="left") - 1
    unknown = np.flatnonzero(ids < 0)
    if len(unknown):
        spelled = [v.fallback(ord(text[p - 1])) for p in places[unknown].tolist()]
        times = np.ones(len(ids), dtype=np.int64)
        times[unknown] = [len(x) for x in spelled]
        ids, unit = np.repeat(ids, times), np.repeat(unit, times)
        ids[ids < 0] = [i for x in spelled for i in x]
    data = ids.astype("<i4").tobytes()
    cuts = (4 * np.searchsorted(unit, np.arange(len(units) + 1))).tolist()
    return [data[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


def _letters(text: str, v: Vocabulary) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    seen, inverse = np.unique(points, return_inverse=True)
    return np.array([v.letter.get(chr(c), 0) if c else 0 for c in seen], dtype=np.int64)[inverse]


class Encoder:
    """Texts to ids; units are looked up first, and what is new is encoded together."""

    def __init__(self, model_file: str | None = None, most: int = 150_000):
        self.v, self.seen, self.old, self.most = vocabulary(model_file), {}, {}, most

    def _split(self, unit: str) -> list[str]:
        """A long unit in parts between characters that no piece holds side by side."""
        cuts = [0, *(k for k in range(1, len(unit)) if unit[k - 1 : k + 1] not in self.v.inside), len(unit)]
        return [unit[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def learn(self, units: set[str]) -> None:
        odd = {u for u in units if len(u) > 48 or u[1:2] == SIGN}
        plain, split = list(units - odd), {}
        for u in odd:
            if u.startswith(SIGN * 2):
                made, ids = self.v.merge(u)[0], []
                for i in made:
                    ids.extend([i] if i >= 0 else self.v.fallback(-1 - i))
                self.seen[u] = np.array(ids, dtype="<i4").tobytes()
            elif len(u) > 48:
                split[u] = self._split(u)
            else:
                plain.append(u)
        plain += sorted({p for parts in split.values() for p in parts} - self.seen.keys() - set(plain))
        # one block of text at a time bounds the arrays
        block = np.cumsum(np.fromiter(map(len, plain), dtype=np.int64, count=len(plain)) + 1) // BLOCK
        edges = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(plain)]
        for start, stop in zip(edges, edges[1:], strict=False):
            if stop > start:
                self.seen.update(zip(plain[start:stop], encode_units(plain[start:stop], self.v), strict=True))
        for u, parts in split.items():
            self.seen[u] = b"".join(self.seen[p] for p in parts)

    def __call__(self, texts: list[str]) -> list[bytes]:
        out = []
        for low in range(0, len(texts), 256):
            units = [UNIT.findall(SIGN + t.replace(" ", SIGN)) if t else [] for t in texts[low : low + 256]]
            if len(self.seen) > self.most:  # two generations: what is still asked for moves to the new one
                self.seen, self.old = {}, self.seen
            new = set().union(*units) - self.seen.keys()
            for u in new & self.old.keys():
                self.seen[u] = self.old[u]
            new -= self.old.keys()
            if new:
                self.learn(new)
            out += [b"".join(map(self.seen.__getitem__, u)) for u in units]
        return out


class Decoder:
    """Ids to texts; knows the pieces' spelling only."""

    def __init__(self, model_file: str | None = None):
        self.spelled = spelling(model_file)

    def __call__(self, ids: bytes) -> str:
        text = b"".join(map(self.spelled.__getitem__, np.frombuffer(ids, dtype="<i4").tolist())).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


@functools.lru_cache(maxsize=2)
def spelling(model_file: str | None = None) -> list[bytes]:
    """What each id stands for; control signs stand for nothing."""
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file or public_tokenizers.path("piece_bpe_32k.model"))
    one = lambda i: bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i) else b"" if model.is_control(i) else model.id_to_piece(i).replace(SIGN, " ").encode("utf-8")
    return [one(i) for i in range(model.get_piece_size())]


def encode(docs: DataFrame, *, id_col="doc_id", text_col="text", model_file=None) -> DataFrame:
    """_id, _text and ids (little-endian 32-bit) of each document."""
    schema = pa.schema([("_id", pa.int64()), ("_text", pa.string()), ("ids", pa.binary())])

    def run(batches):
        encoder = Encoder(model_file)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(pa.string()), pa.array(encoder(batch.column(1).to_pylist()), pa.binary())], schema=schema)

    return id_text(docs, id_col, text_col).mapInArrow(run, "_id long, _text string, ids binary")


def decode(encoded: DataFrame, *, ids_col="ids", model_file=None) -> DataFrame:
    """The rows of ``encode`` with ``decoded``, the text that the ids stand for."""
    keep = [c for c in encoded.columns if c != "decoded"]

    def run(batches):
        decoder = Decoder(model_file)
        for batch in batches:
            batch = batch.select(keep)
            made = pa.array([None if x is None else decoder(x) for x in batch.column(ids_col).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, made], names=[*keep, "decoded"])

    from pyspark.sql.types import StringType, StructField, StructType

    fields = [f for f in encoded.schema.fields if f.name != "decoded"]
    return encoded.select(*keep).mapInArrow(run, StructType([*fields, StructField("decoded", StringType())]))
