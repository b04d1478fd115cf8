"""Packing by powers of two: every document becomes pieces of binary length, each piece a sequence of its own.

A document of n tokens gives floor(n / max_len) pieces of max_len and one for each bit of the rest, longest first.
Pieces of one length form a bucket; a batch drawn from a bucket needs no padding, and no sequence crosses documents.
One narrow pass: nothing is shuffled, and the longest state is one document's tokens.

Defined cases: a null text is empty and still has its end token; null ids stay null; repeated rows are packed one by
one; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import base64
import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, tidy

#: Texts that hold this string go to the tokenizer that knows it as one id.
SPECIAL = "<|endoftext|>"


def _place(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.lru_cache(maxsize=2)
def encoder(json_file: str | None = None, ranks_file: str | None = None):
    """text -> list of ids.  The rank file holds the same vocabulary and is several times as fast; the other is read
    where a text needs it."""
    import public_tokenizers
    import tiktoken

    @functools.cache
    def exact():
        from tokenizers import Tokenizer

        return Tokenizer.from_file(json_file or _place("byte_bpe_50k.json"))

    with open(ranks_file or _place("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> list[int]:
        return exact().encode(text, add_special_tokens=False).ids if SPECIAL in text else fast.encode_ordinary(text)

    return encode


def binary_lengths(n: int, max_len: int) -> list[int]:
    """max_len as often as it fits, then the set bits of the rest, largest first."""
    rest = n % max_len
    return [max_len] * (n // max_len) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def pack(docs: DataFrame, *, id_col="doc_id", text_col="text", max_len=1024, end_id=0, json_file=None, ranks_file=None) -> DataFrame:
    """One row per piece: id, start, length (also its bucket), ids, doc_tokens, sequence_id and offset (always 0).

    sequence_id is unique over the result and increases within a task; a task that runs again gives the same.
    """
    if max_len < 1 or max_len & (max_len - 1):
        raise ValueError("max_len must be a power of two")
    schema = pa.schema([("_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64())])

    def run(batches):
        encode = encoder(json_file, ranks_file)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            rows: list[tuple] = []
            held = 0
            for i, text in zip(ids, texts, strict=True):
                tokens = encode(text)
                tokens.append(end_id)
                data = np.array(tokens, dtype="<u4").tobytes()
                start = 0
                for length in binary_lengths(len(tokens), max_len):
                    rows.append((i, start, length, data[4 * start : 4 * (start + length)], len(tokens)))
                    start += length
                held += len(data)
                if held > 1 << 24:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    pieces = id_text(docs, id_col, text_col).mapInArrow(tidy(run), "_id long, start long, length long, ids binary, doc_tokens long")
    return pieces.select("*", F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
