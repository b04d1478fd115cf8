"""Quality rules: document statistics, and gradient-boosted trees over them with monotonic constraints.

Statistics are taken of every whole text in one pass over Arrow batches; nothing is shuffled.  The trees are trained
on at most ``max_train_rows`` labelled documents (those with the smallest hashed id), flattened into numpy node arrays
of a few kB and carried to the executors in the function's closure.

Defined cases: a null text is empty (all statistics 0, base_failed); null ids stay null; repeated rows are judged one
by one; an empty table gives no rows; columns other than the id and the text are not read.  A null label, or one
whose document is missing, is ignored; without labels of both classes the trees accept everything the base rules do.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import boosting
from .common import id_text, tidy

SYMBOLS = "#*$%&|<>"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Feature, and the sign of its effect on quality (0: free).
FEATURES = {"log_words": 0, "mean_word": 0, "symbol_share": -1, "dup_line_share": -1, "repeat_share": -1, "upper_share": 0, "digit_share": 0, "exclaim_rate": -1, "pipe_rate": -1, "distinct_share": 0, "line_words": 0, "end_share": 0}
SPACES = " \t\n\x0b\x0c\r"


def counts(text: str) -> tuple[int, int, int, int, int, list[bytes]]:
    """The five base statistics of a text, and its words."""
    words = text.encode("utf-8", "surrogatepass").split()
    n = len(words)
    lines = [x for x in text.split("\n") if x.strip(SPACES)] if "\n" in text else []
    repeat = 0
    if n >= 4:
        place: dict[bytes, int] = {}
        codes = np.fromiter((place.setdefault(w, len(place)) for w in words), dtype=np.int64, count=n)
        if len(place) < n:
            _, inverse, times = np.unique((codes[:-2] * len(place) + codes[1:-1]) * len(place) + codes[2:] if len(place) < 2_000_000 else _wide(codes), return_inverse=True, return_counts=True)
            starts = np.flatnonzero(times[inverse] > 1)
            if len(starts):
                step = np.zeros(n + 1, dtype=np.int64)
                np.add.at(step, starts, 1)
                np.add.at(step, starts + 3, -1)
                repeat = int((np.cumsum(step[:-1]) > 0).sum())
    return n, len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeat, words


def _wide(codes: np.ndarray) -> np.ndarray:
    """Windows of three as single codes where the product would not fit 64 bits."""
    _, pairs = np.unique(codes[:-1] * (codes.max() + 1) + codes[1:], return_inverse=True)
    return pairs[:-1] * (codes.max() + 1) + codes[2:]


def features(text: str, base: tuple) -> list[float]:
    n, chars, symbols, dup, repeat, words = base
    lines = text.count("\n") + 1
    size = max(1, chars)
    upper = len(text.encode("utf-8", "surrogatepass").translate(None, _NOT_UPPER)) + sum(map(str.isupper, "".join(_NOT_ASCII.findall(text))))
    digits = len(text.encode("utf-8", "surrogatepass").translate(None, _NOT_DIGIT))
    ends = sum(1 for w in words if w[-1] in b".,;:?!")
    return [np.log1p(n), chars / max(1, n), symbols / size, dup / lines, repeat / max(1, n), upper / size, digits / size, text.count("!") / max(1, n), text.count("|") / max(1, n), len(set(words)) / max(1, n), n / lines, ends / max(1, n)]


_NOT_ASCII = re.compile(r"[^\x00-\x7f]+")
_NOT_UPPER = bytes(b for b in range(256) if not 65 <= b <= 90)
_NOT_DIGIT = bytes(b for b in range(256) if not 48 <= b <= 57)


def base_failed(n: np.ndarray, repeat: np.ndarray) -> np.ndarray:
    return (n < 50) | (100 * repeat > 50 * n)


def measured(texts: pa.Array, with_features: bool) -> tuple[np.ndarray, np.ndarray]:
    """Base statistics and features, a row for each text; only one text's words are held at a time."""
    base = np.zeros((len(texts), len(COUNTS)), dtype=np.int64)
    x = np.zeros((len(texts), len(FEATURES)))
    for k, text in enumerate(texts):
        text = text.as_py()
        own = counts(text)
        base[k] = own[:5]
        if with_features:
            x[k] = features(text, own)
    return base, x


@dataclass
class QualityRules:
    """The trees and the threshold under which a document is rejected."""

    forest: boosting.Forest
    threshold: float = 0.0

    @staticmethod
    def fit(docs: DataFrame, labels: DataFrame, *, id_col="doc_id", text_col="text", label_col="quality", max_train_rows=6000, max_clean_loss=0.002, n_trees=60, depth=3) -> QualityRules:
        """Trains on at most ``max_train_rows`` labelled documents, three quarters for the trees and one to calibrate.

        The threshold is the largest (0.5 at most) that rejects no more than ``max_clean_loss`` of the good documents
        held out.
        """
        chosen = labels.select(F.col(f"`{id_col}`").cast("long").alias("_id"), F.col(f"`{label_col}`").cast("int").alias("_y")).where("_id IS NOT NULL AND _y IN (0, 1)").groupBy("_id").agg(F.max("_y").alias("_y"))
        chosen = chosen.orderBy(F.xxhash64("_id"), "_id").limit(max_train_rows)
        stats = statistics(docs.join(F.broadcast(chosen), F.col(f"`{id_col}`").cast("long") == chosen["_id"], "left_semi"), id_col=id_col, text_col=text_col, with_features=True)
        sample = stats.join(F.broadcast(chosen), stats["_id"] == chosen["_id"]).select(stats["_id"], "_y", "features", "n_words", "n_repeat_words").dropDuplicates(["_id"]).limit(max_train_rows).toArrow()
        failed = base_failed(sample["n_words"].to_numpy(), sample["n_repeat_words"].to_numpy()).astype(bool)
        ids, y = np.array(sample["_id"].to_pylist(), dtype=np.int64)[~failed], np.array(sample["_y"].to_pylist(), dtype=float)[~failed]
        if not len(y) or y.min() == y.max():
            return QualityRules(boosting.constant(4.0), 0.0)
        x = np.array(sample["features"].to_pylist(), dtype=float)[~failed]
        order = np.argsort(ids * 2654435761 % 2**32, kind="stable")
        held = order[: len(order) // 4]
        rest = order[len(order) // 4 :]
        forest = boosting.fit(x[rest], y[rest], n_trees=n_trees, depth=depth, monotone=list(FEATURES.values()), names=list(FEATURES))
        good = np.sort(forest.probability(x[held][y[held] == 1]))
        threshold = 0.5 if not len(good) else min(0.5, float(good[min(len(good) - 1, int(max_clean_loss * len(good)))]))
        return QualityRules(forest, threshold)


def statistics(docs: DataFrame, rules: QualityRules | None = None, *, id_col="doc_id", text_col="text", with_features=False, keep_text=False) -> DataFrame:
    """For each document ``_id``, the five counts, base_failed, and with rules the probability of good quality and kept."""
    schema = "_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean" + ", features array<double>" * with_features + ", quality double, kept boolean" * bool(rules)
    out_schema = pa.schema([("_id", pa.int64()), *((c, pa.int64()) for c in COUNTS), ("base_failed", pa.bool_()), *([("features", pa.list_(pa.float64()))] * with_features), *([("quality", pa.float64()), ("kept", pa.bool_())] * bool(rules))])

    def run(batches):
        for batch in batches:
            base, x = measured(batch.column(1), with_features or bool(rules))
            failed = base_failed(base[:, 0], base[:, 4])
            columns = [batch.column(0), *(pa.array(base[:, i]) for i in range(5)), pa.array(failed)]
            if with_features:
                columns.append(pa.array(list(x), pa.list_(pa.float64())))
            if rules:
                p = rules.forest.probability(x)
                columns += [pa.array(p), pa.array(~failed & (p >= rules.threshold))]
            yield pa.RecordBatch.from_arrays(columns, schema=out_schema)

    return id_text(docs, id_col, text_col).mapInArrow(tidy(run), schema)


def filter_documents(docs: DataFrame, rules: QualityRules, *, text_col="text") -> DataFrame:
    """The documents that the rules keep, all columns as they were.

    A UDF that returns only the verdict keeps it one narrow pass: no join brings the verdicts back.
    """

    @F.arrow_udf("boolean")
    def verdict(texts: pa.Array) -> pa.Array:
        base, x = measured(texts, True)
        return pa.array(~base_failed(base[:, 0], base[:, 4]) & (rules.forest.probability(x) >= rules.threshold))

    return docs.where(verdict(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))))
