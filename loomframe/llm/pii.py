"""Personal data: generators propose overlapping spans, boosted trees choose among them; DataFrame functions only.

Exact kinds (email, ip, card, phone) follow fixed grammars and always stay.  For what has no grammar of its own
(secrets, national phone forms, social security numbers, bank accounts) high-recall patterns propose spans, format and
context features of each go through boosted trees, and a threshold calibrated for each kind selects redactions.  The
trees are trained on the driver on ``n_train`` generated examples (features come from the same SQL expressions) and
become one CASE expression for each tree.  Everything is one narrow pass over the documents inside the JVM.

Positions: a text is cut at a pattern's matches, and running sums of the pieces' lengths give each match's place in
code points.  Repetition of groups is avoided (the JVM's matcher recurses for it): single separators between digits,
or dots inside a domain, are first exchanged for a control character of the same length, and runs are then matched by
one character class.

Defined cases: a null text is empty (no spans); null ids stay null; repeated rows are searched one by one; an empty
table gives no rows; columns other than the id and the text are not read, and ``redact`` passes them through.
"""

from __future__ import annotations

import json
import random

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import boosting
from .common import id_text

KINDS = ["email", "ip", "card", "phone", "account", "secret", "ssn", "tel"]
BASE = KINDS[:4]

_LOCAL = r"A-Za-z0-9._%+\x01-"
EMAIL = rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++\x01[A-Za-z0-9\x01-]++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9\x01])[0-9][0-9\x01]{11,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: High-recall generators; what they propose overlaps (a value after a sign of assignment is a long token as well, a row of
#: digits a telephone or security number), and the trees decide on each proposal.
PROPOSALS = {
    "value": r"(?<=[=:][\x20\"']{0,3})(?<![A-Za-z0-9_/+=-])[A-Za-z0-9_/+=-]{8,}+",
    "digits": r"(?<![A-Za-z0-9.+(-])[(]?[0-9][0-9()\x20.-]{7,17}[0-9](?![A-Za-z0-9.-])",
    "account": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}+(?![A-Za-z0-9])",
    "secret": r"(?<![A-Za-z0-9_/+=-])[A-Za-z0-9_/+=-]{16,}+",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "tel": r"(?<![0-9+.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9.-])",
}
#: The kinds that proposals of these generators are given.
NAMED = {"value": "secret", "digits": "tel"}
_CALL = r"\b(?:phone|call|tel|fax|mobile|cell)\b"
_KEY = "token|key|secret|passw|auth|credential"
HINTS = {"value": _KEY, "digits": _CALL, "secret": _KEY, "tel": _CALL, "account": r"\b(?:iban|account|bank)\b", "ssn": r"\b(?:ssn|social|security)\b"}
FEATURES = ["chars", "digits", "upper", "lower", "distinct", "switches", "hint", "assigned", "kind"]
WINDOW = 24


#: Matches that are placed together; the stretches' own places follow from their sums, so long texts cost no square.
STRETCH = 64


def _spans(text: Column, pattern: str, kind: str) -> Column:
    """array<struct<start, end, kind, piece>> of a pattern's matches, leftmost and non-overlapping."""
    pieces = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    zipped = F.zip_with(pieces, F.slice(gaps, F.lit(1), F.size(pieces)), lambda m, g: F.struct(m.alias("m"), F.length(g).cast("long").alias("g"), F.length(m).cast("long").alias("n")))
    zero, none = F.lit(0).cast("long"), F.array()
    start = lambda acc, x: acc["at"] + x["g"]

    def placed(stretch: Column) -> Column:
        """(length, spans from its begin) of some matches and the text before each."""
        return F.aggregate(
            stretch,
            F.struct(zero.alias("at"), _none().alias("out")),
            lambda acc, x: F.struct(
                (start(acc, x) + x["n"]).alias("at"),
                F.concat(acc["out"], F.array(F.struct(start(acc, x).alias("start"), (start(acc, x) + x["n"]).alias("end"), F.lit(kind).alias("kind"), x["m"].alias("piece")))).alias("out"),
            ),
        )

    def whole(z: Column) -> Column:
        stretches = F.transform(F.sequence(F.lit(0), F.floor((F.size(z) - 1) / STRETCH).cast("int")), lambda k: placed(F.slice(z, k * STRETCH + 1, F.lit(STRETCH))))
        return F.aggregate(
            stretches,
            F.struct(zero.alias("at"), none.cast("array<array<struct<start:bigint,end:bigint,kind:string,piece:string>>>").alias("out")),
            lambda acc, x: F.struct((acc["at"] + x["at"]).alias("at"), F.concat(acc["out"], F.array(F.transform(x["out"], lambda s: F.struct((s["start"] + acc["at"]).alias("start"), (s["end"] + acc["at"]).alias("end"), s["kind"].alias("kind"), s["piece"].alias("piece"))))).alias("out")),
            lambda acc: F.flatten(acc["out"]),
        )

    # in an array of one, so that the matches are computed once and then referred to
    return F.transform(F.array(zipped), lambda z: F.when(F.size(z) > 0, whole(z)).otherwise(_none()))[0]


def _none() -> Column:
    return F.array().cast("array<struct<start:bigint,end:bigint,kind:string,piece:string>>")


def _luhn(digits: Column) -> Column:
    """Whether a string of digits passes: every second one from the right doubles, less 9 if over 9."""
    figures = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(F.pmod(d.cast("int") * 2, F.lit(10)) + F.floor(d.cast("int") * 2 / 10).cast("int")))
    return F.aggregate(figures, F.lit(0), lambda a, x: a + x) % 10 == 0


def base_spans(text: Column) -> Column:
    """All spans of the exact kinds, unsorted."""
    plain = F.translate(text, "\x01", "\x02")
    digits = lambda x: F.regexp_replace(x["piece"], "[^0-9]", "")
    email = _spans(F.regexp_replace(plain, r"(?<=[A-Za-z0-9-])\.(?=[A-Za-z0-9-])", "\x01"), EMAIL, "email")
    part = lambda p: F.ltrim(p, F.lit("0"))
    ip = F.filter(_spans(text, IP, "ip"), lambda x: F.forall(F.split(x["piece"], r"\."), lambda p: (F.length(part(p)) < 3) | ((F.length(part(p)) == 3) & (part(p) <= "255"))))
    card = F.filter(_spans(F.regexp_replace(plain, r"(?<=[0-9])[\x20-](?=[0-9])", "\x01"), CARD, "card"), lambda x: F.when(F.length(digits(x)).between(12, 19), _luhn(digits(x))).otherwise(False))
    phone = F.filter(_spans(text, PHONE, "phone"), lambda x: F.length(digits(x)).between(9, 15))
    return F.concat(
        F.when(F.contains(text, F.lit("@")), email).otherwise(_none()),
        F.when(F.col("_digits") & text.rlike(r"[0-9]\.[0-9]"), ip).otherwise(_none()),
        F.when(F.col("_digits") & text.rlike(r"[0-9](?:[0-9\x20-]){10,}[0-9]"), card).otherwise(_none()),
        F.when(F.contains(text, F.lit("+")), phone).otherwise(_none()),
    )


def proposals(text: Column) -> Column:
    return F.concat(*(F.when(F.col("_digits") & text.rlike(p), _spans(text, p, k)).otherwise(_none()) for k, p in PROPOSALS.items()))


def features(text: Column, span: Column) -> list[Column]:
    """Format of the piece, and what stands in the WINDOW code points before it."""
    piece = span["piece"]
    before = F.lower(F.substring(text, F.greatest(span["start"] - WINDOW, F.lit(0)).cast("int") + 1, F.least(span["start"], F.lit(WINDOW)).cast("int")))
    without = lambda pattern: (F.length(piece) - F.length(F.regexp_replace(piece, pattern, ""))).cast("double")
    hint = F.lit(0.0)
    for kind, words in HINTS.items():
        hint = F.when((span["kind"] == kind) & before.rlike(words), 1.0).otherwise(hint)
    index = F.lit(-1.0)
    for i, kind in enumerate(PROPOSALS):
        index = F.when(span["kind"] == kind, float(i)).otherwise(index)
    return [
        F.length(piece).cast("double"),
        without("[0-9]"),
        without("[A-Z]"),
        without("[a-z]"),
        F.size(F.array_distinct(F.split(piece, ""))).cast("double"),
        F.size(F.regexp_extract_all(piece, F.lit("[0-9][A-Za-z]|[A-Za-z][0-9]"), F.lit(0))).cast("double"),
        hint,
        before.rlike("[=:]\\s*[\"']?$").cast("double"),
        index,
    ]


def examples(n: int, seed: int = 11) -> list[tuple[str, int, int, str, int]]:
    """Generated (text, start, end, kind, label): personal or secret forms, and look-alikes."""
    rng = random.Random(seed)
    pick = lambda chars, k: "".join(rng.choice(chars) for _ in range(k))
    low, up, dig = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    word = lambda: pick(low, rng.randint(2, 9))
    out = []
    for i in range(n):
        kind, yes = list(PROPOSALS)[i % len(PROPOSALS)], rng.random() < 0.5
        lead = f"{word()} {word()} "
        if kind == "value":
            if yes:
                piece = pick(low + dig + up, rng.randint(10, 40)) if rng.random() < 0.5 else pick("0123456789abcdef", rng.choice([16, 32, 40]))
                piece = piece[:3] + "7q" + piece[5:]
                lead += rng.choice(["token", "api key", "secret", "password", "auth"]) + rng.choice([" = \"", ": ", "=", " = "])
            else:
                piece = rng.choice([lambda: pick(low, rng.randint(8, 14)), lambda: pick(dig, rng.randint(8, 12)), lambda: word() + "-" + word() + "-" + word() + "-x", lambda: pick(low, 9).upper(), lambda: pick(low + dig + up, rng.randint(10, 20))])()
                lead += rng.choice(["note", "see", "size", "width", "title"]) + rng.choice([": ", " = ", "="])
        elif kind == "digits":
            form = rng.choice(["ddd ddd dddd", "dd dd dd dd dd", "dddd dddd", "(dd) dddd dddd", "ddddd dddddd", "ddd-dddd-dddd"]) if yes or rng.random() < 0.5 else rng.choice(["dddd-dd-dd", "dddd.dd.dd", "d ddd ddd ddd", "dddddddddddddddd", "dddd dddd dddd dddd"])
            piece = "".join(rng.choice(dig) if c == "d" else c for c in form)
            lead += rng.choice(["phone: ", "call ", "tel. ", "mobile ", "fax "]) if yes else rng.choice(["order ", "", "sum of ", "part no. ", "on "])
        elif kind == "secret":
            if yes:
                piece = rng.choice([lambda: pick("0123456789abcdef", rng.choice([32, 40, 64])), lambda: pick("0123456789ABCDEF", rng.choice([32, 40])), lambda: pick(low + up + dig, rng.randint(20, 48)), lambda: "sk-" + pick(low + dig + up, 32)])()
                lead += rng.choice(["token = \"", "key: ", "api_key=", "secret: \"", "password=", "", ""])
            else:
                piece = rng.choice([lambda: pick(low, rng.randint(16, 40)), lambda: "-".join(word() for _ in range(4)) + "-and-more", lambda: "/".join(word() for _ in range(5)) + "/index", lambda: pick(dig, rng.randint(16, 22)), lambda: "=" * rng.randint(16, 60), lambda: word() + "_" + word() + "_" + word() + "_2024_" + word()])()
        elif kind == "tel":
            piece = f"({pick(dig, 3)}) {pick(dig, 3)}-{pick(dig, 4)}" if rng.random() < 0.5 else rng.choice(" .-").join((pick(dig, 3), pick(dig, 3), pick(dig, 4)))
            lead += rng.choice(["phone: ", "call ", "tel. ", "mobile "]) if yes else rng.choice(["order ", "", "sum of ", "part no. ", "table "])
        elif kind == "ssn":
            piece = f"{pick(dig, 3)}-{pick(dig, 2)}-{pick(dig, 4)}"
            lead += rng.choice(["ssn ", "SSN: ", "social security number "]) if yes else rng.choice(["invoice ", "", "isbn ", "model "])
        else:
            piece = pick(up, 2) + pick(dig, 2) + (pick(dig, rng.randint(12, 20)) if yes else pick(up + dig, rng.randint(11, 18)))
            lead += rng.choice(["iban ", "IBAN: ", "account ", ""]) if yes else rng.choice(["sku ", "", "flight "])
        out.append((f"{lead}{piece} {word()}", len(lead), len(lead) + len(piece), kind, int(yes)))
    return out


class Chooser:
    """Boosted trees as SQL, and the log-odds above which each kind is redacted."""

    def __init__(self, forest: boosting.Forest, cuts: dict[str, float]):
        self.forest, self.cuts = forest, cuts

    @staticmethod
    def fit(spark: SparkSession, n_train: int = 2400, precision: float = 0.97) -> Chooser:
        rows = json.dumps([dict(zip(("t", "start", "end", "kind", "y"), r, strict=True)) for r in examples(n_train)])
        made = spark.range(1).select(F.explode(F.from_json(F.lit(rows), "array<struct<t:string,start:bigint,`end`:bigint,kind:string,y:int>>")).alias("r")).select("r.*")
        span = F.struct("start", "end", "kind", F.expr("substring(t, int(start) + 1, int(end - start))").alias("piece"))
        data = made.select("kind", "y", F.array(*features(F.col("t"), span)).alias("x")).collect()
        x, y, kind = np.array([r["x"] for r in data]), np.array([r["y"] for r in data], dtype=float), np.array([r["kind"] for r in data])
        held = np.arange(len(y)) // len(PROPOSALS) % 4 == 3
        forest = boosting.fit(x[~held], y[~held], n_trees=32, depth=3, rate=0.3, names=FEATURES)
        raw, cuts = forest.raw(x), {}
        for k in PROPOSALS:  # the lowest threshold that is precise enough on what was held out
            own = held & (kind == k)
            order = np.argsort(-raw[own], kind="stable")
            right = np.cumsum(y[own][order]) / np.arange(1, own.sum() + 1)
            good = np.flatnonzero(right >= precision)
            cuts[k] = max(0.0, float(raw[own][order][good[-1]])) if len(good) else float("inf")
        return Chooser(forest, cuts)

    def keeps(self, text: Column, span: Column) -> Column:
        # features go into an array once; the trees then index it
        names = F.transform(F.array(F.array(*features(text, span))), self._odds)[0]
        least = F.lit(float("inf"))
        for k, v in self.cuts.items():
            least = F.when(span["kind"] == k, F.lit(v)).otherwise(least)
        return names >= least

    def _odds(self, x: Column) -> Column:
        def node(at: int) -> Column:
            f = self.forest
            if f.left[at] == at:
                return F.lit(float(f.value[at]))
            return F.when(x[int(f.feature[at])] <= float(f.threshold[at]), node(f.left[at])).otherwise(node(f.right[at]))

        total = F.lit(float(self.forest.base))
        for root in self.forest.roots:
            total = total + node(root)
        return total


def _ranked(spans: Column) -> Column:
    """Sorted by start, then kind as listed."""
    rank = F.map_from_arrays(F.array(*map(F.lit, KINDS)), F.array(*(F.lit(i) for i in range(len(KINDS)))))
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), rank[s["kind"]].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))
    return F.array_sort(keyed)


def find(docs: DataFrame, chooser: Chooser | None = None, *, id_col="doc_id", text_col="text") -> DataFrame:
    """_id, base and spans: sorted arrays of struct<start, rank, end, kind>; spans are base and what the trees chose."""
    return _found(id_text(docs, id_col, text_col), chooser or Chooser.fit(docs.sparkSession)).select("_id", "base", "spans")


def _found(rows: DataFrame, chooser: Chooser) -> DataFrame:
    text = F.col("_text")
    rows = rows.withColumn("_digits", text.rlike("[0-9]"))
    rows = rows.withColumn("_base", base_spans(text)).withColumn("_more", proposals(text))
    rows = rows.withColumn("_more", F.when(F.size("_more") > 0, F.filter("_more", lambda s: chooser.keeps(text, s))).otherwise(F.col("_more")))
    return rows.withColumn("base", _ranked(F.col("_base"))).withColumn("spans", _ranked(F.concat("_base", F.array_distinct(F.transform("_more", _named)))))


def _named(span: Column) -> Column:
    kind = span["kind"]
    for generator, name in NAMED.items():
        kind = F.when(span["kind"] == generator, name).otherwise(kind)
    return F.struct(span["start"].alias("start"), span["end"].alias("end"), kind.alias("kind"), span["piece"].alias("piece"))


def redact(docs: DataFrame, chooser: Chooser | None = None, *, text_col="text", marks="<{}>") -> DataFrame:
    """The documents with every span replaced by its kind's mark; overlapping spans become one, named by the first.

    Columns and their order stay; a null text stays null.
    """
    chooser = chooser or Chooser.fit(docs.sparkSession)
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("_text"))
    text = F.col("_text")
    cut = lambda a, b: F.substring(text, a.cast("int") + 1, (b - a).cast("int"))
    zero, none = F.lit(0).cast("long"), F.array().cast("array<string>")
    clean = F.aggregate(
        "spans",
        F.struct(zero.alias("at"), none.alias("out")),
        lambda acc, s: F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(s["start"] < acc["at"], acc["out"]).otherwise(F.concat(acc["out"], F.array(cut(acc["at"], s["start"]), F.concat(F.lit(marks.split("{}")[0]), F.upper(s["kind"]), F.lit(marks.split("{}")[1]))))).alias("out"),
        ),
        lambda acc: F.array_join(F.concat(acc["out"], F.array(cut(acc["at"], F.length(text).cast("long")))), ""),
    )
    done = _found(whole, chooser).withColumn("_clean", F.when(F.size("spans") > 0, clean).otherwise(text))
    return done.select(*(F.when(F.col("_row")[c].isNotNull(), F.col("_clean")).alias(c) if c == text_col else F.col("_row")[c].alias(c) for c in docs.columns))


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
