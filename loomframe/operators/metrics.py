"""Metrics of predictions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import reduce

#: The fixed part of an AUC's thresholds.
STEPS = [i / 50 for i in range(51)]
#: Of a confusion matrix, which has the square of it as rows.
MOST_LEVELS = 10_000


def confusion_matrix(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """(actual, predicted, n) over the union of both domains with NA; absent pairs have n = 0."""
    pair = df.select(F.coalesce(F.col(actual).cast("string"), F.lit("NA")).alias("actual"), F.coalesce(F.col(predicted).cast("string"), F.lit("NA")).alias("predicted"))
    counts = pair.groupBy("actual", "predicted").agg(F.count("*").alias("n"))
    named = counts.select(F.explode(F.array("actual", "predicted")).alias("x")).distinct()
    levels = sorted(r.x for r in named.limit(MOST_LEVELS + 1).collect())
    if len(levels) > MOST_LEVELS:
        raise ValueError(f"more than {MOST_LEVELS} levels")
    grid = df.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, levels))).alias("actual")).select("actual", F.explode(F.array(*map(F.lit, levels))).alias("predicted"))
    return grid.join(counts, ["actual", "predicted"], "left").select("actual", "predicted", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def class_measures(matrix: DataFrame) -> DataFrame:
    """Of a ``confusion_matrix`` of any number of classes: each one's rows, error, recall, precision and F1."""
    n, right = F.col("n"), F.col("actual") == F.col("predicted")
    rows = matrix.groupBy(F.col("actual").alias("class")).agg(F.sum(n).alias("rows"), F.sum(F.when(right, n).otherwise(0)).alias("hits"))
    said = matrix.groupBy(F.col("predicted").alias("class")).agg(F.sum(n).alias("said"))
    share = lambda a, b: F.when(b > 0, a / b)
    both = rows.join(said, "class")
    recall, precision = share(F.col("hits"), F.col("rows")), share(F.col("hits"), F.col("said"))
    return both.select("class", "rows", (1 - recall).alias("error"), recall.alias("recall"), precision.alias("precision"), share(2 * precision * recall, precision + recall).alias("f1"))


def mse(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    return df.agg(F.avg(F.pow(F.col(predicted).cast("double") - F.col(actual).cast("double"), F.lit(2.0))).alias("mse"))


def thresholds(df: DataFrame, score: str, most: int = 200) -> list[float]:
    """At most ``most`` quantiles of the distinct scores, and 0, .02, .., 1."""
    probs = [i / (most - 1) for i in range(most)]
    found = df.select(score).distinct().agg(F.percentile_approx(score, probs, 10_000)).first()[0] or []
    return sorted({*found, *STEPS})


def auc_table(df: DataFrame, actual: str, score: str, at: Sequence[float] | None = None) -> DataFrame:
    """For each threshold t: tp, fp, tn, fn of score >= t.

    Rows are counted once by the interval that they fall in; running sums over the few intervals give every threshold.
    """
    at = sorted(at if at is not None else thresholds(df, score))
    y, p = F.col(actual).cast("int"), F.col(score).cast("double")
    place = F.size(F.filter(F.array(*map(F.lit, at)), lambda t: t <= p))
    counts = df.where(y.isNotNull() & p.isNotNull()).groupBy(place.alias("k")).agg(F.sum(y).cast("long").alias("pos"), (F.count("*") - F.sum(y)).cast("long").alias("neg"))
    grid = df.sparkSession.range(len(at) + 1).select(F.col("id").cast("int").alias("k"))
    whole = grid.join(F.broadcast(counts), "k", "left").na.fill(0)
    above = Window.orderBy(F.desc("k"))
    every = Window.partitionBy()
    sums = whole.select("k", F.sum("pos").over(above).alias("tp"), F.sum("neg").over(above).alias("fp"), F.sum("pos").over(every).alias("p"), F.sum("neg").over(every).alias("n")).where("k > 0")
    value = F.element_at(F.array(*map(F.lit, at)), F.col("k"))
    return sums.select(value.alias("threshold"), "tp", "fp", (F.col("n") - F.col("fp")).alias("tn"), (F.col("p") - F.col("tp")).alias("fn"))


def auc(table: DataFrame) -> DataFrame:
    """One row from ``auc_table``: auc by trapezoids, gini."""
    rates = table.select("threshold", (F.col("tp") / (F.col("tp") + F.col("fn"))).alias("tpr"), (F.col("fp") / (F.col("fp") + F.col("tn"))).alias("fpr"))
    ends = rates.sparkSession.createDataFrame([(float("inf"), 0.0, 0.0), (float("-inf"), 1.0, 1.0)], "threshold double, tpr double, fpr double")
    w = Window.orderBy(F.desc("threshold"))
    area = rates.union(ends).select((F.col("fpr") - F.lag("fpr").over(w)).alias("dx"), ((F.col("tpr") + F.lag("tpr").over(w)) / 2).alias("y"))
    return area.agg(F.sum(F.col("dx") * F.col("y")).alias("auc")).select("auc", (2 * F.col("auc") - 1).alias("gini"))


def derived(table: DataFrame) -> DataFrame:
    """err, accuracy, precision, recall, specificity, F1, F2, F0.5, MCC, max per-class error for each threshold."""
    tp, fp, tn, fn = (F.col(c).cast("double") for c in ("tp", "fp", "tn", "fn"))
    over = lambda a, b: F.when(b != 0, a / b)
    f = lambda b: over((1 + b * b) * tp, (1 + b * b) * tp + b * b * fn + fp)
    return table.select(
        "*",
        over(fp + fn, tp + fp + tn + fn).alias("err"),
        over(tp + tn, tp + fp + tn + fn).alias("accuracy"),
        over(tp, tp + fp).alias("precision"),
        over(tp, tp + fn).alias("recall"),
        over(tn, tn + fp).alias("specificity"),
        f(1.0).alias("f1"),
        f(2.0).alias("f2"),
        f(0.5).alias("f0_5"),
        over(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))).alias("mcc"),
        F.greatest(over(fp, fp + tn), over(fn, tp + fn)).alias("max_class_error"),
    )


def best_thresholds(table: DataFrame) -> DataFrame:
    """(criterion, threshold): where each criterion is best, the smallest threshold of equals."""
    d = derived(table)
    good = ["accuracy", "precision", "recall", "specificity", "f1", "f2", "f0_5", "mcc"]
    best = [F.struct(F.lit(c).alias("criterion"), (-F.min_by(F.struct((-F.col("threshold")).alias("t")), F.struct(-F.coalesce(F.col(c), F.lit(-1.0)), F.col("threshold")))["t"]).alias("threshold")).alias(f"_{c}") for c in good]
    worst = F.struct(F.lit("max_class_error").alias("criterion"), F.min_by("threshold", F.struct(F.coalesce("max_class_error", F.lit(2.0)), F.col("threshold"))).alias("threshold")).alias("_m")
    return d.agg(*best, worst).select(F.explode(F.array(*(f"_{c}" for c in good), "_m")).alias("b")).select("b.*")


def gains_lift(df: DataFrame, actual: str, score: str, groups: int = 10) -> DataFrame:
    """By groups of falling score (exact quantiles): rows, positives, response rate, lift, cumulative lift."""
    some = df.where(F.col(actual).isNotNull() & F.col(score).isNotNull())
    cuts = [x for x in reduce.quantiles(some, score, [1 - i / groups for i in range(1, groups)]) if x is not None]
    place = F.lit(len(cuts) + 1)
    for i in range(len(cuts) - 1, -1, -1):
        place = F.when(F.col(score) >= cuts[i], F.lit(i + 1)).otherwise(place)
    rows = some.groupBy(place.alias("group")).agg(F.count("*").alias("rows"), F.sum(F.col(actual).cast("long")).alias("positives"))
    w, every = Window.orderBy("group"), Window.partitionBy()
    base = F.sum("positives").over(every) / F.sum("rows").over(every)
    return rows.select("group", "rows", "positives", (F.col("positives") / F.col("rows")).alias("response_rate"), (F.col("positives") / F.col("rows") / base).alias("lift"), (F.sum("positives").over(w) / F.sum("rows").over(w) / base).alias("cumulative_lift"))


def hit_ratio(df: DataFrame, actual: str, scores: dict[str, str], max_k: int) -> DataFrame:
    """(k, hit_ratio): how often the true class is among the k best scored; equal scores by class name.

    scores: class name -> score column.
    """
    pairs = F.array_sort(F.array(*(F.struct((-F.col(c)).alias("s"), F.lit(name).alias("name")) for name, c in scores.items())))
    place = F.array_position(F.transform(pairs, lambda x: x["name"]), F.col(actual))
    ks = F.explode(F.sequence(F.lit(1), F.lit(max_k))).alias("k")
    hits = df.where(F.col(actual).isNotNull()).select(place.alias("_at")).groupBy("_at").count()
    return hits.select("_at", "count", ks).groupBy("k").agg((F.sum(F.when((F.col("_at") > 0) & (F.col("_at") <= F.col("k")), F.col("count")).otherwise(0)) / F.sum("count")).alias("hit_ratio"))


def binomial_deviance(df: DataFrame, actual: str, score: str) -> DataFrame:
    y, p = F.col(actual).cast("double"), F.col(score).cast("double")
    return df.agg((-2 * F.sum(F.when(y > 0, F.ln(p)).otherwise(F.ln(1 - p)))).alias("deviance"))
