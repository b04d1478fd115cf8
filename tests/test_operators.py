import math

import pytest
from pyspark.sql import functions as F

from loomframe.operators import encode, frame, groups, metrics, models, reduce, sampling


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame([(i, float(i % 5) if i % 7 else None, "ab"[i % 2] if i % 11 else None) for i in range(40)], "k int, x double, f string")


def test_rows_by_order(spark, df):
    numbered = frame.with_rows(df.repartition(7), ["k"])
    assert all(r.row == r.k + 1 for r in numbered.collect())
    assert [r.k for r in frame.row_range(df, ["k"], 3, 5).orderBy("k").collect()] == [2, 3, 4]
    assert [r.k for r in frame.gather(df, ["k"], [2, 0, 2, 99]).orderBy("_at").collect()] == [1, 1, None]
    assert frame.cell(df, ["k"], 3, "k") == 2
    with pytest.raises(IndexError):
        frame.cell(df, ["k"], 99, "k")


def test_rows_over_many_wide_ranges(spark):
    """Adaptive merging of ranges, several of them, rows of 250 bytes: every row once, and in order."""
    n = 3_000_000
    wide = spark.range(n).select(F.pmod(F.col("id") * 7919, F.lit(n)).alias("k"), F.rpad(F.xxhash64("id").cast("string"), 250, "x").alias("pad"))
    numbered = frame.with_rows(wide, ["k"]).select("k", "row", F.length("pad").alias("w"))
    got = numbered.agg(F.count("*"), F.sum((F.col("row") != F.col("k") + 1).cast("int")), F.min("w")).first()
    assert tuple(got) == (n, 0, 250)


def test_binding(spark, df):
    both = frame.cbind(df.select("k"), df.select("k", "x"), 2.0, order=[["k"], ["k"]])
    assert both.columns == ["k", "k0", "x", "C3"] and both.count() == 40
    with pytest.raises(ValueError):
        frame.cbind(df.select("k"), df.limit(3).select("k"), order=[["k"], ["k"]])
    assert frame.rbind(df.select("k"), df.select(F.col("k").alias("z"))).columns == ["z"]
    with pytest.raises(ValueError):
        frame.rbind(df.select("k"), df.select("f"))


def test_assignment(spark, df):
    assert frame.assign_column(df, 4, 1.0).columns[-1] == "C4"
    got = frame.assign_rows(df, [1], ["k"], 9.0).orderBy(F.col("k").desc()).collect()
    assert (9, 9.0, None) in [tuple(r) for r in got]


def test_diff(spark):
    df = spark.createDataFrame([(i, float(i * i)) for i in range(10)], "k int, x double")
    assert [r["diff"] for r in frame.diff(df, "x", ["k"], 1, 2).orderBy("k").collect()] == [2.0] * 8
    many = spark.range(200_000).select("id", F.pow("id", 2).cast("double").alias("x"))
    assert frame.diff(many, "x", ["id"], 3, 2).where("diff <> 18").count() == 0 and frame.diff(many, "x", ["id"], 3, 2).count() == 199_994
    assert [r["diff"] for r in frame.diff(df, "x", ["k"], 2).orderBy("k").collect()] == [float(i * i - (i - 2) ** 2) for i in range(2, 10)]


def test_reducers(spark, df):
    assert reduce.fold(df.select("x"), "sum") is None
    assert reduce.fold(df.select("x"), "sum", na_rm=True) == sum(float(i % 5) for i in range(40) if i % 7)
    assert reduce.fold(df.limit(0).select("x"), "max", na_rm=True) is None
    xs = sorted(float(i % 5) for i in range(40) if i % 7)
    place = 0.37 * (len(xs) - 1)
    want = xs[int(place)] + (xs[int(place) + 1] - xs[int(place)]) * (place - int(place))
    assert reduce.multi_pass_quantile(df, "x", 0.37) == pytest.approx(want)
    assert reduce.quantile_mean(df, "x", 0.5) == pytest.approx((xs[len(xs) // 2 - 1] + xs[len(xs) // 2]) / 2)
    assert reduce.xorsum(spark.createDataFrame([(3.0,), (3.0,), (5.0,)], "x double"), "x") == pytest.approx(0.0, abs=1e300)
    assert reduce.summary(df, "x").first()["na"] == 6
    assert sum(r["count"] for r in reduce.histogram(df, "x", 3).collect()) == 34
    assert reduce.identical(df, df.repartition(3)) and not reduce.identical(df, df.limit(5))
    assert reduce.ignorable(spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "i int, u string, k int")) == ["u", "k"]


def test_empty_and_constant(spark):
    empty = spark.createDataFrame([], "x double")
    assert reduce.histogram(empty, "x", 3).count() == 0
    one = spark.createDataFrame([(0.1,)] * 5, "x double")
    assert [tuple(r) for r in reduce.histogram(one, "x", 3).collect()] == [(0, 0.1, 5)]
    assert groups.scale(one).first()[0] is None
    assert groups.impute(empty, "x").count() == 0


def test_groups(spark, df):
    got = {r.f: r.n for r in groups.ddply(df, ["f"], {"n": F.count("*")}).collect()}
    assert set(got) == {"a", "b"}
    assert groups.impute(df, "x", "median", ["f"]).where("x IS NULL").count() == 0
    assert groups.impute(df, "f").where("f IS NULL").count() == 0
    by = groups.ddply_function(df.select("f", "x"), ["f"], lambda g: float(g["x"].sum()), "C1 double").collect()
    assert len(by) == 2
    assert [r.x for r in groups.order(df, "x", 3, reverse=True, ties=["k"]).collect()] == [4.0] * 3


def test_sampling(spark, df):
    assert sorted(r["count"] for r in sampling.split(df, [0.5, 0.25], ["k"]).groupBy("split").count().collect()) == [10, 10, 20]
    a = sampling.sample(df, 10, ["k"], 5)
    b = sampling.sample(df.repartition(9), 10, ["k"], 5)
    assert {r.k for r in a.collect()} == {r.k for r in b.collect()} and a.count() == 10
    assert sampling.insert_missing(df, 1.0, ["k"], ["f"]).where("f IS NOT NULL").count() == 0
    got = {r.f: r["count"] for r in sampling.stratified(df.dropna(), "f", ["k"], {"a": 2, "b": 0}).groupBy("f").count().collect()}
    assert set(got) == {"a"}


def test_encoding(spark, df):
    hot = encode.one_hot(df, "f")
    assert hot.columns == ["f.a", "f.b", "k", "x"]
    made, names = encode.design(df, ["x", "f"])
    assert names == ["x.x", "f.b"]
    inter = encode.interaction(df.withColumn("g", F.lit("c")), ["f", "g"], max_factors=1)
    assert {r[0] for r in inter.select("f_g").distinct().collect()} == {"other", "b_c"} or {r[0] for r in inter.select("f_g").distinct().collect()} == {"other", "a_c"}


def test_metrics(spark):
    df = spark.createDataFrame([(1, 0.9), (1, 0.8), (0, 0.7), (1, 0.6), (0, 0.1)], "y int, s double")
    table = metrics.auc_table(df, "y", "s", [0.0, 0.1, 0.6, 0.7, 0.8, 0.9, 1.0])
    assert metrics.auc(table).first().auc == pytest.approx(5 / 6)
    best = {r.criterion: r.threshold for r in metrics.best_thresholds(table).collect()}
    assert best["recall"] == 0.0 and best["precision"] == 0.8
    cm = {(r.actual, r.predicted): r.n for r in metrics.confusion_matrix(spark.createDataFrame([("a", "a"), ("a", None)], "x string, y string"), "x", "y").collect()}
    assert cm == {("a", "a"): 1, ("a", "NA"): 1, ("NA", "a"): 0, ("NA", "NA"): 0}


def test_models(spark):
    rows = [(float(i), 2.0 * i + 1 + (i % 3 - 1) * 0.1, float(i > 20), float(i % 4)) for i in range(40)]
    df = spark.createDataFrame(rows, "x double, y double, b double, z double")
    one = models.lr2(df, "x", "y").first()
    assert one.beta1 == pytest.approx(2.0, abs=0.01)
    g = models.glm(df, "y", ["x", "z"])
    assert g.beta[1] == pytest.approx(one.beta1, abs=0.01)
    assert models.GLM.load(g.save()).beta.tolist() == g.beta.tolist()
    lasso = models.glm(df, "y", ["x", "z"], alpha=1.0, lam=50.0)
    assert lasso.beta[2] == 0.0 and 0 < lasso.beta[1] < 2
    p = models.glm(df.withColumn("c", F.round(F.exp(F.col("x") / 20))), "c", ["x"], "poisson")
    assert p.beta[1] == pytest.approx(1 / 20, abs=0.01)
    pc = models.pca(df, ["x", "y", "z"])
    assert pc.sdev[0] ** 2 + pc.sdev[1] ** 2 + pc.sdev[2] ** 2 == pytest.approx(3)
    km = models.kmeans(df, ["x", "y"], 2)
    assert km.predict(df).select("cluster").distinct().count() == 2
    nb = models.naive_bayes(df.withColumn("c", F.when(F.col("b") == 1, "hi").otherwise("lo")), "c", ["x"])
    assert nb.predict(df).where("(predict = 'hi') <> (b = 1)").count() <= 1
    assert models.scorecard(df, {"x": [("x > 10", 5.0), ("true", 1.0)]}).agg(F.max("score")).first()[0] == 5.0


def test_cox_against_a_direct_likelihood(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    rows = [(int(t), int(e), float(x)) for t, e, x in zip(rng.integers(1, 9, 60), rng.integers(0, 2, 60), rng.normal(size=60), strict=True)]
    m = models.coxph(spark.createDataFrame(rows, "t int, e int, x double"), "t", "e", ["x"])

    def loglik(b):
        total = 0.0
        for t in sorted({r[0] for r in rows if r[1]}):
            dead = [r[2] for r in rows if r[0] == t and r[1]]
            risk = sum(math.exp(b * r[2]) for r in rows if r[0] >= t)
            own = sum(math.exp(b * x) for x in dead)
            total += b * sum(dead) - sum(math.log(risk - k / len(dead) * own) for k in range(len(dead)))
        return total

    b = m["coef"]["x"]
    assert loglik(b) > loglik(b + 1e-3) and loglik(b) > loglik(b - 1e-3)


def test_bounds_are_errors(spark, monkeypatch):
    rows = [(10 + i % 2, i % 2, float(i), i) for i in range(8)]
    df = spark.createDataFrame(rows, "t int, e int, x double, s int")
    with pytest.raises(ValueError, match="start times"):
        models.coxph(df, "t", "e", ["x"], start="s", max_times=4)
    monkeypatch.setattr(metrics, "MOST_LEVELS", 7)
    with pytest.raises(ValueError, match="levels"):
        metrics.confusion_matrix(df, "s", "t")
