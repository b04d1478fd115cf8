import math

import pytest
from pyspark.sql import functions as F

from loomframe import session
from loomframe.operators import metrics, models, reduce
from loomframe.operators.workspace import BUILT_IN, Workspace, can_be_coerced_to_logical


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame([(i, float(i), None if i == 3 else float(i * 10), "ab"[i % 2]) for i in range(1, 7)], "k int, x double, y double, f string")


def test_names_and_functions(spark, df):
    w = Workspace()
    w.put("h", df)
    assert w.put_value(spark, "note", "text").first().value == "text" and w.ls() == ["h", "note"]
    w.add_function("twice", lambda c: c * 2)
    assert w.frames["h"].agg(F.sum(w.call("twice", F.col("x")))).first()[0] == 42
    with pytest.raises(ValueError):
        w.add_function("sum", max)
    with pytest.raises(KeyError):
        w.call("nothing")
    assert w.call("sum", "h", "sum", ["x"]) == 21 and w.call("quantile", "h", "x", [0.5]) == [3.5]
    assert [r.place for r in w.call("which", "h", F.col("x") > 4, ["k"]).orderBy("place").collect()] == [5, 6]
    assert [r.k for r in w.call("head", "h", ["k"], 2).orderBy("k").collect()] == [1, 2] and [r.k for r in w.call("tail", "h", ["k"], -4).orderBy("k").collect()] == [5, 6]
    assert {"%*%", "t", "diff", "strsplit", "as.numeric", "runif", "sample", "setLevel", "millis", "xorsum", "ddply"} <= set(BUILT_IN)
    w.put_metrics("m", "h", mse=1.0)
    assert w.metrics("m") == [{"model": "m", "frame": "h", "mse": 1.0}] and w.metrics("other") == []
    w.rm("h", "absent")
    assert w.ls() == ["note"]
    assert can_be_coerced_to_logical(df.select((F.col("x") > 2).cast("int").alias("z")), "z") and not can_be_coerced_to_logical(df, "f")


def test_zones_and_folders(spark, tmp_path):
    before = session.timezone(spark)
    assert session.timezone(spark, "Europe/Paris") == "Europe/Paris" and "UTC" in session.timezones(spark)
    session.timezone(spark, before)
    with pytest.raises(ValueError):
        session.timezone(spark, "Nowhere/Town")
    (tmp_path / "a").mkdir()
    assert session.delete_folder(spark, str(tmp_path / "a"), str(tmp_path)) and not (tmp_path / "a").exists()
    with pytest.raises(ValueError):
        session.delete_folder(spark, str(tmp_path.parent), str(tmp_path))


@pytest.mark.parametrize("few", [3, 20_000])
def test_quantiles_by_narrowing(spark, monkeypatch, few):
    monkeypatch.setattr(reduce, "FEW", few)
    df = spark.range(5000).select(F.when(F.col("id") % 10 > 0, (F.col("id") * 7919 % 5003) ** F.lit(2.0)).alias("x"), (F.col("id") % 3).alias("g"), (F.col("id") % 2).alias("z"))
    rows = [(r.g, r.x) for r in df.where("x IS NOT NULL").collect()]

    def want(xs, p):
        xs = sorted(xs)
        at = p * (len(xs) - 1)
        return xs[int(at)] + (xs[min(len(xs) - 1, int(at) + 1)] - xs[int(at)]) * (at - int(at))

    probs = [0.0, 0.001, 0.37, 0.5, 0.99, 1.0]
    assert reduce.quantiles(df, "x", probs) == pytest.approx([want([x for _, x in rows], p) for p in probs])
    assert reduce.quantiles(df, "z", [0.25, 0.75]) == [0.0, 1.0] and reduce.quantiles(df.limit(0), "x", [0.5]) == [None]
    assert {r.g: r["quantile"] for r in reduce.grouped_quantile(df, ["g"], "x", 0.9).collect()} == pytest.approx({g: want([x for h, x in rows if h == g], 0.9) for g in range(3)})
    ends = spark.createDataFrame([(float("-inf"),), (1.0,), (2.0,), (float("inf"),)], "x double")
    assert reduce.quantiles(ends, "x", [1 / 3])[0] == pytest.approx(1.0)
    assert reduce.extremes(df, "x", 3)[0] == sorted({x for _, x in rows})[:3]


def test_models_saved_exported_and_extended(spark):
    df = spark.range(600).select("id", (F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 11).cast("double").alias("b"), ((F.col("id") % 7 > 3).cast("int") + (F.col("id") % 11 > 8).cast("int")).cast("string").alias("y"))
    m = models.multinomial_boosting(df, "y", ["a", "b"], ntrees=6, depth=3, rate=0.5)
    again = models.load_model(models.save_model(m))
    right = again.predict(df).where("predict = y").count()
    assert right > 580 and again.trees == m.trees
    glm = models.glm(df, "b", ["a"], standardize=True, lam=0.1, alpha=0.5)
    assert models.load_model(models.save_model(glm)).beta.tolist() == glm.beta.tolist()
    plain, scaled = models.glm(df, "b", ["a"]), models.glm(df, "b", ["a"], standardize=True)
    assert scaled.beta.tolist() == pytest.approx(plain.beta.tolist())
    ones = df.withColumn("t", (F.col("a") > 3).cast("double"))
    free, held = models.glm(ones, "t", ["b"], "binomial"), models.glm(ones, "t", ["b"], "binomial", prior=0.1)
    share = ones.agg(F.avg("t")).first()[0]
    assert held.beta[0] - free.beta[0] == pytest.approx(math.log(0.1 / 0.9) - math.log(share / (1 - share)))
    _, errors = models.glm_folds(df, "b", ["a"], ["id"], 3)
    assert len(errors) == 3 and all(5 < e < 15 for e in errors)
    trees, voted = models.forest_out_of_bag(ones, "t", ["a"], ["id"], ntrees=4, depth=2, impurity="entropy")
    assert len(trees) == 4 and voted.where("oob <> t").count() == 0 and 400 < voted.where("oob IS NOT NULL").count() <= 600
    measures = {r["class"]: r for r in metrics.class_measures(metrics.confusion_matrix(again.predict(df), "y", "predict")).collect()}
    assert sum(r.rows for r in measures.values()) == 600


def test_survival_weights_and_curve(spark):
    rows = [(4, 1, 0.0), (3, 1, 1.0), (1, 1, 1.0), (1, 0, 0.0), (2, 1, 1.0), (2, 1, 0.0), (3, 0, 0.0)]
    df = spark.createDataFrame([(*r, 2.0 if i < 3 else 1.0) for i, r in enumerate(rows)], "t int, e int, x double, w double")
    twice = df.union(df.where("w = 2")).withColumn("w", F.lit(1.0))
    for ties in ("breslow",):  # a weight of two is a row twice
        a, b = models.coxph(df, "t", "e", ["x"], ties=ties, weights="w"), models.coxph(twice, "t", "e", ["x"], ties=ties)
        assert a["coef"]["x"] == pytest.approx(b["coef"]["x"], rel=1e-6)
        assert [h for _, h in a["baseline"]] == pytest.approx([h for _, h in b["baseline"]], rel=1e-6)
    curve = models.survfit(models.load_model(models.save_model(a)), x=1.0)
    assert [t for t, _, _ in curve] == [1, 2, 3, 4] and all(p[2] > q[2] for p, q in zip(curve, curve[1:], strict=False)) and 0 < curve[-1][2] < 1
