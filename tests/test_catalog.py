import itertools
import math

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

from loomframe.operators import models
from loomframe.plans import catalog

NAN, INF = math.nan, math.inf


def test_arith_broadcast_follows_its_sql_on_odd_numbers(spark, tmp_path):
    quantities = [0.0, -0.0, -3.0, 7.0, NAN, INF, None, 1e300, 5e-324]
    prices = [0.0, -1.5, 100.00005, 2.00015, 33333.33335, -0.00001, NAN, INF, None, 1e305]
    rows = list(itertools.product(quantities, prices, [0.0, 0.05, NAN, None], [0.0, 0.00125, None]))
    names = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
    keys = {"l_orderkey": pa.array(range(len(rows)), pa.int64()), "l_linenumber": pa.array([1] * len(rows), pa.int32())}
    pq.write_table(pa.table(keys | {n: pa.array(x, pa.float64()) for n, x in zip(names, zip(*rows, strict=True), strict=True)}), tmp_path / "lineitem.parquet")
    lineitem = pq.read_table(tmp_path / "lineitem.parquet")  # noqa: F841
    want = duckdb.sql(catalog.SQL["arith_broadcast"]).fetchall()
    got = [tuple(r) for r in catalog.QUERIES["arith_broadcast"](spark, str(tmp_path)).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_boosting_of_classes_depends_on_rows_alone_and_counts_equal_ones(spark):
    """Repeating all rows, or dealing them otherwise, leaves the trees as they are; splits know all rows, not a sample of them."""
    base = [("abc"[(i * i) % 7 % 3], float(i % 90), float(i % 11)) for i in range(12000)]
    df = spark.createDataFrame(base, "y string, a double, b double")
    make = lambda d, rows: models.multinomial_boosting(d, "y", ["a", "b"], ntrees=1, depth=2, min_rows=rows)
    once, twice = make(df, 10), make(df.union(df).repartition(7), 20)
    splits = lambda m: [[t.split(" THEN ")[0] for t in own] for own in m.trees]
    assert splits(once) == splits(twice)


def test_tree_fits_hold_few_rows_in_a_task(spark):
    df = spark.range(1000).selectExpr("double(id) AS `x.1`", "id AS other").coalesce(1)
    made = models._spread(df, ["x.1"], most=100)
    assert made.columns == ["x.1"] and made.rdd.getNumPartitions() == 10
    assert made.agg({"`x.1`": "sum"}).first()[0] == 499500.0
