"""Named queries over the star schema, each with the SQL that states the same result (or none where SQL has none)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arithmetic as A
from ..functions import binning, dates, factors, sequences, text
from ..operators import encode, frame, groups, metrics, models, reduce, sampling
from ..operators.workspace import Workspace, can_be_coerced_to_logical
from ..sources.generate import create_frame as make_frame

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


c = F.col
#: A line-item quantity that is missing above 45, to exercise missing values.
def holed():
    return F.when(c("l_quantity") <= 45, c("l_quantity"))


HOLED_SQL = "CASE WHEN l_quantity <= 45 THEN l_quantity END"


# -- grouped and whole-frame reducers -----------------------------------------------------------------------------


@query(
    """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_price,
    round(avg(l_discount), 6) AS mean_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL"""
)
def group_summary_q1(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem").where("l_shipdate <= timestamp_ntz '1998-09-02'")
    return groups.ddply(li, ["l_returnflag", "l_linestatus"], {"sum_qty": F.round(F.sum("l_quantity"), 2), "sum_price": F.round(F.sum("l_extendedprice"), 2), "mean_disc": F.round(F.avg("l_discount"), 6), "n": F.count("*")})


@query("SELECT o_orderpriority, o_orderstatus, count(*) AS n, round(min(o_totalprice), 2) AS least, round(max(o_totalprice), 2) AS most, round(stddev_samp(o_totalprice), 4) AS sd, round(quantile_cont(o_totalprice, 0.5), 4) AS med FROM orders GROUP BY ALL")
def ddply_multi(spark, sf_dir):
    x = c("o_totalprice")
    orders, keys = read(spark, sf_dir, "orders"), ["o_orderpriority", "o_orderstatus"]
    most = groups.ddply(orders, keys, {"n": F.count("*"), "least": F.round(F.min(x), 2), "most": F.round(F.max(x), 2), "sd": F.round(F.stddev_samp(x), 4)})
    return most.join(reduce.grouped_quantile(orders, keys, "o_totalprice", 0.5, "med"), keys).withColumn("med", F.round("med", 4))


@query("SELECT c_mktsegment, round(quantile_cont(c_acctbal, 0.75) - quantile_cont(c_acctbal, 0.25), 4) AS C1 FROM customer GROUP BY c_mktsegment")
def ddply_udf(spark, sf_dir):
    customers = read(spark, sf_dir, "customer")
    low, high = (reduce.grouped_quantile(customers, ["c_mktsegment"], "c_acctbal", p, f"q{p}") for p in (0.25, 0.75))
    return low.join(high, "c_mktsegment").select("c_mktsegment", F.round(c("`q0.75`") - c("`q0.25`"), 4).alias("C1"))


@query(f"SELECT CASE WHEN count(*) = count(q) THEN sum(q) END AS sum_poisoned, round(sum(q), 2) AS sum_na_rm, CASE WHEN count(*) = count(q) THEN min(q) END AS min_poisoned, min(q) AS min_na_rm, max(q) AS max_na_rm, round(sum(l_tax), 4) AS sum_whole FROM (SELECT {HOLED_SQL} AS q, l_tax FROM lineitem)")
def sum_min_max_na(spark, sf_dir):
    x = read(spark, sf_dir, "lineitem").select(holed().alias("q"), "l_tax")
    q = c("q")
    return x.agg(reduce.total(q).alias("sum_poisoned"), F.round(reduce.total(q, True), 2).alias("sum_na_rm"), reduce.least(q).alias("min_poisoned"), reduce.least(q, True).alias("min_na_rm"), reduce.greatest(q, True).alias("max_na_rm"), F.round(reduce.total(c("l_tax")), 4).alias("sum_whole"))


@query(f"SELECT round(avg(q), 6) AS mean, round(stddev_samp(q), 6) AS sd, round(var_samp(q), 6) AS var FROM (SELECT {HOLED_SQL} AS q FROM lineitem)")
def mean_sd_var(spark, sf_dir):
    x = read(spark, sf_dir, "lineitem").select(holed().alias("q"))
    return x.agg(F.round(reduce.mean(c("q")), 6).alias("mean"), F.round(reduce.sd(c("q")), 6).alias("sd"), F.round(F.var_samp("q"), 6).alias("var"))


_COV = ["l_quantity", "l_extendedprice", "l_discount"]


@query(" UNION ALL ".join(f"SELECT '{a}' AS i, '{b}' AS j, round(covar_samp({a}, {b}), 4) AS value FROM lineitem" for a in _COV for b in _COV))
def cov_matrix(spark, sf_dir):
    return reduce.covariance(read(spark, sf_dir, "lineitem"), _COV).select("i", "j", F.round("value", 4).alias("value"))


@query("SELECT round(quantile_cont(l_extendedprice, 0.1), 4) AS q10, round(quantile_cont(l_extendedprice, 0.25), 4) AS q25, round(quantile_cont(l_extendedprice, 0.5), 4) AS median, round(quantile_cont(l_extendedprice, 0.9), 4) AS q90 FROM lineitem")
def median_quantiles(spark, sf_dir):
    q = reduce.quantiles(read(spark, sf_dir, "lineitem"), "l_extendedprice", [0.1, 0.25, 0.5, 0.9])
    return spark.range(1).select(*(F.round(F.lit(x), 4).alias(n) for x, n in zip(q, ("q10", "q25", "median", "q90"), strict=True)))


@query("SELECT round(quantile_cont(l_extendedprice, 0.37), 4) AS q FROM lineitem")
def quantile_multi_pass(spark, sf_dir):
    q = reduce.multi_pass_quantile(read(spark, sf_dir, "lineitem"), "l_extendedprice", 0.37)
    return spark.range(1).select(F.round(F.lit(q), 4).alias("q"))


@query("SELECT p_brand AS mode FROM part GROUP BY p_brand ORDER BY count(*) DESC, p_brand LIMIT 1")
def mode_level(spark, sf_dir):
    return read(spark, sf_dir, "part").agg(reduce.mode(c("p_brand")).alias("mode"))


@query('SELECT event_type AS "row.names", count(*) AS "Count" FROM events GROUP BY event_type')
def table_1way(spark, sf_dir):
    return reduce.table(read(spark, sf_dir, "events"), "event_type")


@query("SELECT l_returnflag, count(*) FILTER (WHERE l_linestatus = 'F') AS \"F\", count(*) FILTER (WHERE l_linestatus = 'O') AS \"O\" FROM lineitem GROUP BY l_returnflag")
def table_2way(spark, sf_dir):
    return reduce.table(read(spark, sf_dir, "lineitem"), "l_returnflag", "l_linestatus", ["F", "O"])


@query("SELECT DISTINCT p_brand, p_type FROM part")
def unique_rows(spark, sf_dir):
    return groups.unique(read(spark, sf_dir, "part").select("p_brand", "p_type"))


_SUMMED = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(" UNION ALL ".join(f"SELECT '{x}' AS \"column\", min({x}) AS min, max({x}) AS max, round(avg({x}), 6) AS mean, round(stddev_samp({x}), 6) AS sd, count(*) - count({x}) AS missing, bool_and({x} = floor({x})) AS is_int FROM lineitem" for x in _SUMMED))
def summary_stats(spark, sf_dir):
    return reduce.rollups(read(spark, sf_dir, "lineitem"), _SUMMED).select("column", "min", "max", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"), "missing", "is_int")


@query(
    """SELECT count(*) AS rows, count(*) FILTER (WHERE value = 0) AS zeros, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd, round(quantile_cont(value, 0.001), 6) AS p0001, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.999), 6) AS p0999,
    (SELECT round(min(value), 6) FROM events) AS smallest, (SELECT round(max(value), 6) FROM events) AS largest FROM events"""
)
def summary_page(spark, sf_dir):
    s = reduce.summary(read(spark, sf_dir, "events"), "value")
    p = c("percentiles")
    return s.select("rows", "zeros", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"), F.round(p[0], 6).alias("p0001"), F.round(p[5], 6).alias("p50"), F.round(p[10], 6).alias("p0999"), F.round(c("smallest")[0], 6).alias("smallest"), F.round(c("largest")[0], 6).alias("largest"))


@query(
    """WITH r AS (SELECT min(o_totalprice) AS lo, (max(o_totalprice) - min(o_totalprice)) / 20 AS w FROM orders),
    k AS (SELECT least(floor((o_totalprice - lo) / w), 19)::INT AS bin, count(*) AS n FROM orders, r GROUP BY 1)
    SELECT b::INT AS bin, round(lo + b * w, 4) AS low, coalesce(n, 0) AS count FROM range(20) t(b), r LEFT JOIN k ON bin = b"""
)
def histogram(spark, sf_dir):
    return reduce.histogram(read(spark, sf_dir, "orders"), "o_totalprice", 20).select("bin", F.round("low", 4).alias("low"), "count")


@query("SELECT count(*) AS n, round(sum(l_quantity * l_quantity), 2) AS qq, round(sum(l_quantity * l_tax), 4) AS qt, round(sum(l_tax * l_tax), 6) AS tt FROM lineitem")
def matmul_gram(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem")
    g = frame.gram(li, ["l_quantity", "l_tax"])
    cell = lambda i, j: F.max(F.when((c("i") == i) & (c("j") == j), c("value")))
    return g.agg(F.lit(li.count()).cast("long").alias("n"), F.round(cell("l_quantity", "l_quantity"), 2).alias("qq"), F.round(cell("l_quantity", "l_tax"), 4).alias("qt"), F.round(cell("l_tax", "l_tax"), 6).alias("tt"))


@query("SELECT a.r_regionkey AS i, b.r_regionkey AS j, sum((n1.n_nationkey + 1)::DOUBLE * (n2.n_nationkey + 2)::DOUBLE) AS value FROM region a CROSS JOIN region b JOIN nation n1 ON n1.n_regionkey = a.r_regionkey JOIN nation n2 ON n2.n_regionkey = b.r_regionkey AND n1.n_nationkey = n2.n_nationkey GROUP BY ALL")
def matmul_sparse(spark, sf_dir):
    n = read(spark, sf_dir, "nation")
    left = n.select("n_regionkey", "n_nationkey", (c("n_nationkey") + 1.0).alias("v"))
    right = n.select("n_nationkey", "n_regionkey", (c("n_nationkey") + 2.0).alias("v"))
    return frame.matmul(left, right)


# -- slicing, predicates, element-wise ----------------------------------------------------------------------------


@query("SELECT l_orderkey, l_quantity, l_discount FROM lineitem WHERE l_quantity > 30 AND l_discount < 0.03")
def filter_boolean(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem")
    return frame.filter_rows(li, (c("l_quantity") > 30) & (c("l_discount") < 0.03)).select("l_orderkey", "l_quantity", "l_discount")


@query(f"SELECT count(*) AS kept FROM lineitem WHERE ({HOLED_SQL}) > 30 OR ({HOLED_SQL}) IS NULL")
def filter_keeps_na(spark, sf_dir):
    return frame.filter_rows(read(spark, sf_dir, "lineitem"), holed() > 30, na_rows="keep").agg(F.count("*").alias("kept"))


@query("SELECT s_suppkey, s_acctbal FROM supplier")
def slice_columns_neg(spark, sf_dir):
    return frame.columns(read(spark, sf_dir, "supplier"), [-2, -3])


@query("SELECT event_id, user_id, event_type FROM events ORDER BY event_id LIMIT 51 OFFSET 99")
def row_range(spark, sf_dir):
    return frame.row_range(read(spark, sf_dir, "events"), ["event_id"], 100, 150).select("event_id", "user_id", "event_type")


@query("WITH r AS (SELECT *, row_number() OVER (ORDER BY o_orderkey) AS rn FROM orders) SELECT w.i AS _at, o_orderkey, o_custkey FROM (VALUES (0::BIGINT, 5), (1, 3), (2, 5), (3, 999999999)) w(i, r) LEFT JOIN r ON rn = w.r")
def row_gather(spark, sf_dir):
    return frame.gather(read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), ["o_orderkey"], [5, 3, 0, 5, 999999999])


@query("SELECT n_nationkey, n_name, n_regionkey, n_nationkey * 2 AS \"C4\" FROM nation")
def assign_column(spark, sf_dir):
    return frame.assign_column(read(spark, sf_dir, "nation"), 4, c("n_nationkey") * 2)


@query("SELECT n_nationkey, n_name, CASE WHEN row_number() OVER (ORDER BY n_nationkey) IN (2, 4) THEN 99.0 ELSE n_regionkey END::DOUBLE AS n_regionkey FROM nation")
def assign_rows(spark, sf_dir):
    n = read(spark, sf_dir, "nation").withColumn("n_regionkey", c("n_regionkey").cast("double"))
    return frame.assign_rows(n, [2, 4], ["n_nationkey"], 99.0, ["n_regionkey"])


@query("SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS net, round(l_quantity + l_tax * 2, 4) AS mix, l_extendedprice / l_quantity AS unit, l_quantity / (l_discount - l_discount) AS inf FROM lineitem")
def arith_broadcast(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem")
    zero = c("l_discount") - c("l_discount")
    return li.select("l_orderkey", "l_linenumber", A.round_scaled(c("l_extendedprice") * (1 - c("l_discount")), 4).alias("net"), A.round_scaled(c("l_quantity") + c("l_tax") * 2, 4).alias("mix"), A.ieee_divide(c("l_extendedprice"), c("l_quantity")).alias("unit"), A.ieee_divide(c("l_quantity"), zero).alias("inf"))


@query("SELECT c_custkey, floor(c_acctbal / 7) AS q, round(c_acctbal % 7, 4) AS r, round(pow(c_acctbal / 1000, 2), 6) AS p FROM customer")
def int_div_mod(spark, sf_dir):
    b = c("c_acctbal")
    return read(spark, sf_dir, "customer").select("c_custkey", A.int_divide(b, F.lit(7)).alias("q"), F.round(A.remainder(b, F.lit(7)), 4).alias("r"), F.round(A.power(b / 1000, F.lit(2)), 6).alias("p"))


@query("SELECT o_orderkey, (o_totalprice < 150000)::INT AS lt, (o_totalprice >= 150000)::INT AS ge, (o_orderstatus = 'F')::INT AS eq, (o_orderstatus <> 'F')::INT AS ne FROM orders")
def compare_ops(spark, sf_dir):
    x, s = c("o_totalprice"), c("o_orderstatus")
    return read(spark, sf_dir, "orders").select("o_orderkey", A.compare(x, "<", F.lit(150000.0)).alias("lt"), A.compare(x, ">=", F.lit(150000.0)).alias("ge"), A.compare(s, "==", F.lit("F")).alias("eq"), A.compare(s, "!=", F.lit("F")).alias("ne"))


@query(
    """SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN a IS NULL OR b IS NULL THEN NULL ELSE (a <> 0 AND b <> 0)::INT END AS both, (a <> 0 OR b <> 0)::INT AS any_, coalesce((a = 0)::INT, 0) AS none
    FROM (SELECT *, CASE WHEN l_quantity <= 45 THEN (l_quantity > 20)::INT END AS a, (l_discount > 0.05)::INT AS b FROM lineitem)"""
)
def logic_na(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.when(c("l_quantity") <= 45, (c("l_quantity") > 20).cast("int")).alias("a"), (c("l_discount") > 0.05).cast("int").alias("b"))
    return li.select("l_orderkey", "l_linenumber", "l_partkey", A.and_(c("a"), c("b")).alias("both"), A.or_(c("a"), c("b")).alias("any_"), A.not_(c("a")).alias("none"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 45 THEN NULL WHEN l_quantity > 30 THEN 'large' WHEN l_quantity > 10 THEN 'medium' ELSE 'small' END AS size FROM lineitem")
def ifelse_nested(spark, sf_dir):
    q = holed()
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", A.if_else(A.compare(q, ">", F.lit(30)), F.lit("large"), A.if_else(A.compare(q, ">", F.lit(10)), F.lit("medium"), F.lit("small"))).alias("size"))


@query(f"SELECT count(*) FILTER (WHERE q IS NULL) AS na, count(q) AS some FROM (SELECT {HOLED_SQL} AS q FROM lineitem)")
def is_na_counts(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").select(A.is_na(holed()).alias("x")).agg(F.sum("x").alias("na"), F.sum(1 - c("x")).alias("some"))


@query("SELECT row_number() OVER (ORDER BY event_id) AS place FROM events QUALIFY event_type = 'click'")
def which(spark, sf_dir):
    return frame.with_rows(read(spark, sf_dir, "events").select("event_id", "event_type"), ["event_id"], "place").where("event_type = 'click'").select("place")


@query("SELECT l_orderkey, l_linenumber, round_even(l_extendedprice, 0) AS r0, round_even(l_extendedprice, 1) AS r1 FROM lineitem")
def round_half_even(spark, sf_dir):
    x = c("l_extendedprice")
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", A.round_even(x, 0).alias("r0"), A.round_even(x, 1).alias("r1"))


@query("SELECT o_orderkey, printf('%.1f', o_totalprice)::DOUBLE AS r1, printf('%.2e', o_totalprice)::DOUBLE AS s3 FROM orders")
def round_signif_exact(spark, sf_dir):
    x = c("o_totalprice")
    return read(spark, sf_dir, "orders").select("o_orderkey", A.round_exact(x, 1).alias("r1"), A.signif(x, 3).alias("s3"))


@query("SELECT c_custkey, abs(c_acctbal) AS a, sign(c_acctbal)::DOUBLE AS s, CASE WHEN c_acctbal >= 0 THEN round(sqrt(c_acctbal), 6) END AS r, CASE WHEN c_acctbal > 0 THEN round(ln(c_acctbal), 6) WHEN c_acctbal = 0 THEN '-inf'::DOUBLE END AS l, round(exp(c_acctbal / 10000), 6) AS e, ceil(c_acctbal) AS c, floor(c_acctbal) AS f, trunc(c_acctbal) AS t FROM customer")
def math_funcs(spark, sf_dir):
    x, u = c("c_acctbal"), A.UNARY
    return read(spark, sf_dir, "customer").select("c_custkey", u["abs"](x).alias("a"), u["sgn"](x).alias("s"), F.round(u["sqrt"](x), 6).alias("r"), F.round(u["log"](x), 6).alias("l"), F.round(u["exp"](x / 10000), 6).alias("e"), u["ceil"](x).alias("c"), u["floor"](x).alias("f"), u["trunc"](x).alias("t"))


_TRIG = ["cos", "sin", "tan", "acos", "asin", "atan", "cosh", "sinh", "tanh"]


@query("SELECT p_partkey, " + ", ".join(f"round({f}(p_size / 51.0), 8) AS {f}_" for f in _TRIG) + " FROM part")
def trig_funcs(spark, sf_dir):
    x = c("p_size") / 51.0
    return read(spark, sf_dir, "part").select("p_partkey", *(F.round(A.UNARY[f](x), 8).alias(f"{f}_") for f in _TRIG))


# -- strings, times, factors, bins --------------------------------------------------------------------------------


@query("SELECT p_partkey, lower(p_name) AS low, upper(p_name) AS up, p_type AS trimmed FROM part")
def string_case_trim(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", text.lower(c("p_name")).alias("low"), text.upper(c("p_name")).alias("up"), text.trim(F.concat(F.lit(" \t"), c("p_type"), F.lit("  "))).alias("trimmed"))


@query("SELECT p_partkey, regexp_replace(p_name, '[aeiou]', '_') AS first_, regexp_replace(p_name, '[aeiou]', '_', 'g') AS all_, regexp_replace(p_brand, 'BRAND', 'b', 'gi') AS anycase FROM part")
def sub_gsub(spark, sf_dir):
    n = c("p_name")
    return read(spark, sf_dir, "part").select("p_partkey", text.sub("[aeiou]", "_", n).alias("first_"), text.gsub("[aeiou]", "_", n).alias("all_"), text.gsub("BRAND", "b", c("p_brand"), ignore_case=True).alias("anycase"))


@query("SELECT o_orderkey, nullif(string_split(o_orderpriority, '-')[1], '') AS \"C1\", string_split(o_orderpriority, '-')[2] AS \"C2\" FROM orders")
def strsplit_cols(spark, sf_dir):
    return text.strsplit(read(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", "-", 2).select("o_orderkey", "C1", "C2")


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'final' WHEN 'O' THEN 'open' ELSE o_orderstatus END AS status FROM orders")
def revalue(spark, sf_dir):
    return read(spark, sf_dir, "orders").select("o_orderkey", text.revalue(c("o_orderstatus"), "F:final;O:open").alias("status"))


@query("SELECT event_id, year(ts)::INT AS y, (month(ts) - 1)::INT AS mo, day(ts)::INT AS d, hour(ts)::INT AS h, minute(ts)::INT AS mi, second(ts)::INT AS s, (epoch_us(ts) // 1000 % 1000)::INT AS ms FROM events")
def date_parts(spark, sf_dir):
    t = c("ts")
    return read(spark, sf_dir, "events").select("event_id", *(dates.part(t, n).alias(a) for n, a in (("year", "y"), ("month", "mo"), ("day", "d"), ("hour", "h"), ("minute", "mi"), ("second", "s"), ("millis", "ms"))))


@query("SELECT o_orderkey, epoch_ms(date_trunc('day', o_orderdate)) AS ms FROM orders")
def as_date(spark, sf_dir):
    written = F.date_format(c("o_orderdate"), "dd/MM/yyyy")
    return read(spark, sf_dir, "orders").select("o_orderkey", dates.as_date(written, "%d/%m/%Y").alias("ms"))


@query("SELECT p_partkey, (dense_rank() OVER (ORDER BY p_type) - 1)::BIGINT AS code FROM part")
def factor_codes(spark, sf_dir):
    return factors.codes(read(spark, sf_dir, "part").select("p_partkey", "p_type"), "p_type", "code").select("p_partkey", "code")


@query("SELECT DISTINCT c_mktsegment AS level FROM customer")
def levels(spark, sf_dir):
    return factors.levels(read(spark, sf_dir, "customer"), "c_mktsegment").select("level")


@query(
    """WITH r AS (SELECT min(c_acctbal) AS lo, (max(c_acctbal) - min(c_acctbal)) / 6 AS w FROM customer)
    SELECT least(floor((c_acctbal - lo) / w), 5)::INT AS bin, count(*) AS n FROM customer, r GROUP BY 1"""
)
def cut_equal(spark, sf_dir):
    made = binning.cut_equal(read(spark, sf_dir, "customer"), "c_acctbal", 6, "label")
    counts = made.groupBy("label").agg(F.count("*").alias("n"), F.min("c_acctbal").alias("least"))
    low, high = made.agg(F.min("c_acctbal"), F.max("c_acctbal")).first()
    return counts.select(F.least(F.floor((c("least") - low) / ((high - low) / 6)), F.lit(5)).cast("int").alias("bin"), "n")


@query("SELECT p_partkey, CASE WHEN p_size > 0 AND p_size <= 10 THEN '(0,10]' WHEN p_size > 10 AND p_size <= 30 THEN '(10,30]' WHEN p_size > 30 AND p_size <= 45 THEN '(30,45]' END AS bin FROM part")
def cut_breaks(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", binning.cut_breaks(c("p_size"), [0, 30, 10, 45, 30]).alias("bin"))


@query("SELECT p_partkey, ((p_size >= 5)::INT + (p_size >= 20)::INT + (p_size >= 40)::INT) AS k, CASE WHEN p_size = 40 THEN 2 ELSE (p_size >= 5)::INT + (p_size >= 20)::INT + (p_size >= 40)::INT END AS closed FROM part")
def find_interval(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", binning.find_interval(c("p_size"), [5, 20, 40]).alias("k"), binning.find_interval(c("p_size"), [5, 20, 40], True).alias("closed"))


@query("SELECT (2.5 + 0.5 * i)::DOUBLE AS \"C1\" FROM range(0, 12) t(i)")
def seq_range(spark, sf_dir):
    return sequences.seq(spark, 2.5, 8.0, 0.5)


# -- reshape, order, split, encode, impute ------------------------------------------------------------------------


@query("SELECT l_orderkey, l_linenumber, l_quantity + l_discount + l_tax AS \"C1\" FROM lineitem")
def apply_rows(spark, sf_dir):
    return groups.apply_rows(read(spark, sf_dir, "lineitem"), "sum", ["l_quantity", "l_discount", "l_tax"]).select("l_orderkey", "l_linenumber", "C1")


@query(" UNION ALL ".join(f"SELECT '{x}' AS \"column\", round(avg({x}), 6) AS \"C1\" FROM lineitem" for x in _SUMMED))
def apply_cols(spark, sf_dir):
    return groups.apply_cols(read(spark, sf_dir, "lineitem"), lambda x: F.round(F.avg(x), 6), _SUMMED)


@query("WITH a AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS rn FROM orders), b AS (SELECT o_totalprice, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS rn FROM orders) SELECT o_orderkey, o_totalprice, 1.5::DOUBLE AS \"C3\" FROM a JOIN b USING (rn)")
def cbind_scalar(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    left = o.select("o_orderkey")
    right = o.select("o_totalprice", "o_orderkey")
    return frame.cbind(left, right, 1.5, order=[["o_orderkey"], ["o_totalprice", "o_orderkey"]]).select("o_orderkey", "o_totalprice", "C3")


@query("SELECT s_suppkey AS key, s_acctbal AS bal FROM supplier UNION ALL SELECT c_custkey, c_acctbal FROM customer")
def rbind_union(spark, sf_dir):
    return frame.rbind(read(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal"), read(spark, sf_dir, "customer").select(c("c_custkey").alias("key"), c("c_acctbal").alias("bal")))


@query("SELECT 'n_regionkey' AS \"row.names\", " + ", ".join(f"max(CASE WHEN n_nationkey = {i} THEN n_regionkey END)::DOUBLE AS \"C{i + 1}\"" for i in range(25)) + " FROM nation")
def transpose_small(spark, sf_dir):
    return frame.transpose(read(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey"), ["n_nationkey"])


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def order_topn(spark, sf_dir):
    return groups.order(read(spark, sf_dir, "orders"), "o_totalprice", 25, reverse=True, ties=["o_orderkey"]).select("o_orderkey", "o_totalprice")


@query("SELECT event_id, round(value - 2 * lag(value, 1) OVER w + lag(value, 2) OVER w, 6) AS diff FROM events WINDOW w AS (ORDER BY event_id) QUALIFY row_number() OVER (ORDER BY event_id) > 2")
def diff_lag(spark, sf_dir):
    return frame.diff(read(spark, sf_dir, "events"), "value", ["event_id"], 1, 2).select("event_id", F.round("diff", 6).alias("diff"))


@query("WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS rn, count(*) OVER () AS n FROM orders) SELECT o_orderkey, CASE WHEN rn <= floor(0.6 * n) THEN 0 WHEN rn <= floor(0.8 * n) THEN 1 ELSE 2 END AS split FROM r")
def split_ratio(spark, sf_dir):
    return sampling.split(read(spark, sf_dir, "orders").select("o_orderkey"), [0.6, 0.2], ["o_orderkey"])


@query("WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS rn, count(*) OVER () AS n FROM orders) SELECT o_orderkey, floor((rn - 1) * 5 / n)::INT AS fold FROM r")
def nfold(spark, sf_dir):
    return sampling.nfold(read(spark, sf_dir, "orders").select("o_orderkey"), 5, ["o_orderkey"])


@query("SELECT event_id, ((row_number() OVER (ORDER BY event_id) - 1) % 4)::INT AS fold FROM events")
def modulo_fold(spark, sf_dir):
    return sampling.modulo_fold(read(spark, sf_dir, "events").select("event_id"), 4, ["event_id"])


@query("SELECT (l_returnflag = 'A')::INT AS \"l_returnflag.A\", (l_returnflag = 'N')::INT AS \"l_returnflag.N\", (l_returnflag = 'R')::INT AS \"l_returnflag.R\", l_orderkey FROM lineitem")
def one_hot(spark, sf_dir):
    return encode.one_hot(read(spark, sf_dir, "lineitem").select("l_returnflag", "l_orderkey"), "l_returnflag")


@query(
    """WITH t AS (SELECT p_partkey, p_brand || '_' || p_type AS v FROM part), k AS (SELECT v FROM t GROUP BY v HAVING count(*) >= 2 ORDER BY count(*) DESC, v LIMIT 20)
    SELECT p_partkey, CASE WHEN v IN (FROM k) THEN v ELSE 'other' END AS "p_brand_p_type" FROM t"""
)
def interaction(spark, sf_dir):
    return encode.interaction(read(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type"), ["p_brand", "p_type"], 20, 2).select("p_partkey", "p_brand_p_type")


@query(f"SELECT l_orderkey, l_linenumber, round(coalesce({HOLED_SQL}, (SELECT avg({HOLED_SQL}) FROM lineitem)), 6) AS q FROM lineitem")
def impute_mean(spark, sf_dir):
    return groups.impute(read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", holed().alias("q")), "q").select("l_orderkey", "l_linenumber", F.round("q", 6).alias("q"))


@query(f"SELECT l_orderkey, l_linenumber, l_returnflag, coalesce({HOLED_SQL}, quantile_cont({HOLED_SQL}, 0.5) OVER (PARTITION BY l_returnflag)) AS q FROM lineitem")
def impute_grouped_median(spark, sf_dir):
    return groups.impute(read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", holed().alias("q")), "q", "median", ["l_returnflag"])


@query("SELECT c_custkey, coalesce(CASE WHEN c_acctbal > 0 THEN c_mktsegment END, (SELECT c_mktsegment FROM customer WHERE c_acctbal > 0 GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS seg FROM customer")
def impute_mode(spark, sf_dir):
    return groups.impute(read(spark, sf_dir, "customer").select("c_custkey", F.when(c("c_acctbal") > 0, c("c_mktsegment")).alias("seg")), "seg")


@query("SELECT s_suppkey, round((s_acctbal - (SELECT avg(s_acctbal) FROM supplier)) / (SELECT stddev_samp(s_acctbal) FROM supplier), 8) AS z FROM supplier")
def scale(spark, sf_dir):
    return groups.scale(read(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal"), ["s_acctbal"]).select("s_suppkey", F.round("s_acctbal", 8).alias("z"))


@query("SELECT word, count(*) AS count FROM (SELECT unnest(regexp_split_to_array(text, '\\s+')) AS word FROM conversations) WHERE word <> '' GROUP BY word")
def word_count(spark, sf_dir):
    return groups.word_count(read(spark, sf_dir, "conversations"), "text")


@query("SELECT (SELECT list_sort(list(name)) FROM (VALUES ('n_one')) t(name))[1] AS name")
def ignore_columns(spark, sf_dir):
    found = reduce.ignorable(read(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey", F.lit(1).alias("n_one")))
    return spark.createDataFrame([(x,) for x in found], "name string")


# -- metrics and models -------------------------------------------------------------------------------------------

_SCORED = "SELECT l.doc_id, quality AS y, least(1, n_chars / 5000.0)::DOUBLE AS s FROM labels l JOIN documents d USING (doc_id)"


def _scored(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return read(spark, sf_dir, "labels").join(docs, "doc_id").select("doc_id", c("quality").alias("y"), F.least(F.lit(1.0), c("n_chars") / 5000.0).alias("s"))


@query("WITH p AS (SELECT l_linestatus AS a, CASE WHEN l_quantity > 25 THEN 'F' ELSE 'O' END AS p FROM lineitem), n AS (SELECT a, p, count(*) AS n FROM p GROUP BY ALL) SELECT g.a AS actual, h.a AS predicted, coalesce(n, 0) AS n FROM (SELECT DISTINCT a FROM p) g CROSS JOIN (SELECT DISTINCT a FROM p) h LEFT JOIN n ON n.a = g.a AND n.p = h.a")
def confusion_matrix(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem").select("l_linestatus", F.when(c("l_quantity") > 25, "F").otherwise("O").alias("p"))
    return metrics.confusion_matrix(li, "l_linestatus", "p")


@query("SELECT round(avg(pow(l_quantity - l_extendedprice / 2000, 2)), 6) AS mse FROM lineitem")
def mse(spark, sf_dir):
    return metrics.mse(read(spark, sf_dir, "lineitem").select("l_quantity", (c("l_extendedprice") / 2000).alias("p")), "l_quantity", "p").select(F.round("mse", 6).alias("mse"))


@query(f"WITH d AS ({_SCORED}) SELECT t / 50.0::DOUBLE AS threshold, count(*) FILTER (WHERE s >= t / 50.0::DOUBLE AND y = 1) AS tp, count(*) FILTER (WHERE s >= t / 50.0::DOUBLE AND y = 0) AS fp, count(*) FILTER (WHERE s < t / 50.0::DOUBLE AND y = 0) AS tn, count(*) FILTER (WHERE s < t / 50.0::DOUBLE AND y = 1) AS fn FROM d, range(51) r(t) GROUP BY t")
def auc_thresholds(spark, sf_dir):
    return metrics.auc_table(_scored(spark, sf_dir), "y", "s", metrics.STEPS)


@query(
    f"""WITH d AS ({_SCORED}), r AS (SELECT t, count(*) FILTER (WHERE s >= t / 50.0::DOUBLE AND y = 1) / count(*) FILTER (WHERE y = 1) AS tpr, count(*) FILTER (WHERE s >= t / 50.0::DOUBLE AND y = 0) / count(*) FILTER (WHERE y = 0) AS fpr FROM d, range(51) r(t) GROUP BY t
    UNION ALL VALUES (1000, 0, 0), (-1, 1, 1)), a AS (SELECT (fpr - lag(fpr) OVER w) * (tpr + lag(tpr) OVER w) / 2 AS x FROM r WINDOW w AS (ORDER BY t DESC)) SELECT round(sum(x), 8) AS auc, round(2 * sum(x) - 1, 8) AS gini FROM a"""
)
def auc(spark, sf_dir):
    return metrics.auc(metrics.auc_table(_scored(spark, sf_dir), "y", "s", metrics.STEPS)).select(F.round("auc", 8).alias("auc"), F.round("gini", 8).alias("gini"))


@query(
    f"""WITH d AS ({_SCORED}), q AS (SELECT list(quantile ORDER BY quantile DESC) AS qs FROM (SELECT unnest(quantile_cont(s, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS quantile FROM d)),
    g AS (SELECT coalesce(list_position(list_transform(qs, lambda x: s >= x), true), 10)::INT AS "group", y FROM d, q), k AS (SELECT "group", count(*) AS rows, sum(y)::BIGINT AS positives FROM g GROUP BY 1)
    SELECT "group", rows, positives, round(positives / rows / (sum(positives) OVER () / sum(rows) OVER ()), 6) AS lift FROM k"""
)
def gains_lift(spark, sf_dir):
    return metrics.gains_lift(_scored(spark, sf_dir), "y", "s").select("group", "rows", "positives", F.round("lift", 6).alias("lift"))


@query(
    """WITH d AS (SELECT l_returnflag AS y, l_discount AS "A", l_tax AS "N", 0.045::DOUBLE AS "R" FROM lineitem), r AS (SELECT list_position(list_transform(list_sort([{'s': -"A", 'n': 'A'}, {'s': -"N", 'n': 'N'}, {'s': -"R", 'n': 'R'}]), lambda x: x.n), y) AS place FROM d)
    SELECT k::INT AS k, round(count(*) FILTER (WHERE place <= k) / count(*), 8) AS hit_ratio FROM r, range(1, 4) t(k) GROUP BY k"""
)
def hit_ratio(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem").withColumn("r", F.lit(0.045))
    return metrics.hit_ratio(li, "l_returnflag", {"A": "l_discount", "N": "l_tax", "R": "r"}, 3).select(c("k").cast("int").alias("k"), F.round("hit_ratio", 8).alias("hit_ratio"))


@query("SELECT count(*) AS n, round(regr_intercept(l_extendedprice, l_quantity), 4) AS beta0, round(regr_slope(l_extendedprice, l_quantity), 4) AS beta1, round(regr_r2(l_extendedprice, l_quantity), 8) AS r2 FROM lineitem")
def lr2(spark, sf_dir):
    return models.lr2(read(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice").select("n", F.round("beta0", 4).alias("beta0"), F.round("beta1", 4).alias("beta1"), F.round("r2", 8).alias("r2"))


@query("SELECT l_returnflag AS class, count(*) AS n, round(avg(l_quantity), 6) AS mean_l_quantity, round(stddev_samp(l_quantity), 6) AS sd_l_quantity, round(avg(l_tax), 8) AS mean_l_tax, round(stddev_samp(l_tax), 8) AS sd_l_tax FROM lineitem GROUP BY 1")
def naive_bayes_stats(spark, sf_dir):
    s = models.naive_bayes_stats(read(spark, sf_dir, "lineitem"), "l_returnflag", ["l_quantity", "l_tax"])
    return s.select("class", "n", *(F.round(f"{k}_{x}", d).alias(f"{k}_{x}") for x, d in (("l_quantity", 6), ("l_tax", 8)) for k in ("mean", "sd")))


@query(
    """WITH n AS (SELECT l_returnflag AS y, count(*) AS n, avg(l_quantity) AS mq, stddev_samp(l_quantity) AS sq, avg(l_tax) AS mt, stddev_samp(l_tax) AS st FROM lineitem GROUP BY 1),
    t AS (SELECT l_returnflag AS y, l_linestatus AS v, count(*) AS k FROM lineitem GROUP BY ALL), v AS (SELECT count(DISTINCT l_linestatus) AS levels, count(*) AS rows, count(DISTINCT l_returnflag) AS classes FROM lineitem),
    s AS (SELECT i, l_returnflag, n.y, ln((n + 1) / (rows + classes)) + ln((coalesce(k, 0) + 1) / (n + levels)) - pow((l_quantity - mq) / sq, 2) / 2 - ln(sq * sqrt(2 * pi())) - pow((l_tax - mt) / st, 2) / 2 - ln(st * sqrt(2 * pi())) AS p
    FROM (SELECT *, row_number() OVER () AS i FROM lineitem) CROSS JOIN v CROSS JOIN n LEFT JOIN t ON t.y = n.y AND t.v = l_linestatus)
    SELECT l_returnflag, predict, count(*) AS count FROM (SELECT i, any_value(l_returnflag) AS l_returnflag, arg_max(y, p) AS predict FROM s GROUP BY i) GROUP BY ALL"""
)
def naive_bayes_predict(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem")
    m = models.naive_bayes(li, "l_returnflag", ["l_quantity", "l_tax"], ["l_linestatus"], laplace=1.0)
    return m.predict(li.select("l_orderkey", "l_linenumber", "l_quantity", "l_tax", "l_linestatus", "l_returnflag")).groupBy("l_returnflag", "predict").count()


@query(
    """WITH s AS (SELECT count(*) n, avg(l_quantity) mq, avg(l_tax) mt, avg(l_extendedprice) my, covar_pop(l_quantity, l_quantity) qq, covar_pop(l_tax, l_tax) tt, covar_pop(l_quantity, l_tax) qt, covar_pop(l_extendedprice, l_quantity) yq, covar_pop(l_extendedprice, l_tax) yt FROM lineitem),
    b AS (SELECT (yq * tt - yt * qt) / (qq * tt - qt * qt) AS b1, (yt * qq - yq * qt) / (qq * tt - qt * qt) AS b2, * FROM s)
    SELECT 'Intercept' AS name, round(my - b1 * mq - b2 * mt, 2) AS beta FROM b UNION ALL SELECT 'l_quantity', round(b1, 2) FROM b UNION ALL SELECT 'l_tax', round(b2, 2) FROM b"""
)
def glm_gaussian(spark, sf_dir):
    m = models.glm(read(spark, sf_dir, "lineitem"), "l_extendedprice", ["l_quantity", "l_tax"])
    return spark.createDataFrame([(n, round(float(b), 2)) for n, b in zip(["Intercept", *m.names], m.beta, strict=True)], "name string, beta double")


@query()
def glm_binomial(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem").select(((c("l_returnflag") == "R").cast("double")).alias("y"), "l_quantity", "l_tax")
    m = models.glm(li, "y", ["l_quantity", "l_tax"], "binomial")
    return spark.createDataFrame([(n, float(b)) for n, b in zip(["Intercept", *m.names], m.beta, strict=True)], "name string, beta double")


@query()
def kmeans(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem")
    return models.kmeans(li, ["l_quantity", "l_extendedprice", "l_discount"], 4).predict(li).groupBy("cluster").count()


@query()
def pca(spark, sf_dir):
    m = models.pca(read(spark, sf_dir, "lineitem"), _SUMMED)
    return spark.createDataFrame([(i, float(s)) for i, s in enumerate(m.sdev)], "pc int, sdev double")


@query()
def gbm(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select((c("o_orderstatus") == "F").cast("double").alias("y"), "o_totalprice", c("o_custkey").cast("double").alias("k"))
    m, _ = models.tree_model(o, "y", ["o_totalprice", "k"], "gbm", ntrees=3, depth=3)
    return models.predict(m, o, ["o_totalprice", "k"], ["other", "F"]).groupBy("predict").count()


@query()
def random_forest(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select((c("o_orderstatus") == "F").cast("double").alias("y"), "o_totalprice", c("o_custkey").cast("double").alias("k"))
    m, _ = models.tree_model(o, "y", ["o_totalprice", "k"], "drf", ntrees=5, depth=4)
    return models.predict(m, o, ["o_totalprice", "k"], ["other", "F"]).groupBy("predict").count()


@query()
def coxph(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select((F.pmod("o_orderkey", F.lit(97)) + 1).cast("int").alias("t"), (c("o_orderstatus") == "F").cast("int").alias("e"), (c("o_totalprice") / 100000).alias("x"))
    m = models.coxph(o, "t", "e", ["x"])
    return spark.createDataFrame([("x", float(m["coef"]["x"]), float(m["se"]["x"]))], "name string, coef double, se double")


# -- random frames, expressions -----------------------------------------------------------------------------------


@query()
def create_frame(spark, sf_dir):
    return make_frame(spark, 1000, 8, seed=7, response=2)


@query()
def sample_n(spark, sf_dir):
    return sampling.sample(read(spark, sf_dir, "orders"), 500, ["o_orderkey"], seed=3)


@query()
def stratified_sample(spark, sf_dir):
    return sampling.balanced(read(spark, sf_dir, "labels"), "quality", ["doc_id"]).groupBy("quality").count()


@query()
def insert_missing(spark, sf_dir):
    made = sampling.insert_missing(read(spark, sf_dir, "orders"), 0.1, ["o_orderkey"], ["o_totalprice", "o_orderstatus"])
    return made.agg(F.count_if(c("o_totalprice").isNull()).alias("a"), F.count_if(c("o_orderstatus").isNull()).alias("b"))


def _workspace(spark, sf_dir) -> Workspace:
    w = Workspace()
    for name in ("orders", "nation", "events", "customer", "supplier"):
        w.put(name, read(spark, sf_dir, name))
    return w


@query("SELECT o_orderstatus, round(avg(o_totalprice), 4) AS \"C1\", round(max(o_totalprice) - min(o_totalprice), 4) AS \"C2\", count(*) AS \"C3\" FROM orders WHERE o_totalprice > 50000 GROUP BY 1")
def lang_ddply(spark, sf_dir):
    w, x = _workspace(spark, sf_dir), c("o_totalprice")
    w.put("big", frame.filter_rows(w.frames["orders"], x > 50000))
    return w.call("ddply", "big", ["o_orderstatus"], {"C1": F.round(F.avg(x), 4), "C2": F.round(F.max(x) - F.min(x), 4), "C3": F.count("*")})


@query("SELECT event_id::DOUBLE AS event_id, round(CASE WHEN value > 50 THEN value * 2 ELSE value ^ 2 / 7 END, 6) AS value FROM events")
def lang_closure(spark, sf_dir):
    w = _workspace(spark, sf_dir)
    w.add_function("f", lambda v, k: A.if_else((v > 50).cast("int"), v * k, A.power(v, F.lit(2)) / 7))
    return w.frames["events"].select((c("event_id") * 1.0).alias("event_id"), F.round(w.call("f", c("value"), 2), 6).alias("value"))


@query("SELECT round(sum(o_totalprice) / count(*), 4) AS a, round(quantile_cont(o_totalprice, 0.5), 4) AS b, round(stddev_samp(o_totalprice), 4) AS s FROM orders")
def lang_scalars(spark, sf_dir):
    w = _workspace(spark, sf_dir)
    orders = w.frames["orders"]
    mid = w.call("quantile", orders, "o_totalprice", [0.5])[0]
    return orders.agg(F.round(F.sum("o_totalprice") / F.count("*"), 4).alias("a"), F.round(F.lit(mid), 4).alias("b"), F.round(reduce.sd(c("o_totalprice")), 4).alias("s"))


@query("SELECT row_number() OVER (ORDER BY n_nationkey) AS r, n_name FROM nation QUALIFY r BETWEEN 3 AND 7")
def lang_slice(spark, sf_dir):
    out = frame.columns(frame.row_range(_workspace(spark, sf_dir).frames["nation"], ["n_nationkey"], 3, 7), [1, 2])
    return out.select((c("n_nationkey") + 1).cast("long").alias("r"), "n_name")


@query("SELECT event_id, round(value - lag(value, 3) OVER (ORDER BY event_id), 6) AS diff FROM events QUALIFY row_number() OVER (ORDER BY event_id) > 3")
def lang_diff(spark, sf_dir):
    return _workspace(spark, sf_dir).call("diff", "events", "value", ["event_id"], 3).select("event_id", F.round("diff", 6).alias("diff"))


@query("SELECT c_custkey, string_split(c_name, '#')[1] AS \"C1\", string_split(c_name, '#')[2] AS \"C2\" FROM customer")
def lang_strsplit(spark, sf_dir):
    return _workspace(spark, sf_dir).call("strsplit", "customer", "c_name", "#", 2).select("c_custkey", "C1", "C2")


@query("SELECT 's_acctbal' AS i, 's_acctbal' AS j, round(sum(s_acctbal * s_acctbal), 2) AS value FROM supplier")
def lang_crossprod(spark, sf_dir):
    return _workspace(spark, sf_dir).call("crossprod", "supplier", ["s_acctbal"]).select("i", "j", F.round("value", 2).alias("value"))


@query("SELECT row_number() OVER (ORDER BY n_nationkey) AS place FROM nation QUALIFY n_regionkey = 2")
def lang_which(spark, sf_dir):
    return _workspace(spark, sf_dir).call("which", "nation", c("n_regionkey") == 2, ["n_nationkey"])


@query("SELECT unnest(['nation', 'orders']) AS frame, unnest([true, false]) AS logical")
def workspace_names(spark, sf_dir):
    """Frames with a model's columns, and which columns could be logical."""
    w = _workspace(spark, sf_dir)
    w.rm("events", "customer", "supplier", "never")
    if w.compatible(["n_name"]) != ["nation"] or w.compatible(["o_orderkey"]) != ["orders"] or w.ls() != ["nation", "orders"]:
        raise ValueError("compatible frames")
    small = can_be_coerced_to_logical(w.frames["nation"].select((c("n_regionkey") > 2).cast("int").alias("x")), "x")
    return spark.createDataFrame([("nation", small), ("orders", can_be_coerced_to_logical(w.frames["orders"], "o_orderstatus"))], "frame string, logical boolean")


# -- summaries and measures ---------------------------------------------------------------------------------------


@query("SELECT p_type AS level, count(*) AS count, count(*) / (SELECT count(*) FROM part) AS share FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 4")
def summary_factor(spark, sf_dir):
    return reduce.summary_factor(read(spark, sf_dir, "part"), "p_type", 4)


@query(f"SELECT l_returnflag, count(*) AS rows, count(*) - count(q) AS na, count(*) FILTER (WHERE q = 0) AS zeros, min(q) AS min, max(q) AS max, round(avg(q), 6) AS mean, round(stddev_samp(q), 6) AS sd FROM (SELECT l_returnflag, {HOLED_SQL} AS q FROM lineitem) GROUP BY 1")
def summary_grouped(spark, sf_dir):
    made = reduce.summary_grouped(read(spark, sf_dir, "lineitem").select("l_returnflag", holed().alias("q")), ["l_returnflag"], "q")
    return made.withColumn("mean", F.round("mean", 6)).withColumn("sd", F.round("sd", 6))


@query("SELECT l_returnflag, l_linestatus, round(quantile_cont(l_extendedprice, 0.9), 4) AS q FROM lineitem GROUP BY ALL")
def quantile_grouped(spark, sf_dir):
    return reduce.grouped_quantile(read(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice", 0.9, "q").withColumn("q", F.round("q", 4))


@query("SELECT event_id, row_number() OVER (ORDER BY event_id) <= 4 AS first FROM events QUALIFY row_number() OVER (ORDER BY event_id) <= 4 OR row_number() OVER (ORDER BY event_id DESC) <= 3")
def head_tail(spark, sf_dir):
    events = read(spark, sf_dir, "events").select("event_id")
    return frame.head(events, ["event_id"], 4).withColumn("first", F.lit(True)).union(frame.tail(events, ["event_id"], 3).withColumn("first", F.lit(False)))


@query("SELECT l_orderkey, l_linenumber, l_quantity * l_tax AS \"C1\", greatest(l_quantity, l_discount) AS \"C2\" FROM lineitem")
def each_row(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem")
    return groups.each_row(li, lambda q, t, d: [q * t, F.greatest(q, d)], ["l_quantity", "l_tax", "l_discount"]).select("l_orderkey", "l_linenumber", "C1", "C2")


@query(
    """WITH p AS (SELECT l_returnflag AS a, CASE WHEN l_quantity > 40 THEN 'A' WHEN l_quantity > 15 THEN 'N' ELSE 'R' END AS p FROM lineitem), k AS (SELECT unnest(['A', 'N', 'R']) AS class),
    m AS (SELECT class, count(*) FILTER (WHERE a = class) AS rows, count(*) FILTER (WHERE p = class) AS said, count(*) FILTER (WHERE a = class AND p = class) AS hits FROM p, k GROUP BY class)
    SELECT class, rows, round(1 - hits / rows, 8) AS error, round(hits / rows, 8) AS recall, round(hits / said, 8) AS precision, round(2 * hits / (rows + said), 8) AS f1 FROM m"""
)
def class_measures(spark, sf_dir):
    q = c("l_quantity")
    li = read(spark, sf_dir, "lineitem").select("l_returnflag", F.when(q > 40, "A").when(q > 15, "N").otherwise("R").alias("p"))
    made = metrics.class_measures(metrics.confusion_matrix(li, "l_returnflag", "p"))
    return made.select("class", c("rows").cast("long").alias("rows"), *(F.round(x, 8).alias(x) for x in ("error", "recall", "precision", "f1")))


@query("SELECT unnest([0, 1])::INT AS pc, unnest([round(sqrt(1 + abs(corr(l_quantity, l_extendedprice))), 6), round(sqrt(1 - abs(corr(l_quantity, l_extendedprice))), 6)]) AS sdev FROM lineitem")
def pca_pair(spark, sf_dir):
    m = models.pca(read(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice"])
    return spark.createDataFrame([(i, round(float(s), 6)) for i, s in enumerate(m.sdev)], "pc int, sdev double")


@query("SELECT 'glm' AS model, true AS same UNION ALL SELECT 'gbm', true")
def model_export(spark, sf_dir):
    """Saved models and exported SQL give what the models give."""
    li = read(spark, sf_dir, "lineitem")
    m = models.glm(li, "l_extendedprice", ["l_quantity", "l_tax"], standardize=True)
    again = models.load_model(models.save_model(m))
    far = again.predict(li).agg(F.max(F.abs(c("predict") - F.expr(models.export_sql(m))))).first()[0]
    trees, _ = models.tree_model(li, "l_extendedprice", ["l_quantity", "l_tax"], "gbm", False, ntrees=3, depth=3)
    off = models.predict(trees, li, ["l_quantity", "l_tax"]).agg(F.max(F.abs(c("predict") - F.expr(models.export_sql(trees, ["l_quantity", "l_tax"]))))).first()[0]
    return spark.createDataFrame([("glm", far < 1e-6), ("gbm", off < 1e-6)], "model string, same boolean")


@query()
def multinomial_gbm(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem").select("l_returnflag", "l_quantity", "l_discount")
    return models.multinomial_boosting(li, "l_returnflag", ["l_quantity", "l_discount"], ntrees=2, depth=2).predict(li).groupBy("l_returnflag", "predict").count()


@query()
def forest_oob(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select("o_orderkey", (c("o_orderstatus") == "F").cast("double").alias("y"), "o_totalprice", c("o_custkey").cast("double").alias("k"))
    _, voted = models.forest_out_of_bag(o, "y", ["o_totalprice", "k"], ["o_orderkey"], ntrees=5, depth=4)
    return voted.groupBy("y", "oob").count()


# -- extensions: not part of the R-like surface, native here --------------------------------------------------------


@query("SELECT n_name, count(*) AS n, round(sum(c_acctbal), 2) AS bal FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def ext_join(spark, sf_dir):
    return read(spark, sf_dir, "customer").join(read(spark, sf_dir, "nation"), c("c_nationkey") == c("n_nationkey")).groupBy("n_name").agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("bal"))


@query("SELECT coalesce(o_orderstatus, 'all') AS status, coalesce(o_orderpriority, 'all') AS priority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def ext_rollup(spark, sf_dir):
    return read(spark, sf_dir, "orders").rollup("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n")).select(F.coalesce("o_orderstatus", F.lit("all")).alias("status"), F.coalesce("o_orderpriority", F.lit("all")).alias("priority"), "n")


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def ext_stream_windows(spark, sf_dir):
    from ..streaming.windows import windowed_once

    return windowed_once(spark, f"{sf_dir}/events.parquet").select(c("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))
