"""Queries over statistics, time series, windows and scalar functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillstone.functions import scalars as X
from quillstone.operators import stats as S
from quillstone.operators import timeseries as T
from quillstone.operators.overlap import ranked
from quillstone.plans.registry import register
from quillstone.storage import read_table


def _t(name):
    return lambda spark, sf_dir: read_table(spark, sf_dir, name)


line, orders, part, docs, labels, events, customer, nation = (_t(n) for n in ("lineitem", "orders", "part", "documents", "labels", "events", "customer", "nation"))


@register("stat_01_pearson", "SELECT round(corr(l_quantity, l_extendedprice), 6) AS r, count(*) AS n FROM lineitem")
def pearson(spark, sf_dir):
    r, _, n = S.correlation(line(spark, sf_dir), "l_quantity", "l_extendedprice")
    return spark.createDataFrame([(round(r, 6), n)], "r double, n long")


@register("stat_03_correlation_matrix", "SELECT 'l_quantity' AS a, 'l_extendedprice' AS b, round(corr(l_quantity, l_extendedprice), 6) AS r, count(*) AS n FROM lineitem UNION ALL SELECT 'l_quantity', 'l_discount', round(corr(l_quantity, l_discount), 6), count(*) FROM lineitem UNION ALL SELECT 'l_extendedprice', 'l_discount', round(corr(l_extendedprice, l_discount), 6), count(*) FROM lineitem")
def matrix(spark, sf_dir):
    return S.correlations(line(spark, sf_dir), ["l_quantity", "l_extendedprice", "l_discount"])


_PARTIAL = "SELECT corr(l_extendedprice, l_quantity) AS ab, corr(l_extendedprice, l_linenumber) AS ac, corr(l_quantity, l_linenumber) AS bc FROM lineitem"


@register("stat_04_partial_correlation", f"WITH t AS ({_PARTIAL}), p AS (SELECT ab, (ab - ac * bc) / sqrt((1 - ac * ac) * (1 - bc * bc)) AS p FROM t) SELECT round(ab, 6) AS r, round(p, 6) AS partial, round(1 - abs(p) / abs(ab), 6) AS reduction, 1 - abs(p) / abs(ab) > 0.4 AS confounded FROM p")
def partial(spark, sf_dir):
    return S.partial_correlation(line(spark, sf_dir), "l_extendedprice", "l_quantity", "l_linenumber")


_LABEL = "CASE WHEN abs(d) < 0.2 THEN 'negligible' WHEN abs(d) < 0.5 THEN 'small' WHEN abs(d) < 0.8 THEN 'medium' ELSE 'large' END"


@register("stat_05_quartile_experiment", f"WITH q AS (SELECT quantile_cont(l_quantity, 0.25) AS q1, quantile_cont(l_quantity, 0.75) AS q3 FROM lineitem), g AS (SELECT count(*) FILTER (l_quantity >= q3) AS n_hi, count(*) FILTER (l_quantity <= q1) AS n_lo, avg(l_extendedprice) FILTER (l_quantity >= q3) AS m1, avg(l_extendedprice) FILTER (l_quantity <= q1) AS m0, var_samp(l_extendedprice) FILTER (l_quantity >= q3) AS v1, var_samp(l_extendedprice) FILTER (l_quantity <= q1) AS v0 FROM lineitem, q), e AS (SELECT *, (m1 - m0) / sqrt(((n_hi - 1) * v1 + (n_lo - 1) * v0) / (n_hi + n_lo - 2)) AS d FROM g) SELECT n_hi, n_lo, round(m1, 4) AS m_hi, round(m0, 4) AS m_lo, round(100 * (m1 - m0) / abs(m0), 4) AS effect, round(d, 6) AS d, {_LABEL} AS size FROM e")
def quartile(spark, sf_dir):
    return S.quartile_experiment(line(spark, sf_dir), "l_quantity", "l_extendedprice")


@register("stat_06_threshold_experiment", "WITH s AS (SELECT list_sort(list_distinct([round(quantile_cont(l_quantity, 0.25), 2), round(quantile_cont(l_quantity, 0.5), 2), round(quantile_cont(l_quantity, 0.75), 2), round(avg(l_quantity), 2), round(avg(l_quantity) + stddev_samp(l_quantity), 2)]))[1:3] AS cuts FROM lineitem), c AS (SELECT unnest(cuts) AS threshold FROM s) SELECT threshold, count(*) FILTER (l_quantity > threshold) AS n_above, count(*) FILTER (l_quantity <= threshold) AS n_below, round(avg(l_extendedprice) FILTER (l_quantity > threshold), 4) AS m_above, round(avg(l_extendedprice) FILTER (l_quantity <= threshold), 4) AS m_below FROM lineitem, c GROUP BY threshold")
def thresholds(spark, sf_dir):
    return S.threshold_experiments(line(spark, sf_dir), "l_quantity", "l_extendedprice")


@register("stat_07_bootstrap_correlation")
def bootstrap(spark, sf_dir):
    return S.poisson_bootstrap(part(spark, sf_dir), "p_size", "p_retailprice", "p_partkey", 100)


@register("smp_04_bootstrap_means")
def bootstrap_means(spark, sf_dir):
    return S.bootstrap_means(orders(spark, sf_dir), "o_orderstatus", "o_totalprice")


@register("stat_10_welch", "WITH g AS (SELECT count(*) FILTER (o_orderstatus = 'F') AS n_a, count(*) FILTER (o_orderstatus = 'O') AS n_b, avg(o_totalprice) FILTER (o_orderstatus = 'F') AS m_a, avg(o_totalprice) FILTER (o_orderstatus = 'O') AS m_b, var_samp(o_totalprice) FILTER (o_orderstatus = 'F') AS v_a, var_samp(o_totalprice) FILTER (o_orderstatus = 'O') AS v_b FROM orders) SELECT n_a, n_b, round(m_a, 6) AS m_a, round(m_b, 6) AS m_b, round(m_a - m_b, 6) AS difference, round((m_a - m_b) / sqrt(v_a / n_a + v_b / n_b), 6) AS t FROM g")
def welch(spark, sf_dir):
    return S.welch(orders(spark, sf_dir), "o_orderstatus", "F", "O", "o_totalprice").drop("dof", "p")


_ARM = "(l_discount > 0.05)::INT"


@register("stat_11_stratified_effect", f"WITH g AS (SELECT l_returnflag, count(*) AS n, sum(l_extendedprice) FILTER ({_ARM} = 1) AS s1, sum(l_extendedprice) FILTER ({_ARM} = 0) AS s0, count(*) FILTER ({_ARM} = 1) AS n1, count(*) FILTER ({_ARM} = 0) AS n0 FROM lineitem GROUP BY 1) SELECT round(sum(s1) / sum(n1) - sum(s0) / sum(n0), 6) AS naive, round(sum(n * (s1 / n1 - s0 / n0)) / sum(n), 6) AS ate, count(*) AS strata FROM g")
def stratified(spark, sf_dir):
    return S.stratified_effect(line(spark, sf_dir), F.col("l_discount") > 0.05, "l_extendedprice", ["l_returnflag"])


@register("stat_13_treatment_effects")
def effects(spark, sf_dir):
    return S.treatment_effects(line(spark, sf_dir), F.col("l_discount") > 0.05, "l_extendedprice", [F.col("l_quantity"), F.col("l_tax")])


@register("stat_14_conditional_effects", "WITH m AS (SELECT regr_slope(l_extendedprice, l_quantity) FILTER (l_discount > 0.05) - regr_slope(l_extendedprice, l_quantity) FILTER (l_discount <= 0.05) AS s, regr_intercept(l_extendedprice, l_quantity) FILTER (l_discount > 0.05) - regr_intercept(l_extendedprice, l_quantity) FILTER (l_discount <= 0.05) AS i FROM lineitem) SELECT l_returnflag, round(avg(i + s * l_quantity), 4) AS effect FROM lineitem, m GROUP BY 1")
def cate(spark, sf_dir):
    rows = line(spark, sf_dir)
    effect = S.conditional_effects(rows, F.col("l_discount") > 0.05, "l_extendedprice", [F.col("l_quantity")])
    return rows.groupBy("l_returnflag").agg(F.round(F.avg(effect), 4).alias("effect"))


@register("stat_15_counterfactual")
def counterfactual(spark, sf_dir):
    rows = line(spark, sf_dir)
    features = [F.col("l_quantity"), (F.col("l_discount") > 0.05).cast("int")]
    beta = S.least_squares(rows, features, F.col("l_extendedprice"))[0]
    flipped = S.linear(beta, [features[0], 1 - features[1]]) - S.linear(beta, features)
    return rows.groupBy("l_returnflag").agg(F.round(F.avg(flipped), 4).alias("flipped"))


@register("stat_16_granger")
def granger(spark, sf_dir):
    daily = events(spark, sf_dir).groupBy(F.to_date("ts").alias("d"), F.hour("ts").alias("h")).agg(F.count("*").alias("n"), F.sum("value").alias("v")).withColumn("k", F.datediff("d", F.lit("1970-01-01")) * 24 + F.col("h"))
    return S.granger(daily, "k", "n", "v")


@register("stat_17_causal_skeleton", "SELECT unnest(['l_extendedprice', 'l_discount']) AS a, 'net' AS b")
def skeleton(spark, sf_dir):
    """Prices and discounts are drawn apart and make the net price; taxes have no part in it."""
    rows = line(spark, sf_dir).withColumn("net", F.col("l_extendedprice") * (1 - F.col("l_discount")))
    return spark.createDataFrame(S.causal_skeleton(rows, ["l_extendedprice", "l_discount", "l_tax", "net"]), "a string, b string")


@register("stat_19_kolmogorov_smirnov", "WITH a AS (SELECT o_totalprice AS v, count(*) AS p FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), b AS (SELECT o_totalprice AS v, count(*) AS q FROM orders WHERE o_orderstatus = 'O' GROUP BY 1), u AS (SELECT v, coalesce(p, 0) AS p, coalesce(q, 0) AS q FROM a FULL JOIN b USING (v)) SELECT round(max(abs(cp / np - cq / nq)), 6) AS ks FROM (SELECT sum(p) OVER (ORDER BY v) AS cp, sum(q) OVER (ORDER BY v) AS cq, sum(p) OVER () AS np, sum(q) OVER () AS nq FROM u)")
def ks(spark, sf_dir):
    o = orders(spark, sf_dir)
    return S.kolmogorov_smirnov(o.where("o_orderstatus = 'F'"), o.where("o_orderstatus = 'O'"), "o_totalprice")


@register("stat_19_levene", "WITH z AS (SELECT o_orderstatus AS g, abs(o_totalprice - avg(o_totalprice) OVER (PARTITION BY o_orderstatus)) AS z FROM orders), s AS (SELECT g, count(*) AS n, avg(z) AS m, sum(z * z) AS q FROM z GROUP BY 1) SELECT round((sum(n) - count(*)) / (count(*) - 1) * (sum(n * m * m) - sum(n * m) ** 2 / sum(n)) / (sum(q) - sum(n * m * m)), 6) AS w FROM s")
def levene(spark, sf_dir):
    return S.levene(orders(spark, sf_dir), "o_orderstatus", "o_totalprice")


@register("stat_20_what_if", "WITH t AS (SELECT o_totalprice AS b, CASE WHEN o_orderstatus = 'O' THEN o_totalprice * 1.2 ELSE o_totalprice END AS a FROM orders) SELECT round(avg(b), 4) AS mean_before, round(avg(a), 4) AS mean_after, round(stddev_samp(a), 4) AS sd_after, round(100 * (avg(a) - avg(b)) / abs(avg(b)), 4) AS change, CASE WHEN 100 * (avg(a) - avg(b)) / abs(avg(b)) > 5 THEN 'up' WHEN 100 * (avg(a) - avg(b)) / abs(avg(b)) < -5 THEN 'down' ELSE 'stable' END AS class FROM t")
def what_if(spark, sf_dir):
    return S.what_if(orders(spark, sf_dir), "o_totalprice", "percentage", 20, F.col("o_orderstatus") == "O")


@register("stat_20_what_if_simulated")
def simulated(spark, sf_dir):
    return S.what_if(customer(spark, sf_dir), "c_acctbal", "add", 500, runs=20, key="c_custkey")


@register("stat_22_scenarios", "SELECT 'raise' AS scenario, 10.0::DOUBLE AS change, 0.1::DOUBLE AS risk UNION ALL SELECT 'cut', -25.0, 0.25")
def scenario(spark, sf_dir):
    return S.scenarios(orders(spark, sf_dir), "o_totalprice", {"raise": ("percentage", 10), "cut": ("multiply", 0.75)})


_FLOW = "(SELECT unnest([0, 1, 2, 3, 4]) AS month, unnest([-1000.0, 200.0, 300.0, 400.0, 500.0]::DOUBLE[]) AS flow)"


@register("stat_23_cash_flow", f"SELECT month::INTEGER AS month, flow, round(sum(flow) OVER (ORDER BY month), 4) AS cumulative, round(sum(flow / (1 + 0.1 / 12) ** month) OVER (ORDER BY month), 4) AS npv FROM {_FLOW}")
def cash(spark, sf_dir):
    return S.cash_flow(spark, 1000, [100] * 4, [300, 400, 500, 600])


@register("stat_23_internal_rate")
def irr(spark, sf_dir):
    return spark.createDataFrame([(round(S.internal_rate([-1000, 200, 300, 400, 500]), 8),)], "rate double")


@register("stat_24_tornado", "SELECT 'price' AS variable, 300.0::DOUBLE AS low, 700.0::DOUBLE AS high UNION ALL SELECT 'cost', 600.0, 400.0")
def tornado(spark, sf_dir):
    found = S.tornado(500, {"price": 10.0, "cost": 5.0}, lambda v: 100 * (v["price"] - v["cost"]))
    return spark.createDataFrame(found, "variable string, low double, high double")


# Time series: events a day.


def _daily(spark, sf_dir):
    days = events(spark, sf_dir).groupBy(F.date_trunc("hour", "ts").alias("d")).agg(F.sum("value").alias("v"))
    return T.indexed(days, "d", "v")


_DAYS = "WITH y AS (SELECT date_trunc('hour', ts) AS d, sum(value) AS value FROM events GROUP BY 1), r AS (SELECT value, row_number() OVER (ORDER BY d) - 1 AS i FROM y WHERE value IS NOT NULL) "


@register("ts_01_trend", _DAYS + "SELECT 'all' AS series, count(*) AS n, round(regr_slope(value, i), 6) AS slope, round(regr_r2(value, i), 6) AS r2, CASE WHEN count(*) < 10 THEN 'stable' WHEN regr_slope(value, i) / abs(avg(value)) > 0.01 THEN 'up' WHEN regr_slope(value, i) / abs(avg(value)) < -0.01 THEN 'down' ELSE 'stable' END AS direction FROM r")
def trend(spark, sf_dir):
    return T.trend(_daily(spark, sf_dir))


@register("ts_02_change_points", _DAYS + ", w AS (SELECT i, avg(value) OVER b AS b, avg(value) OVER a AS a, count(value) OVER b AS nb, count(value) OVER a AS na FROM r WINDOW b AS (ORDER BY i ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), a AS (ORDER BY i ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING)), h AS (SELECT *, lag(i) OVER (ORDER BY i) AS p FROM w WHERE nb = 10 AND na = 10 AND b <> 0 AND abs(a - b) > 0.3 * abs(b)) SELECT 'all' AS series, i, round(b, 4) AS before, round(a, 4) AS after FROM h WHERE p IS NULL OR i - p > 1")
def changes(spark, sf_dir):
    return T.change_points(_daily(spark, sf_dir))


_ACF = ", s AS (SELECT avg(value) AS m, var_pop(value) AS v, count(*) AS n FROM r), c AS (SELECT lag, sum((a.value - m) * (b.value - m)) / any_value(n * v) AS x FROM (SELECT unnest([1, 2, 7, 24]) AS lag), s, r a JOIN r b ON a.i = b.i + lag GROUP BY lag) "


@register("ts_03_autocorrelation", _DAYS + _ACF + "SELECT 'all' AS series, lag::INTEGER AS lag, round(x, 6) AS r FROM c")
def acf(spark, sf_dir):
    return T.autocorrelation(_daily(spark, sf_dir), [1, 2, 7, 24])


@register("ts_03_seasonality", _DAYS + _ACF.replace("[1, 2, 7, 24]", "range(1, 31)") + ", p AS (SELECT lag AS k, round(x, 6) AS r, lag(round(x, 6)) OVER (ORDER BY c.lag) AS before, lead(round(x, 6)) OVER (ORDER BY c.lag) AS after FROM c) SELECT 'all' AS series, k::INTEGER AS period, r FROM p WHERE k >= 2 AND r > before AND r >= after AND r > 0.01 ORDER BY r DESC, k LIMIT 1")
def seasonality(spark, sf_dir):
    return T.seasonality(_daily(spark, sf_dir), 30, 0.01)


@register("ts_04_periodic_strength", _DAYS + ", g AS (SELECT count(*) AS n, avg(value) AS m, sum(value * value) AS q FROM r GROUP BY i % 7) SELECT 'all' AS series, round((sum(n * m * m) - sum(n * m) ** 2 / sum(n)) / (sum(q) - sum(n * m) ** 2 / sum(n)), 6) AS strength FROM g")
def strength(spark, sf_dir):
    return T.periodic_strength(_daily(spark, sf_dir), 7)


@register("ts_05_decompose", _DAYS + ", t AS (SELECT i, value, CASE WHEN count(value) OVER w = 7 THEN avg(value) OVER w END AS trend FROM r WINDOW w AS (ORDER BY i ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)), s AS (SELECT i % 7 AS phase, avg(value - trend) AS season FROM t WHERE trend IS NOT NULL GROUP BY 1) SELECT 'all' AS series, i, round(trend, 4) AS trend, round(season, 4) AS season, round(value - trend - season, 4) AS rest FROM t JOIN s ON i % 7 = phase")
def decompose(spark, sf_dir):
    return T.decompose(_daily(spark, sf_dir))


@register("ts_10_moving_forecast", _DAYS + ", g AS (SELECT regr_slope(value, i) AS slope, stddev_pop(value) AS sd FROM r), b AS (SELECT avg(value) AS base FROM (SELECT value FROM r ORDER BY i DESC LIMIT 7)) SELECT 'all' AS series, step::INTEGER AS step, round(base + slope * step, 4) AS forecast, round(base + slope * step - 1.96 * sd, 4) AS low, round(base + slope * step + 1.96 * sd, 4) AS high FROM g, b, (SELECT unnest(range(5)) AS step)")
def moving(spark, sf_dir):
    return T.moving_forecast(_daily(spark, sf_dir), 5)


def _types(spark, sf_dir):
    days = events(spark, sf_dir).groupBy("event_type", F.date_trunc("hour", "ts").alias("d")).agg(F.sum("value").alias("v"))
    return T.indexed(days, "d", "v", "event_type")


@register("ts_14_multi_series")
def multi(spark, sf_dir):
    return T.forecast(_types(spark, sf_dir), 6)


@register("ts_15_holt_winters")
def winters(spark, sf_dir):
    return T.forecast(_types(spark, sf_dir), 6, "holt_winters")


@register("ts_16_autoregressive")
def autoregressive(spark, sf_dir):
    return T.forecast(_types(spark, sf_dir), 6, "autoregressive")


@register("ts_12_metrics")
def metrics(spark, sf_dir):
    return T.holdout_metrics(_types(spark, sf_dir), 6)


@register("ts_13_bootstrap_interval")
def interval(spark, sf_dir):
    return T.bootstrap_interval(_types(spark, sf_dir), 6)


# Windows, sorts and sets.


@register("win_01_top_per_group", "SELECT o_orderpriority, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) <= 3")
def top(spark, sf_dir):
    w = Window.partitionBy("o_orderpriority").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return orders(spark, sf_dir).withColumn("r", F.row_number().over(w)).where("r <= 3").select("o_orderpriority", "o_orderkey", "o_totalprice")


@register("win_02_first_occurrence", "SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) = 1 AS first FROM lineitem")
def first(spark, sf_dir):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")
    return line(spark, sf_dir).select("l_orderkey", "l_linenumber", (F.row_number().over(w) == 1).alias("first"))


_LAST = "(PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW)"


def _last():
    return Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-99, 0)


@register("win_03_rolling_z", f"SELECT event_id, round(abs(value - avg(value) OVER w) / stddev_pop(value) OVER w, 4) AS z FROM events WHERE value IS NOT NULL WINDOW w AS {_LAST} QUALIFY count(value) OVER w >= 10 AND stddev_pop(value) OVER w > 0")
def rolling(spark, sf_dir):
    w = _last()
    rows = events(spark, sf_dir).where("value is not null").select("event_id", F.count("value").over(w).alias("n"), F.stddev_pop("value").over(w).alias("s"), F.abs(F.col("value") - F.avg("value").over(w)).alias("d"))
    return rows.where("n >= 10 and s > 0").select("event_id", F.round(F.col("d") / F.col("s"), 4).alias("z"))


@register("win_04_rolling_trigger", f"SELECT event_id FROM events WHERE value IS NOT NULL WINDOW w AS {_LAST} QUALIFY count(value) OVER w >= 10 AND abs(value - avg(value) OVER w) > 2 * stddev_samp(value) OVER w")
def trigger(spark, sf_dir):
    w = _last()
    rows = events(spark, sf_dir).where("value is not null").select("event_id", F.count("value").over(w).alias("n"), F.stddev_samp("value").over(w).alias("s"), F.abs(F.col("value") - F.avg("value").over(w)).alias("d"))
    return rows.where("n >= 10 and d > 2 * s").select("event_id")


@register("win_05_sequence", "SELECT event_id FROM events QUALIFY lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) = 'view' AND event_type = 'click'")
def sequence(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-1, 0)
    return events(spark, sf_dir).withColumn("s", F.collect_list("event_type").over(w)).where(F.col("s") == F.array(F.lit("view"), F.lit("click"))).select("event_id")


@register("win_07_running_total", "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), 2) AS total FROM orders")
def running(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(Window.unboundedPreceding, 0)
    return orders(spark, sf_dir).select("o_orderkey", F.round(F.sum("o_totalprice").over(w), 2).alias("total"))


@register("win_08_frequent_actors", "WITH g AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1) SELECT user_id, n FROM g WHERE n > 1.2 * (SELECT avg(n) FROM g)")
def actors(spark, sf_dir):
    g = events(spark, sf_dir).groupBy("user_id").agg(F.count("*").alias("n"))
    return g.crossJoin(F.broadcast(g.agg(F.avg("n").alias("m")))).where("n > 1.2 * m").select("user_id", "n")


@register("win_09_best_per_pair", "SELECT l_partkey, l_suppkey, max(l_extendedprice) AS best FROM lineitem GROUP BY 1, 2")
def best(spark, sf_dir):
    return line(spark, sf_dir).groupBy("l_partkey", "l_suppkey").agg(F.max("l_extendedprice").alias("best"))


@register("win_10_union", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def union(spark, sf_dir):
    return customer(spark, sf_dir).select(F.col("c_nationkey").alias("k")).unionByName(read_table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"))).distinct()


@register("win_12_except", "SELECT o_custkey AS k FROM orders EXCEPT ALL SELECT c_custkey FROM customer")
def difference(spark, sf_dir):
    return orders(spark, sf_dir).select(F.col("o_custkey").alias("k")).exceptAll(customer(spark, sf_dir).select(F.col("c_custkey").alias("k")))


@register("win_13_ranked", "SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS rank FROM customer")
def rank(spark, sf_dir):
    return ranked(customer(spark, sf_dir).select("c_custkey", (-F.col("c_acctbal")).alias("k")), ["k", "c_custkey"]).select("c_custkey", F.col("rank").cast("long").alias("rank"))


# Scalars.


@register("scl_01_normalize", "SELECT c_custkey, lower(trim(regexp_replace(c_name, '\\s+', ' ', 'g'))) AS v FROM customer")
def normalize(spark, sf_dir):
    return customer(spark, sf_dir).select("c_custkey", X.normalize_value(F.col("c_name")).alias("v"))


@register("scl_02_levenshtein", "SELECT a.n_name AS a, b.n_name AS b, round(1 - levenshtein(a.n_name, b.n_name) / greatest(length(a.n_name), length(b.n_name)), 6) AS s FROM nation a, nation b WHERE a.n_nationkey < b.n_nationkey")
def levenshtein(spark, sf_dir):
    n = nation(spark, sf_dir)
    pairs = n.select(F.col("n_name").alias("a"), F.col("n_nationkey").alias("i")).join(n.select(F.col("n_name").alias("b"), F.col("n_nationkey").alias("j")), F.col("i") < F.col("j"))
    return pairs.select("a", "b", F.round(X.levenshtein_similarity(F.col("a"), F.col("b")), 6).alias("s"))


@register("scl_04_jaro_winkler", "SELECT p_partkey, round(jaro_winkler_similarity(p_name, p_type), 6) AS s FROM part")
def jaro(spark, sf_dir):
    return part(spark, sf_dir).select("p_partkey", F.round(X.jaro_winkler(F.col("p_name"), F.col("p_type")), 6).alias("s"))


@register("scl_06_token_jaccard", "SELECT p_partkey, round(coalesce(len(list_intersect(a, b)) / nullif(len(list_distinct(a || b)), 0), 0), 6) AS s FROM (SELECT p_partkey, string_split(p_name, ' ') AS a, string_split(p_type, ' ') AS b FROM part)")
def tokens(spark, sf_dir):
    return part(spark, sf_dir).select("p_partkey", F.round(X.token_jaccard(F.split("p_name", " "), F.split("p_type", " ")), 6).alias("s"))


@register("scl_07_ngrams", "SELECT n_nationkey, len(list_distinct(list_transform(range(1, length(n_name) - 1), lambda i: substr(n_name, i, 3))))::BIGINT AS n FROM nation")
def ngrams(spark, sf_dir):
    return nation(spark, sf_dir).select("n_nationkey", F.size(X.ngrams(F.col("n_name"))).cast("long").alias("n"))


@register("scl_08_prefix_ratio")
def prefix(spark, sf_dir):
    return part(spark, sf_dir).select("p_partkey", F.round(X.common_prefix_ratio(F.col("p_name"), F.col("p_type")), 6).alias("prefix"), F.round(X.sequence_ratio(F.col("p_name"), F.col("p_type")), 6).alias("ratio"))


@register("scl_09_names", "SELECT unnest(['customerOrderID', 'HTTPServer name']) AS v, unnest(['customer_order_id', 'http_server_name']) AS snake")
def cases(spark, sf_dir):
    names = spark.createDataFrame([("customerOrderID",), ("HTTPServer name",)], "v string")
    return names.select("v", X.snake_case(F.col("v")).alias("snake"))


@register("scl_11_char_class", "SELECT kind, count(*) AS n FROM (SELECT CASE WHEN regexp_matches(o_orderpriority, '^[0-9]+$') THEN 'NUMERIC' WHEN regexp_matches(o_orderpriority, '^[\\p{L}0-9]+([-_./:][\\p{L}0-9]+)+$') THEN 'WITH_SEPARATOR' WHEN regexp_matches(o_orderpriority, '\\s') THEN 'WITH_SPACE' ELSE 'SPECIAL' END AS kind FROM orders) GROUP BY 1")
def kinds(spark, sf_dir):
    return orders(spark, sf_dir).groupBy(X.char_class(F.col("o_orderpriority")).alias("kind")).agg(F.count("*").alias("n"))


@register("scl_12_mask", "SELECT regexp_replace(regexp_replace(regexp_replace(o_orderpriority, '[a-z]', 'a', 'g'), '[A-Z]', 'A', 'g'), '[0-9]', '9', 'g') AS mask, count(*) AS n FROM orders GROUP BY 1")
def mask(spark, sf_dir):
    return orders(spark, sf_dir).groupBy(X.structure_mask(F.col("o_orderpriority")).alias("mask")).agg(F.count("*").alias("n"))


@register("scl_13_patterns", "SELECT count(*) FILTER (regexp_matches(url, '^https?://[^\\s]+$')) AS urls FROM pages")
def urls(spark, sf_dir):
    return read_table(spark, sf_dir, "pages").agg(F.count_if(X.matches(F.col("url"), "url")).alias("urls"))


@register("scl_14_dates", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS d FROM orders")
def dates(spark, sf_dir):
    text = F.date_format("o_orderdate", "yyyy/MM/dd")
    return orders(spark, sf_dir).select("o_orderkey", F.date_format(X.parse_date(text), "yyyy-MM-dd").alias("d"))


@register("scl_15_numeric_string", "SELECT doc_id, n_chars::DOUBLE AS x FROM documents")
def numbers(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", X.numeric_string(F.format_number("n_chars", 0)).alias("x"))


@register("scl_16_window_start", "SELECT event_id, time_bucket(INTERVAL 5 MINUTE, ts, TIMESTAMP '1970-01-01') AS start FROM events")
def starts(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", X.window_start(F.col("ts"), 300).alias("start"))


@register("scl_17_hashes", "SELECT n_nationkey, substr(sha256(n_name), 1, 12) AS sha, md5(n_name) AS md FROM nation")
def hashes(spark, sf_dir):
    return nation(spark, sf_dir).select("n_nationkey", F.substring(F.sha2("n_name", 256), 1, 12).alias("sha"), F.md5("n_name").alias("md"))


@register("scl_18_cosine", "SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 5) AS s FROM embeddings a, embeddings b WHERE b.vec_id = 0")
def cosine(spark, sf_dir):
    e = read_table(spark, sf_dir, "embeddings")
    return e.crossJoin(F.broadcast(e.where("vec_id = 0").select(F.col("embedding").alias("q")))).select("vec_id", F.round(X.cosine(F.col("embedding"), F.col("q")), 5).alias("s"))


@register("scl_19_logistic", "SELECT c_custkey, round(1 / (1 + exp(-c_acctbal / 1000)), 6) AS p FROM customer")
def logistic(spark, sf_dir):
    return customer(spark, sf_dir).select("c_custkey", F.round(X.sigmoid(F.col("c_acctbal") / 1000), 6).alias("p"))


@register("scl_20_entropy", "SELECT round(-sum(p * ln(p)), 6) AS entropy FROM (SELECT count(*) / sum(count(*)) OVER () AS p FROM lineitem GROUP BY l_returnflag)")
def entropy(spark, sf_dir):
    g = line(spark, sf_dir).groupBy("l_returnflag").agg(F.count("*").alias("n"))
    p = F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1)))
    return g.select(p.alias("p")).agg(F.round(-F.sum(F.col("p") * F.log("p")), 6).alias("entropy"))


@register("scl_24_change", "SELECT o_orderkey, o_totalprice * 1.1::DOUBLE AS up, o_totalprice + 5 AS more FROM orders")
def changed(spark, sf_dir):
    return orders(spark, sf_dir).select("o_orderkey", X.change(F.col("o_totalprice"), "percentage", 10).alias("up"), X.change(F.col("o_totalprice"), "add", 5).alias("more"))


@register("scl_25_wildcard", "SELECT unnest(['order.created', 'order.item.added']) AS name, unnest([true, false]) AS hit")
def wildcard(spark, sf_dir):
    names = spark.createDataFrame([("order.created",), ("order.item.added",)], "name string")
    return names.select("name", F.col("name").rlike(X.wildcard("order.*")).alias("hit"))
