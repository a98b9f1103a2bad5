"""Insight queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstone.operators import insight as I
from quillstone.plans.registry import register
from quillstone.storage import read_table


def _t(name):
    return lambda spark, sf_dir: read_table(spark, sf_dir, name)


line, orders, part, docs, labels, events, customer = (_t(n) for n in ("lineitem", "orders", "part", "documents", "labels", "events", "customer"))


@register("agg_11_category_metric", "SELECT o_orderpriority AS category, count(o_totalprice) AS n, round(sum(o_totalprice), 4) AS sum, round(avg(o_totalprice), 4) AS mean, round(stddev_samp(o_totalprice), 4) AS sd, round(sum(o_totalprice) / sum(sum(o_totalprice)) OVER (), 4) AS share FROM orders GROUP BY 1 ORDER BY 3 DESC, 1 LIMIT 5")
def category(spark, sf_dir):
    return I.category_totals(orders(spark, sf_dir), "o_orderpriority", "o_totalprice")


@register("agg_11_category_means", "SELECT p_brand AS category, count(p_retailprice) AS n, round(avg(p_retailprice), 4) AS mean FROM part GROUP BY 1 HAVING count(p_retailprice) >= 3 ORDER BY avg(p_retailprice) DESC, 1 LIMIT 5")
def means(spark, sf_dir):
    return I.category_means(part(spark, sf_dir), "p_brand", "p_retailprice")


_CLASS = "CASE WHEN regexp_matches(status, 'cancel|fail|error|reject|delay|overdue|return|refund|blocked|suspended|lost|damaged') THEN 'anomaly' WHEN regexp_matches(status, 'pending|hold|waiting|review|partial') THEN 'warning' ELSE 'normal' END"


@register("agg_12_status_distribution", f"WITH g AS (SELECT lower(event_type) AS status, count(*) AS n, count(*) / sum(count(*)) OVER () AS share FROM events WHERE event_type IS NOT NULL GROUP BY lower(event_type)) SELECT status, n, round(share, 6) AS share, {_CLASS} AS kind, {_CLASS} = 'anomaly' AND (n >= 100 OR share >= 0.05) AS problem FROM g")
def status(spark, sf_dir):
    return I.status_distribution(events(spark, sf_dir), "event_type")


@register("agg_13_status_class", f"SELECT {_CLASS} AS kind, count(*) AS n FROM (SELECT lower(event_type) AS status FROM events) GROUP BY 1")
def classes(spark, sf_dir):
    return events(spark, sf_dir).groupBy(I.status_class(F.col("event_type")).alias("kind")).agg(F.count("*").alias("n"))


@register("agg_15_flag_counts", "SELECT count(*) FILTER (quality = 1) AS true_n, count(*) FILTER (quality = 0) AS false_n, count(*) FILTER (quality IS NULL) AS null_n, round(avg(quality), 6) AS true_share FROM labels")
def flags(spark, sf_dir):
    return I.flag_counts(labels(spark, sf_dir), "quality")


@register("agg_17_distribution", "SELECT source AS value, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM documents WHERE source IS NOT NULL GROUP BY source ORDER BY n DESC, value LIMIT 5")
def distribution(spark, sf_dir):
    return I.distribution(docs(spark, sf_dir), "source")


@register("agg_18_risk", "SELECT count(*) AS n, count(*) FILTER (regexp_matches(lower(o_orderpriority), 'high|critical|severe|urgent')) AS at_risk FROM orders")
def risk(spark, sf_dir):
    return I.risk_count(orders(spark, sf_dir), "o_orderpriority")


_THR = "CASE WHEN max(l_discount) <= 1 THEN 0.7 WHEN max(l_discount) <= 100 THEN 70.0 ELSE quantile_cont(l_discount, 0.75) END"


@register("agg_19_low_performers", f"SELECT count(l_discount) AS n, round(avg(l_discount), 4) AS mean, round(any_value(t), 4)::DOUBLE AS threshold, count(*) FILTER (l_discount < t) AS below FROM lineitem, (SELECT {_THR} AS t FROM lineitem)")
def performers(spark, sf_dir):
    return I.low_performers(line(spark, sf_dir), "l_discount")


@register("agg_20_threshold", "SELECT quantile_cont(o_totalprice, 0.75) AS threshold FROM orders")
def threshold(spark, sf_dir):
    return I.kpi_threshold(orders(spark, sf_dir), "o_totalprice")


@register("agg_21_missing", "SELECT 'gap' AS \"column\", round(avg((o_orderkey % 3 = 0)::INT), 6) AS share, 'medium' AS severity FROM orders")
def missing(spark, sf_dir):
    return I.missing_insight(orders(spark, sf_dir).select("o_orderkey", F.when(F.col("o_orderkey") % 3 != 0, "x").alias("gap")))


@register("agg_22_segment_gaps", "WITH g AS (SELECT 'o_totalprice' AS metric, o_orderstatus AS category, avg(o_totalprice) AS m FROM orders GROUP BY 2 HAVING count(*) >= 10 UNION ALL SELECT 'o_custkey', o_orderstatus, avg(o_custkey) FROM orders GROUP BY 2 HAVING count(*) >= 10) SELECT metric, count(*) AS groups, arg_max(category, m) AS best, arg_min(category, m) AS worst, round(max(m), 4) AS hi, round(min(m), 4) AS lo, round(max(m) / min(m), 4) AS ratio, CASE WHEN max(m) / min(m) >= 2 THEN 'significant' WHEN max(m) / min(m) < 1.2 THEN 'no_effect' ELSE 'moderate' END AS effect FROM g GROUP BY metric")
def segments(spark, sf_dir):
    return I.segment_gaps(orders(spark, sf_dir), "o_orderstatus", ["o_totalprice", "o_custkey"])


@register("agg_23_segment_gap", "WITH g AS (SELECT l_returnflag AS c, avg(l_quantity) AS m FROM lineitem GROUP BY 1) SELECT 'l_quantity' AS metric, arg_max(c, m) AS best, arg_min(c, m) AS worst FROM g")
def segment(spark, sf_dir):
    return I.segment_gaps(line(spark, sf_dir), "l_returnflag", ["l_quantity"]).select("metric", "best", "worst")


@register("agg_25_buckets", "WITH e AS (SELECT list_distinct(quantile_cont(l_extendedprice, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0])) AS u FROM lineitem), s AS (SELECT list_sort(u) AS e FROM e), b AS (SELECT least(len(list_filter(e, lambda x: x <= l_extendedprice)), len(e) - 1)::INT AS bucket, e, l_quantity FROM lineitem, s) SELECT bucket, round(e[bucket], 4) AS lo, round(e[bucket + 1], 4) AS hi, count(l_quantity) AS n, round(avg(l_quantity), 4) AS mean FROM b GROUP BY bucket, e HAVING count(l_quantity) >= 10")
def bucket(spark, sf_dir):
    return I.buckets(line(spark, sf_dir), "l_extendedprice", "l_quantity")


@register("agg_27_duplicate_ids", "SELECT round(count(*) / sum(n), 6) AS uniqueness, count(*) FILTER (n > 1) AS repeated, max(n) AS most, round(avg(n) FILTER (n > 1), 4) AS mean FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1)")
def duplicate(spark, sf_dir):
    return I.duplicate_ids(orders(spark, sf_dir), "o_custkey")


def _eta(c):
    return f"SELECT '{c}' AS category, round(sum(n * (m - g) ** 2) / any_value(ss), 6) AS eta FROM (SELECT {c}, count(*) AS n, avg(l_extendedprice) AS m FROM lineitem GROUP BY 1), (SELECT avg(l_extendedprice) AS g, sum((l_extendedprice - a) ** 2) AS ss FROM lineitem, (SELECT avg(l_extendedprice) AS a FROM lineitem))"


@register("agg_28_eta_squared", " UNION ALL ".join(map(_eta, ["l_linenumber", "l_returnflag", "l_quantity"])))
def eta(spark, sf_dir):
    return I.eta_squared(line(spark, sf_dir), ["l_linenumber", "l_returnflag", "l_quantity"], ["l_extendedprice"])


@register("agg_29_rate", "SELECT count(*) AS n, round(avg(l_tax / l_discount), 6) AS rate FROM lineitem WHERE l_discount > 0")
def rate(spark, sf_dir):
    return I.mean_ratio(line(spark, sf_dir), "l_tax", "l_discount")


@register("agg_30_positive_mean", "SELECT count(*) AS n, round(avg(c_acctbal), 6) AS mean FROM customer WHERE c_acctbal > 0")
def positive(spark, sf_dir):
    return I.positive_mean(customer(spark, sf_dir), "c_acctbal")


@register("agg_35_cost_per", "SELECT round(sum(l_extendedprice) / sum(l_quantity), 6) AS cost FROM lineitem")
def cost(spark, sf_dir):
    return I.cost_per(line(spark, sf_dir), "l_extendedprice", "l_quantity")


@register("agg_33_graded_mean", "SELECT round(avg(l_quantity), 4) AS mean, max(l_quantity) AS max, CASE WHEN avg(l_quantity) < 4 THEN 'low' WHEN avg(l_quantity) < 7 THEN 'medium' ELSE 'high' END AS grade FROM lineitem")
def graded(spark, sf_dir):
    return I.graded_mean(line(spark, sf_dir), "l_quantity", [(4, "low"), (7, "medium")], "high")


@register("agg_36_group_anomalies", "WITH g AS (SELECT l_suppkey, sum(l_discount) / sum(l_quantity) AS rate FROM lineitem GROUP BY 1), s AS (SELECT *, avg(rate) OVER () AS m, stddev_samp(rate) OVER () AS s FROM g) SELECT l_suppkey, round(rate, 6) AS rate, CASE WHEN rate > m THEN 'high' ELSE 'low' END AS direction FROM s WHERE abs(rate - m) > 2 * s")
def group_anomalies(spark, sf_dir):
    return I.group_rate_anomalies(line(spark, sf_dir), "l_suppkey", "l_discount", "l_quantity")


@register("agg_39_delays", "SELECT count(*) AS n, count(*) FILTER (l_shipdate::DATE > o_orderdate::DATE) AS late, round(avg((l_shipdate::DATE > o_orderdate::DATE)::INT), 6) AS share FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def late(spark, sf_dir):
    both = line(spark, sf_dir).join(orders(spark, sf_dir), F.col("l_orderkey") == F.col("o_orderkey"))
    return I.delays(both, "o_orderdate", "l_shipdate")


@register("agg_40_quantity_anomalies", "SELECT count(*) FILTER (c_acctbal < 0) AS negative, count(*) FILTER (c_acctbal > m + 3 * s) AS large, count(*) FILTER (c_acctbal > m + 3 * s) >= 10 AS reported FROM customer, (SELECT avg(c_acctbal) AS m, stddev_samp(c_acctbal) AS s FROM customer)")
def quantities(spark, sf_dir):
    return I.quantity_anomalies(customer(spark, sf_dir), "c_acctbal")


def _found(spark, sf_dir):
    rows = part(spark, sf_dir).groupBy("p_brand").agg(F.round(F.avg("p_retailprice"), 4).alias("score"))
    return rows.select(F.lit("price").alias("kind"), F.col("p_brand").alias("column"), F.when(F.col("score") > 1500, "up").otherwise("down").alias("direction"), "score")


@register("agg_41_consolidate", "WITH f AS (SELECT 'price' AS kind, p_brand AS \"column\", CASE WHEN round(avg(p_retailprice), 4) > 1500 THEN 'up' ELSE 'down' END AS direction, round(avg(p_retailprice), 4) AS score FROM part GROUP BY p_brand) SELECT *, false AS contradicted, row_number() OVER (ORDER BY score DESC, \"column\", direction)::INT AS rank FROM f QUALIFY rank <= 5")
def consolidate(spark, sf_dir):
    return I.consolidate(_found(spark, sf_dir))


@register("agg_43_by_severity", "SELECT p_brand AS \"column\", round(avg(p_retailprice), 4) AS score, CASE WHEN round(avg(p_retailprice), 4) > 1500 THEN 'high' ELSE 'low' END AS severity FROM part GROUP BY 1 ORDER BY severity, 1")
def severity(spark, sf_dir):
    return I.by_severity(_found(spark, sf_dir).select("column", "score", F.when(F.col("score") > 1500, "high").otherwise("low").alias("severity")))
