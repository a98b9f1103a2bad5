"""Queries over constraints, anomalies, samples, experiments, scenarios, forecasts and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstone.functions import scalars as X
from quillstone.operators import forecasting as M
from quillstone.operators import process as C
from quillstone.operators import quality as Q
from quillstone.operators import relations as R
from quillstone.operators import sampling, stats
from quillstone.operators import timeseries as T
from quillstone.plans.registry import register
from quillstone.plans.statistics import _daily, _types
from quillstone.storage import read_table


def _t(name):
    return lambda spark, sf_dir: read_table(spark, sf_dir, name)


orders, customer, events, part, docs, nation, line, labels = map(_t, ("orders", "customer", "events", "part", "documents", "nation", "lineitem", "labels"))


def _violation(table, key, column, constraint, test, value):
    return f"SELECT {key}, '{column}' AS \"column\", '{constraint}' AS \"constraint\", {value} AS value FROM {table} WHERE {test}"


_HOLED = "(SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN NULL WHEN doc_id % 9 = 1 THEN ' ' ELSE lang END AS lang, source FROM documents)"


@register("dq_20_counts", " UNION ALL ".join((_violation(_HOLED, "doc_id", "lang", "min_count", "lang IS NULL OR trim(lang) = ''", "lang"), _violation(_HOLED, "doc_id", "source", "max_count", "source IS NOT NULL", "source"))))
def counts(spark, sf_dir):
    shape = Q.Shape("documents", (("lang", "min_count", 1), ("source", "min_count", 0), ("source", "max_count", 0), ("lang", "max_count", 1)))
    holed = F.when(F.col("doc_id") % 9 == 0, None).when(F.col("doc_id") % 9 == 1, " ").otherwise(F.col("lang"))
    return Q.violations(docs(spark, sf_dir).withColumn("lang", holed), shape, "doc_id")


@register("dq_21_ranges", " UNION ALL ".join((_violation("part", "p_partkey", "p_size", "min_inclusive", "p_size < 5", "p_size::VARCHAR"), _violation("part", "p_partkey", "p_size", "max_exclusive", "p_size >= 45", "p_size::VARCHAR"), _violation("part", "p_partkey", "p_brand", "max_inclusive", "true", "p_brand"))))
def ranges(spark, sf_dir):
    shape = Q.Shape("part", (("p_size", "min_inclusive", 5), ("p_size", "max_exclusive", 45), ("p_size", "min_exclusive", 0), ("p_brand", "max_inclusive", 10)))
    return Q.violations(part(spark, sf_dir), shape, "p_partkey")


@register("dq_22_lengths", " UNION ALL ".join((_violation("part", "p_partkey", "p_name", "min_length", "length(p_name) < 9", "p_name"), _violation("part", "p_partkey", "p_name", "max_length", "length(p_name) > 11", "p_name"), _violation("part", "p_partkey", "p_brand", "pattern", "NOT regexp_matches(p_brand, '^Brand#1')", "p_brand"))))
def lengths(spark, sf_dir):
    shape = Q.Shape("part", (("p_name", "min_length", 9), ("p_name", "max_length", 11), ("p_brand", "pattern", "Brand#1")))
    return Q.violations(part(spark, sf_dir), shape, "p_partkey")


@register("dq_23_values", " UNION ALL ".join((_violation("orders", "o_orderkey", "o_orderstatus", "in", "o_orderstatus NOT IN ('O', 'F')", "o_orderstatus"), _violation("orders", "o_orderkey", "o_orderpriority", "has_value", "o_orderpriority <> '5-LOW'", "o_orderpriority"))))
def values(spark, sf_dir):
    shape = Q.Shape("orders", (("o_orderstatus", "in", ["O", "F"]), ("o_orderpriority", "has_value", "5-LOW")))
    return Q.violations(orders(spark, sf_dir), shape, "o_orderkey")


@register("dq_25_own_constraint", _violation("part", "p_partkey", "p_size", "multiple_of", "p_size % 7 <> 0", "p_size::VARCHAR"))
def own_constraint(spark, sf_dir):
    Q.add_constraint("multiple_of", lambda c, v: c % v == 0)
    return Q.violations(part(spark, sf_dir), Q.Shape("part", (("p_size", "multiple_of", 7),)), "p_partkey")


@register("dq_14_anomaly_insight", "WITH s AS (SELECT avg(n_chars) AS m, stddev_pop(n_chars) AS sd, quantile_cont(n_chars, 0.25) AS q1, quantile_cont(n_chars, 0.75) AS q3, quantile_cont(n_chars, 0.99) AS p99, count(n_chars) AS n FROM documents) SELECT 'n_chars' AS \"column\", count(*) AS n, round(count(*) / any_value(n), 6) AS share, round(any_value(q1 - 1.5 * (q3 - q1)), 4) AS low, round(any_value(q3 + 1.5 * (q3 - q1)), 4) AS high, round(any_value(p99), 4) AS p99 FROM documents, (SELECT m, sd, q1, q3, p99, n AS n FROM s) s WHERE abs(n_chars - m) / sd > 3 OR n_chars < q1 - 1.5 * (q3 - q1) OR n_chars > q3 + 1.5 * (q3 - q1) HAVING count(*) > 0.01 * any_value(s.n)")
def anomaly_insight(spark, sf_dir):
    return Q.anomaly_insights(docs(spark, sf_dir), ["n_chars", "doc_id"], "doc_id")


@register("agg_38_kpi_estimates", "SELECT 'retention' AS kpi, round(0.6 + 0.2 * least(1.0, count(*) / 100000), 6) AS estimate, count(*) AS rows FROM orders UNION ALL SELECT 'margin', round(0.1 + 0.05 * least(1.0, count(*) / 100000), 6), count(*) FROM orders")
def kpi_estimates(spark, sf_dir):
    return R.kpi_estimates(orders(spark, sf_dir), {"retention": (0.6, 0.8), "margin": (0.1, 0.15)}, 100_000)


@register("smp_02_load_sample", "SELECT event_type, least(count(*), greatest(5, round(1000 * count(*) / (SELECT count(*) FROM events))))::BIGINT AS n FROM events GROUP BY 1")
def load_sample(spark, sf_dir):
    return sampling.load_sample(events(spark, sf_dir), "event_type", "event_id").groupBy("event_type").agg(F.count("*").alias("n"))


@register("smp_03_samples", "SELECT 'orders' AS \"table\", least(count(*), 5000) AS n FROM orders UNION ALL SELECT 'customer', least(count(*), 5000) FROM customer UNION ALL SELECT 'nation', least(count(*), 5000) FROM nation")
def samples(spark, sf_dir):
    found = sampling.samples({"orders": (orders(spark, sf_dir), "o_orderkey"), "customer": (customer(spark, sf_dir), "c_custkey"), "nation": (nation(spark, sf_dir), "n_nationkey")})
    out = None
    for t, df in found.items():
        one = df.agg(F.lit(t).alias("table"), F.count("*").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


@register("stat_09_experiments", "SELECT 'l_quantity' AS driver, 'l_extendedprice' AS outcome")
def experiments(spark, sf_dir):
    df = line(spark, sf_dir).withColumn("l_extendedprice", F.col("l_quantity") * 100 + F.col("l_tax"))
    return stats.significant_experiments(df, ["l_quantity", "l_extendedprice", "l_discount"]).select("driver", "outcome")


@register("ctl_08_insight_run", "SELECT 'l_quantity' AS driver, 'l_extendedprice' AS outcome, 'large' AS size")
def insight_run(spark, sf_dir):
    """Correlations, then experiments on the strongest, through stages; texts about them are a model's part."""
    df = line(spark, sf_dir).withColumn("l_extendedprice", F.col("l_quantity") * 100 + F.col("l_tax")).select("l_quantity", "l_extendedprice", "l_discount")
    run = C.Stages([("experiments", lambda d: stats.significant_experiments(d, d.columns)), ("report", lambda d: d.select("driver", "outcome", stats.effect_size(F.col("d")).alias("size")))])
    return run.run(df)


@register("stat_21_impacts", "SELECT 'o_totalprice' AS \"column\", round(avg(o_totalprice), 4) AS before, round(avg(o_totalprice * 1.1), 4) AS after, round(stddev_pop(o_totalprice * 1.1), 4) AS sd, round((avg(o_totalprice * 1.1) - avg(o_totalprice)) / abs(avg(o_totalprice)), 6) AS change, 'positive' AS kind FROM orders UNION ALL SELECT 'o_custkey', round(avg(o_custkey), 4), round(avg(o_custkey + 0.01), 4), round(stddev_pop(o_custkey + 0.01), 4), round((avg(o_custkey + 0.01) - avg(o_custkey)) / abs(avg(o_custkey)), 6), 'neutral' FROM orders")
def impacts(spark, sf_dir):
    return stats.what_if_impacts(orders(spark, sf_dir), {"o_totalprice": F.col("o_totalprice") * 1.1, "o_custkey": F.col("o_custkey").cast("double") + 0.01})


@register("stat_25_scenarios", "SELECT scenario, likelihood, month::INTEGER AS month, round((SELECT avg(o_totalprice) FROM orders) * (1 + 0.15 * factor * month / 12), 4) AS value FROM (SELECT unnest(['conservative', 'moderate', 'optimistic']) AS scenario, unnest([0.5, 1.0, 1.5]::DOUBLE[]) AS factor, unnest([0.3, 0.5, 0.2]::DOUBLE[]) AS likelihood), (SELECT unnest(range(1, 13)) AS month)")
def scenarios(spark, sf_dir):
    return stats.improvement_scenarios(orders(spark, sf_dir), "o_totalprice")


@register("stat_18_integration_impact", "SELECT 'orders' AS \"table\", count(*) AS rows, round(count(*) FILTER (o_custkey IN (SELECT c_custkey FROM customer)) / count(*), 6) AS joined FROM orders")
def integration_impact(spark, sf_dir):
    """What a key makes reachable, as measured: the share of rows that find their partner. (No data are made up.)"""
    known = customer(spark, sf_dir).select(F.col("c_custkey").alias("k"), F.lit(1).alias("hit")).distinct()
    return orders(spark, sf_dir).join(known, F.col("o_custkey") == F.col("k"), "left").agg(F.lit("orders").alias("table"), F.count("*").alias("rows"), F.round(F.count("hit") / F.count("*"), 6).alias("joined"))


# Forecasts. The models are tested against known series; here they run over all series.


def _forecast(model):
    return lambda spark, sf_dir: T.forecast(_types(spark, sf_dir), 6, model).select("series", "step", F.round("forecast", 4).alias("forecast"))


for _name, _model in (("ts_06_arima", "arima"), ("ts_07_auto_arima", "auto_arima"), ("ts_08_seasonal_regression", "seasonal_regression"), ("ts_09_ensemble", "weighted_ensemble"), ("ts_09_stacking", "stacked"), ("ts_11_forecast", "automatic"), ("ts_17_kpi", "kpi")):
    register(_name)(_forecast(_model))


_HOURS = "WITH y AS (SELECT date_trunc('hour', ts) AS d, sum(value) AS value FROM events GROUP BY 1), r AS (SELECT value, row_number() OVER (ORDER BY d) - 1 AS i FROM y WHERE value IS NOT NULL), g AS (SELECT regr_slope(value, i) AS slope FROM r), b AS (SELECT avg(value) AS now FROM (SELECT value FROM r ORDER BY i DESC LIMIT 7))"


@register("ts_18_insight", _HOURS + ", a AS (SELECT now, avg(round(now + slope * k, 4)) AS ahead FROM b, g, (SELECT unnest(range(7)) AS k) GROUP BY now) SELECT 'all' AS series, round(now, 4) AS now, round(ahead, 4) AS ahead, round((ahead - now) / abs(now), 6) AS change, CASE WHEN (ahead - now) / abs(now) > 0.05 THEN 'rising' WHEN (ahead - now) / abs(now) < -0.05 THEN 'falling' ELSE 'steady' END AS outlook FROM a")
def insight(spark, sf_dir):
    return M.insight(_daily(spark, sf_dir))


# Scalars.


@register("scl_03_name_similarity", "SELECT a.n_nationkey AS a, round(1 - levenshtein(lower(a.n_name), lower(b.n_name)) / greatest(length(a.n_name), length(b.n_name)), 6) AS similarity FROM nation a JOIN nation b ON a.n_nationkey + 1 = b.n_nationkey")
def name_similarity(spark, sf_dir):
    n = nation(spark, sf_dir)
    j = n.select(F.col("n_nationkey").alias("a"), F.lower("n_name").alias("x")).join(n.select((F.col("n_nationkey") - 1).alias("a"), F.lower("n_name").alias("y")), "a")
    return j.select("a", F.round(X.levenshtein_similarity(F.col("x"), F.col("y")), 6).alias("similarity"))


@register("scl_05_jaro_winkler", "SELECT p_partkey, round(jaro_winkler_similarity(p_name, p_type), 6) AS similarity FROM part")
def jaro_winkler(spark, sf_dir):
    return part(spark, sf_dir).select("p_partkey", F.round(X.jaro_winkler(F.col("p_name"), F.col("p_type")), 6).alias("similarity"))


@register("scl_21_json_in_text", "SELECT event_id, '{\"k\": ' || json_extract_string(props, '$.k') || '}' AS json FROM events WHERE event_id % 2 = 0 UNION ALL SELECT event_id, NULL FROM events WHERE event_id % 2 = 1")
def json_in_text(spark, sf_dir):
    fenced = F.concat(F.lit("Here it is:\n```json\n"), F.replace("props", F.lit("}"), F.lit(",}")), F.lit("\n```\nas asked"))
    text = F.when(F.col("event_id") % 2 == 0, fenced).otherwise("no data {at all")
    return events(spark, sf_dir).select("event_id", X.json_in_text(text).alias("json"))
