"""Queries over data quality and repair."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstone.operators import quality as Q
from quillstone.operators import remediate as R
from quillstone.plans.registry import register
from quillstone.storage import read_table


def _line(spark, sf_dir):
    return read_table(spark, sf_dir, "lineitem")


def _docs(spark, sf_dir):
    return read_table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")


_Z = "abs(n_chars - m) / s > 3 FROM documents, (SELECT avg(n_chars) AS m, stddev_pop(n_chars) AS s FROM documents)"
_IQR_STATS = "(SELECT quantile_cont(n_chars::DOUBLE, 0.25) AS q1, quantile_cont(n_chars::DOUBLE, 0.75) AS q3, avg(n_chars) AS m, stddev_pop(n_chars) AS s FROM documents)"
_IQR = "(n_chars < q1 - 1.5 * (q3 - q1) OR n_chars > q3 + 1.5 * (q3 - q1))"


@register("dq_01_z_outliers", f"SELECT doc_id, n_chars FROM documents, {_IQR_STATS} WHERE abs(n_chars - m) / s > 3")
def z(spark, sf_dir):
    return Q.z_outliers(_docs(spark, sf_dir), "n_chars").select("doc_id", "n_chars")


@register("dq_02_iqr_outliers", f"SELECT doc_id, n_chars FROM documents, {_IQR_STATS} WHERE {_IQR}")
def iqr(spark, sf_dir):
    return Q.iqr_outliers(_docs(spark, sf_dir), "n_chars").select("doc_id", "n_chars")


@register("dq_03_column_anomalies", f"SELECT doc_id FROM documents, {_IQR_STATS} WHERE {_IQR} AND abs(n_chars - m) / s > 3")
def anomalies(spark, sf_dir):
    return Q.votes(_docs(spark, sf_dir), "n_chars", "doc_id").where("votes = 2").select("doc_id")


@register("dq_04_ensemble_votes", f"SELECT doc_id, n_chars::DOUBLE AS value, (abs(n_chars - m) / s > 3)::INT AS z, {_IQR}::INT AS iqr, (abs(n_chars - m) / s > 3)::INT + {_IQR}::INT AS votes FROM documents, {_IQR_STATS} WHERE {_IQR} OR abs(n_chars - m) / s > 3")
def ensemble(spark, sf_dir):
    return Q.votes(_docs(spark, sf_dir), "n_chars", "doc_id")


@register("dq_05_isolation_forest")
def isolation(spark, sf_dir):
    part = read_table(spark, sf_dir, "part")
    return Q.isolation_scores(part, "p_partkey", ["p_size", "p_retailprice"])


@register("dq_06_histogram_scores", "WITH b AS (SELECT p_partkey, least(floor((p_size - lo) / greatest(hi - lo, 1e-300) * 10), 9)::INT AS bin FROM part, (SELECT min(p_size)::DOUBLE AS lo, max(p_size)::DOUBLE AS hi FROM part)), c AS (SELECT bin, -ln(count(*) / (SELECT count(*) FROM part)) AS s FROM b GROUP BY bin) SELECT p_partkey, round(s, 6) AS score FROM b JOIN c USING (bin)")
def histogram(spark, sf_dir):
    return Q.histogram_scores(read_table(spark, sf_dir, "part"), ["p_size"], "p_partkey")


@register("dq_07_null_spikes", "SELECT 'nothing' AS \"column\", 1.0::DOUBLE AS share, 'critical' AS severity")
def spikes(spark, sf_dir):
    return Q.null_spikes(_docs(spark, sf_dir).withColumn("nothing", F.lit(None).cast("string")))


@register("dq_08_type_mismatches", "SELECT count(*) AS n, count(*) FILTER (source IS NOT NULL AND try_cast(source AS BIGINT) IS NULL) AS bad, count(*) FILTER (source IS NOT NULL AND try_cast(source AS BIGINT) IS NULL) > 0.05 * count(*) AS mismatch FROM documents")
def mismatches(spark, sf_dir):
    return Q.type_mismatches(_docs(spark, sf_dir), "source", "bigint")


@register("dq_09_key_duplicates", "SELECT l_orderkey, count(*) AS n, count(*) - 1 AS extra FROM lineitem GROUP BY 1 HAVING count(*) > 1")
def duplicates(spark, sf_dir):
    return Q.key_duplicates(_line(spark, sf_dir), "l_orderkey")


def _both(c):
    return f"count(*) FILTER (abs({c} - m_{c}) / s_{c} > 3 AND ({c} < q1_{c} - 1.5 * (q3_{c} - q1_{c}) OR {c} > q3_{c} + 1.5 * (q3_{c} - q1_{c})))"


def _stats(c):
    return f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}, quantile_cont({c}::DOUBLE, 0.25) AS q1_{c}, quantile_cont({c}::DOUBLE, 0.75) AS q3_{c}"


@register("dq_10_table_report", f"WITH r AS (SELECT count(*) AS n, {_both('l_quantity')} AS a, {_both('l_extendedprice')} AS b FROM lineitem, (SELECT {_stats('l_quantity')}, {_stats('l_extendedprice')} FROM lineitem)) SELECT unnest(['l_quantity', 'l_extendedprice']) AS \"column\", unnest([a, b]) AS outliers, round(1.0 - (a + b) / (2 * n + 1), 6) AS quality FROM r")
def report(spark, sf_dir):
    return Q.table_report(_line(spark, sf_dir).select("l_quantity", "l_extendedprice"))


@register("dq_12_order_statistic_outliers", "WITH s AS (SELECT n_chars::DOUBLE AS x, row_number() OVER (ORDER BY n_chars) - 1 AS r, count(*) OVER () AS n FROM documents), q AS (SELECT max(x) FILTER (r = n // 4) AS q1, max(x) FILTER (r = 3 * n // 4) AS q3 FROM s) SELECT doc_id, n_chars FROM documents, q WHERE n_chars < q1 - 1.5 * (q3 - q1) OR n_chars > q3 + 1.5 * (q3 - q1)")
def order_iqr(spark, sf_dir):
    return Q.order_iqr_outliers(_docs(spark, sf_dir), "n_chars").select("doc_id", "n_chars")


def _shares(spark, sf_dir):
    return read_table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("s"), (100.0 - F.col("p_size")).alias("rest"), F.col("p_size").cast("double").alias("twin"), F.col("p_retailprice").alias("price"), (F.col("p_size") / F.col("p_retailprice")).alias("ratio"))


@register("dq_15_sum_constants", "SELECT 's' AS a, 'rest' AS b, 100.0::DOUBLE AS total UNION ALL SELECT 'rest', 'twin', 100.0")
def constants(spark, sf_dir):
    return Q.sum_constants(_shares(spark, sf_dir), ["s", "rest", "twin"])


@register("dq_16_duplicate_columns", "SELECT 's' AS a, 'twin' AS b, 1.0::DOUBLE AS same")
def twins(spark, sf_dir):
    return Q.duplicate_columns(_shares(spark, sf_dir), ["s", "rest", "twin"])


@register("dq_17_derived_ratios", "SELECT 'ratio' AS target, 's' AS a, 'price' AS b, 1 AS scale")
def ratios(spark, sf_dir):
    return Q.derived_ratios(_shares(spark, sf_dir), ["s", "price", "ratio"]).where("target = 'ratio'")


_SHAPE = Q.Shape("orders", (("o_orderkey", "min_count", 1), ("o_totalprice", "max_inclusive", 300000), ("o_orderstatus", "in", ["F", "O"]), ("o_orderpriority", "pattern", "[1-3]-"), ("o_orderpriority", "max_length", 10), ("o_orderkey", "disjoint", "o_custkey")))


def _violation(column, name, test):
    return f"SELECT o_orderkey, '{column}' AS \"column\", '{name}' AS \"constraint\", {column}::VARCHAR AS value FROM orders WHERE {test}"


@register(
    "dq_19_shape_violations",
    "SELECT o_orderkey, \"column\", \"constraint\" FROM (" + " UNION ALL ".join([_violation("o_totalprice", "max_inclusive", "o_totalprice > 300000"), _violation("o_orderstatus", "in", "o_orderstatus NOT IN ('F', 'O')"), _violation("o_orderpriority", "pattern", "NOT regexp_matches(o_orderpriority, '^[1-3]-')"), _violation("o_orderpriority", "max_length", "length(o_orderpriority) > 10"), _violation("o_orderkey", "disjoint", "o_orderkey = o_custkey")]) + ")",
)
def shape(spark, sf_dir):
    return Q.violations(read_table(spark, sf_dir, "orders"), _SHAPE, "o_orderkey").select("o_orderkey", "column", "constraint")


@register("dq_24_column_pairs", "SELECT l_orderkey, 'l_tax' AS \"column\", 'less_than' AS \"constraint\" FROM lineitem WHERE NOT l_tax < l_discount")
def pairs(spark, sf_dir):
    return Q.violations(_line(spark, sf_dir), Q.Shape("line", (("l_tax", "less_than", "l_discount"),)), "l_orderkey").select("l_orderkey", "column", "constraint")


@register("dq_27_default_shape", "SELECT c AS \"column\", unnest(['min_count', 'min_inclusive']) AS \"constraint\", unnest(['1', '0']) AS value FROM (SELECT unnest(['c_custkey', 'c_nationkey']) AS c) UNION ALL SELECT 'c_name', 'min_length', '1'")
def default(spark, sf_dir):
    found = Q.default_shape(read_table(spark, sf_dir, "customer"), "customer")
    return spark.createDataFrame([(c, n, str(v)) for c, n, v in found.constraints], "column string, constraint string, value string")


_HOLES = "(SELECT p_partkey, CASE WHEN p_partkey % 7 <> 0 THEN p_retailprice END AS p_retailprice, CASE WHEN p_partkey % 5 <> 0 THEN p_brand ELSE ' ' END AS p_brand FROM part)"


def _holes(spark, sf_dir):
    part = read_table(spark, sf_dir, "part")
    return part.select("p_partkey", F.when(F.col("p_partkey") % 7 != 0, F.col("p_retailprice")).alias("p_retailprice"), F.when(F.col("p_partkey") % 5 != 0, F.col("p_brand")).otherwise(" ").alias("p_brand"))


@register("rem_01_missing", f"SELECT 'p_retailprice' AS \"column\", count(*) FILTER (p_retailprice IS NULL) AS n, round(count(*) FILTER (p_retailprice IS NULL) / count(*), 6) AS rate FROM {_HOLES} UNION ALL SELECT 'p_brand', count(*) FILTER (trim(p_brand) = ''), round(count(*) FILTER (trim(p_brand) = '') / count(*), 6) FROM {_HOLES}")
def missing(spark, sf_dir):
    return R.missing(_holes(spark, sf_dir))


@register("rem_02_outliers", "SELECT 'n_chars' AS \"column\", count(*) AS n FROM documents, (SELECT avg(n_chars) AS m, stddev_samp(n_chars) AS s FROM documents) WHERE abs(n_chars - m) > 3 * s")
def outliers(spark, sf_dir):
    return R.outliers(_docs(spark, sf_dir).select("n_chars"))


@register("rem_03_duplicates", "SELECT l_partkey, l_suppkey, count(*) - 1 AS extra FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def row_duplicates(spark, sf_dir):
    return R.duplicates(_line(spark, sf_dir).select("l_partkey", "l_suppkey"))


@register("rem_05_fill_mean", f"SELECT p_partkey, round(coalesce(p_retailprice, (SELECT avg(p_retailprice) FROM {_HOLES})), 4) AS p_retailprice FROM {_HOLES}")
def mean(spark, sf_dir):
    return R.fill_mean(_holes(spark, sf_dir), "p_retailprice").select("p_partkey", F.round("p_retailprice", 4).alias("p_retailprice"))


@register("rem_06_fill_median", f"SELECT p_partkey, round(coalesce(p_retailprice, (SELECT quantile_cont(p_retailprice, 0.5) FROM {_HOLES})), 4) AS p_retailprice FROM {_HOLES}")
def median(spark, sf_dir):
    return R.fill_median(_holes(spark, sf_dir), "p_retailprice").select("p_partkey", F.round("p_retailprice", 4).alias("p_retailprice"))


@register("rem_07_fill_mode", f"SELECT p_partkey, CASE WHEN trim(p_brand) = '' THEN (SELECT p_brand FROM {_HOLES} WHERE trim(p_brand) <> '' GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) ELSE p_brand END AS p_brand FROM {_HOLES}")
def mode(spark, sf_dir):
    return R.fill_mode(_holes(spark, sf_dir), "p_brand").select("p_partkey", "p_brand")


@register("rem_08_fill_default", f"SELECT p_partkey, CASE WHEN trim(p_brand) = '' THEN 'N/A' ELSE p_brand END AS p_brand FROM {_HOLES}")
def fill(spark, sf_dir):
    return R.fill_default(_holes(spark, sf_dir), "p_brand").select("p_partkey", "p_brand")


@register("rem_09_remove_rows", "SELECT p_partkey FROM part WHERE p_size <= 40")
def remove(spark, sf_dir):
    part = read_table(spark, sf_dir, "part")
    return R.remove_rows(part, part.where("p_size > 40"), ["p_partkey"]).select("p_partkey")


@register("rem_10_clip", "SELECT doc_id, round(least(greatest(n_chars, lo), hi), 2) AS n_chars FROM documents, (SELECT round(avg(n_chars) - 3 * stddev_samp(n_chars), 2) AS lo, round(avg(n_chars) + 3 * stddev_samp(n_chars), 2) AS hi FROM documents)")
def clip(spark, sf_dir):
    return R.clip(_docs(spark, sf_dir), "n_chars").select("doc_id", F.round("n_chars", 2).alias("n_chars"))


@register("rem_11_deduplicate", "SELECT l_orderkey, min(l_linenumber) AS l_linenumber FROM lineitem GROUP BY 1")
def deduplicate(spark, sf_dir):
    return R.deduplicate(_line(spark, sf_dir).select("l_orderkey", "l_linenumber"), ["l_orderkey"], ["l_linenumber"])


@register("rem_12_infer_by_group", f"WITH h AS (SELECT p.p_partkey, p_type, h.p_brand FROM part p JOIN {_HOLES} h USING (p_partkey)), b AS (SELECT p_type, p_brand, row_number() OVER (PARTITION BY p_type ORDER BY count(*) DESC, p_brand) AS r FROM h WHERE trim(p_brand) <> '' GROUP BY p_type, p_brand) SELECT p_partkey, CASE WHEN trim(h.p_brand) = '' THEN b.p_brand ELSE h.p_brand END AS p_brand FROM h LEFT JOIN b ON h.p_type = b.p_type AND b.r = 1")
def infer(spark, sf_dir):
    rows = _holes(spark, sf_dir).join(read_table(spark, sf_dir, "part").select("p_partkey", "p_type"), "p_partkey")
    return R.fill_group_mode(rows, "p_brand", "p_type").select("p_partkey", "p_brand")


@register("rem_13_impact", "SELECT 'itself' AS \"table\", count(*) AS n, CASE WHEN count(*) > 100 THEN 'high' WHEN count(*) > 10 THEN 'medium' ELSE 'low' END AS risk FROM part WHERE p_size > 40 UNION ALL SELECT 'lineitem', count(*), CASE WHEN count(*) > 100 THEN 'high' WHEN count(*) > 10 THEN 'medium' ELSE 'low' END FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 40)")
def impact(spark, sf_dir):
    return R.impact(read_table(spark, sf_dir, "part").where("p_size > 40"), {"lineitem": (_line(spark, sf_dir), "l_partkey")}, "p_partkey")


@register("rem_15_remediate", "SELECT count(*) AS n, count(*) AS filled, 'missing:p_retailprice:fill_mean,missing:p_brand:fill_default' AS done FROM part")
def remediate(spark, sf_dir):
    df, done = R.remediate(_holes(spark, sf_dir))
    return df.agg(F.count("*").alias("n"), F.count("p_retailprice").alias("filled"), F.lit(",".join(f"{k}:{c}:{s}" for k, c, s in done)).alias("done"))


@register("rem_16_load_rules", "SELECT l_orderkey, l_linenumber, least(l_quantity * 4, 100.0) AS rate FROM lineitem")
def rules(spark, sf_dir):
    return R.load_rules(_line(spark, sf_dir).select("l_orderkey", "l_linenumber", (F.col("l_quantity") * 4).alias("rate")), rate_columns=["rate"])
