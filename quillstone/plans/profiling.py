"""Profiling queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstone.operators import profile as P
from quillstone.plans.registry import register
from quillstone.storage import read_table


def _profile_sql(table: str, columns: dict[str, str]) -> str:
    one = "SELECT '{c}' AS \"column\", '{t}' AS type, count(*) AS total, count(*) - count({c}) AS nulls, count(DISTINCT {c}) AS \"distinct\", min({c})::VARCHAR AS least, max({c})::VARCHAR AS greatest FROM " + table
    return " UNION ALL ".join(one.format(c=c, t=t) for c, t in columns.items())


@register("agg_01_column_metadata", _profile_sql("nation", {"n_nationkey": "int", "n_name": "string", "n_regionkey": "int"}))
def metadata(spark, sf_dir):
    return P.profile(read_table(spark, sf_dir, "nation"))


@register("agg_02_column_profile", _profile_sql("orders", {"o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": "string", "o_orderpriority": "string"}))
def column_profile(spark, sf_dir):
    return P.profile(read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"))


@register("agg_03_table_analysis", "SELECT round((1 - 0.3 * (k < 0.95)::INT + 1 - 0.3 * (n < 0.95)::INT + 3) / 5, 6) AS score, '3NF' AS form, 5 AS n_columns FROM (SELECT count(DISTINCT c_custkey) / count(c_custkey) AS k, count(DISTINCT c_nationkey) / count(c_nationkey) AS n FROM customer)")
def analysis(spark, sf_dir):
    df = read_table(spark, sf_dir, "customer")
    keys = P.key_candidates(df)
    return P.quality_score(df).withColumn("form", F.lit(P.normal_form(df, keys))).withColumn("n_columns", F.lit(len(df.columns)))


@register("agg_04_type_inference", "SELECT unnest(['event_type', 'props']) AS \"column\", 'string' AS inferred, unnest(['status', NULL]) AS meaning")
def inference(spark, sf_dir):
    return P.inferred(read_table(spark, sf_dir, "events"))


def _share(c: str, test: str, name: str) -> str:
    return f"round(avg(CASE WHEN {c} IS NOT NULL AND trim({c}) <> '' THEN ({test})::INT END), 6) AS {name}"


@register("agg_05_patterns", "SELECT 'p_brand' AS \"column\", " + _share("p_brand", "regexp_matches(p_brand, '^[A-Z]{2,5}[-_]?\\d{2,10}$')", "code") + ", " + _share("p_brand", "regexp_matches(p_brand, '^\\d{1,20}$')", "numeric_id") + " FROM part")
def patterns(spark, sf_dir):
    return P.text_shares(read_table(spark, sf_dir, "part").select("p_brand")).select("column", "code", "numeric_id")


@register("agg_06_min_max", "SELECT min(try_cast(replace(s, ',', '') AS DOUBLE)) AS least, max(try_cast(replace(s, ',', '') AS DOUBLE)) AS greatest FROM (SELECT n_chars::VARCHAR AS s FROM documents)")
def min_max(spark, sf_dir):
    text = P.numeric_string(F.col("n_chars").cast("string"))
    return read_table(spark, sf_dir, "documents").agg(F.min(text).alias("least"), F.max(text).alias("greatest"))


@register("agg_07_quality_score", "SELECT round((1 - 0.3 * (c_custkey < 0.95)::INT + 4) / 5, 6) AS score FROM (SELECT count(DISTINCT c_custkey) / count(c_custkey) AS c_custkey FROM customer)")
def quality(spark, sf_dir):
    df = read_table(spark, sf_dir, "customer")
    return P.quality_score(df.withColumnRenamed("c_nationkey", "c_nation"))


@register("agg_08_normal_form", "SELECT '3NF' AS form")
def form(spark, sf_dir):
    df = read_table(spark, sf_dir, "orders")
    return spark.range(1).select(F.lit(P.normal_form(df, P.key_candidates(df))).alias("form"))


def _stats_sql(table: str, columns: list[str]) -> str:
    one = "SELECT '{c}' AS \"column\", count({c}) AS n, round(sum({c}), 4) AS sum, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS sd, round(min({c})::DOUBLE, 4) AS min, round(max({c})::DOUBLE, 4) AS max, round(quantile_cont({c}::DOUBLE, 0.25), 4) AS q25, round(quantile_cont({c}::DOUBLE, 0.5), 4) AS median, round(quantile_cont({c}::DOUBLE, 0.75), 4) AS q75, count(DISTINCT {c}) AS \"distinct\" FROM " + table
    return " UNION ALL ".join(one.format(c=f"{c}") for c in columns).replace("sum(", "sum(1.0::DOUBLE * ")


@register("agg_09_numeric_statistics", _stats_sql("lineitem", ["l_quantity", "l_extendedprice", "l_discount"]))
def statistics(spark, sf_dir):
    return P.numeric_statistics(read_table(spark, sf_dir, "lineitem").select("l_quantity", "l_extendedprice", "l_discount"))


@register("agg_10_column_stats", _stats_sql("part", ["p_size", "p_retailprice"]))
def column_stats(spark, sf_dir):
    return P.numeric_statistics(read_table(spark, sf_dir, "part").select("p_size", "p_retailprice"))


@register("agg_44_value_counts", "SELECT l_returnflag AS value, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM lineitem GROUP BY l_returnflag")
def counts(spark, sf_dir):
    return P.value_counts(read_table(spark, sf_dir, "lineitem"), "l_returnflag")


@register("agg_26_robust_mean", "SELECT l_returnflag, round(CASE WHEN count(l_tax) >= 5 AND stddev_pop(l_tax) / abs(avg(l_tax)) > 10 THEN median(l_tax) ELSE avg(l_tax) END, 6) AS mean FROM lineitem GROUP BY 1")
def robust(spark, sf_dir):
    return read_table(spark, sf_dir, "lineitem").select("l_returnflag", "l_tax").transform(lambda rows: P.robust_means(rows, ["l_returnflag"], "l_tax")).select("l_returnflag", F.round("m", 6).alias("mean"))


@register("fk_03_key_candidates")
def candidates(spark, sf_dir):
    return P.key_candidates(read_table(spark, sf_dir, "orders"))


@register("er_03_categorical_columns", "SELECT unnest(['o_orderstatus', 'o_orderpriority']) AS \"column\"")
def categorical(spark, sf_dir):
    found = P.categorical_columns(read_table(spark, sf_dir, "orders"))
    return spark.createDataFrame([(c,) for c in found], "column string")
