"""Insights over tables: distributions, segments, buckets, duplicates, delays, advertising figures and their ranking."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.operators.quantiles import quantiles
from quillstone.operators.profile import robust_means

#: Words in a status that tell of a problem, and those that are normal.
PROBLEM_WORDS = ("cancel", "fail", "error", "reject", "delay", "overdue", "return", "refund", "blocked", "suspended", "lost", "damaged")
WARNING_WORDS = ("pending", "hold", "waiting", "review", "partial")
TRUE_WORDS, FALSE_WORDS = ("true", "yes", "y", "1", "t", "on"), ("false", "no", "n", "0", "f", "off")
RISK_WORDS = ("high", "critical", "severe", "urgent")


def category_totals(df: DataFrame, category: str, metric: str, top: int = 5) -> DataFrame:
    """The top groups by sum, with n, sum, mean, sd and share of the whole."""
    g = df.groupBy(F.col(category).alias("category")).agg(F.count(metric).alias("n"), F.sum(metric).alias("sum"), F.avg(metric).alias("mean"), F.stddev_samp(metric).alias("sd"))
    whole = df.agg(F.sum(metric).alias("_whole"))
    g = g.orderBy(F.desc("sum"), "category").limit(top).crossJoin(F.broadcast(whole)).withColumn("share", F.col("sum") / F.col("_whole"))
    return g.select("category", "n", *(F.round(c, 4).alias(c) for c in ("sum", "mean", "sd", "share")))


def category_means(df: DataFrame, category: str, metric: str, top: int = 5, least: int = 3) -> DataFrame:
    g = df.groupBy(F.col(category).alias("category")).agg(F.count(metric).alias("n"), F.avg(metric).alias("mean")).where(F.col("n") >= least)
    return g.orderBy(F.desc("mean"), "category").limit(top).select("category", "n", F.round("mean", 4).alias("mean"))


def status_class(c: Column) -> Column:
    low = F.lower(c)
    return F.when(low.rlike("|".join(PROBLEM_WORDS)), "anomaly").when(low.rlike("|".join(WARNING_WORDS)), "warning").otherwise("normal")


def status_distribution(df: DataFrame, column: str) -> DataFrame:
    """Counts of lower-cased values with their class and whether a problem is frequent (100 rows or 5 %)."""
    g = df.where(F.col(column).isNotNull()).groupBy(F.lower(column).alias("status")).agg(F.count("*").alias("n"))
    g = g.crossJoin(F.broadcast(g.agg(F.sum("n").alias("_n")))).withColumn("share", F.col("n") / F.col("_n")).withColumn("kind", status_class(F.col("status")))
    return g.select("status", "n", F.round("share", 6).alias("share"), "kind", ((F.col("kind") == "anomaly") & ((F.col("n") >= 100) | (F.col("share") >= 0.05))).alias("problem"))


def flag_counts(df: DataFrame, column: str) -> DataFrame:
    """True, false and null of a flag; other numbers are true unless 0, what cannot be read is null."""
    low = F.lower(F.trim(F.col(column).cast("string")))
    number = low.try_cast("double")
    flag = F.when(low.isin(*TRUE_WORDS), True).when(low.isin(*FALSE_WORDS), False).when(number.isNotNull(), number != 0)
    return df.agg(F.count_if(flag).alias("true_n"), F.count_if(~flag).alias("false_n"), F.count_if(flag.isNull()).alias("null_n"), F.round(F.avg(flag.cast("int")), 6).alias("true_share"))


def distribution(df: DataFrame, column: str, top: int = 5) -> DataFrame:
    """The top values of a category, by number."""
    g = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    g = g.crossJoin(F.broadcast(g.agg(F.sum("n").alias("_n")))).withColumn("share", F.round(F.col("n") / F.col("_n"), 6)).drop("_n")
    return g.orderBy(F.desc("n"), "value").limit(top)


def risk_count(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.count("*").alias("n"), F.count_if(F.lower(column).rlike("|".join(RISK_WORDS))).alias("at_risk"))


def kpi_threshold(df: DataFrame, column: str) -> DataFrame:
    """A target by the scale of the values: .7 for shares, 70 for percentages, else the third quartile."""
    high = df.agg(F.max(column).cast("double")).first()[0]
    limit = None if high is None else 0.7 if high <= 1 else 70.0 if high <= 100 else quantiles(df, [column], [0.75])[column][0]
    return df.sparkSession.createDataFrame([(limit,)], "threshold double")


def low_performers(df: DataFrame, column: str) -> DataFrame:
    """How many rows are below the target, the mean, and the target."""
    t = kpi_threshold(df, column)
    return df.crossJoin(F.broadcast(t)).groupBy("threshold").agg(F.count(column).alias("n"), F.round(F.avg(column), 4).alias("mean"), F.count_if(F.col(column) < F.col("threshold")).alias("below")).select("n", "mean", F.round("threshold", 4).alias("threshold"), "below")


def missing_insight(df: DataFrame) -> DataFrame:
    row = df.agg(*(F.avg((F.col(f"`{c}`").isNull() | (F.col(f"`{c}`").cast("string") == "")).cast("int")).alias(c) for c in df.columns))
    out = row.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.round(F.col(f"`{c}`"), 6).alias("share")) for c in df.columns))).alias("x")).select("x.*")
    return out.where("share >= 0.2").withColumn("severity", F.when(F.col("share") >= 0.5, "high").otherwise("medium"))


def segment_gaps(df: DataFrame, category: str, metrics: list[str], least: int = 10) -> DataFrame:
    """For each metric: best and worst group of at least least rows by robust mean, their ratio and what it says."""
    longer = df.select(F.col(category).alias("category"), F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("x")) for m in metrics))).alias("p")).select("category", "p.*").where("x is not null and category is not null")
    g = robust_means(longer, ["metric", "category"], "x").where(F.col("n") >= least)
    out = g.groupBy("metric").agg(F.count("*").alias("groups"), F.max("m").alias("hi"), F.min("m").alias("lo"), F.max(F.struct("m", "category"))["category"].alias("best"), F.min(F.struct("m", "category"))["category"].alias("worst"))
    ratio = F.when(F.col("lo") > 0, F.col("hi") / F.col("lo"))
    return out.select("metric", "groups", "best", "worst", F.round("hi", 4).alias("hi"), F.round("lo", 4).alias("lo"), F.round(ratio, 4).alias("ratio"), F.when(ratio >= 2, "significant").when(ratio < 1.2, "no_effect").otherwise("moderate").alias("effect"))


def buckets(df: DataFrame, column: str, metric: str, n: int = 5, least: int = 10) -> DataFrame:
    """Mean of a metric in quantile buckets [lo, hi), the last one closed; equal edges are one."""
    x = F.col(column).cast("double")
    made = [q for q in quantiles(df, [column], [i / n for i in range(n + 1)])[column] if q is not None]
    edges = df.sparkSession.createDataFrame([(sorted(set(made)),)], "_e array<double>")
    at = F.least(F.size(F.filter("_e", lambda e: e <= x)), F.size("_e") - 1)
    g = df.where(x.isNotNull()).crossJoin(F.broadcast(edges)).withColumn("bucket", at).groupBy("bucket", "_e").agg(F.count(metric).alias("n"), F.round(F.avg(metric), 4).alias("mean"))
    return g.where(F.col("n") >= least).select("bucket", F.round(F.get("_e", F.col("bucket") - 1), 4).alias("lo"), F.round(F.get("_e", F.col("bucket")), 4).alias("hi"), "n", "mean")


def duplicate_ids(df: DataFrame, key: str) -> DataFrame:
    """Uniqueness of an identifier and how often those that repeat do."""
    g = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))
    return g.agg(F.round(F.count("*") / F.sum("n"), 6).alias("uniqueness"), F.count_if(F.col("n") > 1).alias("repeated"), F.max("n").alias("most"), F.round(F.avg(F.when(F.col("n") > 1, F.col("n"))), 4).alias("mean"))


def eta_squared(df: DataFrame, categories: list[str], outcomes: list[str], top: int = 5) -> DataFrame:
    """Categories by the share of the outcomes' variance that lies between their groups, averaged over outcomes."""
    parts = []
    for c in categories:
        g = df.where(F.col(c).isNotNull()).groupBy(c).agg(*(f.alias(f"{n}_{o}") for o in outcomes for n, f in (("n", F.count(o)), ("s", F.sum(o)), ("q", F.sum(F.col(o).cast("double") * F.col(o))))))
        shares = []
        for o in outcomes:
            n, s, q = F.sum(f"n_{o}"), F.sum(f"s_{o}"), F.sum(f"q_{o}")
            between = F.sum(F.col(f"s_{o}") * F.col(f"s_{o}") / F.col(f"n_{o}")) - s * s / n
            shares.append(between / (q - s * s / n))
        parts.append(g.agg(F.lit(c).alias("category"), F.round(reduce(lambda a, b: a + b, shares) / len(outcomes), 6).alias("eta")))
    return reduce(DataFrame.unionByName, parts).orderBy(F.desc("eta"), "category").limit(top)


def mean_ratio(df: DataFrame, numerator: str, denominator: str, name: str = "rate") -> DataFrame:
    """Mean of the rows' ratios where the denominator is positive: click-through, conversion, return on spend."""
    return df.where(F.col(denominator) > 0).agg(F.count("*").alias("n"), F.round(F.avg(F.col(numerator) / F.col(denominator)), 6).alias(name))


def positive_mean(df: DataFrame, column: str, micros: bool = False) -> DataFrame:
    """Mean of the positive values, as for cost per click; micros divides by a million."""
    x = F.col(column) / (1e6 if micros else 1.0)
    return df.where(F.col(column) > 0).agg(F.count("*").alias("n"), F.round(F.avg(x), 6).alias("mean"))


def cost_per(df: DataFrame, spend: str, conversions: str) -> DataFrame:
    return df.agg(F.round(F.sum(spend) / F.nullif(F.sum(conversions).cast("double"), F.lit(0.0)), 6).alias("cost"))


def graded_mean(df: DataFrame, column: str, limits: list[tuple[float, str]], above: str) -> DataFrame:
    """Mean and maximum of a column and the grade of the mean: limits are (below, grade) in order."""
    m = F.avg(column)
    grade = reduce(lambda w, x: w.when(m < x[0], x[1]), limits[1:], F.when(m < limits[0][0], limits[0][1])).otherwise(above)
    return df.agg(F.round(m, 4).alias("mean"), F.max(column).alias("max"), grade.alias("grade"))


def group_rate_anomalies(df: DataFrame, group: str, numerator: str, denominator: str, limit: float = 2.0) -> DataFrame:
    """Groups whose rate is over limit sample deviations from the mean of the groups' rates."""
    g = df.groupBy(group).agg(F.sum(numerator).alias("a"), F.sum(denominator).alias("b")).where("b > 0").select(group, (F.col("a") / F.col("b")).alias("rate"))
    g = g.crossJoin(F.broadcast(g.agg(F.avg("rate").alias("m"), F.stddev_samp("rate").alias("s"))))
    return g.where((F.col("s") > 0) & (F.abs(F.col("rate") - F.col("m")) > limit * F.col("s"))).select(group, F.round("rate", 6).alias("rate"), F.when(F.col("rate") > F.col("m"), "high").otherwise("low").alias("direction"))


def delays(df: DataFrame, expected: str, actual: str) -> DataFrame:
    late = F.to_date(actual) > F.to_date(expected)
    return df.where(F.col(expected).isNotNull() & F.col(actual).isNotNull()).agg(F.count("*").alias("n"), F.count_if(late).alias("late"), F.round(F.avg(late.cast("int")), 6).alias("share"))


def quantity_anomalies(df: DataFrame, column: str) -> DataFrame:
    """Negative values, and those over the mean by three sample deviations (reported if there are ten)."""
    stats = df.agg(F.avg(column).alias("_m"), F.stddev_samp(column).alias("_s"))
    out = df.crossJoin(F.broadcast(stats)).agg(F.count_if(F.col(column) < 0).alias("negative"), F.count_if(F.col(column) > F.col("_m") + 3 * F.col("_s")).alias("large"))
    return out.withColumn("reported", F.col("large") >= 10)


def consolidate(insights: DataFrame, top: int = 5) -> DataFrame:
    """Insights (kind, column, direction, score) without repeats, the top of each kind, contradictions marked."""
    once = insights.dropDuplicates(["kind", "column", "direction"])
    rank = F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("score"), "column", "direction"))
    sides = F.size(F.collect_set("direction").over(Window.partitionBy("column")))
    return once.withColumn("contradicted", sides > 1).withColumn("rank", rank).where(F.col("rank") <= top)


SEVERITY = ("critical", "high", "medium", "low", "info")


def by_severity(insights: DataFrame) -> DataFrame:
    place = F.array_position(F.array(*map(F.lit, SEVERITY)), F.lower("severity"))
    return insights.orderBy(F.when(place == 0, len(SEVERITY) + 1).otherwise(place), *[c for c in insights.columns if c != "severity"])
