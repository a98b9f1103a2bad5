"""Correlation, experiments, tests and causal estimates. Data is reduced to sums by Spark; the driver solves small systems."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstone.operators.quantiles import quantiles
from quillstone.functions import distributions as D
from quillstone.functions.scalars import change
from quillstone.operators.overlap import ranked
from quillstone.storage import materialize

LIMIT_CONDITION = 1e-10


def correlation(df: DataFrame, a: str, b: str) -> tuple[float, float, int]:
    """(r, p, n) over rows where both are filled; under ten of them there is none."""
    row = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).agg(F.corr(a, b).alias("r"), F.count("*").alias("n")).first()
    if row.n < 10 or row.r is None:
        return 0.0, 1.0, row.n
    return row.r, D.correlation_p(row.r, row.n), row.n


def correlations(df: DataFrame, columns: list[str], least: float = 0.0) -> DataFrame:
    """All pairs in one pass: a, b, r, n."""
    pairs = list(combinations(columns, 2))
    both = [F.col(a).isNotNull() & F.col(b).isNotNull() for a, b in pairs]
    cells = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.round(F.corr(F.when(t, F.col(a)), F.when(t, F.col(b))), 6).alias("r"), F.count_if(t).alias("n")) for (a, b), t in zip(pairs, both, strict=True)]
    return df.agg(F.array(*cells).alias("x")).select(F.explode("x").alias("p")).select("p.*").where(F.abs("r") >= least)


def partial_correlation(df: DataFrame, a: str, b: str, given: str) -> DataFrame:
    """r, first-order partial r and the share of r that the third column explains, over the same rows."""
    rows = df.select(a, b, given).dropna()
    t = rows.agg(F.corr(a, b).alias("ab"), F.corr(a, given).alias("ac"), F.corr(b, given).alias("bc"))
    p = (F.col("ab") - F.col("ac") * F.col("bc")) / F.sqrt((1 - F.col("ac") * F.col("ac")) * (1 - F.col("bc") * F.col("bc")))
    drop = F.when(F.col("ab") != 0, 1 - F.abs(p) / F.abs("ab")).otherwise(0.0)
    return t.select(F.round("ab", 6).alias("r"), F.round(p, 6).alias("partial"), F.round(drop, 6).alias("reduction"), (drop > 0.4).alias("confounded"))


def effect_size(d: Column) -> Column:
    x = F.abs(d)
    return F.when(x < 0.2, "negligible").when(x < 0.5, "small").when(x < 0.8, "medium").otherwise("large")


def _compare(rows: DataFrame, outcome: str, high: Column, low: Column) -> DataFrame:
    """Means of two groups, effect in percent, Cohen's d and its label."""
    s = {}
    for name, test in (("hi", high), ("lo", low)):
        x = F.when(test, F.col(outcome).cast("double"))
        s |= {f"n_{name}": F.count(x), f"m_{name}": F.avg(x), f"v_{name}": F.var_samp(x)}
    t = rows.agg(*(e.alias(n) for n, e in s.items()))
    pooled = F.sqrt(((F.col("n_hi") - 1) * F.col("v_hi") + (F.col("n_lo") - 1) * F.col("v_lo")) / (F.col("n_hi") + F.col("n_lo") - 2))
    d = (F.col("m_hi") - F.col("m_lo")) / pooled
    return t.select("n_hi", "n_lo", F.round("m_hi", 4).alias("m_hi"), F.round("m_lo", 4).alias("m_lo"), F.round(100 * (F.col("m_hi") - F.col("m_lo")) / F.abs("m_lo"), 4).alias("effect"), F.round(d, 6).alias("d"), effect_size(d).alias("size"))


def quartile_experiment(df: DataFrame, driver: str, outcome: str) -> DataFrame:
    """Outcome above the driver's third quartile against below its first."""
    rows = df.select(F.col(driver).cast("double").alias("x"), F.col(outcome).alias("y")).dropna()
    q1, q3 = (F.lit(q).cast("double") for q in quantiles(rows, ["x"], [0.25, 0.75])["x"])
    return _compare(rows, "y", F.col("x") >= q3, F.col("x") <= q1)


def threshold_experiments(df: DataFrame, driver: str, outcome: str) -> DataFrame:
    """Above against below each of the three smallest of: quartiles, median, mean, mean + sd (rounded to two places)."""
    rows = df.select(F.col(driver).cast("double").alias("x"), F.col(outcome).cast("double").alias("y")).dropna()
    r, q = rows.agg(F.avg("x").alias("m"), F.stddev_samp("x").alias("s")).first(), quantiles(rows, ["x"], [0.25, 0.5, 0.75])["x"]
    if r.m is None:
        return rows.sparkSession.createDataFrame([], "threshold double, n_above long, n_below long, m_above double, m_below double")
    cuts = sorted({round(v, 2) for v in (*q, r.m, r.m + (r.s or 0.0))})[:3]
    cells = [F.struct(F.lit(c).alias("threshold"), F.count_if(F.col("x") > c).alias("n_above"), F.count_if(F.col("x") <= c).alias("n_below"), F.round(F.avg(F.when(F.col("x") > c, F.col("y"))), 4).alias("m_above"), F.round(F.avg(F.when(F.col("x") <= c, F.col("y"))), 4).alias("m_below")) for c in cuts]
    return rows.agg(F.array(*cells).alias("x")).select(F.explode("x").alias("p")).select("p.*")


def poisson_bootstrap(df: DataFrame, a: str, b: str, key: str, draws: int = 200, seed: int = 42, level: float = 0.95) -> DataFrame:
    """Interval of the correlation. Each draw weighs rows by Poisson numbers from a hash of row and draw: one aggregation."""
    rows = df.select(key, F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y")).dropna()
    u = F.pmod(F.xxhash64(F.lit(seed), key, "draw"), F.lit(1 << 30)) / float(1 << 30)
    cuts, total, p = [], 0.0, np.exp(-1.0)
    for k in range(8):
        total += p
        cuts.append(total)
        p /= k + 1
    weight = sum(((u > c).cast("int") for c in cuts), F.lit(0))
    many = rows.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws)))).withColumn("w", weight)
    s = many.groupBy("draw").agg(*(F.sum(F.col("w") * e).alias(n) for n, e in (("n", F.lit(1.0)), ("sx", F.col("x")), ("sy", F.col("y")), ("xx", F.col("x") * F.col("x")), ("yy", F.col("y") * F.col("y")), ("xy", F.col("x") * F.col("y")))))
    r = (F.col("n") * F.col("xy") - F.col("sx") * F.col("sy")) / F.sqrt((F.col("n") * F.col("xx") - F.col("sx") * F.col("sx")) * (F.col("n") * F.col("yy") - F.col("sy") * F.col("sy")))
    tail = (1 - level) / 2
    return s.agg(F.count("*").alias("draws"), F.round(F.percentile(r, tail), 4).alias("low"), F.round(F.percentile(r, 1 - tail), 4).alias("high"))


def welch(df: DataFrame, group: str, a: object, b: object, outcome: str) -> DataFrame:
    """Welch's test of two groups: n, means, difference, t, degrees of freedom and an exact p."""
    rows = df.where(F.col(group).isin(a, b)).groupBy(group).agg(F.count(outcome).alias("n"), F.avg(outcome).alias("m"), F.var_samp(outcome).alias("v"))
    found = {r[group]: r for r in rows.collect()}
    x, y = found[a], found[b]
    se2 = x.v / x.n + y.v / y.n
    t = (x.m - y.m) / np.sqrt(se2)
    dof = se2**2 / ((x.v / x.n) ** 2 / (x.n - 1) + (y.v / y.n) ** 2 / (y.n - 1))
    out = (x.n, y.n, round(x.m, 6), round(y.m, 6), round(x.m - y.m, 6), round(float(t), 6), round(float(dof), 4), float(D.t_two_sided(float(t), float(dof))))
    return df.sparkSession.createDataFrame([out], "n_a long, n_b long, m_a double, m_b double, difference double, t double, dof double, p double")


def stratified_effect(df: DataFrame, treatment: Column, outcome: str, strata: list[str], least: int = 3) -> DataFrame:
    """Naive difference of means, and the mean of the strata's differences weighted by their rows (strata with both arms)."""
    rows = df.select(treatment.cast("int").alias("_t"), F.col(outcome).cast("double").alias("_y"), *strata).where("_t is not null and _y is not null")
    g = rows.groupBy(*strata).agg(F.count("*").alias("n"), F.count_if(F.col("_t") == 1).alias("n1"), F.count_if(F.col("_t") == 0).alias("n0"), F.avg(F.when(F.col("_t") == 1, F.col("_y"))).alias("m1"), F.avg(F.when(F.col("_t") == 0, F.col("_y"))).alias("m0"))
    ok = (F.col("n1") >= least) & (F.col("n0") >= least)
    s1, s0 = F.sum(F.coalesce(F.col("m1") * F.col("n1"), F.lit(0.0))), F.sum(F.coalesce(F.col("m0") * F.col("n0"), F.lit(0.0)))
    naive = s1 / F.sum("n1") - s0 / F.sum("n0")
    ate = F.sum(F.when(ok, F.col("n") * (F.col("m1") - F.col("m0")))) / F.sum(F.when(ok, F.col("n")))
    return g.agg(F.round(naive, 6).alias("naive"), F.round(ate, 6).alias("ate"), F.count_if(ok).alias("strata"))


def normal_equations(df: DataFrame, features: list[Column], outcome: Column, weight: Column | None = None) -> tuple[np.ndarray, np.ndarray, float, int]:
    """X'X, X'y, y'y and n of a regression with intercept, by one aggregation."""
    w = weight if weight is not None else F.lit(1.0)
    x = [F.lit(1.0), *(f.cast("double") for f in features)]
    y = outcome.cast("double")
    ij = [(i, j) for i in range(len(x)) for j in range(i, len(x))]
    row = df.agg(*(F.sum(w * x[i] * x[j]).alias(f"x{i}_{j}") for i, j in ij), *(F.sum(w * x[i] * y).alias(f"y{i}") for i in range(len(x))), F.sum(w * y * y).alias("yy"), F.count("*").alias("n")).first()
    xx = np.zeros((len(x), len(x)))
    for i, j in ij:
        xx[i, j] = xx[j, i] = row[f"x{i}_{j}"] or 0.0
    return xx, np.array([row[f"y{i}"] or 0.0 for i in range(len(x))]), row.yy or 0.0, row.n


def least_squares(df: DataFrame, features: list[Column], outcome: Column) -> tuple[np.ndarray, float, int]:
    """Coefficients (intercept first), residual sum of squares, n."""
    xx, xy, yy, n = normal_equations(df, features, outcome)
    beta = np.linalg.lstsq(xx, xy, rcond=LIMIT_CONDITION)[0]
    return beta, float(max(0.0, yy - beta @ xy)), n


def linear(beta: np.ndarray, features: list[Column]) -> Column:
    return sum((float(b) * f for b, f in zip(beta[1:], features, strict=True)), F.lit(float(beta[0])))


def propensity(df: DataFrame, treatment: Column, features: list[Column], rounds: int = 25, ridge: float = 1e-6) -> np.ndarray:
    """Logistic regression by Newton's method: one aggregation a round."""
    beta = np.zeros(len(features) + 1)
    x = [F.lit(1.0), *(f.cast("double") for f in features)]
    for _ in range(rounds):
        p = 1 / (1 + F.exp(-linear(beta, x[1:])))
        w, g = p * (1 - p), treatment.cast("double") - p
        ij = [(i, j) for i in range(len(x)) for j in range(i, len(x))]
        row = df.agg(*(F.sum(w * x[i] * x[j]).alias(f"h{i}_{j}") for i, j in ij), *(F.sum(g * x[i]).alias(f"g{i}") for i in range(len(x)))).first()
        h = np.zeros((len(x), len(x)))
        for i, j in ij:
            h[i, j] = h[j, i] = row[f"h{i}_{j}"]
        step = np.linalg.solve(h + ridge * np.eye(len(x)), np.array([row[f"g{i}"] for i in range(len(x))]))
        beta += step
        if np.abs(step).max() < 1e-9:
            break
    return beta


def treatment_effects(df: DataFrame, treatment: Column, outcome: str, features: list[Column]) -> DataFrame:
    """Average effect by weighting (propensities kept in .01 .. .99), by regression, and doubly robust."""
    rows = df.withColumn("_t", treatment.cast("double")).withColumn("_y", F.col(outcome).cast("double")).where("_t is not null and _y is not null")
    e = F.least(F.greatest(1 / (1 + F.exp(-linear(propensity(rows, F.col("_t"), features), features))), F.lit(0.01)), F.lit(0.99))
    mu = [linear(least_squares(rows.where(F.col("_t") == k), features, F.col("_y"))[0], features) for k in (0.0, 1.0)]
    t, y = F.col("_t"), F.col("_y")
    ipw = F.sum(t * y / e) / F.sum(t / e) - F.sum((1 - t) * y / (1 - e)) / F.sum((1 - t) / (1 - e))
    regression = F.avg(mu[1] - mu[0])
    robust = F.avg(mu[1] - mu[0] + t * (y - mu[1]) / e - (1 - t) * (y - mu[0]) / (1 - e))
    return rows.agg(F.round(ipw, 4).alias("ipw"), F.round(regression, 4).alias("regression"), F.round(robust, 4).alias("doubly_robust"))


def conditional_effects(df: DataFrame, treatment: Column, outcome: str, features: list[Column], learner: str = "t") -> Column:
    """A column with each row's effect: s (one model with interactions) or t (a model for each arm)."""
    rows = df.withColumn("_t", treatment.cast("double")).where(F.col("_t").isNotNull() & F.col(outcome).isNotNull())
    if learner == "t":
        mu = [linear(least_squares(rows.where(F.col("_t") == k), features, F.col(outcome))[0], features) for k in (0.0, 1.0)]
        return mu[1] - mu[0]
    t = F.col("_t")
    beta = least_squares(rows, [*features, t, *(f * t for f in features)], F.col(outcome))[0]
    k = len(features)
    return linear(np.r_[beta[k + 1], beta[k + 2 :]], features)


def sensitivity(se: float, r2_outcome: float, r2_treatment: float) -> float:
    """Bias that an unseen confounder of that strength could make."""
    return float(np.sqrt(r2_outcome * r2_treatment) * se * 5)


def granger(df: DataFrame, order: str, x: str, y: str, lag: int = 2) -> DataFrame:
    """Whether lags of x help to predict y beyond y's own: F, p. Lags are taken over the whole ordered series."""
    rows = ranked(df.select(order, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")), [order])
    for k in range(1, lag + 1):
        back = rows.select((F.col("rank") + k).alias("rank"), F.col("_x").alias(f"x{k}"), F.col("_y").alias(f"y{k}"))
        rows = rows.join(back.select("rank", f"x{k}", f"y{k}"), "rank")
    own, both = [F.col(f"y{k}") for k in range(1, lag + 1)], [F.col(f"{v}{k}") for v in "yx" for k in range(1, lag + 1)]
    _, r0, n = least_squares(rows, own, F.col("_y"))
    _, r1, _ = least_squares(rows, both, F.col("_y"))
    dof = n - 2 * lag - 1
    f = ((r0 - r1) / lag) / (r1 / dof) if r1 > 0 and dof > 0 else 0.0
    return df.sparkSession.createDataFrame([(lag, n, round(f, 6), D.f_upper(f, lag, dof))], "lag int, n long, f double, p double")


def causal_skeleton(df: DataFrame, columns: list[str], alpha: float = 0.05) -> list[tuple[str, str]]:
    """Edges of the PC algorithm's skeleton from one correlation matrix; partial correlations come from its inverse blocks."""
    found = {(r.a, r.b): r.r for r in correlations(df.dropna(subset=columns), columns).collect()}
    n = df.dropna(subset=columns).count()
    matrix = np.eye(len(columns))
    for (a, b), r in found.items():
        i, j = columns.index(a), columns.index(b)
        matrix[i, j] = matrix[j, i] = r or 0.0
    edges = set(combinations(range(len(columns)), 2))
    for depth in range(len(columns) - 1):
        for i, j in sorted(edges):
            near = [k for k in range(len(columns)) if k not in (i, j) and ((min(i, k), max(i, k)) in edges or (min(j, k), max(j, k)) in edges)]
            for given in combinations(near, depth):
                at = [i, j, *given]
                inverse = np.linalg.pinv(matrix[np.ix_(at, at)])
                r = float(np.clip(-inverse[0, 1] / np.sqrt(inverse[0, 0] * inverse[1, 1]), -0.999999, 0.999999))
                z = abs(np.arctanh(r)) * np.sqrt(max(n - len(given) - 3, 1))
                if 2 * (1 - D.normal_cdf(float(z))) > alpha:
                    edges.discard((i, j))
                    break
    return [(columns[i], columns[j]) for i, j in sorted(edges)]


def kolmogorov_smirnov(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """Largest distance of the two empirical distributions. Values are counted first; only distinct ones are ordered, by ranges."""
    x = a.select(F.col(column).cast("double").alias("v")).dropna().groupBy("v").agg(F.count("*").alias("p"))
    y = b.select(F.col(column).cast("double").alias("v")).dropna().groupBy("v").agg(F.count("*").alias("q"))
    both = x.join(y, "v", "full").fillna(0, ["p", "q"])
    n = int(both.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = materialize(both.repartitionByRange(n, "v").withColumn("_p", F.spark_partition_id()), "ranges")
    inner = Window.partitionBy("_p").orderBy("v")
    sums = parts.groupBy("_p").agg(F.sum("p").alias("sp"), F.sum("q").alias("sq"))
    earlier = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = sums.select("_p", F.coalesce(F.sum("sp").over(earlier), F.lit(0)).alias("bp"), F.coalesce(F.sum("sq").over(earlier), F.lit(0)).alias("bq"), F.sum("sp").over(every).alias("np"), F.sum("sq").over(every).alias("nq"))
    run = parts.withColumn("cp", F.sum("p").over(inner)).withColumn("cq", F.sum("q").over(inner)).join(F.broadcast(before), "_p")
    gap = F.abs((F.col("bp") + F.col("cp")) / F.col("np") - (F.col("bq") + F.col("cq")) / F.col("nq"))
    return run.agg(F.round(F.max(gap), 6).alias("ks"))


def levene(df: DataFrame, group: str, column: str) -> DataFrame:
    """Levene's W over groups, with deviations from the groups' means."""
    m = df.groupBy(group).agg(F.avg(column).alias("_m"))
    z = df.join(F.broadcast(m), group).select(group, F.abs(F.col(column) - F.col("_m")).alias("z")).where("z is not null")
    g = z.groupBy(group).agg(F.count("*").alias("n"), F.avg("z").alias("m"), F.sum(F.col("z") * F.col("z")).alias("q"))
    t = g.agg(F.sum("n").alias("N"), F.count("*").alias("k"), F.sum(F.col("n") * F.col("m")).alias("s"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("b"), F.sum("q").alias("q"))
    between = F.col("b") - F.col("s") * F.col("s") / F.col("N")
    within = F.col("q") - F.col("b")
    return t.select(F.round((F.col("N") - F.col("k")) / (F.col("k") - 1) * between / within, 6).alias("w"))


def what_if(df: DataFrame, column: str, kind: str, value: float, condition: Column | None = None, runs: int = 0, noise: float = 0.05, seed: int = 0, key: str | None = None) -> DataFrame:
    """Mean, deviation and change of a column under a change; runs > 0 adds normal noise to the changed values, run by run."""
    test = condition if condition is not None else F.lit(True)
    x = F.col(column).cast("double")
    rows = df.select(x.alias("before"), F.when(test, change(x, kind, value)).otherwise(x).alias("after"), test.alias("hit"), *([key] if key else []))
    if runs:
        u = [F.pmod(F.xxhash64(F.lit(seed + k), "run", key or "before"), F.lit(1 << 30)) / float(1 << 30) for k in (0, 1)]
        normal = F.sqrt(-2 * F.log(F.greatest(u[0], F.lit(1e-12)))) * F.cos(2 * np.pi * u[1])
        rows = rows.withColumn("run", F.explode(F.sequence(F.lit(1), F.lit(runs)))).withColumn("after", F.when(F.col("hit"), F.col("after") * (1 + noise * normal)).otherwise(F.col("after")))
    moved = 100 * (F.avg("after") - F.avg("before")) / F.abs(F.avg("before"))
    return rows.agg(F.round(F.avg("before"), 4).alias("mean_before"), F.round(F.avg("after"), 4).alias("mean_after"), F.round(F.stddev_samp("after"), 4).alias("sd_after"), F.round(moved, 4).alias("change"), F.when(moved > 5, "up").when(moved < -5, "down").otherwise("stable").alias("class"))


def scenarios(df: DataFrame, column: str, options: dict[str, tuple[str, float]]) -> DataFrame:
    """Scenarios by the size of their change, with a risk score capped at 1."""
    x = F.col(column).cast("double")
    cells = [F.struct(F.lit(n).alias("scenario"), (100 * (F.avg(change(x, k, v)) - F.avg(x)) / F.abs(F.avg(x))).alias("c")) for n, (k, v) in options.items()]
    out = df.agg(F.array(*cells).alias("x")).select(F.explode("x").alias("p")).select("p.scenario", F.round("p.c", 4).alias("change"), F.round(F.least(F.abs("p.c") / 100, F.lit(1.0)), 4).alias("risk"))
    return out.orderBy(F.desc(F.abs("change")), "scenario")


def cash_flow(spark: SparkSession, investment: float, costs: list[float], benefits: list[float], annual_rate: float = 0.1) -> DataFrame:
    """Month by month: net flow, running sum and discounted running sum."""
    rows = [(0, -float(investment))] + [(m + 1, float(b - c)) for m, (c, b) in enumerate(zip(costs, benefits, strict=True))]
    df = spark.createDataFrame(rows, "month int, flow double")
    w = Window.orderBy("month").rowsBetween(Window.unboundedPreceding, 0)
    return df.select("month", "flow", F.round(F.sum("flow").over(w), 4).alias("cumulative"), F.round(F.sum(F.col("flow") / F.pow(F.lit(1 + annual_rate / 12), "month")).over(w), 4).alias("npv"))


def internal_rate(flows: list[float]) -> float | None:
    """Monthly rate at which the flows' present value is nought, by bisection; None if there is no change of sign."""
    value = lambda r: sum(f / (1 + r) ** k for k, f in enumerate(flows))
    lo, hi = -0.99, 10.0
    if value(lo) * value(hi) > 0:
        return None
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if value(lo) * value(mid) > 0 else (lo, mid)
    return (lo + hi) / 2


def tornado(base: float, variables: dict[str, float], impact, swing: float = 0.2) -> list[tuple[str, float, float]]:
    """(variable, low, high) of a result when each variable alone moves by swing, the widest first."""
    out = [(n, impact(variables | {n: v * (1 - swing)}), impact(variables | {n: v * (1 + swing)})) for n, v in variables.items()]
    return sorted(out, key=lambda x: -abs(x[2] - x[1]))


def bootstrap_means(df: DataFrame, group: str, column: str, draws: int = 500, seed: int = 42) -> DataFrame:
    """Interval of each group's mean. Groups are summed to mean and deviation by Spark; draws are of the mean's distribution."""
    g = df.groupBy(group).agg(F.count(column).alias("n"), F.avg(column).alias("m"), F.stddev_samp(column).alias("s"))

    def run(batches):
        for pdf in batches:
            rng = np.random.default_rng(seed)
            draws_ = rng.standard_normal((len(pdf), draws)) * (pdf["s"] / np.sqrt(pdf["n"])).to_numpy()[:, None] + pdf["m"].to_numpy()[:, None]
            yield pd.DataFrame({"group": pdf[group].astype(str), "low": np.percentile(draws_, 2.5, axis=1), "high": np.percentile(draws_, 97.5, axis=1)})

    return g.where("n > 1").mapInPandas(run, "group string, low double, high double")


def significant_experiments(df: DataFrame, columns: list[str], top: int = 10, least: float = 0.2) -> DataFrame:
    """The quartile experiment of each of the most correlated pairs; those whose effect is at least small."""
    pairs = correlations(df, columns).orderBy(F.desc(F.abs("r")), "a", "b").limit(top).collect()  # a report of top pairs
    out = None
    for p in pairs:
        one = quartile_experiment(df, p.a, p.b).withColumns({"driver": F.lit(p.a), "outcome": F.lit(p.b)})
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("there are no pairs of columns")
    return out.where(F.abs("d") >= least)


def what_if_impacts(df: DataFrame, changes: dict[str, Column], limit: float = 0.05, top: int = 20) -> DataFrame:
    """(column, before, after, change, kind): the effect of changed columns on their means, the largest first; within 5 % it is neutral."""
    row = df.agg(*(x for k, (c, made) in enumerate(changes.items()) for x in (F.avg(c).alias(f"b{k}"), F.avg(made).alias(f"a{k}"), F.stddev_pop(made).alias(f"s{k}"))))
    cells = [F.struct(F.lit(c).alias("column"), F.round(f"b{k}", 4).alias("before"), F.round(f"a{k}", 4).alias("after"), F.round(f"s{k}", 4).alias("sd"), F.round((F.col(f"a{k}") - F.col(f"b{k}")) / F.abs(f"b{k}"), 6).alias("change")) for k, c in enumerate(changes)]
    out = row.select(F.explode(F.array(*cells)).alias("p")).select("p.*")
    kind = F.when(F.col("change") > limit, "positive").when(F.col("change") < -limit, "negative").otherwise("neutral")
    return out.withColumn("kind", kind).orderBy(F.desc(F.abs("change")), "column").limit(top)


#: Factors of the usual scenarios and how likely each is.
SCENARIO_FACTORS = (("conservative", 0.5, 0.3), ("moderate", 1.0, 0.5), ("optimistic", 1.5, 0.2))


def improvement_scenarios(df: DataFrame, column: str, improvement: float = 0.15, months: int = 12) -> DataFrame:
    """(scenario, month, value): the column's mean as it would rise in even steps to each scenario's improvement."""
    base = df.agg(F.avg(column).alias("m"))
    cells = F.array(*(F.struct(F.lit(n).alias("scenario"), F.lit(f).alias("factor"), F.lit(p).alias("likelihood")) for n, f, p in SCENARIO_FACTORS))
    rows = base.select("m", F.explode(cells).alias("x")).select("m", "x.*", F.explode(F.sequence(F.lit(1), F.lit(months))).alias("month"))
    return rows.select("scenario", "likelihood", "month", F.round(F.col("m") * (1 + improvement * F.col("factor") * F.col("month") / months), 4).alias("value"))
