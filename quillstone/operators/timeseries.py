"""Time series: trend, change points, seasonality, decomposition and forecasts. Order is always an explicit key.

Many series are handled as groups; one series is at most what one group holds, as for any per-series model.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def indexed(df: DataFrame, order: str, value: str, series: str | None = None) -> DataFrame:
    """(series, i, value) with i from 0 in order within each series."""
    s = F.col(series) if series else F.lit("all")
    w = Window.partitionBy("series").orderBy("t")
    return df.select(s.cast("string").alias("series"), F.col(order).alias("t"), F.col(value).cast("double").alias("value")).where("value is not null").withColumn("i", (F.row_number().over(w) - 1).cast("long"))


def trend(rows: DataFrame) -> DataFrame:
    """Slope, R squared and direction of each series: over 1 % of the mean a step is a trend; under 10 points it is stable."""
    g = rows.groupBy("series").agg(F.count("*").alias("n"), F.regr_slope("value", "i").alias("slope"), F.regr_r2("value", "i").alias("r2"), F.avg("value").alias("m"))
    rel = F.col("slope") / F.abs("m")
    return g.select("series", "n", F.round("slope", 6).alias("slope"), F.round("r2", 6).alias("r2"), F.when((F.col("n") < 10) | (F.col("m") == 0), "stable").when(rel > 0.01, "up").when(rel < -0.01, "down").otherwise("stable").alias("direction"))


def change_points(rows: DataFrame, window: int = 10, limit: float = 0.3) -> DataFrame:
    """The first index of each run at which the mean of the next points differs from that of the points before by over 30 %."""
    w = Window.partitionBy("series").orderBy("i")
    before, after = w.rowsBetween(-window, -1), w.rowsBetween(0, window - 1)
    t = rows.withColumns({"b": F.avg("value").over(before), "a": F.avg("value").over(after), "nb": F.count("value").over(before), "na": F.count("value").over(after)})
    hits = t.where((F.col("nb") == window) & (F.col("na") == window) & (F.col("b") != 0) & (F.abs(F.col("a") - F.col("b")) > limit * F.abs("b")))
    return hits.withColumn("p", F.lag("i").over(w)).where(F.col("p").isNull() | (F.col("i") - F.col("p") > 1)).select("series", "i", F.round("b", 4).alias("before"), F.round("a", 4).alias("after"))


def autocorrelation(rows: DataFrame, lags: list[int]) -> DataFrame:
    """(series, lag, r) by a join of each series with itself for each lag."""
    stats = rows.groupBy("series").agg(F.avg("value").alias("m"), F.var_pop("value").alias("v"), F.count("*").alias("n"))
    at = rows.join(stats, "series").select("series", "i", "n", (F.col("value") - F.col("m")).alias("d"), "v")
    back = at.select("series", F.explode(F.array(*(F.struct(F.lit(k).alias("lag"), (F.col("i") + k).alias("i"), F.col("d").alias("e")) for k in lags))).alias("x")).select("series", "x.*")
    both = at.join(back, ["series", "i"])
    return both.groupBy("series", "lag").agg(F.round(F.sum(F.col("d") * F.col("e")) / F.first(F.col("n") * F.col("v")), 6).alias("r"))


def seasonality(rows: DataFrame, most: int = 60, least: float = 0.1) -> DataFrame:
    """The lag of the strongest peak of each series' autocorrelation."""
    r = autocorrelation(rows, list(range(1, most + 1)))
    w = Window.partitionBy("series").orderBy("lag")
    peaks = r.withColumn("p", F.lag("r").over(w)).withColumn("q", F.lead("r").over(w)).where((F.col("lag") >= 2) & (F.col("r") > F.col("p")) & (F.col("r") >= F.col("q")) & (F.col("r") > least))
    best = peaks.withColumn("k", F.row_number().over(Window.partitionBy("series").orderBy(F.desc("r"), "lag"))).where("k = 1")
    return best.select("series", F.col("lag").alias("period"), "r")


def periodic_strength(rows: DataFrame, period: int) -> DataFrame:
    """Share of the variance that lies between the phases of a period."""
    g = rows.groupBy("series", (F.col("i") % period).alias("phase")).agg(F.count("*").alias("n"), F.avg("value").alias("m"), F.sum(F.col("value") * F.col("value")).alias("q"))
    t = g.groupBy("series").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("m")).alias("s"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("b"), F.sum("q").alias("q"))
    mean2 = F.col("s") * F.col("s") / F.col("n")
    return t.select("series", F.round((F.col("b") - mean2) / (F.col("q") - mean2), 6).alias("strength"))


def decompose(rows: DataFrame, period: int = 7) -> DataFrame:
    """Additive: a centred moving average (odd period), the phases' mean of what is left, and the rest."""
    half = period // 2
    w = Window.partitionBy("series").orderBy("i").rowsBetween(-half, half)
    t = rows.withColumn("trend", F.when(F.count("value").over(w) == 2 * half + 1, F.avg("value").over(w)))
    t = t.withColumn("phase", F.col("i") % period)
    s = t.where("trend is not null").groupBy("series", "phase").agg(F.avg(F.col("value") - F.col("trend")).alias("season"))
    out = t.join(s, ["series", "phase"])
    return out.select("series", "i", F.round("trend", 4).alias("trend"), F.round("season", 4).alias("season"), F.round(F.col("value") - F.col("trend") - F.col("season"), 4).alias("rest"))


def moving_forecast(rows: DataFrame, horizon: int, last: int = 7) -> DataFrame:
    """Mean of the last points plus slope times the step, with +- 1.96 population deviations."""
    w = Window.partitionBy("series").orderBy(F.desc("i"))
    tail = rows.withColumn("k", F.row_number().over(w)).where(F.col("k") <= last).groupBy("series").agg(F.avg("value").alias("base"))
    g = rows.groupBy("series").agg(F.regr_slope("value", "i").alias("slope"), F.stddev_pop("value").alias("sd")).join(tail, "series")
    out = g.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(horizon - 1))))
    f = F.col("base") + F.col("slope") * F.col("step")
    return out.select("series", "step", F.round(f, 4).alias("forecast"), F.round(f - 1.96 * F.col("sd"), 4).alias("low"), F.round(f + 1.96 * F.col("sd"), 4).alias("high"))


def holt_winters(y: np.ndarray, horizon: int, period: int = 12, alpha: float = 0.3, beta: float = 0.1, gamma: float = 0.1) -> np.ndarray:
    """Multiplicative seasonal smoothing; without two whole periods, level and trend only."""
    if len(y) == 0:
        return np.zeros(horizon)
    seasonal = len(y) >= 2 * period and np.all(y[:period] > 0)
    if not seasonal:
        level, slope = y[0], (y[1] - y[0]) if len(y) > 1 else 0.0
        for v in y[1:]:
            old = level
            level = alpha * v + (1 - alpha) * (level + slope)
            slope = beta * (level - old) + (1 - beta) * slope
        return level + slope * np.arange(1, horizon + 1)
    level, slope = y[:period].mean(), (y[period : 2 * period].mean() - y[:period].mean()) / period
    season = list(y[:period] / level)
    for k in range(period, len(y)):
        old, s = level, season[k - period]
        level = alpha * y[k] / s + (1 - alpha) * (level + slope)
        slope = beta * (level - old) + (1 - beta) * slope
        season.append(gamma * y[k] / level + (1 - gamma) * s)
    return np.array([(level + slope * h) * season[len(y) - period + (h - 1) % period] for h in range(1, horizon + 1)])


def autoregressive(y: np.ndarray, horizon: int, p: int = 2) -> np.ndarray:
    """AR(p) on first differences by the Yule-Walker equations."""
    d = np.diff(y)
    if len(d) <= p or np.allclose(d, d.mean() if len(d) else 0.0):
        step = d.mean() if len(d) else 0.0
        return (y[-1] if len(y) else 0.0) + step * np.arange(1, horizon + 1)
    c = d - d.mean()
    r = np.array([c[: len(c) - k] @ c[k:] / len(c) for k in range(p + 1)])
    phi = np.linalg.lstsq(np.array([[r[abs(i - j)] for j in range(p)] for i in range(p)]), r[1:], rcond=1e-10)[0]
    past, out, level = list(c[-p:][::-1]), [], y[-1]
    for _ in range(horizon):
        step = float(phi @ np.array(past[:p]))
        past.insert(0, step)
        level += step + d.mean()
        out.append(level)
    return np.array(out)


MODELS = {"holt_winters": holt_winters, "autoregressive": autoregressive, "ensemble": lambda y, h: 0.6 * holt_winters(y, h) + 0.4 * autoregressive(y, h)}


def forecast(rows: DataFrame, horizon: int, model: str = "ensemble") -> DataFrame:
    """(series, step, forecast) for every series, one group each."""
    own = MODELS[model]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        made = own(pdf.sort_values("i")["value"].to_numpy(), horizon)
        return pd.DataFrame({"series": pdf["series"].iloc[0], "step": np.arange(1, horizon + 1, dtype=np.int32), "forecast": made})

    return rows.groupBy("series").applyInPandas(run, "series string, step int, forecast double")


def holdout_metrics(rows: DataFrame, horizon: int, model: str = "ensemble") -> DataFrame:
    """Errors of a model that saw all but the last horizon points; percentages over the points that are not 0."""
    n = rows.groupBy("series").agg(F.max("i").alias("last"))
    marked = rows.join(n, "series")
    train, test = marked.where(F.col("i") <= F.col("last") - horizon), marked.where(F.col("i") > F.col("last") - horizon)
    made = forecast(train.select("series", "i", "value"), horizon, model)
    both = test.withColumn("step", (F.col("i") - F.col("last") + horizon).cast("int")).join(made, ["series", "step"])
    e = F.col("forecast") - F.col("value")
    pct = F.when(F.col("value") != 0, F.abs(e / F.col("value")))
    smape = F.when(F.abs("value") + F.abs("forecast") > 0, 2 * F.abs(e) / (F.abs("value") + F.abs("forecast")))
    return both.groupBy("series").agg(F.round(F.avg(F.abs(e)), 4).alias("mae"), F.round(F.sqrt(F.avg(e * e)), 4).alias("rmse"), F.round(F.avg(pct), 6).alias("mape"), F.round(F.avg(smape), 6).alias("smape"))


def bootstrap_interval(rows: DataFrame, horizon: int, draws: int = 100, level: float = 0.95, seed: int = 42) -> DataFrame:
    """Forecasts with an interval from resampled residuals of a linear trend."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        x, y = pdf["i"].to_numpy(float), pdf["value"].to_numpy()
        slope, base = np.polyfit(x, y, 1) if len(x) > 1 else (0.0, y[0])
        steps = x[-1] + np.arange(1, horizon + 1)
        made = base + slope * steps
        rest = y - (base + slope * x)
        sims = made + np.random.default_rng(seed).choice(rest, (draws, horizon))
        lo, hi = np.percentile(sims, [50 * (1 - level), 100 - 50 * (1 - level)], axis=0)
        return pd.DataFrame({"series": pdf["series"].iloc[0], "step": np.arange(1, horizon + 1, dtype=np.int32), "forecast": made, "low": lo, "high": hi})

    return rows.groupBy("series").applyInPandas(run, "series string, step int, forecast double, low double, high double")
