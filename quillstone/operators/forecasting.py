"""Forecasting models for one series each, their choice, combination and reading: ARIMA by Hannan and Rissanen's regressions,
seasonal regression with holidays, ensembles and stacking. Models are functions of (values, horizon)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.operators import timeseries as T


def _lagged(z: np.ndarray, e: np.ndarray, p: int, q: int) -> tuple[np.ndarray, np.ndarray]:
    start = max(p, q)
    rows = np.column_stack([np.ones(len(z) - start), *(z[start - k : len(z) - k] for k in range(1, p + 1)), *(e[start - k : len(e) - k] for k in range(1, q + 1))])
    return rows, z[start:]


def fit_arma(z: np.ndarray, p: int, q: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Coefficients (constant, p lags, q errors), the errors, and Akaike's criterion. Errors come first from a long autoregression."""
    e = np.zeros(len(z))
    if q:
        long = min(max(p, q) + 3, max(1, len(z) // 4))
        x, y = _lagged(z, e, long, 0)
        e[long:] = y - x @ np.linalg.lstsq(x, y, rcond=None)[0]
    x, y = _lagged(z, e, p, q)
    beta = np.linalg.lstsq(x, y, rcond=None)[0]
    rest = y - x @ beta
    errors = np.concatenate([np.zeros(len(z) - len(rest)), rest])
    n = max(len(rest), 1)
    return beta, errors, n * float(np.log(max(rest @ rest / n, 1e-12))) + 2 * (p + q + 1)


def arima(y: np.ndarray, horizon: int, order: tuple[int, int, int] = (2, 1, 1)) -> np.ndarray:
    """ARIMA(p, d, q); a series too short for its order goes on with its mean step."""
    y, (p, d, q) = np.asarray(y, float), order
    z, ends = y, []
    for _ in range(d):
        if len(z) < 2:
            break
        ends.append(z[-1])
        z = np.diff(z)
    if len(z) < 3 * (p + q + 1) or np.allclose(z, z.mean()):
        made = np.full(horizon, z.mean() if len(z) else 0.0)
    else:
        beta, errors, _ = fit_arma(z, p, q)
        past, shocks, made = list(z), list(errors), []
        for _ in range(horizon):
            step = beta[0] + sum(beta[k] * past[-k] for k in range(1, p + 1)) + sum(beta[p + k] * shocks[-k] for k in range(1, q + 1))
            past.append(step)
            shocks.append(0.0)
            made.append(step)
        made = np.array(made)
    for end in reversed(ends):
        made = end + np.cumsum(made)
    return made


def best_order(y: np.ndarray, most_p: int = 3, most_q: int = 2, most_d: int = 1) -> tuple[int, int, int]:
    """Differences as long as they lower the variance, then the orders of the least criterion."""
    z, d = np.asarray(y, float), 0
    while d < most_d and len(z) > 3 and np.var(np.diff(z)) < np.var(z):
        z, d = np.diff(z), d + 1
    options = [(p, q) for p in range(most_p + 1) for q in range(most_q + 1) if len(z) >= 3 * (p + q + 1) + max(p, q)]
    if not options or np.allclose(z, z.mean() if len(z) else 0.0):
        return 0, d, 0
    p, q = min(options, key=lambda o: (round(fit_arma(z, *o)[2], 9), o))
    return p, d, q


def auto_arima(y: np.ndarray, horizon: int) -> np.ndarray:
    return arima(y, horizon, best_order(y))


def seasonal_regression(y: np.ndarray, horizon: int, period: float = 7.0, terms: int = 2, holidays: tuple[int, ...] = ()) -> np.ndarray:
    """Trend, waves of a period and an effect for each holiday (an index, past or to come, that all share one effect)."""
    y = np.asarray(y, float)
    if len(y) < 2 * terms + 3:
        return np.full(horizon, y.mean() if len(y) else 0.0)
    at = np.arange(len(y) + horizon)
    waves = [f(2 * np.pi * k * at / period) for k in range(1, terms + 1) for f in (np.sin, np.cos)]
    x = np.column_stack([np.ones(len(at)), at / len(y), *waves, *([np.isin(at, holidays).astype(float)] if holidays else [])])
    return x[len(y) :] @ np.linalg.lstsq(x[: len(y)], y, rcond=None)[0]


def ensemble(y: np.ndarray, horizon: int, weights: tuple[float, float] = (0.4, 0.6)) -> np.ndarray:
    return (weights[0] * arima(y, horizon) + weights[1] * seasonal_regression(y, horizon)) / sum(weights)


def stacked(y: np.ndarray, horizon: int, share: float = 0.2) -> np.ndarray:
    """Models weighed by the inverse squared error that each makes on the last fifth."""
    y = np.asarray(y, float)
    models = (arima, seasonal_regression, T.holt_winters, T.autoregressive)
    held = max(1, int(len(y) * share))
    if len(y) < 10:
        return ensemble(y, horizon)
    weights = np.array([1.0 / max(float(np.mean((m(y[:-held], held) - y[-held:]) ** 2)), 1e-9) for m in models])
    return sum(w * m(y, horizon) for w, m in zip(weights / weights.sum(), models, strict=True))


def choose(y: np.ndarray) -> str:
    """The model that fits a series' shape: short, seasonal, with a trend, or neither."""
    y = np.asarray(y, float)
    if len(y) < 10:
        return "mean"
    if np.allclose(y, y.mean()):
        return "mean"
    slope, base = np.polyfit(np.arange(len(y)), y, 1)
    d = y - (base + slope * np.arange(len(y)))
    if len(y) >= 21 and d.std() > 1e-6 * y.std() and float(d[7:] @ d[:-7]) / float(d @ d) > 0.4:
        return "seasonal_regression"
    return "arima" if abs(slope) * len(y) > y.std() else "ensemble"


def automatic(y: np.ndarray, horizon: int) -> np.ndarray:
    name = choose(y)
    return np.full(horizon, np.mean(y) if len(y) else 0.0) if name == "mean" else {"seasonal_regression": seasonal_regression, "arima": arima, "ensemble": ensemble}[name](y, horizon)


def kpi(y: np.ndarray, horizon: int, improvement: float = 1.0) -> np.ndarray:
    """.6 smoothing and .4 ARIMA, times what improves."""
    return improvement * (0.6 * T.holt_winters(np.asarray(y, float), horizon) + 0.4 * arima(y, horizon))


T.MODELS |= {"arima": arima, "auto_arima": auto_arima, "seasonal_regression": seasonal_regression, "weighted_ensemble": ensemble, "stacked": stacked, "automatic": automatic, "kpi": kpi}


def insight(rows: DataFrame, horizon: int = 7, limit: float = 0.05) -> DataFrame:
    """What lies ahead of each series, in the order of its times: the forecast's mean against that of the last points."""
    ahead = T.moving_forecast(rows, horizon, horizon).groupBy("series").agg(F.avg("forecast").alias("ahead"))
    last = rows.groupBy("series").agg(F.max("i").alias("_last"))
    now = rows.join(last, "series").where(F.col("i") > F.col("_last") - horizon).groupBy("series").agg(F.avg("value").alias("now"))
    change = (F.col("ahead") - F.col("now")) / F.abs("now")
    out = ahead.join(now, "series")
    return out.select("series", F.round("now", 4).alias("now"), F.round("ahead", 4).alias("ahead"), F.round(change, 6).alias("change"), F.when(change > limit, "rising").when(change < -limit, "falling").otherwise("steady").alias("outlook"))
