"""Exact quantiles without a buffer of all values.

A first pass brackets every quantile by sketches (their rank error is bounded), a second counts what lies below and inside
the brackets, and only values inside are gathered. Where a bracket still holds over ``gather`` values it is narrowed again
by sketches of its own. Small columns are gathered at once; the result is the same.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_ACCURACY = 10_000
GATHER = 200_000


def order_statistics(df: DataFrame, wanted: dict[str, tuple[Column, list[float]]], interpolate: bool = True, gather: int | None = None) -> dict[str, list[float | None]]:
    """For each name: values at the probabilities given, between 0 and 1 of the filled values in order.

    interpolate: linearly between neighbours; else probabilities are places counted from 0. None where nothing is filled.
    """
    gather = GATHER if gather is None else gather
    names = list(wanted)
    rows = df.select(*(wanted[c][0].cast("double").alias(f"c{i}") for i, c in enumerate(names)))
    counts = rows.agg(*(F.count(f"c{i}").alias(f"n{i}") for i in range(len(names)))).first()
    need: dict[tuple[int, int], float | None] = {}
    places: dict[int, list[float]] = {}
    for i, c in enumerate(names):
        n = counts[i]
        places[i] = [min(max((n - 1) * p if interpolate else p, 0.0), n - 1) for p in wanted[c][1]] if n else []
        for at in places[i]:
            need.update({(i, math.floor(at)): None, (i, math.ceil(at)): None})
    # Place of each wanted rank inside its bracket: (least, greatest, values below the bracket, values inside).
    open_ = {key: (-math.inf, math.inf, 0, counts[key[0]]) for key in need}
    while open_:
        done = {k: b for k, b in open_.items() if b[3] <= gather or b[0] == b[1]}
        for key, (lo, _, _, _) in list(done.items()):
            if open_[key][0] == open_[key][1]:
                need[key] = lo
                done.pop(key)
                open_.pop(key)
        if done:
            cells = [F.expr(f"percentile_disc({(k[1] - b[2] + 0.5) / b[3]!r}D) WITHIN GROUP (ORDER BY {_inside_sql(k[0], b)})") for k, b in done.items()]
            for key, value in zip(done, rows.agg(*cells).first(), strict=True):
                need[key] = value
                open_.pop(key)
        if not open_:
            break
        slack = 2.0 / _ACCURACY
        share = {k: (k[1] - b[2]) / max(b[3] - 1, 1) for k, b in open_.items()}
        cells = [F.percentile_approx(_inside(k[0], b), [max(share[k] - slack, 0.0), min(share[k] + slack, 1.0)], _ACCURACY) for k, b in open_.items()]
        made = {k: (x[0], x[1]) for k, x in zip(open_, rows.agg(*cells).first(), strict=True)}
        cells = [x for k, (lo, hi) in made.items() for x in (F.count_if(F.col(f"c{k[0]}") < lo), F.count(_inside(k[0], (lo, hi))))]
        row = rows.agg(*cells).first()
        for j, (key, (lo, hi)) in enumerate(made.items()):
            open_[key] = (lo, hi, row[2 * j], row[2 * j + 1])
    out: dict[str, list[float | None]] = {}
    for i, c in enumerate(names):
        out[c] = []
        for at in places[i]:
            a, b = need[i, math.floor(at)], need[i, math.ceil(at)]
            part = at - math.floor(at)
            out[c].append(a if part == 0 else a * (1 - part) + b * part)
        out[c] = out[c] or [None] * len(wanted[c][1])
    return out


def _inside_sql(i: int, bracket: tuple) -> str:
    """The values inside a bracket, null for others."""
    lo, hi = bracket[:2]
    return f"c{i}" if lo == -math.inf else f"CASE WHEN c{i} >= {lo!r}D AND c{i} <= {hi!r}D THEN c{i} END"


def _inside(i: int, bracket: tuple) -> Column:
    return F.expr(_inside_sql(i, bracket))


def quantiles(df: DataFrame, columns: list[str], probabilities: list[float], gather: int | None = None) -> dict[str, list[float | None]]:
    """Exact interpolated quantiles of columns."""
    return order_statistics(df, {c: (F.col(f"`{c}`"), probabilities) for c in columns}, gather=gather)
