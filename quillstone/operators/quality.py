"""Outliers, anomalies, constraints between columns, and shape constraints on rows.

Conventions: z-scores use the population deviation and a strict limit; quartiles are interpolated, but for the order
statistics where an operator says so. Statistics of all columns come from one wide aggregate whose one row is broadcast.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from itertools import combinations, permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions.scalars import is_blank
from quillstone.operators.profile import numeric_columns
from quillstone.operators.quantiles import order_statistics, quantiles


def z_outliers(df: DataFrame, column: str, limit: float = 3.0) -> DataFrame:
    """Rows whose value is over limit population deviations from the mean; none if all values are equal or under three."""
    x = F.col(column).cast("double")
    stats = df.agg(F.avg(x).alias("_m"), F.stddev_pop(x).alias("_s"), F.count(x).alias("_n"))
    z = F.abs(x - F.col("_m")) / F.col("_s")
    return df.crossJoin(F.broadcast(stats)).where((F.col("_n") >= 3) & (F.col("_s") > 0) & (z > limit)).drop("_m", "_s", "_n")


def iqr_outliers(df: DataFrame, column: str, k: float = 1.5) -> DataFrame:
    """Rows strictly outside the fences of the interpolated quartiles."""
    x = F.col(column).cast("double")
    if df.where(x.isNotNull()).limit(4).count() < 4:
        return df.limit(0)
    q1, q3 = quantiles(df, [column], [0.25, 0.75])[column]
    return df.where((x < q1 - k * (q3 - q1)) | (x > q3 + k * (q3 - q1)))


def order_iqr_outliers(df: DataFrame, column: str, k: float = 1.5) -> DataFrame:
    """The same with order statistics: the values at place n // 4 and 3n // 4, counted from 0."""
    x = F.col(column).cast("double")
    n = df.agg(F.count(x).alias("n")).first().n
    if n < 10:
        return df.limit(0)
    q1, q3 = order_statistics(df, {column: (x, [n // 4, (3 * n) // 4])}, interpolate=False)[column]
    return df.where((x < q1 - k * (q3 - q1)) | (x > q3 + k * (q3 - q1)))


def votes(df: DataFrame, column: str, key: str) -> DataFrame:
    """(key, value, z, iqr, votes) of the rows that either detector names."""
    x = F.col(column).cast("double")
    stats = df.agg(F.avg(x).alias("_m"), F.stddev_pop(x).alias("_s"))
    low, high = (F.lit(q).cast("double") for q in quantiles(df, [column], [0.25, 0.75])[column])
    reach = 1.5 * (high - low)
    z = F.coalesce(F.abs(x - F.col("_m")) / F.col("_s") > 3, F.lit(False)).cast("int")
    iqr = ((x < low - reach) | (x > high + reach)).cast("int")
    out = df.where(x.isNotNull()).crossJoin(F.broadcast(stats)).select(key, x.alias("value"), z.alias("z"), iqr.alias("iqr"))
    return out.withColumn("votes", F.col("z") + F.col("iqr")).where("votes > 0")


class IsolationForest:
    """Isolation trees over numeric columns, fitted on a bounded sample as the method prescribes (256 rows a tree)."""

    def __init__(self, trees: int = 100, sample: int = 256, seed: int = 42):
        self.trees, self.sample, self.seed = trees, sample, seed

    @staticmethod
    def _mean_path(n: float) -> float:
        return 2 * (np.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n if n > 2 else float(n > 1)

    def fit(self, values: np.ndarray) -> IsolationForest:
        rng = np.random.default_rng(self.seed)
        size = min(self.sample, len(values))
        deepest = int(np.ceil(np.log2(max(size, 2))))

        def grow(rows: np.ndarray, depth: int):
            spread = np.nonzero(rows.max(axis=0) > rows.min(axis=0))[0] if len(rows) else []
            if depth >= deepest or len(rows) <= 1 or not len(spread):
                return depth + self._mean_path(len(rows))
            at = int(rng.choice(spread))
            cut = rng.uniform(rows[:, at].min(), rows[:, at].max())
            left = rows[:, at] < cut
            return at, cut, grow(rows[left], depth + 1), grow(rows[~left], depth + 1)

        self.forest = [grow(values[rng.choice(len(values), size, replace=False)], 0) for _ in range(self.trees)]
        self.norm = max(self._mean_path(size), 1e-9)
        return self

    def score(self, values: np.ndarray) -> np.ndarray:
        total = np.zeros(len(values))
        for tree in self.forest:
            queue = [(tree, np.arange(len(values)))]
            while queue:
                node, rows = queue.pop()
                if not isinstance(node, tuple):
                    total[rows] += node
                    continue
                at, cut, low, high = node
                left = values[rows, at] < cut
                queue += [(low, rows[left]), (high, rows[~left])]
        return 2 ** (-total / len(self.forest) / self.norm)


def isolation_scores(df: DataFrame, key: str, columns: list[str], trees: int = 100, sample_rows: int = 20_000, seed: int = 42) -> DataFrame:
    """(key, score) by an isolation forest. It is fitted on sample_rows rows chosen by a hash of the key; every row is scored."""
    cells = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in columns]
    picked = df.orderBy(F.xxhash64(key, F.lit(seed)), key).limit(sample_rows).select(*cells).toPandas().to_numpy()
    if not len(picked):
        return df.select(key, F.lit(0.0).alias("score"))
    forest = IsolationForest(trees, seed=seed).fit(picked)
    shared = df.sparkSession.sparkContext.broadcast(forest)

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"key": pdf["key"], "score": shared.value.score(pdf[columns].to_numpy())})

    kind = dict(df.dtypes)[key]
    return df.select(F.col(key).alias("key"), *cells).mapInPandas(run, f"key {kind}, score double").withColumnRenamed("key", key)


def histogram_scores(df: DataFrame, columns: list[str], key: str, bins: int = 10) -> DataFrame:
    """(key, score): the sum over columns of -ln of the share of rows in the value's bin."""
    bounds = df.agg(*(f(c).cast("double").alias(f"_{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))))
    binned = df.crossJoin(F.broadcast(bounds))
    place = {c: F.least(F.floor((F.col(c) - F.col(f"_lo_{c}")) / F.greatest(F.col(f"_hi_{c}") - F.col(f"_lo_{c}"), F.lit(1e-300)) * bins), F.lit(bins - 1)).cast("int") for c in columns}
    rows = binned.select(key, *(p.alias(f"b_{c}") for c, p in place.items()))
    n = rows.agg(F.count("*").alias("_n"))
    for c in columns:  # at most bins rows each
        share = rows.groupBy(f"b_{c}").agg(F.count("*").alias("k")).crossJoin(n).select(f"b_{c}", (-F.log(F.col("k") / F.col("_n"))).alias(f"s_{c}"))
        rows = rows.join(F.broadcast(share), f"b_{c}")
    return rows.select(key, F.round(sum((F.col(f"s_{c}") for c in columns), F.lit(0.0)), 6).alias("score"))


def null_spikes(df: DataFrame, expected: float = 0.1) -> DataFrame:
    """Columns whose share of nulls, blanks and NaN is over three times what is expected; critical over a half."""
    def missing(c: str, kind: str) -> Column:
        x = F.col(f"`{c}`")
        return x.isNull() | (F.isnan(x) if kind in ("double", "float") else (x == "") if kind == "string" else F.lit(False))

    row = df.agg(*(F.avg(missing(c, t).cast("int")).alias(c) for c, t in df.dtypes))
    out = row.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.round(F.col(f"`{c}`"), 6).alias("share")) for c in df.columns))).alias("x")).select("x.*")
    return out.where(F.col("share") > 3 * expected).withColumn("severity", F.when(F.col("share") > 0.5, "critical").otherwise("high"))


def type_mismatches(df: DataFrame, column: str, kind: str) -> DataFrame:
    """How many filled values cannot be cast, and whether they are over 5 % of all rows."""
    bad = F.col(column).isNotNull() & F.col(column).cast("string").try_cast(kind).isNull()
    return df.agg(F.count("*").alias("n"), F.count_if(bad).alias("bad")).withColumn("mismatch", F.col("bad") > 0.05 * F.col("n"))


def key_duplicates(df: DataFrame, key: str) -> DataFrame:
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).where("n > 1").withColumn("extra", F.col("n") - 1)


def table_report(df: DataFrame) -> DataFrame:
    """Outliers by the z and quartile rules together for each numeric column, and a quality figure of the table."""
    names = numeric_columns(df)
    stats = df.agg(*(f.alias(f"_{n}_{c}") for c in names for n, f in (("m", F.avg(c)), ("s", F.stddev_pop(c)))))
    quartiles = quantiles(df, names, [0.25, 0.75])

    def both(c: str) -> Column:
        x, m, s = F.col(c), *(F.col(f"_{n}_{c}") for n in ("m", "s"))
        q1, q3 = (F.lit(q).cast("double") for q in quartiles[c])
        return (F.abs(x - m) / s > 3) & ((x < q1 - 1.5 * (q3 - q1)) | (x > q3 + 1.5 * (q3 - q1)))

    row = df.crossJoin(F.broadcast(stats)).agg(F.count("*").alias("_n"), *(F.count_if(both(c)).alias(c) for c in names))
    out = row.select("_n", F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("outliers")) for c in names))).alias("x")).select("x.*", "_n")
    total = row.select((F.lit(1.0) - sum((F.col(c) for c in names), F.lit(0)) / (F.col("_n") * len(names) + 1)).alias("q"))
    return out.crossJoin(total).select("column", "outliers", F.round(F.greatest("q", F.lit(0.0)), 6).alias("quality"))


_AT_ONCE = 120  # pair expressions in one aggregate, to stay below the JVM's method size


def _pairwise(df: DataFrame, items: list[tuple], expressions: Callable[[tuple], list[Column]]) -> list:
    """Rows of statistics for each item, by wide aggregates over a chunk of items each."""
    out = []
    for k in range(0, len(items), _AT_ONCE):
        part = items[k : k + _AT_ONCE]
        made = [e.alias(f"{i}_{j}") for i, item in enumerate(part) for j, e in enumerate(expressions(item))]
        row = df.agg(*made).first()
        width = len(made) // len(part)
        out += [(*item, *(row[f"{i}_{j}"] for j in range(width))) for i, item in enumerate(part)]
    return out


def sum_constants(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Pairs whose sum is constant (deviation under 1 % of the mean) at about 1 or 100."""
    names = columns or numeric_columns(df)
    pairs = list(combinations(names, 2))
    stats = _pairwise(df, pairs, lambda p: [F.count(F.col(p[0]) + F.col(p[1])), F.avg(F.col(p[0]) + F.col(p[1])), F.stddev_samp(F.col(p[0]) + F.col(p[1]))])
    found = [(a, b, round(m, 6)) for a, b, n, m, s in stats if n >= 10 and m and s is not None and s / abs(m) < 0.01 and (abs(m - 1) <= 0.05 or abs(m - 100) <= 5)]
    return df.sparkSession.createDataFrame(found, "a string, b string, total double")


def duplicate_columns(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Pairs of columns that are equal in over 99 % of the rows."""
    names = columns or numeric_columns(df)
    stats = _pairwise(df, list(combinations(names, 2)), lambda p: [F.avg(F.col(p[0]).eqNullSafe(F.col(p[1])).cast("int"))])
    return df.sparkSession.createDataFrame([(a, b, round(s, 6)) for a, b, s in stats if s is not None and s > 0.99], "a string, b string, same double")


def derived_ratios(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Columns that are a / b or 100 a / b: median relative error under 2 % and 95 % of the rows within 5 %."""
    names = columns or numeric_columns(df)
    triples = [(t, a, b) for a, b in permutations(names, 2) for t in names if t not in (a, b)]

    def error(t: str, a: str, b: str, scale: int) -> Column:
        made = scale * F.col(a) / F.nullif(F.col(b).cast("double"), F.lit(0.0))
        return F.when(F.col(t) != 0, F.abs(made - F.col(t)) / F.abs(F.col(t)))

    stats = _pairwise(df, triples, lambda p: [x for s in (1, 100) for e in [error(*p, s)] for x in (F.avg((e <= 0.05).cast("int")), F.count(e))])
    likely = [(t, a, b, s) for t, a, b, w1, n1, w100, n100 in stats for s, w, n in ((1, w1, n1), (100, w100, n100)) if n >= 10 and w is not None and w >= 0.95]
    medians = order_statistics(df, {str(p): (error(*p), [0.5]) for p in likely}) if likely else {}
    return df.sparkSession.createDataFrame([p for p in likely if medians[str(p)][0] < 0.02], "target string, a string, b string, scale int")


@dataclass(frozen=True)
class Shape:
    """Constraints on the rows of a table: a name and, for each constraint, a column and what must hold."""

    name: str
    constraints: tuple[tuple[str, str, object], ...] = field(default_factory=tuple)


#: Constraint: a condition that a row meets, from the column and the constraint's value. A null only fails min_count.
CONSTRAINTS: dict[str, Callable[[Column, object], Column]] = {
    "min_count": lambda c, v: ~is_blank(c) if v >= 1 else F.lit(True),
    "max_count": lambda c, v: c.isNull() if v == 0 else F.lit(True),
    "min_inclusive": lambda c, v: c.try_cast("double") >= v,
    "max_inclusive": lambda c, v: c.try_cast("double") <= v,
    "min_exclusive": lambda c, v: c.try_cast("double") > v,
    "max_exclusive": lambda c, v: c.try_cast("double") < v,
    "min_length": lambda c, v: F.length(c.cast("string")) >= v,
    "max_length": lambda c, v: F.length(c.cast("string")) <= v,
    "pattern": lambda c, v: c.cast("string").rlike(f"^(?:{v})"),
    "in": lambda c, v: c.isin(*v),
    "has_value": lambda c, v: c == v,
    "datatype": lambda c, v: c.cast("string").try_cast(v).isNotNull(),
    "equals": lambda c, v: c == F.col(v),
    "disjoint": lambda c, v: c != F.col(v),
    "less_than": lambda c, v: c < F.col(v),
    "less_than_or_equals": lambda c, v: c <= F.col(v),
}


def add_constraint(name: str, holds: Callable[[Column, object], Column]) -> None:
    """A constraint of one's own: a function from column and value to a condition."""
    CONSTRAINTS[name] = holds


def violations(df: DataFrame, shape: Shape, key: str) -> DataFrame:
    """(key, column, constraint, value) of everything that does not hold; one pass, all constraints as columns."""
    cells = []
    for column, name, value in shape.constraints:
        if name not in CONSTRAINTS:
            raise ValueError(f"no constraint {name}")
        c = F.col(column)
        holds = F.coalesce(CONSTRAINTS[name](c, value), F.lit(False))
        free = F.lit(False) if name == "min_count" else c.isNull()
        cells.append(F.when(~(free | holds), F.struct(F.lit(column).alias("column"), F.lit(name).alias("constraint"), c.cast("string").alias("value"))))
    return df.select(key, F.explode(F.array_compact(F.array(*cells))).alias("v")).select(key, "v.*")


def closed(df: DataFrame, allowed: set[str]) -> list[str]:
    """Columns that a closed shape doesn't allow."""
    return sorted(set(df.columns) - allowed)


def default_shape(df: DataFrame, name: str) -> Shape:
    """Constraints by the columns' names: keys filled and at least 0, names not empty, email and phone forms."""
    out: list[tuple[str, str, object]] = []
    for c, kind in df.dtypes:
        low = c.lower()
        if re.search(r"(^|_)id$|key$", low):
            out.append((c, "min_count", 1))
            if kind in ("bigint", "int"):
                out.append((c, "min_inclusive", 0))
        elif re.search(r"name|title|code", low):
            out.append((c, "min_length", 1))
        elif "email" in low:
            out.append((c, "pattern", r"[^@\s]+@[^@\s]+\.[^@\s]+$"))
        elif "phone" in low:
            out.append((c, "pattern", r"[\d\s\-+()]{7,}$"))
    return Shape(name, tuple(out))


def anomaly_insights(df: DataFrame, columns: list[str], key: str, least: int = 100, share: float = 0.01) -> DataFrame:
    """Columns with at least least values of which over share are named by a detector: how many, and the fences that say so."""
    spark, out = df.sparkSession, []
    quartiles = quantiles(df, columns, [0.25, 0.75, 0.99])
    counts = df.agg(*(F.count(c).alias(c) for c in columns)).first()
    for c in columns:
        if counts[c] < least:
            continue
        q1, q3, p99 = quartiles[c]
        n = votes(df, c, key).count()
        if n > share * counts[c]:
            out.append((c, n, round(n / counts[c], 6), round(q1 - 1.5 * (q3 - q1), 4), round(q3 + 1.5 * (q3 - q1), 4), round(p99, 4)))
    return spark.createDataFrame(out, "column string, n long, share double, low double, high double, p99 double")
