"""Detection and repair of missing values, outliers and duplicates. Repairs return a new table; the old one is untouched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions.scalars import is_blank
from quillstone.operators.profile import numeric_columns
from quillstone.operators.quantiles import order_statistics


def missing(df: DataFrame) -> DataFrame:
    """Blank cells of each column, number and share, where there are any."""
    row = df.agg(F.count("*").alias("_n"), *(F.count_if(is_blank(F.col(f"`{c}`"))).alias(c) for c in df.columns))
    out = row.select("_n", F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("n")) for c in df.columns))).alias("x"))
    return out.select("x.column", "x.n", F.round(F.col("x.n") / F.col("_n"), 6).alias("rate")).where("n > 0")


def outliers(df: DataFrame, limit: float = 3.0) -> DataFrame:
    """Values over limit sample deviations from the mean, for each numeric column with more than three values."""
    names = numeric_columns(df)
    stats = df.agg(*(f.alias(f"_{n}_{c}") for c in names for n, f in (("m", F.avg(c)), ("s", F.stddev_samp(c)), ("n", F.count(c)))))
    over = [(F.col(f"_n_{c}") > 3) & (F.abs(F.col(c) - F.col(f"_m_{c}")) > limit * F.col(f"_s_{c}")) & (F.col(f"_s_{c}") > 0) for c in names]
    row = df.crossJoin(F.broadcast(stats)).agg(*(F.count_if(t).alias(c) for c, t in zip(names, over, strict=True)))
    return row.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("n")) for c in names))).alias("x")).select("x.*").where("n > 0")


def duplicates(df: DataFrame) -> DataFrame:
    """Distinct rows that occur again, with the number of extra ones."""
    return df.groupBy(*df.columns).agg(F.count("*").alias("n")).where("n > 1").withColumn("extra", F.col("n") - 1).drop("n")


def strategy(rate: float, kind: str) -> str:
    """How an issue is mended: missing values under 30 % by the mean, others by a default; outliers clipped; duplicates dropped."""
    return {"missing": "fill_mean" if rate < 0.3 else "fill_default", "outlier": "clip", "duplicate": "deduplicate"}[kind]


def _fill(df: DataFrame, column: str, value: Column, name: str = "_v") -> DataFrame:
    stats = df.agg(value.alias(name))
    return df.crossJoin(F.broadcast(stats)).withColumn(column, F.when(is_blank(F.col(column)), F.col(name)).otherwise(F.col(column))).drop(name)


def fill_mean(df: DataFrame, column: str) -> DataFrame:
    return _fill(df, column, F.avg(F.col(column).try_cast("double")))


def fill_median(df: DataFrame, column: str) -> DataFrame:
    median = order_statistics(df, {column: (F.col(column).try_cast("double"), [0.5])})[column][0]
    return df.withColumn(column, F.when(is_blank(F.col(column)), F.lit(median)).otherwise(F.col(column)))


def fill_mode(df: DataFrame, column: str) -> DataFrame:
    """The most frequent value, the smallest of ties."""
    best = df.where(~is_blank(F.col(column))).groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(1).select(F.col(column).alias("_v"))
    return df.join(F.broadcast(best), F.lit(True), "left").withColumn(column, F.when(is_blank(F.col(column)), F.col("_v")).otherwise(F.col(column))).drop("_v")


def fill_group_mode(df: DataFrame, column: str, by: str) -> DataFrame:
    """The most frequent value of the row's group: the default where a model would infer it."""
    counts = df.where(~is_blank(F.col(column))).groupBy(by, column).agg(F.count("*").alias("n"))
    best = counts.withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("n"), column))).where("_r = 1").select(by, F.col(column).alias("_v"))
    return df.join(best, by, "left").withColumn(column, F.when(is_blank(F.col(column)), F.col("_v")).otherwise(F.col(column))).drop("_v")


def fill_default(df: DataFrame, column: str, value: object = "N/A") -> DataFrame:
    return df.withColumn(column, F.when(is_blank(F.col(column)), F.lit(value)).otherwise(F.col(column)))


def remove_rows(df: DataFrame, bad: DataFrame, key: list[str]) -> DataFrame:
    return df.join(bad.select(*key), key, "left_anti")


def clip(df: DataFrame, column: str, limit: float = 3.0) -> DataFrame:
    """Values brought inside mean +- limit sample deviations, the bounds rounded to two places."""
    stats = df.agg(F.round(F.avg(column) - limit * F.stddev_samp(column), 2).alias("_lo"), F.round(F.avg(column) + limit * F.stddev_samp(column), 2).alias("_hi"))
    x = F.col(column)
    return df.crossJoin(F.broadcast(stats)).withColumn(column, F.when(x.isNull(), x).otherwise(F.least(F.greatest(x, F.col("_lo")), F.col("_hi")))).drop("_lo", "_hi")


def deduplicate(df: DataFrame, by: list[str] | None = None, order: list[str] | None = None) -> DataFrame:
    """One row for each value of by (all columns), the first in order if one is given."""
    if not order:
        return df.dropDuplicates(by)
    w = Window.partitionBy(*(by or df.columns)).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def impact(affected: DataFrame, downstream: dict[str, tuple[DataFrame, str]], key: str) -> DataFrame:
    """Affected rows here and in each table that refers to them, with a risk by number: over 100 high, over 10 medium."""
    ids = affected.select(F.col(key).alias("_k")).distinct()
    out = affected.agg(F.lit("itself").alias("table"), F.count("*").alias("n"))
    for name, (df, fk) in downstream.items():
        out = out.unionByName(df.join(ids, F.col(fk) == F.col("_k"), "left_semi").agg(F.lit(name).alias("table"), F.count("*").alias("n")))
    return out.withColumn("risk", F.when(F.col("n") > 100, "high").when(F.col("n") > 10, "medium").otherwise("low"))


def remediate(df: DataFrame, approve=lambda issue: True) -> tuple[DataFrame, list[tuple[str, str, str]]]:
    """Detects issues, mends those that approve accepts, and tells which: (kind, column, strategy)."""
    done = []
    numeric = set(numeric_columns(df))
    for r in missing(df).collect():
        how = strategy(r.rate, "missing") if r.column in numeric else "fill_default"
        if approve(("missing", r.column, how)):
            df = fill_mean(df, r.column) if how == "fill_mean" else fill_default(df, r.column, 0 if r.column in numeric else "N/A")
            done.append(("missing", r.column, how))
    for r in outliers(df).collect():
        if approve(("outlier", r.column, "clip")):
            df = clip(df, r.column)
            done.append(("outlier", r.column, "clip"))
    if approve(("duplicate", "*", "deduplicate")) and not duplicates(df).limit(1).isEmpty():
        df = deduplicate(df)
        done.append(("duplicate", "*", "deduplicate"))
    return df, done


def load_rules(df: DataFrame, rate_columns: list[str] = (), count_columns: list[str] = ()) -> DataFrame:
    """Opt-in hard rules: rates over 100 are capped, negative counts become null."""
    made = {c: F.when(F.col(c) > 100, 100.0).otherwise(F.col(c)) for c in rate_columns} | {c: F.when(F.col(c) >= 0, F.col(c)) for c in count_columns}
    return df.withColumns(made) if made else df


class Remediation:
    """Issues of a table as actions that are approved, applied or rejected, and undone; the table before each is kept."""

    def __init__(self, df: DataFrame):
        self.versions, self.state = [df], {}

    @property
    def table(self) -> DataFrame:
        return self.versions[-1]

    def approve(self, name: str) -> None:
        self.state[name] = "approved"

    def reject(self, name: str) -> None:
        self.state[name] = "rejected"

    def apply(self, name: str, change) -> None:
        """An approved action; others raise."""
        if self.state.get(name) != "approved":
            raise ValueError(f"{name} is not approved")
        self.versions.append(change(self.table))
        self.state[name] = "applied"

    def rollback(self, name: str) -> None:
        """Undoes the last action, which must be this one."""
        if self.state.get(name) != "applied" or len(self.versions) < 2:
            raise ValueError(f"{name} is not applied")
        self.versions.pop()
        self.state[name] = "rolled back"
