"""Stratified samples that keep outliers: an operator of its own, never a shortcut of another."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def stratified(df: DataFrame, by: str, key: str, size: int = 5000, numeric: list[str] = (), seed: int = 42, least: int = 10) -> DataFrame:
    """About size rows: of each stratum its share, at least least, by a seeded hash; and all rows outside the .5 and 99.5 percentiles."""
    counts = df.groupBy(by).agg(F.count("*").alias("_n"))
    shares = counts.crossJoin(F.broadcast(counts.agg(F.sum("_n").alias("_all")))).withColumn("_k", F.greatest(F.lit(least), F.round(size * F.col("_n") / F.col("_all")))).drop("_n", "_all")
    place = F.row_number().over(Window.partitionBy(by).orderBy(F.xxhash64(F.lit(seed), key), key))
    picked = df.withColumn("_r", place).join(F.broadcast(shares.withColumnRenamed(by, "_by")), F.col(by).eqNullSafe(F.col("_by")))
    test = F.col("_r") <= F.col("_k")
    if numeric:
        bounds = df.agg(*(F.percentile_approx(c, [0.005, 0.995], 10_000).alias(f"_q_{c}") for c in numeric))
        picked = picked.crossJoin(F.broadcast(bounds))
        for c in numeric:
            test = test | (F.col(c) < F.get(f"_q_{c}", F.lit(0))) | (F.col(c) > F.get(f"_q_{c}", F.lit(1)))
    return picked.where(test).select(*df.columns)


def load_sample(df: DataFrame, by: str, key: str, size: int = 1000, least: int = 5, seed: int = 42) -> DataFrame:
    """What is kept of a table at load: about size rows, of each stratum its share and at least least."""
    return stratified(df, by, key, size, (), seed, least)


def samples(tables: dict[str, tuple[DataFrame, str]], size: int = 5000, seed: int = 42) -> dict[str, DataFrame]:
    """At most size rows of each table, by the least hashes of its key; small tables whole."""
    return {t: df.orderBy(F.xxhash64(F.lit(seed), key), key).limit(size) for t, (df, key) in tables.items()}
