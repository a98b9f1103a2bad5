"""Sketches: MinHash signatures and banded candidate pairs, HyperLogLog, and entity blocking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PRIME = (1 << 31) - 1


def permutations(n: int, seed: int = 1) -> list[tuple[int, int]]:
    """Coefficients of n hash functions, from a fixed rule."""
    state, out = seed, []
    for _ in range(2 * n):
        state = (state * 6364136223846793005 + 1442695040888963407) % (1 << 64)
        out.append((state >> 33) % (PRIME - 1) + 1)
    return list(zip(out[::2], out[1::2], strict=True))


def minhash(items: DataFrame, key: str, value: str, n: int = 128) -> DataFrame:
    """(key, signature) from rows (key, value): n minima, one aggregation with map-side combine."""
    h = F.pmod(F.xxhash64(value), F.lit(PRIME))
    rows = items.select(key, h.alias("h"))
    minima = [F.min(F.pmod(F.col("h") * a + b, F.lit(PRIME))).alias(f"m{i}") for i, (a, b) in enumerate(permutations(n))]
    return rows.groupBy(key).agg(*minima).select(key, F.array(*(f"m{i}" for i in range(n))).alias("signature"))


def estimated_jaccard(a: Column, b: Column) -> Column:
    same = F.zip_with(a, b, lambda x, y: (x == y).cast("int"))
    return F.aggregate(same, F.lit(0), lambda s, x: s + x) / F.size(a)


def similar_pairs(signatures: DataFrame, key: str, bands: int = 16, min_similarity: float = 0.5) -> DataFrame:
    """Pairs that share a band and whose estimate reaches the limit.

    Keys with equal signatures are each paired with the smallest of them only, which stands for them in all other pairs,
    so a large group of copies gives one pair a copy.
    """
    reps = signatures.groupBy("signature").agg(F.min(key).alias(key))
    copies = signatures.join(reps.withColumnRenamed(key, "a"), "signature").where(F.col("a") < F.col(key)).select("a", F.col(key).alias("b"), F.lit(1.0).alias("similarity"))
    size = F.size("signature") / bands
    banded = reps.select(key, "signature", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.xxhash64(F.slice("signature", (i * size).cast("int") + 1, size.cast("int"))))).alias("band", "bucket"))
    a, b = banded.alias("a"), banded.alias("b")
    met = a.join(b, (F.col("a.band") == F.col("b.band")) & (F.col("a.bucket") == F.col("b.bucket")) & (F.col(f"a.{key}") < F.col(f"b.{key}")))
    pairs = met.select(F.col(f"a.{key}").alias("a"), F.col(f"b.{key}").alias("b"), estimated_jaccard(F.col("a.signature"), F.col("b.signature")).alias("similarity"))
    return pairs.distinct().where(F.col("similarity") >= min_similarity).unionByName(copies)


def distinct_estimate(df: DataFrame, columns: list[str], p: int = 14) -> DataFrame:
    """HyperLogLog estimates, one row for each column."""
    row = df.agg(*(F.hll_sketch_estimate(F.hll_sketch_agg(F.col(c).cast("string"), F.lit(p))).alias(c) for c in columns))
    return row.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("estimate")) for c in columns))).alias("x")).select("x.*")


def merged_estimate(df: DataFrame, by: str, column: str, p: int = 14) -> DataFrame:
    """The estimate over all groups from a sketch for each group, merged."""
    parts = df.groupBy(by).agg(F.hll_sketch_agg(F.col(column).cast("string"), F.lit(p)).alias("s"))
    return parts.agg(F.hll_sketch_estimate(F.hll_union_agg("s")).alias("estimate"))


def buckets(signatures: DataFrame, key: str, bands: int = 16) -> DataFrame:
    """(key, band, bucket): where each signature stands in a banded index."""
    size = F.size("signature") / bands
    cut = lambda i: F.xxhash64(F.slice("signature", (i * size).cast("int") + 1, size.cast("int")))
    return signatures.select(key, F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), cut)).alias("band", "bucket"))


def ask(signatures: DataFrame, key: str, asked: DataFrame, bands: int = 16, least: float = 0.5) -> DataFrame:
    """(query, key, similarity): items that share a bucket with a signature asked for (columns query, signature) and are alike."""
    of_query = buckets(asked.select(F.col("query").alias(key), "signature"), key, bands).withColumnRenamed(key, "query")
    met = buckets(signatures, key, bands).join(of_query, ["band", "bucket"]).select("query", key).distinct()
    j = met.join(signatures, key).join(asked.select("query", F.col("signature").alias("_q")), "query")
    return j.select("query", key, F.round(estimated_jaccard(F.col("signature"), F.col("_q")), 6).alias("similarity")).where(F.col("similarity") >= least)


def similar_columns(tables: dict[str, DataFrame], columns: dict[str, list[str]], n: int = 256, least: float = 0.5) -> DataFrame:
    """(a, b, similarity) of columns of different tables by signatures of their values."""
    from quillstone.operators.overlap import inverted_index

    s = minhash(inverted_index(tables, columns), "col", "value", n)
    b = buckets(s, "col", n // 2)
    # Columns are few, so all of a bucket's pairs may be formed.
    met = b.withColumnRenamed("col", "a").join(b.withColumnRenamed("col", "b"), ["band", "bucket"]).where("a < b").select("a", "b").distinct()
    table = lambda c: F.split_part(c, F.lit("."), F.lit(1))
    x, y = s.select(F.col("col").alias("a"), F.col("signature").alias("_x")), s.select(F.col("col").alias("b"), F.col("signature").alias("_y"))
    found = met.where(table("a") != table("b")).join(x, "a").join(y, "b")
    return found.select("a", "b", F.round(estimated_jaccard(F.col("_x"), F.col("_y")), 6).alias("similarity")).where(F.col("similarity") >= least)
