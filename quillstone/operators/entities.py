"""Entity resolution: blocking, pair similarity, matching, clusters; and alignment of names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions import naming
from quillstone.functions.scalars import jaro_winkler, ngrams
from quillstone.operators import sketch
from quillstone.operators.graph import components


def candidate_pairs(entities: DataFrame, key: str, text: str, n: int = 64, bands: int = 16, least: float = 0.5) -> DataFrame:
    """(a, b, similarity) of entities whose three-grams meet in a MinHash band."""
    grams = entities.select(key, F.explode(ngrams(F.lower(text))).alias("g"))
    return sketch.similar_pairs(sketch.minhash(grams, key, "g", n), key, bands, least)


def pair_similarity(pairs: DataFrame, entities: DataFrame, key: str, name: str, attributes: list[str]) -> DataFrame:
    """Score of each pair: 1 for equal names, else .57 name and .43 mean attribute similarity (Jaro-Winkler)."""
    cols = [name, *attributes]
    a = entities.select(F.col(key).alias("a"), *(F.lower(F.col(c).cast("string")).alias(f"a_{c}") for c in cols))
    b = entities.select(F.col(key).alias("b"), *(F.lower(F.col(c).cast("string")).alias(f"b_{c}") for c in cols))
    j = pairs.select("a", "b").join(a, "a").join(b, "b")
    same = F.col(f"a_{name}") == F.col(f"b_{name}")
    j = j.withColumn("_n", jaro_winkler(F.col(f"a_{name}"), F.col(f"b_{name}")))
    if attributes:
        for c in attributes:
            j = j.withColumn(f"_s_{c}", jaro_winkler(F.col(f"a_{c}"), F.col(f"b_{c}")))
        mean = sum((F.coalesce(F.col(f"_s_{c}"), F.lit(0.0)) for c in attributes), F.lit(0.0)) / len(attributes)
        score = (0.4 * F.col("_n") + 0.3 * mean) / 0.7
    else:
        score = F.col("_n")
    return j.select("a", "b", F.round(F.when(same, 1.0).otherwise(score), 6).alias("score"))


def resolve(entities: DataFrame, key: str, name: str, attributes: list[str] = (), least: float = 0.7, block_least: float = 0.5) -> DataFrame:
    """(key, cluster): equal names are one from the start, similar ones by blocking, comparing and closing transitively."""
    reps = entities.groupBy(F.lower(name).alias("_name")).agg(F.min(key).alias("rep"))
    named = entities.select(key, F.lower(name).alias("_name")).join(reps, "_name")
    heads = entities.join(reps.select(F.col("rep").alias(key)), key, "left_semi")
    matches = pair_similarity(candidate_pairs(heads, key, name, least=block_least), heads, key, name, list(attributes)).where(F.col("score") >= least)
    groups = components(matches.select("a", "b"))
    return named.join(groups, F.col("rep") == F.col("node"), "left").select(key, F.coalesce("component", "rep").alias("cluster"))


def clusters(resolved: DataFrame, key: str, least: int = 2) -> DataFrame:
    return resolved.groupBy("cluster").agg(F.count("*").alias("n"), F.min(key).alias("first")).where(F.col("n") >= least)


def greedy_one_to_one(scores: DataFrame, a: str = "a", b: str = "b", score: str = "score", rounds: int = 10_000) -> DataFrame:
    """Pairs that are each other's best, taken round by round from what is left; ties by name."""
    from quillstone.storage import materialize

    rest, taken = materialize(scores.select(a, b, score), "alignment"), []
    while not rest.isEmpty():
        if len(taken) == rounds:
            raise RuntimeError(f"the pairs did not settle within {rounds} rounds")
        x = F.row_number().over(Window.partitionBy(a).orderBy(F.desc(score), b))
        y = F.row_number().over(Window.partitionBy(b).orderBy(F.desc(score), a))
        best = materialize(rest.withColumn("_x", x).withColumn("_y", y).where("_x = 1 and _y = 1").drop("_x", "_y"), "alignment")
        taken.append(best)
        rest = materialize(rest.join(best.select(a), a, "left_anti").join(best.select(b), b, "left_anti"), "alignment")
    out = scores.select(a, b, score).limit(0)
    for t in taken:
        out = out.unionByName(t)
    return out


def quality(predicted: DataFrame, reference: DataFrame) -> DataFrame:
    """Precision, recall and F1 of pairs (a, b)."""
    p, r = predicted.select("a", "b").distinct().withColumn("p", F.lit(1)), reference.select("a", "b").distinct().withColumn("r", F.lit(1))
    t = p.join(r, ["a", "b"], "full").agg(F.count("p").alias("p"), F.count("r").alias("r"), F.count_if(F.col("p").isNotNull() & F.col("r").isNotNull()).alias("h"))
    precision, recall = F.col("h") / F.nullif(F.col("p"), F.lit(0)), F.col("h") / F.nullif(F.col("r"), F.lit(0))
    return t.select(F.round(precision, 6).alias("precision"), F.round(recall, 6).alias("recall"), F.round(2 * precision * recall / F.nullif(precision + recall, F.lit(0.0)), 6).alias("f1"))


def cross_table_columns(tables: dict[str, DataFrame]) -> list[tuple[str, list[str]]]:
    """Key columns that name the same entity in several tables."""
    found: dict[str, set[str]] = {}
    for t, df in tables.items():
        for c in df.columns:
            if naming.is_key(c) and naming.base(c):
                found.setdefault(naming.base(c), set()).add(f"{t}.{c}")
    return sorted((e, sorted(cs)) for e, cs in found.items() if len({c.split(".")[0] for c in cs}) > 1)


def column_matches(a: list[str], b: list[str], least: float = 0.7) -> list[tuple[str, str, float]]:
    return [(x, y, round(s, 4)) for x in a for y in b if (s := naming.column_match(x, y)) >= least]


def recency_frequency_value(df: DataFrame, key: str, time: str, value: str, now: Column) -> DataFrame:
    """Days since the last, number and sum: the recipe behind churn and lifetime value."""
    return df.groupBy(key).agg(F.datediff(now, F.max(time)).alias("recency"), F.count("*").alias("frequency"), F.round(F.sum(value), 2).alias("value"))
