"""Alignment of names, entities, concepts and tables: matchers, one-to-one alignment, a committee that learns, conflicts."""

from __future__ import annotations

import re
from difflib import SequenceMatcher
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions import naming
from quillstone.functions.scalars import common_prefix_ratio, jaro_winkler, levenshtein_similarity, sigmoid, structure_mask, token_jaccard
from quillstone.operators.discovery import type_compatibility
from quillstone.operators.overlap import value_text

#: Endings that say what a company is, not which.
LEGAL = ("inc", "ltd", "llc", "co", "corp", "gmbh", "ag", "sa")


def normal_name(c: Column) -> Column:
    """Lower-cased words of letters and digits, without a legal form at the end."""
    words = F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}0-9]+", " "))
    return F.regexp_replace(words, f" (?:{'|'.join(LEGAL)})$", "")


def same_entity(a: str, b: str) -> str | None:
    """How two entity names agree: exact, normalised, singular, or by the entity that a key names."""
    if a == b:
        return "exact"
    x, y = (re.sub(r"[^a-z0-9]+", "_", naming.snake(n)).strip("_") for n in (a, b))
    if x == y:
        return "normalised"
    if naming.singular(x) == naming.singular(y):
        return "singular"
    return "entity" if naming.base(a) and naming.base(a) == naming.base(b) else None


def string_similarity(a: Column, b: Column) -> Column:
    """1 if equal once normalised, else .35 Jaro-Winkler, .25 token Jaccard, .25 edit similarity and .15 common prefix."""
    x, y = normal_name(a), normal_name(b)
    mixed = 0.35 * jaro_winkler(x, y) + 0.25 * token_jaccard(F.split(x, " "), F.split(y, " ")) + 0.25 * levenshtein_similarity(x, y) + 0.15 * common_prefix_ratio(x, y)
    return F.round(F.when(x == y, 1.0).otherwise(mixed), 6)


def matches(scored: DataFrame, least: float = 0.7) -> DataFrame:
    return scored.where(F.col("score") >= least)


def cross_table_mapping(tables: dict[str, tuple[DataFrame, str, str]]) -> DataFrame:
    """(table_a, key_a, table_b, key_b) for equal normalised names; of names that repeat, the least key of either table."""
    parts = [df.select(F.lit(t).alias("table"), F.col(key).cast("string").alias("key"), normal_name(F.col(name)).alias("name")).groupBy("table", "name").agg(F.min("key").alias("key")) for t, (df, key, name) in tables.items()]
    rows = reduce(DataFrame.unionByName, parts)
    x, y = (rows.select("name", F.col("table").alias(f"table_{s}"), F.col("key").alias(f"key_{s}")) for s in "ab")
    return x.join(y, "name").where("table_a < table_b").select("table_a", "key_a", "table_b", "key_b")


def deduplicated(df: DataFrame, key: str, name: str) -> DataFrame:
    """One row for each normalised name: the least key, that key's name, and how many there are."""
    g = df.groupBy(normal_name(F.col(name)).alias("normal")).agg(F.min_by(name, F.struct(key, name)).alias("name"), F.min(key).alias(key), F.count("*").alias("n"))
    return g.select(key, "name", "n")


def instance_similarity(a: DataFrame, col_a: str, b: DataFrame, col_b: str) -> DataFrame:
    """.5 Jaccard of the values, .3 Jaccard of their forms, .2 closeness of their mean lengths."""
    def one(df: DataFrame, column: str, side: str) -> DataFrame:
        return df.select(value_text(df, column).alias("v")).where("v is not null").distinct().withColumn(side, F.lit(1))

    x, y = one(a, col_a, "x"), one(b, col_b, "y")

    def jaccard(p: DataFrame, q: DataFrame, name: str) -> DataFrame:
        return p.join(q, "v", "full").agg((F.count_if(F.col("x").isNotNull() & F.col("y").isNotNull()) / F.count("*")).alias(name))

    masks = [df.select(structure_mask(F.col("v")).alias("v")).distinct().withColumn(side, F.lit(1)) for df, side in ((x, "x"), (y, "y"))]
    lengths = x.agg(F.avg(F.length("v")).alias("la")).crossJoin(y.agg(F.avg(F.length("v")).alias("lb")))
    all_ = jaccard(x, y, "values").crossJoin(jaccard(*masks, "forms")).crossJoin(lengths)
    close = 1 - F.abs(F.col("la") - F.col("lb")) / F.greatest("la", "lb")
    return all_.select(F.round("values", 6).alias("values"), F.round("forms", 6).alias("forms"), F.round(0.5 * F.col("values") + 0.3 * F.col("forms") + 0.2 * close, 6).alias("score"))


def align(a: DataFrame, b: DataFrame, least: float = 0.4) -> list[tuple[str, str, float]]:
    """Columns of two tables one to one, the best first: .4 names, .2 types, .4 common values (one index of both tables)."""
    spark = a.sparkSession
    cells = lambda df, side: df.select(F.explode(F.array(*(F.struct(F.lit(c).alias(side), value_text(df, c).alias("v")) for c in df.columns))).alias("x")).select("x.*").where("v is not null").distinct()
    x, y = cells(a, "a"), cells(b, "b")
    sizes = {(s, r[0]): r[1] for s, df in (("a", x), ("b", y)) for r in df.groupBy(s).agg(F.count("*")).collect()}  # a row for each column
    held = x.groupBy("v").agg(F.collect_list("a").alias("as")).join(y.groupBy("v").agg(F.collect_list("b").alias("bs")), "v")
    common = {(r.a, r.b): r.n for r in held.select(F.explode("as").alias("a"), "bs").select("a", F.explode("bs").alias("b")).groupBy("a", "b").agg(F.count("*").alias("n")).collect()}
    kinds_a, kinds_b = dict(a.dtypes), dict(b.dtypes)
    scores = []
    for c in a.columns:
        for d in b.columns:
            n = common.get((c, d), 0)
            union = sizes.get(("a", c), 0) + sizes.get(("b", d), 0) - n
            scores.append((round(0.4 * naming.column_match(c, d) + 0.2 * type_compatibility(kinds_a[c], kinds_b[d]) + 0.4 * (n / union if union else 0.0), 6), c, d))
    out, used = [], set()
    for score, c, d in sorted(scores, key=lambda s: (-s[0], s[1], s[2])):
        if score >= least and not {("a", c), ("b", d)} & used:
            out.append((c, d, score))
            used |= {("a", c), ("b", d)}
    return out


def table_similarity(tables: dict[str, DataFrame], overlaps: DataFrame) -> DataFrame:
    """(a, b, structure, value, semantic, score) of table pairs: columns' number, best containment of values, best match of names."""
    names = sorted(tables)
    rows = [(t, u, min(len(tables[t].columns), len(tables[u].columns)) / max(len(tables[t].columns), len(tables[u].columns)), max(naming.column_match(c, d) for c in tables[t].columns for d in tables[u].columns)) for i, t in enumerate(names) for u in names[i + 1 :]]
    base = overlaps.sparkSession.createDataFrame(rows, "a string, b string, structure double, semantic double")
    first = lambda c: F.split_part(c, F.lit("."), F.lit(1))
    best = overlaps.groupBy(F.least(first("col_a"), first("col_b")).alias("a"), F.greatest(first("col_a"), first("col_b")).alias("b")).agg(F.max(F.greatest("a_in_b", "b_in_a")).alias("value"))
    j = base.join(best, ["a", "b"], "left").fillna(0.0, ["value"])
    return j.select("a", "b", F.round("structure", 6).alias("structure"), F.round("value", 6).alias("value"), F.round("semantic", 6).alias("semantic"), F.round(0.3 * F.col("structure") + 0.5 * F.col("value") + 0.2 * F.col("semantic"), 6).alias("score"))


def concept_conflicts(concepts: list[tuple[str, str, str]]) -> list[tuple[str, str, str]]:
    """(a, b, kind) among concepts (name, definition, type): alike names of other meaning, or one meaning under other types or names."""
    ratio = lambda x, y: SequenceMatcher(None, x.lower(), y.lower()).ratio()
    out = []
    for i, (a, text, kind) in enumerate(concepts):
        for b, other, second in concepts[i + 1 :]:
            names, meaning = ratio(a, b), ratio(text, other)
            if names >= 0.85 and meaning < 0.5:
                out.append((a, b, "definition"))
            if names >= 0.85 and kind != second:
                out.append((a, b, "type"))
            if names < 0.85 and meaning >= 0.9:
                out.append((a, b, "name"))
    return out


def concept_quality(concepts: DataFrame) -> DataFrame:
    """(name, quality, grade) of concepts (name, definition, evidence, relations): .3 definition, .3 evidence, .2 name, .2 relations."""
    q = F.when(F.length("definition") >= 20, 0.3).otherwise(0.0) + F.when(F.col("evidence") > 0, 0.3).otherwise(0.0) + F.when(F.col("name").rlike("^[A-Z][A-Za-z0-9]*$"), 0.2).otherwise(0.0) + F.when(F.col("relations") > 0, 0.2).otherwise(0.0)
    return concepts.select("name", F.round(q, 6).alias("quality"), F.when(q >= 0.8, "good").when(q >= 0.5, "fair").otherwise("poor").alias("grade"))


# A committee of logistic models, for matches that are learned from some labelled pairs.


def pair_features(pairs: DataFrame, entities: DataFrame, key: str, name: str, attributes: list[str]) -> DataFrame:
    """(a, b, f0 .. f5): Jaro-Winkler and equality of the names, their prefix; mean, greatest and least of the attributes'."""
    cols = [name, *attributes]
    side = lambda s: entities.select(F.col(key).alias(s), *(F.lower(F.col(c).cast("string")).alias(f"{s}_{c}") for c in cols))
    j = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b")
    x, y = F.col(f"a_{name}"), F.col(f"b_{name}")
    j = j.withColumns({f"_s{k}": F.coalesce(jaro_winkler(F.col(f"a_{c}"), F.col(f"b_{c}")), F.lit(0.0)) for k, c in enumerate(cols)})
    own = [F.col(f"_s{k + 1}") for k in range(len(attributes))] or [F.lit(0.0)]
    mean = sum(own[1:], own[0]) / len(own)
    found = [F.col("_s0"), (x == y).cast("double"), common_prefix_ratio(x, y), mean, F.greatest(*own) if len(own) > 1 else own[0], F.least(*own) if len(own) > 1 else own[0]]
    return j.select("a", "b", *(f.alias(f"f{k}") for k, f in enumerate(found)))


def fit_committee(features: np.ndarray, labels: np.ndarray, members: int = 5, seed: int = 42, ridge: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Weights (intercept first) of logistic models, each fitted by Newton's method on rows drawn with repeats."""
    x = np.column_stack([np.ones(len(labels)), features])
    rng, out = np.random.default_rng(seed), []
    for _ in range(members):
        pick = rng.integers(0, len(labels), len(labels))
        z, y, w = x[pick], labels[pick], np.zeros(x.shape[1])
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            step = np.linalg.solve((z.T * (p * (1 - p))) @ z + ridge * np.eye(len(w)), z.T @ (y - p) - ridge * w)
            w = w + step
            if np.abs(step).max() < 1e-8:
                break
        out.append(w)
    return np.array(out)


def committee_scores(features: DataFrame, weights: np.ndarray) -> DataFrame:
    """(a, b, probability, disagreement): mean and range of the members; the pairs to label next are those that disagree most."""
    names = [c for c in features.columns if re.fullmatch(r"f\d+", c)]
    members = [sigmoid(sum((float(w) * F.col(c) for w, c in zip(row[1:], names, strict=True)), F.lit(float(row[0])))) for row in weights]
    mean = sum(members[1:], members[0]) / len(members)
    return features.select("a", "b", F.round(mean, 6).alias("probability"), F.round(F.greatest(*members) - F.least(*members), 6).alias("disagreement"))
