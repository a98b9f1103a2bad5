"""Relations between tables and columns as a whole: mappings, cardinalities, integrated key discovery, KPI definitions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions import naming
from quillstone.functions.scalars import char_class, structure_mask
from quillstone.operators import keys as K
from quillstone.operators.overlap import value_text


def column_mappings(tables: dict[str, DataFrame]) -> list[tuple[str, str, str, float]]:
    """(column, column, kind, confidence) across tables: equal names .8, equal words .6, same entity .4; .1 more for equal types."""
    cells = [(t, c, kind) for t, df in tables.items() for c, kind in df.dtypes]
    out = []
    for i, (t, c, kind) in enumerate(cells):
        for u, d, other in cells[i + 1 :]:
            if t == u:
                continue
            same = 0.1 if kind == other else 0.0
            if c.lower() == d.lower():
                found = ("exact", 0.8 + same)
            elif naming.parts(c) == naming.parts(d):
                found = ("normalised", 0.6 + same)
            elif naming.base(c) and naming.base(c) == naming.base(d):
                found = ("semantic", 0.4 + same)
            else:
                continue
            out.append((f"{t}.{c}", f"{u}.{d}", found[0], round(found[1], 2)))
    return sorted(out)


def cardinality(a: DataFrame, col_a: str, b: DataFrame, col_b: str) -> DataFrame:
    """1:1, 1:N, N:1 or N:M between two columns, by the largest number of rows that a common value has on either side."""
    x = a.select(value_text(a, col_a).alias("v")).where("v is not null").groupBy("v").agg(F.count("*").alias("n"))
    y = b.select(value_text(b, col_b).alias("v")).where("v is not null").groupBy("v").agg(F.count("*").alias("m"))
    t = x.join(y, "v").agg(F.max("n").alias("n"), F.max("m").alias("m"), F.count("*").alias("common"))
    kind = F.when((F.col("n") == 1) & (F.col("m") == 1), "1:1").when(F.col("n") == 1, "1:N").when(F.col("m") == 1, "N:1").otherwise("N:M")
    return t.select("common", F.when(F.col("common") > 0, kind).alias("cardinality"))


def pattern_matches(tables: dict[str, DataFrame], columns: dict[str, list[str]]) -> DataFrame:
    """Pairs of columns of different tables whose most frequent value form (class, mask, length) is the same."""
    parts = []
    for t, names in columns.items():
        df = tables[t]
        cells = F.array(*(F.struct(F.lit(f"{t}.{c}").alias("col"), F.col(c).cast("string").alias("v")) for c in names))
        parts.append(df.select(F.explode(cells).alias("x")).select("x.*").where("v is not null"))
    rows = reduce(DataFrame.unionByName, parts)
    forms = rows.groupBy("col", char_class(F.col("v")).alias("kind"), structure_mask(F.col("v")).alias("mask"), F.length("v").alias("len")).agg(F.count("*").alias("n"))
    best = forms.groupBy("col").agg(F.max_by(F.struct("kind", "mask", "len"), F.struct("n", "mask")).alias("f")).select("col", "f.*")
    a, b = best.select(F.col("col").alias("a"), "kind", "mask", "len"), best.select(F.col("col").alias("b"), "kind", "mask", "len")
    both = a.join(b, ["kind", "mask", "len"]).where("a < b")
    return both.where(F.split_part("a", F.lit("."), F.lit(1)) != F.split_part("b", F.lit("."), F.lit(1))).select("a", "b", "mask")


def integrated_keys(tables: dict[str, DataFrame]) -> DataFrame:
    """Single, hierarchical and temporal keys in one table: (kind, from, to, score), each pair once."""
    spark = next(iter(tables.values())).sparkSession
    single = K.foreign_keys(tables).select(F.lit("single").alias("kind"), F.concat_ws(".", "from_table", "from_column").alias("source"), F.concat_ws(".", "to_table", "to_column").alias("target"), "score")
    rows = [("hierarchy", f"{t}.{c}", f"{t}.{k}", 1.0) for t, c, k in K.self_references(tables)]
    rows += [("temporal", t, kind, 1.0) for t, df in tables.items() if (kind := naming.temporal_kind(df.columns))]
    more = spark.createDataFrame(rows, "kind string, source string, target string, score double")
    return single.unionByName(more).dropDuplicates(["source", "target"])


def likely_key_columns(df: DataFrame, most_unique: float = 0.5) -> DataFrame:
    """Columns worth indexing: named as keys, or with few values for their rows."""
    named = [c for c in df.columns if naming.is_key(c)]
    row = df.agg(F.count("*").alias("_n"), *(F.approx_count_distinct(c).alias(c) for c in df.columns))
    out = row.select("_n", F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("d")) for c in df.columns))).alias("x"))
    return out.where(F.col("x.column").isin(*named) | (F.col("x.d") < most_unique * F.col("_n"))).select("x.column")


def kpi_check(df: DataFrame, definitions: dict[str, tuple[Column, float, bool]]) -> DataFrame:
    """(kpi, value, target, met): definitions give an aggregate, a target and whether more is better."""
    cells = [F.struct(F.lit(n).alias("kpi"), F.round(e, 4).alias("value"), F.lit(float(t)).alias("target"), (e >= t if up else e <= t).alias("met")) for n, (e, t, up) in definitions.items()]
    return df.agg(F.array(*cells).alias("x")).select(F.explode("x").alias("p")).select("p.*")


def explained(correlations: DataFrame, explanations: DataFrame) -> DataFrame:
    """Correlations (a, b, r) without the pairs that a constraint between the columns explains, either way round."""
    both = explanations.select("a", "b").union(explanations.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    return correlations.join(both, ["a", "b"], "left_anti")


def standardise(insights: DataFrame) -> DataFrame:
    """Titles trimmed, severities among the known ones, repeats by kind, column and title gone."""
    low = F.lower(F.trim("severity"))
    severity = F.when(low.isin("critical", "high", "medium", "low"), low).when(low.isin("warning", "warn"), "medium").when(low.isin("error", "severe"), "high").otherwise("info")
    title = F.trim(F.regexp_replace("title", r"\s+", " "))
    return insights.withColumn("severity", severity).withColumn("title", title).dropDuplicates(["kind", "column", "title"])


def homeomorphism(a: Column, b: Column) -> Column:
    """Score of two structures (b0, b1, columns): .5 for equal Betti numbers less their distance, .5 for the ratio of columns."""
    distance = F.abs(a["b0"] - b["b0"]) + F.abs(a["b1"] - b["b1"])
    return 0.5 / (1 + distance) + 0.5 * F.least(a["columns"], b["columns"]) / F.greatest(a["columns"], b["columns"])


def entities(tables: dict[str, DataFrame]) -> DataFrame:
    """Entities that tables and key columns name."""
    spark: SparkSession = next(iter(tables.values())).sparkSession
    rows = [(naming.singular(t), "table", t) for t in tables] + [(naming.base(c), "column", f"{t}.{c}") for t, df in tables.items() for c in df.columns if naming.is_key(c) and naming.base(c)]
    return spark.createDataFrame(sorted(set(rows)), "entity string, kind string, source string")


def kpi_estimates(rows: DataFrame, targets: dict[str, tuple[float, float]], full: int = 1000) -> DataFrame:
    """(kpi, estimate, rows): from a baseline towards a target, by how many rows there are to go by. An assumption, not a measurement."""
    n = rows.agg(F.count("*").alias("n"))
    cells = F.array(*(F.struct(F.lit(k).alias("kpi"), F.lit(float(b)).alias("b"), F.lit(float(t)).alias("t")) for k, (b, t) in targets.items()))
    made = n.select("n", F.explode(cells).alias("x")).select("n", "x.*")
    return made.select("kpi", F.round(F.col("b") + (F.col("t") - F.col("b")) * F.least(F.lit(1.0), F.col("n") / full), 6).alias("estimate"), F.col("n").alias("rows"))
