"""Column profiles and the aggregates built on them. One pass over a table gives all its columns' figures."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstone.functions.scalars import PATTERNS, numeric_string

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
NESTED = (T.ArrayType, T.MapType, T.StructType)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, NUMERIC)]


def unpivoted(row: DataFrame, fields: dict[str, dict[str, str]]) -> DataFrame:
    """One wide row as one row for each column: fields maps an output column to the wide column of each input column."""
    names = list(fields)
    columns = list(next(iter(fields.values())))
    structs = [F.struct(F.lit(c).alias("column"), *(F.col(f"`{fields[n][c]}`").alias(n) for n in names)) for c in columns]
    return row.select(F.explode(F.array(*structs)).alias("p")).select("p.*")


def profile(df: DataFrame, approximate: bool = False) -> DataFrame:
    """For each column: type, rows, nulls, distinct values (of the JSON form for nested ones), least and greatest as text.

    approximate counts distinct values with a sketch, whose size doesn't grow; exact counts shuffle the values.
    """
    fields: dict[str, dict[str, str]] = {n: {} for n in ("type", "total", "nulls", "distinct", "least", "greatest")}
    aggregates = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        plain = F.to_json(c) if isinstance(f.dataType, NESTED) else c
        text = plain.cast("string")
        distinct = F.approx_count_distinct(plain) if approximate else F.count_distinct(plain)
        ordered = not isinstance(f.dataType, (T.BinaryType, T.BooleanType, *NESTED))
        made = {"type": F.lit(f.dataType.simpleString()), "total": F.count(F.lit(1)), "nulls": F.count_if(c.isNull()), "distinct": distinct, "least": F.min(c).cast("string") if ordered else F.min(text), "greatest": F.max(c).cast("string") if ordered else F.max(text)}
        for name, expression in made.items():
            key = f"{f.name}|{name}"
            aggregates.append((F.max(expression) if name == "type" else expression).alias(key))
            fields[name][f.name] = key
    return unpivoted(df.agg(*aggregates), fields)


def numeric_statistics(df: DataFrame, digits: int = 4) -> DataFrame:
    """Exact aggregates of each numeric column, rounded: n, sum, mean, sd (sample), min, max, quartiles, distinct values.

    A column is read once, for its value counts; everything else comes from these, which are dealt by ranges of values, so
    no task holds a column's values.
    """
    from quillstone.storage import materialize

    names = numeric_columns(df)
    spark = df.sparkSession
    counts = None
    for i, c in enumerate(names):
        one = df.select(F.col(f"`{c}`").cast("double").alias("x")).where("x is not null").groupBy("x").agg(F.count("*").alias("k")).select(F.lit(i).alias("i"), "x", "k")
        counts = one if counts is None else counts.unionByName(one)
    spine = spark.createDataFrame(list(enumerate(names)), "i int, column string")
    if counts is None:
        counts = spark.createDataFrame([], "i int, x double, k long")
    counts = materialize(counts.repartitionByRange("i", "x").withColumn("part", F.spark_partition_id()), "value-counts")
    x, k = F.col("x"), F.col("k")
    made = counts.groupBy("i", "part").agg(F.sum("k").alias("n"), F.sum(x * k).alias("sum"), F.min("x").alias("min"), F.max("x").alias("max"), F.count("*").alias("distinct"))
    parts = materialize(made, "value-count-parts")
    made = parts.groupBy("i").agg(*(f(c).alias(c) for f, c in ((F.sum, "n"), (F.sum, "sum"), (F.min, "min"), (F.max, "max"), (F.sum, "distinct"))))
    made = materialize(made, "value-count-sums")
    mean = made.select("i", F.col("n").alias("_n"), (F.col("sum") / F.col("n")).alias("_mean"))
    off = F.col("x") - F.col("_mean")
    sd = counts.join(F.broadcast(mean), "i").groupBy("i").agg(F.sum(off * off * k).alias("s"), F.max("_n").alias("_n")).select("i", F.when(F.col("_n") > 1, F.sqrt(F.col("s") / (F.col("_n") - 1))).alias("sd"))
    quartiles = spark.createDataFrame(_quartiles(counts, parts), "i int, q array<double>")
    r = lambda c: F.round(c, digits)
    out = F.broadcast(spine).join(F.broadcast(made), "i", "left").join(F.broadcast(sd), "i", "left").join(F.broadcast(quartiles), "i", "left")
    return out.select("column", F.coalesce("n", F.lit(0)).alias("n"), r("sum").alias("sum"), r(F.col("sum") / F.col("n")).alias("mean"), r("sd").alias("sd"), r("min").alias("min"), r("max").alias("max"), r(F.col("q")[0]).alias("q25"), r(F.col("q")[1]).alias("median"), r(F.col("q")[2]).alias("q75"), F.coalesce("distinct", F.lit(0)).alias("distinct"))


def _quartiles(counts: DataFrame, parts: DataFrame) -> list[tuple[int, list[float]]]:
    """Quartiles, interpolated, from value counts (i, part, x, k): parts with their sums n follow each other in order of x."""
    sums: dict[int, list[tuple[int, int]]] = {}
    for row in parts.select("i", "part", "n").collect():
        sums.setdefault(row.i, []).append((row.part, row.n))
    wanted, found = [], {}
    for i, sizes in sums.items():
        places = [(sum(n for _, n in sizes) - 1) * p for p in (0.25, 0.5, 0.75)]
        for at in sorted({f(p) for p in places for f in (math.floor, math.ceil)}):
            below = 0
            for part, n in sorted(sizes):
                if at < below + n:
                    wanted.append((i, part, at, at - below))
                    break
                below += n
    if wanted:
        asked = F.broadcast(counts.sparkSession.createDataFrame(wanted, "i int, part int, place long, inside long"))
        held = counts.join(asked.select("i", "part").distinct(), ["i", "part"], "left_semi").withColumn("upto", F.sum("k").over(Window.partitionBy("i", "part").orderBy("x")))
        hits = held.join(asked, ["i", "part"]).where("inside < upto and inside >= upto - k")
        found = {(r.i, r.place): r.x for r in hits.select("i", "place", "x").collect()}
    out = []
    for i, sizes in sums.items():
        total, q = sum(n for _, n in sizes), []
        for p in (0.25, 0.5, 0.75):
            at = (total - 1) * p
            a, b, share = found[i, math.floor(at)], found[i, math.ceil(at)], at - math.floor(at)
            q.append(a if share == 0 else a * (1 - share) + b * share)
        out.append((i, q))
    return out


def value_counts(df: DataFrame, column: str) -> DataFrame:
    total = df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    return total.crossJoin(F.broadcast(df.agg(F.count("*").alias("_n")))).withColumn("share", F.round(F.col("n") / F.col("_n"), 6)).drop("_n")


def text_shares(df: DataFrame) -> DataFrame:
    """For each text column the share of its non-blank values that fit each pattern, and that read as number or date."""
    columns = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    names = [*PATTERNS, "number", "boolean"]
    fields: dict[str, dict[str, str]] = {n: {} for n in [*names, "mean_length"]}
    aggregates = []
    for name in columns:
        c = F.col(f"`{name}`")
        full = c.isNotNull() & (F.trim(c) != "")
        tests = {p: c.rlike(x) for p, x in PATTERNS.items()} | {"number": numeric_string(c).isNotNull(), "boolean": F.lower(c).isin("true", "false", "yes", "no", "y", "n", "0", "1")}
        for p, test in tests.items():
            aggregates.append(F.round(F.avg(F.when(full, test.cast("int"))), 6).alias(f"{name}|{p}"))
            fields[p][name] = f"{name}|{p}"
        aggregates.append(F.round(F.avg(F.when(full, F.length(c))), 6).alias(f"{name}|mean_length"))
        fields["mean_length"][name] = f"{name}|mean_length"
    return unpivoted(df.agg(*aggregates), fields)


#: Words in a column's name that tell its meaning.
NAME_MEANINGS = {"id": ("id", "key", "code", "no"), "name": ("name", "title"), "date": ("date", "time", "ts", "created", "updated"), "amount": ("amount", "price", "cost", "total", "balance", "acctbal", "revenue"), "count": ("count", "qty", "quantity", "num"), "status": ("status", "state", "flag", "type"), "email": ("email",), "phone": ("phone", "tel"), "address": ("address", "city", "street")}


def name_meaning(column: str) -> str | None:
    tokens = re.split(r"[^a-z0-9]+", column.lower())
    for meaning, words in NAME_MEANINGS.items():
        if any(t == w or t.endswith(w) for t in tokens for w in words):
            return meaning
    return None


def inferred(df: DataFrame) -> DataFrame:
    """Inferred and semantic type of each text column: the kind that over 80 % of its values have."""
    shares = text_shares(df)
    best = F.when(F.col("boolean") > 0.8, "boolean").when(F.col("number") > 0.8, "numeric_string").when(F.col("date_iso") > 0.8, "datetime").otherwise("string")
    meaning = F.when(F.col("email") > 0.8, "email").when(F.col("uuid") > 0.8, "uuid").when(F.col("url") > 0.8, "url").when(F.col("date_iso") > 0.8, "date")
    by_name = F.create_map(*(F.lit(x) for c in df.columns for x in (c, name_meaning(c) or ""))) if df.columns else F.lit(None)
    named = F.nullif(by_name[F.col("column")], F.lit(""))
    return shares.select("column", best.alias("inferred"), F.coalesce(meaning, named, F.when(F.col("mean_length") > 50, "text")).alias("meaning"))


def key_candidates(df: DataFrame) -> DataFrame:
    """Primary and foreign key scores of each column from uniqueness, nulls and name."""
    p = profile(df)
    ids = [c for c in df.columns if name_meaning(c) == "id"]
    unique = F.when(F.col("total") > F.col("nulls"), F.col("distinct") / (F.col("total") - F.col("nulls"))).otherwise(0.0)
    named = F.col("column").isin(*ids) if ids else F.lit(False)
    pk = F.when(unique >= 0.999, 0.4).otherwise(0.0) + F.when(F.col("nulls") == 0, 0.2).otherwise(0.0) + F.when(named, 0.3).otherwise(0.0)
    fk = F.when(unique < 0.999, 0.3).otherwise(0.0) + F.when(F.col("nulls") == 0, 0.1).otherwise(0.0) + F.when(named, 0.25).otherwise(0.0)
    return p.select("column", F.round(unique, 6).alias("uniqueness"), F.round(pk, 2).alias("pk_score"), F.round(fk, 2).alias("fk_score"), F.when(pk >= 0.5, "pk").when(fk >= 0.5, "fk").alias("role"))


def quality_score(df: DataFrame) -> DataFrame:
    """Mean over columns of 1 - 0.3 * null share - 0.3 where an identifier repeats, clipped to 0 .. 1."""
    p = profile(df)
    ids = [c for c in df.columns if name_meaning(c) == "id"]
    named = F.col("column").isin(*ids) if ids else F.lit(False)
    unique = F.when(F.col("total") > F.col("nulls"), F.col("distinct") / (F.col("total") - F.col("nulls"))).otherwise(0.0)
    null_share = F.when(F.col("total") > 0, F.col("nulls") / F.col("total")).otherwise(0.0)
    score = F.least(F.greatest(1 - 0.3 * null_share - F.when(named & (unique < 0.95), 0.3).otherwise(0.0), F.lit(0.0)), F.lit(1.0))
    return p.agg(F.round(F.avg(score), 6).alias("score"))


def normal_form(df: DataFrame, candidates: DataFrame) -> str:
    """A guess by shape: no key 0NF, several numbered columns 1NF, wide without foreign keys 2NF, else 3NF."""
    roles = {r.role for r in candidates.select("role").distinct().collect()}
    if "pk" not in roles:
        return "0NF"
    if sum(bool(re.search(r"\d$", c)) for c in df.columns) > 2:
        return "1NF"
    return "2NF" if "fk" not in roles and len(df.columns) > 10 else "3NF"


def robust_means(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, n, m): the mean, or the median if the coefficient of variation is over 10 and there are 5 values.

    Only the groups that need their median are read a second time.
    """
    g = rows.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("m"), F.stddev_pop(value).alias("_s"))
    g = g.withColumn("_wide", F.coalesce((F.col("n") >= 5) & (F.col("_s") > 10 * F.abs("m")), F.lit(False)))
    wide = rows.join(g.where("_wide").select(*by), by, "left_semi").groupBy(*by).agg(F.percentile(value, 0.5).alias("_median"))
    return g.join(wide, by, "left").select(*by, "n", F.coalesce("_median", "m").alias("m"))


def categorical_columns(df: DataFrame, most: int = 50) -> list[str]:
    """Text columns with 2 to most values (one pass with sketches)."""
    texts = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    if not texts:
        return []
    row = df.agg(*(F.approx_count_distinct(c).alias(c) for c in texts)).first()
    return [c for c in texts if 2 <= row[c] <= most]
