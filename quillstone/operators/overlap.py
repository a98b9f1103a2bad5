"""Shared values between columns, from one inverted index: the distinct (value, column) pairs of all candidate columns.

One shuffle by value serves every pair of columns. Values are cast to text from a common numeric form, so 1 and 1.0
are the same. A value held by very many columns would make many pairs; each value's columns are a short sorted array
(at most the number of columns), so no row group grows with the data.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstone.functions.scalars import NULL_TOKENS, is_blank, normalize_value
from quillstone.storage import materialize

_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def value_text(df: DataFrame, column: str) -> Column:
    kind = df.schema[column].dataType
    c = F.col(f"`{column}`")
    if isinstance(kind, _WHOLE):
        return c.cast("bigint").cast("string")
    if isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType)):
        x = c.cast("double")
        return F.when(x == F.floor(x), x.cast("bigint").cast("string")).otherwise(x.cast("string"))
    return normalize_value(c)


def inverted_index(tables: dict[str, DataFrame], columns: dict[str, list[str]]) -> DataFrame:
    """Distinct (value, col) with col = table.column; each table is read once."""
    parts = []
    for t, names in columns.items():
        df = tables[t]
        cells = F.array(*(F.struct(F.lit(f"{t}.{c}").alias("col"), value_text(df, c).alias("value")) for c in names))
        parts.append(df.select(F.explode(cells).alias("x")).select("x.*").where("value is not null and value <> ''").distinct())
    return reduce(DataFrame.unionByName, parts)


def overlaps(index: DataFrame, min_jaccard: float = 0.0, min_containment: float = 0.0) -> DataFrame:
    """For each pair of columns of different tables with a common value: sizes, common values, Jaccard, containments.

    A pair is kept if its Jaccard or its larger containment reaches the limit.
    """
    sizes = index.groupBy("col").agg(F.count("*").alias("size"))
    held = index.groupBy("value").agg(F.array_sort(F.collect_set("col")).alias("cols")).where(F.size("cols") > 1)
    pairs = held.select(F.explode(F.flatten(F.transform("cols", lambda a: F.transform(F.filter("cols", lambda b: b > a), lambda b: F.struct(a.alias("col_a"), b.alias("col_b")))))).alias("p")).select("p.*")
    pairs = pairs.where(F.split_part("col_a", F.lit("."), F.lit(1)) != F.split_part("col_b", F.lit("."), F.lit(1)))
    common = pairs.groupBy("col_a", "col_b").agg(F.count("*").alias("common"))
    a = sizes.select(F.col("col").alias("col_a"), F.col("size").alias("size_a"))
    b = sizes.select(F.col("col").alias("col_b"), F.col("size").alias("size_b"))
    out = common.join(a, "col_a").join(b, "col_b")
    jaccard = F.col("common") / (F.col("size_a") + F.col("size_b") - F.col("common"))
    out = out.withColumns({"jaccard": F.round(jaccard, 6), "a_in_b": F.round(F.col("common") / F.col("size_a"), 6), "b_in_a": F.round(F.col("common") / F.col("size_b"), 6)})
    keep = F.lit(False)
    if min_jaccard:
        keep = keep | (F.col("jaccard") >= min_jaccard)
    if min_containment:
        keep = keep | (F.greatest("a_in_b", "b_in_a") >= min_containment)
    return out.where(keep) if min_jaccard or min_containment else out


def relation(found: DataFrame) -> DataFrame:
    """Kind of relation and strength as a join key of overlapping columns."""
    kind = F.when((F.col("a_in_b") == 1) & (F.col("b_in_a") == 1), "equal").when(F.col("a_in_b") >= 0.95, "a_in_b").when(F.col("b_in_a") >= 0.95, "b_in_a").otherwise("partial")
    strength = F.when(F.col("jaccard") >= 0.5, "strong").when(F.col("jaccard") >= 0.3, "moderate").otherwise("weak")
    return found.withColumns({"relation": kind, "strength": strength})


def orphans(child: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """Rows of child whose key is none of parent's; blank keys are allowed."""
    rows = child.where(~is_blank(F.col(column), NULL_TOKENS)).withColumn("_k", value_text(child, column))
    return rows.join(parent.select(value_text(parent, key).alias("_k")), "_k", "left_anti").drop("_k")


def inclusion(child: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """Share of child's distinct keys that parent has."""
    mine = child.select(value_text(child, column).alias("v")).where("v is not null").distinct()
    theirs = parent.select(value_text(parent, key).alias("v")).where("v is not null").distinct().withColumn("hit", F.lit(1))
    return mine.join(theirs, "v", "left").agg(F.count("*").alias("n"), F.count("hit").alias("found"), F.round(F.count("hit") / F.count("*"), 6).alias("inclusion"))


def composite_inclusion(child: DataFrame, columns: list[str], parent: DataFrame, keys: list[str]) -> DataFrame:
    """The same for tuples of columns; tuples with a null are left out."""
    names = [f"k{i}" for i in range(len(columns))]
    mine = child.select(*(F.col(c).alias(n) for c, n in zip(columns, names, strict=True))).dropna().distinct()
    theirs = parent.select(*(F.col(c).alias(n) for c, n in zip(keys, names, strict=True))).dropna().distinct().withColumn("hit", F.lit(1))
    return mine.join(theirs, names, "left").agg(F.count("*").alias("n"), F.count("hit").alias("found"), F.round(F.count("hit") / F.count("*"), 6).alias("inclusion"))


MAX_DELETED = 2


def _deleted(text: Column, n: int) -> Column:
    """The texts that are left after n letters of text go; n is 0, 1 or 2."""
    if n == 0:
        return F.array(text)
    length = F.length(text)
    without = lambda t, i: F.concat(F.substr(t, F.lit(1), i - 1), F.substr(t, i + 1, F.length(t)))
    if n == 1:
        return F.array_distinct(F.transform(F.sequence(F.lit(1), length), lambda i: without(text, i)))
    # The second letter that goes stands behind the first.
    rest = lambda i: F.transform(F.sequence(i, F.greatest(length - 1, i)), lambda j: without(without(text, i), j))
    return F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.greatest(length - 1, F.lit(1))), rest)))


def _by_deletion(rows: DataFrame, name: str, lengths: DataFrame, min_similarity: float) -> DataFrame:
    """(name, n, m, rest): what is left of each text after as many deletions as a partner of each length allows."""
    n, m = F.length(name), F.col("m")
    longer = F.greatest(n, m)
    edits = F.floor((1 - min_similarity) * longer + 1e-9).cast("int")
    out = rows.join(F.broadcast(lengths), (F.least(n, m) >= longer * min_similarity - 1e-9) & (edits <= MAX_DELETED))
    out = out.withColumn("_d", n - (longer - edits)).where("_d >= 0")
    cells = F.when(F.col("_d") == 0, _deleted(F.col(name), 0)).when(F.col("_d") == 1, _deleted(F.col(name), 1)).otherwise(_deleted(F.col(name), 2))
    return out.select(name, n.alias("own"), m.alias("other"), F.explode(cells).alias("rest"))


def fuzzy_matches(a: DataFrame, b: DataFrame, min_similarity: float = 0.8, below: bool = False) -> DataFrame:
    """Pairs of distinct texts (column value) whose Levenshtein similarity reaches a limit of over 0.5.

    Where the lengths allow at most ``MAX_DELETED`` edits, texts meet by what is left of them after deletions: of two texts
    within k edits some common rest has k letters fewer than the longer one, and hardly any others share it. Else,
    two such texts differ in at most k = (1 - limit) * length places, so of k + 1 even pieces of the one at least one
    stands in the other, shifted by k at most. Pairs meet by (length of the pieces' text, piece, text of the piece).
    below: only pairs with a < b, as for a column with itself.
    """
    if not 0.5 < min_similarity <= 1:
        raise ValueError("the limit must be over 0.5")
    left = a.select(F.col("value").alias("a")).where("a is not null and a <> ''").distinct()
    right = b.select(F.col("value").alias("b")).where("b is not null and b <> ''").distinct()
    order = F.col("a") < F.col("b") if below else F.lit(True)
    lengths = [materialize(x.select(F.length(c).alias("m")).distinct(), "text-lengths") for x, c in ((right, "b"), (left, "a"))]
    short = _by_deletion(left, "a", lengths[0], min_similarity).withColumnsRenamed({"own": "x", "other": "y"})
    partners = _by_deletion(right, "b", lengths[1], min_similarity).withColumnsRenamed({"own": "y", "other": "x"})
    near = short.join(partners, ["x", "y", "rest"]).where(order).select("a", "b")
    longest = max((x.agg(F.max("m")).first()[0] or 0 for x in lengths), default=0)
    # Lengths of over MAX_DELETED edits: their longer text has at least this many letters.
    many = (MAX_DELETED + 1) / (1 - min_similarity) if min_similarity < 1 else float("inf")
    if longest < many - 1e-6:
        return _similar(near.distinct(), min_similarity)
    left, right = left.where(F.length("a") >= many * min_similarity - 1), right.where(F.length("b") >= many * min_similarity - 1)
    edits = lambda n: F.floor((1 - min_similarity) * n / min_similarity + 1e-9).cast("int")  # noqa: E731  as seen from the shorter text
    n = F.length("a")
    pieces = edits(n) + 1
    starts = F.transform(F.sequence(F.lit(0), pieces - 1), lambda i: F.struct(i.alias("i"), F.floor(i * n / pieces).cast("int").alias("s"), F.floor((i + 1) * n / pieces).cast("int").alias("e")))
    mine = left.select("a", n.alias("n"), F.explode(starts).alias("p")).where("p.e > p.s").select("a", "n", F.col("p.s").alias("s"), F.substr("a", F.col("p.s") + 1, F.col("p.e") - F.col("p.s")).alias("piece"))
    m = F.length("b")
    lengths = F.sequence(F.greatest(F.ceil(m * min_similarity).cast("int"), F.lit(1)), F.floor(m / min_similarity + 1e-9).cast("int"))
    theirs = right.select("b", F.explode(lengths).alias("n"))
    k = edits(F.col("n"))
    cuts = F.transform(F.sequence(F.lit(0), k), lambda i: F.struct(F.floor(i * F.col("n") / (k + 1)).cast("int").alias("s"), F.floor((i + 1) * F.col("n") / (k + 1)).cast("int").alias("e")))
    theirs = theirs.select("b", "n", k.alias("k"), F.explode(cuts).alias("p")).where("p.e > p.s")
    theirs = theirs.select("b", "n", F.col("p.s").alias("s"), F.explode(F.sequence(F.greatest(F.col("p.s") - F.col("k"), F.lit(0)), F.col("p.s") + F.col("k"))).alias("at"), (F.col("p.e") - F.col("p.s")).alias("l")).where(F.col("at") + F.col("l") <= F.length("b"))
    theirs = theirs.select("b", "n", "s", F.substr("b", F.col("at") + 1, F.col("l")).alias("piece")).distinct()
    found = mine.join(theirs, ["n", "s", "piece"]).where(order).select("a", "b")
    return _similar(found.union(near).distinct(), min_similarity)


def _similar(pairs: DataFrame, min_similarity: float) -> DataFrame:
    longer = F.greatest(F.length("a"), F.length("b"))
    # The distance is computed once, and only as far as the limit; beyond it is -1.
    most = F.floor((1 - min_similarity) * longer + 1e-9)
    found = pairs.withColumn("_d", F.expr(f"levenshtein(a, b, cast(floor({1 - min_similarity!r} * greatest(length(a), length(b)) + 1e-9) as int))")).where(F.col("_d").between(0, most))
    return found.select("a", "b", F.round(1 - F.col("_d") / longer, 6).alias("similarity"))


def aligned(a: DataFrame, b: DataFrame, order_a: list[str], order_b: list[str]) -> DataFrame:
    """Row i of a beside row i of b, by explicit order keys; the longer table's rest is left out.

    Ranks come from a range-partitioned sort with the partitions' sizes added up, not from one window over all rows.
    """
    return ranked(a, order_a).join(ranked(b, order_b), "rank").drop("rank")


def ranked(df: DataFrame, order: list[str]) -> DataFrame:
    """df with column rank, 1 for the first row in order."""
    from pyspark.sql import Window

    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Written once: the ranges come from a sample, so two readings of the plan could differ.
    parts = materialize(df.repartitionByRange(n, *order).withColumn("_p", F.spark_partition_id()), "ranges")
    inner = parts.withColumn("_r", F.row_number().over(Window.partitionBy("_p").orderBy(*order)))
    sizes = parts.groupBy("_p").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_b", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    return inner.join(F.broadcast(before), "_p").withColumn("rank", F.col("_r") + F.col("_b")).drop("_p", "_r", "_b")
