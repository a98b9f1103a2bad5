"""Discovery of primary, foreign, composite, hierarchical and temporal keys: names on the driver, values in the inverted index."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions import naming
from quillstone.operators.overlap import composite_inclusion, inclusion, inverted_index, overlaps, value_text
from quillstone.operators.profile import profile
from quillstone.storage import materialize

FK_SCHEMA = "from_table string, from_column string, to_table string, to_column string, name_score double"


def column_statistics(tables: dict[str, DataFrame]) -> DataFrame:
    """(col, rows, filled, distinct) of every column."""
    out = None
    for t, df in tables.items():
        p = profile(df).select(F.concat(F.lit(f"{t}."), F.col("column")).alias("col"), F.col("total").alias("rows"), (F.col("total") - F.col("nulls")).alias("filled"), F.col("distinct"))
        out = p if out is None else out.unionByName(p)
    return out


def primary_keys(tables: dict[str, DataFrame]) -> DataFrame:
    """Columns without nulls or repeats whose name is a key's."""
    named = [f"{t}.{c}" for t, df in tables.items() for c in df.columns if naming.is_key(c)]
    stats = column_statistics(tables)
    return stats.where(F.col("col").isin(*named) & (F.col("filled") == F.col("rows")) & (F.col("distinct") == F.col("rows")) & (F.col("rows") > 0)).select("col")


def candidates(tables: dict[str, DataFrame], least: float = 0.5) -> list[tuple[str, str, str, str, float]]:
    """(from_table, from_column, to_table, to_column, name score) of all pairs of key columns whose names fit."""
    out = []
    for t, df in tables.items():
        for c in df.columns:
            if not naming.is_key(c):
                continue
            for u, other in tables.items():
                if u == t:
                    continue
                for d in other.columns:
                    score = naming.name_similarity(c, d, u) if naming.is_key(d) else 0.0
                    if score >= least:
                        out.append((t, c, u, d, round(score, 4)))
    return out


def foreign_keys(tables: dict[str, DataFrame], min_inclusion: float = 0.8, min_score: float = 0.6) -> DataFrame:
    """Single-column foreign keys.

    The target must be unique and hold the source's values; names weigh .35, inclusion .45, the target's uniqueness .10
    and agreement of the base words .10. Of two directions the one to the more unique side stays.
    """
    spark = next(iter(tables.values())).sparkSession
    named = candidates(tables)
    if not named:
        return spark.createDataFrame([], FK_SCHEMA + ", inclusion double, uniqueness double, score double, confidence string")
    columns: dict[str, set] = {}
    for t, c, u, d, _ in named:
        columns.setdefault(t, set()).add(c)
        columns.setdefault(u, set()).add(d)
    used = {t: tables[t].select(*sorted(cs)) for t, cs in columns.items()}
    index = materialize(inverted_index(used, {t: sorted(cs) for t, cs in columns.items()}), "value-index")
    pairs = overlaps(index)
    both = pairs.select(F.col("col_a").alias("f"), F.col("col_b").alias("p"), F.col("a_in_b").alias("inclusion")).union(pairs.select("col_b", "col_a", "b_in_a"))
    # One row for each key column: read once, used three times.
    filled = None
    for t, df in used.items():
        row = df.agg(F.count("*").alias("_n"), *(F.count(c).alias(c) for c in df.columns))
        part = row.select(F.explode(F.array(*(F.struct(F.lit(f"{t}.{c}").alias("col"), F.col("_n").alias("rows"), F.col(c).alias("filled")) for c in df.columns))).alias("x")).select("x.*")
        filled = part if filled is None else filled.unionByName(part)
    every = materialize(filled.join(index.groupBy("col").agg(F.count("*").alias("distinct")), "col"), "key-columns")
    stats = every.select(F.col("col").alias("p"), (F.col("distinct") / F.greatest("filled", F.lit(1))).alias("uniqueness"))
    names = spark.createDataFrame(named, FK_SCHEMA).withColumn("f", F.concat_ws(".", "from_table", "from_column")).withColumn("p", F.concat_ws(".", "to_table", "to_column"))
    found = F.broadcast(names).join(both, ["f", "p"]).join(stats, "p").where((F.col("uniqueness") >= 0.99) & (F.col("inclusion") >= min_inclusion))
    score = F.round(0.35 * F.col("name_score") + 0.45 * F.col("inclusion") + 0.1 * F.col("uniqueness") + F.when(F.col("name_score") >= 0.85, 0.1).otherwise(0.0), 4)
    found = found.withColumn("score", score).where(F.col("score") >= min_score)
    own = every.select(F.col("col").alias("f"), (F.col("distinct") / F.greatest("filled", F.lit(1))).alias("own"))
    rows = every.select(F.col("col").alias("p"), F.col("rows").alias("to_rows"))
    found = found.join(own, "f").join(rows, "p")
    from pyspark.sql import Window

    turn = F.concat_ws("|", F.array_sort(F.array("f", "p")))
    best = Window.partitionBy(turn).orderBy(F.desc(F.col("uniqueness") - F.col("own")), F.desc("score"), F.asc("to_rows"), "f")
    target = Window.partitionBy("f").orderBy(F.desc("score"), F.asc("to_rows"), "p")
    found = found.withColumn("_d", F.row_number().over(best)).where("_d = 1").withColumn("_t", F.row_number().over(target)).where("_t = 1")
    label = F.when(F.col("score") >= 0.9, "certain").when(F.col("score") >= 0.75, "high").when(F.col("score") >= 0.6, "medium").otherwise("low")
    return found.select("from_table", "from_column", "to_table", "to_column", "name_score", "inclusion", F.round("uniqueness", 6).alias("uniqueness"), "score", label.alias("confidence"))


def without_transitive(found: DataFrame, least: float = 0.85) -> DataFrame:
    """Drops A -> B where A and B both point to the same C with at least that score and A's column is B's target's name."""
    a, b = found.alias("a"), found.alias("b")
    twin = a.join(b, (F.col("a.to_table") == F.col("b.to_table")) & (F.col("a.to_column") == F.col("b.to_column")) & (F.col("a.score") >= least) & (F.col("b.score") >= least))
    extra = twin.select(F.col("a.from_table").alias("from_table"), F.col("a.from_column").alias("from_column"), F.col("b.from_table").alias("to_table"), F.col("b.from_column").alias("to_column"))
    return found.join(extra, ["from_table", "from_column", "to_table", "to_column"], "left_anti")


def signals(child: DataFrame, fk: str, parent: DataFrame, pk: str, fk_table: str, pk_table: str) -> DataFrame:
    """Five signals of a pair: overlap .25, cardinality .20, integrity .25, naming .15, structure .15, and their sum."""
    c = child.select(value_text(child, fk).alias("v")).where("v is not null").groupBy("v").agg(F.count("*").alias("n"))
    p = parent.select(value_text(parent, pk).alias("v")).where("v is not null").groupBy("v").agg(F.count("*").alias("m"))
    j = c.join(p, "v", "full")
    out = j.agg(F.count("n").alias("fk_values"), F.count("m").alias("pk_values"), F.count_if(F.col("n").isNotNull() & F.col("m").isNotNull()).alias("both"), F.sum("n").alias("fk_rows"), F.sum("m").alias("pk_rows"), F.sum(F.when(F.col("m").isNotNull(), F.col("n"))).alias("kept_rows"))
    naming_score = naming.name_similarity(fk, pk, pk_table)
    structure = 1.0 if naming.is_key(fk) and naming.is_key(pk) else 0.5 if naming.is_key(fk) else 0.0
    made = {
        "overlap": F.col("both") / F.col("fk_values"),
        "cardinality": F.col("pk_values") / F.col("pk_rows"),
        "integrity": F.coalesce(F.col("kept_rows"), F.lit(0)) / F.col("fk_rows"),
        "naming": F.lit(naming_score),
        "structure": F.lit(structure),
    }
    out = out.select(*(F.round(x, 6).alias(n) for n, x in made.items()))
    return out.withColumn("score", F.round(0.25 * F.col("overlap") + 0.2 * F.col("cardinality") + 0.25 * F.col("integrity") + 0.15 * F.col("naming") + 0.15 * F.col("structure"), 6))


def direction(a: DataFrame, col_a: str, b: DataFrame, col_b: str) -> DataFrame:
    """Evidence that a points to b (positive) or b to a: uniqueness, containment, row counts. Under .3 it is undecided."""
    x = a.select(value_text(a, col_a).alias("v")).where("v is not null").groupBy("v").agg(F.count("*").alias("n"))
    y = b.select(value_text(b, col_b).alias("v")).where("v is not null").groupBy("v").agg(F.count("*").alias("m"))
    t = x.join(y, "v", "full").agg(F.count("n").alias("da"), F.count("m").alias("db"), F.sum("n").alias("ra"), F.sum("m").alias("rb"), F.count_if(F.col("n").isNotNull() & F.col("m").isNotNull()).alias("both"))
    unique = 0.8 * (F.col("db") / F.col("rb") - F.col("da") / F.col("ra"))
    contained = 0.7 * (F.col("both") / F.col("da") - F.col("both") / F.col("db"))
    rows = F.when(F.col("ra") > F.col("rb"), 0.5).when(F.col("ra") < F.col("rb"), -0.5).otherwise(0.0)
    margin = F.round(unique + contained + rows, 6)
    return t.select(margin.alias("margin"), F.when(margin >= 0.3, "a_to_b").when(margin <= -0.3, "b_to_a").otherwise("undecided").alias("direction"))


def composite_uniqueness(df: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct tuples without a null by their number."""
    full = df.select(*columns).dropna()
    return full.agg(F.count("*").alias("n"), F.count_distinct(F.struct(*columns)).alias("distinct")).withColumn("uniqueness", F.round(F.col("distinct") / F.col("n"), 6))


def composite_keys(df: DataFrame, most: int = 3, columns: list[str] | None = None) -> DataFrame:
    """Smallest sets of key-like columns whose tuples never repeat; all sets of a size are counted in one pass."""
    names = columns or [c for c in df.columns if naming.is_key(c) or c.lower().endswith(("number", "line", "seq"))]
    spark = df.sparkSession
    found: list[tuple[str, ...]] = []
    for size in range(1, most + 1):
        sets = [s for s in combinations(names, size) if not any(set(f) <= set(s) for f in found)]
        if not sets:
            continue
        row = df.agg(F.count("*").alias("n"), *(F.count_distinct(*s).alias(f"d{i}") for i, s in enumerate(sets))).first()
        found += [s for i, s in enumerate(sets) if row.n and row[f"d{i}"] == row.n]
    return spark.createDataFrame([(",".join(s), len(s)) for s in found], "columns string, size int")


def composite_foreign_key(child: DataFrame, columns: list[str], parent: DataFrame, keys: list[str]) -> DataFrame:
    """Inclusion, target uniqueness and score .5 inclusion + .3 uniqueness + .2 names."""
    names = sum(naming.column_match(a, b) for a, b in zip(columns, keys, strict=True)) / len(columns)
    a = composite_inclusion(child, columns, parent, keys)
    b = composite_uniqueness(parent, keys).select("uniqueness")
    return a.crossJoin(b).withColumn("score", F.round(0.5 * F.col("inclusion") + 0.3 * F.col("uniqueness") + 0.2 * names, 6))


def hierarchy(spark: SparkSession, df: DataFrame, child: str, parent: str) -> DataFrame:
    """Depth and root of every node of a parent column, level by level; nodes on or below a cycle have a null depth.

    Doubling: each round a node's ancestor becomes its ancestor's ancestor, so rounds grow with the logarithm of the depth.
    They end when no ancestor changes, or, where there are cycles, when a path without one cannot be longer.
    """
    nodes = df.select(F.col(child).alias("node"), F.col(parent).alias("parent")).where("node is not null").dropDuplicates(["node"])
    known = nodes.select(F.col("node").alias("k"))
    start = nodes.join(known, F.col("parent") == F.col("k"), "left").select("node", F.coalesce("k", "node").alias("up"), F.when(F.col("k").isNull(), 0).otherwise(1).cast("long").alias("depth"))
    now = materialize(start, "hierarchy")
    for _ in range(now.count().bit_length()):
        above = now.select(F.col("node").alias("u"), F.col("up").alias("up2"), F.col("depth").alias("d2"))
        now = materialize(now.join(above, F.col("up") == F.col("u")).select("node", F.col("up2").alias("up"), (F.col("depth") + F.col("d2")).alias("depth"), (F.col("d2") > 0).alias("moved")), "hierarchy")
        if now.where("moved").isEmpty():
            break
    roots = start.where("depth = 0").select(F.col("node").alias("r"))
    return now.join(roots, F.col("up") == F.col("r"), "left").select("node", F.col("r").alias("root"), F.when(F.col("r").isNotNull(), F.col("depth")).alias("depth"))


def self_references(tables: dict[str, DataFrame], least: float = 0.5) -> list[tuple[str, str, str]]:
    """(table, parent column, key column) by name and value inclusion."""
    out = []
    for t, df in tables.items():
        keys = [c for c in df.columns if naming.is_key(c) and not naming.PARENT.search(naming.snake(c))]
        for c in df.columns:
            if naming.PARENT.search(naming.snake(c)) and keys and inclusion(df, c, df, keys[0]).first().inclusion >= least:
                out.append((t, c, keys[0]))
    return out


def row_inclusion(history: DataFrame, column: str, base: DataFrame, key: str) -> DataFrame:
    """Share of a history table's rows (not of its values) whose key the base table has."""
    known = base.select(value_text(base, key).alias("v")).distinct().withColumn("hit", F.lit(1))
    rows = history.select(value_text(history, column).alias("v")).where("v is not null")
    return rows.join(known, "v", "left").agg(F.count("*").alias("n"), F.round(F.count("hit") / F.count("*"), 6).alias("inclusion"))


def mapping(df: DataFrame, a: str, b: str) -> DataFrame:
    """Whether a determines b and the other way round; bijective if both and there are three values."""
    t = df.select(a, b).dropna().agg(F.count_distinct(a).alias("n_a"), F.count_distinct(b).alias("n_b"), F.count_distinct(a, b).alias("n_ab"))
    return t.select("n_a", "n_b", "n_ab", (F.col("n_ab") == F.col("n_a")).alias("a_determines_b"), ((F.col("n_ab") == F.col("n_a")) & (F.col("n_a") == F.col("n_b")) & (F.col("n_a") >= 3)).alias("bijective"))


def matched_prefix(child: DataFrame, fk: str, parent: DataFrame, pk: str) -> DataFrame:
    """The letters that matched values start with most often, and the share of matches that have them."""
    p = parent.select(F.col(pk).cast("string").alias("v")).distinct()
    c = child.select(F.col(fk).cast("string").alias("v")).distinct().join(p, "v", "left_semi")
    return c.select(F.regexp_extract("v", "^([A-Za-z#]*)", 1).alias("prefix")).groupBy("prefix").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "prefix").limit(1)


def adaptive_threshold(tables: dict[str, DataFrame], base: float = 0.3) -> float:
    """The score that a candidate needs, by how many key cells are filled: .05 more over .9, less under .7."""
    filled = total = 0
    for df in tables.values():
        names = [c for c in df.columns if naming.is_key(c)]
        if names:
            row = df.agg(F.count("*").alias("n"), *(F.count(c).alias(c) for c in names)).first()
            total += row.n * len(names)
            filled += sum(row[c] for c in names)
    share = filled / total if total else 0.0
    return min(0.4, max(0.15, base + (0.05 if share > 0.9 else 0.0 if share > 0.7 else -0.05 if share > 0.5 else -0.1)))
