"""Key discovery beyond one detector: evidence for all candidate pairs from one index, filters on directions, and what names say.

Names, of which there are few, are handled on the driver; everything about values is in Spark.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions import naming
from quillstone.operators import keys as K
from quillstone.operators.overlap import value_text
from quillstone.storage import materialize

_NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double")
EVIDENCE = ["from_table", "from_column", "to_table", "to_column"]


def type_compatibility(a: str, b: str) -> float:
    """1 for equal types, .9 for two numbers or two texts, else .3."""
    kind = lambda t: "number" if t in _NUMBERS or t.startswith("decimal") else "text" if t in ("string", "char", "varchar") else t
    return 1.0 if a == b else 0.9 if kind(a) == kind(b) else 0.3


def named_keys(tables: dict[str, DataFrame]) -> list[tuple[str, str, str]]:
    """(table, key column, other table that its name stands for)."""
    stems = {naming.singular(naming.snake(t)): t for t in tables}
    return [(t, c, stems[naming.base(c)]) for t, df in tables.items() for c in df.columns if naming.is_key(c) and stems.get(naming.base(c), t) != t]


def evidence(tables: dict[str, DataFrame], pairs: list[tuple[str, str, str, str, float]]) -> DataFrame:
    """For pairs (from_table, from_column, to_table, to_column, name score): what their values say.

    One count of each column's values serves all pairs: common values, Jaccard, inclusion, uniqueness of either side,
    integrity (share of rows that find their key), rows; the five signals' score; and the margin of the direction.
    """
    spark = next(iter(tables.values())).sparkSession
    columns: dict[str, set[str]] = {}
    for t, c, u, d, _ in pairs:
        columns.setdefault(t, set()).add(c)
        columns.setdefault(u, set()).add(d)
    parts = []
    for t, names in columns.items():
        cells = F.array(*(F.struct(F.lit(f"{t}.{c}").alias("col"), value_text(tables[t], c).alias("value")) for c in sorted(names)))
        parts.append(tables[t].select(F.explode(cells).alias("x")).select("x.*").where("value is not null").groupBy("col", "value").agg(F.count("*").alias("n")))
    counts = materialize(reduce(DataFrame.unionByName, parts), "value-counts")
    stats = counts.groupBy("col").agg(F.count("*").alias("d"), F.sum("n").alias("r"))
    wanted = spark.createDataFrame([(f"{t}.{c}", f"{u}.{d}", float(s)) for t, c, u, d, s in pairs], "f string, p string, name_score double")
    # A value is in at most as many columns as there are.
    held = counts.groupBy("value").agg(F.collect_list(F.struct("col", "n")).alias("x")).where(F.size("x") > 1)
    met = held.select(F.explode("x").alias("a"), "x").select("a", F.explode("x").alias("b")).select(F.col("a.col").alias("f"), F.col("b.col").alias("p"), F.col("a.n").alias("n"))
    common = met.join(F.broadcast(wanted.select("f", "p")), ["f", "p"]).groupBy("f", "p").agg(F.count("*").alias("common"), F.sum("n").alias("kept"))
    side = lambda c: stats.select(F.col("col").alias(c), F.col("d").alias(f"d{c}"), F.col("r").alias(f"r{c}"))
    j = wanted.join(common, ["f", "p"], "left").join(side("f"), "f").join(side("p"), "p").fillna(0, ["common", "kept"])
    inclusion, uniqueness, own = F.col("common") / F.col("df"), F.col("dp") / F.col("rp"), F.col("df") / F.col("rf")
    margin = 0.8 * (uniqueness - own) + 0.7 * (inclusion - F.col("common") / F.col("dp")) + 0.5 * F.signum((F.col("rf") - F.col("rp")).cast("double"))
    integrity = F.col("kept") / F.col("rf")
    score = 0.25 * inclusion + 0.2 * uniqueness + 0.25 * integrity + 0.15 * F.col("name_score") + 0.15
    cut = lambda c, k: F.split_part(c, F.lit("."), F.lit(k))
    named = [cut("f", 1).alias("from_table"), cut("f", 2).alias("from_column"), cut("p", 1).alias("to_table"), cut("p", 2).alias("to_column")]
    jaccard = F.col("common") / (F.col("df") + F.col("dp") - F.col("common"))
    return j.select(*named, "name_score", "common", jaccard.alias("jaccard"), inclusion.alias("inclusion"), uniqueness.alias("uniqueness"), own.alias("own"), integrity.alias("integrity"), score.alias("score"), margin.alias("margin"))


def without_reverse(found: DataFrame) -> DataFrame:
    """Of the two directions of a pair, that to the more unique side; ties by name."""
    ends = [F.concat_ws(".", "from_table", "from_column"), F.concat_ws(".", "to_table", "to_column")]
    w = Window.partitionBy(F.concat_ws("|", F.array_sort(F.array(*ends)))).orderBy(F.desc(F.col("uniqueness") - F.col("own")), ends[0])
    return found.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def pipeline(tables: dict[str, DataFrame], least: float = 0.6) -> DataFrame:
    """Pairs by name, their five signals and their direction, combined: .6 signals, .2 direction, .2 name; the better direction stays."""
    found = evidence(tables, K.candidates(tables))
    total = 0.6 * F.col("score") + 0.2 * F.least(F.greatest(F.col("margin"), F.lit(0.0)), F.lit(1.0)) + 0.2 * F.col("name_score")
    good = found.withColumn("confidence", F.round(total, 6)).where((F.col("confidence") >= least) & (F.col("margin") >= 0.3) & (F.col("uniqueness") >= 0.99) & (F.col("inclusion") >= 0.8))
    return without_reverse(good)


def universal(tables: dict[str, DataFrame], min_jaccard: float = 0.3, min_containment: float = 0.8) -> DataFrame:
    """Pairs by name whose values agree both ways (Jaccard) and one way (containment), without reverse and transitive ones."""
    found = evidence(tables, K.candidates(tables)).where((F.col("jaccard") >= min_jaccard) & (F.col("inclusion") >= min_containment) & (F.col("uniqueness") >= 0.99))
    return K.without_transitive(without_reverse(found))


def confidence_factors(found: DataFrame) -> DataFrame:
    """.2 name, .15 Jaccard, .35 containment and .05 more from .95, .15 uniqueness of the target, .1 for tables of one group."""
    group = lambda c: F.split_part(c, F.lit("_"), F.lit(1))
    same = (group("from_table") == group("to_table")).cast("double")
    total = 0.2 * F.col("name_score") + 0.15 * F.col("jaccard") + 0.35 * F.col("inclusion") + F.when(F.col("inclusion") >= 0.95, 0.05).otherwise(0.0) + 0.15 * F.col("uniqueness") + 0.1 * same
    return found.select(*EVIDENCE, F.round(total, 6).alias("confidence"))


def same_name(tables: dict[str, DataFrame], least: float = 0.5) -> DataFrame:
    """Key columns of the same name in two tables: from the side that is no more unique, with that inclusion."""
    pairs = [(t, c, u, c, 1.0) for t, df in tables.items() for c in df.columns if naming.is_key(c) for u, other in tables.items() if u != t and c in other.columns]
    if not pairs:
        return next(iter(tables.values())).sparkSession.createDataFrame([], ", ".join(f"{c} string" for c in EVIDENCE) + ", inclusion double")
    return evidence(tables, pairs).where((F.col("inclusion") >= least) & (F.col("uniqueness") >= F.col("own"))).select(*EVIDENCE, F.round("inclusion", 6).alias("inclusion"))


def by_inclusion(tables: dict[str, DataFrame], columns: dict[str, list[str]], least: float = 0.95) -> DataFrame:
    """Pairs of columns by values alone: nearly all of one in the other, which never repeats."""
    pairs = [(t, c, u, d, 0.0) for t, cs in columns.items() for c in cs for u, ds in columns.items() for d in ds if t != u]
    return evidence(tables, pairs).where((F.col("inclusion") >= least) & (F.col("uniqueness") >= 0.99)).select(*EVIDENCE, F.round("inclusion", 6).alias("inclusion"))


def bridges(found: DataFrame) -> DataFrame:
    """Tables whose keys lead to two or more others."""
    return found.groupBy(F.col("from_table").alias("table")).agg(F.count_distinct("to_table").alias("n")).where("n >= 2")


def indirect(found: DataFrame) -> DataFrame:
    """(a, bridge, b): tables that have no key to each other but both are led to by a third."""
    x, y = (found.select(F.col("from_table").alias("bridge"), F.col("to_table").alias(n)).distinct() for n in ("a", "b"))
    linked = found.select(F.least("from_table", "to_table").alias("a"), F.greatest("from_table", "to_table").alias("b"))
    return x.join(y, "bridge").where("a < b").join(linked, ["a", "b"], "left_anti").select("a", "bridge", "b")


def mandatory(found: DataFrame, boost: float = 0.1) -> DataFrame:
    """Keys with strong evidence (all values found, target unique, name fits), their score raised."""
    strong = (F.col("inclusion") >= 0.999) & (F.col("uniqueness") >= 0.999) & (F.col("name_score") >= 0.85)
    return found.where(strong).select(*EVIDENCE, F.round(F.least(F.col("score") + boost, F.lit(1.0)), 4).alias("score"))


def cross_platform(tables: dict[str, DataFrame], least: float = 0.1) -> DataFrame:
    """Tables of different platforms (their first word) that share a key: (a, b, column, common, jaccard)."""
    platform = {t: naming.snake(t).split("_")[0] for t in tables}
    key = lambda t: {naming.base(c): c for c in tables[t].columns if naming.is_key(c) and naming.base(c)}
    pairs = [(t, key(t)[e], u, key(u)[e], 1.0) for t in tables for u in tables if t < u and platform[t] != platform[u] for e in sorted(key(t).keys() & key(u).keys())]
    found = evidence(tables, pairs).where(F.col("jaccard") >= least)
    return found.select(F.col("from_table").alias("a"), F.col("to_table").alias("b"), F.col("from_column").alias("column"), "common", F.round("jaccard", 6).alias("jaccard"))


# What names say.

#: Kinds of columns that are no keys, by a word of their name.
CATEGORIES = {
    "date": {"date", "time", "day", "month", "year", "at"},
    "measure": {"price", "amount", "total", "balance", "quantity", "rate", "tax", "discount", "size", "score", "value"},
    "flag": {"flag", "status", "is", "has", "active"},
    "text": {"name", "title", "comment", "description", "address", "email", "phone"},
}
VERBS = {"assigned", "created", "updated", "managed", "approved", "handled", "owned", "sold", "referred", "reported", "owner"}
_SMALL = {"by", "to", "from", "for", "of", "in", "at", "on"}


def category(column: str) -> str | None:
    words = naming.parts(column)
    return next((kind for kind, own in CATEGORIES.items() if any(w == k or len(k) > 3 and w.endswith(k) for w in words for k in own)), None)


def false_positive(a: str, b: str) -> str | None:
    """Why two columns with common values are no key all the same: the kind of the one that cannot be."""
    kinds = [k for c in (a, b) if not naming.is_key(c) and (k := category(c))]
    return kinds[0] if kinds else None


def judged(found: DataFrame, judge: Callable[[dict], tuple[str, float]] | None = None) -> DataFrame:
    """Foreign keys that were found, with (verdict, confidence) of a judge, a callable that is given a row.

    Keys that their columns' kinds rule out are rejected without asking. Without a judge, values and names decide:
    strong from an inclusion of .9 and names of .8 on, weak from an inclusion of .7 on, else none. A key is a row here,
    so there are few.
    """

    def plain(row: dict) -> tuple[str, float]:
        names = naming.name_similarity(row["from_column"], row["to_column"], row["to_table"])
        if row["inclusion"] >= 0.9 and names >= 0.8:
            return "strong", min(0.9, row["score"])
        return ("weak", min(0.7, row["score"])) if row["inclusion"] >= 0.7 else ("none", row["score"])

    rows = []
    for r in found.select(*EVIDENCE, "inclusion", "score").collect():
        out = ("rejected", 0.95) if false_positive(r.from_column, r.to_column) else (judge or plain)(r.asDict())
        rows.append((*r[:4], out[0], float(out[1])))
    return found.sparkSession.createDataFrame(rows, ", ".join(f"{c} string" for c in EVIDENCE) + ", verdict string, confidence double")


def reference(column: str, tables: Iterable[str]) -> tuple[str, str] | None:
    """(table, kind) that a column's words refer to: the last word that names a table; kind by a verb, a parent word or plain."""
    words, stems = naming.parts(column), {naming.singular(naming.snake(t)): t for t in tables}
    roles = [naming.ROLES.get(w, w) for w in words]
    found = next((stems[w] for w in reversed(roles) if w in stems), None)
    if found is None:
        return None
    kind = "self" if naming.PARENT.search(naming.snake(column)) else "verb" if set(words) & (VERBS | _SMALL) else "plain"
    return found, kind


def abbreviations(pairs: Iterable[tuple[str, str]]) -> list[tuple[str, str]]:
    """(short, long) words from pairs of columns that hold the same values: the letters of the one stand in the other in order, the first ones alike."""
    out = set()
    for a, b in pairs:
        x, y = ([w for w in naming.snake(c).split("_") if w not in naming.KEY_WORDS] for c in (a, b))
        for v in set(x) - set(y):
            for w in set(y) - set(x):
                short, long = sorted((v, w), key=len)
                letters = iter(long)
                if 2 <= len(short) < len(long) and short[0] == long[0] and all(c in letters for c in short):
                    out.add((short, long))
    return sorted(out)


def synonyms(pairs: Iterable[tuple[str, str]]) -> list[tuple[str, str]]:
    """Words that stand for the same entity: what differs between two columns of the same values and is no abbreviation."""
    out = set()
    for a, b in pairs:
        x, y = ({w for w in naming.parts(c) if w not in naming.KEY_WORDS} for c in (a, b))
        if len(x - y) == 1 and len(y - x) == 1 and not abbreviations([(a, b)]):
            out.add(tuple(sorted(((x - y).pop(), (y - x).pop()))))
    return sorted(out)


def heuristic_keys(table: str, columns: list[str], tables: Iterable[str]) -> list[tuple[str, str]]:
    """(column, kind) by the table's columns' names alone: its own key, a parent in itself, another table's name."""
    own, others = naming.singular(naming.snake(table)), {naming.singular(naming.snake(t)) for t in tables} - {naming.singular(naming.snake(table))}
    out = []
    for c in columns:
        words = naming.parts(c)
        if naming.PARENT.search(naming.snake(c)):
            out.append((c, "self_reference"))
        elif words in (["id"], ["key"]) or (naming.is_key(c) and naming.base(c) == own):
            out.append((c, "primary_key"))
        elif naming.is_key(c) and naming.base(c) in others:
            out.append((c, "foreign_key"))
        elif len(words) == 1 and words[0] in others:
            out.append((c, "single_noun"))
    return out


def resolve_reference(fk: str, fk_table: str, pk: str, pk_table: str) -> tuple[float, str]:
    """Confidence and reason that a column refers to a key: same entity, a synonym's, a compound's, or its parent's."""
    own, entity, table = [w for w in naming.parts(fk) if w not in naming.KEY_WORDS], naming.base(pk), naming.singular(naming.snake(pk_table))
    targets = {entity, table} - {""}
    if not naming.is_key(fk) and not naming.PARENT.search(naming.snake(fk)):
        return 0.0, "no key"
    if naming.PARENT.search(naming.snake(fk)) and fk_table == pk_table:
        return 0.85, "parent"
    plain = "_".join(own)
    if plain in targets:
        return 0.95, "same entity"
    if own and "_".join(naming.ROLES.get(w, w) for w in own) in targets:
        return 0.85, "synonym"
    if any(naming.ROLES.get(w, w) in targets for w in own):
        return 0.75, "compound"
    return 0.0, "none"


def relation_graph(tables: dict[str, DataFrame], found: DataFrame, overlaps: DataFrame, least: float = 0.9) -> DataFrame:
    """Edges (a, b, kind, weight) between columns and tables: parts of tables, keys, common values and alike names."""
    spark = next(iter(tables.values())).sparkSession
    rows = [(t, f"{t}.{c}", "has", 1.0) for t, df in tables.items() for c in df.columns]
    names = sorted(tables)
    rows += [(f"{t}.{c}", f"{u}.{d}", "name", round(s, 6)) for i, t in enumerate(names) for u in names[i + 1 :] for c in tables[t].columns for d in tables[u].columns if (s := naming.column_match(c, d)) >= least]
    keys = found.select(F.concat_ws(".", "from_table", "from_column").alias("a"), F.concat_ws(".", "to_table", "to_column").alias("b"), F.lit("key").alias("kind"), F.round("score", 6).alias("weight"))
    values = overlaps.select(F.col("col_a").alias("a"), F.col("col_b").alias("b"), F.lit("values").alias("kind"), F.col("jaccard").alias("weight"))
    return spark.createDataFrame(rows, "a string, b string, kind string, weight double").unionByName(keys).unionByName(values)
