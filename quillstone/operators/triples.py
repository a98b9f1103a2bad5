"""Facts as (subject, predicate, object) rows, rules to a fixpoint, consistency checks and column lineage.

Rules run semi-naively where they are linear: each round joins only what the round before found. Every round is written
to the shared folder.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions.scalars import uri, xsd_type
from quillstone.storage import materialize

SPO = ("subject", "predicate", "object")


def pattern(triples: DataFrame, subject: str | None = None, predicate: str | None = None, object_: str | None = None) -> DataFrame:
    """Facts that match; None or a name that starts with ? matches anything, a name used twice must match the same."""
    parts = {"subject": subject, "predicate": predicate, "object": object_}
    fixed = {c: v for c, v in parts.items() if v is not None and not v.startswith("?")}
    out = reduce(lambda d, kv: d.where(F.col(kv[0]) == kv[1]), fixed.items(), triples)
    names: dict[str, str] = {}
    for c, v in parts.items():
        if v is not None and v.startswith("?"):
            if v in names:
                out = out.where(F.col(c) == F.col(names[v]))
            names.setdefault(v, c)
    return out


@dataclass(frozen=True)
class Rule:
    """body patterns imply the head; names with ? are variables. Confidence is the least of the premises' times the rule's."""

    name: str
    body: tuple[tuple[str, str, str], ...]
    head: tuple[str, str, str]
    confidence: float = 1.0

    def apply(self, facts: DataFrame) -> DataFrame:
        bound: DataFrame | None = None
        for k, terms in enumerate(self.body):
            match = pattern(facts, *terms)
            columns = {}
            for c, v in zip(SPO, terms, strict=True):
                if v.startswith("?"):
                    columns.setdefault(v, F.col(c))
            part = match.select(*(c.alias(v) for v, c in columns.items()), F.col("confidence").alias(f"_c{k}"))
            if bound is None:
                bound = part
            else:
                shared = [v for v in columns if v in bound.columns]
                if not shared:
                    raise ValueError(f"{self.name}: no variable of {terms} stands in the patterns before it")
                bound = bound.join(part, shared)
        c = F.least(*(F.col(f"_c{k}") for k in range(len(self.body)))) if len(self.body) > 1 else F.col("_c0")
        made = [F.col(f"`{v}`") if v.startswith("?") else F.lit(v) for v in self.head]
        return bound.select(*(x.alias(n) for x, n in zip(made, SPO, strict=True)), (c * self.confidence).alias("confidence"), F.lit(self.name).alias("rule"))


def with_confidence(triples: DataFrame) -> DataFrame:
    out = triples if "confidence" in triples.columns else triples.withColumn("confidence", F.lit(1.0))
    return out.withColumn("rule", F.lit(None).cast("string")) if "rule" not in triples.columns else out


def infer(triples: DataFrame, rules: list[Rule], max_rounds: int = 100) -> DataFrame:
    """All facts that the rules give, with confidence (the best way found first) and rule; given ones have a null rule."""
    facts = materialize(with_confidence(triples).select(*SPO, "confidence", "rule").dropDuplicates(list(SPO)), "facts")
    for _ in range(max_rounds):
        made = reduce(DataFrame.unionByName, (r.apply(facts) for r in rules))
        best = made.groupBy(*SPO).agg(F.max(F.struct("confidence", "rule")).alias("b")).select(*SPO, "b.confidence", "b.rule")
        fresh = materialize(best.join(facts.select(*SPO), list(SPO), "left_anti"), "facts")
        if fresh.isEmpty():
            return facts
        facts = materialize(facts.unionByName(fresh), "facts")
    raise RuntimeError(f"no fixpoint within {max_rounds} rounds")


TYPE, SUB_CLASS, SUB_PROPERTY, DOMAIN, RANGE = "rdf:type", "rdfs:subClassOf", "rdfs:subPropertyOf", "rdfs:domain", "rdfs:range"
#: The RDFS entailment rules and a subset of OWL's.
RDFS = [
    Rule("rdfs2", (("?p", DOMAIN, "?c"), ("?x", "?p", "?y")), ("?x", TYPE, "?c")),
    Rule("rdfs3", (("?p", RANGE, "?c"), ("?x", "?p", "?y")), ("?y", TYPE, "?c")),
    Rule("rdfs5", (("?a", SUB_PROPERTY, "?b"), ("?b", SUB_PROPERTY, "?c")), ("?a", SUB_PROPERTY, "?c")),
    Rule("rdfs7", (("?p", SUB_PROPERTY, "?q"), ("?x", "?p", "?y")), ("?x", "?q", "?y")),
    Rule("rdfs9", (("?a", SUB_CLASS, "?b"), ("?x", TYPE, "?a")), ("?x", TYPE, "?b")),
    Rule("rdfs11", (("?a", SUB_CLASS, "?b"), ("?b", SUB_CLASS, "?c")), ("?a", SUB_CLASS, "?c")),
]
OWL = [
    Rule("inverse", (("?p", "owl:inverseOf", "?q"), ("?x", "?p", "?y")), ("?y", "?q", "?x")),
    Rule("transitive", (("?p", TYPE, "owl:TransitiveProperty"), ("?x", "?p", "?y"), ("?y", "?p", "?z")), ("?x", "?p", "?z"), 0.85),
    Rule("symmetric", (("?p", TYPE, "owl:SymmetricProperty"), ("?x", "?p", "?y")), ("?y", "?p", "?x")),
    Rule("equivalent", (("?a", "owl:equivalentClass", "?b"), ("?x", TYPE, "?a")), ("?x", TYPE, "?b")),
    Rule("same", (("?a", "owl:sameAs", "?b"), ("?b", "owl:sameAs", "?c")), ("?a", "owl:sameAs", "?c")),
]


def chain(properties: list[str], to: str) -> Rule:
    """A property chain: p1 then p2 ... implies to; confidence .9 for two, .85 for more."""
    body = tuple((f"?v{k}", p, f"?v{k + 1}") for k, p in enumerate(properties))
    return Rule(f"chain_{to}", body, ("?v0", to, f"?v{len(properties)}"), 0.9 if len(properties) == 2 else 0.85)


def closure(triples: DataFrame, predicate: str, max_rounds: int = 100) -> DataFrame:
    """(subject, object) of the transitive closure, without loops; semi-naive with doubling of paths."""
    paths = materialize(pattern(triples, None, predicate, None).select("subject", "object").distinct(), "closure")
    for _ in range(max_rounds):
        right = paths.select(F.col("subject").alias("object"), F.col("object").alias("o2"))
        longer = paths.join(right, "object").select("subject", F.col("o2").alias("object")).distinct()
        fresh = materialize(longer.join(paths, ["subject", "object"], "left_anti"), "closure")
        if fresh.isEmpty():
            return paths.where("subject <> object")
        paths = materialize(paths.unionByName(fresh), "closure")
    raise RuntimeError("the closure did not settle")


def cycles(triples: DataFrame, predicate: str) -> DataFrame:
    """Nodes that a predicate leads back to."""
    up = closure(triples, predicate)
    back = up.select(F.col("object").alias("subject"), F.col("subject").alias("object"))
    return up.join(back, ["subject", "object"]).select("subject").union(pattern(triples, None, predicate, None).where("subject = object").select("subject")).distinct()


def functional_violations(triples: DataFrame) -> DataFrame:
    """Subjects with several values of a functional property."""
    functional = pattern(triples, None, TYPE, "owl:FunctionalProperty").select(F.col("subject").alias("predicate"))
    return triples.join(functional, "predicate", "left_semi").groupBy("subject", "predicate").agg(F.count_distinct("object").alias("n")).where("n > 1")


def disjoint_violations(triples: DataFrame) -> DataFrame:
    """Members of two disjoint classes."""
    d = pattern(triples, None, "owl:disjointWith", None).select(F.col("subject").alias("a"), F.col("object").alias("b"))
    t = pattern(triples, None, TYPE, None)
    x, y = t.select(F.col("subject").alias("member"), F.col("object").alias("a")), t.select(F.col("subject").alias("member"), F.col("object").alias("b"))
    return d.join(x, "a").join(y, ["member", "b"]).select("member", "a", "b")


def type_violations(triples: DataFrame) -> DataFrame:
    """Uses of a property whose subject lacks its domain, or whose object lacks its range (subclasses count)."""
    up = closure(triples, SUB_CLASS).select(F.col("subject").alias("c"), F.col("object").alias("s"))
    own = pattern(triples, None, TYPE, None).select(F.col("subject").alias("member"), F.col("object").alias("c"))
    have = own.union(own.join(up, "c").select("member", "s")).distinct()
    out = []
    for kind, side in ((DOMAIN, "subject"), (RANGE, "object")):
        need = pattern(triples, None, kind, None).select(F.col("subject").alias("predicate"), F.col("object").alias("c"))
        uses = triples.join(need, "predicate").select(F.col(side).alias("member"), "predicate", "c")
        out.append(uses.join(have, ["member", "c"], "left_anti").withColumn("kind", F.lit(kind.split(":")[1])))
    return out[0].unionByName(out[1]).distinct()


def cardinality_violations(triples: DataFrame, cls: str, predicate: str, least: int = 0, most: int | None = None) -> DataFrame:
    """Members of a class with too few or too many values; members without any count as 0."""
    members = pattern(triples, None, TYPE, cls).select("subject").distinct()
    n = pattern(triples, None, predicate, None).groupBy("subject").agg(F.count_distinct("object").alias("k"))
    out = members.join(n, "subject", "left").select("subject", F.coalesce("k", F.lit(0)).cast("long").alias("n"))
    return out.where((F.col("n") < least) | (F.col("n") > most if most is not None else F.lit(False)))


def missing_properties(triples: DataFrame, required: dict[str, list[str]]) -> DataFrame:
    """(subject, predicate): members of a class that lack a property."""
    spark = triples.sparkSession
    need = spark.createDataFrame([(c, p) for c, ps in required.items() for p in ps], "object string, needed string")
    members = pattern(triples, None, TYPE, None).join(F.broadcast(need), "object").select("subject", F.col("needed").alias("predicate"))
    return members.join(triples.select("subject", "predicate"), ["subject", "predicate"], "left_anti").distinct()


def of_schema(spark: SparkSession, tables: dict[str, DataFrame], keys: list) -> DataFrame:
    """Classes, datatype properties and, from foreign keys, object properties with their inverse."""
    rows = []
    for t, df in tables.items():
        rows.append((f"ex:{t}", TYPE, "owl:Class"))
        for c, kind in df.dtypes:
            rows += [(f"ex:{t}.{c}", TYPE, "owl:DatatypeProperty"), (f"ex:{t}.{c}", DOMAIN, f"ex:{t}"), (f"ex:{t}.{c}", RANGE, xsd_type(kind))]
    for k in keys:
        name = f"ex:{k.from_table}_to_{k.to_table}"
        rows += [(name, TYPE, "owl:ObjectProperty"), (name, DOMAIN, f"ex:{k.from_table}"), (name, RANGE, f"ex:{k.to_table}"), (f"{name}_inverse", "owl:inverseOf", name)]
    return spark.createDataFrame(rows, "subject string, predicate string, object string")


def of_rows(df: DataFrame, key: str, cls: str, properties: dict[str, str]) -> DataFrame:
    """Facts of a table's rows: a type each, and the filled properties (column to predicate)."""
    s = uri(f"ex:{cls}/", F.col(key))
    cells = [F.struct(F.lit(p).alias("predicate"), F.col(c).cast("string").alias("object")) for c, p in properties.items()]
    out = df.select(s.alias("subject"), F.explode(F.array(F.struct(F.lit(TYPE).alias("predicate"), F.lit(f"ex:{cls}").alias("object")), *cells)).alias("x")).select("subject", "x.*")
    return out.where("object is not null")


def graph_statistics(triples: DataFrame) -> DataFrame:
    return triples.agg(F.count("*").alias("facts"), F.count_distinct("subject").alias("subjects"), F.count_distinct("predicate").alias("predicates"), F.count_distinct("object").alias("objects"))


def lineage(edges: DataFrame, start: str, downstream: bool = True, most: int = 10_000) -> DataFrame:
    """(node, depth): columns that a column feeds, or that feed it, however far; edges are (source, target)."""
    near, far = ("source", "target") if downstream else ("target", "source")
    spark = edges.sparkSession
    seen = spark.createDataFrame([(start, 0)], "node string, depth int")
    front = seen
    for k in range(1, most + 1):
        step = edges.join(F.broadcast(front) if k == 1 else front, F.col(near) == F.col("node")).select(F.col(far).alias("node")).distinct()
        front = materialize(step.join(seen, "node", "left_anti").withColumn("depth", F.lit(k)), "lineage")
        if front.isEmpty():
            return seen.where("depth > 0")
        seen = materialize(seen.unionByName(front), "lineage")
    raise RuntimeError(f"there are columns at more than {most} steps")


def impact(edges: DataFrame, start: str) -> DataFrame:
    found = lineage(edges, start)
    return found.agg(F.count("*").alias("columns"), F.count_distinct(F.split_part("node", F.lit("."), F.lit(1))).alias("tables"), F.coalesce(F.max("depth"), F.lit(0)).alias("depth"))


def prove(triples: DataFrame, rules: list[Rule], goal: tuple[str, str, str]) -> DataFrame:
    """Facts that answer a goal (names with ? are free), working backwards: only rules that lead to its predicate, and facts that those read."""
    wanted, used = {goal[1]}, []
    grown = True
    while grown:
        grown = False
        for r in rules:
            free = r.head[1].startswith("?") or any(w.startswith("?") for w in wanted)
            if r not in used and (free or r.head[1] in wanted):
                used.append(r)
                wanted |= {p for _, p, _ in r.body}
                grown = True
    facts = triples if any(w.startswith("?") for w in wanted) else triples.where(F.col("predicate").isin(*wanted))
    found = infer(facts, used) if used else with_confidence(facts).select(*SPO, "confidence", "rule")
    return pattern(found, *goal)


def lineage_edges(found: DataFrame) -> DataFrame:
    """(source, target) from foreign keys: a key feeds the columns that refer to it."""
    return found.select(F.concat_ws(".", "to_table", "to_column").alias("source"), F.concat_ws(".", "from_table", "from_column").alias("target"))


#: Rules over what tables hold beside RDFS and OWL: places are inherited along parts, suppliers of parts serve those that order them.
DOMAIN_RULES = [
    Rule("located", (("?x", "locatedIn", "?y"), ("?y", "partOf", "?z")), ("?x", "locatedIn", "?z"), 0.9),
    Rule("serves", (("?s", "supplies", "?p"), ("?o", "contains", "?p")), ("?s", "serves", "?o"), 0.8),
]
