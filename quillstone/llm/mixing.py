"""Mixing sources to target weights by hierarchical budgeting.

Documents hang in a tree of levels (say domain, language, source). A token budget goes down from the root: a node splits
what it gets among its children by weight; a child that cannot use its share, because its documents times
``max_epochs`` have fewer tokens, is filled, and its shortage goes to its siblings by weight before anything is left to
their parent's siblings. A leaf then takes whole epochs and, of the next epoch's seeded order of its documents, the
longest prefix whose tokens fit.

Only sums for each leaf reach the driver (at most ``max_leaves``; beyond that it is an error). The prefix is found without
sorting a leaf and without texts: each leaf's order is dealt into ``BUCKETS`` hash ranges whose token sums tell in which
one the prefix ends, that range is dealt again, ``LEVELS`` times in all, and only the last one's identifiers and token
counts are sorted. The rows are then filtered in place by the place where their leaf's prefix ends.

Defined cases: a null or empty text has 0 tokens and is taken while the prefix lasts; null level values are a branch of
their own; weights not given are 1, a weight of 0 gives nothing; documents that tie in order (repeated rows) are ordered
by identifier and text hash, and of rows that agree in both as many as fit are taken, any of them; an empty table or a budget of 0 gives no rows beyond those
of 0 tokens; columns of the input that clash with ``tokens`` or ``epochs`` are replaced.
"""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstone.storage import materialize, read_table

BUCKETS = 1024
LEVELS = 2


def split_budget(budget: float, weights: list[float], capacities: list[float]) -> list[float]:
    """Shares of a budget by weight, none above its capacity; what one cannot use goes to the others."""
    out, open_ = [0.0] * len(weights), [k for k, w in enumerate(weights) if w > 0]
    left = budget
    while open_:
        total = sum(weights[k] for k in open_)
        full = [k for k in open_ if left * weights[k] / total >= capacities[k]]
        if not full:
            for k in open_:
                out[k] = left * weights[k] / total
            break
        for k in full:
            out[k] = capacities[k]
            left = max(0.0, left - capacities[k])
        open_ = [k for k in open_ if k not in full]
    return out


def allocate(leaves: dict[tuple, float], weights: Mapping[tuple, float], budget: float) -> dict[tuple, float]:
    """Tokens for each leaf. leaves: path to capacity; weights: path of any node to its weight among its siblings."""
    usable: dict[tuple, float] = {}
    children: dict[tuple, set] = {}
    for path, capacity in leaves.items():
        reachable = capacity if all(weights.get(path[:d], 1.0) > 0 for d in range(1, len(path) + 1)) else 0.0
        for depth in range(len(path) + 1):
            usable[path[:depth]] = usable.get(path[:depth], 0.0) + reachable
            if depth:
                children.setdefault(path[: depth - 1], set()).add(path[:depth])
    got = {(): min(budget, usable.get((), 0.0))}
    queue = [()] if leaves else []
    while queue:
        node = queue.pop()
        below = sorted(children.get(node, ()), key=str)
        shares = split_budget(got[node], [weights.get(c, 1.0) for c in below], [usable[c] for c in below])
        for child, share in zip(below, shares, strict=True):
            got[child] = share
            queue.append(child)
    return {path: got[path] for path in leaves}


def n_tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("long")


def mix(df: DataFrame, levels: list[Column], weights: Mapping[tuple, float], budget: int | None = None, budget_share: float = 0.5, max_epochs: int = 2, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", max_leaves: int = 100_000) -> DataFrame:
    """The rows of df that are taken, with tokens and epochs (how often). levels: from the root's children to the leaves.

    budget: tokens in all; if None, budget_share of the tokens there are.
    """
    spark = df.sparkSession
    leaf = F.to_json(F.array(*(x.cast("string") for x in levels)), {"ignoreNullFields": "false"})
    narrow = materialize(df.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), leaf.alias("leaf"), n_tokens(F.col(text_col)).alias("tokens")), "mixing-tokens")
    totals = {r.leaf: r.tokens for r in narrow.groupBy("leaf").agg(F.sum("tokens").alias("tokens")).limit(max_leaves + 1).collect()}
    if len(totals) > max_leaves:
        raise ValueError(f"over {max_leaves} leaves")
    paths = {tuple(json.loads(x)): x for x in totals}
    if budget is None:
        budget = int(budget_share * sum(totals.values()))
    given = allocate({p: float(totals[x]) * max_epochs for p, x in paths.items()}, weights, float(budget))
    plan = []
    for path, tokens in given.items():
        own = totals[paths[path]]
        # Rounded down, but a float that is off by less than a thousandth of a token is the whole number it stands for.
        take = min(int(tokens + 1e-3), own * max_epochs)
        whole = take // own if own else 0
        plan.append((paths[path], int(whole), int(take - whole * own)))
    plans = spark.createDataFrame(plan, "leaf string, whole long, rest long")

    def order(id_: Column, th: Column) -> Column:
        return F.xxhash64(F.lit(seed), F.col("whole"), id_, th)

    def ranked() -> Column:
        """u in its unsigned order."""
        return F.col("u").bitwiseXOR(F.lit(-(1 << 63)))

    # Where each leaf's prefix ends: range by range, the first whose tokens no longer fit. At most max_leaves rows.
    bits = BUCKETS.bit_length() - 1
    plans = plans.withColumns({"range": F.lit(0).cast("long"), "before": F.lit(0).cast("long")})

    def inside(level: int) -> DataFrame:
        """The narrow rows of the ranges in which the prefixes end."""
        dealt = narrow.join(F.broadcast(plans.where("range is not null")), "leaf").withColumn("u", order(F.col("id"), F.col("th")))
        return dealt.where(F.shiftrightunsigned("u", 64 - bits * level) == F.col("range")) if level else dealt

    for level in range(1, LEVELS + 1):
        sums = inside(level - 1).groupBy("leaf", F.shiftrightunsigned("u", 64 - bits * level).alias("b")).agg(F.sum("tokens").alias("t"), F.first("rest").alias("rest"), F.first("before").alias("before"))
        upto = F.col("before") + F.sum("t").over(Window.partitionBy("leaf").orderBy("b"))
        ends = sums.withColumn("upto", upto).where(F.col("upto") > F.col("rest")).groupBy("leaf").agg(F.min(F.struct("b", (F.col("upto") - F.col("t")).alias("before"))).alias("end"))
        ends = ends.select("leaf", F.col("end.b").alias("range"), F.col("end.before").alias("before"))
        plans = materialize(plans.select("leaf", "whole", "rest").join(ends, "leaf", "left"), "mixing-plan")
    groups = inside(LEVELS).groupBy("leaf", ranked().alias("v"), "id", "th").agg(F.first("tokens").alias("each"), F.sum("tokens").alias("t"), F.first("rest").alias("rest"), F.first("before").alias("before"))
    upto = F.col("before") + F.sum("t").over(Window.partitionBy("leaf").orderBy("v", "id", "th").rowsBetween(Window.unboundedPreceding, 0))
    over = groups.withColumn("upto", upto).where(F.col("upto") > F.col("rest"))
    fit = F.when(F.col("each") > 0, F.floor((F.col("rest") - (F.col("upto") - F.col("t"))) / F.col("each")).cast("long")).otherwise(0)
    cuts = over.groupBy("leaf").agg(F.min(F.struct(F.struct("v", "id", "th").alias("cut"), fit.alias("fit"))).alias("end")).select("leaf", "end.cut", "end.fit")
    plans = materialize(plans.select("leaf", "whole").join(cuts, "leaf", "left"), "mixing-plan")
    # The row goes as one struct, so that its columns cannot clash with those added here.
    kept = [c for c in df.columns if c not in ("tokens", "epochs")]
    packed = df.select(F.struct(*(F.col(c) for c in kept)).alias("row"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), n_tokens(F.col(text_col)).alias("tokens"), leaf.alias("leaf"))
    rows = packed.join(F.broadcast(plans), "leaf").withColumn("u", order(F.col("id"), F.col("th"))).withColumn("place", F.struct(ranked().alias("v"), "id", "th"))
    at_cut = F.coalesce((F.col("place") == F.col("cut")) & (F.col("fit") > 0), F.lit(False))
    sure = rows.where(~at_cut).withColumn("more", F.when(F.col("cut").isNull() | (F.col("place") < F.col("cut")), 1).otherwise(0))
    # Only rows that agree in identifier and text, of which some fit and some do not.
    edge = rows.where(at_cut).withColumn("more", F.when(F.row_number().over(Window.partitionBy("leaf").orderBy("u")) <= F.col("fit"), 1).otherwise(0))
    out = sure.unionByName(edge).withColumn("epochs", (F.col("whole") + F.col("more")).cast("long"))
    return out.where("epochs > 0").select("row.*", "tokens", "epochs")


#: Domains of the test corpus and the mix that is asked for.
DOMAINS = ("web", "reference", "forum")
WEIGHTS = {("web",): 0.5, ("reference",): 0.3, ("forum",): 0.2} | {(d, lang): w for d in DOMAINS for lang, w in (("en", 0.55), ("de", 0.2), ("fr", 0.15), ("es", 0.1))}


def corpus_levels() -> list[Column]:
    """Domain (dealt by source, as the corpus names none), language and source."""
    domain = F.element_at(F.array(*map(F.lit, DOMAINS)), (F.crc32(F.coalesce("source", F.lit(""))) % len(DOMAINS) + 1).cast("int"))
    return [domain, F.col("lang"), F.col("source")]


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    levels = corpus_levels()
    taken = mix(read_table(spark, sf_dir, "documents"), levels, WEIGHTS, seed=7)
    return taken.select("doc_id", levels[0].alias("domain"), "lang", "source", "tokens", "epochs")
