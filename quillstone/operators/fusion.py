"""Evidence, votes, calibration, audit reports, state machines and behaviours."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

Mass = dict[frozenset, float]


def belief(m: Mass, a: frozenset) -> float:
    return sum(v for s, v in m.items() if s and s <= a)


def plausibility(m: Mass, a: frozenset) -> float:
    return sum(v for s, v in m.items() if s & a)


def pignistic(m: Mass) -> dict[str, float]:
    out: dict[str, float] = {}
    for s, v in m.items():
        for x in s:
            out[x] = out.get(x, 0.0) + v / len(s)
    return out


def conflict(a: Mass, b: Mass) -> float:
    return sum(x * y for (s, x), (t, y) in product(a.items(), b.items()) if not s & t)


def combine(a: Mass, b: Mass, rule: str = "dempster") -> Mass:
    """Dempster's rule, or Yager's, which gives the conflict to the whole frame, or Murphy's average combined with itself."""
    if rule == "murphy":
        mean = {s: (a.get(s, 0.0) + b.get(s, 0.0)) / 2 for s in a.keys() | b.keys()}
        return combine(mean, mean)
    out: Mass = {}
    for (s, x), (t, y) in product(a.items(), b.items()):
        if s & t:
            out[s & t] = out.get(s & t, 0.0) + x * y
    k = conflict(a, b)
    if rule == "yager":
        whole = frozenset().union(*a, *b)
        out[whole] = out.get(whole, 0.0) + k
        return out
    if k >= 1 - 1e-12:
        raise ValueError("the evidence contradicts itself wholly")
    return {s: v / (1 - k) for s, v in out.items()}


def weighted_votes(votes: DataFrame, topic: str = "topic", vote: str = "vote", confidence: str = "confidence") -> DataFrame:
    """Decision of each topic: abstentions and voters over two population deviations off are left out, the rest weighs by confidence.

    The result's confidence is agreement times mean confidence; under a half it is REVIEW.
    """
    w = Window.partitionBy(topic)
    rows = votes.where(F.lower(vote) != "abstain").withColumn("_m", F.avg(confidence).over(w)).withColumn("_s", F.stddev_pop(confidence).over(w))
    rows = rows.where((F.col("_s") == 0) | (F.abs(F.col(confidence) - F.col("_m")) <= 2 * F.col("_s")))
    g = rows.groupBy(topic, vote).agg(F.sum(confidence).alias("w"), F.count("*").alias("n"))
    t = g.withColumn("all", F.sum("w").over(w)).withColumn("voters", F.sum("n").over(w)).withColumn("r", F.row_number().over(w.orderBy(F.desc("w"), vote))).where("r = 1")
    final = F.col("w") / F.col("all") * F.col("all") / F.col("voters")
    return t.select(topic, F.when(final < 0.5, "REVIEW").otherwise(F.col(vote)).alias("decision"), F.round(final, 6).alias("confidence"))


def soft_consensus(opinions: DataFrame, topic: str = "topic", confidence: str = "confidence", weight: str = "weight", accept: float = 0.75, reject: float = 0.3) -> DataFrame:
    mean = F.sum(F.col(confidence) * F.col(weight)) / F.sum(weight)
    agreement = 1 - F.least(F.lit(1.0), 4 * F.var_pop(confidence))
    return opinions.groupBy(topic).agg(F.round(mean, 6).alias("score"), F.round(agreement, 6).alias("agreement"), F.when(mean >= accept, "accepted").when(mean <= reject, "rejected").otherwise("provisional").alias("state"))


def calibration(df: DataFrame, confidence: Column, correct: Column, bins: int = 10) -> DataFrame:
    """Expected and greatest calibration error; confidence 1 is in the last bin."""
    place = F.least(F.floor(confidence * bins), F.lit(bins - 1))
    g = df.select(place.alias("b"), confidence.alias("c"), correct.cast("double").alias("y")).groupBy("b").agg(F.count("*").alias("n"), F.abs(F.avg("c") - F.avg("y")).alias("gap"))
    return g.agg(F.round(F.sum(F.col("n") * F.col("gap")) / F.sum("n"), 6).alias("ece"), F.round(F.max("gap"), 6).alias("mce"))


def scaled(confidence: Column, temperature: Column | float) -> Column:
    p = F.least(F.greatest(confidence, F.lit(1e-6)), F.lit(1 - 1e-6))
    return 1 / (1 + F.exp(-F.log(p / (1 - p)) / temperature))


def fit_temperature(df: DataFrame, confidence: Column, correct: Column, bins: int = 10) -> DataFrame:
    """(temperature, ece) for a grid from .5 to 3, each with its own bins; the least error first."""
    grid = F.explode(F.array(*(F.lit(round(0.5 + 0.25 * k, 2)) for k in range(11))))
    rows = df.select(confidence.alias("c"), correct.cast("double").alias("y"), grid.alias("temperature")).withColumn("c", scaled(F.col("c"), F.col("temperature")))
    g = rows.withColumn("b", F.least(F.floor(F.col("c") * bins), F.lit(bins - 1))).groupBy("temperature", "b").agg(F.count("*").alias("n"), F.abs(F.avg("c") - F.avg("y")).alias("gap"))
    return g.groupBy("temperature").agg(F.round(F.sum(F.col("n") * F.col("gap")) / F.sum("n"), 6).alias("ece")).orderBy("ece", "temperature")


def uncertainty(samples: DataFrame, topic: str, answer: str, confidence: str) -> DataFrame:
    """Variance of confidence and entropy of answers for each topic."""
    n = samples.groupBy(topic, answer).agg(F.count("*").alias("n"), F.sum(confidence).alias("s"), F.sum(F.col(confidence) * F.col(confidence)).alias("q"))
    t = n.groupBy(topic).agg(F.sum("n").alias("N"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum(F.col("n") * F.log("n")).alias("e"))
    return t.select(topic, F.round(F.col("q") / F.col("N") - F.pow(F.col("s") / F.col("N"), 2), 6).alias("variance"), F.round(F.log("N") - F.col("e") / F.col("N"), 6).alias("entropy"))


def audit_query(events: DataFrame, since=None, until=None, types: list[str] | None = None, actor: str | None = None, resource: str | None = None, limit: int = 1000) -> DataFrame:
    tests = [F.col("ts") >= since if since is not None else None, F.col("ts") <= until if until is not None else None, F.col("event_type").isin(*types) if types else None, F.col("actor") == actor if actor else None, F.contains(F.col("resource"), F.lit(resource)) if resource else None]
    for t in tests:
        events = events.where(t) if t is not None else events
    return events.orderBy("ts", "event_id").limit(limit)


def audit_report(events: DataFrame) -> DataFrame:
    """Counts by type, by actor and in all, in one pass of grouping sets."""
    return events.groupingSets([["event_type"], ["actor"], []], "event_type", "actor").agg(F.count("*").alias("n")).select("event_type", "actor", "n")


def governance(concepts: DataFrame) -> DataFrame:
    """Quality .3 confidence + .3 evidence + .3 status + .1 type, and the decision that follows."""
    q = 0.3 * F.col("confidence") + 0.3 * F.col("evidence") + 0.3 * F.col("status") + 0.1 * F.col("kind")
    decision = F.when(q >= 0.7, "approve").when(q < 0.3, "reject").when(F.col("confidence") < 0.5, "escalate").otherwise("schedule_review")
    return concepts.select("name", F.round(q, 6).alias("quality"), decision.alias("decision"))


def priority(actions: DataFrame) -> DataFrame:
    """.4 impact + .3 urgency + .3 (6 - effort); high from 4.0, medium from 3.2; quick wins have high impact and low effort."""
    p = 0.4 * F.col("impact") + 0.3 * F.col("urgency") + 0.3 * (6 - F.col("effort"))
    return actions.select("name", F.round(p, 4).alias("score"), F.when(p >= 4.0, "high").when(p >= 3.2, "medium").otherwise("low").alias("priority"), ((F.col("impact") >= 4) & (F.col("effort") <= 2)).alias("quick_win"))


@dataclass
class StateMachine:
    """States and guarded transitions, applied to whole tables of objects."""

    initial: str
    transitions: list[tuple[str, str, str, str]]  # event, from, to, guard expression
    finals: set[str] = field(default_factory=set)

    def validate(self) -> list[str]:
        """States that cannot be reached."""
        states = {self.initial} | {t[1] for t in self.transitions} | {t[2] for t in self.transitions}
        seen, queue = {self.initial}, [self.initial]
        while queue:
            x = queue.pop()
            for _, a, b, _ in self.transitions:
                if a == x and b not in seen:
                    seen.add(b)
                    queue.append(b)
        return sorted(states - seen)

    def fire(self, objects: DataFrame, event: str, state: str = "state") -> DataFrame:
        """objects after an event: each moves by the first transition whose guard holds, else stays."""
        moved = F.lit(None).cast("string")
        for name, a, b, guard in reversed(self.transitions):
            if name == event:
                moved = F.when((F.col(state) == a) & F.expr(guard or "true"), F.lit(b)).otherwise(moved)
        return objects.withColumn(state, F.coalesce(moved, F.col(state)))

    def mermaid(self) -> str:
        return "\n".join(["stateDiagram-v2", f"    [*] --> {self.initial}", *(f"    {a} --> {b}: {e}" for e, a, b, _ in self.transitions)])


@dataclass
class Behaviours:
    """Functions registered for object types: queries, computed columns, checks. Code strings are never run."""

    known: dict[tuple[str, str], tuple[str, Callable]] = field(default_factory=dict)

    def add(self, type_id: str, name: str, kind: str, run: Callable) -> None:
        if kind not in ("query", "computation", "validation", "mutation"):
            raise ValueError(f"no kind of behaviour {kind}")
        self.known[type_id, name] = (kind, run)

    def apply(self, type_id: str, name: str, df: DataFrame, require: str | None = None, **params) -> DataFrame:
        """Runs a behaviour over the objects that meet the precondition, a SQL expression."""
        kind, run = self.known[type_id, name]
        rows = df.where(F.expr(require)) if require else df
        made = run(rows, **params)
        if kind == "computation" and isinstance(made, Column):
            return rows.withColumn(name, made)
        return rows.where(made) if isinstance(made, Column) else made


def domain_of(spark: SparkSession, names: list[str], keywords: dict[str, list[str]], least: float = 0.2) -> str:
    """The domain most of whose words occur in table and column names; general if none reaches the limit."""
    score = {d: min(1.0, sum(0.2 for w in ws if any(w in n.lower() for n in names))) for d, ws in keywords.items()}
    best = max(sorted(score), key=lambda d: score[d])
    return best if score[best] >= least else "general"
