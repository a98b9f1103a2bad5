"""Processes over event logs, batches of actions with their undoing, plans of dependent tasks, gates between phases."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.storage import materialize


def transitions(events: DataFrame, case: str, step: str, order: list[str]) -> DataFrame:
    """(source, target, n, seconds): which step follows which within a case, how often and after how long on average."""
    w = Window.partitionBy(case).orderBy(*order)
    rows = events.select(F.col(step).alias("source"), F.lead(step).over(w).alias("target"), (F.lead(order[0]).over(w).cast("timestamp").cast("double") - F.col(order[0]).cast("timestamp").cast("double")).alias("s"))
    return rows.where("target is not null").groupBy("source", "target").agg(F.count("*").alias("n"), F.round(F.avg("s"), 3).alias("seconds"))


def late_cases(events: DataFrame, case: str, time: str, seconds: float) -> DataFrame:
    """Cases that took longer from their first to their last event than agreed."""
    g = events.groupBy(case).agg(F.count("*").alias("steps"), (F.max(time).cast("timestamp").cast("double") - F.min(time).cast("timestamp").cast("double")).alias("s"))
    return g.where(F.col("s") > seconds).select(case, "steps", F.round("s", 3).alias("seconds"))


#: Words of table and column names that tell a business process.
PROCESSES = {"order to cash": ("order", "customer", "invoice", "payment"), "procure to pay": ("supplier", "purchase", "part"), "support": ("ticket", "case", "agent")}


def processes(names: list[str], least: int = 2) -> list[tuple[str, int]]:
    """(process, words found) of the processes that names tell of."""
    low = " ".join(names).lower()
    return sorted((p, n) for p, words in PROCESSES.items() if (n := sum(w in low for w in words)) >= least)


@dataclass
class Writeback:
    """Actions on named tables, in order. Tables are immutable, so what was before is kept, and undoing is going back to it."""

    tables: dict[str, DataFrame]
    log: list[tuple[str, str, str]] = field(default_factory=list)  # action, table, state
    _before: list[tuple[str, DataFrame] | None] = field(default_factory=list)

    def execute(self, name: str, table: str, change: Callable[[DataFrame], DataFrame], approve: Callable[[str, str], bool] = lambda name, table: True) -> bool:
        """Whether the action was done; errors of the change are noted and leave the table as it was."""
        if not approve(name, table):
            self._note(name, table, "rejected", None)
            return False
        try:
            made = change(self.tables[table])
        except Exception as why:  # an action's own error is a result of the batch
            self._note(name, table, f"failed: {type(why).__name__}", None)
            return False
        self._note(name, table, "done", (table, self.tables[table]))
        self.tables[table] = made
        return True

    def _note(self, name: str, table: str, state: str, before: tuple[str, DataFrame] | None) -> None:
        self.log.append((name, table, state))
        self._before.append(before)

    def batch(self, actions: list[tuple[str, str, Callable[[DataFrame], DataFrame]]], stop_on_error: bool = False, approve: Callable[[str, str], bool] = lambda name, table: True) -> int:
        """Runs actions (name, table, change); the number that was done."""
        done = 0
        for name, table, change in actions:
            if self.execute(name, table, change, approve):
                done += 1
            elif stop_on_error and self.log[-1][2].startswith("failed"):
                break
        return done

    def rollback(self, n: int = 1) -> None:
        """Undoes the last n actions that were done."""
        for k in range(len(self.log) - 1, -1, -1):
            if n and self._before[k] is not None:
                table, before = self._before[k]
                self.tables[table], self._before[k] = before, None
                self.log[k] = (*self.log[k][:2], "rolled back")
                n -= 1


def layers(needs: Mapping[str, list[str]]) -> list[list[str]]:
    """Tasks that can run together, layer by layer; a circle of needs is an error."""
    rest, out = {t: set(n) for t, n in needs.items()}, []
    while rest:
        ready = sorted(t for t, n in rest.items() if not n & rest.keys())
        if not ready:
            raise ValueError(f"tasks need each other: {sorted(rest)}")
        out.append(ready)
        for t in ready:
            del rest[t]
    return out


def schedule(needs: Mapping[str, list[str]], priority: Mapping[str, int]) -> list[str]:
    """One order of tasks: what is ready, the highest priority first, then by name."""
    done, out = set(), []
    layers(needs)  # refuses circles
    while len(out) < len(needs):
        ready = [t for t, n in needs.items() if t not in done and not (set(n) & needs.keys()) - done]
        best = min(ready, key=lambda t: (-priority.get(t, 0), t))
        out.append(best)
        done.add(best)
    return out


@dataclass
class Stages:
    """Stages over a table, each with what runs before and after it; a stage that fails is tried again."""

    stages: list[tuple[str, Callable[[DataFrame], DataFrame]]]
    before: list[Callable[[str, DataFrame], None]] = field(default_factory=list)
    after: list[Callable[[str, DataFrame], None]] = field(default_factory=list)
    retries: int = 0

    def run(self, df: DataFrame) -> DataFrame:
        for name, stage in self.stages:
            for hook in self.before:
                hook(name, df)
            for attempt in range(self.retries + 1):
                try:
                    made = stage(df)
                    break
                except Exception:
                    if attempt == self.retries:
                        raise
            df = made
            for hook in self.after:
                hook(name, df)
        return df


@dataclass
class Task:
    """Work on the results of other tasks; it is tried again if it fails."""

    work: Callable[..., DataFrame]
    needs: tuple[str, ...] = ()
    retries: int = 0


def run_tasks(tasks: Mapping[str, Task], together: int = 10) -> tuple[dict[str, DataFrame], list[tuple[str, int, int, str]]]:
    """Results of tasks, each given the results it needs in that order, and a log (task, layer, attempts, state).

    Tasks of a layer run together, as many as ``together`` at once; their results are written, so nothing runs twice. What
    needs a task that failed is skipped, all else goes on.
    """
    found: dict[str, DataFrame] = {}
    log: list[tuple[str, int, int, str]] = []

    def attempt(name: str) -> tuple[DataFrame | None, int, str]:
        task = tasks[name]
        if any(n not in found for n in task.needs):
            return None, 0, "skipped"
        for k in range(1, task.retries + 2):
            try:
                return materialize(task.work(*(found[n] for n in task.needs)), "task"), k, "done"
            except Exception as why:  # the log tells what a task met
                state = "failed: " + str(why).splitlines()[0]
        return None, task.retries + 1, state

    for place, names in enumerate(layers({name: list(task.needs) for name, task in tasks.items()})):
        with ThreadPoolExecutor(together) as pool:
            made = list(pool.map(attempt, names))
        for name, (df, attempts, state) in zip(names, made, strict=True):
            log.append((name, place, attempts, state))
            if df is not None:
                found[name] = df
    return found, log


def report(found: Mapping[str, DataFrame]) -> DataFrame:
    """(finding, n): how many rows each task left."""
    return reduce(DataFrame.unionByName, (df.agg(F.lit(name).alias("finding"), F.count("*").alias("n")) for name, df in found.items()))


def gates(findings: Mapping[str, DataFrame], required: Mapping[str, Mapping[str, int]]) -> DataFrame:
    """(phase, finding, n, passed): whether each phase left at least the rows of each finding that the next needs."""
    spark = next(iter(findings.values())).sparkSession
    counts = reduce(DataFrame.unionByName, (df.agg(F.lit(name).alias("finding"), F.count("*").alias("n")) for name, df in findings.items()))
    need = spark.createDataFrame([(p, f, n) for p, fs in required.items() for f, n in fs.items()], "phase string, finding string, least long")
    j = need.join(counts, "finding", "left").fillna(0, ["n"])
    return j.select("phase", "finding", "n", (F.col("n") >= F.col("least")).alias("passed"))


def attribution(evidence: DataFrame, decision: str = "decision", source: str = "source", weight: str = "weight") -> DataFrame:
    """(decision, source, share): what part of the weight behind each decision comes from each source."""
    g = evidence.groupBy(decision, source).agg(F.sum(weight).alias("w"))
    total = evidence.groupBy(decision).agg(F.sum(weight).alias("all"))
    return g.join(total, decision).select(decision, source, F.round(F.col("w") / F.col("all"), 6).alias("share"))


def patterns(experiences: DataFrame, situation: str, action: str, success: Column, least: int = 5) -> DataFrame:
    """(situation, action, n, rate): how often an action went well in a situation that came up often enough; the best of each situation."""
    g = experiences.groupBy(situation, action).agg(F.count("*").alias("n"), F.avg(success.cast("int")).alias("rate")).where(F.col("n") >= least)
    w = Window.partitionBy(situation).orderBy(F.desc("rate"), F.desc("n"), action)
    return g.withColumn("_r", F.row_number().over(w)).where("_r = 1").select(situation, action, "n", F.round("rate", 6).alias("rate"))
