"""SQL over the views, and the deterministic part of answering questions in words: intent, join paths, and the query built from them."""

from __future__ import annotations

import re
import time
from collections import deque
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass
class SqlRunner:
    """Runs SQL and keeps count. Errors are raised."""

    spark: SparkSession
    runs: list[tuple[bool, float]] = field(default_factory=list)

    def execute(self, sql: str, args: list | dict | None = None) -> DataFrame:
        began = time.monotonic()
        try:
            df = self.spark.sql(sql, args=args) if args else self.spark.sql(sql)
        except Exception:
            self.runs.append((False, time.monotonic() - began))
            raise
        self.runs.append((True, time.monotonic() - began))
        return df

    def preview(self, table: str, limit: int = 5) -> DataFrame:
        return self.spark.table(table).limit(limit)

    def statistics(self) -> dict[str, float]:
        n = len(self.runs)
        return {"total": n, "succeeded": sum(ok for ok, _ in self.runs), "mean_ms": 1000 * sum(s for _, s in self.runs) / n if n else 0.0}

    def validate(self, sql: str) -> dict[str, object]:
        """Whether SQL can be analysed, the error if not, and the tables that the analysed plan reads."""
        try:
            plan = self.spark.sql(sql)._jdf.queryExecution().analyzed()
        except (AnalysisException, ParseException) as why:
            return {"valid": False, "error": str(why).split("\n")[0], "tables": []}
        found = set(re.findall(r"SubqueryAlias ([A-Za-z_][\w.]*)", plan.toString()))
        return {"valid": True, "error": None, "tables": sorted(x for x in found if self.spark.catalog.tableExists(x))}


#: Words that tell what a question asks for.
AGGREGATE_WORDS = {"sum": ("total", "sum", "합계", "총"), "avg": ("average", "mean", "평균"), "count": ("how many", "count", "number of", "개수", "몇"), "max": ("maximum", "highest", "largest", "최대"), "min": ("minimum", "lowest", "smallest", "최소")}
_TOP = re.compile(r"(?:top|상위)\s*(\d+)", re.I)


@dataclass(frozen=True)
class ForeignKey:
    from_table: str
    from_column: str
    to_table: str
    to_column: str


def join_type(left: str, fk: ForeignKey) -> str:
    """Keep the rows of the table that owns the key if it is on the left."""
    return "left" if left == fk.from_table else "inner"


class JoinPaths:
    """Paths in the undirected graph of foreign keys."""

    def __init__(self, keys: list[ForeignKey]):
        self.near: dict[str, list[tuple[str, ForeignKey]]] = {}
        for fk in keys:
            self.near.setdefault(fk.from_table, []).append((fk.to_table, fk))
            self.near.setdefault(fk.to_table, []).append((fk.from_table, fk))

    def find(self, source: str, target: str, max_hops: int = 4) -> list[ForeignKey] | None:
        """A shortest path; [] for a table and itself, None if there is none."""
        if source == target:
            return []
        seen, queue = {source}, deque([(source, [])])
        while queue:
            here, path = queue.popleft()
            if len(path) == max_hops:
                continue
            for other, fk in self.near.get(here, ()):
                if other == target:
                    return [*path, fk]
                if other not in seen:
                    seen.add(other)
                    queue.append((other, [*path, fk]))
        return None

    def all(self, source: str, target: str, max_hops: int = 3) -> list[list[ForeignKey]]:
        """All simple paths, shortest first."""
        out: list[list[ForeignKey]] = []

        def walk(here: str, path: list[ForeignKey], seen: set[str]) -> None:
            if here == target and path:
                out.append(path)
                return
            if len(path) < max_hops:
                for other, fk in self.near.get(here, ()):
                    if other not in seen:
                        walk(other, [*path, fk], seen | {other})

        walk(source, [], {source})
        return sorted(out, key=len)

    def connect(self, tables: list[str], base: str | None = None) -> list[ForeignKey]:
        """Keys that join all tables, each attached to the nearest one that is in already."""
        base = base or tables[0]
        inside, out, rest = {base}, [], [t for t in tables if t != base]
        while rest:
            options = [(len(p), t, p) for t in rest for s in sorted(inside) if (p := self.find(s, t)) is not None]
            if not options:
                raise ValueError(f"no path joins {rest} to {sorted(inside)}")
            _, table, path = min(options, key=lambda x: x[:2])
            for fk in path:
                if fk not in out:
                    out.append(fk)
                inside |= {fk.from_table, fk.to_table}
            rest = [t for t in rest if t not in inside]
        return out

    def related(self, table: str) -> list[str]:
        return sorted({t for t, _ in self.near.get(table, ())})


def join_along(tables: dict[str, DataFrame], base: str, path: list[ForeignKey], how: str = "inner") -> DataFrame:
    """base joined with the tables of a path, in order."""
    df, inside = tables[base], {base}
    for fk in path:
        other = fk.to_table if fk.from_table in inside else fk.from_table
        if other in inside:
            continue
        df = df.join(tables[other], F.col(fk.from_column) == F.col(fk.to_column), how)
        inside.add(other)
    return df


def join_sql(base: str, path: list[ForeignKey]) -> str:
    """The FROM clause of a path."""
    out, inside = base, {base}
    for fk in path:
        other = fk.to_table if fk.from_table in inside else fk.from_table
        if other not in inside:
            out += f"\nINNER JOIN {other} ON {fk.from_table}.{fk.from_column} = {fk.to_table}.{fk.to_column}"
            inside.add(other)
    return out


def intent(question: str, columns: dict[str, list[str]]) -> dict[str, object]:
    """Aggregate, limit, tables and columns that a question names. Names match as words, plurals included."""
    low = question.lower()

    def named(name: str) -> bool:
        plain = name.lower().split("_", 1)[-1] if re.match(r"^[a-z]{1,2}_", name) else name.lower()
        return any(re.search(rf"\b{re.escape(x)}(s|es)?\b", low) for x in {name.lower(), plain, plain.rstrip("s")} if len(x) > 2)

    tables = [t for t in columns if named(t)]
    aggregate = next((a for a, words in AGGREGATE_WORDS.items() if any(re.search(rf"\b{w}\b", low) if w.isascii() else w in low for w in words)), None)
    top = _TOP.search(question)
    return {"aggregate": aggregate, "limit": int(top[1]) if top else None, "tables": tables, "columns": {t: [c for c in columns[t] if named(c)] for t in tables}}


def answer(spark: SparkSession, question: str, tables: dict[str, DataFrame], keys: list[ForeignKey], model: Callable[[str, dict], str] | None = None) -> DataFrame:
    """Rows for a question: SQL from a model if one is given, else the plan that the intent describes."""
    columns = {t: df.columns for t, df in tables.items()}
    found = intent(question, columns)
    if model is not None:
        return spark.sql(model(question, found))
    if not found["tables"]:
        raise ValueError("the question names no table")
    base = found["tables"][0]
    df = join_along(tables, base, JoinPaths(keys).connect(found["tables"], base)) if len(found["tables"]) > 1 else tables[base]
    numeric = {c for t in tables.values() for c, kind in t.dtypes if kind in ("bigint", "int", "double", "float") or kind.startswith("decimal")}
    named = [c for t in found["tables"] for c in found["columns"][t]]
    measures, groups = [c for c in named if c in numeric], [c for c in named if c not in numeric]
    if found["aggregate"] == "count" or (found["aggregate"] and not measures):
        out = df.groupBy(*groups).agg(F.count("*").alias("n")) if groups else df.agg(F.count("*").alias("n"))
        return out.orderBy(F.desc("n"), *groups).limit(found["limit"]) if found["limit"] else out
    if found["aggregate"]:
        made = [getattr(F, found["aggregate"])(c).alias(f"{found['aggregate']}_{c}") for c in measures]
        out = df.groupBy(*groups).agg(*made) if groups else df.agg(*made)
        return out.orderBy(F.desc(f"{found['aggregate']}_{measures[0]}"), *groups).limit(found["limit"]) if found["limit"] else out
    return df.limit(found["limit"]) if found["limit"] else df
