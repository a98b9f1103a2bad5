"""Snapshots, differences, three-way merges and change capture. Versions are immutable Parquet folders and a log table."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def checksum(df: DataFrame) -> DataFrame:
    """Order-free fingerprint of a table: rows, and the XOR and sum of their hashes."""
    h = F.xxhash64(*df.columns)
    return df.agg(F.count("*").alias("rows"), F.bit_xor(h).alias("x"), F.sum(F.pmod(h, F.lit(1_000_003))).alias("s"))


def diff(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """(key, change, columns): rows added, deleted or modified from a to b, with the names of the changed columns."""
    values = [c for c in a.columns if c not in key]
    x = a.select(*key, F.struct(*values).alias("_a"))
    y = b.select(*key, F.struct(*values).alias("_b"))
    j = x.join(y, key, "full")
    changed = F.array_compact(F.array(*(F.when(~F.col(f"_a.{c}").eqNullSafe(F.col(f"_b.{c}")), c) for c in values)))
    kind = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "deleted").when(F.size(changed) > 0, "modified")
    return j.select(*key, kind.alias("change"), F.when(kind == "modified", F.concat_ws(",", changed)).alias("columns")).where("change is not null")


def change_counts(differences: DataFrame) -> DataFrame:
    return differences.groupBy("change").agg(F.count("*").alias("n"))


def merge3(base: DataFrame, source: DataFrame, target: DataFrame, key: list[str], prefer: str = "target") -> DataFrame:
    """Three-way merge, column by column; adds conflicts, the names of columns that both sides changed differently.

    A conflict takes the preferred side. Of a deletion against a change the changed row stays; a row that one side deleted
    and the other left alone goes.
    """
    values = [c for c in base.columns if c not in key]
    sides = {n: df.select(*key, F.struct(*values).alias(n)) for n, df in (("_o", base), ("_s", source), ("_t", target))}
    j = sides["_o"].join(sides["_s"], key, "full").join(sides["_t"], key, "full")
    o, s, t = (lambda c, n=n: F.col(f"{n}.{c}") for n in ("_o", "_s", "_t"))
    s_changed, t_changed = ~F.col("_s").eqNullSafe(F.col("_o")), ~F.col("_t").eqNullSafe(F.col("_o"))
    gone_s, gone_t, known = F.col("_s").isNull(), F.col("_t").isNull(), F.col("_o").isNotNull()
    drop = (known & gone_s & gone_t) | (known & gone_s & ~t_changed) | (known & gone_t & ~s_changed)

    def value(c: str) -> Column:
        conflict = ~s(c).eqNullSafe(o(c)) & ~t(c).eqNullSafe(o(c)) & ~s(c).eqNullSafe(t(c))
        chosen = s(c) if prefer == "source" else t(c)
        return F.when(gone_s, t(c)).when(gone_t, s(c)).when(conflict, chosen).when(~s(c).eqNullSafe(o(c)), s(c)).otherwise(t(c)).alias(c)

    both = ~gone_s & ~gone_t
    conflicts = F.array_compact(F.array(*(F.when(both & ~s(c).eqNullSafe(o(c)) & ~t(c).eqNullSafe(o(c)) & ~s(c).eqNullSafe(t(c)), c) for c in values)))
    lost = F.when(known & ((gone_s & t_changed) | (gone_t & s_changed)), F.array(F.lit("*"))).otherwise(conflicts)
    return j.where(~F.coalesce(drop, F.lit(False))).select(*key, *map(value, values), F.concat_ws(",", lost).alias("conflicts"))


def latest(changes: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last change of each key; order must be total."""
    place = F.struct(*order)
    rest = [c for c in changes.columns if c not in key]
    return changes.groupBy(*key).agg(F.max_by(F.struct(*rest), place).alias("_r")).select(*key, "_r.*")


def apply_changes(table: DataFrame, changes: DataFrame, key: list[str], order: list[str], kind: str = "change") -> DataFrame:
    """table after inserts, updates, upserts and deletes, the last change of each key counting."""
    last = latest(changes, key, order)
    kept = table.join(last.select(*key), key, "left_anti")
    fresh = last.where(F.lower(kind) != "delete").select(*table.columns)
    return kept.unionByName(fresh)


def capture(before: DataFrame, after: DataFrame, key: list[str], foreign: list[str] = ()) -> DataFrame:
    """Change events: kind, both images as maps, and the foreign key columns that changed."""
    values = [c for c in before.columns if c not in key]
    image = lambda n: F.when(F.col(n).isNotNull(), F.map_from_arrays(F.array(*map(F.lit, values)), F.array(*(F.col(f"{n}.{c}").cast("string") for c in values))))
    j = before.select(*key, F.struct(*values).alias("_b")).join(after.select(*key, F.struct(*values).alias("_a")), key, "full")
    kind = F.when(F.col("_b").isNull(), "INSERT").when(F.col("_a").isNull(), "DELETE").when(~F.col("_a").eqNullSafe(F.col("_b")), "UPDATE")
    moved = F.array_compact(F.array(*(F.when(~F.col(f"_b.{c}").eqNullSafe(F.col(f"_a.{c}")), c) for c in foreign))) if foreign else F.array().cast("array<string>")
    return j.select(*key, kind.alias("change"), image("_b").alias("before"), image("_a").alias("after"), moved.alias("affected_keys")).where("change is not null")


def resolve(before: Column, after: Column, strategy: str, before_at: Column | None = None, after_at: Column | None = None) -> Column:
    """Value of a conflict: source (after), target (before), merge (after unless null) or latest by the times given."""
    if strategy == "latest":
        if before_at is None or after_at is None:
            raise ValueError("latest compares times; give both")
        return F.when(after_at >= before_at, after).otherwise(before)
    kinds = {"source": after, "target": before, "merge": F.coalesce(after, before)}
    if strategy not in kinds:
        raise ValueError(f"{strategy} needs a decision for each conflict")
    return kinds[strategy]


def cascade(parents: DataFrame, key: str, children: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """(table, n): rows that refer to the given parents."""
    ids = parents.select(F.col(key).alias("_k")).distinct()
    return reduce(DataFrame.unionByName, (df.join(ids, F.col(fk) == F.col("_k"), "left_semi").agg(F.lit(t).alias("table"), F.count("*").alias("n")) for t, (df, fk) in children.items()))


class Repository:
    """Named tables under versions and branches, in a shared folder. A version's tables are whole, not samples."""

    LOG = "version string, branch string, parent string, message string, author string, tags array<string>, at double, tables array<struct<name:string,path:string,rows:long,x:long,s:long>>"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.heads: dict[str, str | None] = {"main": None}
        self.branch = "main"
        self.versions: dict[str, dict] = {}

    def commit(self, message: str, tables: dict[str, DataFrame], author: str = "", tags: tuple[str, ...] = ()) -> str:
        version = uuid.uuid4().hex[:8]
        entries = []
        for name, df in tables.items():
            where = f"{self.path}/{version}/{name}"
            df.write.parquet(where)
            c = checksum(self.spark.read.parquet(where)).first()
            entries.append({"name": name, "path": where, "rows": c.rows, "x": c.x, "s": c.s})
        entry = {"version": version, "branch": self.branch, "parent": self.heads[self.branch], "message": message, "author": author, "tags": list(tags), "at": time.time(), "tables": entries}
        self.spark.createDataFrame([entry], self.LOG).coalesce(1).write.mode("append").json(f"{self.path}/log")
        self.versions[version], self.heads[self.branch] = entry, version
        return version

    def checkout(self, version: str, verify: bool = True) -> dict[str, DataFrame]:
        out = {}
        for t in self.versions[version]["tables"]:
            df = self.spark.read.parquet(t["path"])
            if verify and tuple(checksum(df).first()) != (t["rows"], t["x"], t["s"]):
                raise ValueError(f"{t['name']} of {version} is not what was committed")
            out[t["name"]] = df
        return out

    def diff(self, a: str, b: str, keys: dict[str, list[str]]) -> dict[str, DataFrame]:
        x, y = self.checkout(a, False), self.checkout(b, False)
        return {n: diff(x[n], y[n], keys[n]) for n in x.keys() & y.keys()}

    def history(self, branch: str | None = None, limit: int = 50) -> list[dict]:
        out, at = [], self.heads[branch or self.branch]
        while at and len(out) < limit:
            out.append(self.versions[at])
            at = self.versions[at]["parent"]
        return out

    def create_branch(self, name: str, version: str | None = None) -> None:
        if name in self.heads:
            raise ValueError(f"there is a branch {name}")
        self.heads[name] = version or self.heads[self.branch]

    def switch(self, name: str) -> None:
        if name not in self.heads:
            raise KeyError(name)
        self.branch = name

    def delete_branch(self, name: str) -> None:
        if name in ("main", self.branch):
            raise ValueError("neither main nor the current branch can go")
        del self.heads[name]

    def common(self, a: str, b: str) -> str | None:
        seen = {e["version"] for e in self.history(a, 1 << 30)}
        return next((e["version"] for e in self.history(b, 1 << 30) if e["version"] in seen), None)

    def branches(self) -> list[tuple[str, str | None, bool]]:
        """(branch, head, whether it is the current one)."""
        return [(b, v, b == self.branch) for b, v in sorted(self.heads.items())]

    def compare(self, a: str, b: str) -> dict[str, object]:
        """The last common version, and how many versions either branch has beyond it."""
        base = self.common(a, b)

        def beyond(branch: str) -> int:
            versions = [e["version"] for e in self.history(branch, 1 << 30)]
            return versions.index(base) if base in versions else len(versions)

        return {"common": base, "ahead": beyond(a), "behind": beyond(b)}

    def merge(self, source: str, target: str, keys: dict[str, list[str]], prefer: str = "target", message: str = "merge") -> tuple[str, dict[str, int]]:
        """Merges source into target: fast forward if it can, else by rows and columns. Returns the version and conflicts by table."""
        base = self.common(source, target)
        if base == self.heads[target]:
            self.heads[target] = self.heads[source]
            return self.heads[target], {}
        o, s, t = self.checkout(base), self.checkout(self.heads[source]), self.checkout(self.heads[target])
        merged, conflicts = {}, {}
        for name in s.keys() | t.keys():
            if name not in s or name not in t:
                merged[name] = s.get(name, t.get(name))
                continue
            m = merge3(o.get(name, t[name].limit(0)), s[name], t[name], keys[name], prefer)
            conflicts[name] = m.where("conflicts <> ''").count()
            merged[name] = m.drop("conflicts")
        here, self.branch = self.branch, target
        try:
            return self.commit(message, merged), conflicts
        finally:
            self.branch = here


def subscribe(stream: DataFrame, handler: Callable, checkpoint: str, tables: list[str] | None = None, kinds: list[str] | None = None, condition: Column | None = None):
    """Hands the change events of some tables and kinds to a handler, batch by batch."""
    for column, wanted in (("table_name", tables), ("change", kinds)):
        stream = stream.where(F.col(column).isin(*wanted)) if wanted else stream
    stream = stream.where(condition) if condition is not None else stream
    return stream.writeStream.foreachBatch(handler).option("checkpointLocation", checkpoint).start()


def chain_breaks(log: DataFrame, order: str, link: str, digest: str) -> DataFrame:
    """Entries of an ordered log whose link isn't the digest of the one before.

    The log is ordered by range partitions; only the last entry of each is looked up by the next.
    """
    from quillstone.operators.overlap import ranked

    rows = ranked(log.select(order, link, digest), [order])
    before = rows.select((F.col("rank") + 1).alias("rank"), F.col(digest).alias("_d"))
    return rows.join(before, "rank", "left").where((F.col("rank") > 1) & ~F.col(link).eqNullSafe(F.col("_d"))).select(order)


def frequency(changes: DataFrame, key: str) -> DataFrame:
    g = changes.groupBy(key).agg(F.count("*").alias("n"))
    return g.crossJoin(F.broadcast(g.agg(F.avg("n").alias("mean"))))


class EvidenceChain:
    """Findings in order, each linked to the one before by a SHA-256 digest."""

    def __init__(self):
        self.blocks: list[tuple[int, str, str, str, str, str]] = []

    def add(self, phase: str, agent: str, finding: str) -> str:
        import hashlib

        previous = self.blocks[-1][5] if self.blocks else ""
        body = "|".join((str(len(self.blocks)), phase, agent, finding, previous))
        self.blocks.append((len(self.blocks), phase, agent, finding, previous, hashlib.sha256(body.encode()).hexdigest()))
        return self.blocks[-1][5]

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.blocks, "place long, phase string, agent string, finding string, previous string, digest string")


def evidence_breaks(chain: DataFrame) -> DataFrame:
    """Places of a chain's blocks whose digest is not that of their content, or whose link is not the digest before."""
    made = F.sha2(F.concat_ws("|", F.col("place").cast("string"), "phase", "agent", "finding", "previous"), 256)
    wrong = chain.where(made != F.col("digest")).select("place")
    return wrong.union(chain_breaks(chain, "place", "previous", "digest")).distinct()
