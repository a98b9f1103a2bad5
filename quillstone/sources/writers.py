"""Sinks: findings as JSON, triples in the RDF text formats, audit lines, upserts and insight handlers."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_findings(findings: Mapping[str, DataFrame], path: str, scenario: str) -> None:
    """One JSON folder for each named finding."""
    for name, df in findings.items():
        df.write.mode("overwrite").json(f"{path}/{scenario}_{name}")


def _term(c: Column, prefixes: Mapping[str, str]) -> Column:
    """A URI in angle brackets, prefixes expanded, or a quoted literal."""
    out = F.when(c.rlike("^https?://"), F.concat(F.lit("<"), c, F.lit(">")))
    for prefix, full in prefixes.items():
        out = out.when(c.startswith(f"{prefix}:"), F.concat(F.lit(f"<{full}"), F.substr(c, F.lit(len(prefix) + 2)), F.lit(">")))
    escaped = F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))
    return out.otherwise(F.concat(F.lit('"'), escaped, F.lit('"')))


def ntriples(triples: DataFrame, prefixes: Mapping[str, str]) -> DataFrame:
    """One line for each triple."""
    s, p, o = (_term(F.col(c), prefixes) for c in ("subject", "predicate", "object"))
    return triples.select(F.concat(s, F.lit(" "), p, F.lit(" "), o, F.lit(" .")).alias("value"))


def turtle(triples: DataFrame, prefixes: Mapping[str, str]) -> DataFrame:
    """Prefix lines, then one statement a line, in order: 0 for prefixes, 1 for statements."""
    spark = triples.sparkSession
    head = spark.createDataFrame([(0, f"@prefix {p}: <{u}> .") for p, u in prefixes.items()], "part int, value string")
    known = "|".join(prefixes) or "(?!)"
    quoted = F.when(F.col("object").rlike(f"^({known}):"), F.col("object")).otherwise(F.concat(F.lit('"'), F.replace("object", F.lit('"'), F.lit('\\"')), F.lit('"')))
    return head.union(triples.select(F.lit(1), F.concat_ws(" ", "subject", "predicate", quoted, F.lit("."))))


def json_ld(triples: DataFrame) -> DataFrame:
    """One JSON object for each subject."""
    grouped = triples.groupBy("subject", "predicate").agg(F.array_sort(F.collect_list("object")).alias("objects"))
    members = grouped.groupBy("subject").agg(F.array_sort(F.collect_list(F.struct("predicate", "objects"))).alias("m"))
    return members.select(F.to_json(F.map_concat(F.create_map(F.lit("@id"), F.array("subject")), F.map_from_entries("m"))).alias("value"))


def append_audit(events: DataFrame, path: str) -> None:
    events.write.mode("append").json(path)


def upsert(existing: DataFrame, changes: DataFrame, key: list[str]) -> DataFrame:
    """existing with the rows of changes put in by key; what a MERGE would leave."""
    return existing.join(changes.select(*key), key, "left_anti").unionByName(changes, allowMissingColumns=True)


def each_batch(stream: DataFrame, handler: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append"):
    """Hands every micro-batch to a handler (webhook, log, key-value store); exactly once if the handler is idempotent by batch id."""
    return stream.writeStream.foreachBatch(handler).option("checkpointLocation", checkpoint).outputMode(mode).start()


def webhook(url: str, timeout: float = 10.0) -> Callable[[DataFrame, int], None]:
    """A handler that posts each row as JSON. Rows are streamed to the driver, not gathered."""

    def post(batch: DataFrame, _: int) -> None:
        import urllib.request

        for line in batch.toJSON().toLocalIterator():
            urllib.request.urlopen(urllib.request.Request(url, line.encode(), {"Content-Type": "application/json"}), timeout=timeout)

    return post


class UpsertSink:
    """A table in a folder that micro-batches are merged into by key. Of a key's rows that with the greatest order stays,
    whichever batch it comes in. Each batch writes a version named by its number, so a batch that runs again after a failure
    writes the same version, and readers see whole versions only."""

    def __init__(self, spark, path: str, key: list[str], order: list[str]):
        self.spark, self.path, self.key, self.order, self.version = spark, path.rstrip("/"), key, order, None

    def __call__(self, batch: DataFrame, number: int) -> None:
        place = F.struct(*self.order)
        known = self.table()
        rows = batch if known is None else known.unionByName(batch, allowMissingColumns=True)
        rest = [c for c in rows.columns if c not in self.key]
        last = rows.groupBy(*self.key).agg(F.max_by(F.struct(*rest), place).alias("_r")).select(*self.key, "_r.*")
        last.write.mode("overwrite").parquet(f"{self.path}/v{number}")
        self.version = number

    def table(self) -> DataFrame | None:
        return None if self.version is None else self.spark.read.parquet(f"{self.path}/v{self.version}")


def markdown(title: str, sections: Mapping[str, DataFrame], rows: int = 20) -> list[str]:
    """Lines of a report: a table for each section, its first rows only (a report is to be read)."""
    out = [f"# {title}"]
    for name, df in sections.items():
        shown = df.limit(rows + 1).collect()
        out += ["", f"## {name}", "", "| " + " | ".join(df.columns) + " |", "|" + "-|" * len(df.columns)]
        out += ["| " + " | ".join("" if v is None else str(v).replace("|", "\\|") for v in r) + " |" for r in shown[:rows]]
        out += ["", f"(first {rows} rows)"] if len(shown) > rows else []
    return out
