"""Windows, triggers and detectors over events. Every builder takes a batch or a streaming DataFrame alike."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions.scalars import wildcard

#: Comparison of a threshold trigger.
COMPARE = {">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, "==": lambda a, b: a == b, "!=": lambda a, b: a != b}


def marked(events: DataFrame, time: str = "ts", late: str = "10 minutes") -> DataFrame:
    """With a watermark if it is a stream; event time has to be a TIMESTAMP there."""
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late) if events.isStreaming else events


def _figures(value: str) -> list[Column]:
    return [F.count("*").alias("n"), F.round(F.sum(value), 4).alias("sum"), F.round(F.avg(value), 4).alias("mean"), F.max(value).alias("max")]


def _flat(df: DataFrame, by: list[str]) -> DataFrame:
    return df.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *by, "n", "sum", "mean", "max")


def tumbling(events: DataFrame, size: str = "5 minutes", by: list[str] = ("event_type",), time: str = "ts", value: str = "value") -> DataFrame:
    return _flat(marked(events, time).groupBy(F.window(time, size), *by).agg(*_figures(value)), list(by))


def sliding(events: DataFrame, size: str = "10 minutes", slide: str = "5 minutes", by: list[str] = ("event_type",), time: str = "ts", value: str = "value") -> DataFrame:
    return _flat(marked(events, time).groupBy(F.window(time, size, slide), *by).agg(*_figures(value)), list(by))


def sessions(events: DataFrame, gap: str = "30 minutes", by: list[str] = ("user_id",), time: str = "ts", value: str = "value") -> DataFrame:
    found = marked(events, time).groupBy(F.session_window(time, gap), *by).agg(*_figures(value))
    return _flat(found.withColumnRenamed("session_window", "window"), list(by))


def overall(events: DataFrame, by: list[str] = ("event_type",), value: str = "value") -> DataFrame:
    return events.groupBy(*by).agg(*_figures(value))


def busy(windows: DataFrame, rate: float = 100.0, mean: float | None = None) -> DataFrame:
    """Windows with over rate events a second, or whose mean is over a limit."""
    seconds = F.unix_timestamp("end") - F.unix_timestamp("start")
    test = F.col("n") / seconds > rate
    return windows.where(test | (F.col("mean") > mean) if mean is not None else test)


def threshold(field: str, operator: str, value: float) -> Column:
    """A trigger: the field reads as a number and compares so."""
    return F.coalesce(COMPARE[operator](F.col(field).cast("string").try_cast("double"), F.lit(float(value))), F.lit(False))


def pattern(field: str, patterns: list[str], regex: bool = False, every: bool = False) -> Column:
    tests = [F.col(field).rlike(p) if regex else F.col(field) == p for p in patterns]
    return F.coalesce(reduce((lambda a, b: a & b) if every else (lambda a, b: a | b), tests), F.lit(False))


def composite(triggers: list[Column], every: bool = True) -> Column:
    return reduce((lambda a, b: a & b) if every else (lambda a, b: a | b), triggers)


def fired(events: DataFrame, triggers: dict[str, Column], key: str = "event_id") -> DataFrame:
    """(key, trigger) for every trigger that an event sets off."""
    cells = [F.when(c, F.lit(n)) for n, c in triggers.items()]
    return events.select(key, F.explode(F.array_compact(F.array(*cells))).alias("trigger"))


def kpi_violations(payload: DataFrame, kpis: DataFrame, key: str = "event_id") -> DataFrame:
    """payload (key, name, value) against kpis (kpi, limit, higher_is_better), a small table of definitions; a KPI fits names that hold it."""
    joined = payload.join(F.broadcast(kpis), F.contains(F.lower("name"), F.lower("kpi")))
    bad = F.when(F.col("higher_is_better"), F.col("value") < F.col("limit")).otherwise(F.col("value") > F.col("limit"))
    return joined.where(bad).select(key, "kpi", "value")


def rolling_anomalies(events: DataFrame, key: str = "user_id", order: list[str] = ("ts", "event_id"), value: str = "value", last: int = 100, least: int = 10, limit: float = 3.0) -> DataFrame:
    """The batch form of the detector: z over the last values, the current one included; the limit rises by a tenth every thousand values."""
    w = Window.partitionBy(key).orderBy(*order)
    near = w.rowsBetween(-(last - 1), 0)
    rows = events.where(F.col(value).isNotNull())
    t = rows.select("*", F.count(value).over(near).alias("_n"), F.avg(value).over(near).alias("_m"), F.stddev_pop(value).over(near).alias("_s"), F.row_number().over(w).alias("_k"))
    z = F.abs(F.col(value) - F.col("_m")) / F.col("_s")
    return t.where((F.col("_n") >= least) & (F.col("_s") > 0) & (z > limit * (1 + 0.1 * F.col("_k") / 1000))).select("event_id", key, value, F.round(z, 4).alias("z"))


def stateful_anomalies(events: DataFrame, last: int = 100, least: int = 10, limit: float = 3.0) -> DataFrame:
    """The streaming form: keeps each user's last values in state. Order within a micro-batch is by time and event."""

    def run(key, batches, state):
        held, total = list(state.get[0]) if state.exists else [], state.get[1] if state.exists else 0
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        out = []
        for event, value in zip(rows["event_id"], rows["value"], strict=True):
            if value != value or value is None:
                continue
            held = [*held, float(value)][-last:]
            total += 1
            if len(held) >= least:
                s = pd.Series(held)
                sd = s.std(ddof=0)
                z = abs(value - s.mean()) / sd if sd > 0 else 0.0
                if z > limit * (1 + 0.1 * total / 1000):
                    out.append((int(event), int(key[0]), float(value), round(float(z), 4)))
        state.update((held, total))
        yield pd.DataFrame(out, columns=["event_id", "user_id", "value", "z"]).astype({"event_id": "int64", "user_id": "int64", "value": "float64", "z": "float64"})

    rows = events.select("user_id", "ts", "event_id", "value")
    return rows.groupBy("user_id").applyInPandasWithState(run, "event_id long, user_id long, value double, z double", "held array<double>, total long", "append", "NoTimeout")


def debounced(hits: DataFrame, by: str, time: str = "ts", seconds: int = 60, order: str = "event_id") -> DataFrame:
    """The first hit of each quiet period: a hit counts if none stands within the seconds before it."""
    w = Window.partitionBy(by).orderBy(time, order)
    gap = F.unix_timestamp(time) - F.unix_timestamp(F.lag(time).over(w))
    return hits.withColumn("_g", gap).where(F.col("_g").isNull() | (F.col("_g") > seconds)).drop("_g")


def chain(events: DataFrame, start: str, key: str = "event_id", cause: str = "cause_id", most: int = 1000) -> DataFrame:
    """An event and what caused it, step by step back; a chain of over most steps (a cycle) is an error."""
    known = events.select(F.col(key).alias("id"), F.col(cause).alias("cause"))
    out, at = [], start
    while at is not None:
        found = known.where(F.col("id") == at).first()
        if found is None:
            break
        if len(out) > most:
            raise RuntimeError(f"the chain has over {most} steps")
        out.append((found.id, len(out)))
        at = found.cause
    return events.sparkSession.createDataFrame(out, known.select("id", F.lit(0).alias("depth")).schema)


def run_to_end(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what there is and returns its result as a table."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)


def expired(windows: DataFrame, now: Column) -> DataFrame:
    """Windows that have ended by a time: what a watermark at that time would close."""
    return windows.where(F.col("end") <= now)


def rolling_iqr(events: DataFrame, key: str = "user_id", order: list[str] = ("ts", "event_id"), value: str = "value", last: int = 100, least: int = 10, k: float = 1.5) -> DataFrame:
    """Values outside the quartile fences of the last values of their key, themselves included; a window holds at most last values."""
    near = Window.partitionBy(key).orderBy(*order).rowsBetween(-(last - 1), 0)
    rows = events.where(F.col(value).isNotNull())
    t = rows.select("event_id", key, value, F.count(value).over(near).alias("_n"), F.percentile(value, 0.25).over(near).alias("_a"), F.percentile(value, 0.75).over(near).alias("_b"))
    reach = k * (F.col("_b") - F.col("_a"))
    return t.where((F.col("_n") >= least) & ((F.col(value) < F.col("_a") - reach) | (F.col(value) > F.col("_b") + reach))).select("event_id", key, value)


class EventBus:
    """Subscriptions by name pattern (* is one dotted segment, alone it is everything), priority and condition."""

    def __init__(self):
        self.subscriptions: list[tuple[str, str, int, Column | None]] = []

    def subscribe(self, name: str, pattern: str, priority: int = 0, condition: Column | None = None) -> EventBus:
        self.subscriptions.append((name, pattern, priority, condition))
        return self

    def dispatch(self, events: DataFrame, key: str = "event_id", kind: str = "event_type") -> DataFrame:
        """(key, subscriber, place): who gets an event, the highest priority first, then by name."""
        cells = []
        for name, pattern, _, condition in sorted(self.subscriptions, key=lambda s: (-s[2], s[0])):
            hit = F.col(kind).rlike(wildcard(pattern))
            cells.append(F.when(hit if condition is None else hit & condition, F.lit(name)))
        found = events.select(key, F.posexplode(F.array_compact(F.array(*cells))).alias("place", "subscriber"))
        return found.select(key, "subscriber", (F.col("place") + 1).alias("place"))


def engine(events: DataFrame, rules: dict[str, Column], kpis: DataFrame, size: str = "5 minutes", limit: float = 2.0) -> dict[str, DataFrame]:
    """One query for each concern on a shared source: anomalies, windows, rules that fire, KPIs that are violated."""
    return {
        "anomaly": rolling_anomalies(events, limit=limit),
        "window": tumbling(events, size),
        "rule": fired(events, rules),
        "kpi": kpi_violations(events.select("event_id", F.col("event_type").alias("name"), "value"), kpis),
    }


def run_batches(stream: DataFrame, handler, checkpoint: str) -> None:
    """Hands what a stream holds to a handler (batch, batch id), micro-batch by micro-batch, until nothing is left."""
    stream.writeStream.foreachBatch(handler).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
