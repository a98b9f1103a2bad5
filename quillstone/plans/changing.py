"""Queries over versions, changes, streams, entities, fusion, sources and behaviours."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillstone.operators import entities as E
from quillstone.operators import fusion as U
from quillstone.operators import versioning as V
from quillstone.plans.linking import tables_of
from quillstone.plans.registry import register
from quillstone.sources import readers, writers
from quillstone.storage import read_table, scratch_path
from quillstone.streaming import windows as W


def _t(name):
    return lambda spark, sf_dir: read_table(spark, sf_dir, name)


orders, customer, events, part, labels, docs, nation = (_t(n) for n in ("orders", "customer", "events", "part", "labels", "documents", "nation"))
_KEY = ["o_orderkey"]


def _old(spark, sf_dir):
    return orders(spark, sf_dir).where("o_orderkey % 10 <> 3").select("o_orderkey", "o_orderstatus", "o_totalprice")


def _new(spark, sf_dir):
    return orders(spark, sf_dir).where("o_orderkey % 10 <> 4").select("o_orderkey", F.when(F.col("o_orderkey") % 7 == 0, "X").otherwise(F.col("o_orderstatus")).alias("o_orderstatus"), F.when(F.col("o_orderkey") % 5 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")).alias("o_totalprice"))


_OLD = "(SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 10 <> 3)"
_NEW = "(SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 5 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice FROM orders WHERE o_orderkey % 10 <> 4)"
_DIFF = f"SELECT o_orderkey, CASE WHEN a.o_totalprice IS NULL THEN 'added' WHEN b.o_totalprice IS NULL THEN 'deleted' ELSE 'modified' END AS change, CASE WHEN a.o_totalprice IS NOT NULL AND b.o_totalprice IS NOT NULL THEN concat_ws(',', CASE WHEN a.o_orderstatus <> b.o_orderstatus THEN 'o_orderstatus' END, CASE WHEN a.o_totalprice <> b.o_totalprice THEN 'o_totalprice' END) END AS columns FROM {_OLD} a FULL JOIN {_NEW} b USING (o_orderkey) WHERE a.o_totalprice IS NULL OR b.o_totalprice IS NULL OR a.o_orderstatus <> b.o_orderstatus OR a.o_totalprice <> b.o_totalprice"


@register("ver_03_diff", _DIFF)
def diff(spark, sf_dir):
    return V.diff(_old(spark, sf_dir), _new(spark, sf_dir), _KEY)


@register("ver_11_change_counts", f"SELECT change, count(*) AS n FROM ({_DIFF}) GROUP BY change")
def counts(spark, sf_dir):
    return V.change_counts(V.diff(_old(spark, sf_dir), _new(spark, sf_dir), _KEY))


@register("ver_01_commit", f"SELECT count(*) AS rows FROM {_OLD}")
def commit(spark, sf_dir):
    repository = V.Repository(spark, scratch_path(spark, "versions"))
    version = repository.commit("first", {"orders": _old(spark, sf_dir)})
    return repository.checkout(version)["orders"].agg(F.count("*").alias("rows"))


_SIDE = "(SELECT n_nationkey, {name} AS n_name, n_regionkey FROM nation {where})"
_SRC = _SIDE.format(name="CASE WHEN n_nationkey % 2 = 0 THEN n_name || 's' ELSE n_name END", where="WHERE n_nationkey <> 5")
_TGT = _SIDE.format(name="CASE WHEN n_nationkey % 3 = 0 THEN n_name || 't' ELSE n_name END", where="WHERE n_nationkey <> 7")


def _merged(spark, sf_dir, prefer):
    n = nation(spark, sf_dir).select("n_nationkey", "n_name", "n_regionkey")
    s = n.where("n_nationkey <> 5").withColumn("n_name", F.when(F.col("n_nationkey") % 2 == 0, F.concat("n_name", F.lit("s"))).otherwise(F.col("n_name")))
    t = n.where("n_nationkey <> 7").withColumn("n_name", F.when(F.col("n_nationkey") % 3 == 0, F.concat("n_name", F.lit("t"))).otherwise(F.col("n_name")))
    return V.merge3(n, s, t, ["n_nationkey"], prefer)


def _merge_sql(prefer):
    suffix = {"source": "s", "target": "t"}[prefer]
    return f"SELECT n_nationkey, CASE WHEN n_nationkey % 6 = 0 THEN n_name || '{suffix}' WHEN n_nationkey % 2 = 0 THEN n_name || 's' WHEN n_nationkey % 3 = 0 THEN n_name || 't' ELSE n_name END AS n_name, n_regionkey, CASE WHEN n_nationkey % 6 = 0 THEN 'n_name' ELSE '' END AS conflicts FROM nation WHERE n_nationkey NOT IN (5, 7)"


@register("ver_08_merge", _merge_sql("target"))
def merge(spark, sf_dir):
    return _merged(spark, sf_dir, "target")


@register("ver_09_merge_prefer_source", _merge_sql("source"))
def merge_source(spark, sf_dir):
    return _merged(spark, sf_dir, "source")


@register("ver_15_capture", f"SELECT o_orderkey, CASE change WHEN 'added' THEN 'INSERT' WHEN 'deleted' THEN 'DELETE' ELSE 'UPDATE' END AS change FROM ({_DIFF})")
def capture(spark, sf_dir):
    return V.capture(_old(spark, sf_dir), _new(spark, sf_dir), _KEY).select("o_orderkey", "change")


_CHANGES = "(SELECT user_id % 400 AS c_custkey, event_id, value, CASE WHEN event_id % 11 = 0 THEN 'delete' ELSE 'upsert' END AS change FROM events)"


def _changes(spark, sf_dir):
    return events(spark, sf_dir).select((F.col("user_id") % 400).alias("c_custkey"), "event_id", F.col("value").alias("c_acctbal"), F.when(F.col("event_id") % 11 == 0, "delete").otherwise("upsert").alias("change"))


@register("ver_18_replay", f"SELECT c_custkey, arg_max(change, event_id) AS change, max(event_id) AS event_id FROM {_CHANGES} GROUP BY 1")
def replay(spark, sf_dir):
    return V.latest(_changes(spark, sf_dir).withColumn("o", F.col("event_id")), ["c_custkey"], ["o"]).select("c_custkey", "change", "event_id")


@register("ver_19_apply_changes", f"WITH l AS (SELECT * FROM {_CHANGES} QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY event_id DESC) = 1) SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM l) UNION ALL SELECT c_custkey, value FROM l WHERE change <> 'delete'")
def apply_changes(spark, sf_dir):
    return V.apply_changes(customer(spark, sf_dir).select("c_custkey", "c_acctbal"), _changes(spark, sf_dir), ["c_custkey"], ["event_id"])


@register("ver_17_resolve", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice ELSE o_custkey END::DOUBLE AS v FROM orders")
def resolve(spark, sf_dir):
    after = F.when(F.col("o_orderkey") % 2 == 0, F.col("o_totalprice"))
    return orders(spark, sf_dir).select("o_orderkey", V.resolve(F.col("o_custkey").cast("double"), after, "merge").alias("v"))


@register("ver_10_latest", "SELECT o_orderkey, CASE WHEN o_orderdate >= TIMESTAMP '1996-01-01' THEN 'after' ELSE 'before' END AS v FROM orders")
def latest(spark, sf_dir):
    return orders(spark, sf_dir).select("o_orderkey", V.resolve(F.lit("before"), F.lit("after"), "latest", F.lit("1996-01-01").cast("timestamp"), F.col("o_orderdate").cast("timestamp")).alias("v"))


@register("ver_19_cascade", "SELECT 'orders' AS \"table\", count(*) AS n FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)")
def cascade(spark, sf_dir):
    return V.cascade(customer(spark, sf_dir).where("c_nationkey = 3"), "c_custkey", {"orders": (orders(spark, sf_dir), "o_custkey")})


@register("ver_13_upsert", "SELECT n_nationkey, CASE WHEN n_nationkey < 3 THEN 'NEW' ELSE n_name END AS n_name FROM nation")
def upsert(spark, sf_dir):
    n = nation(spark, sf_dir).select("n_nationkey", "n_name")
    return writers.upsert(n, n.where("n_nationkey < 3").withColumn("n_name", F.lit("NEW")), ["n_nationkey"])


def _chain(spark, sf_dir):
    e = events(spark, sf_dir).select("event_id", F.sha2(F.concat_ws("|", "event_id", "event_type"), 256).alias("hash"))
    w = Window.partitionBy(F.lit(1)).orderBy("event_id")
    linked = e.withColumn("previous", F.lag("hash").over(w))
    return linked.withColumn("previous", F.when(F.col("event_id") % 1000 == 500, "broken").otherwise(F.col("previous")))


@register("win_06_hash_chain", "SELECT event_id FROM events WHERE event_id % 1000 = 500")
def hash_chain(spark, sf_dir):
    return V.chain_breaks(_chain(spark, sf_dir), "event_id", "previous", "hash")


# Streams: the batch form is compared, the streaming form runs over the same rows.


def _window_sql(start, size):
    return f"SELECT {start} AS start, {start} + INTERVAL {size} AS \"end\", event_type, count(*) AS n, round(sum(value), 4) AS sum, round(avg(value), 4) AS mean, max(value) AS max FROM events GROUP BY ALL"


@register("str_03_tumbling", _window_sql("time_bucket(INTERVAL 5 MINUTE, ts, TIMESTAMP '1970-01-01')", "5 MINUTE"))
def tumbling(spark, sf_dir):
    return W.tumbling(events(spark, sf_dir))


@register("str_04_sliding", "WITH e AS (SELECT *, time_bucket(INTERVAL 5 MINUTE, ts, TIMESTAMP '1970-01-01') - INTERVAL 5 MINUTE * k AS start FROM events, (SELECT unnest([0, 1]) AS k)) SELECT start, start + INTERVAL 10 MINUTE AS \"end\", event_type, count(*) AS n, round(sum(value), 4) AS sum, round(avg(value), 4) AS mean, max(value) AS max FROM e GROUP BY ALL")
def sliding(spark, sf_dir):
    return W.sliding(events(spark, sf_dir))


@register("str_05_sessions", "WITH g AS (SELECT *, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= INTERVAL 30 MINUTE, true)::INT AS fresh FROM events), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g) SELECT min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS \"end\", user_id, count(*) AS n, round(sum(value), 4) AS sum, round(avg(value), 4) AS mean, max(value) AS max FROM s GROUP BY user_id, k")
def sessions(spark, sf_dir):
    return W.sessions(events(spark, sf_dir))


@register("str_06_overall", "SELECT event_type, count(*) AS n, round(sum(value), 4) AS sum, round(avg(value), 4) AS mean, max(value) AS max FROM events GROUP BY 1")
def overall(spark, sf_dir):
    return W.overall(events(spark, sf_dir))


@register("str_08_busy_windows", "WITH w AS (" + _window_sql("time_bucket(INTERVAL 5 MINUTE, ts, TIMESTAMP '1970-01-01')", "5 MINUTE") + ") SELECT start, event_type, n FROM w WHERE n / 300 > 100 OR mean > 60")
def busy(spark, sf_dir):
    return W.busy(W.tumbling(events(spark, sf_dir)), mean=60).select("start", "event_type", "n")


@register("str_11_threshold_trigger", "SELECT event_id FROM events WHERE value > 90")
def threshold(spark, sf_dir):
    return events(spark, sf_dir).where(W.threshold("value", ">", 90)).select("event_id")


@register("str_12_pattern_trigger", "SELECT event_id FROM events WHERE regexp_matches(event_type, '^(click|view)$')")
def pattern(spark, sf_dir):
    return events(spark, sf_dir).where(W.pattern("event_type", ["^click$", "^view$"], regex=True)).select("event_id")


@register("str_14_composite_trigger", "SELECT event_id, 'both' AS trigger FROM events WHERE value > 50 AND event_type = 'click' UNION ALL SELECT event_id, 'either' FROM events WHERE value > 50 OR event_type = 'click'")
def composite(spark, sf_dir):
    a, b = W.threshold("value", ">", 50), W.pattern("event_type", ["click"])
    return W.fired(events(spark, sf_dir), {"both": W.composite([a, b]), "either": W.composite([a, b], every=False)})


@register("str_09_kpi_violations", "SELECT event_id, 'click' AS kpi, value FROM events WHERE contains(lower(event_type), 'click') AND value < 20")
def kpis(spark, sf_dir):
    definitions = spark.createDataFrame([("click", 20.0, True)], "kpi string, limit double, higher_is_better boolean")
    return W.kpi_violations(events(spark, sf_dir).select("event_id", F.col("event_type").alias("name"), "value"), definitions)


_ROLL = "WITH t AS (SELECT event_id, user_id, value, count(value) OVER n AS k, avg(value) OVER n AS m, stddev_pop(value) OVER n AS s, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events WHERE value IS NOT NULL WINDOW n AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW)) SELECT event_id, user_id, value, round(abs(value - m) / s, 4) AS z FROM t WHERE k >= 10 AND s > 0 AND abs(value - m) / s > 2 * (1 + 0.1 * r / 1000)"


@register("str_02_rolling_anomalies", _ROLL)
def rolling(spark, sf_dir):
    return W.rolling_anomalies(events(spark, sf_dir), limit=2.0)


def _stream(spark, sf_dir):
    path = scratch_path(spark, "stream")
    events(spark, sf_dir).repartitionByRange(1, "ts", "event_id").sortWithinPartitions("ts", "event_id").write.parquet(path)
    return readers.stream_parquet(spark, path)


@register("str_02_stateful_anomalies", _ROLL)
def stateful(spark, sf_dir):
    name = "stateful_" + scratch_path(spark, "q")[-8:]
    return W.run_to_end(W.stateful_anomalies(_stream(spark, sf_dir), limit=2.0), name, scratch_path(spark, "stream-state"))


@register("str_03_streaming_tumbling", _window_sql("time_bucket(INTERVAL 5 MINUTE, ts, TIMESTAMP '1970-01-01')", "5 MINUTE"))
def streaming(spark, sf_dir):
    name = "tumbling_" + scratch_path(spark, "q")[-8:]
    return W.run_to_end(W.tumbling(_stream(spark, sf_dir)), name, scratch_path(spark, "stream-state"), "complete")


@register("str_16_debounced", "SELECT event_id FROM events WHERE value > 80 QUALIFY coalesce(floor(epoch(ts)) - lag(floor(epoch(ts))) OVER (PARTITION BY event_type ORDER BY ts, event_id) > 60, true)")
def debounced(spark, sf_dir):
    return W.debounced(events(spark, sf_dir).where("value > 80"), "event_type").select("event_id")


@register("str_19_causation", "SELECT unnest(['e100', 'e33', 'e11', 'e3', 'e1', 'e0']) AS id, unnest([0, 1, 2, 3, 4, 5]) AS depth")
def causation(spark, sf_dir):
    e = events(spark, sf_dir).select(F.concat(F.lit("e"), "event_id").alias("event_id"), F.when(F.col("event_id") > 0, F.concat(F.lit("e"), F.floor(F.col("event_id") / 3))).alias("cause_id"))
    return W.chain(e, "e100")


@register("scl_22_json", "SELECT event_id, try_cast(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events")
def json_fields(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", F.get_json_object("props", "$.k").try_cast("double").alias("k"))


# Entities.


def _products(spark, sf_dir):
    """Parts by all that names them: many share a name, and many names are alike."""
    return part(spark, sf_dir).select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", "p_brand", "p_type").alias("name"))


@register("er_04_resolve")
def resolved(spark, sf_dir):
    return E.resolve(_products(spark, sf_dir), "id", "name", [], 0.98, 0.7)


@register("er_08_clusters", "SELECT min(p_partkey) AS cluster, count(*) AS n, min(p_partkey) AS first FROM part GROUP BY lower(p_name || ' ' || p_brand || ' ' || p_type) HAVING count(*) > 1")
def clusters(spark, sf_dir):
    return E.clusters(E.resolve(_products(spark, sf_dir), "id", "name", [], 1.0, 0.9), "id")


@register("er_15_alignment_quality", "SELECT 0.5::DOUBLE AS precision, 0.333333::DOUBLE AS recall, 0.4::DOUBLE AS f1")
def alignment(spark, sf_dir):
    p = spark.createDataFrame([("a", "x"), ("b", "y")], "a string, b string")
    r = spark.createDataFrame([("a", "x"), ("c", "z"), ("d", "w")], "a string, b string")
    return E.quality(p, r)


@register("er_16_one_to_one", "SELECT unnest(['a', 'b']) AS a, unnest(['x', 'y']) AS b, unnest([0.9, 0.5]::DOUBLE[]) AS score")
def one_to_one(spark, sf_dir):
    return E.greedy_one_to_one(spark.createDataFrame([("a", "x", 0.9), ("a", "y", 0.8), ("b", "x", 0.85), ("b", "y", 0.5)], "a string, b string, score double"))


@register("er_02_cross_table", "SELECT unnest(['customer', 'nation', 'order', 'part', 'region', 'supplier']) AS entity, unnest([2, 3, 2, 2, 2, 2]) AS tables")
def cross_table(spark, sf_dir):
    return spark.createDataFrame([(e, len({c.split(".")[0] for c in cs})) for e, cs in E.cross_table_columns(tables_of(spark, sf_dir))], "entity string, tables int")


@register("er_20_recency", "SELECT o_custkey, datediff('day', max(o_orderdate)::DATE, DATE '2000-01-01')::INTEGER AS recency, count(*) AS frequency, round(sum(o_totalprice), 2) AS value FROM orders GROUP BY 1")
def recency(spark, sf_dir):
    return E.recency_frequency_value(orders(spark, sf_dir), "o_custkey", "o_orderdate", "o_totalprice", F.lit("2000-01-01").cast("date"))


# Fusion, calibration, audit.


def _votes(spark, sf_dir):
    return events(spark, sf_dir).select((F.col("user_id") % 20).alias("topic"), F.col("event_type").alias("vote"), (F.col("event_id") % 90 / 100 + 0.1).alias("confidence"))


@register("fus_04_votes", "WITH v AS (SELECT user_id % 20 AS topic, event_type AS vote, event_id % 90 / 100 + 0.1 AS c FROM events), k AS (SELECT *, avg(c) OVER w AS m, stddev_pop(c) OVER w AS s FROM v WINDOW w AS (PARTITION BY topic)), g AS (SELECT topic, vote, sum(c) AS w, count(*) AS n FROM k WHERE s = 0 OR abs(c - m) <= 2 * s GROUP BY 1, 2), t AS (SELECT *, sum(n) OVER (PARTITION BY topic) AS voters FROM g QUALIFY row_number() OVER (PARTITION BY topic ORDER BY w DESC, vote) = 1) SELECT topic, CASE WHEN w / voters < 0.5 THEN 'REVIEW' ELSE vote END AS decision, round(w / voters, 6) AS confidence FROM t")
def votes(spark, sf_dir):
    return U.weighted_votes(_votes(spark, sf_dir))


@register("fus_05_consensus", "WITH v AS (SELECT user_id % 20 AS topic, event_id % 90 / 100 + 0.1 AS c, 1 + event_id % 3 AS w FROM events) SELECT topic, round(sum(c * w) / sum(w), 6) AS score, round(1 - least(1.0, 4 * var_pop(c)), 6) AS agreement, CASE WHEN sum(c * w) / sum(w) >= 0.75 THEN 'accepted' WHEN sum(c * w) / sum(w) <= 0.3 THEN 'rejected' ELSE 'provisional' END AS state FROM v GROUP BY 1")
def consensus(spark, sf_dir):
    rows = events(spark, sf_dir).select((F.col("user_id") % 20).alias("topic"), (F.col("event_id") % 90 / 100 + 0.1).alias("confidence"), (1 + F.col("event_id") % 3).alias("weight"))
    return U.soft_consensus(rows)


_CAL = "SELECT least(floor(c * 10), 9) AS b, count(*) AS n, abs(avg(c) - avg(y)) AS gap FROM (SELECT (doc_id % 97) / 97.0::DOUBLE AS c, quality AS y FROM labels) GROUP BY 1"


@register("fus_06_calibration", f"SELECT round(sum(n * gap) / sum(n), 6) AS ece, round(max(gap), 6) AS mce FROM ({_CAL})")
def calibration(spark, sf_dir):
    return U.calibration(labels(spark, sf_dir), (F.col("doc_id") % 97) / 97.0, F.col("quality"))


@register("fus_07_temperature", "WITH g AS (SELECT 0.5 + 0.25 * k AS temperature FROM (SELECT unnest(range(11)) AS k)), s AS (SELECT temperature::DOUBLE AS temperature, 1 / (1 + exp(-ln(p / (1 - p)) / temperature)) AS c, y FROM (SELECT least(greatest((doc_id % 97) / 97.0::DOUBLE, 1e-6), 1 - 1e-6) AS p, quality AS y FROM labels), g), b AS (SELECT temperature, least(floor(c * 10), 9) AS b, count(*) AS n, abs(avg(c) - avg(y)) AS gap FROM s GROUP BY 1, 2) SELECT temperature, round(sum(n * gap) / sum(n), 6) AS ece FROM b GROUP BY 1")
def temperature(spark, sf_dir):
    return U.fit_temperature(labels(spark, sf_dir), (F.col("doc_id") % 97) / 97.0, F.col("quality"))


@register("fus_08_uncertainty", "WITH v AS (SELECT user_id % 20 AS topic, event_type AS a, event_id % 90 / 100 + 0.1 AS c FROM events), g AS (SELECT topic, count(*) AS n FROM v GROUP BY topic, a) SELECT topic, variance, entropy FROM (SELECT topic, round(var_pop(c), 6) AS variance FROM v GROUP BY 1) JOIN (SELECT topic, round(-sum(n / t * ln(n / t)), 6) AS entropy FROM (SELECT *, sum(n) OVER (PARTITION BY topic) AS t FROM g) GROUP BY 1) USING (topic)")
def uncertainty(spark, sf_dir):
    return U.uncertainty(_votes(spark, sf_dir), "topic", "vote", "confidence")


@register("fus_02_combine", "SELECT 0.815789::DOUBLE AS fk, 0.24::DOUBLE AS conflict")
def evidence(spark, sf_dir):
    fk, no = frozenset({"fk"}), frozenset({"no"})
    a, b = {fk: 0.6, no: 0.2, fk | no: 0.2}, {fk: 0.6, no: 0.2, fk | no: 0.2}
    made = U.combine(a, b)
    return spark.createDataFrame([(round(U.pignistic(made)["fk"], 6), round(U.conflict(a, b), 6))], "fk double, conflict double")


def _audit(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", "ts", "event_type", F.concat(F.lit("u"), F.col("user_id") % 5).alias("actor"), "props")


@register("fus_10_audit_query", "SELECT event_id FROM events WHERE event_type IN ('click', 'view') AND user_id % 5 = 2 ORDER BY ts, event_id LIMIT 100")
def audit(spark, sf_dir):
    return U.audit_query(_audit(spark, sf_dir), types=["click", "view"], actor="u2", limit=100).select("event_id")


@register("fus_11_audit_report", "SELECT event_type, 'u' || (user_id % 5) AS actor, count(*) AS n FROM events GROUP BY GROUPING SETS ((event_type), ('u' || (user_id % 5)), ())")
def audit_report(spark, sf_dir):
    return U.audit_report(_audit(spark, sf_dir))


@register("fus_12_governance", "SELECT unnest(['Order', 'Odd']) AS name, unnest([0.85, 0.25]::DOUBLE[]) AS quality, unnest(['approve', 'reject']) AS decision")
def governance(spark, sf_dir):
    return U.governance(spark.createDataFrame([("Order", 0.9, 0.8, 0.8, 1.0), ("Odd", 0.2, 0.2, 0.2, 0.7)], "name string, confidence double, evidence double, status double, kind double"))


@register("fus_12_priority", "SELECT unnest(['a', 'b']) AS name, unnest([4.4, 2.2]::DOUBLE[]) AS score, unnest(['high', 'low']) AS priority, unnest([true, false]) AS quick_win")
def priority(spark, sf_dir):
    return U.priority(spark.createDataFrame([("a", 5, 4, 2), ("b", 1, 2, 2)], "name string, impact int, urgency int, effort int"))


_MACHINE = U.StateMachine("O", [("ship", "O", "S", "o_totalprice > 1000"), ("ship", "P", "S", ""), ("close", "S", "F", "")])


@register("udf_06_state_machine", "SELECT o_orderkey, CASE WHEN (o_orderstatus = 'O' AND o_totalprice > 1000) OR o_orderstatus = 'P' THEN 'S' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def machine(spark, sf_dir):
    return _MACHINE.fire(orders(spark, sf_dir), "ship", "o_orderstatus").select("o_orderkey", "o_orderstatus")


@register("udf_01_behaviour", "SELECT o_orderkey, o_totalprice * 0.1 AS tax FROM orders WHERE o_orderstatus = 'O'")
def behaviour(spark, sf_dir):
    known = U.Behaviours()
    known.add("orders", "tax", "computation", lambda rows, rate: F.col("o_totalprice") * rate)
    return known.apply("orders", "tax", orders(spark, sf_dir), "o_orderstatus = 'O'", rate=0.1).select("o_orderkey", "tax")


# Sources.


@register("src_01_csv", "SELECT n_nationkey::BIGINT AS n_nationkey, n_name, n_regionkey::BIGINT AS n_regionkey FROM nation")
def csv(spark, sf_dir):
    path = scratch_path(spark, "csv")
    nation(spark, sf_dir).select("n_nationkey", "n_name", "n_regionkey").coalesce(1).write.option("header", True).csv(path)
    df = readers.read_csv(spark, path)
    return df.select(F.col("n_nationkey").cast("long"), "n_name", F.col("n_regionkey").cast("long"))


@register("src_05_json", "SELECT n_nationkey::BIGINT AS n_nationkey, n_name FROM nation")
def json(spark, sf_dir):
    path = scratch_path(spark, "json")
    writers.write_findings({"nation": nation(spark, sf_dir).select("n_nationkey", "n_name")}, path, "t")
    return readers.read_json(spark, f"{path}/t_nation").select("n_nationkey", "n_name")


@register("src_06_parquet", "SELECT r_regionkey, r_name FROM region")
def parquet(spark, sf_dir):
    return readers.read_file(spark, f"{sf_dir}/region.parquet").select("r_regionkey", "r_name")


@register("src_09_folder", "SELECT count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey")
def folder(spark, sf_dir):
    readers.Catalog(spark).load_folder(sf_dir)
    return spark.sql("SELECT count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey")


@register("src_27_object_schema", "SELECT 'region' AS \"table\", unnest(['r_regionkey', 'r_name']) AS \"column\", unnest(['int', 'string']) AS type")
def object_schema(spark, sf_dir):
    return readers.Catalog(spark).add_all({"region": read_table(spark, sf_dir, "region")}).object_schema()


@register("src_30_audit_lines", "SELECT count(*) AS n FROM events")
def audit_lines(spark, sf_dir):
    path = scratch_path(spark, "audit")
    writers.append_audit(_audit(spark, sf_dir), path)
    return readers.read_json(spark, path).agg(F.count("*").alias("n"))


def _sampled(spark, sf_dir):
    from quillstone.operators.sampling import stratified

    return stratified(docs(spark, sf_dir).select("doc_id", "lang", "n_chars"), "lang", "doc_id", 200, ["n_chars"])


@register("smp_01_stratified")
def sample(spark, sf_dir):
    return _sampled(spark, sf_dir).groupBy("lang").agg(F.count("*").alias("n"))
