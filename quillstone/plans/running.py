"""Queries over sources and sinks, streams, versions, behaviours, processes, evidence and control."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstone.operators import fusion as U
from quillstone.operators import keys as K
from quillstone.operators import overlap as O
from quillstone.operators import process as C
from quillstone.operators import remediate as R
from quillstone.operators import triples as T
from quillstone.operators import versioning as V
from quillstone.operators.objects import OPERATORS, ObjectTypes
from quillstone.plans import sql as S
from quillstone.plans.changing import _DIFF, _KEY, _new, _old
from quillstone.plans.knowledge import _facts
from quillstone.plans.linking import FK_SQL, tables_of
from quillstone.plans.objects import STAR, star
from quillstone.plans.registry import register
from quillstone.sources import readers, writers
from quillstone.storage import read_table, scratch_path
from quillstone.streaming import windows as W


def _t(name):
    return lambda spark, sf_dir: read_table(spark, sf_dir, name)


orders, customer, events, part, labels, docs, nation, region, line = map(_t, ("orders", "customer", "events", "part", "labels", "documents", "nation", "region", "lineitem"))

# Sources and sinks.


@register("src_03_encoding", "SELECT unnest(['utf-8', 'utf-8 with mark', 'korean', 'latin']) AS text, unnest(['utf-8', 'utf-8-sig', 'cp949', 'latin-1']) AS encoding")
def encodings(spark, sf_dir):
    heads = {"utf-8": "café 한국".encode(), "utf-8 with mark": "a,b".encode("utf-8-sig"), "korean": "한국어,이름".encode("cp949"), "latin": b"caf\xe9\xff\xff,\xe9t\xe9 \xa9"}
    return spark.createDataFrame([(k, readers.detect_encoding(v)) for k, v in heads.items()], "text string, encoding string")


@register("src_08_single_file", "SELECT n_name FROM nation WHERE n_regionkey = 2")
def single_file(spark, sf_dir):
    readers.Catalog(spark).load_file(f"{sf_dir}/nation.parquet")
    return spark.sql("SELECT n_name FROM nation WHERE n_regionkey = 2")


@register("src_11_full_table", "SELECT c_custkey, c_name FROM customer")
def full_table(spark, sf_dir):
    return readers.Catalog(spark).add_all(tables_of(spark, sf_dir)).table("customer").select("c_custkey", "c_name")


@register("src_12_all_tables", " UNION ALL ".join(f"SELECT '{t}' AS \"table\", count(*) AS n FROM {t}" for t in STAR))
def all_tables(spark, sf_dir):
    found = readers.Catalog(spark).add_all(tables_of(spark, sf_dir)).non_empty()
    out = None
    for t, df in found.items():
        one = df.agg(F.lit(t).alias("table"), F.count("*").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


def _csv(spark, sf_dir, path):
    nation(spark, sf_dir).write.option("header", True).csv(path)


@register("src_13_csv_to_sql", "SELECT n_regionkey::BIGINT AS n_regionkey, count(*) AS n FROM nation GROUP BY 1")
def csv_to_sql(spark, sf_dir):
    path = scratch_path(spark, "load")
    _csv(spark, sf_dir, f"{path}/nations_loaded.csv")
    readers.Catalog(spark).load_file(f"{path}/nations_loaded.csv")
    return spark.sql("SELECT CAST(n_regionkey AS BIGINT) AS n_regionkey, count(*) AS n FROM nations_loaded GROUP BY 1")


@register("src_15_table_by_name", "SELECT n_nationkey::BIGINT AS n_nationkey, n_name FROM nation")
def table_by_name(spark, sf_dir):
    path = scratch_path(spark, "silo")
    _csv(spark, sf_dir, f"{path}/deep/below/nation.csv")
    return readers.find_table(spark, path, "nation").select(F.col("n_nationkey").cast("long"), "n_name")


@register("src_16_column_lists", "SELECT unnest(['lands', 'lands', 'lands']) AS \"table\", unnest(['n_nationkey', 'n_name', 'n_regionkey']) AS \"column\"")
def column_lists(spark, sf_dir):
    path = scratch_path(spark, "folder")
    _csv(spark, sf_dir, f"{path}/lands.csv")
    return spark.createDataFrame([(t, c) for t, c, _ in readers.Catalog(spark).load_folder(path).columns()], "table string, column string")


@register("src_17_kafka_rows", "SELECT event_type || '-' || user_id || '-' || event_id AS event_id, event_type AS source, CASE WHEN event_id % 2 = 0 THEN json_extract_string(props, '$.k') ELSE 'plain' END AS value FROM events")
def kafka_rows(spark, sf_dir):
    """What a topic holds, from a table that stands in for it: JSON objects, and values that are none."""
    value = F.when(F.col("event_id") % 2 == 0, F.col("props")).otherwise("plain").cast("binary")
    raw = events(spark, sf_dir).select(F.col("event_type").alias("topic"), F.col("user_id").alias("partition"), F.col("event_id").alias("offset"), F.col("ts").alias("timestamp"), F.lit(None).cast("binary").alias("key"), value.alias("value"))
    found = readers.kafka_events(raw)
    return found.select("event_id", "source", F.coalesce(F.try_element_at("payload", F.lit("k")), F.try_element_at("payload", F.lit("value"))).alias("value"))


def _stream(spark, sf_dir, files=3):
    path = scratch_path(spark, "stream")
    events(spark, sf_dir).repartitionByRange(files, "ts", "event_id").write.parquet(path)
    return readers.stream_parquet(spark, path)


@register("src_18_event_stream", "SELECT count(*) AS n, round(sum(value), 4) AS total FROM events")
def event_stream(spark, sf_dir):
    name = "events_" + scratch_path(spark, "q")[-8:]
    return W.run_to_end(_stream(spark, sf_dir).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")), name, scratch_path(spark, "state"), "complete")


@register("src_19_instances", "SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey = 3 ORDER BY c_custkey LIMIT 5 OFFSET 2")
def instances(spark, sf_dir):
    return readers.instances(customer(spark, sf_dir), {"c_mktsegment": "BUILDING", "c_nationkey": 3}, ["c_custkey"], 5, 2).select("c_custkey", "c_name")


@register("src_22_upsert_sink", "SELECT user_id, arg_max(value, event_id) AS value, max(event_id) AS event_id FROM events GROUP BY 1")
def upsert_sink(spark, sf_dir):
    sink = writers.UpsertSink(spark, scratch_path(spark, "upserts"), ["user_id"], ["event_id"])
    W.run_batches(_stream(spark, sf_dir).select("user_id", "value", "event_id"), sink, scratch_path(spark, "state"))
    return sink.table()


@register("src_23_findings", "SELECT 'entities' AS finding, count(*) AS n FROM nation UNION ALL SELECT 'actions', count(*) FROM region")
def findings(spark, sf_dir):
    path = scratch_path(spark, "findings")
    made = {"entities": nation(spark, sf_dir), "actions": region(spark, sf_dir)}
    writers.write_findings(made, path, "run")
    counts = [readers.read_json(spark, f"{path}/run_{n}").agg(F.lit(n).alias("finding"), F.count("*").alias("n")) for n in made]
    return counts[0].unionByName(counts[1])


@register("src_28_markdown", "SELECT unnest(['# Areas', '', '## Regions', '', '| r_regionkey | r_name |', '|-|-|']) AS line, unnest(range(6)) AS place UNION ALL SELECT '| ' || r_regionkey || ' | ' || r_name || ' |', 6 + row_number() OVER (ORDER BY r_regionkey) - 1 FROM region")
def report(spark, sf_dir):
    lines = writers.markdown("Areas", {"Regions": region(spark, sf_dir).orderBy("r_regionkey")})
    return spark.createDataFrame(list(zip(lines, range(len(lines)), strict=True)), "line string, place long")


@register("src_29_log_sink", "SELECT count(*) AS n FROM events WHERE value > 90")
def log_sink(spark, sf_dir):
    path = scratch_path(spark, "log")
    W.run_batches(_stream(spark, sf_dir).where("value > 90"), lambda batch, number: batch.write.mode("overwrite").json(f"{path}/batch-{number}"), scratch_path(spark, "state"))
    return spark.read.json(f"{path}/*").agg(F.count("*").alias("n"))


# Objects and SQL.

_ALIASES = {"$eq": ("O", "= 'O'"), "$ne": ("O", "<> 'O'"), "$gt": ("F", "> 'F'"), "$gte": ("F", ">= 'F'"), "$lt": ("O", "< 'O'"), "$lte": ("O", "<= 'O'"), "$in": (["O", "F"], "IN ('O', 'F')"), "$nin": (["O"], "NOT IN ('O')"), "$like": ("%O%", "LIKE '%O%'"), "$ilike": ("o", "ILIKE 'o'"), "$null": (True, "IS NULL"), "$notnull": (None, "IS NOT NULL"), "$between": (("F", "O"), "BETWEEN 'F' AND 'O'")}


@register("qb_04_aliases", " UNION ALL ".join(f"SELECT '{a}' AS alias, count(*) FILTER (o_orderstatus {s}) AS n FROM orders" for a, (_, s) in _ALIASES.items()))
def aliases(spark, sf_dir):
    cells = [F.struct(F.lit(a).alias("alias"), F.count_if(OPERATORS[a](F.col("o_orderstatus"), v)).alias("n")) for a, (v, _) in _ALIASES.items()]
    return orders(spark, sf_dir).agg(F.array(*cells).alias("x")).select(F.explode("x").alias("p")).select("p.*")


@register("qb_20_execute", "SELECT * FROM customer WHERE c_nationkey = 4")
def execute(spark, sf_dir):
    return star(spark, sf_dir).query("customer").where("c_nationkey", "$eq", 4).execute()


@register("sql_05_statistics", "SELECT 3 AS total, 2 AS succeeded")
def statistics(spark, sf_dir):
    runner = S.SqlRunner(spark)
    for text in ("SELECT 1", "SELECT 2", "SELECT FROM nowhere at all"):
        try:
            runner.execute(text)
        except Exception as why:
            if "nowhere" not in text:
                raise why
    found = runner.statistics()
    return spark.createDataFrame([(found["total"], found["succeeded"])], "total int, succeeded int")


_COLUMNS = {"orders": ["o_orderkey", "o_totalprice", "o_orderstatus"], "customer": ["c_custkey", "c_mktsegment"]}


@register("sql_06_orchestration", "SELECT c_mktsegment, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def orchestration(spark, sf_dir):
    """A question, its intent, the join path, the plan, and rows; a model may write the SQL instead."""
    tables_of(spark, sf_dir)["orders"].createOrReplaceTempView("orders")
    tables_of(spark, sf_dir)["customer"].createOrReplaceTempView("customer")

    def model(question, intent):
        assert intent["aggregate"] == "count" and intent["tables"] == ["orders", "customer"]
        return "SELECT c_mktsegment, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment"

    from quillstone.plans.objects import KEYS

    return S.answer(spark, "how many orders by customer mktsegment", {t: tables_of(spark, sf_dir)[t] for t in _COLUMNS}, KEYS, model)


@register("sql_07_intent", "SELECT 'top 3 orders by average totalprice' AS question, 'avg' AS aggregate, 3 AS \"limit\", 'orders' AS tables UNION ALL SELECT 'how many orders has each customer', 'count', NULL, 'orders,customer'")
def intents(spark, sf_dir):
    asked = ("top 3 orders by average totalprice", "how many orders has each customer")
    found = [(q, S.intent(q, _COLUMNS)) for q in asked]
    return spark.createDataFrame([(q, i["aggregate"], i["limit"], ",".join(i["tables"])) for q, i in found], "question string, aggregate string, limit int, tables string")


# Joins over facts and versions.


@register("join_11_triple_join", "SELECT 'o:' || o_orderkey AS subject, 'n:' || c_nationkey AS object FROM orders JOIN customer ON o_custkey = c_custkey")
def triple_join(spark, sf_dir):
    o = orders(spark, sf_dir).select(F.concat(F.lit("o:"), "o_orderkey").alias("subject"), F.lit("by").alias("predicate"), F.concat(F.lit("c:"), "o_custkey").alias("object"))
    c = customer(spark, sf_dir).select(F.concat(F.lit("c:"), "c_custkey"), F.lit("in"), F.concat(F.lit("n:"), "c_nationkey"))
    rule = T.Rule("from", (("?o", "by", "?c"), ("?c", "in", "?n")), ("?o", "from", "?n"))
    return rule.apply(T.with_confidence(o.union(c))).select("subject", "object")


@register("join_12_chain", "SELECT 'c:' || c_custkey AS subject, 'r:' || n_regionkey AS object, 0.9::DOUBLE AS confidence FROM customer JOIN nation ON c_nationkey = n_nationkey")
def chain(spark, sf_dir):
    c = customer(spark, sf_dir).select(F.concat(F.lit("c:"), "c_custkey").alias("subject"), F.lit("in").alias("predicate"), F.concat(F.lit("n:"), "c_nationkey").alias("object"))
    n = nation(spark, sf_dir).select(F.concat(F.lit("n:"), "n_nationkey"), F.lit("of"), F.concat(F.lit("r:"), "n_regionkey"))
    return T.chain(["in", "of"], "region").apply(T.with_confidence(c.union(n))).select("subject", "object", "confidence")


@register("join_13_three_way", "SELECT c_custkey, CASE WHEN c_custkey % 6 = 0 THEN c_acctbal + 2 WHEN c_custkey % 2 = 0 THEN c_acctbal + 1 WHEN c_custkey % 3 = 0 THEN c_acctbal + 2 ELSE c_acctbal END AS c_acctbal, CASE WHEN c_custkey % 6 = 0 THEN 'c_acctbal' ELSE '' END AS conflicts FROM customer")
def three_way(spark, sf_dir):
    base = customer(spark, sf_dir).select("c_custkey", "c_acctbal")
    side = lambda k, more: base.withColumn("c_acctbal", F.when(F.col("c_custkey") % k == 0, F.col("c_acctbal") + more).otherwise(F.col("c_acctbal")))
    return V.merge3(base, side(2, 1), side(3, 2), ["c_custkey"])


@register("join_14_two_way", f"SELECT change, count(*) AS n FROM ({_DIFF}) GROUP BY 1")
def two_way(spark, sf_dir):
    return V.diff(_old(spark, sf_dir), _new(spark, sf_dir), _KEY).groupBy("change").agg(F.count("*").alias("n"))


@register("kb_03_backward", "SELECT 'n:' || n_nationkey AS subject FROM nation UNION ALL SELECT 'r:' || r_regionkey FROM region")
def backward(spark, sf_dir):
    rule = T.Rule("transitive", (("?x", "partOf", "?y"), ("?y", "partOf", "?z")), ("?x", "partOf", "?z"))
    other = T.Rule("unused", (("?x", "near", "?y"),), ("?y", "near", "?x"))
    return T.prove(_facts(spark, sf_dir), [rule, other], ("?x", "partOf", "world")).select("subject")


@register("kb_06_owl_loop", "SELECT 'inverse' AS rule, (SELECT count(*) FROM nation) * 2 + (SELECT count(*) FROM region) AS n UNION ALL SELECT 'transitive', count(*) FROM nation UNION ALL SELECT 'symmetric', 1")
def owl_loop(spark, sf_dir):
    found = T.infer(_facts(spark, sf_dir), T.OWL).where("rule is not null and predicate in ('partOf', 'hasPart', 'near')")
    return found.groupBy("rule").agg(F.count("*").alias("n"))


@register("kb_16_rule_set", "SELECT 'located' AS rule, count(*) AS n FROM customer UNION ALL SELECT 'serves', count(DISTINCT (l_suppkey, l_orderkey)) FROM lineitem")
def rule_set(spark, sf_dir):
    text = lambda prefix, c: F.concat(F.lit(prefix), c)
    c = customer(spark, sf_dir).select(text("c:", "c_custkey").alias("subject"), F.lit("locatedIn").alias("predicate"), text("n:", "c_nationkey").alias("object"))
    n = nation(spark, sf_dir).select(text("n:", "n_nationkey"), F.lit("partOf"), text("r:", "n_regionkey"))
    l = line(spark, sf_dir)
    own = l.select(text("s:", "l_suppkey"), F.lit("supplies"), text("i:", F.concat_ws(".", "l_orderkey", "l_partkey", "l_suppkey")))
    held = l.select(text("o:", "l_orderkey"), F.lit("contains"), text("i:", F.concat_ws(".", "l_orderkey", "l_partkey", "l_suppkey")))
    found = T.infer(c.union(n).union(own).union(held), T.DOMAIN_RULES).where("rule is not null")
    return found.groupBy("rule").agg(F.count("*").alias("n"))


@register("kb_21_transitions", "SELECT source, target, count(*) AS n, round(avg(s), 3) AS seconds FROM (SELECT event_type AS source, lead(event_type) OVER w AS target, epoch(lead(ts) OVER w) - epoch(ts) AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE target IS NOT NULL GROUP BY 1, 2")
def transitions(spark, sf_dir):
    return C.transitions(events(spark, sf_dir), "user_id", "event_type", ["ts", "event_id"])


@register("kb_21_late_cases", "SELECT user_id, count(*) AS steps, round(epoch(max(ts)) - epoch(min(ts)), 3) AS seconds FROM events GROUP BY 1 HAVING epoch(max(ts)) - epoch(min(ts)) > 1000000")
def late_cases(spark, sf_dir):
    return C.late_cases(events(spark, sf_dir), "user_id", "ts", 1_000_000)


@register("kb_21_processes", "SELECT 'order to cash' AS process, 2 AS words UNION ALL SELECT 'procure to pay', 2")
def processes(spark, sf_dir):
    return spark.createDataFrame(C.processes(list(STAR)), "process string, words int")


# Versions.


def _repository(spark, sf_dir):
    r = V.Repository(spark, scratch_path(spark, "versions"))
    r.commit("one", {"region": region(spark, sf_dir)})
    r.create_branch("work")
    r.commit("two", {"region": region(spark, sf_dir).where("r_regionkey > 0")})
    r.switch("work")
    for message in ("a", "b"):
        r.commit(message, {"region": region(spark, sf_dir)})
    return r


@register("ver_05_branches", "SELECT unnest(['main', 'work']) AS branch, unnest([false, true]) AS current")
def branches(spark, sf_dir):
    r = _repository(spark, sf_dir)
    r.create_branch("gone")
    r.delete_branch("gone")
    return spark.createDataFrame([(b, c) for b, _, c in r.branches()], "branch string, current boolean")


@register("ver_06_compare", "SELECT 'one' AS common, 2 AS ahead, 1 AS behind")
def compare(spark, sf_dir):
    r = _repository(spark, sf_dir)
    found = r.compare("work", "main")
    return spark.createDataFrame([(r.versions[found["common"]]["message"], found["ahead"], found["behind"])], "common string, ahead int, behind int")


def _writeback(spark, sf_dir):
    w = C.Writeback({"customer": customer(spark, sf_dir).select("c_custkey", "c_acctbal")})
    raise_ = lambda df: df.withColumn("c_acctbal", F.col("c_acctbal") + 100)
    drop = lambda df: df.where("c_custkey % 2 = 0")
    return w, [("raise", "customer", raise_), ("broken", "customer", lambda df: df.select("nothing")), ("drop", "customer", drop)]


@register("ver_14_writeback", "SELECT count(*) AS n, round(sum(c_acctbal + 100), 2) AS total, 'raise:done,broken:failed: AnalysisException,drop:rolled back' AS log FROM customer")
def writeback(spark, sf_dir):
    w, actions = _writeback(spark, sf_dir)
    w.batch(actions)
    w.rollback()
    log = ",".join(f"{n}:{s}" for n, _, s in w.log)
    return w.tables["customer"].agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("total"), F.lit(log).alias("log"))


@register("udf_09_actions", "SELECT count(*) AS n, 'raise:done,drop:rejected' AS log FROM customer")
def actions(spark, sf_dir):
    w, known = _writeback(spark, sf_dir)
    w.batch([known[0], known[2]], stop_on_error=True, approve=lambda name, table: name != "drop")
    return w.tables["customer"].agg(F.count("*").alias("n"), F.lit(",".join(f"{n}:{s}" for n, _, s in w.log)).alias("log"))


@register("rem_14_apply_rollback", "SELECT unnest([count(*), count(*) FILTER (p_size <= 40), count(*)]) AS n, unnest(['start', 'applied', 'rolled back']) AS state FROM part")
def apply_rollback(spark, sf_dir):
    r = R.Remediation(part(spark, sf_dir))
    counts = [("start", r.table.count())]
    r.approve("large")
    r.apply("large", lambda df: df.where("p_size <= 40"))
    counts.append((r.state["large"], r.table.count()))
    r.rollback("large")
    counts.append((r.state["large"], r.table.count()))
    return spark.createDataFrame([(n, s) for s, n in counts], "n long, state string")


@register("rem_04_strategies", "SELECT unnest(['missing', 'missing', 'outlier', 'duplicate']) AS issue, unnest([0.1, 0.5, 0.2, 0.2]::DOUBLE[]) AS rate, unnest(['fill_mean', 'fill_default', 'clip', 'deduplicate']) AS strategy")
def strategies(spark, sf_dir):
    issues = [("missing", 0.1), ("missing", 0.5), ("outlier", 0.2), ("duplicate", 0.2)]
    return spark.createDataFrame([(k, r, R.strategy(r, k)) for k, r in issues], "issue string, rate double, strategy string")


@register("ver_16_subscribe", "SELECT count(*) AS n FROM events WHERE event_type IN ('error', 'signup') AND event_id % 3 = 0 AND value > 10")
def subscribe(spark, sf_dir):
    stream = _stream(spark, sf_dir).select("event_id", "value", F.col("event_type").alias("table_name"), F.when(F.col("event_id") % 3 == 0, "INSERT").otherwise("UPDATE").alias("change"))
    path = scratch_path(spark, "changes")
    query = V.subscribe(stream, lambda batch, number: batch.write.mode("overwrite").parquet(f"{path}/batch-{number}"), scratch_path(spark, "state"), ["error", "signup"], ["INSERT"], F.col("value") > 10)
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return spark.read.parquet(f"{path}/*").agg(F.count("*").alias("n"))


# Streams.

_RULES = {"large": "value > 80", "failed": "event_type = 'error'"}


@register("str_01_engine", "SELECT 'window' AS concern, count(*) AS n FROM (SELECT DISTINCT time_bucket(INTERVAL 5 MINUTE, ts, TIMESTAMP '1970-01-01'), event_type FROM events) UNION ALL SELECT 'rule', count(*) FILTER (value > 80) + count(*) FILTER (event_type = 'error') FROM events UNION ALL SELECT 'kpi', count(*) FROM events WHERE event_type = 'click' AND value < 20")
def engine(spark, sf_dir):
    kpis = spark.createDataFrame([("click", 20.0, True)], "kpi string, limit double, higher_is_better boolean")
    found = W.engine(events(spark, sf_dir), {n: F.expr(e) for n, e in _RULES.items()}, kpis)
    out = None
    for name in ("window", "rule", "kpi"):
        one = found[name].agg(F.lit(name).alias("concern"), F.count("*").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


@register("str_07_expired", "SELECT time_bucket(INTERVAL 5 MINUTE, ts, TIMESTAMP '1970-01-01') AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2 HAVING time_bucket(INTERVAL 5 MINUTE, ts, TIMESTAMP '1970-01-01') + INTERVAL 5 MINUTE <= TIMESTAMP '2024-01-02'")
def expired(spark, sf_dir):
    return W.expired(W.tumbling(events(spark, sf_dir)), F.lit("2024-01-02").cast("timestamp")).select("start", "event_type", "n")


@register("str_10_domain_rules", "SELECT event_id, 'large' AS trigger FROM events WHERE value > 80 UNION ALL SELECT event_id, 'failed' FROM events WHERE event_type = 'error'")
def domain_rules(spark, sf_dir):
    return W.fired(events(spark, sf_dir), {n: F.coalesce(F.expr(e), F.lit(False)) for n, e in _RULES.items()})


@register("str_13_iqr_trigger", "SELECT event_id, user_id, value FROM events WHERE value IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) QUALIFY count(value) OVER w >= 10 AND (value < quantile_cont(value, 0.25) OVER w - 1.5 * (quantile_cont(value, 0.75) OVER w - quantile_cont(value, 0.25) OVER w) OR value > quantile_cont(value, 0.75) OVER w + 1.5 * (quantile_cont(value, 0.75) OVER w - quantile_cont(value, 0.25) OVER w))")
def iqr_trigger(spark, sf_dir):
    return W.rolling_iqr(events(spark, sf_dir))


@register("str_15_custom_trigger", "SELECT event_id, 'odd' AS trigger FROM events WHERE try_cast(json_extract_string(props, '$.k') AS INTEGER) % 2 = 1")
def custom_trigger(spark, sf_dir):
    odd = lambda props: F.get_json_object(props, "$.k").try_cast("int") % 2 == 1  # noqa: E731  a trigger of one's own is a function to a Column
    return W.fired(events(spark, sf_dir), {"odd": F.coalesce(odd(F.col("props")), F.lit(False))})


@register("str_17_batches", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def batches(spark, sf_dir):
    path = scratch_path(spark, "batches")
    W.run_batches(_stream(spark, sf_dir), lambda batch, number: batch.groupBy("event_type").agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{path}/batch-{number}"), scratch_path(spark, "state"))
    return spark.read.parquet(f"{path}/*").groupBy("event_type").agg(F.sum("n").alias("n"))


@register("str_18_event_bus", "SELECT event_id, s AS subscriber, row_number() OVER (PARTITION BY event_id ORDER BY p DESC, s)::INTEGER AS place FROM (SELECT event_id, unnest(list_filter([CASE WHEN event_type = 'error' THEN {'s': 'alarm', 'p': 9} END, {'s': 'audit', 'p': 1}, CASE WHEN value > 50 THEN {'s': 'large', 'p': 1} END], lambda x: x IS NOT NULL), recursive := true) FROM events)")
def event_bus(spark, sf_dir):
    bus = W.EventBus().subscribe("audit", "*", 1).subscribe("alarm", "error", 9).subscribe("large", "*", 1, F.col("value") > 50)
    return bus.dispatch(events(spark, sf_dir))


# Behaviours and evidence.


@register("udf_02_kinds", "SELECT unnest(['computation', 'mutation', 'query', 'validation']) AS kind, unnest([count(*), count(*), 3, count(*) FILTER (o_totalprice > 100000)]) AS n FROM orders")
def kinds(spark, sf_dir):
    known = U.Behaviours()
    known.add("orders", "tax", "computation", lambda rows: F.col("o_totalprice") * 0.1)
    known.add("orders", "close", "mutation", lambda rows: rows.withColumn("o_orderstatus", F.lit("F")))
    known.add("orders", "states", "query", lambda rows: rows.groupBy("o_orderstatus").agg(F.count("*").alias("n")))
    known.add("orders", "large", "validation", lambda rows: F.col("o_totalprice") > 100000)
    out = None
    for (_, name), (kind, _) in known.known.items():
        one = known.apply("orders", name, orders(spark, sf_dir)).agg(F.lit(kind).alias("kind"), F.count("*").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


@register("udf_03_sql_behaviour", "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_totalprice > 200000 GROUP BY 1")
def sql_behaviour(spark, sf_dir):
    known = U.Behaviours()
    known.add("orders", "by_state", "query", lambda rows, least: spark.sql("SELECT o_orderstatus, count(*) AS n FROM {rows} WHERE o_totalprice > :least GROUP BY 1", args={"least": least}, rows=rows))
    return known.apply("orders", "by_state", orders(spark, sf_dir), least=200000)


@register("udf_08_tool_layers", "SELECT unnest(['load', 'profile', 'keys', 'report']) AS tool, unnest([0, 1, 1, 2]) AS layer")
def tool_layers(spark, sf_dir):
    found = C.layers({"report": ["profile", "keys"], "profile": ["load"], "keys": ["load"], "load": []})
    return spark.createDataFrame([(t, k) for k, ts in enumerate(found) for t in ts], "tool string, layer int")


@register("udf_10_row_handlers", "SELECT event_id FROM events WHERE value > 50 AND event_type LIKE 'p%'")
def row_handlers(spark, sf_dir):
    tests = [lambda df: df.where("value > 50"), lambda df: df.where(F.col("event_type").startswith("p"))]
    df = events(spark, sf_dir)
    for t in tests:
        df = t(df)
    return df.select("event_id")


@register("fus_01_masses", "SELECT 'fk' AS hypothesis, 0.5::DOUBLE AS belief, 0.8::DOUBLE AS plausibility, 0.65::DOUBLE AS pignistic UNION ALL SELECT 'no', 0.2, 0.5, 0.35")
def masses(spark, sf_dir):
    fk, no = frozenset({"fk"}), frozenset({"no"})
    m = {fk: 0.5, no: 0.2, fk | no: 0.3}
    return spark.createDataFrame([(h, round(U.belief(m, frozenset({h})), 6), round(U.plausibility(m, frozenset({h})), 6), round(U.pignistic(m)[h], 6)) for h in ("fk", "no")], "hypothesis string, belief double, plausibility double, pignistic double")


@register("fus_03_conflict", "SELECT 0.38::DOUBLE AS conflict, true AS accepted")
def conflict(spark, sf_dir):
    fk, no = frozenset({"fk"}), frozenset({"no"})
    a, b = {fk: 0.8, no: 0.1, fk | no: 0.1}, {fk: 0.6, no: 0.4, fk | no: 0.0}
    return spark.createDataFrame([(round(U.conflict(a, b), 6), U.pignistic(U.combine(a, b))["fk"] >= 0.5)], "conflict double, accepted boolean")


@register("fus_09_evidence_chain", "SELECT unnest(['whole', 'changed', 'changed']) AS chain, unnest([NULL, 1, 2]) AS place")
def evidence_chain(spark, sf_dir):
    chain = V.EvidenceChain()
    for k, finding in enumerate(("columns read", "keys found", "rules made")):
        chain.add(f"phase {k}", "engine", finding)
    whole = chain.table(spark)
    forged = whole.withColumn("finding", F.when(F.col("place") == 1, "no keys").otherwise(F.col("finding")))
    made = F.sha2(F.concat_ws("|", F.col("place").cast("string"), "phase", "agent", "finding", "previous"), 256)
    relinked = whole.withColumn("previous", F.when(F.col("place") == 2, "x").otherwise(F.col("previous"))).withColumn("digest", F.when(F.col("place") == 2, made).otherwise(F.col("digest")))
    none = V.evidence_breaks(whole).agg(F.lit("whole").alias("chain"), F.max("place").cast("int").alias("place"))
    return none.union(V.evidence_breaks(forged).union(V.evidence_breaks(relinked)).select(F.lit("changed"), F.col("place").cast("int")))


@register("fus_13_attribution", "SELECT user_id % 20 AS decision, event_type AS source, round(sum(value) / sum(sum(value)) OVER (PARTITION BY user_id % 20), 6) AS share FROM events GROUP BY 1, 2")
def attribution(spark, sf_dir):
    return C.attribution(events(spark, sf_dir).select((F.col("user_id") % 20).alias("decision"), F.col("event_type").alias("source"), F.col("value").alias("weight")))


@register("fus_14_patterns", "SELECT segment, event_type, n, round(rate, 6) AS rate FROM (SELECT user_id % 7 AS segment, event_type, count(*) AS n, avg((value > 30)::INT) AS rate FROM events GROUP BY 1, 2 HAVING count(*) >= 5) QUALIFY row_number() OVER (PARTITION BY segment ORDER BY rate DESC, n DESC, event_type) = 1")
def patterns(spark, sf_dir):
    return C.patterns(events(spark, sf_dir).withColumn("segment", F.col("user_id") % 7), "segment", "event_type", F.col("value") > 30)


# Control.


@register("ctl_02_stages", "SELECT count(*) AS n, 'before one,after one,before two,after two' AS hooks FROM orders WHERE o_totalprice > 100000 AND o_orderstatus = 'F'")
def stages(spark, sf_dir):
    seen = []
    run = C.Stages([("one", lambda df: df.where("o_totalprice > 100000")), ("two", lambda df: df.where("o_orderstatus = 'F'"))], [lambda n, df: seen.append(f"before {n}")], [lambda n, df: seen.append(f"after {n}")])
    df = run.run(orders(spark, sf_dir))
    return df.agg(F.count("*").alias("n"), F.lit(",".join(seen)).alias("hooks"))


@register("src_14_context", "SELECT 'nation' AS \"table\", true AS loaded, count(*) AS n FROM nation UNION ALL SELECT 'places', true, count(*) FROM region UNION ALL SELECT 'lost', false, 0")
def context(spark, sf_dir):
    catalog = readers.Catalog(spark)
    done = catalog.load_each({"nation": f"{sf_dir}/nation.parquet", "lost": f"{sf_dir}/lost.parquet", "places": region(spark, sf_dir)})
    rows = [spark.sql(f"SELECT '{t}' AS `table`, true AS loaded, count(*) AS n FROM {t}" if why is None else f"SELECT '{t}' AS `table`, false AS loaded, 0L AS n") for t, why in done]
    return rows[0].union(rows[1]).union(rows[2])


def _discovery(spark, sf_dir):
    """What the platform finds out of tables: their columns, keys, and rows whose keys lead nowhere."""
    tables = tables_of(spark, sf_dir)
    columns = spark.createDataFrame([(t, c, k) for t, df in tables.items() for c, k in df.dtypes], "table string, column string, kind string")
    return {
        "report": C.Task(lambda keys, kept: keys.select("from_table").union(kept.select(F.lit("orders"))), ("keys", "orphans")),
        "columns": C.Task(lambda: columns),
        "keys": C.Task(lambda columns: K.foreign_keys({r.table: tables[r.table] for r in columns.select("table").distinct().collect()}), ("columns",), 1),
        "orphans": C.Task(lambda keys: O.orphans(tables["orders"], "o_custkey", tables["customer"], "c_custkey"), ("keys",)),
    }


_ORPHANS = "(SELECT count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer))"


@register("ctl_01_platform", f"SELECT 'columns' AS finding, (SELECT count(*) FROM information_schema.columns WHERE table_name IN {STAR}) AS n UNION ALL SELECT 'keys', (SELECT count(*) FROM ({FK_SQL})) UNION ALL SELECT 'orphans', {_ORPHANS} UNION ALL SELECT 'report', (SELECT count(*) FROM ({FK_SQL})) + {_ORPHANS}")
def platform(spark, sf_dir):
    found, _ = C.run_tasks(_discovery(spark, sf_dir))
    return C.report(found)


@register("ctl_03_orchestrated", "SELECT unnest(['load', 'count', 'broken', 'after', 'shaky']) AS task, unnest([0, 1, 1, 2, 0]) AS layer, unnest([1, 1, 2, 0, 2]) AS attempts, unnest(['done', 'done', 'failed', 'skipped', 'done']) AS state")
def orchestrated(spark, sf_dir):
    """One task fails for good, one at first only; what needs the former is skipped."""
    tried = []

    def shaky():
        tried.append(1)
        if len(tried) == 1:
            raise OSError("not yet")
        return nation(spark, sf_dir)

    tasks = {
        "load": C.Task(lambda: orders(spark, sf_dir)),
        "count": C.Task(lambda df: df.groupBy("o_orderstatus").count(), ("load",)),
        "broken": C.Task(lambda df: df.select("nothing"), ("load",), 1),
        "after": C.Task(lambda df: df, ("broken",)),
        "shaky": C.Task(shaky, (), 1),
    }
    _, log = C.run_tasks(tasks)
    return spark.createDataFrame([(t, k, n, s.split(":")[0]) for t, k, n, s in log], "task string, layer int, attempts int, state string")


_NEEDS = {"load": [], "profile": ["load"], "keys": ["load"], "repair": ["profile"], "report": ["keys", "repair"]}


@register("ctl_04_tasks", "SELECT unnest(['load', 'keys', 'profile', 'repair', 'report']) AS task, unnest([0, 1, 1, 2, 3]) AS layer")
def tasks(spark, sf_dir):
    return spark.createDataFrame([(t, k) for k, ts in enumerate(C.layers(_NEEDS)) for t in ts], "task string, layer int")


@register("ctl_11_schedule", "SELECT unnest(['load', 'keys', 'profile', 'repair', 'report']) AS task, unnest([0, 1, 2, 3, 4]) AS place")
def schedule(spark, sf_dir):
    found = C.schedule(_NEEDS, {"keys": 5, "report": 9})
    return spark.createDataFrame([(t, k) for k, t in enumerate(found)], "task string, place int")


@register("ctl_12_gates", "SELECT 'discovery' AS phase, 'tables' AS finding, 7::BIGINT AS n, true AS passed UNION ALL SELECT 'discovery', 'orphans', (SELECT count(*) FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part)), (SELECT count(*) FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part)) >= 1 UNION ALL SELECT 'governance', 'decisions', 0, false")
def gates(spark, sf_dir):
    tables = spark.createDataFrame([(t,) for t in STAR], "name string")
    orphans = line(spark, sf_dir).join(part(spark, sf_dir), F.col("l_partkey") == F.col("p_partkey"), "left_anti").select("l_partkey")
    return C.gates({"tables": tables, "orphans": orphans}, {"discovery": {"tables": 3, "orphans": 1}, "governance": {"decisions": 1}})


@register("src_21_routing", "SELECT 'customer' AS kind, count(*) AS n FROM customer UNION ALL SELECT 'nation', count(*) FROM nation")
def routing(spark, sf_dir):
    """Each object type from its own source, others from the default one."""
    own, default = {"customer": customer}, lambda spark, sf_dir, name: read_table(spark, sf_dir, name)
    types = ObjectTypes(spark)
    for name, key in (("customer", "c_custkey"), ("nation", "n_nationkey")):
        types.add_type(name, own[name](spark, sf_dir) if name in own else default(spark, sf_dir, name), key)
    counts = [types.query(n).count().select(F.lit(n).alias("kind"), "n") for n in ("customer", "nation")]
    return counts[0].unionByName(counts[1])
