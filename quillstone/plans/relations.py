"""Queries over relations between tables, and the operators that other areas leave."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstone.functions import naming
from quillstone.functions import scalars as X
from quillstone.operators import entities as E
from quillstone.operators import fusion as U
from quillstone.operators import insight as I
from quillstone.operators import keys as K
from quillstone.operators import overlap as O
from quillstone.operators import profile as P
from quillstone.operators import quality as Q
from quillstone.operators import relations as R
from quillstone.operators import sketch
from quillstone.operators import stats as S
from quillstone.operators import triples as T
from quillstone.operators import versioning as V
from quillstone.operators.objects import ObjectTypes
from quillstone.plans.linking import FK_SQL, LABEL_SQL, tables_of
from quillstone.plans.registry import register
from quillstone.sources import readers
from quillstone.storage import read_table, scratch_path


def _t(name):
    return lambda spark, sf_dir: read_table(spark, sf_dir, name)


line, orders, customer, part, nation, region, docs, labels, events, supplier = map(_t, ("lineitem", "orders", "customer", "part", "nation", "region", "documents", "labels", "events", "supplier"))


@register("agg_14_status_columns", "SELECT unnest(['o_orderstatus', 'o_orderpriority']) AS \"column\"")
def status_columns(spark, sf_dir):
    return spark.createDataFrame([(c,) for c in P.categorical_columns(orders(spark, sf_dir), 20)], "column string")


@register("agg_16_boolean_columns", "SELECT unnest(['quality', 'toxic']) AS \"column\"")
def boolean_columns(spark, sf_dir):
    df = labels(spark, sf_dir)
    row = df.agg(*(F.bool_and(F.lower(F.col(c).cast("string")).isin(*I.TRUE_WORDS, *I.FALSE_WORDS)).alias(c) for c in df.columns))
    return row.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("b")) for c in df.columns))).alias("x")).where("x.b").select("x.column")


@register("agg_24_segment_driver", "WITH g AS (SELECT o_orderstatus AS category, avg(o_totalprice) AS m FROM orders GROUP BY 1 HAVING count(*) >= 10) SELECT 'o_totalprice' AS metric, count(*) AS groups, arg_max(category, m) AS best, arg_min(category, m) AS worst, round(max(m), 4) AS hi, round(min(m), 4) AS lo, round(max(m) / min(m), 4) AS ratio, CASE WHEN max(m) / min(m) >= 2 THEN 'significant' WHEN max(m) / min(m) < 1.2 THEN 'no_effect' ELSE 'moderate' END AS effect FROM g")
def segment_driver(spark, sf_dir):
    df = orders(spark, sf_dir)
    return I.segment_gaps(df, P.categorical_columns(df)[0], ["o_totalprice"])


@register("agg_31_conversion", "SELECT count(*) AS n, round(avg(l_discount / l_quantity), 6) AS rate FROM lineitem WHERE l_quantity > 0")
def conversion(spark, sf_dir):
    return I.mean_ratio(line(spark, sf_dir), "l_discount", "l_quantity")


@register("agg_32_return_on_spend", "SELECT count(*) AS n, round(avg(l_extendedprice / l_quantity), 6) AS roas FROM lineitem WHERE l_quantity > 0")
def roas(spark, sf_dir):
    return I.mean_ratio(line(spark, sf_dir), "l_extendedprice", "l_quantity", "roas")


@register("agg_34_quality_grade", "SELECT round(avg(p_size), 4) AS mean, max(p_size) AS max, CASE WHEN avg(p_size) < 6 THEN 'poor' WHEN avg(p_size) < 9 THEN 'fair' ELSE 'good' END AS grade FROM part")
def quality_grade(spark, sf_dir):
    return I.graded_mean(part(spark, sf_dir), "p_size", [(6, "poor"), (9, "fair")], "good")


@register("agg_37_domain_kpis", "SELECT 'mean order' AS kpi, round(avg(o_totalprice), 4) AS value, 100000.0::DOUBLE AS target, avg(o_totalprice) >= 100000 AS met FROM orders UNION ALL SELECT 'open share', round(avg((o_orderstatus = 'O')::INT), 4), 0.4, avg((o_orderstatus = 'O')::INT) <= 0.4 FROM orders")
def domain_kpis(spark, sf_dir):
    return R.kpi_check(orders(spark, sf_dir), {"mean order": (F.avg("o_totalprice"), 100000, True), "open share": (F.avg((F.col("o_orderstatus") == "O").cast("int")), 0.4, False)})


@register("agg_42_standardise", "SELECT 'k' AS kind, 'c' AS \"column\", 'Too many' AS title, 'medium' AS severity")
def standardise(spark, sf_dir):
    rows = [("k", "c", " Too  many ", "Warning"), ("k", "c", "Too many", "warn")]
    return R.standardise(spark.createDataFrame(rows, "kind string, column string, title string, severity string"))


@register("dq_11_sweep")
def sweep(spark, sf_dir):
    found = None
    for name, df in tables_of(spark, sf_dir, ("orders", "part", "customer")).items():
        one = Q.table_report(df).withColumn("table", F.lit(name))
        found = one if found is None else found.unionByName(one)
    return found


@register("dq_13_quality_report", "SELECT 'problem status' AS kind, event_type AS subject, count(*) AS n FROM events WHERE regexp_matches(lower(event_type), 'error|fail|cancel|reject|delay|overdue|return|refund|blocked|suspended|lost|damaged') GROUP BY 2 UNION ALL SELECT 'flag', 'toxic', count(*) FILTER (toxic = 1) FROM labels")
def quality_report(spark, sf_dir):
    status = I.status_distribution(events(spark, sf_dir), "event_type").where("kind = 'anomaly'").select(F.lit("problem status").alias("kind"), F.col("status").alias("subject"), "n")
    return status.unionByName(I.flag_counts(labels(spark, sf_dir), "toxic").select(F.lit("flag").alias("kind"), F.lit("toxic").alias("subject"), F.col("true_n").alias("n")))


@register("dq_18_explained_correlations", "SELECT 'p_size' AS a, 'p_retailprice' AS b, round(corr(p_size, p_retailprice), 6) AS r FROM part")
def explained(spark, sf_dir):
    df = part(spark, sf_dir).select("p_size", "p_retailprice", F.col("p_size").alias("twin"))
    pairs = S.correlations(df, ["p_size", "p_retailprice", "twin"]).select("a", "b", "r")
    return R.explained(pairs, Q.duplicate_columns(df, ["p_size", "p_retailprice", "twin"])).where("a = 'p_size'")


@register("dq_26_closed_shape", "SELECT unnest(['c_acctbal', 'c_mktsegment']) AS \"column\"")
def closed(spark, sf_dir):
    return spark.createDataFrame([(c,) for c in Q.closed(customer(spark, sf_dir), {"c_custkey", "c_name", "c_nationkey"})], "column string")


@register("fk_04_column_mappings")
def mappings(spark, sf_dir):
    return spark.createDataFrame(R.column_mappings(tables_of(spark, sf_dir)), "a string, b string, kind string, confidence double")


@register("fk_10_confidence", f"SELECT from_column, {LABEL_SQL} AS confidence FROM ({FK_SQL})")
def confidence(spark, sf_dir):
    return K.foreign_keys(tables_of(spark, sf_dir)).select("from_column", "confidence")


@register("fk_22_names", "SELECT unnest(['cust_id', 'l_orderkey', 'buyer_id', 'categories']) AS name, unnest(['customer', 'order', 'customer', 'category']) AS base")
def names(spark, sf_dir):
    return spark.createDataFrame([(n, naming.base(n)) for n in ("cust_id", "l_orderkey", "buyer_id", "categories")], "name string, base string")


@register("fk_23_table_groups", "SELECT 'sales' AS prefix, 2 AS n")
def groups(spark, sf_dir):
    found = naming.table_groups(["sales_orders", "sales_items", "staff"])
    return spark.createDataFrame([(k, len(v)) for k, v in found.items()], "prefix string, n int")


@register("fk_24_column_match", "SELECT 'o_custkey' AS a, 'c_custkey' AS b, 1.0::DOUBLE AS score")
def column_match(spark, sf_dir):
    t = tables_of(spark, sf_dir, ("orders", "customer"))
    return spark.createDataFrame(E.column_matches(t["orders"].columns, t["customer"].columns, 0.4), "a string, b string, score double")


@register("fk_31_integrated", f"SELECT 'single' AS kind, from_table || '.' || from_column AS source, to_table || '.' || to_column AS target FROM ({FK_SQL})")
def integrated(spark, sf_dir):
    return R.integrated_keys(tables_of(spark, sf_dir)).select("kind", "source", "target")


@register("fk_42_likely_columns", "SELECT unnest(['o_orderkey', 'o_custkey', 'o_orderstatus', 'o_orderdate', 'o_orderpriority']) AS \"column\"")
def likely(spark, sf_dir):
    return R.likely_key_columns(orders(spark, sf_dir))


@register("fk_45_pattern_matches", "SELECT 'customer.c_name' AS a, 'supplier.s_name' AS b, any_value(regexp_replace(regexp_replace(regexp_replace(s_name, '[a-z]', 'a', 'g'), '[A-Z]', 'A', 'g'), '[0-9]', '9', 'g')) AS mask FROM supplier")
def pattern_matches(spark, sf_dir):
    return R.pattern_matches(tables_of(spark, sf_dir, ("customer", "supplier")), {"customer": ["c_name", "c_mktsegment"], "supplier": ["s_name"]})


@register("gr_06_cardinality", "SELECT count(DISTINCT o_custkey) AS common, 'N:1' AS cardinality FROM orders")
def cardinality(spark, sf_dir):
    return R.cardinality(orders(spark, sf_dir), "o_custkey", customer(spark, sf_dir), "c_custkey")


@register("gr_21_homeomorphism", "SELECT 0.5 + 0.5 * 4 / 5 AS score")
def homeomorphism(spark, sf_dir):
    row = spark.createDataFrame([((1, 0, 4), (1, 0, 5))], "a struct<b0:int,b1:int,columns:int>, b struct<b0:int,b1:int,columns:int>")
    return row.select(R.homeomorphism(F.col("a"), F.col("b")).alias("score"))


@register("er_01_entities", "SELECT 'customer' AS entity, count(*) AS n FROM (SELECT unnest([1, 2, 3]))")
def entities(spark, sf_dir):
    return R.entities(tables_of(spark, sf_dir)).where("entity = 'customer'").groupBy("entity").agg(F.count("*").alias("n"))


@register("er_05_pair_similarity", "SELECT a.n_nationkey AS a, b.n_nationkey AS b, round(jaro_winkler_similarity(lower(a.n_name), lower(b.n_name)), 6) AS score FROM nation a JOIN nation b ON a.n_nationkey + 1 = b.n_nationkey")
def pair_similarity(spark, sf_dir):
    n = nation(spark, sf_dir)
    pairs = n.select(F.col("n_nationkey").alias("a"), (F.col("n_nationkey") + 1).alias("b")).where("b < 25")
    return E.pair_similarity(pairs, n, "n_nationkey", "n_name", [])


@register("kb_02_forward_chaining", "SELECT 'o:' || o_orderkey AS subject, 'n:' || c_nationkey AS object, 0.81::DOUBLE AS confidence FROM orders JOIN customer ON o_custkey = c_custkey ")
def forward(spark, sf_dir):
    o = orders(spark, sf_dir).select(F.concat(F.lit("o:"), "o_orderkey").alias("subject"), F.lit("by").alias("predicate"), F.concat(F.lit("c:"), "o_custkey").alias("object"))
    c = customer(spark, sf_dir).select(F.concat(F.lit("c:"), "c_custkey"), F.lit("in"), F.concat(F.lit("n:"), "c_nationkey"))
    facts = o.union(c).withColumn("confidence", F.lit(0.9))
    found = T.infer(facts, [T.Rule("from", (("?o", "by", "?c"), ("?c", "in", "?n")), ("?o", "from", "?n"), 0.9)])
    return found.where("predicate = 'from'").select("subject", "object", F.round("confidence", 6).alias("confidence"))


@register("kb_13_explain", "SELECT 'from' AS rule, 2 AS premises")
def explain(spark, sf_dir):
    rule = T.Rule("from", (("?o", "by", "?c"), ("?c", "in", "?n")), ("?o", "from", "?n"))
    facts = spark.createDataFrame([("o", "by", "c"), ("c", "in", "n")], "subject string, predicate string, object string")
    return T.infer(facts, [rule]).where("rule is not null").select("rule", F.lit(len(rule.body)).alias("premises"))


@register("ver_02_checkout", "SELECT count(*) AS n, true AS whole FROM region")
def checkout(spark, sf_dir):
    repository = V.Repository(spark, scratch_path(spark, "versions"))
    version = repository.commit("one", {"region": region(spark, sf_dir)})
    found = repository.checkout(version)["region"]
    same = tuple(V.checksum(found).first()) == tuple(V.checksum(region(spark, sf_dir)).first())
    return found.agg(F.count("*").alias("n"), F.lit(same).alias("whole"))


@register("ver_04_log", "SELECT unnest(['two', 'one']) AS message")
def log(spark, sf_dir):
    repository = V.Repository(spark, scratch_path(spark, "versions"))
    for m in ("one", "two"):
        repository.commit(m, {"region": region(spark, sf_dir)})
    return spark.createDataFrame([(e["message"],) for e in repository.history()], "message string")


@register("ver_07_fast_forward", "SELECT 'two' AS message")
def fast_forward(spark, sf_dir):
    repository = V.Repository(spark, scratch_path(spark, "versions"))
    repository.commit("one", {"region": region(spark, sf_dir)})
    repository.create_branch("work")
    repository.switch("work")
    repository.commit("two", {"region": region(spark, sf_dir)})
    repository.merge("work", "main", {})
    return spark.createDataFrame([(repository.history("main")[0]["message"],)], "message string")


@register("udf_05_preconditions", "SELECT count(*) AS n FROM orders WHERE o_totalprice > 1000 AND o_orderstatus = 'F'")
def preconditions(spark, sf_dir):
    known = U.Behaviours()
    known.add("orders", "closed", "validation", lambda rows: F.expr("o_orderstatus = 'F'"))
    return known.apply("orders", "closed", orders(spark, sf_dir), "o_totalprice > 1000").agg(F.count("*").alias("n"))


@register("udf_07_state_machine_check", "SELECT 'X' AS unreachable")
def machine(spark, sf_dir):
    m = U.StateMachine("A", [("go", "A", "B", ""), ("back", "X", "A", "")])
    return spark.createDataFrame([(s,) for s in m.validate()], "unreachable string")


@register("kb_22_domain", "SELECT 'retail' AS domain")
def domain(spark, sf_dir):
    columns = [c for df in tables_of(spark, sf_dir).values() for c in df.columns]
    return spark.createDataFrame([(U.domain_of(spark, columns, {"retail": ["order", "cust", "price"], "health": ["patient", "doctor"]}),)], "domain string")


@register("stat_02_cross_table_correlation", "WITH c AS (SELECT c_acctbal AS a, row_number() OVER (ORDER BY c_custkey) AS r FROM customer), s AS (SELECT s_acctbal AS b, row_number() OVER (ORDER BY s_suppkey) AS r FROM supplier) SELECT 'a' AS a, 'b' AS b, round(corr(a, b), 6) AS r, count(*) AS n FROM c JOIN s USING (r)")
def cross_table(spark, sf_dir):
    both = O.aligned(customer(spark, sf_dir).select("c_custkey", F.col("c_acctbal").alias("a")), supplier(spark, sf_dir).select("s_suppkey", F.col("s_acctbal").alias("b")), ["c_custkey"], ["s_suppkey"])
    return S.correlations(both, ["a", "b"])


@register("stat_08_effect_size", "SELECT unnest([0.1, -0.3, 0.6, 1.0]::DOUBLE[]) AS d, unnest(['negligible', 'small', 'medium', 'large']) AS size")
def effect(spark, sf_dir):
    return spark.createDataFrame([(0.1,), (-0.3,), (0.6,), (1.0,)], "d double").select("d", S.effect_size(F.col("d")).alias("size"))


@register("stat_12_propensity")
def propensity(spark, sf_dir):
    beta = S.propensity(line(spark, sf_dir), F.col("l_discount") > 0.05, [F.col("l_quantity"), F.col("l_tax")])
    return spark.createDataFrame([(k, round(float(b), 6)) for k, b in enumerate(beta)], "term int, coefficient double")


@register("scl_10_singular", "SELECT unnest(['orders', 'categories', 'status']) AS word, unnest(['order', 'category', 'status']) AS singular")
def singular(spark, sf_dir):
    return spark.createDataFrame([(w, naming.singular(w)) for w in ("orders", "categories", "status")], "word string, singular string")


@register("scl_23_merge_maps", "SELECT n_nationkey, 'right' AS v FROM nation")
def merge_maps(spark, sf_dir):
    merged = F.map_from_entries(F.map_entries(F.map_zip_with(F.create_map(F.lit("k"), F.lit("left")), F.create_map(F.lit("k"), F.lit("right")), lambda k, a, b: F.coalesce(b, a))))
    return nation(spark, sf_dir).select("n_nationkey", merged["k"].alias("v"))


@register("scl_26_uri", "SELECT r_regionkey, 'http://example.org/' || regexp_replace(r_name, '[^A-Za-z0-9_\\-.]', '_', 'g') AS uri FROM region")
def uris(spark, sf_dir):
    return region(spark, sf_dir).select("r_regionkey", X.uri("http://example.org/", F.col("r_name")).alias("uri"))


@register("skt_02_estimated_jaccard")
def estimated(spark, sf_dir):
    rows = docs(spark, sf_dir).select("lang", F.explode(F.split(F.lower("text"), r"\s+")).alias("w"))
    s = sketch.minhash(rows, "lang", "w", 64)
    return s.select(F.col("lang").alias("a"), F.col("signature").alias("x")).join(s.select(F.col("lang").alias("b"), F.col("signature").alias("y")), F.col("a") < F.col("b")).select("a", "b", F.round(sketch.estimated_jaccard(F.col("x"), F.col("y")), 6).alias("similarity"))


@register("skt_11_entity_blocking")
def blocking(spark, sf_dir):
    return E.candidate_pairs(part(spark, sf_dir), "p_partkey", "p_name", least=0.6)


@register("src_02_header_offset", "SELECT 2 AS lines")
def header(spark, sf_dir):
    return spark.createDataFrame([(readers.detect_header(["# comment", "title", "a,b", "1,2"]),)], "lines int")


@register("src_04_unique_columns", "SELECT unnest(['a', 'a_1', 'column_2']) AS name")
def unique(spark, sf_dir):
    return spark.createDataFrame([(n,) for n in readers.unique_names(["a", "a", ""])], "name string")


@register("src_10_in_memory", "SELECT count(*) AS n FROM region")
def in_memory(spark, sf_dir):
    return readers.Catalog(spark).add_all({"sub/areas": region(spark, sf_dir)}).table("sub/areas").agg(F.count("*").alias("n"))


@register("src_20_context_objects", "SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' ORDER BY c_custkey LIMIT 5 OFFSET 5")
def context(spark, sf_dir):
    types = ObjectTypes(spark).add_type("customer", customer(spark, sf_dir), "c_custkey")
    return types.query("customer").filter({"c_mktsegment": "BUILDING"}).order_by("c_custkey").offset(5).limit(5).select("c_custkey").execute()
