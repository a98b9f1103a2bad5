"""Queries over objects, links and SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstone.operators.objects import Link, ObjectTypes, equality_filter
from quillstone.plans import sql as S
from quillstone.plans.registry import register
from quillstone.storage import read_table

KEYS = [
    S.ForeignKey("orders", "o_custkey", "customer", "c_custkey"),
    S.ForeignKey("lineitem", "l_orderkey", "orders", "o_orderkey"),
    S.ForeignKey("lineitem", "l_partkey", "part", "p_partkey"),
    S.ForeignKey("lineitem", "l_suppkey", "supplier", "s_suppkey"),
    S.ForeignKey("customer", "c_nationkey", "nation", "n_nationkey"),
    S.ForeignKey("supplier", "s_nationkey", "nation", "n_nationkey"),
    S.ForeignKey("nation", "n_regionkey", "region", "r_regionkey"),
]
PRIMARY = {"orders": "o_orderkey", "customer": "c_custkey", "nation": "n_nationkey", "region": "r_regionkey", "supplier": "s_suppkey", "part": "p_partkey", "lineitem": "l_orderkey"}
STAR = tuple(PRIMARY)
#: The links as a common table expression k(a, b, via), for SQL that walks them.
LINKS_SQL = "k(a, b, via) AS (VALUES " + ", ".join(f"('{k.from_table}', '{k.to_table}', '{k.from_table}.{k.from_column}')" for k in KEYS) + ")"


def star(spark, sf_dir) -> ObjectTypes:
    types = ObjectTypes(spark)
    for name, key in PRIMARY.items():
        types.add_type(name, read_table(spark, sf_dir, name), key)
    for fk in KEYS:
        types.add_link(Link(fk.to_table, fk.from_table, fk.from_column, fk.to_table, fk.to_column))
    return types


def views(spark, sf_dir):
    tables = {t: read_table(spark, sf_dir, t) for t in STAR}
    for t, df in tables.items():
        df.createOrReplaceTempView(t)
    return tables


def _orders(name, build, sql):
    register(name, sql)(lambda spark, sf_dir: build(star(spark, sf_dir).query("orders")).execute())


_SOME = "o_orderkey, o_custkey, o_totalprice"
_some = ("o_orderkey", "o_custkey", "o_totalprice")
_orders("qb_01_select", lambda q: q.select("o_orderkey", "o_orderstatus"), "SELECT o_orderkey, o_orderstatus FROM orders")
_orders("qb_02_filter", lambda q: q.filter([{"o_orderstatus": "F", "o_totalprice": {"$gt": 100000, "$lt": 200000}}]).select(*_some), f"SELECT {_SOME} FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000 AND o_totalprice < 200000")
_orders("qb_03_where", lambda q: q.where("o_totalprice", "$gte", 250000).select(*_some), f"SELECT {_SOME} FROM orders WHERE o_totalprice >= 250000")
_orders("qb_05_eq", lambda q: q.where("o_orderstatus", "$eq", "O").select(*_some), f"SELECT {_SOME} FROM orders WHERE o_orderstatus = 'O'")
_orders("qb_06_ne", lambda q: q.where("o_orderstatus", "$ne", "O").select(*_some), f"SELECT {_SOME} FROM orders WHERE o_orderstatus <> 'O'")
_orders("qb_07_gt", lambda q: q.where("o_totalprice", "$gt", 300000).select(*_some), f"SELECT {_SOME} FROM orders WHERE o_totalprice > 300000")
_orders("qb_08_lte", lambda q: q.where("o_totalprice", "$lte", 50000).select(*_some), f"SELECT {_SOME} FROM orders WHERE o_totalprice <= 50000")
_orders("qb_09_in", lambda q: q.where("o_orderpriority", "$in", ["1-URGENT", "2-HIGH"]).select(*_some), f"SELECT {_SOME} FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')")
_orders("qb_10_not_in", lambda q: q.where("o_orderpriority", "$nin", ["1-URGENT", "2-HIGH"]).select(*_some), f"SELECT {_SOME} FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH')")
_orders("qb_11_like", lambda q: q.where("o_orderpriority", "$like", "%-H%").select(*_some), f"SELECT {_SOME} FROM orders WHERE o_orderpriority LIKE '%-H%'")
_orders("qb_12_ilike", lambda q: q.where("o_orderpriority", "$ilike", "%urgent").select(*_some), f"SELECT {_SOME} FROM orders WHERE o_orderpriority ILIKE '%urgent'")
_orders("qb_13_null", lambda q: q.where("o_custkey", "$notnull").select(*_some), f"SELECT {_SOME} FROM orders WHERE o_custkey IS NOT NULL")
_orders("qb_14_between", lambda q: q.where("o_totalprice", "$between", (1000, 90000)).select(*_some), f"SELECT {_SOME} FROM orders WHERE o_totalprice BETWEEN 1000 AND 90000")
_orders("qb_15_sort", lambda q: q.order_by("o_orderstatus", True).order_by("o_orderkey").select(*_some).limit(50), f"SELECT {_SOME} FROM orders ORDER BY o_orderstatus DESC, o_orderkey LIMIT 50")
_orders("qb_16_limit", lambda q: q.order_by("o_totalprice", True).order_by("o_orderkey").limit(10).select(*_some), f"SELECT {_SOME} FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
_orders("qb_17_offset", lambda q: q.order_by("o_orderkey").offset(100).select(*_some), f"SELECT {_SOME} FROM orders ORDER BY o_orderkey OFFSET 100")
_orders("qb_18_page", lambda q: q.order_by("o_orderkey").page(3, 20).select(*_some), f"SELECT {_SOME} FROM orders ORDER BY o_orderkey LIMIT 20 OFFSET 40")


@register("qb_19_include", "SELECT o_orderkey, o_totalprice, c_name, c_mktsegment FROM (SELECT * FROM orders WHERE o_totalprice > 100000 ORDER BY o_totalprice DESC, o_orderkey LIMIT 10) LEFT JOIN customer ON o_custkey = c_custkey")
def include(spark, sf_dir):
    q = star(spark, sf_dir).query("orders").filter({"o_totalprice": {"$gt": 100000}}).include("customer").order_by("o_totalprice", True).order_by("o_orderkey").limit(10)
    return q.execute().select("o_orderkey", "o_totalprice", "customer.c_name", "customer.c_mktsegment")


@register("qb_21_count", "SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'F'")
def count(spark, sf_dir):
    return star(spark, sf_dir).query("orders").filter({"o_orderstatus": "F"}).count()


@register("qb_22_exists", "SELECT count(*) > 0 AS found FROM orders WHERE o_totalprice > 1")
def exists(spark, sf_dir):
    return spark.range(1).select(F.lit(star(spark, sf_dir).query("orders").where("o_totalprice", "$gt", 1).exists()).alias("found"))


@register("qb_23_first", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 1")
def first(spark, sf_dir):
    return star(spark, sf_dir).query("orders").order_by("o_orderkey").select("o_orderkey").first()


@register("qb_24_json", """SELECT '{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '"}' AS value FROM nation""")
def as_json(spark, sf_dir):
    return star(spark, sf_dir).query("nation").select("n_nationkey", "n_name").to_json()


@register("qb_25_get_by_id", "SELECT * FROM customer WHERE c_custkey = 7")
def get_by_id(spark, sf_dir):
    return star(spark, sf_dir).get_by_id("customer", 7)


@register("qb_26_raw", "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_totalprice > 1000 GROUP BY o_orderstatus")
def raw(spark, sf_dir):
    views(spark, sf_dir)
    return S.SqlRunner(spark).execute("SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_totalprice > :least GROUP BY o_orderstatus", {"least": 1000})


@register("qb_27_equality", "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey IS NOT DISTINCT FROM 1")
def equal(spark, sf_dir):
    return equality_filter(read_table(spark, sf_dir, "nation"), {"n_regionkey": 1}).select("n_nationkey", "n_name")


_CUBE = "SELECT o_orderstatus, o_orderpriority, count(*) AS n, grouping(o_orderstatus) + 0 AS g FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)"


@register("sql_01_execute", "SELECT o_orderstatus, o_orderpriority, count(*) AS n, grouping(o_orderstatus)::INTEGER AS g FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def execute(spark, sf_dir):
    views(spark, sf_dir)
    return S.SqlRunner(spark).execute(_CUBE).withColumn("g", F.col("g").cast("int"))


@register("sql_02_bind", "SELECT n_name FROM nation WHERE n_regionkey = 2")
def bind(spark, sf_dir):
    views(spark, sf_dir)
    return S.SqlRunner(spark).execute("SELECT n_name FROM nation WHERE n_regionkey = ?", [2])


@register("sql_03_validate", "SELECT unnest(['SELECT * FROM orders JOIN customer ON o_custkey = c_custkey', 'SELECT nothing FROM orders', 'SELEC 1']) AS sql, unnest([true, false, false]) AS valid, unnest(['customer,orders', '', '']) AS tables")
def validate(spark, sf_dir):
    views(spark, sf_dir)
    runner = S.SqlRunner(spark)
    tests = ["SELECT * FROM orders JOIN customer ON o_custkey = c_custkey", "SELECT nothing FROM orders", "SELEC 1"]
    return spark.createDataFrame([(k, r["valid"], ",".join(r["tables"])) for k, r in ((t, runner.validate(t)) for t in tests)], "sql string, valid boolean, tables string")


@register("sql_04_preview", "SELECT * FROM region ORDER BY r_regionkey LIMIT 5")
def preview(spark, sf_dir):
    views(spark, sf_dir)
    return S.SqlRunner(spark).preview("region")


@register("sql_08_question", "SELECT n_name, sum(o_totalprice) AS sum_o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name ORDER BY 2 DESC, 1 LIMIT 5")
def question(spark, sf_dir):
    tables = views(spark, sf_dir)
    return S.answer(spark, "top 5 nation name by total totalprice of orders", {t: tables[t] for t in ("orders", "customer", "nation")}, KEYS)


@register("sql_09_join_path", "SELECT r_name, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def join_path(spark, sf_dir):
    tables = views(spark, sf_dir)
    keys = [k for k in KEYS if k.from_table != "supplier"]
    return S.join_along(tables, "lineitem", S.JoinPaths(keys).find("lineitem", "region")).groupBy("r_name").agg(F.count("*").alias("n"))


@register("sql_10_connect", "SELECT p_brand, s_name, count(*) AS n FROM part JOIN lineitem ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey WHERE p_size = 1 GROUP BY ALL")
def connect(spark, sf_dir):
    tables = views(spark, sf_dir)
    return S.join_along(tables, "part", S.JoinPaths(KEYS).connect(["part", "supplier"])).where("p_size = 1").groupBy("p_brand", "s_name").agg(F.count("*").alias("n"))


@register("sql_11_all_paths", f"WITH RECURSIVE {LINKS_SQL}, e AS (SELECT a, b, via FROM k UNION SELECT b, a, via FROM k), p AS (SELECT a, b, [a, b] AS seen, via AS path, 1 AS hops FROM e WHERE a = 'orders' UNION ALL SELECT p.a, e.b, list_append(seen, e.b), path || ' > ' || via, hops + 1 FROM p JOIN e ON p.b = e.a WHERE NOT list_contains(seen, e.b) AND hops < 4) SELECT hops, path FROM p WHERE b = 'nation'")
def all_paths(spark, sf_dir):
    paths = S.JoinPaths(KEYS).all("orders", "nation", 4)
    return spark.createDataFrame([(len(p), " > ".join(f"{k.from_table}.{k.from_column}" for k in p)) for p in paths], "hops int, path string")


@register("sql_12_left_join", "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def left_join(spark, sf_dir):
    tables = views(spark, sf_dir)
    return tables["customer"].join(tables["orders"], F.col("c_custkey") == F.col("o_custkey"), S.join_type("orders", KEYS[0])).groupBy("c_custkey").agg(F.count("o_orderkey").alias("n"))


@register("sql_13_join_clause", "SELECT count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey")
def join_clause(spark, sf_dir):
    views(spark, sf_dir)
    return spark.sql("SELECT count(*) AS n FROM " + S.join_sql("nation", S.JoinPaths(KEYS).find("nation", "region")))


@register("sql_14_related", f"WITH {LINKS_SQL} SELECT a AS \"table\", b AS related FROM k UNION SELECT b, a FROM k")
def related(spark, sf_dir):
    paths = S.JoinPaths(KEYS)
    return spark.createDataFrame([(t, r) for t in STAR for r in paths.related(t)], "table string, related string")


@register("join_01_outgoing", "SELECT o_orderkey, c_custkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def outgoing(spark, sf_dir):
    types = star(spark, sf_dir)
    return types.outgoing(types.tables["orders"], "orders", "customer").select("o_orderkey", "c_custkey", "c_name")


@register("join_02_incoming", "SELECT c_custkey, coalesce(n, 0)::BIGINT AS n_linked, coalesce(least_key, -1) AS least_key FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, min(o_orderkey) AS least_key FROM orders GROUP BY 1) ON c_custkey = o_custkey")
def incoming(spark, sf_dir):
    types = star(spark, sf_dir)
    found = types.incoming(types.tables["customer"], types.links["orders", "customer"])
    return found.select("c_custkey", "n_linked", F.coalesce(F.get("linked", F.lit(0)), F.lit(-1)).alias("least_key"))


@register("udf_04_derived_property", "SELECT c_custkey, round(total, 2) AS total FROM customer LEFT JOIN (SELECT o_custkey, sum(o_totalprice) AS total FROM orders GROUP BY 1) ON c_custkey = o_custkey")
def derived(spark, sf_dir):
    types = star(spark, sf_dir)
    return types.derive("customer", types.links["orders", "customer"], "total", F.round(F.sum("o_totalprice"), 2)).select("c_custkey", "total")


@register("ver_12_update", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def update(spark, sf_dir):
    return star(spark, sf_dir).update("orders", F.col("o_orderstatus") == "P", {"o_orderstatus": F.lit("X")}).select("o_orderkey", "o_orderstatus")


@register("ver_12_create", "SELECT n_nationkey, n_name FROM nation UNION ALL SELECT 100, 'ATLANTIS'")
def create(spark, sf_dir):
    fresh = spark.createDataFrame([(100, "ATLANTIS", 0), (3, "TWICE", 0)], "n_nationkey int, n_name string, n_regionkey int")
    return star(spark, sf_dir).create("nation", fresh).select("n_nationkey", "n_name")


@register("ver_12_delete", "SELECT o_orderkey FROM orders WHERE NOT coalesce(o_totalprice < 200000, false)")
def delete(spark, sf_dir):
    return star(spark, sf_dir).delete("orders", F.col("o_totalprice") < 200000).select("o_orderkey")
