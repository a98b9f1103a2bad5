"""Queries over key discovery, alignment, relation graphs and what names say."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstone.operators import alignment as A
from quillstone.operators import discovery as D
from quillstone.operators import entities as E
from quillstone.operators import graph as G
from quillstone.operators import keys as K
from quillstone.operators import overlap as O
from quillstone.operators import search, sketch
from quillstone.operators import triples as T
from quillstone.plans.linking import _COLS, _INDEX_SQL, FK_SQL, PAIR_SQL, tables_of
from quillstone.plans.registry import register
from quillstone.storage import read_table


def _t(name):
    return lambda spark, sf_dir: read_table(spark, sf_dir, name)


customer, orders, part, nation, region, docs, labels, embeddings, line, supplier = map(_t, ("customer", "orders", "part", "nation", "region", "documents", "labels", "embeddings", "lineitem", "supplier"))
_ENDS = "from_table, from_column, to_table, to_column"


@register("fk_02_named_keys", f"SELECT from_table, from_column, to_table FROM ({FK_SQL})")
def named_keys(spark, sf_dir):
    return spark.createDataFrame(D.named_keys(tables_of(spark, sf_dir)), "from_table string, from_column string, to_table string")


def _same_name_sql(a, b):
    return f"SELECT '{a}' AS from_table, 'doc_id' AS from_column, '{b}' AS to_table, 'doc_id' AS to_column, round((SELECT count(DISTINCT doc_id) FROM {a} WHERE doc_id IN (SELECT doc_id FROM {b})) / (SELECT count(DISTINCT doc_id) FROM {a}), 6) AS inclusion, (SELECT count(DISTINCT doc_id) / count(doc_id) FROM {a}) AS own, (SELECT count(DISTINCT doc_id) / count(doc_id) FROM {b}) AS other"


@register("fk_07_same_name", f"SELECT {_ENDS}, inclusion FROM ({_same_name_sql('documents', 'labels')} UNION ALL {_same_name_sql('labels', 'documents')}) WHERE inclusion >= 0.5 AND other >= own")
def same_name(spark, sf_dir):
    return D.same_name(tables_of(spark, sf_dir, ("documents", "labels", "embeddings")))


_UNIQUE = "(" + " UNION ALL ".join(f"SELECT '{t}.{c}' AS col, count(DISTINCT {c}) / count({c}) AS u FROM {t}" for t, cs in _COLS.items() for c in cs) + ")"
_SPLIT = "split_part(f, '.', 1) AS from_table, split_part(f, '.', 2) AS from_column, split_part(p, '.', 1) AS to_table, split_part(p, '.', 2) AS to_column"


@register("fk_08_value_inclusion", _INDEX_SQL + f", w AS (SELECT col_a AS f, col_b AS p, a_in_b AS inclusion FROM o UNION ALL SELECT col_b, col_a, b_in_a FROM o) SELECT {_SPLIT}, inclusion FROM w JOIN {_UNIQUE} u ON u.col = p WHERE inclusion >= 0.95 AND u >= 0.99")
def by_inclusion(spark, sf_dir):
    return D.by_inclusion(tables_of(spark, sf_dir, _COLS), _COLS)


@register("fk_12_type_compatibility", "SELECT unnest(['bigint', 'int', 'string', 'string', 'timestamp']) AS a, unnest(['bigint', 'double', 'varchar', 'int', 'bigint']) AS b, unnest([1.0, 0.9, 0.9, 0.3, 0.3]::DOUBLE[]) AS score")
def type_compatibility(spark, sf_dir):
    pairs = [("bigint", "bigint"), ("int", "double"), ("string", "varchar"), ("string", "int"), ("timestamp", "bigint")]
    return spark.createDataFrame([(a, b, D.type_compatibility(a, b)) for a, b in pairs], "a string, b string, score double")


_MARGIN = "0.8 * (uniqueness - own) + 0.7 * (inclusion - common / size_p) + 0.5 * sign(rf - rp)"
_ROWS = f"(SELECT x.*, (SELECT n FROM r WHERE t = from_table) AS rf, (SELECT n FROM r WHERE t = to_table) AS rp FROM ({PAIR_SQL}) x)"
_R = "WITH r AS (" + " UNION ALL ".join(f"SELECT '{t}' AS t, count(*) AS n FROM {t}" for t in ("orders", "customer", "nation", "region", "supplier", "part", "lineitem")) + ") "


@register("fk_16_pipeline", _R + f"SELECT {_ENDS} FROM (SELECT *, {_MARGIN} AS margin FROM {_ROWS}) WHERE margin >= 0.3 AND uniqueness >= 0.99 AND inclusion >= 0.8")
def pipeline(spark, sf_dir):
    return D.pipeline(tables_of(spark, sf_dir)).select(*D.EVIDENCE)


@register("fk_17_universal", f"SELECT {_ENDS} FROM ({PAIR_SQL}) WHERE jaccard >= 0.3 AND inclusion >= 0.8 AND uniqueness >= 0.99")
def universal(spark, sf_dir):
    return D.universal(tables_of(spark, sf_dir)).select(*D.EVIDENCE)


def _named_pairs(tables):
    return [p for p in K.candidates(tables) if p[1].split("_", 1)[1] == p[3].split("_", 1)[1]]


@register("fk_19_without_reverse", f"SELECT {_ENDS} FROM (SELECT *, row_number() OVER (PARTITION BY list_sort([from_table || '.' || from_column, to_table || '.' || to_column]) ORDER BY uniqueness - own DESC, from_table || '.' || from_column) AS k FROM ({PAIR_SQL})) WHERE k = 1")
def reverse(spark, sf_dir):
    tables = tables_of(spark, sf_dir)
    return D.without_reverse(D.evidence(tables, _named_pairs(tables))).select(*D.EVIDENCE)


@register("fk_21_confidence_factors", f"SELECT {_ENDS}, round(0.2 * 0.95 + 0.15 * jaccard + 0.35 * inclusion + CASE WHEN inclusion >= 0.95 THEN 0.05 ELSE 0 END + 0.15 * uniqueness, 6) AS confidence FROM ({PAIR_SQL})")
def factors(spark, sf_dir):
    tables = tables_of(spark, sf_dir)
    return D.confidence_factors(D.evidence(tables, _named_pairs(tables)))


@register("dq_28_false_positives", "SELECT unnest(['o_orderdate', 'l_quantity', 'o_custkey', 'c_name']) AS a, unnest(['l_shipdate', 'p_size', 'c_custkey', 's_suppkey']) AS b, unnest(['date', 'measure', NULL, 'text']) AS why")
def false_positives(spark, sf_dir):
    pairs = [("o_orderdate", "l_shipdate"), ("l_quantity", "p_size"), ("o_custkey", "c_custkey"), ("c_name", "s_suppkey")]
    return spark.createDataFrame([(a, b, D.false_positive(a, b)) for a, b in pairs], "a string, b string, why string")


@register("fk_32_references", "SELECT unnest(['assigned_to_employee_id', 'parent_order_id', 'buyer_id', 'l_partkey']) AS \"column\", unnest(['employees', 'orders', 'customers', 'parts']) AS \"table\", unnest(['verb', 'self', 'plain', 'plain']) AS kind")
def references(spark, sf_dir):
    columns, tables = ("assigned_to_employee_id", "parent_order_id", "buyer_id", "l_partkey", "comment"), ("employees", "orders", "customers", "parts")
    return spark.createDataFrame([(c, *r) for c in columns if (r := D.reference(c, tables))], "column string, table string, kind string")


@register("fk_33_bridges", f"SELECT from_table AS \"table\", count(DISTINCT to_table) AS n FROM ({FK_SQL}) GROUP BY 1 HAVING count(DISTINCT to_table) >= 2")
def bridges(spark, sf_dir):
    return D.bridges(K.foreign_keys(tables_of(spark, sf_dir)))


@register("join_17_indirect", f"WITH f AS ({FK_SQL}) SELECT DISTINCT x.to_table AS a, x.from_table AS bridge, y.to_table AS b FROM f x JOIN f y ON x.from_table = y.from_table AND x.to_table < y.to_table WHERE NOT EXISTS (SELECT 1 FROM f z WHERE least(z.from_table, z.to_table) = x.to_table AND greatest(z.from_table, z.to_table) = y.to_table)")
def indirect(spark, sf_dir):
    return D.indirect(K.foreign_keys(tables_of(spark, sf_dir)))


def _renamed(spark, sf_dir):
    """Tables whose columns hold the same values under other names."""
    c, o = customer(spark, sf_dir), orders(spark, sf_dir)
    return {"clients": c.select(F.col("c_custkey").alias("client_number"), F.col("c_mktsegment").alias("mkt_segment")), "accounts": c.select(F.col("c_custkey").alias("clnt_number"), F.col("c_mktsegment").alias("market_segment")), "sales": o.select(F.col("o_custkey").alias("patron_number"))}


def _overlapping(spark, sf_dir):
    tables = _renamed(spark, sf_dir)
    found = O.overlaps(O.inverted_index(tables, {t: df.columns for t, df in tables.items()}), min_jaccard=0.8)
    return [(r.col_a.split(".")[1], r.col_b.split(".")[1]) for r in found.collect()]  # a row for each pair of columns


_MANY = "(SELECT count(DISTINCT o_custkey) FROM orders) >= 0.8 * (SELECT count(*) FROM customer)"


@register("fk_34_abbreviations", "SELECT unnest(['clnt', 'mkt']) AS short, unnest(['client', 'market']) AS long")
def abbreviations(spark, sf_dir):
    return spark.createDataFrame(D.abbreviations(_overlapping(spark, sf_dir)), "short string, long string")


@register("fk_36_synonyms", f"SELECT unnest(['client', 'clnt']) AS a, 'patron' AS b WHERE {_MANY}")
def synonyms(spark, sf_dir):
    return spark.createDataFrame(D.synonyms(_overlapping(spark, sf_dir)), "a string, b string")


@register("fk_37_mandatory", f"SELECT {_ENDS}, round(least(score + 0.1, 1.0), 4) AS score FROM ({FK_SQL}) WHERE inclusion >= 0.999 AND uniqueness >= 0.999")
def mandatory(spark, sf_dir):
    return D.mandatory(K.foreign_keys(tables_of(spark, sf_dir)))


@register("fk_38_cross_platform", "WITH x AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_returnflag = 'R'), y AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_returnflag = 'A') SELECT 'meta_ads' AS a, 'search_ads' AS b, 'campaign_id' AS \"column\", count(*) AS common, round(count(*) / ((SELECT count(*) FROM x) + (SELECT count(*) FROM y) - count(*)), 6) AS jaccard FROM x JOIN y USING (k)")
def cross_platform(spark, sf_dir):
    ads = lambda flag: line(spark, sf_dir).where(F.col("l_returnflag") == flag).select(F.col("l_partkey").alias("campaign_id"), "l_quantity")
    return D.cross_platform({"meta_ads": ads("R"), "search_ads": ads("A")})


@register("fk_39_heuristic_keys", "SELECT unnest(['order_id', 'customer_id', 'parent_order_id', 'product']) AS \"column\", unnest(['primary_key', 'foreign_key', 'self_reference', 'single_noun']) AS kind")
def heuristic(spark, sf_dir):
    found = D.heuristic_keys("orders", ["order_id", "customer_id", "parent_order_id", "product", "amount"], ["orders", "customers", "products"])
    return spark.createDataFrame(found, "column string, kind string")


@register("fk_40_judged", f"SELECT {_ENDS}, CASE WHEN inclusion >= 0.9 THEN 'strong' ELSE 'weak' END AS verdict, least(CASE WHEN inclusion >= 0.9 THEN 0.9 ELSE 0.7 END, score)::DOUBLE AS confidence FROM ({FK_SQL})")
def judged(spark, sf_dir):
    return D.judged(K.foreign_keys(tables_of(spark, sf_dir)))


@register("fk_40_asked", f"SELECT {_ENDS}, CASE WHEN to_table = 'nation' THEN 'strong' ELSE 'none' END AS verdict, 0.5::DOUBLE AS confidence FROM ({FK_SQL})")
def asked(spark, sf_dir):
    return D.judged(K.foreign_keys(tables_of(spark, sf_dir)), lambda row: ("strong" if row["to_table"] == "nation" else "none", 0.5))


@register("fk_41_resolver", "SELECT unnest(['cust_id', 'buyer_id', 'main_supplier_id', 'parent_id', 'price']) AS fk, unnest([0.95, 0.85, 0.75, 0.85, 0.0]::DOUBLE[]) AS confidence, unnest(['same entity', 'synonym', 'compound', 'parent', 'no key']) AS reason")
def resolver(spark, sf_dir):
    asked = [("cust_id", "orders", "id", "customers"), ("buyer_id", "orders", "customer_id", "customers"), ("main_supplier_id", "parts", "supplier_id", "suppliers"), ("parent_id", "parts", "part_id", "parts"), ("price", "orders", "id", "customers")]
    return spark.createDataFrame([(a[0], *D.resolve_reference(*a)) for a in asked], "fk string, confidence double, reason string")


@register("gr_01_relation_graph", _INDEX_SQL + f"SELECT kind, count(*) AS n, round(sum(weight), 4) AS weight FROM (SELECT 'key' AS kind, score AS weight FROM ({FK_SQL}) WHERE from_table IN ('orders', 'customer', 'nation', 'supplier') AND to_table IN ('customer', 'nation', 'region') UNION ALL SELECT 'values', jaccard FROM o WHERE jaccard >= 0.5) GROUP BY 1")
def relation_graph(spark, sf_dir):
    tables = tables_of(spark, sf_dir, _COLS)
    found = D.relation_graph(tables, K.foreign_keys(tables), O.overlaps(O.inverted_index(tables, _COLS), min_jaccard=0.5))
    return found.where("kind in ('key', 'values')").groupBy("kind").agg(F.count("*").alias("n"), F.round(F.sum("weight"), 4).alias("weight"))


@register("gr_08_schema_graph", "SELECT 'has' AS kind, 7 AS n UNION ALL SELECT 'name', 3")
def schema_graph(spark, sf_dir):
    tables = {"customer": customer(spark, sf_dir).select("c_custkey", "c_nationkey", "c_name"), "nation": nation(spark, sf_dir).select("n_nationkey", "n_name"), "region": region(spark, sf_dir)}
    none = spark.createDataFrame([], "from_table string, from_column string, to_table string, to_column string, score double")
    shared = spark.createDataFrame([], "col_a string, col_b string, jaccard double")
    edges = D.relation_graph(tables, none, shared).where("kind = 'has' or (kind = 'name' and a like 'customer.%')")
    return edges.groupBy("kind").agg(F.count("*").cast("int").alias("n"))


@register("gr_22_column_cloud", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", round(count(DISTINCT {c}) / count(*), 6) AS \"distinct\", round(count({c}) / count(*), 6) AS filled, round(avg(length({c}::VARCHAR)), 6) AS length FROM documents" for c in ("doc_id", "text", "lang", "source")))
def column_cloud(spark, sf_dir):
    return G.column_cloud(docs(spark, sf_dir).select("doc_id", "text", "lang", "source"))


@register("gr_22_bottleneck", "SELECT unnest([0.0, 0.1, 0.5]::DOUBLE[]) AS distance")
def bottleneck(spark, sf_dir):
    base = [(0.0, 1.0), (0.2, 0.5)]
    return spark.createDataFrame([(round(G.bottleneck(base, other), 6),) for other in (base, [(0.1, 1.0), (0.2, 0.5)], [(0.2, 0.5)])], "distance double")


@register("gr_26_inner_product", "SELECT b.vec_id, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 5) AS score FROM embeddings a, embeddings b WHERE a.vec_id = 7 ORDER BY 2 DESC, 1 LIMIT 5")
def inner(spark, sf_dir):
    vectors = embeddings(spark, sf_dir)
    return search.inner_product(vectors, "vec_id", "embedding", vectors.where("vec_id = 7").first().embedding)


@register("kb_18_lineage_edges", f"SELECT to_table || '.' || to_column AS source, from_table || '.' || from_column AS target FROM ({FK_SQL})")
def lineage_edges(spark, sf_dir):
    return T.lineage_edges(K.foreign_keys(tables_of(spark, sf_dir)))


# Alignment.


_NEXT = "FROM nation a JOIN nation b ON a.n_nationkey + 1 = b.n_nationkey"


def _neighbours(spark, sf_dir):
    return nation(spark, sf_dir).select(F.col("n_nationkey").alias("a"), (F.col("n_nationkey") + 1).alias("b")).where("b < 25")


@register("er_06_threshold", f"SELECT a.n_nationkey AS a, b.n_nationkey AS b, round(jaro_winkler_similarity(lower(a.n_name), lower(b.n_name)), 6) AS score {_NEXT} WHERE jaro_winkler_similarity(lower(a.n_name), lower(b.n_name)) >= 0.95")
def threshold(spark, sf_dir):
    return A.matches(E.pair_similarity(_neighbours(spark, sf_dir), nation(spark, sf_dir), "n_nationkey", "n_name", []), 0.95)


def _people(spark, sf_dir):
    """Parts and their names as another catalogue has them: every name with a legal form, in capitals."""
    p = part(spark, sf_dir).select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", "p_brand", "p_type").alias("name"), F.col("p_type").alias("kind"))
    return p, p.select((F.col("id") + 1_000_000).alias("id"), F.concat(F.upper("name"), F.lit(", Inc.")).alias("name"), "kind")


def _committee(spark, sf_dir):
    p, other = _people(spark, sf_dir)
    both = p.union(other.withColumn("name", F.lower("name")))
    pairs = p.select(F.col("id").alias("a"), (F.col("id") + 1_000_000).alias("b")).union(p.select("id", (F.pmod(F.col("id") * 7 + 3, F.lit(1000)) + 1_000_000)))
    pairs = pairs.join(both.select(F.col("id").alias("b")), "b", "left_semi").distinct()
    f = A.pair_features(pairs, both, "id", "name", ["kind"]).withColumn("same", (F.col("b") == F.col("a") + 1_000_000).cast("int"))
    labelled = f.where("a % 20 = 0").orderBy("a", "b").limit(2000).toPandas()  # what people labelled: at most 2,000 pairs
    names = [c for c in f.columns if c.startswith("f")]
    return f, A.fit_committee(labelled[names].to_numpy(float), labelled["same"].to_numpy(float))


@register("er_07_committee")
def committee(spark, sf_dir):
    """How many pairs the committee judges right, of those it was not shown."""
    f, weights = _committee(spark, sf_dir)
    scored = A.committee_scores(f, weights).withColumn("same", F.col("b") == F.col("a") + 1_000_000).where("a % 20 <> 0")
    return scored.agg(F.count("*").alias("n"), F.round(F.avg(((F.col("probability") >= 0.5) == F.col("same")).cast("int")), 6).alias("right"))


@register("er_09_cross_table", "SELECT 'catalogue' AS table_a, min((p_partkey + 1000000)::VARCHAR) AS key_a, 'part' AS table_b, min(p_partkey::VARCHAR) AS key_b FROM part GROUP BY p_name, p_brand, p_type")
def cross_table(spark, sf_dir):
    p, other = _people(spark, sf_dir)
    return A.cross_table_mapping({"part": (p, "id", "name"), "catalogue": (other, "id", "name")})


@register("er_10_deduplicated", "SELECT min(p_partkey) AS p_partkey, p_name AS name, count(*) AS n FROM part GROUP BY p_name")
def deduplicated(spark, sf_dir):
    return A.deduplicated(part(spark, sf_dir), "p_partkey", "p_name")


@register("er_11_same_entity", "SELECT unnest(['orders', 'Order Items', 'categories', 'cust_id', 'part']) AS a, unnest(['orders', 'order_items', 'category', 'customer_key', 'nation']) AS b, unnest(['exact', 'normalised', 'singular', 'entity', NULL]) AS how")
def same_entity(spark, sf_dir):
    pairs = [("orders", "orders"), ("Order Items", "order_items"), ("categories", "category"), ("cust_id", "customer_key"), ("part", "nation")]
    return spark.createDataFrame([(a, b, A.same_entity(a, b)) for a, b in pairs], "a string, b string, how string")


@register("er_12_align", "SELECT unnest(['o_orderkey', 'o_custkey', 'o_totalprice', 'o_orderstatus']) AS a, unnest(['order_id', 'customer_id', 'total_price', 'status']) AS b")
def align(spark, sf_dir):
    o = orders(spark, sf_dir).select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")
    other = o.toDF("order_id", "customer_id", "total_price", "status")
    return spark.createDataFrame([(a, b) for a, b, _ in A.align(o, other)], "a string, b string")


_NORM = "trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))"


@register("er_13_string_mix", f"WITH n AS (SELECT a.n_nationkey AS a, b.n_nationkey AS b, {_NORM.format('a.n_name')} AS x, {_NORM.format('b.n_name')} AS y {_NEXT}), s AS (SELECT *, string_split(x, ' ') AS p, string_split(y, ' ') AS q FROM n) SELECT a, b, round(CASE WHEN x = y THEN 1 ELSE 0.35 * jaro_winkler_similarity(x, y) + 0.25 * len(list_intersect(p, q)) / len(list_distinct(p || q)) + 0.25 * (1 - levenshtein(x, y) / greatest(length(x), length(y))) + 0.15 * len(list_filter(range(1, least(length(x), length(y)) + 1), lambda i: x[:i] = y[:i])) / greatest(length(x), length(y)) END, 6) AS score FROM s")
def string_mix(spark, sf_dir):
    n = nation(spark, sf_dir)
    j = _neighbours(spark, sf_dir).join(n.select(F.col("n_nationkey").alias("a"), F.col("n_name").alias("x")), "a").join(n.select(F.col("n_nationkey").alias("b"), F.col("n_name").alias("y")), "b")
    return j.select("a", "b", A.string_similarity(F.col("x"), F.col("y")).alias("score"))


_MASK = "regexp_replace(regexp_replace(regexp_replace(v, '[a-z]', 'a', 'g'), '[A-Z]', 'A', 'g'), '[0-9]', '9', 'g')"


@register("er_14_instances", f"WITH x AS (SELECT DISTINCT o_custkey::VARCHAR AS v FROM orders), y AS (SELECT DISTINCT c_custkey::VARCHAR AS v FROM customer), p AS (SELECT DISTINCT {_MASK} AS v FROM x), q AS (SELECT DISTINCT {_MASK} AS v FROM y), s AS (SELECT (SELECT count(*) FROM (FROM x INTERSECT FROM y)) / (SELECT count(*) FROM (FROM x UNION FROM y)) AS a, (SELECT count(*) FROM (FROM p INTERSECT FROM q)) / (SELECT count(*) FROM (FROM p UNION FROM q)) AS f, (SELECT avg(length(v)) FROM x) AS la, (SELECT avg(length(v)) FROM y) AS lb) SELECT round(a, 6) AS \"values\", round(f, 6) AS forms, round(0.5 * a + 0.3 * f + 0.2 * (1 - abs(la - lb) / greatest(la, lb)), 6) AS score FROM s")
def instances(spark, sf_dir):
    return A.instance_similarity(orders(spark, sf_dir), "o_custkey", customer(spark, sf_dir), "c_custkey")


@register("er_17_table_similarity", _INDEX_SQL + ", b AS (SELECT least(split_part(col_a, '.', 1), split_part(col_b, '.', 1)) AS a, greatest(split_part(col_a, '.', 1), split_part(col_b, '.', 1)) AS b, max(greatest(a_in_b, b_in_a)) AS value FROM o GROUP BY 1, 2), n AS (SELECT unnest(['customer', 'nation', 'orders', 'region', 'supplier']) AS t, unnest([5, 3, 6, 2, 4]) AS k) SELECT x.t AS a, y.t AS b, round(least(x.k, y.k) / greatest(x.k, y.k), 6) AS structure, round(coalesce(value, 0), 6) AS value FROM n x JOIN n y ON x.t < y.t LEFT JOIN b ON b.a = x.t AND b.b = y.t")
def table_similarity(spark, sf_dir):
    tables = tables_of(spark, sf_dir, _COLS)
    return A.table_similarity(tables, O.overlaps(O.inverted_index(tables, _COLS))).select("a", "b", "structure", "value")


@register("er_18_conflicts", "SELECT unnest(['Order', 'Client', 'Order']) AS a, unnest(['Orders', 'Buyer', 'Orders']) AS b, unnest(['definition', 'name', 'type']) AS kind")
def conflicts(spark, sf_dir):
    concepts = [("Order", "goods that a customer asks for", "object"), ("Orders", "ranks of clerics", "role"), ("Client", "someone who buys goods", "role"), ("Buyer", "someone who buys goods", "role")]
    return spark.createDataFrame(A.concept_conflicts(concepts), "a string, b string, kind string")


@register("er_19_concept_quality", "SELECT unnest(['Order', 'thing', 'Part']) AS name, unnest([1.0, 0.2, 0.7]::DOUBLE[]) AS quality, unnest(['good', 'poor', 'fair']) AS grade")
def concept_quality(spark, sf_dir):
    return A.concept_quality(spark.createDataFrame([("Order", "goods that a customer asks for", 3, 2), ("thing", "short", 0, 1), ("Part", "what is built into a product", 0, 4)], "name string, definition string, evidence int, relations int"))


@register("join_16_blocking", "SELECT count(*) AS n, true AS found FROM (SELECT DISTINCT p_name FROM part)")
def blocking(spark, sf_dir):
    """Names and the same names with a mark behind them meet in a band: all of them are found."""
    names = part(spark, sf_dir).groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("id"))
    names = names.withColumn("name", F.concat_ws(" ", "name", F.md5("name")))
    both = names.select("id", "name").union(names.select((F.col("id") + 1_000_000).alias("id"), F.concat("name", F.lit("."))))
    met = E.candidate_pairs(both, "id", "name").where("b = a + 1000000")
    return met.agg(F.count("*").alias("n")).crossJoin(names.agg(F.count("*").alias("all"))).select("n", (F.col("n") == F.col("all")).alias("found"))


def _values(spark, sf_dir):
    rows = line(spark, sf_dir).select(F.col("l_suppkey").alias("id"), F.col("l_partkey").alias("v"))
    return sketch.minhash(rows.union(rows.select(F.col("id") + 1_000_000, "v")), "id", "v", 64)


@register("skt_03_buckets", "SELECT count(DISTINCT l_suppkey) * 2 * 16 AS n, 16::BIGINT AS bands, count(DISTINCT l_suppkey) * 2 AS items FROM lineitem")
def banded(spark, sf_dir):
    b = sketch.buckets(_values(spark, sf_dir), "id")
    return b.agg(F.count("*").alias("n"), F.count_distinct("band").alias("bands"), F.count_distinct("id").alias("items"))


@register("skt_04_query", "SELECT s_suppkey AS query, unnest([s_suppkey, s_suppkey + 1000000]) AS id, 1.0::DOUBLE AS similarity FROM supplier WHERE s_suppkey % 20 = 0 AND s_suppkey IN (SELECT l_suppkey FROM lineitem)")
def asked(spark, sf_dir):
    s = _values(spark, sf_dir)
    return sketch.ask(s, "id", s.where("id % 20 = 0 and id < 1000000").select(F.col("id").alias("query"), "signature"), 16, 0.99)


@register("skt_09_cardinalities", "SELECT unnest(['l_orderkey', 'l_partkey', 'l_suppkey']) AS \"column\", true AS close")
def cardinalities(spark, sf_dir):
    df, names = line(spark, sf_dir), ["l_orderkey", "l_partkey", "l_suppkey"]
    exact = df.agg(*(F.count_distinct(c).alias(c) for c in names)).select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("n")) for c in names))).alias("x")).select("x.*")
    return sketch.distinct_estimate(df, names).join(exact, "column").select("column", (F.abs(F.col("estimate") - F.col("n")) <= 0.03 * F.col("n") + 1).alias("close"))


@register("skt_10_similar_columns", _INDEX_SQL + "SELECT col_a AS a, col_b AS b FROM o WHERE jaccard >= 0.9")
def similar_columns(spark, sf_dir):
    return sketch.similar_columns(tables_of(spark, sf_dir, _COLS), _COLS, 256, 0.85).select("a", "b")


@register("skt_02_all_pairs_exact", _INDEX_SQL + "SELECT count(*) FILTER (jaccard >= 0.99) AS n FROM o")
def exact_pairs(spark, sf_dir):
    return sketch.similar_columns(tables_of(spark, sf_dir, _COLS), _COLS, 64, 0.99).agg(F.count("*").alias("n"))
