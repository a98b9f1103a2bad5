"""Queries over graphs, vectors, facts and lineage."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstone.operators import graph as G
from quillstone.operators import search
from quillstone.operators import triples as T
from quillstone.plans.linking import tables_of
from quillstone.plans.objects import KEYS, LINKS_SQL
from quillstone.plans.registry import register
from quillstone.sources import writers
from quillstone.storage import read_table

_EDGES = "(SELECT DISTINCT 'p' || l_partkey AS a, 's' || l_suppkey AS b FROM lineitem)"
_U = f"WITH RECURSIVE e AS (SELECT a, b FROM {_EDGES} UNION SELECT b, a FROM {_EDGES}) "
SCHEMA_EDGES = [(k.from_table, k.to_table) for k in KEYS]


def _edges(spark, sf_dir):
    """Parts and the suppliers they came from."""
    return read_table(spark, sf_dir, "lineitem").select(F.concat(F.lit("p"), "l_partkey").alias("a"), F.concat(F.lit("s"), "l_suppkey").alias("b")).distinct()


def _groups(spark, sf_dir):
    """Orders and their customers: a component for each customer that has orders."""
    return read_table(spark, sf_dir, "orders").select(F.concat(F.lit("o"), "o_orderkey").alias("a"), F.concat(F.lit("c"), "o_custkey").alias("b"))


@register("gr_02_components", "SELECT 'o' || o_orderkey AS node, 'c' || o_custkey AS component FROM orders UNION ALL SELECT DISTINCT 'c' || o_custkey, 'c' || o_custkey FROM orders")
def components(spark, sf_dir):
    return G.components(_groups(spark, sf_dir))


@register("gr_03_bridges", "SELECT 'lineitem' AS a, 'part' AS b UNION ALL SELECT 'nation', 'region'")
def bridges(spark, sf_dir):
    return spark.createDataFrame(G.SchemaGraph(SCHEMA_EDGES).bridges(), "a string, b string")


@register("gr_04_shortest_path", "SELECT 'lineitem > supplier > nation > region' AS path")
def shortest(spark, sf_dir):
    return spark.createDataFrame([(" > ".join(G.SchemaGraph(SCHEMA_EDGES).shortest("lineitem", "region")),)], "path string")


@register("gr_05_all_paths", "SELECT unnest(['customer > nation > supplier', 'customer > orders > lineitem > supplier']) AS path")
def all_paths(spark, sf_dir):
    return spark.createDataFrame([(" > ".join(p),) for p in G.SchemaGraph(SCHEMA_EDGES).all_paths("customer", "supplier")], "path string")


@register("gr_07_density", _U + "SELECT count(DISTINCT a) AS nodes, count(*) // 2 AS edges, round(count(*) / (count(DISTINCT a) * (count(DISTINCT a) - 1)), 6) AS density FROM e")
def density(spark, sf_dir):
    return G.density(_edges(spark, sf_dir))


@register("gr_11_degree", _U + "SELECT a AS node, count(*) AS degree FROM e GROUP BY 1")
def degree(spark, sf_dir):
    return G.degree(_edges(spark, sf_dir))


@register("gr_12_pagerank", _U + ", g AS (SELECT a, b, count(*) OVER (PARTITION BY a) AS d FROM e), n AS (SELECT count(DISTINCT a)::DOUBLE AS n FROM e), r AS (SELECT 0 AS k, a AS node, 1 / n AS rank FROM (SELECT DISTINCT a FROM e), n UNION ALL SELECT any_value(r.k) + 1, g.b, any_value(0.15 / n) + 0.85 * sum(rank / d) FROM r JOIN g ON g.a = r.node, n WHERE r.k < 20 GROUP BY g.b) SELECT node, round(rank, 6) AS rank FROM r WHERE k = 20")
def pagerank(spark, sf_dir):
    return G.pagerank(_edges(spark, sf_dir)).select("node", F.round("rank", 6).alias("rank"))


@register("gr_15_hits")
def hits(spark, sf_dir):
    found = G.hits(_edges(spark, sf_dir))
    return found.select("node", F.round("hub", 5).alias("hub"), F.round("authority", 5).alias("authority"))


@register("gr_10_label_propagation", _U + ", l AS (SELECT 0 AS k, a AS node, a AS label FROM (SELECT DISTINCT a FROM e) UNION ALL SELECT k + 1, a, label FROM (SELECT l.k, e.a, l.label, count(*) AS n FROM l JOIN e ON e.b = l.node WHERE l.k < 4 GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY a ORDER BY n DESC, label) = 1) SELECT node, label FROM l WHERE k = 4")
def labels(spark, sf_dir):
    return G.label_propagation(_edges(spark, sf_dir), 4)


@register("gr_10_modularity", "SELECT round(1 - sum(n * n) / sum(n) ** 2, 6) AS modularity FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey)")
def modularity(spark, sf_dir):
    e = _groups(spark, sf_dir)
    return G.modularity(e, G.components(e).withColumnRenamed("component", "label"))


@register("gr_10_louvain")
def louvain(spark, sf_dir):
    return spark.createDataFrame(sorted(G.SchemaGraph(SCHEMA_EDGES).louvain().items()), "node string, community string")


@register("gr_13_betweenness", f"WITH RECURSIVE {LINKS_SQL}, e AS (SELECT a, b FROM k UNION SELECT b, a FROM k), p AS (SELECT a, b, [a, b] AS path FROM e UNION ALL SELECT p.a, e.b, list_append(path, e.b) FROM p JOIN e ON p.b = e.a WHERE NOT list_contains(path, e.b)), s AS (SELECT * FROM p QUALIFY len(path) = min(len(path)) OVER (PARTITION BY a, b)), w AS (SELECT path, 1 / count(*) OVER (PARTITION BY a, b) AS w FROM s), n AS (SELECT unnest(path[2:len(path) - 1]) AS node, w FROM w) SELECT t.node, coalesce(sum(w) / 2, 0)::DOUBLE AS score FROM (SELECT DISTINCT a AS node FROM e) AS t LEFT JOIN n USING (node) GROUP BY 1")
def betweenness(spark, sf_dir):
    return spark.createDataFrame(sorted(G.SchemaGraph(SCHEMA_EDGES).betweenness().items()), "node string, score double")


@register("gr_14_closeness", _U + ", d AS (SELECT 's' || s_suppkey AS source, 's' || s_suppkey AS node, 0 AS k FROM supplier WHERE s_suppkey % 20 = 0 UNION SELECT d.source, e.b, d.k + 1 FROM d JOIN e ON e.a = d.node WHERE d.k < 8), m AS (SELECT source, node, min(k) AS k FROM d GROUP BY 1, 2) SELECT source AS node, round(count(*) / sum(k), 6) AS closeness FROM m WHERE k > 0 GROUP BY 1")
def closeness(spark, sf_dir):
    """Of the suppliers whose key is divisible by 20, over the whole graph."""
    asked = read_table(spark, sf_dir, "supplier").where("s_suppkey % 20 = 0").select(F.concat(F.lit("s"), "s_suppkey").alias("source"))
    return G.closeness(_edges(spark, sf_dir), asked)


def _returned(spark, sf_dir, flag):
    return read_table(spark, sf_dir, "lineitem").where(F.col("l_returnflag") == flag).select(F.concat(F.lit("p"), "l_partkey").alias("a"), F.concat(F.lit("s"), "l_suppkey").alias("b")).distinct()


def _returned_sql(flag):
    return f"SELECT DISTINCT l_partkey AS a, l_suppkey AS b FROM lineitem WHERE l_returnflag = '{flag}'"


@register("gr_16_graph_similarity", f"WITH x AS ({_returned_sql('R')}), y AS ({_returned_sql('A')}) SELECT round((SELECT count(*) FROM (SELECT * FROM x INTERSECT SELECT * FROM y)) / (SELECT count(*) FROM (SELECT * FROM x UNION SELECT * FROM y)), 6) AS jaccard")
def similarity(spark, sf_dir):
    return G.graph_similarity(_returned(spark, sf_dir, "R"), _returned(spark, sf_dir, "A"))


@register("gr_18_coexistence", "SELECT 'doc_id' AS a, 'lang' AS b, round(avg((doc_id IS NOT NULL AND lang IS NOT NULL)::INT), 6) AS share FROM documents UNION ALL SELECT 'doc_id', 'source', round(avg((doc_id IS NOT NULL AND source IS NOT NULL)::INT), 6) FROM documents UNION ALL SELECT 'lang', 'source', round(avg((lang IS NOT NULL AND source IS NOT NULL)::INT), 6) FROM documents")
def coexistence(spark, sf_dir):
    return G.coexistence(read_table(spark, sf_dir, "documents"), ["doc_id", "lang", "source"])


def _ring(spark, sf_dir):
    n = read_table(spark, sf_dir, "nation")
    return n.select(F.col("n_nationkey").alias("a"), F.col("n_regionkey").alias("b")).union(n.select("n_nationkey", ((F.col("n_nationkey") + 1) % 25).alias("b")))


_RING = "(SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b FROM (SELECT n_nationkey AS a, n_regionkey AS b FROM nation UNION SELECT n_nationkey, (n_nationkey + 1) % 25 FROM nation) WHERE a <> b)"


@register("gr_19_betti", f"WITH e AS (SELECT * FROM {_RING}) SELECT 1::BIGINT AS b0, (SELECT count(*) FROM e) - 25 + 1 AS b1, (SELECT count(*) // 4 FROM e x JOIN e y ON x.b = y.a JOIN e z ON z.a = x.a AND z.b = y.b) AS b2")
def betti(spark, sf_dir):
    return G.betti(_ring(spark, sf_dir))


@register("gr_20_persistence")
def persistence(spark, sf_dir):
    graph = G.SchemaGraph(SCHEMA_EDGES)
    found = graph.persistence({e: 0.5 + 0.05 * k for k, e in enumerate(SCHEMA_EDGES)})
    return spark.createDataFrame(found, "birth double, death double")


@register("gr_09_embedding")
def embedding(spark, sf_dir):
    made = G.SchemaGraph(SCHEMA_EDGES).embedding()
    return spark.createDataFrame([(n, [float(x) for x in v]) for n, v in made.items()], "node string, vector array<double>")


@register("gr_17_similar_nodes")
def similar_nodes(spark, sf_dir):
    return search.similar_to(embedding(spark, sf_dir), "node", "vector", "orders", 3)


_COS = "list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"


@register("gr_25_find_similar", f"SELECT b.vec_id, round({_COS}, 6) AS score FROM embeddings a, embeddings b WHERE a.vec_id = 3 AND b.vec_id <> 3 ORDER BY round({_COS}, 6) DESC, b.vec_id LIMIT 5")
def find_similar(spark, sf_dir):
    return search.similar_to(read_table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 3)


@register("gr_24_semantic_search", f"SELECT b.vec_id, round({_COS}, 6) AS score FROM embeddings a, embeddings b WHERE a.vec_id = 3 AND b.vec_id <> 3 AND b.label = 1 ORDER BY round({_COS}, 6) DESC, b.vec_id LIMIT 10")
def semantic(spark, sf_dir):
    return search.similar_to(read_table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 3, 10, F.col("label") == 1)


@register("join_15_nearest", f"SELECT a.vec_id AS query, b.vec_id, round({_COS}, 5) AS score FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0 QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY round({_COS}, 5) DESC, b.vec_id) <= 3")
def nearest(spark, sf_dir):
    e = read_table(spark, sf_dir, "embeddings")
    return search.nearest(e.where("vec_id % 20 = 0"), e, "vec_id", "embedding", 3)


@register("gr_23_text_search", "SELECT p_partkey, (contains(t, 'ring'))::INT + (contains(t, 'economy'))::INT AS score FROM (SELECT p_partkey, lower(p_name || ' ' || p_type) AS t FROM part) WHERE contains(t, 'ring') OR contains(t, 'economy') ORDER BY 2 DESC, 1 LIMIT 10")
def text(spark, sf_dir):
    return search.text_search(read_table(spark, sf_dir, "part"), "p_partkey", ["p_name", "p_type"], ["ring", "economy"])


# Facts: nations, regions and customers.


def _facts(spark, sf_dir):
    n, r = read_table(spark, sf_dir, "nation"), read_table(spark, sf_dir, "region")
    part_of = n.select(F.concat(F.lit("n:"), "n_nationkey").alias("subject"), F.lit("partOf").alias("predicate"), F.concat(F.lit("r:"), "n_regionkey").alias("object"))
    world = r.select(F.concat(F.lit("r:"), "r_regionkey"), F.lit("partOf"), F.lit("world"))
    kinds = n.select(F.concat(F.lit("n:"), "n_nationkey"), F.lit("rdf:type"), F.lit("Nation"))
    schema = spark.createDataFrame([("partOf", "rdf:type", "owl:TransitiveProperty"), ("Nation", "rdfs:subClassOf", "Place"), ("Place", "rdfs:subClassOf", "Thing"), ("partOf", "owl:inverseOf", "hasPart"), ("partOf", "rdfs:domain", "Place"), ("near", "rdf:type", "owl:SymmetricProperty"), ("n:1", "near", "n:2")], "subject string, predicate string, object string")
    return part_of.union(world).union(kinds).union(schema)


@register("kb_01_pattern", "SELECT 'n:' || n_nationkey AS subject, 'partOf' AS predicate, 'r:1' AS object FROM nation WHERE n_regionkey = 1")
def patterns(spark, sf_dir):
    return T.pattern(_facts(spark, sf_dir), "?x", "partOf", "r:1")


@register("kb_04_rdfs", "SELECT 'n:' || n_nationkey AS subject, c AS object FROM nation, (SELECT unnest(['Nation', 'Place', 'Thing']) AS c) UNION SELECT 'r:' || r_regionkey, c FROM region, (SELECT unnest(['Place', 'Thing']) AS c)")
def rdfs(spark, sf_dir):
    found = T.infer(_facts(spark, sf_dir), T.RDFS)
    return T.pattern(found, None, "rdf:type", None).where("object not like 'owl:%'").select("subject", "object")


@register("kb_05_owl", "SELECT 'n:' || n_nationkey AS subject, 'partOf' AS predicate, 'world' AS object, 0.85::DOUBLE AS confidence FROM nation UNION ALL SELECT 'n:2', 'near', 'n:1', 1.0")
def owl(spark, sf_dir):
    found = T.infer(_facts(spark, sf_dir), T.OWL)
    return found.where("rule in ('transitive', 'symmetric') and predicate in ('partOf', 'near')").select("subject", "predicate", "object", "confidence")


@register("kb_09_property_chain", "SELECT 'n:' || n_nationkey AS subject, 'world' AS object, 0.9::DOUBLE AS confidence FROM nation")
def chain(spark, sf_dir):
    found = T.infer(_facts(spark, sf_dir), [T.chain(["partOf", "partOf"], "inWorld")])
    return T.pattern(found, None, "inWorld", None).select("subject", "object", "confidence")


@register("kb_07_closure", "SELECT 'n:' || n_nationkey AS subject, unnest(['r:' || n_regionkey, 'world']) AS object FROM nation UNION SELECT 'r:' || r_regionkey, 'world' FROM region")
def closure(spark, sf_dir):
    return T.closure(_facts(spark, sf_dir), "partOf")


@register("kb_08_inverse", "SELECT 'r:' || n_regionkey AS subject, 'n:' || n_nationkey AS object FROM nation UNION SELECT 'world', 'r:' || r_regionkey FROM region")
def inverse(spark, sf_dir):
    found = T.infer(_facts(spark, sf_dir), [r for r in T.OWL if r.name == "inverse"])
    return T.pattern(found, None, "hasPart", None).select("subject", "object")


def _sold(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders")
    return o.select(F.concat(F.lit("o:"), "o_orderkey").alias("subject"), F.lit("by").alias("predicate"), F.concat(F.lit("c:"), "o_custkey").alias("object"))


@register("kb_10_cardinality", "SELECT 'c:' || c_custkey AS subject, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey HAVING count(o_orderkey) < 8 OR count(o_orderkey) > 12")
def cardinality(spark, sf_dir):
    c = read_table(spark, sf_dir, "customer")
    kinds = c.select(F.concat(F.lit("c:"), "c_custkey").alias("subject"), F.lit("rdf:type").alias("predicate"), F.lit("Customer").alias("object"))
    placed = _sold(spark, sf_dir).select(F.col("object").alias("subject"), F.lit("placed").alias("predicate"), F.col("subject").alias("object"))
    return T.cardinality_violations(kinds.union(placed), "Customer", "placed", 8, 12)


@register("kb_11_functional", "SELECT 'c:' || o_custkey AS subject, 'placed' AS predicate, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 1")
def functional(spark, sf_dir):
    placed = _sold(spark, sf_dir).select(F.col("object").alias("subject"), F.lit("placed").alias("predicate"), F.col("subject").alias("object"))
    rule = spark.createDataFrame([("placed", "rdf:type", "owl:FunctionalProperty")], placed.schema)
    return T.functional_violations(placed.union(rule))


@register("kb_11_disjoint", "SELECT 'n:' || n_nationkey AS member, 'Nation' AS a, 'Small' AS b FROM nation WHERE n_nationkey < 3")
def disjoint(spark, sf_dir):
    small = read_table(spark, sf_dir, "nation").where("n_nationkey < 3").select(F.concat(F.lit("n:"), "n_nationkey").alias("subject"), F.lit("rdf:type").alias("predicate"), F.lit("Small").alias("object"))
    rule = spark.createDataFrame([("Nation", "owl:disjointWith", "Small")], small.schema)
    return T.disjoint_violations(_facts(spark, sf_dir).union(small).union(rule))


@register("kb_11_types", "SELECT 'r:' || r_regionkey AS member, 'partOf' AS predicate, 'Place' AS c, 'domain' AS kind FROM region")
def types(spark, sf_dir):
    return T.type_violations(_facts(spark, sf_dir))


@register("kb_11_cycles", "SELECT unnest(['a', 'b', 'c']) AS subject")
def cycles(spark, sf_dir):
    loop = spark.createDataFrame([("a", "up", "b"), ("b", "up", "c"), ("c", "up", "a"), ("x", "up", "a")], "subject string, predicate string, object string")
    return T.cycles(loop, "up")


@register("kb_12_completeness", "SELECT 'n:' || n_nationkey AS subject, 'name' AS predicate FROM nation")
def completeness(spark, sf_dir):
    return T.missing_properties(_facts(spark, sf_dir), {"Nation": ["name", "partOf"]})


@register("kb_14_schema", "SELECT 2::BIGINT AS classes, 3 + 2 AS properties")
def schema(spark, sf_dir):
    found = T.of_schema(spark, tables_of(spark, sf_dir, ("nation", "region")), [k for k in KEYS if k.from_table == "nation"])
    kinds = found.where("predicate = 'rdf:type'")
    return kinds.agg(F.count_if(F.col("object") == "owl:Class").alias("classes"), F.count_if(F.col("object") == "owl:DatatypeProperty").cast("int").alias("properties"))


@register("kb_15_row_facts", "SELECT 'ex:region/' || r_regionkey AS subject, unnest(['rdf:type', 'name']) AS predicate, unnest(['ex:region', r_name]) AS object FROM region")
def row_facts(spark, sf_dir):
    return T.of_rows(read_table(spark, sf_dir, "region"), "r_regionkey", "region", {"r_name": "name"})


@register("kb_17_statistics", "SELECT 25 + 5 + 25 + 7 AS facts, 25 + 5 + 4 AS subjects")
def statistics(spark, sf_dir):
    return T.graph_statistics(_facts(spark, sf_dir)).select(F.col("facts").cast("int").alias("facts"), F.col("subjects").cast("int").alias("subjects"))


def _lineage(spark):
    return spark.createDataFrame([(f"{k.to_table}.{k.to_column}", f"{k.from_table}.{k.from_column}") for k in KEYS] + [("orders.o_custkey", "report.customer"), ("nation.n_regionkey", "report.region"), ("report.customer", "board.customers")], "source string, target string")


@register("kb_19_downstream", "SELECT unnest(['orders.o_custkey', 'report.customer', 'board.customers']) AS node, unnest([1, 2, 3]) AS depth")
def downstream(spark, sf_dir):
    return T.lineage(_lineage(spark), "customer.c_custkey")


@register("kb_19_upstream", "SELECT unnest(['report.customer', 'orders.o_custkey', 'customer.c_custkey']) AS node, unnest([1, 2, 3]) AS depth")
def upstream(spark, sf_dir):
    return T.lineage(_lineage(spark), "board.customers", downstream=False)


@register("kb_20_impact", "SELECT 3::BIGINT AS columns, 3::BIGINT AS tables, 3 AS depth")
def impact(spark, sf_dir):
    return T.impact(_lineage(spark), "customer.c_custkey")


_PREFIXES = {"ex": "http://example.org/", "rdf": "http://www.w3.org/1999/02/22-rdf-syntax-ns#"}


@register("src_25_ntriples", "SELECT '<http://example.org/region/' || r_regionkey || '> <http://example.org/name> \"' || r_name || '\" .' AS value FROM region")
def ntriples(spark, sf_dir):
    return writers.ntriples(T.of_rows(read_table(spark, sf_dir, "region"), "r_regionkey", "region", {"r_name": "ex:name"}).where("predicate = 'ex:name'"), _PREFIXES)


@register("src_24_turtle", "SELECT 0 AS part, unnest(['@prefix ex: <http://example.org/> .', '@prefix rdf: <http://www.w3.org/1999/02/22-rdf-syntax-ns#> .']) AS value UNION ALL SELECT 1, unnest(['ex:region/' || r_regionkey || ' rdf:type ex:region .', 'ex:region/' || r_regionkey || ' name \"' || r_name || '\" .']) FROM region")
def turtle(spark, sf_dir):
    return writers.turtle(row_facts(spark, sf_dir), _PREFIXES)


@register("src_26_json_ld", "SELECT '{\"@id\":[\"ex:region/' || r_regionkey || '\"],\"name\":[\"' || r_name || '\"],\"rdf:type\":[\"ex:region\"]}' AS value FROM region")
def json_ld(spark, sf_dir):
    return writers.json_ld(row_facts(spark, sf_dir))
