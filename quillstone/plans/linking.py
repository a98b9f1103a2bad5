"""Queries over shared values, keys and sketches."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstone.functions import naming
from quillstone.operators import keys as K
from quillstone.operators import overlap as O
from quillstone.operators import sketch
from quillstone.plans.objects import STAR
from quillstone.plans.registry import register
from quillstone.storage import read_table

_COLS = {"orders": ["o_custkey", "o_orderkey"], "customer": ["c_custkey", "c_nationkey"], "nation": ["n_nationkey", "n_regionkey"], "supplier": ["s_suppkey", "s_nationkey"], "region": ["r_regionkey"]}
_INDEX_SQL = "WITH i AS (" + " UNION ".join(f"SELECT DISTINCT '{t}.{c}' AS col, {c}::VARCHAR AS value FROM {t}" for t, cs in _COLS.items() for c in cs) + "), s AS (SELECT col, count(*) AS size FROM i GROUP BY col), p AS (SELECT a.col AS col_a, b.col AS col_b, count(*) AS common FROM i a JOIN i b ON a.value = b.value AND a.col < b.col AND split_part(a.col, '.', 1) <> split_part(b.col, '.', 1) GROUP BY 1, 2), o AS (SELECT p.*, a.size AS size_a, b.size AS size_b, round(common / (a.size + b.size - common), 6) AS jaccard, round(common / a.size, 6) AS a_in_b, round(common / b.size, 6) AS b_in_a FROM p JOIN s a ON a.col = col_a JOIN s b ON b.col = col_b) "


def tables_of(spark, sf_dir, names=STAR):
    return {t: read_table(spark, sf_dir, t) for t in names}


def _index(spark, sf_dir):
    return O.inverted_index(tables_of(spark, sf_dir, _COLS), _COLS)


@register("join_03_orphans", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def orphans(spark, sf_dir):
    return O.orphans(read_table(spark, sf_dir, "documents"), "doc_id", read_table(spark, sf_dir, "labels"), "doc_id").select("doc_id")


@register("join_04_inclusion", "SELECT count(*) AS n, count(c_custkey) AS found, round(count(c_custkey) / count(*), 6) AS inclusion FROM (SELECT DISTINCT o_custkey FROM orders) LEFT JOIN customer ON o_custkey = c_custkey")
def included(spark, sf_dir):
    return O.inclusion(read_table(spark, sf_dir, "orders"), "o_custkey", read_table(spark, sf_dir, "customer"), "c_custkey")


@register("join_05_value_overlap", _INDEX_SQL + "SELECT * FROM o WHERE col_a = 'customer.c_custkey' AND col_b = 'orders.o_custkey'")
def overlap(spark, sf_dir):
    return O.overlaps(_index(spark, sf_dir)).where("col_a = 'customer.c_custkey' and col_b = 'orders.o_custkey'")


@register("join_06_all_overlaps", _INDEX_SQL + "SELECT * FROM o WHERE jaccard >= 0.1")
def all_overlaps(spark, sf_dir):
    return O.overlaps(_index(spark, sf_dir), min_jaccard=0.1)


@register("join_07_join_keys", _INDEX_SQL + "SELECT *, CASE WHEN a_in_b = 1 AND b_in_a = 1 THEN 'equal' WHEN a_in_b >= 0.95 THEN 'a_in_b' WHEN b_in_a >= 0.95 THEN 'b_in_a' ELSE 'partial' END AS relation, CASE WHEN jaccard >= 0.5 THEN 'strong' WHEN jaccard >= 0.3 THEN 'moderate' ELSE 'weak' END AS strength FROM o WHERE jaccard >= 0.3")
def join_keys(spark, sf_dir):
    return O.relation(O.overlaps(_index(spark, sf_dir), min_jaccard=0.3))


_SIM = "1 - levenshtein(a, b) / greatest(length(a), length(b))"


@register("join_08_fuzzy", f"SELECT a, b, round({_SIM}, 6) AS similarity FROM (SELECT DISTINCT lower(c_name) AS a FROM customer), (SELECT DISTINCT lower(c_name) AS b FROM customer) WHERE a < b AND {_SIM} >= 0.9")
def fuzzy(spark, sf_dir):
    """All customers' names against all others."""
    names = read_table(spark, sf_dir, "customer").select(F.lower("c_name").alias("value"))
    return O.fuzzy_matches(names, names, 0.9, below=True)


@register("join_09_positional", "SELECT c_custkey, s_suppkey, round(c_acctbal + s_acctbal, 2) AS both FROM (SELECT *, row_number() OVER (ORDER BY c_custkey) AS r FROM customer) JOIN (SELECT *, row_number() OVER (ORDER BY s_suppkey) AS r FROM supplier) USING (r)")
def positional(spark, sf_dir):
    both = O.aligned(read_table(spark, sf_dir, "customer"), read_table(spark, sf_dir, "supplier"), ["c_custkey"], ["s_suppkey"])
    return both.select("c_custkey", "s_suppkey", F.round(F.col("c_acctbal") + F.col("s_acctbal"), 2).alias("both"))


@register("join_10_composite_inclusion", "WITH a AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'R'), b AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'A') SELECT count(*) AS n, count(b.l_partkey) AS found, round(count(b.l_partkey) / count(*), 6) AS inclusion FROM a LEFT JOIN b USING (l_partkey, l_suppkey)")
def composite_inclusion(spark, sf_dir):
    line, pair = read_table(spark, sf_dir, "lineitem"), ["l_partkey", "l_suppkey"]
    return O.composite_inclusion(line.where("l_returnflag = 'R'"), pair, line.where("l_returnflag = 'A'"), pair)


@register("win_11_value_sets", "SELECT (SELECT count(*) FROM (SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier)) AS both, (SELECT count(*) FROM (SELECT c_nationkey FROM customer EXCEPT SELECT s_nationkey FROM supplier)) AS only_a, (SELECT count(*) FROM (SELECT c_nationkey FROM customer UNION SELECT s_nationkey FROM supplier)) AS either")
def value_sets(spark, sf_dir):
    a = read_table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"))
    b = read_table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"))
    n = lambda df, name: df.agg(F.count("*").alias(name))
    return n(a.intersect(b), "both").crossJoin(n(a.subtract(b), "only_a")).crossJoin(n(a.union(b).distinct(), "either"))


_KEY_COLUMNS = {"orders": ["o_orderkey", "o_custkey"], "customer": ["c_custkey", "c_nationkey"], "nation": ["n_nationkey", "n_regionkey"], "region": ["r_regionkey"], "supplier": ["s_suppkey", "s_nationkey"], "part": ["p_partkey"], "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]}


def _pair_sql(t, c, u, d):
    return f"SELECT '{t}' AS from_table, '{c}' AS from_column, '{u}' AS to_table, '{d}' AS to_column, (SELECT count(DISTINCT {c}) FROM {t} WHERE {c} IN (SELECT {d} FROM {u})) AS common, (SELECT count(DISTINCT {c}) FROM {t}) AS size_f, (SELECT count(DISTINCT {d}) FROM {u}) AS size_p, (SELECT count(DISTINCT {c}) / count({c}) FROM {t}) AS own, (SELECT count(DISTINCT {d}) / count({d}) FROM {u}) AS uniqueness"


#: All ordered pairs of key columns of the same name behind the table's prefix, with what their values say.
PAIR_SQL = "SELECT *, common / size_f AS inclusion, common / (size_f + size_p - common) AS jaccard FROM (" + " UNION ALL ".join(_pair_sql(t, c, u, d) for t, cs in _KEY_COLUMNS.items() for c in cs for u, ds in _KEY_COLUMNS.items() for d in ds if t != u and c.split("_", 1)[1] == d.split("_", 1)[1]) + ")"
#: The foreign keys among them.
FK_SQL = f"SELECT *, round(0.3325 + 0.45 * inclusion + 0.1 * uniqueness + 0.1, 4) AS score FROM ({PAIR_SQL}) WHERE uniqueness >= 0.99 AND inclusion >= 0.8"
LABEL_SQL = "CASE WHEN score >= 0.9 THEN 'certain' WHEN score >= 0.75 THEN 'high' WHEN score >= 0.6 THEN 'medium' ELSE 'low' END"


@register("fk_01_primary_keys", " UNION ALL ".join(f"SELECT '{t}.{c}' AS col FROM {t} HAVING count(*) > 0 AND count(DISTINCT {c}) = count(*)" for t, cs in _KEY_COLUMNS.items() for c in cs))
def primary(spark, sf_dir):
    return K.primary_keys(tables_of(spark, sf_dir))


@register("fk_05_foreign_keys", f"SELECT from_column, to_column FROM ({FK_SQL})")
def foreign(spark, sf_dir):
    return K.foreign_keys(tables_of(spark, sf_dir)).select("from_column", "to_column")


@register("fk_09_scores", f"SELECT from_table, from_column, to_table, to_column, 0.95::DOUBLE AS name_score, round(inclusion, 6) AS inclusion, round(uniqueness, 6) AS uniqueness, score, {LABEL_SQL} AS confidence FROM ({FK_SQL})")
def scores(spark, sf_dir):
    return K.foreign_keys(tables_of(spark, sf_dir))


@register("fk_20_without_transitive", f"SELECT from_table, from_column, to_table, to_column FROM ({FK_SQL})")
def transitive(spark, sf_dir):
    return K.without_transitive(K.foreign_keys(tables_of(spark, sf_dir))).select("from_table", "from_column", "to_table", "to_column")


@register("fk_13_name_similarity")
def names(spark, sf_dir):
    return spark.createDataFrame(K.candidates(tables_of(spark, sf_dir)), K.FK_SCHEMA)


@register("fk_14_signals", "WITH c AS (SELECT o_custkey AS v, count(*) AS n FROM orders GROUP BY 1), p AS (SELECT c_custkey AS v, count(*) AS m FROM customer GROUP BY 1), t AS (SELECT count(n) AS fk_values, count(m) AS pk_values, count(*) FILTER (n IS NOT NULL AND m IS NOT NULL) AS hits, sum(n) AS fk_rows, sum(m) AS pk_rows, sum(n) FILTER (m IS NOT NULL) AS kept FROM c FULL JOIN p USING (v)), s AS (SELECT round(hits / fk_values, 6) AS overlap, round(pk_values / pk_rows, 6) AS cardinality, round(kept / fk_rows, 6) AS integrity, 0.95::DOUBLE AS naming, 1.0::DOUBLE AS structure FROM t) SELECT *, round(0.25 * overlap + 0.2 * cardinality + 0.25 * integrity + 0.15 * naming + 0.15 * structure, 6) AS score FROM s")
def five_signals(spark, sf_dir):
    return K.signals(read_table(spark, sf_dir, "orders"), "o_custkey", read_table(spark, sf_dir, "customer"), "c_custkey", "orders", "customer")


@register("fk_15_direction", f"SELECT round(0.8 * (uniqueness - own) + 0.7 * (common / size_f - common / size_p) + sign((SELECT count(o_custkey) FROM orders) - (SELECT count(c_custkey) FROM customer)) * 0.5, 6) AS margin, 'a_to_b' AS direction FROM ({PAIR_SQL}) WHERE from_column = 'o_custkey' AND to_column = 'c_custkey'")
def direction(spark, sf_dir):
    return K.direction(read_table(spark, sf_dir, "orders"), "o_custkey", read_table(spark, sf_dir, "customer"), "c_custkey")


@register("fk_18_validation", f"SELECT round(jaccard, 6) AS jaccard, round(inclusion, 6) AS containment FROM ({PAIR_SQL}) WHERE from_column = 'o_custkey' AND to_column = 'c_custkey'")
def validation(spark, sf_dir):
    found = O.overlaps(_index(spark, sf_dir)).where("col_a = 'customer.c_custkey' and col_b = 'orders.o_custkey'")
    return found.select("jaccard", F.col("b_in_a").alias("containment"))


@register("fk_25_composite_foreign_key", "WITH p AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem), m AS (SELECT count(*) AS n, count(q.l_partkey) AS found FROM p LEFT JOIN p AS q USING (l_partkey, l_suppkey)), u AS (SELECT count(DISTINCT (l_partkey, l_suppkey)) / count(*) AS u FROM p) SELECT n, found, round(found / n, 6) AS inclusion, round(u, 6) AS uniqueness, round(0.5 * found / n + 0.3 * u + 0.2, 6) AS score FROM m, u")
def composite_fk(spark, sf_dir):
    line = read_table(spark, sf_dir, "lineitem")
    pairs = line.select("l_partkey", "l_suppkey").distinct()
    return K.composite_foreign_key(line, ["l_partkey", "l_suppkey"], pairs, ["l_partkey", "l_suppkey"])


@register("fk_26_composite_uniqueness", "SELECT count(*) AS n, count(DISTINCT (l_orderkey, l_linenumber)) AS \"distinct\", round(count(DISTINCT (l_orderkey, l_linenumber)) / count(*), 6) AS uniqueness FROM lineitem")
def composite_unique(spark, sf_dir):
    return K.composite_uniqueness(read_table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@register("fk_25_composite_keys", "SELECT columns, size FROM (SELECT 'l_orderkey' AS columns, 1 AS size, count(DISTINCT l_orderkey) = count(*) AS u FROM lineitem UNION ALL SELECT 'l_partkey', 1, count(DISTINCT l_partkey) = count(*) FROM lineitem UNION ALL SELECT 'l_orderkey,l_partkey', 2, count(DISTINCT (l_orderkey, l_partkey)) = count(*) FROM lineitem UNION ALL SELECT 'l_orderkey,l_linenumber', 2, count(DISTINCT (l_orderkey, l_linenumber)) = count(*) FROM lineitem UNION ALL SELECT 'l_orderkey,l_suppkey', 2, count(DISTINCT (l_orderkey, l_suppkey)) = count(*) FROM lineitem UNION ALL SELECT 'l_partkey,l_suppkey', 2, count(DISTINCT (l_partkey, l_suppkey)) = count(*) FROM lineitem UNION ALL SELECT 'l_partkey,l_linenumber', 2, count(DISTINCT (l_partkey, l_linenumber)) = count(*) FROM lineitem UNION ALL SELECT 'l_orderkey,l_partkey,l_suppkey', 3, count(DISTINCT (l_orderkey, l_partkey, l_suppkey)) = count(*) FROM lineitem UNION ALL SELECT 'l_orderkey,l_partkey,l_linenumber', 3, count(DISTINCT (l_orderkey, l_partkey, l_linenumber)) = count(*) FROM lineitem UNION ALL SELECT 'l_orderkey,l_suppkey,l_linenumber', 3, count(DISTINCT (l_orderkey, l_suppkey, l_linenumber)) = count(*) FROM lineitem UNION ALL SELECT 'l_partkey,l_suppkey,l_linenumber', 3, count(DISTINCT (l_partkey, l_suppkey, l_linenumber)) = count(*) FROM lineitem) WHERE u")
def composite(spark, sf_dir):
    return K.composite_keys(read_table(spark, sf_dir, "lineitem"))


_TREE = "WITH RECURSIVE t AS (SELECT event_id AS node, CASE WHEN event_id = 0 THEN NULL ELSE event_id // 3 END AS parent FROM events), r AS (SELECT node, node AS root, 0::BIGINT AS depth FROM t WHERE parent IS NULL UNION ALL SELECT t.node, r.root, r.depth + 1 FROM t JOIN r ON t.parent = r.node) "


def _tree(spark, sf_dir):
    return read_table(spark, sf_dir, "events").select(F.col("event_id").alias("node_id"), F.when(F.col("event_id") != 0, F.floor(F.col("event_id") / 3)).alias("parent_id"))


@register("fk_27_hierarchy_inclusion", "SELECT count(*) AS n, count(e.event_id) AS found, round(count(e.event_id) / count(*), 6) AS inclusion FROM (SELECT DISTINCT event_id // 3 AS p FROM events WHERE event_id <> 0) LEFT JOIN events e ON e.event_id = p")
def hierarchy_inclusion(spark, sf_dir):
    tree = _tree(spark, sf_dir)
    return O.inclusion(tree, "parent_id", tree, "node_id")


@register("fk_28_hierarchy", _TREE + "SELECT node, root, depth FROM r")
def hierarchy(spark, sf_dir):
    return K.hierarchy(spark, _tree(spark, sf_dir), "node_id", "parent_id")


@register("fk_29_temporal", "SELECT unnest(['price_history', 'stock_snapshot', 'users']) AS \"table\", unnest(['type2', 'snapshot', 'type3']) AS kind")
def temporal(spark, sf_dir):
    shapes = {"price_history": ["id", "valid_from", "valid_to"], "stock_snapshot": ["sku", "snapshot_date"], "users": ["id", "previous_email"]}
    return spark.createDataFrame([(t, naming.temporal_kind(c)) for t, c in shapes.items()], "table string, kind string")


@register("fk_30_history_inclusion", "SELECT count(*) AS n, round(count(o_orderkey) / count(*), 6) AS inclusion FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey")
def history(spark, sf_dir):
    return K.row_inclusion(read_table(spark, sf_dir, "lineitem"), "l_orderkey", read_table(spark, sf_dir, "orders"), "o_orderkey")


@register("fk_11_matched_prefix", "SELECT regexp_extract(c_name, '^([A-Za-z#]*)', 1) AS prefix, count(DISTINCT c_name) AS n FROM customer GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1")
def prefix(spark, sf_dir):
    c = read_table(spark, sf_dir, "customer")
    return K.matched_prefix(c, "c_name", c, "c_name")


_FILLED = " UNION ALL ".join(f"SELECT count(*) AS n, count({c}) AS k FROM {t}" for t, cs in _KEY_COLUMNS.items() for c in cs)


@register("fk_06_adaptive_threshold", f"SELECT 0.3 + CASE WHEN share > 0.9 THEN 0.05 WHEN share > 0.7 THEN 0 WHEN share > 0.5 THEN -0.05 ELSE -0.1 END::DOUBLE AS threshold FROM (SELECT sum(k) / sum(n) AS share FROM ({_FILLED}))")
def threshold(spark, sf_dir):
    return spark.range(1).select(F.lit(round(K.adaptive_threshold(tables_of(spark, sf_dir)), 6)).alias("threshold"))


_MAP = "SELECT count(DISTINCT {a}) AS n_a, count(DISTINCT {b}) AS n_b, count(DISTINCT ({a}, {b})) AS n_ab, count(DISTINCT ({a}, {b})) = count(DISTINCT {a}) AS a_determines_b, count(DISTINCT ({a}, {b})) = count(DISTINCT {a}) AND count(DISTINCT {a}) = count(DISTINCT {b}) AND count(DISTINCT {a}) >= 3 AS bijective FROM {t}"


@register("fk_44_mapping", _MAP.format(a="n_nationkey", b="n_name", t="nation"))
def mapping(spark, sf_dir):
    return K.mapping(read_table(spark, sf_dir, "nation"), "n_nationkey", "n_name")


@register("fk_43_value_patterns", "SELECT regexp_replace(regexp_replace(regexp_replace(p_brand, '[a-z]', 'a', 'g'), '[A-Z]', 'A', 'g'), '[0-9]', '9', 'g') AS mask, length(p_brand) AS n_chars, count(*) AS n FROM part GROUP BY ALL")
def value_patterns(spark, sf_dir):
    from quillstone.functions.scalars import structure_mask

    return read_table(spark, sf_dir, "part").groupBy(structure_mask(F.col("p_brand")).alias("mask"), F.length("p_brand").cast("long").alias("n_chars")).agg(F.count("*").alias("n"))


@register("fk_46_integrity", "SELECT count(*) AS orphans FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part)")
def integrity(spark, sf_dir):
    return O.orphans(read_table(spark, sf_dir, "lineitem"), "l_partkey", read_table(spark, sf_dir, "part"), "p_partkey").agg(F.count("*").alias("orphans"))


def _shingles(spark, sf_dir):
    return read_table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array_distinct(F.split(F.lower("text"), r"\s+"))).alias("w"))


@register("skt_01_minhash")
def minhash(spark, sf_dir):
    return sketch.minhash(_shingles(spark, sf_dir), "doc_id", "w", 32).select("doc_id", F.xxhash64("signature").alias("signature"))


@register("skt_05_similar_pairs")
def similar(spark, sf_dir):
    return sketch.similar_pairs(sketch.minhash(_shingles(spark, sf_dir), "doc_id", "w", 64), "doc_id", 16, 0.7)


@register("skt_06_hyperloglog")
def hyperloglog(spark, sf_dir):
    return sketch.distinct_estimate(read_table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_partkey", "l_suppkey"])


@register("skt_07_hll_merge")
def hll_merge(spark, sf_dir):
    return sketch.merged_estimate(read_table(spark, sf_dir, "lineitem"), "l_returnflag", "l_partkey")


@register("skt_08_advanced_similarity", _INDEX_SQL + "SELECT * FROM o WHERE greatest(a_in_b, b_in_a) >= 0.8")
def containment(spark, sf_dir):
    return O.overlaps(_index(spark, sf_dir), min_containment=0.8)


@register("fk_35_value_correlations", _INDEX_SQL + "SELECT * FROM o WHERE jaccard >= 0.3 OR greatest(a_in_b, b_in_a) >= 0.8")
def correlations(spark, sf_dir):
    return O.overlaps(_index(spark, sf_dir), min_jaccard=0.3, min_containment=0.8)
