"""Conventions on tables small enough to work out by hand."""

import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillstone.functions import distributions as D
from quillstone.functions import naming
from quillstone.functions import scalars as X
from quillstone.operators import fusion as U
from quillstone.operators import graph as G
from quillstone.operators import entities, keys, objects, overlap, quality, remediate, sketch, versioning
from quillstone.operators import timeseries as T
from quillstone.plans import sql as S
from quillstone.sources import readers
from quillstone.streaming import windows as W


@settings(max_examples=100, deadline=None)
@given(st.text("abc ", max_size=8), st.text("abc ", max_size=8))
def test_jaro_winkler_is_a_similarity(a, b):
    s = X.jaro_winkler_text(a, b)
    assert 0 <= s <= 1 + 1e-12 and s == pytest.approx(X.jaro_winkler_text(b, a)) and (s == 1) == (a == b)


def test_jaro_winkler_known_values():
    assert X.jaro_winkler_text("martha", "marhta") == pytest.approx(0.961111, abs=1e-6)
    assert X.jaro_winkler_text("dwayne", "duane") == pytest.approx(0.84, abs=1e-6)


def test_distributions_against_known_values():
    assert D.t_two_sided(2.228139, 10) == pytest.approx(0.05, abs=1e-6)
    assert D.f_upper(4.102821, 2, 10) == pytest.approx(0.05, abs=1e-6)
    assert D.normal_cdf(1.959964) == pytest.approx(0.975, abs=1e-6)
    assert D.incomplete_beta(2, 3, 0.4) == pytest.approx(0.5248, abs=1e-9)


def test_names():
    assert naming.snake("customerOrderID") == "customer_order_id"
    assert naming.base("l_orderkey") == naming.base("o_orderkey") == "order"
    assert naming.base("cust_id") == "customer" == naming.base("buyer_id")
    assert naming.singular("categories") == "category" and naming.singular("status") == "status"
    assert naming.name_similarity("o_custkey", "c_custkey", "customer") > naming.name_similarity("o_custkey", "n_nationkey", "nation")
    assert naming.temporal_kind(["id", "valid_from", "valid_to"]) == "type2" and naming.temporal_kind(["id"]) is None


def test_unknown_operators_raise():
    with pytest.raises(ValueError):
        objects.predicate("x", "$about", 1)
    with pytest.raises(ValueError):
        X.change(None, "double", 2)


def test_sql_errors_are_raised_and_counted(spark):
    runner = S.SqlRunner(spark)
    with pytest.raises(Exception, match="nowhere"):
        runner.execute("select * from nowhere")
    assert runner.execute("select :x as x", {"x": 3}).first().x == 3
    assert runner.statistics()["total"] == 2 and runner.statistics()["succeeded"] == 1


def test_csv_with_comments_above_the_header(spark, tmp_path):
    (tmp_path / "silo").mkdir()
    (tmp_path / "silo" / "people.csv").write_text("# made by hand\nreport of today\nid,name,name\n1,Ann,x\n2,\"B, C\",y\n")
    (tmp_path / "silo" / "sub").mkdir()
    (tmp_path / "silo" / "sub" / "cities.csv").write_text("id,city\n7,Rome\n")
    catalog = readers.Catalog(spark).load_folder(str(tmp_path / "silo"))
    assert sorted(catalog.tables) == ["people", "sub__cities"]
    people = catalog.table("people")
    assert people.columns == ["id", "name", "name_1"] and dict(people.dtypes)["id"] == "bigint"
    assert sorted(tuple(r) for r in people.collect()) == [(1, "Ann", "x"), (2, "B, C", "y")]
    assert spark.sql("select city from sub__cities").first().city == "Rome"
    with pytest.raises(KeyError):
        catalog.table("nothing")


def test_encodings():
    assert readers.detect_encoding("한글".encode("cp949")) == "cp949"
    assert readers.detect_encoding(b"\xef\xbb\xbfa") == "utf-8-sig" and readers.detect_encoding("é".encode()[:1] + b"") in ("utf-8", "latin-1")


def test_outlier_conventions(spark):
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate([5, 6, 7, 8, 5, 6, 7, 8, 5, 6, 7, 8, 100])] + [(99, None)], "id long, v double")
    assert [r.id for r in quality.z_outliers(df, "v").collect()] == [12]
    assert [r.id for r in quality.iqr_outliers(df, "v").collect()] == [12]
    assert [r.id for r in quality.order_iqr_outliers(df, "v").collect()] == [12]
    same = spark.createDataFrame([(i, 5.0) for i in range(20)], "id long, v double")
    assert quality.z_outliers(same, "v").count() == 0


def test_isolation_forest_ranks_a_far_point_first():
    rng = np.random.default_rng(0)
    values = np.r_[rng.normal(size=(300, 2)), [[9.0, 9.0]]]
    assert quality.IsolationForest(50).fit(values).score(values).argmax() == 300


def test_shapes_and_nulls(spark):
    df = spark.createDataFrame([(1, "a@b.co", 5), (2, None, -1), (3, "bad", None)], "id long, email string, n int")
    shape = quality.Shape("s", (("email", "min_count", 1), ("email", "pattern", r"[^@]+@[^@]+\.[a-z]+$"), ("n", "min_inclusive", 0)))
    assert sorted((r.id, r.column, r.constraint) for r in quality.violations(df, shape, "id").collect()) == [(2, "email", "min_count"), (2, "n", "min_inclusive"), (3, "email", "pattern")]


def test_remediation_leaves_no_gap(spark):
    df = spark.createDataFrame([(1, 2.0, "x"), (2, None, ""), (3, 4.0, "x"), (3, 4.0, "x")], "id long, v double, s string")
    fixed, done = remediate.remediate(df)
    got = sorted(tuple(r) for r in fixed.collect())
    assert len(got) == 3 and all(v is not None and s for _, v, s in got) and ("duplicate", "*", "deduplicate") in done


def test_fuzzy_join_equals_all_pairs(spark):
    rng = random.Random(3)
    a = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 9))) for _ in range(80)]
    b = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 9))) for _ in range(80)]

    def lev(x, y):
        row = list(range(len(y) + 1))
        for i, p in enumerate(x, 1):
            row, old = [i], row
            for j, q in enumerate(y, 1):
                row.append(min(row[-1] + 1, old[j] + 1, old[j - 1] + (p != q)))
        return row[-1]

    for limit in (0.6, 0.8, 1.0):
        got = overlap.fuzzy_matches(spark.createDataFrame([(x,) for x in a], "value string"), spark.createDataFrame([(x,) for x in b], "value string"), limit).collect()
        want = {(x, y) for x in set(a) for y in set(b) if 1 - lev(x, y) / max(len(x), len(y)) >= limit}
        assert {(r.a, r.b) for r in got} == want


def test_minhash_estimates_jaccard(spark):
    sets = {1: range(0, 200), 2: range(20, 220), 3: range(1000, 1100), 4: range(0, 200)}
    rows = [(k, str(v)) for k, vs in sets.items() for v in vs]
    found = sketch.similar_pairs(sketch.minhash(spark.createDataFrame(rows, "k long, v string"), "k", "v"), "k", 32, 0.5).collect()
    assert {(r.a, r.b) for r in found} == {(1, 2), (1, 4)}
    assert abs(next(r.similarity for r in found if r.b == 2) - 180 / 220) < 0.15


def test_components_and_triangles(spark):
    rng = random.Random(1)
    edges = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(55)]
    df = spark.createDataFrame(edges, "a long, b long")
    root = {n: n for e in edges for n in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    assert {(r.node, r.component) for r in G.components(df).collect()} == {(n, find(n)) for n in root}
    pairs = {(min(e), max(e)) for e in edges if e[0] != e[1]}
    nodes = sorted(root)
    n = sum((a, b) in pairs and (b, c) in pairs and (a, c) in pairs for i, a in enumerate(nodes) for j, b in enumerate(nodes[i:], i) for c in nodes[j:])
    assert G.triangles(df).first().triangles == n


def test_bridges_and_betweenness_of_a_path():
    g = G.SchemaGraph([("a", "b"), ("b", "c"), ("c", "d"), ("b", "d")])
    assert g.bridges() == [("a", "b")] and g.betweenness()["b"] == 2.0 and g.shortest("a", "c") == ["a", "b", "c"]


def test_holt_winters_follows_a_line():
    assert np.allclose(T.holt_winters(np.arange(1.0, 8.0), 3), [8, 9, 10])
    assert np.allclose(T.autoregressive(np.arange(10.0), 2), [10, 11])


def test_dempster():
    fk, no = frozenset({"fk"}), frozenset({"no"})
    m = U.combine({fk: 0.6, no: 0.2, fk | no: 0.2}, {fk: 0.6, no: 0.2, fk | no: 0.2})
    assert sum(m.values()) == pytest.approx(1) and U.belief(m, fk) <= U.plausibility(m, fk)
    with pytest.raises(ValueError):
        U.combine({fk: 1.0}, {no: 1.0})


def test_repository_branches_and_merge(spark, tmp_path):
    base = spark.createDataFrame([(1, "a", 1), (2, "b", 2), (3, "c", 3)], "id long, s string, n long")
    repo = versioning.Repository(spark, f"file://{tmp_path}/repo")
    repo.commit("base", {"t": base})
    repo.create_branch("work")
    repo.switch("work")
    repo.commit("work", {"t": base.where("id <> 3").withColumn("s", F.when(F.col("id") == 1, "A").otherwise(F.col("s")))})
    repo.switch("main")
    repo.commit("main", {"t": base.withColumn("n", F.col("n") * 10)})
    version, conflicts = repo.merge("work", "main", {"t": ["id"]})
    got = sorted(tuple(r) for r in repo.checkout(version)["t"].collect())
    assert got == [(1, "A", 10), (2, "b", 20), (3, "c", 30)] and conflicts == {"t": 1}
    assert [e["message"] for e in repo.history()] == ["merge", "main", "base"]


def test_merge_is_symmetric_without_conflicts(spark):
    base = spark.createDataFrame([(i, i, i) for i in range(10)], "k long, x long, y long")
    s, t = base.withColumn("x", F.col("x") + 1), base.withColumn("y", F.col("y") + 1)
    a = versioning.merge3(base, s, t, ["k"]).collect()
    b = versioning.merge3(base, t, s, ["k"]).collect()
    assert sorted(a) == sorted(b) and all(r.conflicts == "" and r.x == r.k + 1 == r.y for r in a)


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i, i % 3, float((i * 37) % 50), f"2024-01-01 00:{i // 60:02d}:{i % 60:02d}") for i in range(600)]
    df = spark.createDataFrame(rows, "event_id long, user_id long, value double, t string").select("event_id", "user_id", "value", F.to_timestamp("t").alias("ts"), F.lit("e").alias("event_type"))
    df.repartitionByRange(4, "ts").write.parquet(f"{tmp_path}/in")
    batch = W.tumbling(spark.read.parquet(f"{tmp_path}/in"), "1 minute")
    out = W.run_to_end(W.tumbling(readers.stream_parquet(spark, f"{tmp_path}/in"), "1 minute"), "windows_test", f"file://{tmp_path}/c", "complete")
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, batch.collect()))


def test_wildcards():
    import re

    assert re.match(X.wildcard("order.*"), "order.new") and not re.match(X.wildcard("order.*"), "order.new.one") and re.match(X.wildcard("*"), "a.b.c")


def test_cash_flow_and_rate():
    from quillstone.operators.stats import internal_rate

    r = internal_rate([-1000, 500, 500, 500])
    assert math.isclose(sum(f / (1 + r) ** k for k, f in enumerate([-1000, 500, 500, 500])), 0, abs_tol=1e-6) and internal_rate([1, 1]) is None


def test_rounds_go_on_until_nothing_changes(spark):
    chain = spark.createDataFrame([(k, k + 1) for k in range(14)], "a long, b long")
    source = spark.createDataFrame([(0,)], "source long")
    assert {r.node: r.distance for r in G.distances(chain, source).collect()} == {k: k for k in range(15)}
    assert G.closeness(chain, source).first().closeness == pytest.approx(14 / sum(range(15)), abs=1e-6)
    with pytest.raises(RuntimeError):
        G.distances(chain, source, 3)
    steps = [(f"a{k:02}", f"b{k:02}", 1 - k / 100) for k in range(23)] + [(f"a{k + 1:02}", f"b{k:02}", 1 - k / 100 - 0.005) for k in range(22)]
    got = entities.greedy_one_to_one(spark.createDataFrame(steps, "a string, b string, score double")).collect()
    assert sorted((r.a, r.b) for r in got) == [(f"a{k:02}", f"b{k:02}") for k in range(23)]
    deep = [(k, k - 1 if k else None) for k in range(150)] + [(500, 501), (501, 500), (502, 501)]
    got = {r.node: (r.root, r.depth) for r in keys.hierarchy(spark, spark.createDataFrame(deep, "c long, p long"), "c", "p").collect()}
    assert got == {**{k: (0, k) for k in range(150)}, **dict.fromkeys((500, 501, 502), (None, None))}


def test_quantiles_are_exact_however_few_values_are_gathered(spark):
    import numpy as np

    from quillstone.operators import quantiles as Qn

    rng = np.random.default_rng(7)
    a, b = rng.normal(size=3000).round(3), np.r_[np.zeros(2500), rng.integers(0, 5, 500)]
    df = spark.createDataFrame([(float(x), float(y), None) for x, y in zip(a, b, strict=True)], "a double, b double, c double").repartition(3)
    ps = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]
    for gather in (10**6, 50, 1):
        got = Qn.quantiles(df, ["a", "b", "c"], ps, gather)
        assert np.allclose(got["a"], np.quantile(a, ps)) and np.allclose(got["b"], np.quantile(b, ps)) and got["c"] == [None] * len(ps)
        ranks = Qn.order_statistics(df, {"a": (F.col("a"), [0, 7, 2999])}, interpolate=False, gather=gather)["a"]
        assert ranks == [float(np.sort(a)[k]) for k in (0, 7, 2999)]


def test_fuzzy_matches_equal_brute_force(spark):
    import random

    from quillstone.operators.overlap import fuzzy_matches

    rng = random.Random(3)

    def far(a, b):
        last = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            now = [i]
            for j, y in enumerate(b, 1):
                now.append(min(now[-1] + 1, last[j] + 1, last[j - 1] + (x != y)))
            last = now
        return last[-1]

    words = {"".join(rng.choice("ab") for _ in range(rng.randint(1, 9))) for _ in range(80)} | {"ab" * 20, "ab" * 19 + "a", "ba" * 20, "ab" * 15 + "xyz" + "ab" * 5}
    for limit in (0.6, 0.75, 0.9):
        df = spark.createDataFrame([(w,) for w in words], "value string").repartition(2)
        got = {(r.a, r.b) for r in fuzzy_matches(df, df, limit, below=True).collect()}
        want = {(a, b) for a in words for b in words if a < b and 1 - far(a, b) / max(len(a), len(b)) >= limit - 1e-9}
        assert got == want


def test_closeness_of_sources_in_several_blocks(spark, monkeypatch):
    """gr_14: one row of a node holds 64 sources here; every source counts over the whole graph."""
    monkeypatch.setattr(G, "_WORDS", 1)
    links = [(k, (7 * k + 3) % 90) for k in range(90)] + [(k, k // 2) for k in range(1, 90)] + [(200, 201)]
    near = {}
    for a, b in links:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    want, sources = {}, [*range(80), 200, 999]
    for s in sources:
        reached, front, k = {s: 0}, [s], 0
        while front:
            k += 1
            front = [y for y in {y for x in front for y in near.get(x, ())} if y not in reached]
            reached.update(dict.fromkeys(front, k))
        if len(reached) > 1:
            want[s] = round((len(reached) - 1) / sum(reached.values()), 6)
    got = G.closeness(spark.createDataFrame(links, "a long, b long"), spark.createDataFrame([(s,) for s in [*sources, 5]], "source long"))
    assert {r.node: r.closeness for r in got.collect()} == want


def test_statistics_come_from_value_counts(spark, monkeypatch):
    """agg_09: quartiles take no passes of their own over the table; columns of one value, of none and of repeats."""
    from quillstone.operators import profile as P
    from quillstone.operators import quantiles as Q

    monkeypatch.setattr(Q, "order_statistics", None)
    rows = [(float(k % 7), k * 0.5 if k % 3 else None, None, 4) for k in range(1, 101)]
    got = {r.column: r for r in P.numeric_statistics(spark.createDataFrame(rows, "a double, b double, c double, d int").repartition(3)).collect()}
    for c, i in (("a", 0), ("b", 1), ("d", 3)):
        x = np.array([r[i] for r in rows if r[i] is not None], float)
        want = [len(x), x.sum(), x.mean(), x.std(ddof=1), x.min(), x.max(), *np.quantile(x, [0.25, 0.5, 0.75]), len(set(x.tolist()))]
        assert list(got[c])[1:] == pytest.approx(want, abs=1e-4)
    assert list(got["c"])[1:] == [0, *[None] * 8, 0]
