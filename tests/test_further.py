"""Discovery, alignment, forecasting, processes, facts and sketches on cases small enough to work out by hand."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstone.operators import alignment as A
from quillstone.operators import discovery as D
from quillstone.operators import forecasting as M
from quillstone.operators import graph as G
from quillstone.operators import process as C
from quillstone.operators import remediate, search, sketch
from quillstone.operators import timeseries as T
from quillstone.operators import triples as K
from quillstone.sources import readers, writers
from quillstone.streaming import windows as W


def test_arma_finds_the_coefficients_that_made_a_series():
    rng = np.random.default_rng(1)
    e, z = rng.normal(size=4000), np.zeros(4000)
    for k in range(1, 4000):
        z[k] = 1.0 + 0.6 * z[k - 1] + e[k] + 0.3 * e[k - 1]
    beta, _, _ = M.fit_arma(z, 1, 1)
    assert beta == pytest.approx([1.0, 0.6, 0.3], abs=0.08)
    assert M.best_order(np.cumsum(rng.normal(size=600)))[1] == 1


def test_models_on_plain_series():
    line = np.arange(40) * 2.0 + 5
    assert M.arima(line, 3) == pytest.approx([85, 87, 89])
    assert M.auto_arima(line, 3) == pytest.approx([85, 87, 89])
    wave = np.sin(2 * np.pi * np.arange(70) / 7) + 0.1 * np.arange(70)
    ahead = np.sin(2 * np.pi * np.arange(70, 77) / 7) + 0.1 * np.arange(70, 77)
    assert M.seasonal_regression(wave, 7) == pytest.approx(ahead, abs=1e-6)
    assert M.choose(wave - 0.1 * np.arange(70)) == "seasonal_regression" and M.choose(line) == "arima" and M.choose(line[:5]) == "mean"
    assert M.stacked(wave, 7) == pytest.approx(ahead, abs=0.05)  # the model that was right before weighs nearly all
    shop = np.zeros(30)
    shop[[9, 19]] = 10.0
    assert M.seasonal_regression(shop, 3, holidays=(9, 19, 31))[1] - M.seasonal_regression(shop, 3)[1] > 8
    for model in T.MODELS.values():
        assert len(model(np.array([1.0, 2.0, 3.0]), 4)) == 4 and np.isfinite(model(np.ones(30), 2)).all()
    assert M.ensemble(line, 2) == pytest.approx(0.4 * M.arima(line, 2) + 0.6 * M.seasonal_regression(line, 2))
    assert M.kpi(line, 2, 1.1) == pytest.approx(1.1 * (0.6 * T.holt_winters(line, 2) + 0.4 * M.arima(line, 2)))


def test_committee_learns_and_disagrees_where_it_has_seen_nothing(spark):
    rng = np.random.default_rng(2)
    x = rng.random((200, 6))
    y = (x[:, 0] + x[:, 3] > 1).astype(float)
    w = A.fit_committee(x, y)
    df = spark.createDataFrame([(k, k, *map(float, row)) for k, row in enumerate(x)], "a int, b int, " + ", ".join(f"f{k} double" for k in range(6)))
    got = A.committee_scores(df, w).collect()
    assert np.mean([(r.probability >= 0.5) == bool(y[r.a]) for r in got]) > 0.95
    assert all(0 <= r.disagreement <= 1 for r in got)
    assert M and got[0].probability == pytest.approx(np.mean(1 / (1 + np.exp(-(w[:, 0] + w[:, 1:] @ x[got[0].a])))), abs=1e-5)


def test_what_names_say():
    assert D.category("o_orderdate") == "date" and D.category("c_custkey") is None
    assert D.abbreviations([("dept_id", "department_key"), ("a_id", "b_id")]) == [("dept", "department")]
    assert D.synonyms([("client_id", "patron_id"), ("clnt_id", "client_id")]) == [("client", "patron")]
    assert D.reference("note", ["orders"]) is None and D.reference("approved_by_employee_id", ["employees"]) == ("employees", "verb")
    assert A.same_entity("part", "nation") is None
    assert A.concept_conflicts([("Part", "a thing", "object"), ("Nation", "a land", "place")]) == []


def test_evidence_counts_values_once(spark):
    child = spark.createDataFrame([(k, k % 5 if k % 7 else None) for k in range(70)], "child_id long, parent_id long")
    parent = spark.createDataFrame([(k,) for k in range(10)], "parent_id long")
    r = D.evidence({"child": child, "parent": parent}, [("child", "parent_id", "parent", "parent_id", 1.0)]).first()
    assert (r.common, r.jaccard, r.inclusion, r.uniqueness, r.own, r.integrity) == (5, 0.5, 1.0, 1.0, pytest.approx(5 / 60), 1.0)


def test_layers_schedule_writeback_and_stages(spark):
    with pytest.raises(ValueError):
        C.layers({"a": ["b"], "b": ["a"]})
    assert C.schedule({"a": [], "b": ["a"], "c": []}, {"c": 1}) == ["c", "a", "b"]
    df = spark.range(5)
    w = C.Writeback({"t": df})
    actions = [("one", "t", lambda d: d.where("id > 0")), ("bad", "t", lambda d: d.select("none")), ("two", "t", lambda d: d.where("id > 1"))]
    assert w.batch(actions, stop_on_error=True) == 1 and [s for _, _, s in w.log] == ["done", "failed: AnalysisException"]
    w.rollback()
    assert w.tables["t"].count() == 5 and w.log[0][2] == "rolled back"
    tries = []

    def shaky(d):
        tries.append(1)
        if len(tries) < 2:
            raise OSError
        return d

    assert C.Stages([("s", shaky)], retries=1).run(df).count() == 5
    with pytest.raises(ValueError):
        remediate.Remediation(df).apply("x", lambda d: d)


def test_backward_chaining_reads_only_what_leads_to_the_goal(spark):
    facts = spark.createDataFrame([("a", "up", "b"), ("b", "up", "c"), ("x", "near", "y")], "subject string, predicate string, object string")
    up = K.Rule("up", (("?x", "up", "?y"), ("?y", "up", "?z")), ("?x", "up", "?z"))
    near = K.Rule("near", (("?x", "near", "?y"),), ("?y", "near", "?x"))
    got = K.prove(facts, [up, near], ("a", "up", "?x")).collect()
    assert sorted(r.object for r in got) == ["b", "c"]
    assert K.prove(facts, [up, near], ("y", "near", "?x")).count() == 1 and K.prove(facts, [up], ("c", "up", "?x")).count() == 0
    with pytest.raises(ValueError):
        K.Rule("loose", (("?a", "up", "?b"), ("?c", "near", "?d")), ("?a", "near", "?d")).apply(K.with_confidence(facts))


def test_long_lineage_and_chains_go_to_the_end(spark):
    edges = spark.createDataFrame([(f"t.c{k}", f"t.c{k + 1}") for k in range(14)], "source string, target string")
    assert K.lineage(edges, "t.c0").count() == 14
    events = spark.createDataFrame([(f"e{k}", f"e{k - 1}" if k else None) for k in range(12)], "event_id string, cause_id string")
    assert W.chain(events, "e11").count() == 12
    loop = spark.createDataFrame([("a", "b"), ("b", "a")], "event_id string, cause_id string")
    with pytest.raises(RuntimeError):
        W.chain(loop, "a", most=5)


def test_bottleneck_equals_brute_force():
    rng = random.Random(4)

    def brute(x, y):
        n, m = len(x), len(y)
        best = float("inf")
        for perm in itertools.permutations(range(n + m)):
            worst = 0.0
            for i, j in enumerate(perm):
                if i < n and j < m:
                    worst = max(worst, abs(x[i][0] - y[j][0]), abs(x[i][1] - y[j][1]))
                elif i < n or j < m:
                    p = x[i] if i < n else y[j]
                    worst = max(worst, (p[1] - p[0]) / 2)
            best = min(best, worst)
        return best

    for _ in range(15):
        x, y = ([(a := rng.random(), a + rng.random()) for _ in range(rng.randint(0, 3))] for _ in range(2))
        assert G.bottleneck(x, y) == pytest.approx(brute(x, y) if x or y else 0.0)


def test_vector_search_in_blocks_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(130, 6))
    df = spark.createDataFrame([(k, [float(x) for x in row]) for k, row in enumerate(v)], "id long, v array<double>").repartition(4)
    got = {(r.query, r.id) for r in search.nearest(df.where("id % 10 = 0"), df, "id", "v", 3, least=-1.0, block=4).collect()}
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = (unit @ unit.T).round(5)
    np.fill_diagonal(s, -2)
    want = {(k, int(j)) for k in range(0, 130, 10) for j in np.lexsort((np.arange(130), -s[k]))[:3]}
    assert got == want


def test_minhash_estimates_are_near_the_truth(spark):
    rows = [(f"c{k}", str(x)) for k in range(4) for x in range(50 * k, 50 * k + 200)]
    s = {r.key: r.signature for r in sketch.minhash(spark.createDataFrame(rows, "key string, value string"), "key", "value", 256).collect()}
    for k in (1, 2, 3):
        estimate = np.mean([a == b for a, b in zip(s["c0"], s[f"c{k}"], strict=True)])
        assert estimate == pytest.approx((200 - 50 * k) / (200 + 50 * k), abs=0.12)
    asked = spark.createDataFrame([("q", s["c2"])], "query string, signature array<long>")
    found = sketch.ask(spark.createDataFrame(list(s.items()), "key string, signature array<long>"), "key", asked, 128, 0.9).collect()
    assert [(r.query, r.key, r.similarity) for r in found] == [("q", "c2", 1.0)]


def test_a_batch_that_runs_again_changes_nothing(spark, tmp_path):
    sink = writers.UpsertSink(spark, f"file://{tmp_path}/t", ["k"], ["at"])
    one = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")], "k int, at int, v string")
    two = spark.createDataFrame([(2, 5, "d")], "k int, at int, v string")
    sink(one, 0)
    sink(two, 1)
    assert sorted((r.k, r.v) for r in sink.table().collect()) == [(1, "b"), (2, "d")]
    again = writers.UpsertSink(spark, f"file://{tmp_path}/t", ["k"], ["at"])
    again.version = 0
    again(two, 1)
    assert sorted((r.k, r.v) for r in again.table().collect()) == [(1, "b"), (2, "d")]
    with pytest.raises(ValueError):
        readers.instances(one, limit=3)
    with pytest.raises(KeyError):
        readers.find_table(spark, f"file://{tmp_path}", "nowhere")


def test_batches_may_come_in_any_order(spark, tmp_path):
    """src_22: files of a stream are read by their time of writing, which need not be the rows' order."""
    batches = [[(1, 5, "new"), (2, 1, "old"), (None, 4, "n")], [(1, 3, "late"), (2, 2, "new"), (None, 2, "late")], [(1, 4, "late"), (3, 1, "x")]]
    for order in ([0, 1, 2], [2, 1, 0], [1, 2, 0]):
        sink = writers.UpsertSink(spark, f"file://{tmp_path}/t{order[0]}", ["k"], ["at"])
        for number, k in enumerate(order):
            sink(spark.createDataFrame(batches[k], "k int, at int, v string"), number)
        assert sorted(((r.k or 0, r.at, r.v) for r in sink.table().collect())) == [(0, 4, "n"), (1, 5, "new"), (2, 2, "new"), (3, 1, "x")]


def test_windows_that_have_ended(spark):
    w = spark.createDataFrame([(1, 5), (2, 9)], "start int, end int")
    assert [r.start for r in W.expired(w, F.lit(5)).collect()] == [1]


def test_resolution_of_the_parts_finds_nearly_all_pairs(spark):
    import os

    from quillstone.functions.scalars import jaro_winkler_text
    from quillstone.plans import changing

    path = "/root/testdata/sf0.001"
    if not os.path.isdir(path):
        pytest.skip("no test tables here")
    cluster = {r.id: r.cluster for r in changing.resolved(spark, path).collect()}
    names = {r.id: r.name.lower() for r in changing._products(spark, path).collect()}
    alike = [(a, b) for a, b in itertools.combinations(sorted(names), 2) if names[a] == names[b] or jaro_winkler_text(names[a], names[b]) >= 0.98]
    found = [cluster[a] == cluster[b] for a, b in alike]
    assert len(cluster) == len(names) and len(alike) > 10 and np.mean(found) >= 0.9
    # No cluster holds what no chain of alike names joins.
    near = {(a, b) for a, b in alike}
    for c in set(cluster.values()):
        members = [k for k, v in cluster.items() if v == c]
        assert len(members) == 1 or all(any((min(a, b), max(a, b)) in near for b in members if b != a) for a in members)
