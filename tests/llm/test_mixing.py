import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillstone.llm import mixing


@settings(max_examples=200, deadline=None)
@given(st.floats(0, 1000), st.lists(st.tuples(st.sampled_from([0.0, 0.5, 1.0, 3.0]), st.floats(0, 300)), max_size=6))
def test_split_uses_all_it_can_and_keeps_proportions(budget, children):
    weights, caps = [w for w, _ in children], [c for _, c in children]
    got = mixing.split_budget(budget, weights, caps)
    usable = sum(c for w, c in children if w > 0)
    assert sum(got) == pytest.approx(min(budget, usable), abs=1e-6)
    assert all(0 <= g <= c + 1e-9 for g, c in zip(got, caps, strict=True))
    rates = [g / w for g, w, c in zip(got, weights, caps, strict=True) if w > 0 and g < c - 1e-6]
    assert not rates or max(rates) - min(rates) < 1e-6
    assert all(g / w <= max(rates) + 1e-6 for g, w in zip(got, weights, strict=True) if w > 0 and rates)


def test_a_shortage_goes_to_siblings_first():
    leaves = {("a", "x"): 10, ("a", "y"): 100, ("b", "z"): 100}
    assert mixing.allocate(leaves, {}, 100) == {("a", "x"): 10, ("a", "y"): 40, ("b", "z"): 50}
    assert mixing.allocate(leaves, {}, 190) == pytest.approx({("a", "x"): 10, ("a", "y"): 85, ("b", "z"): 95})
    assert mixing.allocate(leaves, {("a",): 3, ("b",): 0}, 1000) == {("a", "x"): 10, ("a", "y"): 100, ("b", "z"): 0}


def brute(spark, rows, weights, budget, max_epochs, seed):
    tokens = [len(re.findall(r"\S+", r[1] or "")) for r in rows]
    total = {}
    for r, t in zip(rows, tokens, strict=True):
        total[r[2], r[3]] = total.get((r[2], r[3]), 0) + t
    given_ = mixing.allocate({p: float(t * max_epochs) for p, t in total.items()}, weights, float(budget))
    keyed = spark.createDataFrame([(k, r[0], r[1]) for k, r in enumerate(rows)], "k int, doc_id long, text string")
    out = []
    for path, got in given_.items():
        own = total[path]
        take = min(int(got + 1e-3), own * max_epochs)
        whole, rest = (take // own, take % own) if own else (0, 0)
        order = {r.k: (r.u % 2**64) for r in keyed.select("k", F.xxhash64(F.lit(seed), F.lit(whole).cast("long"), "doc_id", F.xxhash64("text")).alias("u")).collect()}
        mine = sorted((k for k, r in enumerate(rows) if (r[2], r[3]) == path), key=lambda k: order[k])
        done, open_ = 0, True
        for k in mine:
            done += tokens[k]
            open_ = open_ and done <= rest
            if whole + open_:
                out.append((str(rows[k][0]), tokens[k], whole + open_))
    return sorted(out)


@pytest.mark.parametrize("buckets,budget,epochs", [(1024, 700, 1), (4, 1500, 2), (2, 90, 1), (16, 10**6, 3), (16, 0, 1)])
def test_prefixes_equal_brute_force(spark, monkeypatch, buckets, budget, epochs):
    monkeypatch.setattr(mixing, "BUCKETS", buckets)
    rng = random.Random(buckets)
    rows = [(i, " ".join("w" * rng.randint(1, 3) for _ in range(rng.randint(0, 25))), rng.choice("aab"), rng.choice(["s", "s", "t", None])) for i in range(120)]
    rows += [(200, None, "a", "s"), (201, "", "b", None), (None, "no id here", "a", "t"), (202, "x " * 500, "a", "u"), (203, " ", None, None)]
    df = spark.createDataFrame([(*r, -1) for r in rows], "doc_id long, text string, lang string, source string, tokens int").repartition(3)
    got = mixing.mix(df, [F.col("lang"), F.col("source")], {("a",): 2.0, ("a", "t"): 0.3}, budget=budget, max_epochs=epochs, seed=5)
    assert got.columns == ["doc_id", "text", "lang", "source", "tokens", "epochs"]
    assert sorted((str(r.doc_id), r.tokens, r.epochs) for r in got.collect()) == brute(spark, rows, {("a",): 2.0, ("a", "t"): 0.3}, budget, epochs, 5)


def test_empty_table_and_repeated_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert mixing.mix(none, [F.col("lang")], {}).collect() == []
    same = spark.createDataFrame([(1, "a b", "x")] * 4, "doc_id long, text string, lang string")
    assert mixing.mix(same, [F.col("lang")], {}, budget=5).count() == 2
