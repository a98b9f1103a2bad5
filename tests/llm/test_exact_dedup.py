import hashlib
import random

import pytest
from pyspark.sql import functions as F

from quillstone.llm.exact_dedup import DigestIndex, exact_dedup

SCHEMA = "doc_id long, text string, digest string, keep_id string"


def brute(rows, best):
    groups = {}
    for i, text in rows:
        groups.setdefault(text or "", []).append(i)
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = best(known) if known else None
        out += [(i, keep, len(ids), i == keep, hashlib.sha256(text.encode()).hexdigest()) for i in ids]
    return sorted(out, key=str)


ROWS = [(1, "a"), (2, "b"), (3, "a"), (4, None), (5, ""), (6, "a "), (7, "x" * 200_000), (8, "x" * 200_000), (None, "b"), (None, "c"), (9, "dup"), (9, "dup")]


def found(df, **more):
    got = exact_dedup(df, **more).withColumn("digest", F.lower(F.hex("digest"))).select("doc_id", "keep_id", "group_size", "kept", "digest")
    return sorted(map(tuple, got.collect()), key=str)


def test_equal_texts_nulls_ties_and_clashing_columns(spark):
    df = spark.createDataFrame([(i, t, "noise", None) for i, t in ROWS], SCHEMA).repartition(3)
    assert found(df) == brute(ROWS, min)
    assert found(df, keep="largest") == brute(ROWS, max)


def test_colliding_digests_are_told_apart_by_text(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    weak = exact_dedup(df, digest=lambda text: F.encode(F.substring(F.md5(text), 1, 0), "utf-8"))
    got = sorted(((r.doc_id, r.keep_id, r.group_size) for r in weak.collect()), key=str)
    assert got == sorted((x[:3] for x in brute(ROWS, min)), key=str)


def test_empty_table(spark):
    assert found(spark.createDataFrame([], "doc_id long, text string")) == []


@pytest.mark.parametrize("digest", [None, lambda text: F.encode(F.substring(F.md5(text), 1, 1), "utf-8")])
def test_later_batches_are_looked_up_in_the_level(spark, digest):
    """Three batches: each row is seen if an earlier batch has its text; weak digests collide and change nothing."""
    rng = random.Random(5)
    batches = [[(100 * b + k, rng.choice(["", None, *(f"text {x}" for x in range(25))])) for k in range(20)] for b in range(3)]
    index, store, known = DigestIndex(spark, **({"digest": digest} if digest else {})), None, {}
    for rows in batches:
        batch = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
        if store is not None:
            got = sorted((r.id, r.text, r.keep_id) for r in index.seen(batch, store, "doc_id", "text").collect())
            assert got == sorted((i, t or "", min(known[t or ""])) for i, t in rows if (t or "") in known)
        index.flush(batch, "doc_id", "text")
        store = batch if store is None else store.union(batch)
        for i, t in rows:
            known.setdefault(t or "", []).append(i)
        if digest is None:
            assert sorted((r.keep_id, r.group_size) for r in index.compact().collect()) == sorted((min(x), len(x)) for x in known.values())
    assert index.merged >= 2 and len(index.runs) == 3


def test_runs_merge_and_the_filter_has_no_false_negative(spark):
    a, b = spark.range(0, 500), spark.range(250, 750)
    index = DigestIndex(spark)
    for part in (a, b):
        index.flush(part.withColumn("text", F.col("id").cast("string")), "id", "text")
    level = index.compact()
    assert level.count() == 750 and level.where("group_size = 2").count() == 250
    bitmap, bits = index.filter(level.where("group_size = 2"))
    rows = index.rows(spark.range(0, 750).withColumn("text", F.col("id").cast("string")), "id", "text")
    passed = {r.id for r in index.may_hold(rows, bitmap, bits).collect()}
    assert passed >= set(range(250, 500)) and len(passed) < 300
