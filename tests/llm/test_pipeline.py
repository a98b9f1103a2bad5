import os
import random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from quillstone.llm import decontaminate, exact_dedup, quality, simhash  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, extra=()):
    return " ".join([rng.choice("bcdfghjk") + rng.choice("aeiou") + str(rng.randint(0, 99)) for _ in range(n)] + list(extra))


def corpus():
    rng = random.Random(11)
    rows, labels = [], []
    for i in range(160):
        bad = i % 5 == 0
        rows.append((i, words(rng, 120, ["vile", "rotten", "foul"] if bad else []), rng.choice(["en", "de", None]), rng.choice(["src0", "src1", None])))
        labels.append((i, 1, int(bad)))
    rows += [(200 + k, rows[1][1], "en", "src0") for k in range(4)]
    base = words(rng, 900)
    rows += [(300 + k, base + f" ending{k}", "en", "src1") for k in range(3)]
    item = words(rng, 14)
    rows += [(400, words(rng, 30) + " " + item + " " + words(rng, 30), "de", "src2"), (401, None, "en", "src0"), (402, "", "en", "src0"), (403, words(rng, 60_000), "fr", "src3"), (2, rows[2][1], rows[2][2], rows[2][3])]
    return [(*r, len(r[1] or "")) for r in rows], labels, item


def write(spark, path, rows, labels, items):
    spark.createDataFrame(rows, SCHEMA).repartition(4).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_every_stage_does_its_job_on_what_is_left(spark, tmp_path):
    rows, labels, item = corpus()
    sf = write(spark, tmp_path / "sf", rows, labels, [(1, item), (2, None)])
    docs, seen = spark.read.parquet(f"{sf}/documents.parquet"), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, sf)
        if k < 4:
            assert docs.schema == spark.read.parquet(f"{sf}/documents.parquet").schema
        docs.write.parquet(f"{tmp_path}/out{k}")
        docs = spark.read.parquet(f"{tmp_path}/out{k}")
        seen[name] = sorted(r.doc_id for r in docs.collect())
    ids = sorted(r[0] for r in rows)
    good = seen["quality classifier"]
    assert set(ids) - set(good) == set(range(0, 160, 5))
    distinct = seen["exact dedup"]
    assert distinct == sorted((set(good) - {200, 201, 202, 203, 402}))
    assert seen["SimHash near-dedup"] == sorted(set(distinct) - {301, 302})
    assert seen["benchmark decontamination"] == sorted(set(seen["SimHash near-dedup"]) - {400})
    assert set(seen["mixing sources to target weights"]) <= set(seen["benchmark decontamination"])
    ran = corpus_pipeline.run(spark, sf)
    assert sorted(r.doc_id for r in ran.collect()) == seen["mixing sources to target weights"]


def test_empty_tables(spark, tmp_path):
    sf = write(spark, tmp_path / "sf", [], [], [])
    assert corpus_pipeline.run(spark, sf).collect() == []


def test_keep_one_of_equal_rows_and_shared_identifiers(spark):
    rows = [(1, "a b"), (1, "a b"), (1, "c"), (2, "a b"), (None, "c"), (None, "d"), (None, "d"), (3, None), (4, "")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, _n string")
    got = sorted((str(r.doc_id), r.text or "") for r in exact_dedup.keep_one(df).collect())
    assert got == sorted([("1", "a b"), ("1", "c"), ("None", "d"), ("3", "")])
    rng = random.Random(2)
    base = words(rng, 700)
    near = [(5, base + " x"), (4, base + " y"), (4, "another text"), (None, base + " z"), (7, None), (8, " ")]
    got = sorted(map(str, (tuple(r) for r in simhash.keep_one(spark.createDataFrame(near, "doc_id long, text string")).collect())))
    assert got == sorted(map(str, [near[1], near[2], near[4], near[5]]))


def test_drop_contaminated_in_blocks(spark):
    docs = spark.createDataFrame([(1, "x a b c y"), (2, "a b d"), (3, None), (4, "Q. r!")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b c"), (2, "q r"), (3, "")], "item_id long, text string")
    for size in (1 << 20, 2):
        assert sorted(r.doc_id for r in decontaminate.drop_contaminated(docs, items, window=3, max_block_bytes=size).collect()) == [2, 3]


def test_toxic_rows_go_on_the_test_tables(spark):
    path = "/root/testdata/sf0.01"
    if not os.path.isdir(path):
        pytest.skip("no test tables here")
    docs = spark.read.parquet(f"{path}/documents.parquet")
    left = corpus_pipeline.quality_classifier(spark, docs, path)
    assert 0.7 < left.count() / docs.count() < 0.97
    assert quality.label_grade() is not None
