import itertools
import math
import os

import numpy as np
import pytest

from quillstone.llm import language_id as li

pytestmark = pytest.mark.skipif(not os.path.exists(li.VOCABULARY), reason="no vocabulary here")


def segmentations(text):
    for cuts in itertools.product([0, 1], repeat=len(text) - 1):
        out, start = [], 0
        for k, c in enumerate(cuts, 1):
            if c:
                out.append(text[start:k])
                start = k
        yield [*out, text[start:]]


def test_forward_and_expected_counts_sum_over_all_segmentations():
    pieces = [li.START, "a", "b", "ab", li.START + "a", "ba", "aba"]
    lattice = li.Lattice(pieces)
    rng = np.random.default_rng(0)
    table = rng.random((len(pieces) + 1, 2))
    for word in ("", "a", "abab", "xab", "bbax"):
        total, counts = [0.0, 0.0], {}
        for parts in segmentations(li.START + word):
            ids = [lattice.index.get(p, lattice.unknown if len(p) == 1 else None) for p in parts]
            if None in ids:
                continue
            p = table[ids].prod(axis=0)
            total = [x + y for x, y in zip(total, p, strict=True)]
            for k in ids:
                counts[k] = counts.get(k, 0) + p[0]
        padded = np.vstack([table, np.zeros(2)])
        assert np.allclose(np.exp(lattice.forward([word, "b" * len(word), "q"], padded))[0], total)
        found = dict.fromkeys(range(len(pieces) + 1), 0.0)
        lattice.expected(word, table[:, 0].tolist(), 3.0, found)
        assert np.allclose([found[k] for k in found], [3 * counts.get(k, 0) / total[0] for k in found])


def test_awkward_rows(spark):
    rows = [(1, "the cat and the dog", "en"), (2, "der hund und die katze", "de"), (3, None, "en"), (4, "12 !", "de"), (5, "", None), (6, "the dog " * 30_000, None), (7, "und " + "x" * 5000, None), (None, "die katze", None), (1, "the cat and the dog", "en")]
    df = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, lang string, score double").repartition(2)
    got = li.predict(df, li.fit(df)).collect()
    assert sorted((str(r.doc_id), r.lang_pred) for r in got) == sorted([("1", "en"), ("1", "en"), ("2", "de"), ("3", "und"), ("4", "und"), ("5", "und"), ("6", "en"), ("7", "de"), ("None", "de")])
    assert all(0 <= r.score <= 1 and not math.isnan(r.score) for r in got)


def test_empty_table_and_nothing_to_learn_from(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    some = spark.createDataFrame([(1, "word", None)], "doc_id long, text string, lang string")
    assert li.predict(none, li.fit(none)).collect() == []
    assert [tuple(r) for r in li.predict(some, li.fit(some)).collect()] == [(1, "und", 0.0)]


def test_only_letters_make_words(spark):
    assert li.words_of("½ ② Ⅷ ٣ 12 _ !") == [] and li.words_of("x²y a_b ça 二十") == ["x", "y", "a", "b", "ça", "二十"]
    df = spark.createDataFrame([(1, "the cat", "en"), (2, "½ ②", "en"), (3, "die katze", "de")], "doc_id long, text string, lang string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in li.predict(df, li.fit(df)).collect()}
    assert got[2] == ("und", 0.0) and got[1][0] == "en" and got[3][0] == "de"


def test_copies_are_sampled_one_by_one(spark):
    rows = [(i, "der hund und die katze", "de") for i in range(400)] + [(1000 + i, "the cat and the dog", "en") for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = li.fit(df, sample_per_lang=1)
    got = li.predict(spark.createDataFrame([(1, "hund und katze"), (2, "cat and dog")], "doc_id long, text string"), model).collect()
    assert [r.lang_pred for r in sorted(got)] == ["de", "en"]


def test_too_many_languages(spark, monkeypatch):
    monkeypatch.setattr(li, "MAX_LANGUAGES", 1)
    with pytest.raises(ValueError):
        li.fit(spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "doc_id long, text string, lang string"))


def test_a_full_cache_changes_nothing():
    pieces = [li.START, *"abcdef"]
    model = li.Model(["x", "y"], [0.5, 0.5], pieces, np.random.default_rng(1).random((8, 2)) / 8)
    text = " ".join(a + b + c for a, b, c in itertools.product("abcdef", repeat=3))
    (small,), (large,) = li.Scorer(model, 10).predict_all([text]), li.Scorer(model).predict_all([text])
    assert small[0] == large[0] and small[1] == pytest.approx(large[1])


def test_held_out_accuracy(spark):
    path = "/root/testdata/sf0.01"
    if not os.path.isdir(path):
        pytest.skip("no test tables here")
    found = li.op4_language_id(spark, path).join(spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out and lang is not null and lang_pred <> 'und'").collect()
    assert len(found) > 100 and sum(r.lang == r.lang_pred for r in found) / len(found) > 0.97
