import random
import re

import pytest

from quillstone.llm.substring_dedup import substring_dedup


def brute(rows, window):
    docs = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    seen = {}
    for d, w in enumerate(docs):
        for i in range(len(w) - window + 1):
            seen.setdefault(tuple(w[i : i + window]), []).append((d, i))
    gone = [set() for _ in docs]
    for places in seen.values():
        if len(places) > 1:
            for d, i in places:
                gone[d].update(range(i, i + window))
    return sorted(((rows[d][0], len(w), len(gone[d]), " ".join(x for k, x in enumerate(w) if k not in gone[d])) for d, w in enumerate(docs)), key=str)


def corpus(rng, vocabulary, n):
    passages = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(3, 40))) for _ in range(6)]
    rows = []
    for i in range(n):
        parts = [rng.choice(passages) if rng.random() < 0.4 else "\t".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 25))) for _ in range(rng.randint(0, 6))]
        rows.append((i, "\n ".join(parts)))
    return rows + [(n, None), (n + 1, ""), (n + 2, "a a a a a a a a a a a a a a a"), (n + 3, rows[0][1]), (3, rows[3][1]), (3, "b " * 30), (None, passages[0]), (n + 4, " ".join(f"w{k}" for k in range(30_000)))]


@pytest.mark.parametrize("window,limit,seed", [(7, 2000, 1), (8, 1, 2), (2, 3, 3), (1, 2000, 4)])
def test_equals_brute_force(spark, window, limit, seed):
    rng = random.Random(seed)
    rows = corpus(rng, [f"é{k}" for k in range(30)] + ["a", "b"], 40)
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, key string, n int").repartition(5)
    got = substring_dedup(df, window=window, group_limit=limit).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got), key=str) == brute(rows, window)
    for r in got:
        assert sum(s.end - s.start for s in r.spans) == r.n_removed


def test_empty_table(spark):
    assert substring_dedup(spark.createDataFrame([], "doc_id long, text string")).collect() == []
