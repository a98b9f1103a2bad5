import random

import numpy as np
import pytest

from quillstone.llm import suffix_dedup as sd


def brute(rows, window):
    docs = [(t or "").encode() for _, t in rows]
    seen = {}
    for d, b in enumerate(docs):
        for i in range(len(b) - window + 1):
            seen.setdefault(b[i : i + window], []).append((d, i))
    gone = [set() for _ in docs]
    for places in seen.values():
        if len(places) > 1:
            for d, i in places:
                gone[d].update(range(i, i + window))
    return sorted(((rows[d][0], len(b), len(gone[d]), bytes(x for k, x in enumerate(b) if k not in gone[d])) for d, b in enumerate(docs)), key=str)


def corpus(rng, n):
    def junk(k):
        return "".join(rng.choice("abcdeé 世") for _ in range(k))

    passages = [junk(rng.randint(5, 90)) for _ in range(6)]
    rows = [(i, "".join(rng.choice(passages) if rng.random() < 0.45 else junk(rng.randint(0, 60)) for _ in range(rng.randint(0, 6)))) for i in range(n)]
    return rows + [(n, None), (n + 1, ""), (n + 2, "a" * 300), (n + 3, rows[0][1]), (3, rows[3][1]), (3, "ab" * 90), (None, passages[0] * 2), (n + 4, "世界" * 40)]


@pytest.mark.parametrize("window,anchor,limit,stretch,seed", [(20, 6, 2000, 1 << 18, 1), (20, 6, 1, 50, 2), (120, 30, 2, 1 << 18, 3), (5, 5, 2000, 7, 4), (1, 1, 2000, 100, 5)])
def test_equals_brute_force(spark, monkeypatch, window, anchor, limit, stretch, seed):
    rows = corpus(random.Random(seed), 40)
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, key string, n int").repartition(5)
    monkeypatch.setattr(sd, "_STRETCH", stretch)
    got = sd.suffix_dedup(df, window=window, anchor=anchor, group_limit=limit).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, bytes(r.kept)) for r in got), key=str) == brute(rows, window)


def test_anchors_cover_every_window_once():
    rng = np.random.default_rng(0)
    text = bytes(rng.integers(97, 100, 5000, np.uint8)) + b"z" * 3000
    for stretch in (1 << 18, 333):
        sd._STRETCH, old = stretch, sd._STRETCH
        try:
            starts = np.concatenate([np.arange(a, a + k) for *_, lo, n in sd.anchors(text, 200, 40) for a, k in zip(lo, n, strict=True)])
        finally:
            sd._STRETCH = old
        assert (starts == np.arange(len(text) - 199)).all()


def test_empty_table_and_a_very_long_text(spark):
    assert sd.suffix_dedup(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    rng = random.Random(9)
    long = "".join(rng.choice("abcdefgh ") for _ in range(600_000))
    rows = [(1, long), (2, "xy" + long[300_000:300_500] + "é")]
    got = {r.doc_id: (r.n_removed, [tuple(s) for s in r.spans]) for r in sd.suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (500, [(300_000, 300_500)]), 2: (500, [(2, 502)])}
