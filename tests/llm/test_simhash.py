import random
import re

import numpy as np
import pytest
import xxhash

from quillstone.llm import components as module
from quillstone.llm import simhash
from quillstone.llm.components import components


def brute_fingerprint(text, size=4):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not words:
        return 0
    grams = [" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(fps, bits=4):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    fs = sorted(root)
    for i, a in enumerate(fs):
        for b in fs[i + 1 :]:
            if (a ^ b).bit_count() <= bits:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {f: find(f) for f in fs}


@pytest.mark.parametrize("text", [None, "", " \t\n", "One", "a b c", "A b c\x0bd E f", "É é À " * 40, "x " * 70_000])
def test_fingerprint(text):
    assert simhash.fingerprint(text and text.encode(), 4) == brute_fingerprint(text)


def test_any_two_within_four_bits_share_a_key():
    rng = random.Random(1)
    for _ in range(400):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), rng.randint(0, 4)):
            b ^= 1 << bit
        keys, owners = simhash.keys_of(np.array([a, b], np.uint64))
        assert set(keys[owners == 0]) & set(keys[owners == 1])


def cloud(rng, n):
    base = rng.getrandbits(64)
    out = set()
    while len(out) < n:
        x = base
        for bit in rng.sample(range(64), rng.randint(0, 5)):
            x ^= 1 << bit
        out.add(x)
    return out


@pytest.mark.parametrize("limit", [16384, 7])
def test_links_keep_every_component(spark, limit):
    rng = random.Random(7)
    fps = {0, 1, 2**64 - 1} | {rng.getrandbits(64) for _ in range(300)}
    for size in (2, 3, 40, 120):
        fps |= cloud(rng, size)
    rows = [(x - 2**64 if x >= 2**63 else x,) for x in fps]
    found = components(simhash.links(spark.createDataFrame(rows, "fp long").repartition(3), 4, limit)).collect()
    root = {f: f for f in fps} | {r.node % 2**64: r.root % 2**64 for r in found}
    mine, want = {}, {}
    for f, r in root.items():
        mine.setdefault(r, set()).add(f)
    for f, r in brute_groups(fps).items():
        want.setdefault(r, set()).add(f)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, want.values()))


def test_operator_on_awkward_rows(spark):
    rng = random.Random(3)
    base = [rng.choice("abcdefghij") + str(rng.randint(0, 400)) for _ in range(900)]
    texts = [None, "", "  ", " ".join(base), " ".join(base), " ".join(base[:-1]), " ".join(base[1:]), "short text", "Short  TEXT", "other words entirely here", " ".join(base * 20)]
    rows = [(i + 1, t, "c", 0) for i, t in enumerate(texts)] + [(4, texts[3], "c", 0), (None, "short text", "c", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id string, fp int").repartition(3)
    got = simhash.simhash_groups(df).collect()
    fps = {(r[0], r[1]): brute_fingerprint(r[1]) for r in rows}
    roots = brute_groups(set(fps.values()))
    least = {}
    for i, t in fps:
        k = roots[fps[i, t]]
        least[k] = min(x for x in (least.get(k), i) if x is not None)
    want = sorted(((i, fps[i, t], least[roots[fps[i, t]]]) for i, t, *_ in rows), key=str)
    assert sorted(((r.doc_id, r.fp % 2**64, r.component_id) for r in got), key=str) == want


@pytest.mark.parametrize("per_task", [500_000, 40])
def test_empty_table_and_long_chain(spark, monkeypatch, per_task):
    monkeypatch.setattr(module, "PER_TASK", per_task)
    assert simhash.simhash_groups(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    chain = spark.range(0, 400, 1, 20).selectExpr("id as a", "id + 1 as b")
    assert {(r.node, r.root) for r in components(chain).collect()} == {(i, 0) for i in range(1, 401)}
    rng = random.Random(per_task)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(260)]
    root = {n: n for e in edges for n in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    found = components(spark.createDataFrame(edges, "a long, b long").repartition(7)).collect()
    assert {(r.node, r.root) for r in found} == {(n, find(n)) for n in root if find(n) != n}


@pytest.mark.parametrize("limit,nodes", [(16384, 1500), (5, 3)])
def test_near_copies_by_shingles(spark, monkeypatch, limit, nodes):
    monkeypatch.setattr(simhash, "_BLOCK_NODES", nodes)
    rng = random.Random(13)
    rows, words = [], [f"w{k}" for k in range(4000)]
    for group in range(12):
        base = [rng.choice(words) for _ in range(rng.choice([60, 300]))]
        for _ in range(6):
            text = list(base)
            for _ in range(rng.randint(0, 4)):
                text[rng.randrange(len(text))] = rng.choice(words)
            rows.append((len(rows), " ".join(text)))
    rows += [(1000 + k, " ".join(rng.choice(words) for _ in range(100))) for k in range(60)] + [(2000, "a a a a"), (2001, "a"), (2002, None), (2003, " ")]
    sets = {i: set(simhash.shingle_hashes((t or "").encode(), 5)) for i, t in rows}
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in sets.items():
        for j, b in sets.items():
            if i < j and a and b and len(a & b) >= 0.8 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    want = {i for i in root if find(i) == i}
    df = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, row string").repartition(3)
    got = {r.doc_id for r in simhash.keep_one(df, bucket_limit=limit).collect()}
    assert want <= got and len(got - want) <= 0.02 * len(rows)


@pytest.mark.parametrize("limit,slots", [(16384, None), (5, 1 << 10)])
def test_no_near_copy_is_missed_whatever_the_edit(spark, monkeypatch, limit, slots):
    if slots:  # a full bitmap: nearly every shingle counts as shared
        monkeypatch.setattr(simhash.bitmaps, "bits_for", lambda n, per_key=16: slots if per_key == 1 else 1 << 18)
    rng = random.Random(17)
    words = [f"w{k}" for k in range(6000)]
    pick = lambda n: [rng.choice(words) for _ in range(n)]
    rows, notice = [], " ".join(pick(12))
    for n in [60, 120, 250, 600] * 25:
        base, more = pick(n), int(n * rng.uniform(0.05, 0.2))
        at = rng.randrange(n - more)
        for text in (base, base + pick(more), pick(more) + base, base[:-more], base[:at] + base[at + more :], base[:at] + pick(more // 2) + base[at + more // 2 :]):
            rows.append((len(rows), " ".join(text) + (f" {notice}" if n == 600 else "")))
    sets = [set(simhash.shingle_hashes(t.encode(), 5)) for _, t in rows]
    near = {(i, j) for i, a in enumerate(sets) for j in range(i + 1, len(sets)) if len(a & (b := sets[j])) >= 0.8 * len(a | b)}
    assert len(near) > 300
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in near:
        x, y = find(i), find(j)
        root[max(x, y)] = min(x, y)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r.doc_id for r in simhash.keep_one(df, bucket_limit=limit).collect()} == {i for i in root if find(i) == i}


def test_levels_count_every_shingle(spark, monkeypatch):
    """Common and rare shingles, counted in small parts and many ranges: levels are those of a plain count by slot."""
    rng = random.Random(12)
    texts = [" ".join(["the", "same", "opening", "line", "here"] + [rng.choice("abcdefgh") + str(rng.randint(0, 30)) for _ in range(rng.randint(0, 60))]) for _ in range(300)] + ["", None]
    df = spark.createDataFrame([(t.encode() if t is not None else None,) for t in texts], "text binary").repartition(3)
    for counted, ranges in ((1 << 21, 64), (50, 256)):
        monkeypatch.setattr(simhash, "_COUNTED", counted)
        monkeypatch.setattr(simhash, "_RANGES", ranges)
        bitmap, slots = simhash.shingle_levels(df, 5)
        words = sum(len((t or "").encode()) for t in texts) // 6
        counts = np.zeros(slots, int)
        for t in texts:
            hashes = np.array(simhash.shingle_hashes((t or "").encode(), 5), np.int64).view(np.uint64)
            np.add.at(counts, (hashes >> np.uint64(64 - (slots.bit_length() - 1))).astype(int), 1)
        for plane, least in zip(bitmap, (2, 8 + 2 * words // slots, 64 + 2 * words // slots), strict=True):
            assert (np.unpackbits(plane, bitorder="little").astype(bool) == (counts >= least)).all()


def test_near_copies_come_from_fingerprints_too(spark, monkeypatch):
    """pairs that meet by their Golay keys are candidates of the near stage without the prefix filter."""
    monkeypatch.setattr(simhash, "shingle_links", lambda *a: [])
    rng = random.Random(3)
    base = [f"w{rng.randint(0, 3000)}" for _ in range(900)]
    rows = [(1, " ".join(base)), (2, " ".join([*base[:-1], "end"])), (3, " ".join(f"w{rng.randint(0, 3000)}" for _ in range(900)))]
    assert sorted(r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()) == [1, 3]


def test_long_texts_that_share_a_passage_do_not_hang_together(spark, monkeypatch):
    """sketches of one width let all pairs of long texts through, whose blocks were dealt out many times over."""
    monkeypatch.setattr(simhash.bitmaps, "bits_for", lambda n, per_key=16: 1 << 10 if per_key == 1 else 1 << 18)
    rng = random.Random(4)
    line = " ".join(f"w{k}" for k in range(40))
    rows = [(k, f"{line} " + " ".join(f"w{rng.randint(0, 6000)}" for _ in range(1500 * 2 ** (k % 3)))) for k in range(24)]
    texts = spark.createDataFrame([(k, t.encode()) for k, t in rows], "node long, text binary").repartition(3)
    assert simhash.meetings(texts, 5, 0.8).count() > 0
    assert [r for part in simhash.shingle_links(texts, 5, 0.8, 16384) for r in part.collect()] == []


@pytest.mark.parametrize("size", [10**9, 7])
def test_shared_keys_whatever_the_parts(size):
    rng = random.Random(size)
    keys = [rng.randint(0, 60) for _ in range(300)]
    rows = [(k, rng.randint(0, 9) + 10 * (k % 4)) for k in keys] + [(100, 1)] * 3
    held, found = [np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, bool)], []
    for k in range(0, len(rows), size):
        part = rows[k : k + size]
        held = [np.concatenate(x) for x in zip(held, ([r[0] for r in part], [r[1] for r in part], [False] * len(part)), strict=True)]
        held = [held[0].astype(np.uint64), held[1].astype(np.int64), held[2].astype(bool)]
        out, held = simhash.shared(*held, k + size >= len(rows))
        found += zip(*(x.tolist() for x in out), strict=True)
    holders, buckets = {}, {}
    for k, n in rows:
        holders.setdefault(k, set()).add(n)
    for k, n in found:
        buckets.setdefault(k, set()).add(n)
    want = {frozenset(x) for x in holders.values() if len(x) > 1}
    got = {frozenset(x) for x in buckets.values()}
    assert got == want and (size < 10**9 or len(buckets) == len(want))


def test_sets_that_may_be_alike_share_a_tier():
    for similarity in (0.8, 0.5):
        for n in [*range(1, 3000), *range(6300, 8100), *range(25500, 32100, 7)]:
            least = int(np.ceil(similarity * n - 1e-6))
            for m in {least, (least + n) // 2, n}:
                assert simhash.tiers_of(n, similarity)[0] in simhash.tiers_of(m, similarity)
