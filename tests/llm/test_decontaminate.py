import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from quillstone.llm.decontaminate import build, contaminated_spans, hit_words, scan, words_of


def words(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def brute(text, items, window):
    own, hit, names = words(text), set(), set()
    for name, item in items:
        w = words(item)
        k = min(window, len(w))
        wins = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if k else set()
        for i in range(len(own) - k + 1 if k else 0):
            if tuple(own[i : i + k]) in wins:
                hit.update(range(i, i + k))
                names |= {name} - {None}
    return len(own), len(hit), sorted(names)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from("abAB1é"), max_size=60), st.lists(st.tuples(st.integers(0, 3), st.lists(st.sampled_from("abé1"), max_size=9)), max_size=5), st.integers(1, 5))
def test_search_equals_brute_force(doc, items, window):
    text, items = ", ".join(doc), [(i, " ".join(w)) for i, w in items]
    own = words_of(text.encode())
    spans, names = scan(own, build(items, window))
    assert (len(own), sum(b - a for a, b in spans), names) == brute(text, items, window)


def test_whole_operator_in_one_block_and_in_many(spark):
    rng = random.Random(5)
    items = [(i, " ".join(rng.choice(["sun", "moon", "Été", "x9"]) for _ in range(rng.randint(0, 14)))) for i in range(12)] + [(None, "only word"), (3, None), (4, "")]
    docs = [(i, " - ".join(rng.choice(["SUN", "moon", "été", "x9", "only", "word"]) for _ in range(rng.randint(0, 300)))) for i in range(30)]
    docs += [(100, None), (101, ""), (102, items[0][1] + " " + "q " * 50_000 + items[1][1])]
    d = spark.createDataFrame([(i, t, "clash", 1) for i, t in docs], "doc_id long, text string, item_id string, n_words int").repartition(3)
    b = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, doc_id int")
    want = {i: brute(t, items, 4) for i, t in docs}
    for size in (1 << 20, 100):
        got = contaminated_spans(d, b, window=4, max_block_bytes=size).withColumn("n", hit_words("spans")).collect()
        assert {r.doc_id: (r.n_words, r.n, sorted(r["items"])) for r in got} == want


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [tuple(r) for r in contaminated_spans(docs, none).collect()] == [(1, 2, [], [])]
    assert contaminated_spans(docs.limit(0), none).collect() == []


def test_rows_that_share_an_identifier_stay_apart_in_many_blocks(spark):
    items = [(k, f"start{k} middle{k} end{k}") for k in range(8)]
    docs = [(None, f"a {items[k][1]} b" + " c" * k) for k in range(5)] + [(1, items[0][1]), (1, items[1][1] + " " + items[2][1]), (1, "nothing"), (1, "nothing"), (None, None)]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    want = sorted((str(i), *brute(t, items, 3)) for i, t in docs)
    for size in (1 << 20, 60):
        got = contaminated_spans(d, b, window=3, max_block_bytes=size).withColumn("n", hit_words("spans")).collect()
        assert sorted((str(r.doc_id), r.n_words, r.n, r["items"]) for r in got) == want


def test_identifiers_of_any_type_and_no_rows_to_repeat(spark):
    docs = spark.createDataFrame([("d", "x a b c y"), (None, "a b"), ("e", None)], "doc_id string, text string")
    items = spark.createDataFrame([("item-10", "a b c"), ("item-9", "b c y z"), ("item-9", "A B"), (None, "x a")], "item_id string, text string")
    for size in (1 << 20, 6):
        got = {r.doc_id: (r.n_words, [tuple(s) for s in r.spans], r["items"]) for r in contaminated_spans(docs, items, window=3, max_block_bytes=size).collect()}
        assert got == {"d": (5, [(0, 5)], ["item-10", "item-9"]), None: (2, [(0, 2)], ["item-9"]), "e": (0, [], [])}


def test_tables_take_a_bounded_number_of_bytes():
    """A benchmark of 4 MB, words of one letter included: below 20 bytes a byte of text, and right."""
    rng = random.Random(8)
    items = [(i, " ".join("".join(rng.choices("abcdefgh", k=rng.randint(1, 6))) for _ in range(200))) for i in range(4000)]
    items += [(-1, " ".join(rng.choices("xyz", k=300_000)))]
    size = sum(len(t) for _, t in items)
    tables = build(items, 10)
    assert sum(s.nbytes() for s in tables.searchers) < 20 * size
    own = words_of(items[7][1].encode())
    assert scan([b"new", *own, b"end"], tables) == ([(1, 201)], [7])
