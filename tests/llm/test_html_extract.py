import html
import os
import random
import re
from functools import lru_cache

import pytest

from quillstone.llm import html_extract as hx


def blocks(page):
    return hx.extract(hx.parse(page))


@pytest.mark.parametrize(
    "page,want",
    [
        ("", []),
        ("plain &amp; text", ["plain & text"]),
        ("<article><h1>T</h1><p><b>a<br><p>b &lt;c&gt;\n\t d</p><ul><li>x<li>y</ul></article><p>out", ["T", "a", "b <c> d", "x", "y"]),
        ("<body><nav>n</nav><header>h</header><div class='side-bar sidebar'>s</div><main><p>keep</p><form>f</form></main><footer>f", ["keep"]),
        ("<article><header><h1>T</h1></header><p>a</p><div id=comments><article>c</article></div></article>", ["T", "a"]),
        ("<p>a<script>var t='</p><p>x';</script><style>p{}</style><!-- <p>c</p> -->b</p>", ["ab"]),
        ("<article><p>one</p><p>cut off <a href='x", ["one", "cut off"]),
        ("<p>1 < 2 and 3<4</p>", ["1 < 2 and 3<4"]),
        ("<div>a<div>b</div>c</div>", ["a", "b", "c"]),
        ("<article>x<article>reader</article>y</article>", ["x", "y"]),
        ("<table><tr><td>1<td>2<tr><td>3</table>", ["1", "2", "3"]),
        ("<p>&#233;&nbsp;&am &copy</p></div></p>", ["é &am ©"]),
        ("<div hidden>no</div><p role=alert>no</p><p style='display: none'>no</p><p>yes</p>", ["yes"]),
        ("<title>t</title><p>a<svg><p>x</p></svg>b", ["ab"]),
        ("<article><p>short</p></article><article><p>much longer text</p></article>", ["short", "much longer text"]),
        ("<article>a</article><div class=related><article>r</article></div><article>a</article>", ["a", "a"]),
        ("<h1>Site</h1><main><h1>T</h1><article><p>a</p></article><article>b</article><aside>s</aside></main>", ["T", "a", "b"]),
        ("<main><h1>Section</h1><article><h1>T</h1>a</article></main>", ["T", "a"]),
        ("<p>so <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></math></p><template><p>t</p></template>", ["so x=2"]),
    ],
)
def test_blocks(page, want):
    assert blocks(page) == want


def test_deep_and_long_pages():
    assert blocks("<div>" * 5000 + "deep" + "</div>" * 5000) == ["deep"]
    assert blocks('<a href="' + "<a b='" * 50_000) == []
    assert len(blocks("<p>x" * 30_000)) == 30_000


def tree(rng, depth=3):
    return f"<{(t := rng.choice(['div', 'p', 'ul']))}>" + rng.choice(["", "s", "t"]) + "".join(tree(rng, depth - 1) for _ in range(rng.randint(0, 3)) if depth) + f"</{t}>"


def test_simple_tree_matching_is_optimal():
    rng = random.Random(4)

    def brute(a, b):
        if a.tag != b.tag:
            return 0
        xs, ys = hx.block_nodes(a), hx.block_nodes(b)

        @lru_cache(None)
        def best(i, j):
            if i == len(xs) or j == len(ys):
                return 0
            return max(best(i + 1, j), best(i, j + 1), brute(xs[i], ys[j]) + best(i + 1, j + 1))

        return 2 + (hx.own_text(a) == hx.own_text(b)) + best(0, 0)

    for _ in range(60):
        a, b = hx.parse(tree(rng)), hx.parse(tree(rng))
        pairs = hx.align(a, b)
        assert sum(2 + (hx.own_text(x) == hx.own_text(y)) for x, y in pairs) == brute(a, b)
        assert all(x.tag == y.tag for x, y in pairs)


def page(title, paras):
    return f"<body><div><p>Welcome to our site</p></div><div><h1>{title}</h1>" + "".join(f"<p>{x}</p>" for x in paras) + "<div><p>All rights kept</p></div></div></body>"


def test_template_is_induced_and_content_kept(spark):
    rows = [(i, "http://host/a", page(f"title {i}", [f"text {i} {k}" for k in range(i % 4 + 1)])) for i in range(12)]
    rows += [(100 + i, "http://copies/x", page("same", ["same text"])) for i in range(12)]
    rows += [(200, "http://few/x", page("t", ["u"])), (201, None, "<p>no url</p>"), (202, "http://host/b", None), (203, "http://host/c", ""), (None, "http://host/d", page("new", ["words"])), (3, rows[3][1], rows[3][2])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, host string, blocks int").repartition(3)
    for limit in (16 << 20, 0):
        got = {(r.page_id, r.url): r.blocks for r in hx.extract_pages(df, max_broadcast=limit).collect()}
        for i in range(12):
            assert got[i, "http://host/a"] == [f"title {i}", *(f"text {i} {k}" for k in range(i % 4 + 1))]
            assert got[100 + i, "http://copies/x"] == ["Welcome to our site", "same", "same text", "All rights kept"]
        assert got[200, "http://few/x"] == ["Welcome to our site", "t", "u", "All rights kept"]
        assert got[None, "http://host/d"] == ["new", "words"]
        assert got[201, None] == ["no url"] and got[202, "http://host/b"] == [] == got[203, "http://host/c"]
    assert hx.extract_pages(df).count() == len(rows)


def test_empty_table(spark):
    assert hx.extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_against_a_plain_reading_of_the_test_pages(spark):
    path = "/root/testdata/sf0.01"
    if not os.path.isdir(path):
        pytest.skip("no test tables here")

    def plain(text):
        inner = re.search(r"<article>(.*?)(</article>|\Z)", text, re.S)[1]
        cut = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", inner)]
        return "\n\n".join(x for x in cut if x)

    want = {r.page_id: plain(r.html) for r in spark.read.parquet(f"{path}/pages.parquet").collect()}
    got = {r.page_id: r.text for r in hx.op5_html_extraction(spark, path).collect()}
    assert got == want


def flattened(text):
    """The page with the sectioning tags turned to div and without class, id and role."""
    text = re.sub(r"<(/?)(?:article|nav|footer|header|main|aside|section)\b[^>]*>", r"<\1div>", text)
    return re.sub(r"<(\w+)(?: (?:class|id|role)=(?:\"[^\"]*\"|\S+))+", r"<\1", text)


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_slots_alone_find_the_article(spark, sf):
    """Without any markup that names the parts, hosts of over five pages give what their articles hold."""
    path = f"/root/testdata/{sf}/pages.parquet"
    if not os.path.exists(path):
        pytest.skip("no test tables here")
    pages = spark.read.parquet(path)
    want = {r.page_id: r.blocks for r in hx.extract_pages(pages).collect()}
    rows = [(r.page_id, r.url, flattened(r.html or "")) for r in pages.collect()]
    assert not any("<article" in x or "class=" in x for _, _, x in rows)
    hosts = {i: re.sub(r"^\w+://([^/]*).*", r"\1", u).lower() for i, u, _ in rows if u}
    many = {h for h in hosts.values() if sum(x == h for x in hosts.values()) > 5}
    got = {r.page_id: r.blocks for r in hx.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)).collect()}
    wrong = [i for i, h in hosts.items() if h in many and got[i] != want[i]]
    assert many and not wrong


def slots(pages):
    ref = hx.number(hx.parse(pages[0]))
    sums = {}
    for text in pages[1:]:
        root = hx.parse(text)
        for k, (a, b) in hx.slot_masses(root, hx.align(ref, root)).items():
            x, y = sums.get(k, (0, 0))
            sums[k] = x + a, y + b
    region, menus = hx.main_slot(ref, sums)
    nodes, queue = {}, [ref]
    while queue:
        node = queue.pop()
        nodes[node.number] = node
        queue += hx.block_nodes(node)
    return nodes.get(region), [hx.own_text(nodes[m]) or hx.own_text(hx.block_nodes(nodes[m])[0]) for m in menus]


def test_main_slot():
    words = lambda k, n: " ".join(f"w{k * 1000 + i}" for i in range(n))
    plain = [f"<body><div><ul><li><a>l{k}</a><li><a>m{k}</a></ul></div><div>ad {k}</div><div><h1>t{k}</h1><div><p>{words(k, 40)}</p><p>{words(k + 50, 30)}</p></div></div><div>foot {k}</div></body>" for k in range(6)]
    node, menus = slots(plain)
    assert [c.tag for c in hx.block_nodes(node)] == ["h1", "div"] and menus == []
    # Two halves: neither holds the content alone, and the menu between them is told by its links.
    halves = [f"<body><p>{words(k, 20)}</p><div><a>link number {k}</a></div><p>{words(k + 50, 20)}</p></body>" for k in range(6)]
    node, menus = slots(halves)
    assert node.tag == "body" and menus == ["link number 0"]
    # Comparable shares: the markup decides; furniture by name is never the main slot.
    marked = [f"<body><div>{words(k, 30)}</div><article><p>{words(k + 50, 20)}</p></article><div class=sidebar>{words(k + 90, 90)}</div></body>" for k in range(6)]
    assert slots(marked)[0].tag == "article"
    assert slots(["<body><p>same</p></body>"] * 3) == (None, [])


def test_hosts_without_markup_keep_all_of_the_main_slot(spark):
    rows = [(i, "http://h/x", f"<body><div><a>menu {i}</a></div><div><h1>title {i}</h1>" + "".join(f"<p>long text of page {i} part {k}</p>" for k in range(i % 3 + 2)) + f"</div><div>notice {i}</div></body>") for i in range(9)]
    rows += [(50, "http://h/two", "<body><section><h1>other</h1><p>layout</p></section></body>")]  # no partner for the main slot
    for limit in (16 << 20, 0):
        got = {r.page_id: r.blocks for r in hx.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3), max_broadcast=limit).collect()}
        for i in range(9):
            assert got[i] == [f"title {i}", *(f"long text of page {i} part {k}" for k in range(i % 3 + 2))]
        assert got[50] == ["other", "layout"]


def test_long_child_lists_are_matched_like_short_ones(monkeypatch):
    rng = random.Random(6)

    def listing(n):
        return "<body>" + "".join(f"<{t}>{rng.choice('abcd')}<p>{rng.choice('xyz')}</p></{t}>" if t == "div" else f"<{t}>{rng.choice('abcd')}</{t}>" for t in (rng.choice(["p", "div", "h2"]) for _ in range(n))) + "</body>"

    for n, m in [(1, 5), (7, 7), (30, 22), (12, 50)] * 5:
        a, b = hx.parse(listing(n)), hx.parse(listing(m))
        whole = hx.align(a, b)
        with monkeypatch.context() as context:
            context.setattr(hx, "MAX_CELLS", 0)
            assert sorted((id(x), id(y)) for x, y in hx.align(a, b)) == sorted((id(x), id(y)) for x, y in whole)
    paras = [f"own text {k}" for k in range(300)]
    long = [hx.parse("<body><h1>t</h1>" + "".join(f"<p>{x}</p>" for x in p) + "</body>") for p in (paras, [f"new {k}" for k in range(40)] + paras[:150] + ["one more"] + paras[150:])]
    same = sum(hx.own_text(x) == hx.own_text(y) != "" for x, y in hx.align(*long))
    assert same >= 300
