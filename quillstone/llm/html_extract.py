"""Main text of web pages by wrapper induction.

* **Trees.** A page becomes a tree by the usual rules of omitted end tags; scripts, styles and comments go at once.
* **Alignment.** The page of each host with the smallest identifier is its reference. Every other page's tree is aligned
  with it by simple tree matching: the largest set of node pairs with equal tags that keeps parents and the order of
  siblings, found by dynamic programming over the children.
* **Template.** A reference node whose own text is the same in at least ``min_share`` of the pages aligned with it, of
  which there must be ``min_pages`` that differ from the reference somewhere else, is template; the other aligned nodes
  are slots. Votes are counted for each host and node, with map-side combine.
* **Region.** Every page also votes with the share of its varying text that lies in each slot, text inside links apart;
  text of nodes without a partner counts for the nearest aligned node above. From the root of the reference the induction
  goes down into the child that holds most of it, as long as that is at least half and no title, nor a quarter in paragraphs, is left
  behind. Where children hold comparable shares, markup (an article or main element; furniture by tag, role or class)
  decides between them. The node where this ends is the host's main slot; beside it, slots whose text is nearly all links
  are menus.
* **Content.** The node that is aligned with the main slot: all articles in it, or all of the article it lies in, without
  template nodes whose text the page shares and without furniture by tag, role or class. Only pages that have no main slot
  (hosts of fewer than ``min_region`` pages that vary, or no partner for it) are read by their markup alone: all
  articles, else the main elements, else the body. Blocks are the runs of text between block-level tags.

References are broadcast only if their size was measured to be below ``max_broadcast`` bytes; beyond it pages are joined
with them by host, and a frequent host is split by adaptive execution.

Defined cases: null or empty html gives no text; a null url is a host of its own; a host with few pages has no template;
repeated rows are each extracted; where an identifier is null everywhere in a host there is no reference; several
articles all stay, in page order, and ties between slots go to the first; child lists whose product is over ``MAX_CELLS``
are matched in the same way with few rows of the table held; nodes deeper than ``MAX_DEPTH`` hang below the node at that
depth, with all their text; an end tag without a start is passed over and what is open at the end is closed; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import html as html_lib
import math
import re
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.storage import materialize, read_table, ship

MAX_CELLS = 20_000
MAX_DEPTH = 150
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript iframe noembed noframes xmp textarea title template svg annotation annotation-xml".split())
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split())
_CLOSES_P = _BLOCK - frozenset("caption td th tr tbody thead tfoot option legend summary html body".split())
#: Start tag: the open tags it ends, and the tags beyond which it doesn't look.
_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select"}),
}
_BOILERPLATE_TAGS = frozenset("nav aside footer form button select input label dialog menu object embed canvas audio video".split())
_BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar".split())
_BOILERPLATE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion sidebar menu nav navbar navigation breadcrumb breadcrumbs footer masthead cookie cookies consent gdpr notice notices "
    "popup modal overlay newsletter subscribe subscription share sharing social comment comments respond disqus related recommended widget toolbar pagination pager skip hidden".split()
)
_START = re.compile(r"([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
_ATTRIBUTE = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_CUT = re.compile(r"[^a-z0-9]+")
_TEXT_BLOCKS = frozenset("blockquote dl h1 h2 h3 h4 h5 h6 ol p pre ul".split())
_CONTAINERS = frozenset("article body center div html main section table tbody td tr".split())


class Node:
    __slots__ = ("attributes", "blocks", "children", "linked", "number", "tag", "text")

    def __init__(self, tag: str, attributes: str = ""):
        self.tag, self.attributes = tag, attributes
        self.children: list[Node | str] = []
        self.number = -1
        self.blocks: list[Node] | None = None
        self.text: str | None = None
        self.linked = 0


def parse(page: str) -> Node:
    """The tree of a page; text is decoded."""
    root = Node("html")
    stack, at, n = [root], 0, len(page)
    while at < n:
        tag = page.find("<", at)
        if tag < 0:
            tag = n
        if tag > at:
            stack[-1].children.append(html_lib.unescape(page[at:tag]))
        if tag >= n:
            break
        following = page[tag + 1 : tag + 2]
        if following == "!" or following == "?":
            if page.startswith("<!--", tag):
                end = page.find("-->", tag + 4)
                at = end + 3 if end >= 0 else n
            else:
                end = page.find(">", tag)
                at = end + 1 if end >= 0 else n
        elif following == "/":
            end = page.find(">", tag)
            if end < 0:
                break
            found = re.match(r"[a-zA-Z][^\s/>]*", page[tag + 2 : end])
            if found:
                name = found[0].lower()
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == name:
                        del stack[k:]
                        break
            at = end + 1
        elif following.isascii() and following.isalpha():
            found = _START.match(page, tag + 1)
            if not found:
                break  # the page ends inside a tag
            name, at = found[1].lower(), found.end()
            if name in _RAW and not found[2].endswith("/"):
                close = re.compile(f"</{re.escape(name)}(?=[\\s/>])", re.I).search(page, at)
                end = page.find(">", close.end()) if close else -1
                at = end + 1 if end >= 0 else n
                continue
            if name == "html":
                continue
            _open(stack, name, found[2])
        else:
            stack[-1].children.append("<")
            at = tag + 1
    return root


def _open(stack: list[Node], name: str, attributes: str) -> None:
    if name in _CLOSES_P:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag == "p":
                del stack[k:]
                break
            if stack[k].tag in ("td", "th", "button", "table", "caption"):
                break
    if name in _ENDS:
        ended, stop = _ENDS[name]
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in stop:
                break
            if stack[k].tag in ended:
                del stack[k:]
                if name not in ("tr", "tbody", "tfoot"):
                    break
                return _open(stack, name, attributes)
    node = Node(name, attributes)
    stack[-1].children.append(node)
    if name not in _VOID and len(stack) < MAX_DEPTH:
        stack.append(node)


def squeeze(text: str) -> str:
    return " ".join(text.split())


def _attributes(node: Node) -> dict[str, str]:
    return {a.lower(): html_lib.unescape(b or c or d or "") for a, b, c, d in _ATTRIBUTE.findall(node.attributes)} if node.attributes.strip() else {}


def is_boilerplate(node: Node, in_article: bool) -> bool:
    if node.tag in _BOILERPLATE_TAGS or (node.tag == "header" and not in_article):
        return True
    own = _attributes(node)
    if not own:
        return False
    if own.get("role", "").lower() in _BOILERPLATE_ROLES or "hidden" in own or own.get("aria-hidden") == "true":
        return True
    if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", own.get("style", "")):
        return True
    if node.tag in ("article", "main", "body"):
        return False
    names = set(_CUT.split(f"{own.get('class', '')} {own.get('id', '')}".lower()))
    return bool(names & _BOILERPLATE_NAMES) or ("header" in names and not in_article)


def is_main(node: Node) -> bool:
    return node.tag == "main" or "main" in node.attributes and _attributes(node).get("role") == "main"


def main_nodes(root: Node) -> list[Node]:
    """The outermost articles below a node, else the outermost main elements, else the node itself.

    Where a main element has its title beside its articles, the title comes with them.
    """
    if root.tag == "article":
        return [root]
    articles: list[Node] = []
    mains: list[Node] = []
    titles: list[Node] = []

    def look(node: Node, in_main: bool) -> None:
        for c in node.children:
            if not isinstance(c, Node) or is_boilerplate(c, in_main):
                continue
            if c.tag == "article":
                articles.append(c)
                continue
            if c.tag == "h1" and in_main and not articles:
                titles.append(c)
            own = is_main(c)
            if own and not in_main:
                mains.append(c)
            look(c, in_main or own)

    look(root, is_main(root))
    if articles:
        return articles if _has(articles[0], "h1") else titles + articles
    return mains or [root]


def _has(node: Node, tag: str) -> bool:
    return any(isinstance(c, Node) and (c.tag == tag or _has(c, tag)) for c in node.children)


def block_nodes(node: Node) -> list[Node]:
    """Children that take part in alignment: block-level ones, also those inside inline ones."""
    if node.blocks is None:
        node.blocks = []
        for c in node.children:
            if isinstance(c, Node):
                if c.tag in _BLOCK:
                    node.blocks.append(c)
                else:
                    node.blocks += block_nodes(c)
    return node.blocks


def own_text(node: Node) -> str:
    """Text of a node outside its block-level descendants; notes how many characters of it are inside links."""
    if node.text is None:
        parts: list[str] = []

        def gather(x: Node, linked: bool) -> None:
            for c in x.children:
                if isinstance(c, str):
                    parts.append(c)
                    if linked:
                        node.linked += len(c)
                elif c.tag in _BLOCK or c.tag == "br":
                    parts.append(" ")
                    if c.tag not in _BLOCK:
                        gather(c, linked)
                else:
                    gather(c, linked or c.tag == "a")

        gather(node, False)
        node.text = squeeze("".join(parts))
    return node.text


def _match(a: Node, b: Node, memo: dict) -> int:
    """Weight of the best matching of two trees: 2 for each pair, and 1 more if their own text is the same."""
    key = (id(a), id(b))
    if key in memo:
        return memo[key][0]
    if a.tag != b.tag:
        memo[key] = (0, ())
        return 0
    weight, pairs = _children(block_nodes(a), block_nodes(b), memo)
    weight += 2 + (own_text(a) == own_text(b))
    memo[key] = (weight, pairs)
    return weight


def _children(xs: list[Node], ys: list[Node], memo: dict) -> tuple[int, list[tuple[Node, Node]]]:
    if not xs or not ys:
        return 0, []
    if len(xs) * len(ys) > MAX_CELLS:
        return _long_children(xs, ys, memo)
    best = [[0] * (len(ys) + 1) for _ in range(len(xs) + 1)]
    right = [(y, y.tag, bool(block_nodes(y)), own_text(y)) for y in ys]
    for i, x in enumerate(xs, 1):
        row, above, last = best[i], best[i - 1], 0
        tag, deep, text = x.tag, bool(block_nodes(x)), own_text(x)
        for j, (y, y_tag, y_deep, y_text) in enumerate(right, 1):
            up = above[j]
            if up > last:
                last = up
            if tag == y_tag:
                w = above[j - 1] + (_match(x, y, memo) if deep and y_deep else 2 + (text == y_text))
                if w > last:
                    last = w
            row[j] = last
    pairs, i, j = [], len(xs), len(ys)
    while i and j:
        if best[i][j] == best[i - 1][j]:
            i -= 1
        elif best[i][j] == best[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            pairs.append((xs[i], ys[j]))
    return best[-1][-1], pairs


def _long_children(xs: list[Node], ys: list[Node], memo: dict) -> tuple[int, list[tuple[Node, Node]]]:
    """The matching of _children for long lists: a row of the table at a time, with only some rows kept.

    The way back makes the rows between two kept ones again, so a table of n rows needs the memory of 2 sqrt(n).
    """
    tags, texts = np.array([y.tag for y in ys], object), np.array([own_text(y) for y in ys], object)
    deep = np.array([bool(block_nodes(y)) for y in ys])

    def below(above: np.ndarray, x: Node) -> np.ndarray:
        same = tags == x.tag
        gain = np.where(same, 2 + (texts == own_text(x)), 0)
        if block_nodes(x):
            for j in np.nonzero(same & deep)[0]:
                gain[j] = _match(x, ys[j], {})
        return np.maximum.accumulate(np.concatenate([[0], np.maximum(above[1:], np.where(same, above[:-1] + gain, 0))]))

    step, row, kept = math.isqrt(len(xs)) + 1, np.zeros(len(ys) + 1, np.int64), []
    for i, x in enumerate(xs):
        if i % step == 0:
            kept.append(row)
        row = below(row, x)
    pairs, j = [], len(ys)
    for start in range((len(kept) - 1) * step, -1, -step):
        rows = [kept.pop()]
        for x in xs[start : start + step]:
            rows.append(below(rows[-1], x))
        i = len(rows) - 1
        while i and j:
            if rows[i][j] == rows[i - 1][j]:
                i -= 1
            elif rows[i][j] == rows[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                pairs.append((xs[start + i], ys[j]))
    for x, y in pairs:
        _match(x, y, memo)
    return int(row[-1]), pairs


def align(reference: Node, page: Node) -> list[tuple[Node, Node]]:
    """Pairs of nodes by simple tree matching."""
    memo: dict = {}
    _match(reference, page, memo)
    out, queue = [], [(reference, page)]
    while queue:
        a, b = queue.pop()
        out.append((a, b))
        queue.extend(memo.get((id(a), id(b)), (0, ()))[1])
    return out


def number(root: Node) -> Node:
    """Gives the block-level nodes their numbers, in page order."""
    count, queue = 0, [root]
    while queue:
        node = queue.pop()
        node.number = count
        count += 1
        queue.extend(reversed(block_nodes(node)))
    return root


def slot_masses(root: Node, pairs: list[tuple[Node, Node]]) -> dict[int, tuple[int, int]]:
    """For each reference node, the thousandths of the page's varying text that it holds: outside and inside links."""
    partner = {id(b): a for a, b in pairs}
    found: dict[int, list[int]] = {}
    queue: list[tuple[Node, Node | None]] = [(root, None)]
    while queue:
        node, above = queue.pop()
        slot = partner.get(id(node))
        if slot is None and is_boilerplate(node, False):
            continue
        text = own_text(node)
        if text and not (slot is not None and own_text(slot) == text):
            linked = min(node.linked, len(text))
            mass = found.setdefault((slot or above).number, [0, 0])
            mass[0] += len(text) - linked
            mass[1] += linked
        queue.extend((c, slot or above) for c in block_nodes(node))
    total = sum(map(sum, found.values()))
    return {k: (round(1000 * a / total), round(1000 * b / total)) for k, (a, b) in found.items()} if total else {}


def main_slot(root: Node, masses: dict[int, tuple[int, int]]) -> tuple[int, list[int]]:
    """The number of the reference node that holds the content, and those of the menus in it; -1 where nothing varies."""
    inside: dict[int, tuple[int, int]] = {}

    def add(node: Node) -> tuple[int, int]:
        a, b = masses.get(node.number, (0, 0))
        for c in block_nodes(node):
            x, y = add(c)
            a, b = a + x, b + y
        inside[node.number] = a, b
        return a, b

    def text(node: Node) -> int:
        return inside[node.number][0]

    add(root)
    if not text(root):
        return -1, []
    node = root
    while node.tag != "article":
        below = block_nodes(node)
        varying = [c for c in below if text(c) and not is_boilerplate(c, False)]
        if not varying or sum(c.tag == "article" for c in varying) > 1 or any(c.tag == "h1" for c in varying):
            break
        most = max(map(text, varying))
        marked = [c for c in varying if 4 * text(c) >= most and (c.tag == "article" or is_main(c))]
        into = max(marked or varying, key=text)
        left = sum(text(c) for c in varying if c.tag in _TEXT_BLOCKS) + masses.get(node.number, (0, 0))[0]
        if into.tag not in _CONTAINERS or not marked and (2 * text(into) < text(node) or 4 * left > text(node)):
            break
        node = into
    menus, queue = [], [] if node.tag == "article" else block_nodes(node)[:]
    while queue:
        c = queue.pop()
        a, b = inside[c.number]
        if a + b and b >= 4 * a:
            menus.append(c.number)
        elif c.tag != "article" and not is_main(c):
            queue.extend(block_nodes(c))
    return node.number, sorted(menus)


def content_nodes(root: Node, region: Node | None) -> list[Node]:
    """Where the content of a page is, given the node of its main slot."""
    if region is None:
        return main_nodes(root)
    around: list[Node] = []

    def look(node: Node) -> bool:
        if node is region or any(isinstance(c, Node) and look(c) for c in node.children):
            around.append(node)
            return True
        return False

    look(root)
    outer = [x for x in reversed(around) if x.tag == "article" and not is_boilerplate(x, False)]
    return outer[:1] or main_nodes(region)


def extract(root: Node, template: set[int] | None = None, region: Node | None = None, menus: set[int] | None = None) -> list[str]:
    """The blocks of the main text. template: id() of the nodes whose own text is left out; menus: of those left out whole."""
    blocks: list[str] = []
    parts: list[str] = []

    def flush() -> None:
        text = squeeze("".join(parts))
        parts.clear()
        if text:
            blocks.append(text)

    def walk(node: Node, skip: bool, in_article: bool) -> None:
        for c in node.children:
            if isinstance(c, str):
                if not skip:
                    parts.append(c)
                continue
            if c.tag == "br":
                parts.append(" ")
                walk(c, skip, in_article)
            elif c.tag in _BLOCK:
                flush()
                if not is_boilerplate(c, in_article) and not (in_article and c.tag == "article") and not (menus and id(c) in menus):
                    walk(c, bool(template) and id(c) in template, in_article)
                    flush()
            elif not is_boilerplate(c, in_article):
                walk(c, skip, in_article)

    for node in content_nodes(root, region):
        walk(node, bool(template) and id(node) in template, node.tag == "article")
        flush()
    return blocks


def extract_pages(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_share: float = 0.8, min_pages: int = 5, min_region: int = 3, max_broadcast: int = 16 << 20) -> DataFrame:
    """(identifier, url, blocks) for every row."""
    spark = df.sparkSession
    ship(spark)
    host = F.coalesce(F.lower(F.regexp_extract(url_col, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))
    pages = df.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"), host.alias("host"))
    first = materialize(pages.groupBy("host").agg(F.min("id").alias("id"), F.count("*").alias("n")).where(F.col("n") > min(min_pages, min_region)).select("host", "id"), "page-hosts")
    few = first.count() <= 100_000  # short rows, so they can be broadcast below that number
    refs = pages.join(F.broadcast(first) if few else first, ["host", "id"]).groupBy("host").agg(F.min("html").alias("ref"))
    refs = materialize(refs, "page-references")
    small = (refs.agg(F.sum(F.octet_length("ref"))).first()[0] or 0) <= max_broadcast

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = _Trees()
        for batch in batches:
            votes: dict[tuple, list[int]] = {}
            for name, text, ref in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if text == ref:
                    continue
                root = parse(text)
                pairs = align(trees.get(name, ref), root)
                masses = slot_masses(root, pairs)
                if not masses:
                    continue  # tells nothing about what varies
                rows = {a.number: [1, int(own_text(a) == own_text(b)), 0, 0] for a, b in pairs if own_text(a)}
                for k, mass in masses.items():
                    rows.setdefault(k, [0, 0, 0, 0])[2:] = mass
                rows.setdefault(0, [0, 0, 0, 0]).append(1)  # the root tells how many pages voted
                for k, row in rows.items():
                    total = votes.setdefault((name, k), [0] * 5)
                    for i, x in enumerate(row):
                        total[i] += x
            hosts, nodes = zip(*votes, strict=True) if votes else ((), ())
            sums = np.array(list(votes.values()), np.int64).reshape(-1, 5).T
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(nodes, pa.int32()), *(pa.array(np.ascontiguousarray(x)) for x in sums)], ["host", "node", *_VOTES])

    voters = pages.join(F.broadcast(refs) if small else refs, "host").select("host", "html", "ref")
    counts = voters.mapInArrow(vote, "host string, node int, " + ", ".join(f"{c} long" for c in _VOTES)).groupBy("host", "node").agg(*(F.sum(c).alias(c) for c in _VOTES))
    # A group here has at most the nodes of one page, the reference.
    tallies = counts.groupBy("host").agg(F.collect_list(F.struct("node", *_VOTES)).alias("tally")).join(refs, "host").select("host", "ref", "tally")

    def induce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for ref, tally in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                voters = sum(t["pages"] for t in tally)
                constant = [t["node"] for t in tally if t["n"] >= min_pages and t["same"] >= min_share * t["n"]]
                region, menus = main_slot(number(parse(ref)), {t["node"]: (t["text"], t["linked"]) for t in tally}) if voters >= min_region else (-1, [])
                made.append((sorted(constant), region, menus))
            columns = zip(*made, strict=True) if made else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, t) for c, t in zip(columns, (pa.list_(pa.int32()), pa.int32(), pa.list_(pa.int32())), strict=True))], ["host", "ref", "nodes", "region", "menus"])

    wrappers = tallies.mapInArrow(induce, "host string, ref string, nodes array<int>, region int, menus array<int>")
    wrappers = materialize(wrappers, "page-wrappers")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = _Trees()
        for batch in batches:
            out = []
            for name, text, ref, nodes, region, menus in zip(*(batch.column(k).to_pylist() for k in range(2, 8)), strict=True):
                root, template, main, dropped = parse(text), set(), None, set()
                if ref is not None and (nodes or region >= 0):
                    fixed, lists = set(nodes), set(menus)
                    for a, b in align(trees.get(name, ref), root):
                        if a.number in fixed and own_text(a) == own_text(b):
                            template.add(id(b))
                        if a.number == region:
                            main = b
                        if a.number in lists:
                            dropped.add(id(b))
                out.append(extract(root, template, main, dropped))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.string()))], ["id", "url", "blocks"])

    kind = dict(df.dtypes)[id_col]
    paired = pages.join(F.broadcast(wrappers) if small else wrappers, "host", "left")
    found = paired.select("id", "url", "host", "html", "ref", "nodes", "region", "menus").mapInArrow(run, f"id {kind}, url string, blocks array<string>")
    return found.withColumnsRenamed({"id": id_col, "url": url_col})


#: Sums for a reference node: pages that have a partner for it, those of the same text, thousandths of varying text outside and inside links; pages (at the root).
_VOTES = ["n", "same", "text", "linked", "pages"]


class _Trees:
    """The numbered trees of the references that a task met last."""

    def __init__(self, most: int = 64):
        self.most, self.held = most, OrderedDict()

    def get(self, host: str, ref: str) -> Node:
        if host not in self.held:
            self.held[host] = number(parse(ref))
            if len(self.held) > self.most:
                self.held.popitem(last=False)
        self.held.move_to_end(host)
        return self.held[host]


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract_pages(read_table(spark, sf_dir, "pages"))
    text = F.array_join("blocks", "\n\n")
    return found.select("page_id", "url", text.alias("text"), F.length(text).cast("long").alias("n_chars"))
